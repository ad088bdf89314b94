"""URL filters, sharding, chat formatting and quality rules."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.llm import chat_formatting as chat
from sluice.llm import quality_rules, sharding, url_filters

PAGES = "page_id long, url string, html string, host string, said string"


def test_url_filters_equal_their_sql(same):
    same(url_filters.op1, url_filters.SQL)


def test_url_parts_rules_and_odd_rows(spark):
    rows = [(1, "http://Example.NET/en/x", "", "h", "s"), (2, "http://a.example.net/en", None, "h", "s"), (3, "https://x.org/fr/?q", "", None, None), (4, None, None, "h", "s"), (5, "no scheme", "", "h", "s"), (5, "no scheme", "", "h", "s"),
            (6, "a://EXAMPLE.com/de/#f", "", "h", "s"), (7, "a://notexample.com/de/", "", "h", "s"), (8, "://", "", "h", "s"), (9, "q://net?u=a://b", "", "h", "s")]
    got = {r["page_id"]: r for r in url_filters.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("net/", "block")
    assert (got[3]["rule"], got[3]["verdict"]) == ("org/fr/", "allow")
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in (4, 5, 8)] == [("", "", None)] * 3
    assert (got[6]["rule"], got[6]["verdict"]) == ("example.com/de/", "block") and got[7]["rule"] is None
    assert (got[9]["host"], got[9]["path"], got[9]["rule"]) == ("net", "", None)
    assert url_filters.filter_urls(spark.createDataFrame(rows, PAGES)).count() == len(rows)
    assert url_filters.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_trust_follows_links_and_distrust_goes_against_them(spark):
    link = lambda h: f'<a href="http://{h}/p">'
    rows = [(1, "http://good.org/fr/", link("friend.tv"), "", ""), (2, "http://friend.tv/", "", "", ""), (3, "http://spam.tv/", link("bad.net"), "", ""), (4, "http://bad.net/", "", "", ""), (5, "http://alone.tv/", "", "", "")]
    got = {r["page_id"]: r for r in url_filters.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[2]["trust"] > 0 == got[2]["distrust"] and got[2]["verdict"] == "allow"
    assert got[3]["distrust"] > got[3]["trust"] and got[3]["verdict"] == "block"
    assert got[5]["verdict"] == "allow" and got[5]["trust"] == got[5]["distrust"] == 0


def test_propagation_by_hand(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")]
    seeds = [("a", 10**12, 0), ("d", 0, 10**12)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filters.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "host string, trust long, distrust long")).collect()}
    for side in (0, 1):
        flow = [e if side == 0 else e[::-1] for e in edges]
        out = defaultdict(list)
        for u, v in flow:
            out[u].append(v)
        seed = {h: s[side] for h, *s in seeds}
        score = {h: seed.get(h, 0) for h in "abcd"}
        for _ in range(url_filters.ROUNDS):
            new = Counter()
            for u in score:
                for v in out[u]:
                    new[v] += score[u] // len(out[u])
            score = {h: (15 * seed.get(h, 0) + 85 * new[h]) // 100 for h in score}
        assert {h: got[h][side] for h in "abcd"} == score


DOCS = "doc_id long, source string, text string, shard string, size string, _h string"


def test_shards_are_gapless_even_and_mixed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.interleave(docs).collect()
    n = len(rows)
    assert n == docs.count() and {r["law"] for r in rows} == {"rows"}
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    assert sorted(shards) == list(range(16)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for s in shards.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    whole = Counter(r["source"] for r in rows)
    for s in shards.values():
        part = Counter(r["source"] for r in s)
        assert all(abs(part[k] - whole[k] * len(s) / n) <= 1 + len(whole) for k in whole)


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None, "a", "b", "c"), (1, "x", "", "a", "b", "c"), (1, "x", "", "a", "b", "c"), (2, None, "é", "a", "b", "c")] + [(3, "hot", "same", "", "", "")] * 50
    got = sharding.interleave(spark.createDataFrame(rows, DOCS), 4).collect()
    assert len(got) == len(rows) and {r["size"] for r in got} == {1, 3, 5}
    assert max(Counter(r["shard"] for r in got).values()) - min(Counter(r["shard"] for r in got).values()) <= 1
    assert {r["text_crc32"] for r in got if r["size"] == 1} == {0}
    assert sharding.interleave(spark.createDataFrame([], DOCS), 4).count() == 0
    few = sharding.interleave(spark.createDataFrame(rows[:2], DOCS), 16).collect()
    assert len({r["shard"] for r in few}) == 2


MSG = "conv long, node long, parent long, role string, text string, score double, formatted string"


def test_chat_equals_its_sql(same):
    same(chat.op7, chat.SQL)


@pytest.mark.parametrize("text", ["\\### Assistant: </turn> ok", "", "\\\\h###\\t</turn>\\", "#### x", "</turn></turn>\n### user: a", "a: b\\c", "\\h \\t \\c"])
def test_escapes_are_reversible(spark, text):
    c = spark.range(1).select(F.lit(text).alias("t"))
    for role in (False, True):
        e, back = c.select(chat.escape(F.col("t"), role).alias("e")).select("e", chat.unescape(F.col("e")).alias("b")).first()
        assert back == text and "###" not in e and "</turn>" not in e and (not role or ":" not in e)


def test_trees_give_every_path_and_rank_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0, "x"), (1, 2, 1, "assistant", "a", 2.0, "x"), (1, 3, 1, "assistant", "b", 1.0, "x"), (1, 4, 3, "user", None, 5.0, "x"), (2, 9, 77, "user", "lost parent", None, "x"),
            (3, 1, 2, "user", "circle", 1.0, "x"), (3, 2, 1, "user", "circle", 1.0, "x"), (4, 1, None, None, "no role", 0.0, "x")] + [(5, k, k - 1 if k else None, "user" if k % 2 == 0 else "assistant", f"t{k}", 0.0, "x") for k in range(70)]
    got = chat.format_trees(spark.createDataFrame(rows, MSG), best=1).collect()
    one = {r["conv"]: r for r in got}
    assert sorted(one) == [1, 2, 4, 5] and len(got) == 4
    assert one[1]["formatted"] == "### user: q</turn>\n### assistant: b</turn>\n### user: </turn>\n" and one[1]["score"] == 6.0
    assert one[5]["n_turns"] == 70 and one[5]["formatted"].count("</turn>") == 70
    every = chat.format_trees(spark.createDataFrame(rows, MSG)).filter("conv = 1").collect()
    assert {r["leaf"] for r in every} == {2, 4}
    start, length = one[1]["loss_spans"][0]
    assert one[1]["formatted"][start - 1 : start - 1 + length] == "b"
    assert chat.format_trees(spark.createDataFrame([], MSG)).count() == 0


def test_quality_rules_equal_their_sql(same):
    same(quality_rules.op8, quality_rules.SQL)


def brute(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_base_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t ", "a b c d e " * 3, "one\ntwo\none\n\n", "#<>é 𝒳 *|&%$", "x " * 5000, "a b c d e f a b c d e", "\x0b\x0c mixed\rspace"]
    df = spark.createDataFrame([(k, t, "h", 9) for k, t in enumerate(texts)], "doc_id long, text string, source string, n_words long")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality_rules.apply_quality_rules(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_common_lines_deplete_documents(spark):
    own = "a text of its own with quite enough different words to pass the base rules number {}"
    rows = [(k, "menu home about 7\n" + own.format("abcdefghij"[k % 10] * (k + 1)), "h") for k in range(40)] + [(100, "Menu  home about 12\nmenu home about 3 menu\n", "h"), (101, "menu home about 1 one two three four five six seven\n" + "menu home about 5\n" * 9, "h"), (102, "menu home about 7\n", None)]
    rows += rows[:1]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(df, line_docs=20, line_share=0.5).collect()}
    assert all(got[k]["n_removed_words"] == 4 and got[k]["kept"] for k in range(40))
    assert got[101]["n_removed_words"] == 36 and not got[101]["kept"] and got[102]["n_removed_words"] == 0
    assert quality_rules.apply_quality_rules(df, line_docs=20, line_share=0.5).count() == len(rows)
    assert quality_rules.apply_quality_rules(df.limit(0)).count() == 0
    assert math.isclose(quality_rules.LEAST_LEFT, 0.3)
