"""Toxicity, decontamination, packing, line dedup, language-model scores and near-duplicates."""

import hashlib
import itertools
import math
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import benchmark_decontamination as decon
from sluice.llm import components, line_dedup, lm_scoring, packing, simhash_dedup, toxicity
from sluice.llm.common import from_varints

DOC = "doc_id long, text string, score double, n_words long, row_id string"
ODD = [(None, "no id at all", 0.5, 1, "x"), (1, None, 0.5, 1, "x"), (2, "", 0.5, 1, "x"), (3, " \n\t", 0.5, 1, "x"), (4, "word", 0.5, 1, "x"), (4, "word", 0.5, 1, "x"), (5, "a b\nc d\na b\nc d " * 3000, 0.5, 1, "x"), (6, "é 𝒳 ß\u0000z", 0.5, 1, "x")]


def odd(spark):
    return spark.createDataFrame(ODD, DOC)


# toxicity


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    assert auc([(r["score"], r["toxic"]) for r in got]) > 0.95
    caught = sum(r["predicted"] for r in got if r["toxic"]) / max(1, sum(r["toxic"] for r in got))
    wrong = sum(r["predicted"] for r in got if not r["toxic"]) / sum(not r["toxic"] for r in got)
    assert caught > 0.75 and wrong < 0.02


def test_toxicity_decoder(spark):
    model = toxicity.language_model(spark.createDataFrame([("you are an idiot and a stupid fool, said the awful moron " * 30,)], "text string"))
    d = toxicity.Decoder(model)
    for seen, meant in (("1d10t", "idiot"), ("stup!d", "stupid"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("aw4ul", "awaul")):
        if meant != "awaul":
            assert d(seen) == meant
    assert d.restore("plain words stay") == "plain words stay"
    assert "idiot" in d.restore("what an i d i o t he is")


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert toxicity.score_toxicity(odd(spark).limit(0), labels).count() == 0
    assert max(r["score"] for r in toxicity.score_toxicity(odd(spark), labels.limit(0)).collect()) < 1e-6
    assert toxicity.drop_toxic(odd(spark), labels.limit(0)).columns == odd(spark).columns


def test_toxicity_ignores_ids_and_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.id_remainder(F.col("doc_id"), 4) == 2
    a = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))).collect()}
    assert a == b


# decontamination


def find(docs, items, width):
    out = []
    for _, text in docs:
        t = decon.tokens(text)
        hit, names = set(), set()
        for name, item in items:
            w = decon.tokens(item)
            for k in range(max(1, len(w) - width + 1) if w else 0):
                x = w[k : k + width]
                for i in range(len(t) - len(x) + 1):
                    if t[i : i + len(x)] == x:
                        hit |= set(range(i, i + len(x)))
                        names.add(str(name))
        out.append((len(t), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def near(docs, items, width, slop):
    """Items of which a window of width words stands in each text, in order with at most slop other words between."""
    out = []
    for _, text in docs:
        t, names = decon.tokens(text), set()
        for name, item in items:
            w = decon.tokens(item)
            for k in range(len(w) - width + 1):
                for i, x in enumerate(t):
                    at = i if x == w[k] else None
                    for y in w[k + 1 : k + width]:
                        at = next((j for j in range(at + 1, len(t)) if t[j] == y), None) if at is not None else None
                    if at is not None and at - i + 1 - width <= slop:
                        names.add(str(name))
        out.append(len(names))
    return out


@pytest.mark.parametrize("segment,width,slop", [(1 << 21, 3, 2), (40, 5, 2), (1 << 21, 6, 0)])
def test_decontamination_equals_brute_force(spark, segment, width, slop):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "é1"], n))
    items = [(f"q{k}", text(n)) for k, n in enumerate((0, 1, 2, 3, 5, 8, 8))] + [("q1", "b a"), (None, "a"), ("q9", None), ("q3", "A-b.c")]
    docs = [(k, text(n)) for k, n in enumerate((0, 1, 4, 30, 30, 200))] + [(9, None), (10, "c" * 5000), (11, "x, B!a?"), (11, "x, B!a?")]
    got = decon.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), width=width, slop=slop, segment_words=segment)
    rows = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], r["n_near_items"]) for r in got.collect())
    items = [i for i in items if i[0] is not None and i[1] is not None]
    assert rows == sorted((d[0], *f, n) for d, f, n in zip(docs, find(docs, items, width), near(docs, items, width, slop)))


def test_phrases_are_found_with_words_put_in(spark):
    docs = spark.createDataFrame([(1, "a x b y c z"), (2, "b a b c"), (3, "c b a"), (4, "a b"), (5, "c")], "doc_id long, text string")
    index, at = decon.build_index(docs)
    find = lambda p, slop: sorted((r["doc_id"], r["first"], r["end"], r["exact"]) for r in decon.search(index, spark.createDataFrame([(p.encode(),)], "phrase binary"), slop).join(index.filter("term IS NULL").select("seg", "start", "doc_id"), ["seg", "start"]).collect())
    assert find("a b c", 2) == [(1, 0, 5, False), (2, 1, 4, True)] and find("a b c", 1) == [(2, 1, 4, True)]
    assert find("a b c q", 2) == [] and find("c", 3) == [(1, 4, 5, True), (2, 3, 4, True), (3, 0, 1, True), (5, 0, 1, True)]
    decon.forget(spark, at)
    with pytest.raises(ValueError):
        decon.search(index, docs, decon.GAP)


def test_numbers_of_any_size_pack_and_unpack():
    from sluice.llm.common import from_varints, to_varints

    v = np.array([0, 1, 127, 128, 300, 2**32, 2**63 - 1, 2**64 - 1], np.uint64)
    raw, ends = to_varints(v)
    assert (from_varints(raw) == v).all() and (from_varints(raw[ends[2] : ends[4]].tobytes()) == v[2:4]).all() and len(from_varints(b"")) == 0


def test_many_windows_of_few_words_stay_small(spark):
    rng = np.random.default_rng(1)
    digits = lambda n: " ".join(map(str, rng.integers(0, 10, n)))
    doc = digits(20_000)
    items = [(f"{k}", digits(10)) for k in range(5000)] + [("in", " ".join(doc.split()[777:787]))] + [(f"p{k}", "one shared prompt that every item of this set begins with " + str(k)) for k in range(3000)]
    got = decon.find_contamination(spark.createDataFrame([(1, doc), (2, "One shared prompt that every item of this set begins with 7!")], "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert "in" in rows[1]["items"] and rows[1]["n_hit"] >= 10 and rows[2]["n_items"] == 3000 and rows[2]["n_hit"] == 12  # its last word is in the third window of p7


def test_decontamination_equals_its_sql(same):
    same(decon.op3, decon.SQL)


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([("1", "word")], "item_id string, text string")
    got = decon.find_contamination(odd(spark), items).collect()
    assert len(got) == len(ODD) and sum(r["contaminated"] for r in got) == 2
    assert decon.find_contamination(odd(spark), items.limit(0)).filter("contaminated").count() == 0
    assert decon.find_contamination(odd(spark).limit(0), items).count() == 0
    kept = decon.drop_contaminated(odd(spark), items)
    assert kept.count() == len(ODD) - 2 and kept.columns == odd(spark).columns


def test_extra_columns_of_any_name_stay(spark):
    names = ["t", "T_", "_t", "_th", "a", "b", "copies", "row", "_i", "_id", "_h", "_lines", "_gone", "_copies", "i", "_a", "doc"]
    docs = spark.createDataFrame([(1, "some words here", *range(len(names))), (1, "some words here", *range(len(names))), (2, None, *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    items, labels = spark.createDataFrame([("1", "other")], "item_id string, text string"), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for out, n in ((decon.drop_contaminated(docs, items), 3), (toxicity.drop_toxic(docs, labels), 3), (simhash_dedup.drop_near_duplicates(docs), 2), (line_dedup.dedup_lines(docs, passage_words=50), 3)):
        assert out.columns[: len(docs.columns)] == docs.columns and out.count() == n
        assert {tuple(r)[2 : 2 + len(names)] for r in out.collect()} == {tuple(range(len(names)))}


# packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 6)), min_size=1, max_size=9), st.integers(4, 9))
def test_cuts_cost_least(steps, width):
    at = [0, *itertools.accumulate(s for s, _ in steps)]
    cost = [0, *(c for _, c in steps)]
    price = lambda cuts: sum(width - (at[b] - at[a]) + cost[b] for a, b in zip(cuts, cuts[1:]))
    every = [(0, *c, len(at) - 1) for n in range(len(at) - 1) for c in itertools.combinations(range(1, len(at) - 1), n)]
    best = min(price(c) for c in every if all(at[b] - at[a] <= width for a, b in zip(c, c[1:])))
    got = packing.choose_cuts(at, cost, width)
    assert price(got) == best and all(at[b] - at[a] <= width for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("width,block", [(1024, 1 << 20), (64, 500)])
def test_packing_holds_every_id_once(spark, sf, width, block):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("doc_id % 4 = 0").unionByName(odd(spark).select((F.col("doc_id") + 10**9).alias("doc_id"), "text").filter("doc_id IS NOT NULL").distinct())
    docs = docs.unionByName(spark.createDataFrame([(2 * 10**9, "ends <|endoftext|> here")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, width=width, block=block).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for k, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]])) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= width
    total = sum(r["length"] for rows in sequences.values() for r in rows)
    assert total / (width * len(sequences)) > (0.9 if width == 1024 else 0.85)


def test_packing_of_odd_rows(spark):
    got = packing.pack(odd(spark)).collect()
    assert sum(r["length"] for r in got if r["doc_id"] in (1, 2)) == 2 and sum(r["start"] == 0 for r in got) == len(ODD)
    assert packing.pack(odd(spark).limit(0)).count() == 0


def test_near_duplicates_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(9)
    docs, linked, apart = [], [], []
    for g in range(60):  # 400 words, then some changed far apart: each takes 5 of 396 shingles
        t = [f"w{k}" for k in rng.integers(0, 5000, 400)]
        near, far = list(t), list(t)
        for k in range(8):
            near[20 + 45 * k] = f"near{k}"
        for k in range(10):
            far[10 + 39 * k] = f"far{k}"
        linked.append((2 * g, 2 * g + 1) if g < 40 else None)
        docs += [(2 * g, " ".join(t)), (2 * g + 1, " ".join(near if g < 40 else far))]
        apart += [] if g < 40 else [2 * g, 2 * g + 1]
    sets = [set(zip(*[d[1].split()[k:] for k in range(5)])) for d in docs]
    alike = [len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]) for g in range(60)]
    assert all(0.8 <= s < 0.83 for s in alike[:40]) and all(0.75 < s < 0.8 for s in alike[40:])
    kept = {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {a for a, _ in linked[:40]} | set(apart)


def test_near_duplicates_come_out_of_simhash_too(spark):
    rng = np.random.default_rng(11)
    docs, alike = [], []
    while len(docs) < 12:  # a word of 45 changed: too few five-word shingles are left, of three words enough; SimHash has some such pairs within two bits
        t = [f"w{k}" for k in rng.integers(0, 5000, 45)]
        u = [*t[:22], "new", *t[23:]]
        if bin(fingerprint(" ".join(t)) ^ fingerprint(" ".join(u))).count("1") <= 2:
            five, three = ([set(zip(*[x[k:] for k in range(n)])) for x in (t, u)] for n in (5, 3))
            alike.append([len(x & y) / len(x | y) for x, y in (five, three)])
            docs += [(len(docs), " ".join(t)), (len(docs) + 1, " ".join(u))]
    spam = "x " * 3000  # outweighs the rest, so that the fingerprints are equal: the check tells them apart
    other = [(100 + k, spam + " ".join(f"v{i}" for i in rng.integers(0, 5000, 200))) for k in range(3)]
    assert len({fingerprint(t) for _, t in other}) == 1
    kept = {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(spark.createDataFrame(docs + other, "doc_id long, text string")).collect()}
    assert all(five < 0.8 <= three for five, three in alike)
    assert kept == {2 * k for k in range(6)} | {100, 101, 102}


def test_bucket_members_that_fail_with_the_head_are_compared(spark):
    rng = np.random.default_rng(10)
    shared = [f"s{k}" for k in range(300)]  # all share this; two by two they share more
    docs = []
    for g in range(30):
        own = [f"o{k}" for k in rng.integers(0, 10**6, 120)]
        docs += [(2 * g, " ".join(shared + own)), (2 * g + 1, " ".join(shared + own[:-1] + ["end"]))]
    kept = {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {2 * g for g in range(30)}


# line dedup


def chunks(text):
    word = lambda s: len([w for w in s.replace("\x0b", " ").replace("\x0c", " ").split() if w])
    lines = text.split("\n")
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in lines]
    r = [2**63 - 1] + [signed(xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42))) for a, b in zip(h, h[1:])] + [2**63 - 1]
    cut = lambda i: r[i] < r[i - 1] and r[i] < r[i + 1]
    long = [word(x) >= line_dedup.LONG_LINE for x in lines]
    out, begin = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (i > 0 and cut(i)) or long[i] or long[i + 1]:
            out.append((lines[begin : i + 1], i + 1 - begin > 1 or long[i]))
            begin = i + 1
    return out


def dedup(docs):
    place = {}
    key = lambda i, t: (i is not None, i or 0, (xxhash.xxh64_intdigest(t.encode(), seed=42) + 2**63) % 2**64)
    for i, t in docs:
        for n, (c, ok) in enumerate(chunks(t) if t is not None else []):
            if ok:
                place.setdefault("\n".join(c), set()).add((*key(i, t), n))
    out = []
    for i, t in docs:
        if t is None:
            out.append((i, None, 0, 0, 0))
            continue
        c = chunks(t)
        stay = [x for n, (x, ok) in enumerate(c) if not ok or min(place["\n".join(x)]) == (*key(i, t), n)]
        gone = len(c) - len(stay)
        out.append((i, "\n".join("\n".join(x) for x in stay) if gone else t, t.count("\n") + 1, t.count("\n") + 1 - sum(map(len, stay)), gone))
    return out


def test_line_dedup_equals_brute_force(spark, sf):
    rng = np.random.default_rng(5)
    passages = ["\n".join(f"line {rng.integers(9)} of {k}" for _ in range(6)) for k in range(4)] + [" ".join(f"w{j}" for j in range(60)), "\n\n\n"]
    docs = [(k, "\n".join(passages[j] for j in rng.integers(0, len(passages), 5)) + f"\nown {k}") for k in range(30)] + [(None, passages[0]), (77, None), (78, ""), (79, passages[1]), (79, passages[1]), (80, passages[1])]
    docs += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 5 = 0").collect()]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(dedup(docs), key=repr)
    assert sum(r["n_removed_chunks"] for r in got) > 20


def test_line_dedup_finds_shifted_passages(spark):
    rng = np.random.default_rng(6)
    passage = "\n".join(" ".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40))
    docs = [(1, passage), (2, "put in\nbefore\n" + passage), (3, "one more\n" + passage + "\nafter")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["n_removed_lines"] == 0 and min(got[2]["n_removed_lines"], got[3]["n_removed_lines"]) >= 30


def test_line_dedup_finds_every_passage_of_50_words(spark):
    rng = np.random.default_rng(7)
    line = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))
    docs, want = [], []
    for g, sizes in enumerate([(40,) * 5, (25, 25), (10, 30, 10), (45, 5, 3), (3, 0, 49, 1), (12,) * 6, (6,) * 10, (30, 20), (1,) * 50, (24, 25), (6,) * 8]):
        passage = [line(n) for n in sizes]
        for k in range(3):
            before, after = [line(9) for _ in range(k + 1)], [line(9) for _ in range(2)]
            docs.append((3 * g + k, "\n".join(before + passage + after)))
            goes = k > 0 and sum(sizes) >= 50
            want.append((3 * g + k, "\n".join(before + after if goes else before + passage + after), len(sizes) * goes, int(goes)))
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), passage_words=line_dedup.PASSAGE_WORDS)
    assert sorted((r["doc_id"], r["text"], r["n_removed_lines"], r["n_removed_chunks"]) for r in got.collect() if r["doc_id"] < 27) == want[:27]
    short = {r["doc_id"]: r["text"] for r in got.collect()}
    assert all(len(short[i]) > 0 for i in range(27, 33))


def test_line_dedup_loses_no_line(spark):
    rng = np.random.default_rng(11)
    pool = [" ".join(f"w{rng.integers(99)}" for _ in range(rng.integers(0, 30))) for _ in range(12)]
    docs = [(k, "\n".join(pool[j] for j in rng.integers(0, 12, 25))) for k in range(20)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), passage_words=20).collect()
    assert sum(r["n_removed_lines"] for r in got) > 50 and all(r["n_lines"] - r["n_removed_lines"] == len(r["text"].split("\n")) for r in got if r["text"])
    assert {x for _, t in docs for x in t.split("\n")} == {x for r in got for x in r["text"].split("\n")}


def test_links_of_a_bucket_join_the_groups_that_pairs_join():
    rng = np.random.default_rng(13)
    sets = [np.unique(rng.choice(60, rng.integers(20, 40))).astype(np.int64) for _ in range(40)]
    roots = [k // 2 for k in range(40)]
    found = simhash_dedup._links(np.array([len(x) for x in sets]), np.concatenate(sets), roots, 0.35)
    close = lambda a, b: len(set(a) & set(b)) >= 0.35 * len(set(a) | set(b))
    every = [(i, j) for i in range(40) for j in range(i) if close(sets[i], sets[j])]
    given = [(2 * r, 2 * r + 1) for r in range(20)]
    assert all(close(sets[i], sets[j]) for i, j in found) and len(found) < 20 < len(every)
    parts = lambda links: {frozenset(n for n in range(40) if classes(range(40), links)[n] == r) for r in classes(range(40), links).values()}
    assert parts(found + given) == parts(every + given)


def test_line_dedup_of_odd_rows(spark):
    got = line_dedup.dedup_lines(odd(spark).withColumn("n_lines", F.lit("clash")))
    assert got.count() == len(ODD) and dict(got.dtypes)["n_lines"] == "bigint" and "score" in got.columns
    assert line_dedup.dedup_lines(odd(spark).limit(0)).count() == 0


# language-model scores


def test_filter_never_loses_a_count():
    rng = np.random.default_rng(2)
    keys, counts, blocks = np.unique(rng.integers(0, 2**64, 5000, np.uint64)), rng.integers(1, 3000, 5000), 8
    block, rest = lm_scoring.LogFrequencyFilter.block_of(keys, blocks), keys & lm_scoring._REST
    built = [lm_scoring.LogFrequencyFilter.build_block(rest[block == b], counts[block == b]) for b in range(blocks)]
    f = lm_scoring.LogFrequencyFilter(np.concatenate(built), [len(x) for x in built], blocks)
    got, true = f.levels(keys), 1 + np.floor(np.log2(counts))
    assert (got >= true).all() and (got == true).mean() > 0.95
    assert (f.levels(rng.integers(0, 2**64, 5000, np.uint64)) > 0).mean() < 0.03 and f.levels(np.zeros(0, np.uint64)).shape == (0,)
    half = [lm_scoring.LogFrequencyFilter(np.concatenate(built[a : a + 4]), [len(x) for x in built[a : a + 4]], blocks, a) for a in (0, 4)]
    assert (np.maximum(half[0].levels(keys), half[1].levels(keys)) == got).all()


class Ran:
    """In a table's place: keeps the function that would run on its batches."""

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self

    def select(self, *columns):
        return self

    groupBy = agg = repartition = sortWithinPartitions = unionByName = select  # noqa: N815

    def of(self, batches):
        """What it gives, in mappings from columns to lists, and the most MB that it held meanwhile, as rows are passed on."""
        tracemalloc.start()
        out = []
        for x in self.run(iter(batches)):
            out.append(x)
        most = tracemalloc.get_traced_memory()[1] / (1 << 20)
        tracemalloc.stop()
        return pa.Table.from_batches(out).to_pydict(), most


def test_workers_of_the_model_hold_little(monkeypatch):
    rng, blocks = np.random.default_rng(3), 64
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 150_000)) for _ in range(8)]  # 1.2 million words, so 2.4 million n-grams
    monkeypatch.setattr(lm_scoring, "STEP", 1 << 16)
    got, most = lm_scoring.count_ngrams(Ran(), blocks).of([pa.RecordBatch.from_arrays([pa.array([t.encode()])], ["t"]) for t in texts])
    assert most < 90, most  # 257 when a whole table was sorted and written out at once
    c: Counter = Counter()
    for t in texts:
        h = np.array([lm_scoring._hash(w) for w in lm_scoring.words_of(t.encode())], np.uint64)
        u, v = lm_scoring.before(h)
        c.update(np.concatenate([lm_scoring.pairs(u, h), lm_scoring.triples(v, u, h)]).tolist())
    true = Counter()
    for b, k, n in zip(got["block"], got["keys"], got["counts"]):
        for key, x in zip(np.cumsum(from_varints(k), dtype=np.uint64).tolist(), from_varints(n).tolist()):
            true[b << 40 | key] += x
    keys, counts = np.array(list(c), np.uint64), np.array(list(c.values()))
    assert true == Counter(dict(zip(lm_scoring._placed(keys, blocks).tolist(), counts.tolist())))
    tracemalloc.start()
    bits = lm_scoring.LogFrequencyFilter.build_block(keys & lm_scoring._REST, counts)
    most = tracemalloc.get_traced_memory()[1] / (1 << 20)
    tracemalloc.stop()
    assert most < 60, most
    f = lm_scoring.LogFrequencyFilter(bits, [len(bits)], 1)
    assert (f.levels(keys) >= 1 + np.floor(np.log2(counts))).all()


def test_letters_of_all_words_are_counted(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEP", 1 << 10)
    words = [f"{'ab,é9'[k % 5]}w{k}".encode() for k in range(3000)]
    got, most = lm_scoring._letters(Ran()).of([pa.RecordBatch.from_arrays([pa.array(words[a : a + 500])], ["word"]) for a in range(0, 3000, 500)])
    assert most < 20, most  # a table of all codes alone takes 42
    want: Counter = Counter()
    for w in words:
        x = [0] * lm_scoring.ORDER + [int(lm_scoring._LETTER[b]) for b in w] + [0]
        for i in range(lm_scoring.ORDER, len(x)):
            for k in range(1, lm_scoring.ORDER + 1):
                want[lm_scoring.SPELL + k, sum(x[i - j] * lm_scoring.LETTERS**j for j in range(k))] += 1
    true: Counter = Counter()
    for kind, code, n in zip(got["kind"], got["code"], got["n"]):
        true[kind, code] += n
    assert true == want


def test_freed_memory_goes_back_before_scoring():
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096 >> 20
    held = [bytearray(b"x") * (1 << 16) for _ in range(1024)]
    full, last = resident(), held.pop()  # what was taken last keeps the heap from shrinking by itself
    del held
    lm_scoring.released()
    assert resident() < full - 40 and len(last) == 1 << 16


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    docs = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 60)) % 500)) for k in range(150)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = {i: lm_scoring.words_of(t.encode()) for i, t in docs}
    c1, c2, c3 = Counter(), Counter(), Counter()
    behind = lambda w: [(b" ", b" ", *w)[k : k + 3] for k in range(len(w))]
    for i, w in words.items():
        if not held(i):
            c1.update(w), c2.update(x[1:] for x in behind(w)), c3.update(behind(w))
    n, once = sum(c1.values()), sum(x == 1 for x in c1.values())
    level = lambda c: lm_scoring.COUNT_OF[int(math.log2(c)) + 1] if c else 0.0
    want = {}
    for i, w in words.items():
        want[i] = 0.0
        for t, u, x in behind(w):
            if not c1[x]:  # spelled: left out here
                want[i] = None
                break
            p = c1[x] / (n + once)
            two = level(c2[u, x]) if c1[u] else 0.0
            p = (two + lm_scoring.TWO * p) / (max(c1[u], two) + lm_scoring.TWO)
            context = c1[b" "] if u == b" " else level(c2[t, u])
            three = min(level(c3[t, u, x]), two) if two and context else 0.0
            want[i] += math.log10((three + lm_scoring.THREE * p) / (max(context, three) + lm_scoring.THREE))
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), broadcast_bytes=1 << 10).collect()}
    known = [i for i in got if want[i] is not None]
    assert len(known) > 100 and sum(abs(got[i] - want[i]) < 0.02 * abs(want[i]) + 1e-6 for i in known) > 0.9 * len(known)


@pytest.mark.parametrize("listed", [1 << 18, 40])
def test_scores(spark, sf, monkeypatch, listed):
    monkeypatch.setattr(lm_scoring, "SHORTLIST", listed)  # the model is the same, but for the rounding of rarer words' counts
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = {k: lm_scoring.words_of(t.encode()) for k, (_, t) in enumerate(rows)}
    c = Counter(w for k, (i, _) in enumerate(rows) if not held(i) for w in words[k])
    n, v = sum(c.values()), len(c)
    expect = sorted((i is None, i or 0, held(i), len(words[k]), sum(w in c for w in words[k]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[k]), 4)) for k, (i, _) in enumerate(rows))
    got = lm_scoring.score_documents(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expect
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    if listed > 1000:
        assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"]) * 0.95


def test_scores_of_no_rows(spark):
    assert lm_scoring.score_documents(odd(spark).limit(0)).count() == 0
    only = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [(r["n_tokens"], r["train_tokens"]) for r in lm_scoring.score_documents(only).collect()] == [(1, 1)]


# near-duplicates


def fingerprint(text, shingle=3):
    w = (text or "").encode().lower().split()
    g = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) > shingle else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    root = {n: n for n in nodes}
    for a, b in linked:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for n in sorted(nodes):
        root[n] = root[root[n]]
    return root


def test_simhash_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(10**6 + i, t) for i, t, *_ in ODD if i is not None] + [(2 * 10**6 + k, "a b c d") for k in range(50)]
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup.simhash_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    fp = [(i, fingerprint(t)) for i, t in docs]
    distinct = sorted({f for _, f in fp})
    near = classes(distinct, [(a, b) for a, b in itertools.combinations(distinct, 2) if bin(a ^ b).count("1") <= 2])
    first = defaultdict(lambda: 10**9)
    for i, f in fp:
        first[near[f]] = min(first[near[f]], i)
    assert got == {(i, f"{f:016x}", first[near[f]]) for i, f in fp}


def test_ball_hashing_finds_all_links(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 60)]
    words = base + [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (2, 2))] + [b ^ 7 for b in base] + [-1, -2, -4, 0, 1, 3, 7]
    words = sorted(set(words))
    links = simhash_dedup.within_two(spark.createDataFrame([(w,) for w in words], "w long"), 64).collect()
    mask = 2**64 - 1
    assert all(bin((r["a"] ^ r["b"]) & mask).count("1") <= 2 for r in links)
    got = classes(words, [(r["a"], r["b"]) for r in links])
    true = classes(words, [(a, b) for a, b in itertools.combinations(words, 2) if bin((a ^ b) & mask).count("1") <= 2])
    groups = lambda c: {frozenset(w for w in words if c[w] == r) for r in set(c.values())}
    assert groups(got) == groups(true)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100)] + [(500, k) for k in range(501, 560)] + [(700, 700)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got.get(k, k) for k in range(101)} == {0} and {got.get(k, k) for k in range(500, 560)} == {500} and 700 not in got
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_equal_those_of_rounds(spark, monkeypatch):
    rng = np.random.default_rng(15)
    links = [(int(a), int(b)) for a, b in rng.integers(-400, 400, (500, 2))] + [(1000 + k, 1001 + k) for k in range(200)] + [(-(2**63), 2**63 - 1), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    few = {tuple(r) for r in components.connected_components(df).collect()}
    monkeypatch.setattr(components, "FEW_LINKS", 0)
    assert few == {tuple(r) for r in components.connected_components(df).collect()}


def test_near_duplicates_leave_one_of_each_group(spark):
    rng = np.random.default_rng(8)
    pool = [f"w{k}" for k in range(3000)]
    text = lambda: list(rng.choice(pool, 300))
    docs, groups = [], []
    for g in range(20):
        t = text()
        groups.append([])
        for _ in range(4):
            u = list(t)
            u[int(rng.integers(300))] = "changed"
            groups[-1].append(len(docs))
            docs.append((len(docs), " ".join(u), 0.0, 1, "x"))
    single = [(1000 + k, " ".join(text()), 0.0, 1, "x") for k in range(40)]
    df = spark.createDataFrame(docs + single + single[:1] + ODD, DOC)
    kept = simhash_dedup.drop_near_duplicates(df)
    ids = Counter(r["doc_id"] for r in kept.collect())
    left = [sum(ids[i] for i in g) for g in groups]  # a fingerprint misses a link now and then, but drops no group
    assert min(left) == 1 and left.count(1) >= 18 and all(ids[d[0]] == 1 for d in single)
    assert kept.columns == df.columns and simhash_dedup.drop_near_duplicates(df.limit(0)).count() == 0
