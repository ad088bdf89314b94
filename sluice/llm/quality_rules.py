"""Cross-document line frequency: lines that too many documents of a host share are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import SPACE, computed, read, words

#: A line is boilerplate if more than this many documents of its host have it, and more than this share.
LINE_DOCS, LINE_SHARE = 100, 0.02
#: A document is depleted if less than this share of its words remains.
LEAST_LEFT = 0.3


def normalised_line(line: Column) -> Column:
    """Lower-case, digits as 0, white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), f"[{SPACE}]+", " "))


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) of the whole text.

    Null counts as a text without words. A word is in n_repeat_words if one of the 5-word windows
    that hold it occurs twice or more in the text (equal 64-bit hashes of equal word hashes).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = computed(docs, _w=words(t), _lines=F.filter(F.split(t, "\n"), lambda s: s.rlike(f"[^{SPACE}]")))
    df = computed(
        df,
        _wh=F.transform("_w", lambda w: F.xxhash64(w)),
        n_words=F.size("_w").cast("long"),
        word_chars=F.length(F.array_join("_w", "")).cast("long"),
        n_symbols=F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    ).drop("_w", "_lines")
    windows = F.when(F.col("n_words") < 5, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), (F.col("n_words") - 5).cast("int")), lambda i: F.xxhash64(*[F.get("_wh", i + k) for k in range(5)]))
    )
    df = computed(df, _v=windows).drop("_wh")
    # Only texts with an equal pair of windows are sorted.
    again = F.size(F.array_distinct("_v")) < F.size("_v")
    df = computed(df, _s=F.when(again, F.array_sort(F.transform("_v", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_v")
    pairs = F.zip_with(
        F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))), F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))),
        lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")),
    )
    starts = F.when(F.col("_s").isNotNull(), F.array_sort(F.array_distinct(F.flatten(pairs))))
    df = computed(df, _p=starts).drop("_s")
    covered = F.aggregate(
        "_p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc.n + F.lit(5) - F.greatest(acc.end - p, F.lit(0))).alias("n"), (p + 5).alias("end")),
        lambda acc: acc.n,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")


def apply_quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                        line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """One row for each row of docs: its id, the base statistics, base_failed, n_removed_words, kept.

    Each document's distinct normalised lines count once for its host; the counts are pre-aggregated
    before they are shuffled, so a host with a third of all rows is no hot key. A line in more than
    line_docs and more than line_share of its host's documents is removed, and a document with less
    than least_left of its words left is rejected. Null hosts are one host. A null or empty text has
    no words and fails the base rules. Repeated rows (same id, host and text) count for a line as often as they
    occur, and each gets a row. Columns of docs with other names are not returned, so names cannot clash.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col(text).alias("_text"))
    d = d.withColumn("_key", F.xxhash64("doc_id", "_host", "_text"))
    lines = F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda s: s.rlike(f"[^{SPACE}]"))
    each = F.transform(lines, lambda s: F.struct(F.xxhash64(normalised_line(s)).alias("h"), F.size(F.split(F.trim(F.regexp_replace(s, f"[{SPACE}]+", " ")), " ")).alias("n")))
    exploded = d.select("_key", "_host", F.explode(each).alias("l")).select("_key", "_host", "l.h", "l.n")
    # Words by line within a document first: a line counts a document once.
    per_doc = d.select("_key", "_host", F.explode(F.array_distinct(F.transform(each, lambda x: x.h))).alias("h"))
    hosts = d.groupBy("_host").agg(F.count("*").alias("_docs"))
    frequent = (
        per_doc.groupBy("_host", "h").agg(F.count("*").alias("_n")).filter(F.col("_n") > line_docs)
        .join(hosts, "_host").filter(F.col("_n") > F.col("_docs") * F.lit(line_share)).select("_host", "h")
    )
    removed = exploded.join(frequent, ["_host", "h"]).groupBy("_key").agg(F.sum("n").alias("_sum"), F.count("*").alias("_rows"))
    # Equal rows share a key, so their sums are in one: the number of equal rows divides it.
    equal = d.groupBy("_key").agg(F.count("*").alias("_equal"))
    removed = removed.join(equal, "_key").select("_key", (F.expr("_sum div _equal")).alias("n_removed_words"))
    base = base_statistics(d.select("doc_id", "_key", "_text"), "_text").drop("_text")
    out = base.join(removed, "_key", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words") >= F.col("n_words") * F.lit(least_left)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left).drop("_key")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(read(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT k, i, len(list(word) OVER x) AS n, array_to_string(list(word) OVER x, ' ') AS s FROM pos WINDOW x AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
rep AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, s) AS c FROM win WHERE n = 5) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM rep, range(5) r(j) GROUP BY k),
l AS (SELECT k, host, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY k),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
freq AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT k) AS c FROM lw GROUP BY host, norm) JOIN hosts USING (host) WHERE c > {LINE_DOCS} AND c > docs * {LINE_SHARE}::DOUBLE),
gone AS (SELECT k, sum(n)::BIGINT AS n_removed_words FROM lw JOIN freq USING (host, norm) GROUP BY k),
b AS (SELECT d.k, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (k) LEFT JOIN dup USING (k) LEFT JOIN cov USING (k) LEFT JOIN gone USING (k))
SELECT * EXCLUDE (k), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= n_words * {LEAST_LEFT}::DOUBLE AS kept FROM b
"""
