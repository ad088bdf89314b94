"""Proportional stratified interleaving: every shard has the mixture of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import checkpointed, read, unsigned_crc32

SHARDS, SEED = 16, 17
#: Rows that one window of a ranking should hold.
ROWS_PER_BUCKET = 20_000


def _power(n: int, least: int) -> int:
    return max(least, 1 << max(0, (n // ROWS_PER_BUCKET)).bit_length())


def _ranked(df: DataFrame, group: list[str], bucket: str, order: list[Column], rank: str, total: str | None = None) -> DataFrame:
    """df with the place of each row in its group (from 0), ordered by bucket and then by order.

    Only a bucket's rows meet in one task; what stands before it is a running sum over the counts of
    the group's buckets, which are few.
    """
    counts = df.groupBy(*group, bucket).agg(F.count("*").alias("_c"))
    upto = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    counts = counts.select(*group, bucket, (F.sum("_c").over(upto.orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_before"), F.sum("_c").over(upto).alias("_total"))
    inside = F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order)) - 1
    out = df.withColumn("_in", inside).join(counts, [*group, bucket]).withColumn(rank, (F.col("_before") + F.col("_in")).cast("long"))
    return (out.withColumn(total, F.col("_total")) if total else out).drop("_in", "_before", "_total")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs; law `rows` holds.

    Rows of a source stand in a seeded random order; row r of n has the fractional rank (r + 1/2) / n,
    and all rows sorted by it are cut into shards whose counts differ by one at most. Null sources are
    one source, a null text has no bytes (size 1, crc32 0). Equal rows are interchangeable, so their
    ties leave the result the same. Both rankings go by buckets whose number grows with the rows, so
    no source meets in one task. Texts are not shuffled: size and checksum are taken first.
    """
    t = F.col(text)
    d = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(unsigned_crc32(t), F.lit(0)).cast("long").alias("text_crc32"))
    d = d.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "_source", "size", "text_crc32"))
    d = checkpointed(d)
    n = d.count()
    buckets = _power(n, 256)
    d = d.withColumn("_b", F.shiftrightunsigned("_h", 64 - (buckets.bit_length() - 1)).cast("int"))
    tie = [F.expr("shiftrightunsigned(_h, 1)"), F.col("_h"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    d = _ranked(d, ["_source"], "_b", tie, "_r", "_n")
    # Exact comparison of (2r + 1) / 2n: bucket by the quotient, then by the remainder over n.
    strata = _power(n, 1024)
    part = F.col("_r") * strata * 2 + strata
    d = d.withColumn("_g", F.expr(f"(_r * {2 * strata} + {strata}) div (2 * _n)").cast("int")).withColumn("_f", (part % (F.col("_n") * 2)).cast("double") / (F.col("_n") * 2))
    d = _ranked(d, [], "_g", [F.col("_f"), F.col("_source"), *tie], "_place")
    big, small = -(-n // shards), n // shards
    extra = n - small * shards
    at = F.col("_place")
    shard = F.when(at < extra * big, F.expr(f"_place div {max(big, 1)}")).otherwise(extra + F.expr(f"(_place - {extra * big}) div {max(small, 1)}"))
    slot = F.when(at < extra * big, at % max(big, 1)).otherwise((at - extra * big) % max(small, 1))
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_source").alias("source"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(read(spark, sf_dir, "documents"))
