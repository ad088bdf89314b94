"""Documents through five operators, in order: toxicity, line dedup, near-duplicates, decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.benchmark_decontamination import drop_contaminated
from sluice.llm.common import SPACE, forget, read, shared_folder, swept
from sluice.llm.line_dedup import PASSAGE_WORDS, dedup_lines
from sluice.llm.packing import pack
from sluice.llm.simhash_dedup import drop_near_duplicates
from sluice.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are predicted toxic."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated chunks and passages; a document that had words and has none left was a copy throughout and goes."""
    done = dedup_lines(docs, passage_words=PASSAGE_WORDS)
    done = done.filter((F.col("n_removed_lines") == 0) | F.col("text").rlike(f"[^{SPACE}]"))
    return done.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: SimHash's groups, verified, and those by bands of minima that it can't find."""
    swept(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of the benchmark occurs."""
    swept(spark)
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces of the documents that are left."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: A Viterbi decoder, 64-bit majority fingerprints and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again."""
    folder = shared_folder(spark)
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = f"{folder}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:  # the last stage's table stays, as the result is read from it
            forget(spark, before)
        before = at
    return docs
