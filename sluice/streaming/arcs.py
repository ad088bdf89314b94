"""Networks kept up to date from a stream of arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.network import canonical_arcs


def merged_arcs(arcs: DataFrame) -> DataFrame:
    """Canonical arcs of all that a stream of directed (src, dst, cap) has brought; for output mode update or complete."""
    return canonical_arcs(arcs)


def windowed_arcs(arcs: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Canonical arcs of each window of event time; arcs later than late are dropped with their window's state."""
    w = arcs.withWatermark(time, late).filter("src <> dst")
    fore = F.col("src") < F.col("dst")
    return (
        w.groupBy(F.window(time, length).alias("window"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.sum(F.when(fore, F.col("cap")).otherwise(0)).cast("long").alias("cap"), F.sum(F.when(fore, 0).otherwise(F.col("cap"))).cast("long").alias("rcap"))
    )
