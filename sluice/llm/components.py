"""Connected components by alternating large and small stars; links never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import checkpointed

#: So many links, of 16 bytes, are joined by one task in a single pass; more in rounds over all executors.
FEW_LINKS = 1 << 20


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links and the least node that each can reach: roots hang on the least root they link to, then all nodes on their root."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return nodes, nodes[root]


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node that can be reached; nodes that only link to themselves are left out.

    Each round hangs every node's larger neighbours on the least neighbour (large star), then its smaller
    ones (small star); rounds grow with the logarithm of the nodes, also along chains. The least
    neighbour is a pre-aggregated minimum, joined back on the node. A few links take no rounds, as each
    costs six shuffles however little there is to shuffle.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e, before = checkpointed(e), None
    if {kind for _, kind in e.dtypes} == {"bigint"} and e.count() <= FEW_LINKS:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if held:
                nodes, roots = _joined(*(np.concatenate(c) for c in zip(*held)))
                hung = nodes != roots
                yield pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(roots[hung])], ["node", "root"])

        return checkpointed(e.coalesce(1).mapInArrow(run, "node bigint, root bigint"))
    for _ in range(max_rounds):
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # (v, m) for the others, (u, m) for the node itself: both from one row
        hung = large.join(low, "u").select(F.inline(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))))
        e = checkpointed(hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
