"""A network cut into partitions that share nodes, and the constraints that hold the copies together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.operators.network import FlowNetwork, cut_lineage
from sluice.operators.partition import arc_parts

#: Node ids that one window of a numbering holds.
STRIDE = 1 << 16


def numbered(df: DataFrame, block: str, order: list[str], name: str) -> DataFrame:
    """df with a gapless number from 0 in the order (block, order): inside blocks, shifted by the blocks before."""
    counts = df.groupBy(block).agg(F.count("*").alias("_n"))
    before = counts.select(block, (F.sum("_n").over(W.orderBy(block).rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(block).orderBy(*order)) - 1
    return df.withColumn("_in", inside).join(before, block).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_in", "_before")


def homes(arcs: DataFrame, part: DataFrame) -> DataFrame:
    """Canonical arcs with their partition p, that of the smaller end, and whether they cross."""
    return arc_parts(arcs, part).select("src", "dst", "cap", "rcap", F.col("p_src").alias("p"), F.col("p_dst").alias("q"), (F.col("p_src") != F.col("p_dst")).alias("crosses"))


def members(arcs: DataFrame, part: DataFrame, home: DataFrame | None = None) -> DataFrame:
    """(p, node) of all copies: each node in its own part, the larger end of a crossing arc also in the arc's."""
    home = homes(arcs, part) if home is None else home
    away = home.filter("crosses").select("p", F.col("dst").alias("node")).distinct()
    return part.select(F.col("part").alias("p"), "node").unionByName(away).distinct()


def node_map(copies: DataFrame) -> DataFrame:
    """(p, node, local_index), numbered within a partition by blocks of ids, so that no task holds a partition."""
    block = F.expr(f"node div {STRIDE}")
    counts = copies.groupBy("p", block.alias("_b")).agg(F.count("*").alias("_n"))
    before = counts.select("p", "_b", (F.sum("_n").over(W.partitionBy("p").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("p", "_b").orderBy("node")) - 1
    return copies.withColumn("_b", block).withColumn("_in", inside).join(before, ["p", "_b"]).select(*copies.columns, (F.col("_before") + F.col("_in")).cast("int").alias("local_index"))


def constraints(copies: DataFrame) -> DataFrame:
    """(constraint_id, node, p, q) for every two partitions p < q that share a node, numbered by (node, p, q)."""
    holders = copies.groupBy("node").agg(F.sort_array(F.collect_set("p")).alias("ps")).filter(F.size("ps") > 1)
    pairs = holders.select("node", F.explode("ps").alias("p"), "ps").select("node", "p", F.explode(F.filter("ps", lambda q: q > F.col("p"))).alias("q"))
    return numbered(pairs.withColumn("_b", F.expr(f"node div {STRIDE}")), "_b", ["node", "p", "q"], "constraint_id").select("constraint_id", "node", "p", "q")


def endpoints(cons: DataFrame) -> DataFrame:
    """(constraint_id, node, p, is_source): both ends of each constraint; the smaller partition is its source."""
    both = F.array(F.struct("p", F.lit(True).alias("is_source")), F.struct(F.col("q").alias("p"), F.lit(False).alias("is_source")))
    return cons.select("constraint_id", "node", F.inline(both))


@dataclass(frozen=True)
class Pieces:
    """What the packages hold, a row for each thing: no row or task grows with a partition.

    nodes(p, node, local_index, tcap), arcs(p, src, dst, a, b, cap, rcap), a and b being local, and
    ends(p, constraint_id, node, local_index, is_source). What has no copy where it should have one has a null index.
    """

    nodes: DataFrame
    arcs: DataFrame
    ends: DataFrame


def pieces(net: FlowNetwork, part: DataFrame, cons: DataFrame | None = None, copies: DataFrame | None = None) -> Pieces:
    """A terminal is in its node's own part alone. Every copy is there, also of a node without arcs."""
    home = cut_lineage(homes(net.arcs, part))
    copies = cut_lineage(members(net.arcs, part, home)) if copies is None else copies
    cons = cut_lineage(constraints(copies)) if cons is None else cons
    local = cut_lineage(node_map(copies))
    own = part.select(F.col("part").alias("p"), "node").join(net.terminals.select("node", "tcap"), "node")
    nodes = local.join(own, ["p", "node"], "left").select("p", "node", "local_index", F.coalesce("tcap", F.lit(0)).cast("long").alias("tcap"))
    at = lambda c, i: local.select("p", F.col("node").alias(c), F.col("local_index").alias(i))
    arcs = home.join(at("src", "a"), ["p", "src"], "left").join(at("dst", "b"), ["p", "dst"], "left").select("p", "src", "dst", "a", "b", "cap", "rcap")
    ends = endpoints(cons).join(local, ["p", "node"], "left").select("p", "constraint_id", "node", "local_index", "is_source")
    return Pieces(nodes, arcs, ends)


def summary(got: Pieces) -> DataFrame:
    """(p, nodes, arcs, endpoints, capacity, terminals) of each package, from partial sums."""
    nodes = got.nodes.groupBy("p").agg(F.count("*").alias("nodes"), F.sum("tcap").cast("long").alias("terminals"))
    arcs = got.arcs.groupBy("p").agg(F.count("*").alias("arcs"), F.sum(F.col("cap") + F.col("rcap")).cast("long").alias("capacity"))
    ends = got.ends.groupBy("p").agg(F.count("*").alias("endpoints"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.join(arcs, "p", "left").join(ends, "p", "left").select("p", "nodes", none("arcs"), none("endpoints"), none("capacity"), "terminals")


def packages(net: FlowNetwork, part: DataFrame, cons: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """One row for each partition with all that its solver needs, for workers: a partition must fit in a row.

    partition_id, local_to_global, arcs, arc_capacities, terminal_capacities and constraint_endpoints.
    """
    got = pieces(net, part, cons, copies)
    # Numbers of partitions that stand between, so that one sort gives arcs and capacities the same order.
    arcs = got.arcs.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("a", "b", "cap", "rcap"))).alias("a"))
    arcs = arcs.select("p", F.flatten(F.transform("a", lambda x: F.array(x.a, x.b))).alias("arcs"), F.flatten(F.transform("a", lambda x: F.array(x.cap, x.rcap))).alias("arc_capacities"))
    nodes = got.nodes.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("local_index", "node", F.col("tcap").alias("t")))).alias("n"))
    nodes = nodes.select("p", F.transform("n", lambda x: x.node).alias("local_to_global"), F.transform("n", lambda x: x.t).alias("terminal_capacities"))
    ends = got.ends.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("constraint_id", F.col("node").alias("global_node_id"), "local_index", "is_source"))).alias("constraint_endpoints"))
    out = nodes.join(arcs, "p", "left").join(ends, "p", "left")
    none = lambda c: F.coalesce(c, F.array().cast(dict(out.dtypes)[c]))
    return out.select(F.col("p").alias("partition_id"), F.size("local_to_global").alias("local_node_count"), none("arcs").alias("arcs"), none("arc_capacities").alias("arc_capacities"), "terminal_capacities", "local_to_global", none("constraint_endpoints").alias("constraint_endpoints"))


def piece_violations(got: Pieces) -> DataFrame:
    """(partition_id, reason) as package_violations gives them, found on the pieces: each rule once for a partition that breaks it.

    Ends and capacities are columns of an arc here, so a missing one is a null.
    """
    count = got.nodes.groupBy("p").agg(F.count("*").alias("n"), F.count("tcap").alias("t"), F.count_distinct("local_index").alias("i"), F.min("local_index").alias("lo"), F.max("local_index").alias("hi"))
    few = F.broadcast(count.select("p", "n"))  # a row for each partition
    outside = lambda c: F.col(c).isNull() | (F.col(c) < 0) | F.col("n").isNull() | (F.col(c) >= F.col("n"))

    def broken(df: DataFrame, rules: dict) -> DataFrame:
        told = df.groupBy("p").agg(*[F.max(F.coalesce(cond, F.lit(False))).alias(f"r{k}") for k, cond in enumerate(rules.values())])
        found = F.filter(F.array(*[F.when(F.col(f"r{k}"), F.lit(name)) for k, name in enumerate(rules)]), lambda r: r.isNotNull())
        return told.select(F.col("p").alias("partition_id"), F.explode(found).alias("reason"))

    nodes = broken(count, {"negative partition id": F.col("p") < 0, "terminals don't match nodes": F.col("t") != F.col("n"), "node map is neither empty nor full": (F.col("i") != F.col("n")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)})
    arcs = broken(got.arcs.join(few, "p", "left"), {"capacities don't match arcs": F.col("cap").isNull() | F.col("rcap").isNull(), "arc end out of range": outside("a") | outside("b")})
    ends = broken(got.ends.join(few, "p", "left"), {"negative constraint id": F.col("constraint_id") < 0, "constraint end out of range": outside("local_index")})
    return nodes.unionByName(arcs).unionByName(ends)


def package_violations(pack: DataFrame) -> DataFrame:
    """(partition_id, reason) for each rule that a package breaks; no rows for sound ones."""
    rules = {
        "negative partition id": F.col("partition_id") < 0,
        "negative node count": F.col("local_node_count") < 0,
        "odd number of arc ends": F.size("arcs") % 2 != 0,
        "capacities don't match arcs": F.size("arcs") != F.size("arc_capacities"),
        "terminals don't match nodes": F.size("terminal_capacities") != F.col("local_node_count"),
        "node map is neither empty nor full": (F.size("local_to_global") != 0) & (F.size("local_to_global") != F.col("local_node_count")),
        "arc end out of range": F.exists("arcs", lambda v: (v < 0) | (v >= F.col("local_node_count"))),
        "negative constraint id": F.exists("constraint_endpoints", lambda e: e.constraint_id < 0),
        "constraint end out of range": F.exists("constraint_endpoints", lambda e: (e.local_index < 0) | (e.local_index >= F.col("local_node_count"))),
    }
    found = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda r: r.isNotNull())
    return pack.select("partition_id", F.explode(found).alias("reason"))


def partition_violations(part: DataFrame, n: int, parts: int) -> DataFrame:
    """(node, reason): nodes with more or fewer than one label, or one out of range."""
    every = part.sparkSession.range(n).select(F.col("id").alias("node"))
    got = part.groupBy("node").agg(F.count("*").alias("c"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    bad = every.join(got, "node", "full")
    reason = F.when(F.col("c").isNull(), "no label").when((F.col("node") < 0) | (F.col("node") >= n), "unknown node").when(F.col("c") > 1, "several labels").when((F.col("lo") < 0) | (F.col("hi") >= parts), "label out of range")
    return bad.select("node", reason.alias("reason")).filter("reason IS NOT NULL")
