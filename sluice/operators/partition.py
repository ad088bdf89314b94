"""Partitioners of a network's nodes, and what a partition costs."""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.columns import contiguous_part, edge_weight
from sluice.operators.network import FlowNetwork, cut_lineage, spread_in_order

PASSES, LAMBDA, SLACK = 3, 0.005, 0.05
METHODS = ("contiguous", "region", "local_search", "propagation")
#: Rows of a batch that the sequential methods give back.
OUT = 1 << 16


def contiguous(net: FlowNetwork, parts: int) -> DataFrame:
    n = net.node_count()
    return net.arcs.sparkSession.range(n).select(F.col("id").alias("node"), contiguous_part("id", n, parts).alias("part"))


class Adjacency:
    """Neighbours and weights of every node, in the arcs' order, in a file: in memory are a few numbers for each node.

    Runs of a node come in one after another; simple tells of nodes without parallel arcs, whose neighbours rise.
    """

    def __init__(self, n: int, weighted: bool):
        self.weighted, self.rows, self.kind = weighted, 0, np.dtype(np.int32 if n < 2**31 else np.int64)
        self.begin, self.size, self.simple = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        self.last = None
        self.to, self.weight = tempfile.TemporaryFile(), tempfile.TemporaryFile()

    def add(self, node: np.ndarray, to: np.ndarray, weight: np.ndarray | None) -> None:
        if not len(node):
            return
        new = np.ones(len(node), bool)
        new[1:] = node[1:] != node[:-1]
        at = np.flatnonzero(new)
        head, count = node[at], np.diff(at, append=len(node))
        fresh = self.size[head] == 0
        self.begin[head[fresh]] = self.rows + at[fresh]
        same = ~new[1:] & (to[1:] <= to[:-1])
        self.simple[node[1:][same]] = False
        if self.last is not None and self.last[0] == node[0] and to[0] <= self.last[1]:
            self.simple[node[0]] = False
        self.size[head] += count
        self.last, self.rows = (int(node[-1]), int(to[-1])), self.rows + len(node)
        self.to.write(to.astype(self.kind).tobytes())
        if self.weighted:
            self.weight.write(weight.astype(np.float64).tobytes())

    def seal(self) -> Adjacency:
        self.to.flush()
        self.weight.flush()
        return self

    def of(self, node: int) -> np.ndarray:
        return np.frombuffer(os.pread(self.to.fileno(), self.kind.itemsize * int(self.size[node]), self.kind.itemsize * int(self.begin[node])), self.kind)

    def weights(self, node: int) -> np.ndarray:
        return np.frombuffer(os.pread(self.weight.fileno(), 8 * int(self.size[node]), 8 * int(self.begin[node])), np.float64)


def grow_regions(n: int, parts: int, near: Adjacency, most: int) -> np.ndarray:
    """Breadth-first regions from evenly spread seeds, one node in turn for each part that has room.

    A node that is taken, or waits in the part's queue already, is not queued: it would be passed over when its turn comes.
    """
    part = np.full(n, -1, np.int64)
    size, queue, waits = [0] * parts, [deque() for _ in range(parts)], np.zeros((parts, n), bool)
    seeds = [0] if parts == 1 else [p * (n - 1) // (parts - 1) for p in range(parts)]

    def take(node: int, p: int) -> None:
        part[node] = p
        size[p] += 1
        if near.size[node]:
            to = near.of(node)
            to = to[(part[to] < 0) & ~waits[p][to]]
            if len(to):
                if not near.simple[node]:
                    to = to[np.sort(np.unique(to, return_index=True)[1])]
                waits[p][to] = True
                queue[p].extend(to.tolist())

    for p, node in enumerate(seeds):
        if n and part[node] < 0:
            take(node, p)
    free, moved = 0, True
    while moved:
        moved = False
        for p in range(parts):
            if size[p] >= most:
                continue
            node = next((v for v in iter(lambda q=queue[p]: q.popleft() if q else None, None) if part[v] < 0), None)
            if node is None:
                while free < n and part[free] >= 0:
                    free += 1
                node = free if free < n else None
            if node is not None:
                take(node, p)
                moved = True
    for node in np.flatnonzero(part < 0).tolist():
        take(node, min(range(parts), key=size.__getitem__))
    return part


def improve(n: int, parts: int, near: Adjacency, part: np.ndarray, most: int, passes: int = PASSES) -> np.ndarray:
    """Greedy moves of single nodes that lower crossing weight plus the number of boundary nodes.

    foreign counts each node's arcs into other parts, so what a move does to the boundary is read
    off the mover's neighbours without visiting theirs; a node without one has nowhere to go. Sums are over arrays of a
    node's arcs, in their order; parallel arcs are counted as one neighbour met several times.
    """
    part = part.copy()
    size = np.bincount(part, minlength=parts)
    foreign = np.zeros(n, np.int64)
    linked = np.flatnonzero(near.size).tolist()
    for v in linked:
        foreign[v] = np.count_nonzero(part[near.of(v)] != part[v])
    for _ in range(passes):
        moves = 0
        for v in linked:
            if not foreign[v]:
                continue
            nb, here = near.of(v), int(part[v])
            at = part[nb]
            arcs_to, load = np.bincount(at, minlength=parts), np.bincount(at, near.weights(v), parts)
            if near.simple[v]:
                links, times, where, loose = nb, 1, at, foreign[nb]
            else:
                links, times = np.unique(nb, return_counts=True)
                where, loose = part[links], foreign[links]
            lost = int(np.count_nonzero((where == here) & (loose == 0)))
            gained = np.bincount(where[loose == times], minlength=parts)
            best, gain = here, 0.0
            for p in range(parts):
                if p == here or not arcs_to[p] or size[p] >= most:
                    continue
                delta = load[here] - load[p] + int(len(nb) > arcs_to[p]) - 1 + lost
                delta -= int(gained[p])
                if delta < gain:
                    best, gain = p, delta
                elif best != here and delta == gain:  # of equal moves the one to the part that is met first
                    first = [int(np.argmax(at == q)) for q in (best, p)]
                    best = best if first[0] < first[1] else p
            if best != here:
                foreign[links] += times * ((where == here).astype(np.int64) - (where == best))
                foreign[v] = len(nb) - arcs_to[best]
                part[v] = best
                size[here] -= 1
                size[best] += 1
                moves += 1
        if not moves:
            break
    return part


def _sequential(net: FlowNetwork, parts: int, method: str, passes: int, lam: float, slack: float, start: str) -> DataFrame:
    """The two methods whose result depends on the order of nodes.

    Both ends of the arcs are sorted by node over all tasks; then one task streams them into a file and goes through
    the nodes, with a few numbers for each in memory, whatever the number of arcs.
    """
    n = net.node_count()
    most = max(1, int(np.ceil(-(-n // parts) * (1 + slack))))
    weighted = method == "local_search"
    w = (edge_weight("cap", "rcap", lam).cast("double") if weighted else F.lit(0.0)).alias("w")
    arcs = net.arcs.filter("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w)
    ends = arcs.select("src", "dst", "w", F.posexplode(F.array("src", "dst")).alias("k", "node"))
    order = ["node", "src", "dst", "w"]
    ends = cut_lineage(spread_in_order(ends, "node").sortWithinPartitions(*order).select("node", F.when(F.col("k") == 0, F.col("dst")).otherwise(F.col("src")).alias("to"), "w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Adjacency(n, weighted)
        for b in batches:
            near.add(*(c.to_numpy() for c in b.columns))
        near.seal()
        part = np.arange(n) // max(1, -(-n // parts)) if start == "contiguous" else grow_regions(n, parts, near, most)
        if weighted:
            part = improve(n, parts, near, part, most, passes)
        for at in range(0, n, OUT):
            ids = np.arange(at, min(n, at + OUT))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(part[ids].astype(np.int32))], ["node", "part"])

    return ends.coalesce(1).mapInArrow(run, "node long, part int")


def propagate(net: FlowNetwork, parts: int, rounds: int = 4, slack: float = SLACK, lam: float = LAMBDA) -> DataFrame:
    """The scalable method: from equal runs, nodes move to the part that most of their arcs' weight leads to.

    Half the nodes may move in a round, so that neighbours don't swap for ever; a part takes of the
    nodes that ask the share it has room for, by a hash of the node. The table of sizes has a row
    for each part and is broadcast; all else is joins and partial sums on node.
    """
    n = net.node_count()
    most = max(1, int(np.ceil(-(-n // parts) * (1 + slack))))
    w = edge_weight("cap", "rcap", lam).alias("w")
    links = cut_lineage(net.arcs.filter("src <> dst").select("src", "dst", w).select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("to"), "w"), F.struct(F.col("dst").alias("node"), F.col("src").alias("to"), "w")))))
    state = cut_lineage(contiguous(net, parts))
    for k in range(rounds):
        pull = links.join(state.select(F.col("node").alias("to"), F.col("part").alias("want")), "to").groupBy("node", "want").agg(F.sum("w").alias("w"))
        best = pull.groupBy("node").agg(F.max_by("want", F.struct("w", -F.col("want"))).alias("want"), F.max("w").alias("most"), F.map_from_entries(F.collect_list(F.struct("want", "w"))).alias("by"))
        coin = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 20))
        ask = state.join(best, "node").filter((F.col("want") != F.col("part")) & (F.col("most") > F.coalesce(F.element_at("by", F.col("part")), F.lit(0.0))) & (coin < (1 << 19))).select("node", "want")
        ask = cut_lineage(ask)
        room = state.groupBy("part").agg((F.lit(most) - F.count("*")).alias("room")).join(ask.groupBy(F.col("want").alias("part")).agg(F.count("*").alias("n")), "part").select(F.col("part").alias("want"), (F.col("room") / F.col("n")).alias("share"))
        dice = F.pmod(F.xxhash64("node", F.lit(~k)), F.lit(1 << 20)) / (1 << 20)
        moved = ask.join(F.broadcast(room), "want").filter(dice < F.col("share")).select("node", "want")
        state = cut_lineage(state.join(moved, "node", "left").select("node", F.coalesce("want", "part").alias("part")))
    return state


def partition(net: FlowNetwork, parts: int, method: str | None = None, passes: int = PASSES, lam: float = LAMBDA, slack: float = SLACK, start: str = "region") -> DataFrame:
    """(node, part) by one of METHODS; without one by the variable SLUICE_PARTITIONER, else contiguous."""
    method = method or os.environ.get("SLUICE_PARTITIONER", "contiguous")
    if parts < 1:
        raise ValueError("at least one part")
    if method == "contiguous":
        return contiguous(net, parts)
    if method == "propagation":
        return propagate(net, parts, slack=slack, lam=lam)
    if method not in METHODS:
        raise ValueError(f"unknown partitioner {method}; one of {', '.join(METHODS)}")
    return _sequential(net, parts, method, passes, lam, slack, start)


def arc_parts(arcs: DataFrame, part: DataFrame) -> DataFrame:
    """arcs with p_src and p_dst."""
    at = lambda c: part.select(F.col("node").alias(c), F.col("part").alias(f"p_{c}"))
    return arcs.join(at("src"), "src").join(at("dst"), "dst")


def boundary_nodes(arcs: DataFrame, part: DataFrame) -> DataFrame:
    """(node, part) of the nodes with an arc into another part."""
    cross = arc_parts(arcs, part).filter("p_src <> p_dst")
    return cross.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("p_src").alias("part")), F.struct(F.col("dst").alias("node"), F.col("p_dst").alias("part"))))).distinct()


def partition_statistics(net: FlowNetwork, part: DataFrame, lam: float = 0.0) -> DataFrame:
    """One row: parts, sizes of nodes and arcs (an arc is in its smaller end's part), imbalance, crossing, boundary, constrained."""
    arcs = arc_parts(net.arcs, part)
    nodes = part.groupBy("part").agg(F.count("*").alias("n"))
    home = arcs.groupBy(F.when(F.col("src") < F.col("dst"), F.col("p_src")).otherwise(F.col("p_dst")).alias("part")).agg(F.count("*").alias("m"))
    sizes = nodes.join(home, "part", "left").agg(
        F.count("*").alias("parts"), F.min("n").alias("min_nodes"), F.max("n").alias("max_nodes"), (F.max("n") / F.avg("n")).alias("imbalance"),
        F.min(F.coalesce("m", F.lit(0))).alias("min_arcs"), F.max(F.coalesce("m", F.lit(0))).alias("max_arcs"))
    cross = arcs.filter("p_src <> p_dst")
    crossing = cross.agg(F.count("*").alias("crossing_arcs"), F.round(F.coalesce(F.sum(edge_weight("cap", "rcap", lam)), F.lit(0.0)), 6).alias("crossing_weight"), F.count_distinct(F.greatest("src", "dst")).alias("constrained_nodes"))
    return sizes.crossJoin(crossing).crossJoin(boundary_nodes(net.arcs, part).agg(F.count("*").alias("boundary_nodes")))  # one row each
