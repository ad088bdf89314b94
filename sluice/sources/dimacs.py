"""DIMACS maximum-flow text: three readers, a writer, and the Spark data source `dimacs`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from sluice.functions.columns import is_terminal_arc, remap_index
from sluice.operators.network import FlowNetwork, canonical_arcs, cut_lineage, net_terminals

MODES = ("general", "directed", "symmetric")


def _blocks_of(spark: SparkSession, path: str) -> DataFrame:
    """(f, b, m, value): lines with their file, the start of their block in it, and a number that rises by 1 inside a block."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), "value")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(kind, tokens, line, block) of the lines that aren't comments, line being the place in the file.

    A task reads a block from its start to its end, so a line's place is that of its block and what it is behind the
    block's first line: lines are numbered where they are read, and only a count for each block is gathered.
    """
    raw = _blocks_of(spark, path)
    told = raw.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("m").alias("first")).orderBy("f", "b").collect()
    rows, before = [], 0
    for k, r in enumerate(told):
        rows.append((r["f"], r["b"], r["first"], before, k))
        before += r["n"]
    at = spark.createDataFrame(rows, "f string, b long, first long, before long, block int")
    kind = F.substring("value", 1, 1)
    out = raw.filter(kind.isin("p", "n", "a")).join(F.broadcast(at), ["f", "b"], "left")
    known = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("the file's blocks have changed while it was read")).cast("long"))
    return out.select(kind.alias("kind"), F.split(F.trim("value"), r"\s+").alias("tokens"), (known("before") + F.col("m") - F.col("first")).cast("long").alias("line"), "block")


def read_dimacs(spark: SparkSession, path: str, mode: str = "general") -> FlowNetwork:
    """The network of a file `p max N M`, `n ID s|t`, `a SRC DST CAP`, its nodes numbered from 0 without the terminals.

    general sums parallel arcs and joins opposite ones; directed keeps each arc as it stands, with
    no backward capacity; symmetric takes arcs in adjacent opposite pairs, in the file's order, and
    the declared number of nodes. Arcs of a node from the source and to the sink are netted, and
    what that takes out of the flow is in offset, as are arcs from source to sink. Arcs into the source or out
    of the sink, arcs before the terminals are known, and unpaired arcs in symmetric mode raise
    ValueError; a number that isn't one is an error when it is read.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; one of {', '.join(MODES)}")
    every = lines(spark, path)
    heads = every.filter(F.col("kind") != "a").orderBy("line").limit(1000).collect()  # a problem line and two node lines
    ends = {}
    for r in heads:
        if r["kind"] == "n":
            ends.setdefault(r["tokens"][2], (int(r["tokens"][1]), r["line"]))
    if not {"s", "t"} <= ends.keys():
        raise ValueError("the file names no source or no sink")
    (source, at_s), (sink, at_t) = ends["s"], ends["t"]
    number = lambda k: F.get("tokens", F.lit(k)).cast("long")
    arcs = every.filter("kind = 'a'").select("line", "block", number(1).alias("u"), number(2).alias("v"), number(3).alias("cap"))
    at_end = is_terminal_arc("u", "v", source, sink)
    told = arcs.groupBy("block").agg(F.count_if(F.col("line") < max(at_s, at_t)).alias("early"), F.count_if((F.col("v") == source) | (F.col("u") == sink)).alias("wrong"), F.count_if(F.col("u").isNull() | F.col("v").isNull() | F.col("cap").isNull()).alias("short"), F.coalesce(F.sum(F.when((F.col("u") == source) & (F.col("v") == sink), F.col("cap"))), F.lit(0)).alias("direct"), F.count("*").alias("arcs"), F.count_if(~at_end).alias("inner")).orderBy("block").collect()
    bad = {k: sum(r[k] for r in told) for k in ("early", "wrong", "short", "direct")}
    if bad["early"] or bad["short"]:
        raise ValueError("an arc stands before the terminals" if bad["early"] else "an arc lacks a number")
    if bad["wrong"]:
        raise ValueError(f"{bad['wrong']} arcs go into the source or out of the sink")
    inner = arcs.filter(~at_end).select("line", remap_index("u", source, sink).alias("src"), remap_index("v", source, sink).alias("dst"), "cap")
    outer = arcs.filter(at_end & ~((F.col("u") == source) & (F.col("v") == sink)))
    terms = cut_lineage(net_terminals(outer.select(remap_index(F.when(F.col("u") == source, F.col("v")).otherwise(F.col("u")), source, sink).alias("node"), (F.col("u") == source).alias("from_source"), "cap")))  # asked for twice, a row for each node
    offset = bad["direct"] + terms.agg(F.coalesce(F.sum("imbalance"), F.lit(0))).first()[0]
    terms = terms.select("node", "tcap")
    if mode == "general":
        return FlowNetwork(canonical_arcs(inner), terms, offset)
    if mode == "directed":
        return FlowNetwork(inner.select("line", "src", "dst", "cap", F.lit(0).cast("long").alias("rcap")), terms, offset)
    declared = next((int(r["tokens"][2]) for r in heads if r["kind"] == "p"), None)
    if declared is None:
        raise ValueError("the file has no problem line")
    ends = arcs.select("block", "line", remap_index("u", source, sink).alias("src"), remap_index("v", source, sink).alias("dst"), "cap", (~at_end).alias("inner"))
    return FlowNetwork(_pairs(ends, [(r["block"], r["arcs"], r["inner"]) for r in told]), terms, offset, declared - 2)


PAIRS = "pair long, half int, line long, src long, dst long, cap long, rcap long, place long, bad long"


def _pairs(arcs: DataFrame, blocks: list[tuple[int, int, int]]) -> DataFrame:
    """Adjacent opposite arcs as one; the k-th inner arc belongs to pair k div 2.

    blocks tells how many arcs and inner arcs a block has, so a task knows k from its block's first line on and
    joins its arcs as it reads them. Only an arc at a block's edge, whose other half is in another block, is shuffled.
    """
    before, arcs_before, inner_before = {}, 0, 0
    for block, n, k in blocks:
        before[block] = arcs_before, inner_before
        arcs_before, inner_before = arcs_before + n, inner_before + k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, k, held = None, 0, 0, None  # held is the first half of a pair, with its place among the arcs

        def half(kind: int, k: int, row) -> pa.RecordBatch:
            line, src, dst, cap, place = row
            return _table([k // 2], [kind], [line], [src], [dst], [cap], [0], [place], [0])

        for b in batches:
            of, line, src, dst, cap = (b.column(c).to_numpy() for c in range(5))
            inner = b.column(5).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if of[lo] != block:
                    if held is not None:
                        yield half(0, k - 1, held)
                    block, held = of[lo], None
                    at, k = before[int(block)]
                place = at + np.arange(hi - lo)
                at += hi - lo
                on = inner[lo:hi]
                rows = np.stack([line[lo:hi][on], src[lo:hi][on], dst[lo:hi][on], cap[lo:hi][on], place[on]], axis=1)
                first, k = k, k + len(rows)
                if held is not None:
                    rows, first, held = np.concatenate([[held], rows]), first - 1, None
                elif len(rows) and first % 2:
                    yield half(1, first, rows[0])
                    rows, first = rows[1:], first + 1
                if len(rows) % 2:
                    rows, held = rows[:-1], rows[-1]
                if len(rows):
                    x, y = rows[0::2], rows[1::2]
                    wrong = ((x[:, 1] != y[:, 2]) | (x[:, 2] != y[:, 1])) + (y[:, 4] - x[:, 4] - 1)
                    yield _table(first // 2 + np.arange(len(x)), np.full(len(x), -1), x[:, 0], x[:, 1], x[:, 2], x[:, 3], y[:, 3], x[:, 4], wrong)
        if held is not None:
            yield half(0, k - 1, held)

    got = arcs.mapInArrow(run, PAIRS)
    halves = got.filter("half >= 0").groupBy("pair").agg(F.min_by(F.struct("line", "src", "dst", "cap", "place"), "half").alias("x"), F.max_by(F.struct("line", "src", "dst", "cap", "place"), "half").alias("y"), F.count("*").alias("n"))
    apart = (F.col("n") != 2) | (F.col("x.src") != F.col("y.dst")) | (F.col("x.dst") != F.col("y.src"))
    halves = halves.select("x.line", "x.src", "x.dst", F.col("x.cap").alias("cap"), F.col("y.cap").alias("rcap"), (apart.cast("long") + F.greatest(F.col("y.place") - F.col("x.place") - 1, F.lit(0))).alias("bad"))
    every = got.filter("half < 0").select(*halves.columns).unionByName(halves)
    if wrong := every.agg(F.coalesce(F.sum("bad"), F.lit(0))).first()[0]:
        raise ValueError(f"{wrong} arcs don't stand in adjacent opposite pairs")
    return every.drop("bad")


def _table(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 7)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), t) for c, t in zip(columns, kinds)], ["pair", "half", "line", "src", "dst", "cap", "rcap", "place", "bad"])


def to_dimacs(net: FlowNetwork) -> DataFrame:
    """(value) lines of a network: nodes count from 1, then come the source and the sink."""
    spark = net.arcs.sparkSession
    # One pass over the arcs tells both how many there are and the largest node.
    told = net.arcs.agg(F.count("*").alias("m"), F.max(F.greatest("src", "dst")).alias("most")).first()
    also = net.terminals.agg(F.count_if(F.col("tcap") != 0).alias("m"), F.max("node").alias("most")).first()
    n = net.n_nodes if net.n_nodes is not None else max(-1 if r["most"] is None else r["most"] for r in (told, also)) + 1
    m = 2 * told["m"] + also["m"]
    arcs = net.arcs.select(F.inline(F.array(F.struct((F.col("src") + 1).alias("u"), (F.col("dst") + 1).alias("v"), F.col("cap").alias("c")), F.struct((F.col("dst") + 1).alias("u"), (F.col("src") + 1).alias("v"), F.col("rcap").alias("c")))))
    terms = net.terminals.filter("tcap <> 0").select(F.when(F.col("tcap") > 0, n + 1).otherwise(F.col("node") + 1).alias("u"), F.when(F.col("tcap") > 0, F.col("node") + 1).otherwise(n + 2).alias("v"), F.abs("tcap").alias("c"))
    every = arcs.unionByName(terms)
    heads = spark.createDataFrame([(0, f"p max {n + 2} {m}"), (1, f"n {n + 1} s"), (2, f"n {n + 2} t")], "o int, value string").coalesce(1).sortWithinPartitions("o").select("value")
    return heads.unionByName(every.select(F.concat_ws(" ", F.lit("a"), "u", "v", "c").alias("value")))


def write_dimacs(net: FlowNetwork, path: str) -> None:
    """Writes a folder of text parts, the headers first; read_dimacs reads it as one file."""
    to_dimacs(net).write.mode("overwrite").text(path)


class DimacsDataSource(DataSource):
    """spark.read.format("dimacs").load(path): (kind, a, b, cap) of every line, for looking at small files."""

    @classmethod
    def name(cls) -> str:
        return "dimacs"

    def schema(self) -> str:
        return "kind string, a string, b string, cap long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition):
        import pyarrow.fs as fs

        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        with store.open_input_stream(at) as f:
            for line in f.readall().decode().splitlines():
                t = line.split()
                if t and t[0] in ("p", "n", "a"):
                    yield t[0], t[1], t[2], int(t[3]) if len(t) > 3 else None
