"""What one task or one row holds must not grow with the tables: plans, shuffles and pieces on small networks."""

import pytest
from pyspark.sql import functions as F

from sluice import FlowNetwork, read_dimacs, write_dimacs
from sluice.operators import decompose, network
from sluice.operators import partition as partitions
from sluice.operators.partition import partition
from sluice.plans import catalog
from sluice.plans.networks import supply_network
from sluice.sources import dimacs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def net(spark):
    arcs = spark.createDataFrame([(0, 5, 2, 3), (5, 0, 1, 4), (2, 2, 9, 9), (3, 1, 6, 7), (0, 5, 1, 1)], "src long, dst long, cap long, rcap long")
    return FlowNetwork(arcs, spark.createDataFrame([(v, v - 2) for v in range(6)], "node long, tcap long"))


def test_canonical_sums_each_arc_as_one_row(net):
    got = net.canonical().arcs
    assert rows(got) == [(0, 5, 7, 5), (1, 3, 7, 6)]
    assert "Generate" not in plan(got) and plan(got).count("Aggregate") == 1


def test_supply_arcs_stay_in_as_many_tasks_as_there_are_shuffle_partitions(spark):
    assert supply_network(spark, SF).arcs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bfs_holds_no_sum_over_links(spark, net, monkeypatch):
    seen = []
    monkeypatch.setattr(network, "cut_lineage", lambda df, real=network.cut_lineage: (seen.append(plan(df)), real(df))[1])
    assert rows(network.bfs(net.arcs, spark.createDataFrame([(0,)], "node long"), 2)) == [(0, 0), (5, 1)]
    assert "Aggregate" not in seen[0]


def test_package_pieces_hold_what_packages_hold_in_no_array(spark):
    net = FlowNetwork(supply_network(spark, SF).canonical().arcs, supply_network(spark, SF).terminals)
    part = partition(net, 4, "contiguous")
    got, packs = decompose.pieces(net, part), decompose.packages(net, part).collect()
    assert sorted((r["partition_id"], r["local_node_count"], len(r["arcs"]) // 2, len(r["constraint_endpoints"]), sum(r["arc_capacities"]), sum(r["terminal_capacities"])) for r in packs) == rows(decompose.summary(got))
    assert not decompose.piece_violations(got).collect()
    for name in ("package_summary", "package_checks"):
        text = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in text, name


def test_broken_pieces_are_found(spark):
    nodes = spark.createDataFrame([(0, 7, 0, 1), (0, 8, 2, 1), (-1, 9, 0, None)], "p int, node long, local_index int, tcap long")
    arcs = spark.createDataFrame([(0, 7, 8, 0, 2, 1, 1), (0, 7, 9, 0, None, 1, 1), (-1, 9, 9, 0, 0, None, 1)], "p int, src long, dst long, a int, b int, cap long, rcap long")
    ends = spark.createDataFrame([(0, -1, 7, 0, True), (5, 1, 7, 0, True)], "p int, constraint_id long, node long, local_index int, is_source boolean")
    assert rows(decompose.piece_violations(decompose.Pieces(nodes, arcs, ends))) == [
        (-1, "capacities don't match arcs"), (-1, "negative partition id"), (-1, "terminals don't match nodes"),
        (0, "arc end out of range"), (0, "negative constraint id"), (0, "node map is neither empty nor full"), (5, "constraint end out of range")]


@pytest.mark.parametrize("size", [64, 10_000])
def test_dimacs_lines_and_pairs_without_a_shuffle_of_lines(spark, tmp_path, size):
    """Blocks of a few lines: pairs stand across their edges."""
    arcs = [(v, v + 1, v % 7 + 1, v % 5) for v in range(40)]
    net = FlowNetwork(spark.createDataFrame(arcs, "src long, dst long, cap long, rcap long"), spark.createDataFrame([(v, (v * 5) % 11 - 5) for v in range(41)], "node long, tcap long"))
    write_dimacs(net, str(tmp_path / "out"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        for mode in ("general", "symmetric"):
            back = read_dimacs(spark, str(tmp_path / "out"), mode)
            assert rows(back.arcs.select("src", "dst", "cap", "rcap")) == arcs
            assert rows(back.terminals) == [(v, t) for v, t in rows(net.terminals) if t]
        assert plan(back.arcs).count("Window") == 0 and "RowNumber" not in plan(back.arcs)
        at = dimacs.lines(spark, str(tmp_path / "out"))
        assert "Window" not in plan(at) and "Aggregate" not in plan(at)
        assert [r["line"] for r in at.select("line").orderBy("line").collect()] == list(range(len(arcs) * 2 + 3 + sum(t != 0 for _, t in rows(net.terminals))))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_bad_pairs_across_blocks(spark, tmp_path):
    text = "p max 5 4\nn 1 s\nn 5 t\na 2 3 7\na 1 3 1\na 3 2 11\na 3 4 2\na 4 3 5\n"
    (tmp_path / "f.max").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (8, 16, old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            with pytest.raises(ValueError, match="^1 arcs"):
                read_dimacs(spark, str(tmp_path / "f.max"), "symmetric")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sequential_methods_take_any_number_of_arcs(spark, monkeypatch):
    """A path of 12 nodes with parallel and opposite arcs and a loop, in four regions as the plain queues give them."""
    arcs = [(v, v + 1, 3, 1) for v in range(11)] + [(4, 3, 1, 1), (4, 3, 1, 1), (7, 7, 1, 1)]
    long = FlowNetwork(spark.createDataFrame(arcs, "src long, dst long, cap long, rcap long"), spark.createDataFrame([(0, 1)], "node long, tcap long"), 0, 12)
    monkeypatch.setattr(partitions, "SEQUENTIAL_ARCS", 3, raising=False)  # a limit there was
    assert [p for _, p in rows(partition(long, 4, "region"))] == [0, 0, 1, 1, 0, 1, 2, 2, 2, 3, 3, 3]
    assert len(rows(partition(long, 4, "local_search"))) == 12
