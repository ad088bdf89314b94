"""Networks, readers, partitions, decomposition and rounds on small tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from sluice import Coordinator, FlowNetwork, LocalWorker, Options, SparkRounds, WorkerRounds, labels_of, min_cut_many, read_dimacs, write_dimacs
from sluice.operators import decode, decompose, network
from sluice.operators.partition import METHODS, partition, partition_statistics
from sluice.sources.dimacs import DimacsDataSource
from sluice.streaming.arcs import merged_arcs

TEXT = "c comment\np max 4 4\nn 1 s\nn 4 t\na 1 2 5\na 2 3 7\na 3 2 11\na 3 4 17\n"


def net_of(spark, n, arcs, t):
    ends, caps = [v for a in arcs for v in a[:2]], [v for a in arcs for v in a[2:]]
    return FlowNetwork.from_arrays(spark, n, ends, caps, t)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def grid(spark):
    k, arcs = 6, []
    for i, j in itertools.product(range(k), range(k)):
        v = i * k + j
        arcs += [(v, v + 1, (3 * v) % 7 + 1, (5 * v) % 4)] if j < k - 1 else []
        arcs += [(v, v + k, (2 * v) % 5 + 1, (v * v) % 3)] if i < k - 1 else []
    net = net_of(spark, k * k, arcs, [(7 * v * v) % 23 - 11 for v in range(k * k)])
    return FlowNetwork(network.cut_lineage(net.arcs), network.cut_lineage(net.terminals), 0, k * k)


@pytest.mark.parametrize("n,arcs,t,value,labels", [
    (2, [(0, 1, 3, 4)], [5, -5], 3, [0, 1]),
    (2, [(0, 1, 3, 4)], [-4, -4], 0, [1, 1]),
    (2, [(0, 1, 3, 5)], [2, -4], 2, None),
    (2, [(0, 1, 21, 35)], [14, -28], 14, None),
    (1, [], [-5], 0, [1]),
    (2, [(0, 0, 9, 9), (0, 1, 1, 1), (1, 0, 1, 1)], [5, -5], 2, [0, 1]),
])
def test_small_networks(spark, n, arcs, t, value, labels):
    solved = min_cut_many(net_of(spark, n, arcs, t), True)
    r = solved.first()
    assert r["cut_value"] == r["max_flow"] == value
    assert labels is None or [x for _, x in rows(labels_of(solved))] == labels


def test_bad_networks(spark):
    for args in ((2, [0, 2], [1, 1], [0, 0]), (2, [0], [1], [0, 0]), (2, [0, 1], [1, 1], [0])):
        with pytest.raises(ValueError):
            FlowNetwork.from_arrays(spark, *args)
    net = net_of(spark, 2, [(0, 1, 2**30, 0)], [1, -1])
    with pytest.raises(ValueError):
        net.scaled(0)
    with pytest.raises(Exception, match="capacity outside 32 bits"):
        net.scaled(4).arcs.collect()
    assert min_cut_many(FlowNetwork(net.arcs.limit(0), net.terminals.limit(0), keys=("arc_id",)).__class__(net.arcs.limit(0).withColumnRenamed("arc_id", "k"), net.terminals.limit(0).withColumn("k", F.lit(0).cast("long")), keys=("k",))).count() == 0


def test_cut_value_of_labels(spark):
    net = net_of(spark, 3, [(0, 1, 4, 5), (1, 2, 6, 7)], [3, -2, 1])
    at = lambda x: net.cut_value(spark.createDataFrame(list(enumerate(x)), "node long, label int")).first()["value"]
    assert at([0, 0, 0]) == 2 and at([0, 1, 1]) == 4 + 1 and at([1, 0, 0]) == 5 + 3 + 2 and at([1, 1, 0]) == 3 + 7


def test_readers_agree(spark, tmp_path):
    at = tmp_path / "f.max"
    at.write_text(TEXT)
    got = {m: read_dimacs(spark, str(at), m) for m in ("general", "directed", "symmetric")}
    assert rows(got["general"].arcs) == [(0, 1, 7, 11)] and rows(got["directed"].arcs.select("src", "dst", "cap", "rcap")) == [(0, 1, 7, 0), (1, 0, 11, 0)]
    assert rows(got["symmetric"].arcs.select("src", "dst", "cap", "rcap")) == [(0, 1, 7, 11)] and got["symmetric"].node_count() == 2
    for net in got.values():
        assert rows(net.terminals) == [(0, 5), (1, -17)] and min_cut_many(net).first()["cut_value"] == 5
    spark.dataSource.register(DimacsDataSource)
    assert spark.read.format("dimacs").load(str(at)).filter("kind = 'a'").count() == 4


@pytest.mark.parametrize("text,mode", [
    (TEXT.replace("n 4 t\n", ""), "general"), ("p max 4 1\na 1 2 5\nn 1 s\nn 4 t\n", "general"), (TEXT.replace("a 1 2 5", "a 2 1 5"), "general"), (TEXT.replace("a 3 4 17", "a 4 3 17"), "directed"),
    (TEXT.replace("a 3 2 11", "a 2 3 11"), "symmetric"), (TEXT.replace("a 3 2 11\n", ""), "symmetric"), (TEXT.replace("a 2 3 7\na 3 2 11", "a 2 3 7\na 1 3 1\na 3 2 11"), "symmetric"), (TEXT, "other"), (TEXT.replace("a 2 3 7", "a 2 3"), "general"),
])
def test_bad_files(spark, tmp_path, text, mode):
    (tmp_path / "f.max").write_text(text)
    with pytest.raises(ValueError):
        read_dimacs(spark, str(tmp_path / "f.max"), mode)


def test_offset_keeps_netted_flow(spark, tmp_path):
    (tmp_path / "f.max").write_text("p max 3 4\nn 1 s\nn 3 t\na 1 2 5\na 2 3 2\na 1 3 4\na 1 2 1\n")
    net = read_dimacs(spark, str(tmp_path / "f.max"))
    assert rows(net.terminals) == [(0, 4)] and net.offset == 2 + 4 and min_cut_many(net).first()["cut_value"] == 0


def test_write_and_read(spark, grid, tmp_path):
    write_dimacs(grid, str(tmp_path / "out"))
    back = read_dimacs(spark, str(tmp_path / "out"), "symmetric")
    assert rows(back.arcs.select("src", "dst", "cap", "rcap")) == rows(grid.arcs.select("src", "dst", "cap", "rcap")) and min_cut_many(back).first()["cut_value"] == min_cut_many(grid).first()["cut_value"]


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("parts", [1, 3])
def test_partitioners(grid, method, parts):
    part = network.cut_lineage(partition(grid, parts, method))
    assert decompose.partition_violations(part, 36, parts).count() == 0
    stats = partition_statistics(grid, part).first()
    assert stats["max_nodes"] <= 14 * (3 // parts) + (36 if parts == 1 else 0) and (stats["crossing_arcs"] == 0) == (parts == 1)


def test_local_search_does_not_worsen(grid):
    cost = lambda p: (lambda s: s["crossing_weight"] + s["boundary_nodes"])(partition_statistics(grid, p, 0.005).first())
    assert cost(partition(grid, 4, "local_search", start="contiguous")) <= cost(partition(grid, 4, "contiguous"))
    assert cost(partition(grid, 4, "local_search")) <= cost(partition(grid, 4, "region"))
    for bad in (("x", 2), ("contiguous", 0)):
        with pytest.raises(ValueError):
            partition(grid, bad[1], bad[0])


def test_partitions_carry_the_whole_objective(spark, grid):
    """For labels on which all copies agree, the packages' objectives sum to the network's."""
    part = partition(grid, 4, "contiguous")
    packs = [r.asDict(recursive=True) for r in decompose.packages(grid, part).collect()]
    assert decompose.package_violations(decompose.packages(grid, part)).count() == 0
    x = [(v * v) % 5 % 2 for v in range(36)]
    total = 0
    for p in packs:
        label = [x[g] for g in p["local_to_global"]]
        for (s, t), (c, r) in zip(zip(p["arcs"][::2], p["arcs"][1::2]), zip(p["arc_capacities"][::2], p["arc_capacities"][1::2])):
            total += c * (label[s] < label[t]) + r * (label[s] > label[t])
        total += sum(w * y if w > 0 else -w * (1 - y) for w, y in zip(p["terminal_capacities"], label))
    assert total == grid.cut_value(spark.createDataFrame(list(enumerate(x)), "node long, label int")).first()["value"]
    bad = spark.createDataFrame([{**packs[0], "partition_id": -1, "arcs": [0, 99, 1]}], decompose.packages(grid, part).schema)
    assert decompose.package_violations(bad).count() >= 4


def test_node_without_arcs_at_home_gets_its_copy(spark):
    """The larger end of a crossing arc with terminal 0 is in no arc and no terminal of its own partition."""
    net = net_of(spark, 2, [(0, 1, 3, 5)], [2, 0])
    part = partition(net, 2, "contiguous")
    assert rows(decompose.members(net.arcs, part)) == [(0, 0), (0, 1), (1, 1)]
    assert Coordinator(SparkRounds(net, part), Options(max_iteration_count=3)).run_round(1, 1, 100, 0)["lower_bound"] == 0


def test_rounds_agree_between_backends(spark, grid):
    part = partition(grid, 3, "contiguous")
    big = grid.scaled(100)
    a, packs = SparkRounds(big, part), [r.asDict(recursive=True) for r in decompose.packages(big, part).collect()]
    one, two = Coordinator(a), Coordinator(WorkerRounds(packs, [LocalWorker(), LocalWorker()]))
    for k, (step, strength) in enumerate([(100, 0), (50, 0), (10, 10), (10, 10)]):
        r, s = one.run_round(k + 1, 1, step, strength), two.run_round(k + 1, 1, step, strength)
        assert {x: v for x, v in r.items()} == {x: v for x, v in s.items()}
    assert sorted(r["node"] for r in a.disagreeing().collect()) == sorted(two.rounds.disagreeing())


def test_solve_meets_the_optimum(spark, grid):
    direct = min_cut_many(grid).first()["cut_value"]
    seen = []
    rounds = SparkRounds(grid.scaled(1000), partition(grid, 2, "contiguous"))
    r = Coordinator(rounds, Options(objective_scale=1000, track_primal_upper_bound=True, max_iteration_count=2, initial_step_size=100, num_optimization_scales=2)).solve(lambda labels, best, bad: seen.append((labels.count(), best)))
    assert r.unscaled("best_lower_bound") <= direct <= r.unscaled("best_upper_bound")
    assert all(n == 36 for n, _ in seen)
    assert r.status != "OPTIMAL" or round(r.unscaled("best_lower_bound")) == direct


def test_votes(spark):
    copies = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (0, 2, 1), (1, 2, 1), (2, 2, 0), (0, 3, 0)], "p int, node long, label int")
    assert rows(decode.majority(copies)) == [(1, 0), (2, 1), (3, 0)] and rows(decode.average(copies)) == [(1, 1), (2, 1), (3, 0)]


def test_narrow_band(spark, grid):
    best = labels_of(min_cut_many(grid))
    zero = best.withColumn("label", F.lit(0))
    value = lambda x: grid.cut_value(x).first()["value"]
    seeds = spark.createDataFrame([(14,)], "node long")
    whole = decode.narrow_band(grid, zero, seeds, 20)
    assert value(whole) == value(best)
    assert value(decode.narrow_band(grid, zero, seeds, 2, write_rim=False)) <= value(zero)
    assert rows(decode.narrow_band(grid, zero, seeds, 20, budget=5)) == rows(zero)
    assert {tuple(r) for r in network.bfs(grid.arcs, seeds, 1).collect()} == {(14, 0), (13, 1), (15, 1), (8, 1), (20, 1)}


def test_stream_of_arcs(spark, tmp_path):
    data = [(0, 1, 2), (1, 0, 3), (0, 1, 4), (2, 2, 9)]
    spark.createDataFrame(data, "src long, dst long, cap long").write.parquet(str(tmp_path / "in"))
    stream = merged_arcs(spark.readStream.schema("src long, dst long, cap long").parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("arcs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(60)
    assert rows(spark.table("arcs")) == [(0, 1, 6, 3)]


def test_command_line(spark, tmp_path, capsys):
    from sluice import cli

    (tmp_path / "f.max").write_text(TEXT)
    out = cli.run(spark, ["cut", str(tmp_path / "f.max"), "--labels", str(tmp_path / "labels")])
    assert out["min_cut"] == out["max_flow"] == 5 and spark.read.parquet(str(tmp_path / "labels")).count() == 2
    out = cli.run(spark, ["dual", str(tmp_path / "f.max"), "--partitions", "2", "--capacity-multiplier", "100", "--iterations", "2", "--initial-step", "100", "--scales", "1"])
    assert out["best_lower_bound"] <= 5 <= out["best_upper_bound"] and "status" in capsys.readouterr().out
