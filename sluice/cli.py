"""python -m sluice.cli cut FILE | dual FILE: solve a DIMACS file and print what was found, a line for each figure."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from sluice.operators.coordinator import SCALED_EPSILON, Coordinator, Options
from sluice.operators.dual import SparkRounds
from sluice.operators.network import FlowNetwork
from sluice.operators.partition import METHODS, partition, partition_statistics
from sluice.operators.solve import labels_of, min_cut_many
from sluice.sources.dimacs import MODES, read_dimacs


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=("cut", "dual"))
    p.add_argument("file")
    p.add_argument("--mode", choices=MODES, default="general")
    p.add_argument("--capacity-multiplier", type=int, default=1)
    p.add_argument("--labels", help="folder to which the labels go as Parquet")
    p.add_argument("--partitions", type=int, default=2)
    p.add_argument("--partitioner", choices=METHODS)
    p.add_argument("--iterations", type=int, default=10000)
    p.add_argument("--scales", type=int, default=5)
    p.add_argument("--initial-step", type=int, default=10000)
    p.add_argument("--min-step", type=int, default=1)
    p.add_argument("--max-step", type=int, default=10000)
    p.add_argument("--patience", type=int, default=10)
    p.add_argument("--legacy-patience", action="store_true")
    p.add_argument("--disable-group-stopping", action="store_true")
    p.add_argument("--no-momentum", action="store_true")
    p.add_argument("--disable-regularization", action="store_true")
    p.add_argument("--budget-limit", type=int, default=0)
    p.add_argument("--no-promotion", action="store_true")
    p.add_argument("--random-alpha-radius", type=int, default=0)
    p.add_argument("--random-alpha-seed", type=int, default=0)
    p.add_argument("--no-upper-bound", action="store_true")
    return p


def options(a: argparse.Namespace) -> Options:
    return Options(num_optimization_scales=a.scales, max_iteration_count=a.iterations, initial_step_size=a.initial_step, patience=a.patience, legacy_patience=a.legacy_patience, min_step_size=a.min_step, max_step_size=a.max_step,
                   objective_scale=a.capacity_multiplier, use_momentum=not a.no_momentum, enable_group_stopping=not a.disable_group_stopping, regularization_scheme="NONE" if a.disable_regularization else SCALED_EPSILON,
                   regularization_budget_limit=a.budget_limit, promote_objective_scale_on_overbudget=not a.no_promotion, randomize_initial_alphas=a.random_alpha_radius > 0, initial_alpha_random_radius=a.random_alpha_radius,
                   initial_alpha_random_seed=a.random_alpha_seed, track_primal_upper_bound=not a.no_upper_bound)


def run(spark: SparkSession, argv: list[str] | None = None) -> dict:
    """The figures of a command, also printed."""
    a = arguments().parse_args(argv)
    out, began = {}, time.perf_counter()
    net = read_dimacs(spark, a.file, a.mode)
    net = net.scaled(a.capacity_multiplier) if a.capacity_multiplier != 1 else net
    out |= {"nodes": net.node_count(), "arcs": net.arcs.count(), "offset": net.offset, "read_s": time.perf_counter() - began}
    began = time.perf_counter()
    if a.command == "cut":
        solved = min_cut_many(net, True).persist()
        row = solved.first()
        out |= {"min_cut": row["cut_value"], "max_flow": row["max_flow"], "min_cut_with_offset": row["cut_value"] + net.offset}
        labels = labels_of(solved)
    else:
        net = FlowNetwork(net.canonical().arcs, net.terminals, net.offset, net.node_count())
        part = partition(net, a.partitions, a.partitioner)
        out |= partition_statistics(net, part).first().asDict()
        rounds = SparkRounds(net, part)
        out["decompose_s"] = time.perf_counter() - began
        got = Coordinator(rounds, options(a)).solve()
        out |= {k: getattr(got, k) for k in ("status", "stop_reason", "scale", "total_iterations", "objective_scale_promotion_count", "final_disagreement_count")}
        out |= {k: got.unscaled(k) for k in ("best_lower_bound", "best_upper_bound", "final_objective")}
        out["gap"] = None if got.best_upper_bound_raw is None else out["best_upper_bound"] - out["best_lower_bound"]
        from sluice.operators.decode import average

        labels = average(rounds.copies())
    out["solve_s"] = time.perf_counter() - began
    if a.labels:
        labels.write.mode("overwrite").parquet(a.labels)
    for k, v in out.items():
        print(f"{k} {v}")
    return out


if __name__ == "__main__":
    run(SparkSession.builder.appName("sluice").getOrCreate())
