"""Minimum cuts and maximum flows on Spark DataFrames."""

from sluice.operators.coordinator import Coordinator, LocalWorker, Options, WorkerRounds
from sluice.operators.dual import SparkRounds
from sluice.operators.network import FlowNetwork
from sluice.operators.partition import partition
from sluice.operators.solve import cut_arcs, flows_of, labels_of, min_cut_many
from sluice.sources.dimacs import read_dimacs, write_dimacs

__all__ = ["Coordinator", "FlowNetwork", "LocalWorker", "Options", "SparkRounds", "WorkerRounds", "cut_arcs", "flows_of", "labels_of", "min_cut_many", "partition", "read_dimacs", "write_dimacs"]
