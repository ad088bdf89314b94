"""Arithmetic of arcs, terminals, bounds and reports as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX, INT_MIN = 2**31 - 1, -(2**31)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remap_index(i: Column | str, source: int, sink: int) -> Column:
    """File ids count from 1 and include the two terminals; inner nodes count from 0 without them."""
    i = col(i)
    return (i - F.when(i > source, 1).otherwise(0) - F.when(i > sink, 1).otherwise(0) - 1).cast("long")


def is_terminal_arc(src: Column | str, dst: Column | str, source: int, sink: int) -> Column:
    return col(src).isin(source, sink) | col(dst).isin(source, sink)


def edge_weight(cap: Column | str, rcap: Column | str, lam: float = 0.0) -> Column:
    """1 + lam * ln(1 + the larger capacity), capacities below 0 counting as 0; 1 where lam is 0."""
    return F.lit(1.0) if lam == 0 else F.lit(1.0) + F.lit(lam) * F.log1p(F.greatest(F.lit(0).cast("double"), col(cap).cast("double"), col(rcap).cast("double")))


def as_int32(c: Column | str) -> Column:
    """The value as a 32-bit capacity; one that doesn't fit is an error at run time, not a wrap-around."""
    c = col(c)
    return F.when(c.between(INT_MIN, INT_MAX), c.cast("int")).otherwise(F.raise_error(F.concat(F.lit("capacity outside 32 bits: "), c.cast("string"))).cast("int"))


def cut_term(label_src: Column, label_dst: Column, cap: Column, rcap: Column) -> Column:
    """What an arc adds to the objective: its capacity from the source side to the sink side."""
    return F.when((label_src == 0) & (label_dst == 1), cap).when((label_src == 1) & (label_dst == 0), rcap).otherwise(0).cast("long")


def terminal_term(label: Column, tcap: Column) -> Column:
    """What a signed terminal adds: a source capacity counts on the sink side, a sink capacity on the source side."""
    return F.when(tcap > 0, tcap * label).otherwise(-tcap * (1 - label)).cast("long")


def regularized(original: Column | str, contribution: Column | str) -> Column:
    return col(original) + col(contribution)


def certified(original: Column | str, contribution: Column | str, budget: Column | str) -> Column:
    """A lower bound of the original objective: the regularised one less all that regularisation may have added."""
    return col(original) + col(contribution) - col(budget)


def over_budget(strength: Column | str, budget: Column | str, limit: Column | str | int) -> Column:
    return (col(strength) > 0) & (col(budget) >= (F.lit(limit) if isinstance(limit, int) else col(limit)))


def work_estimate(nodes: Column | str, arcs: Column | str, endpoints: Column | str) -> Column:
    return F.greatest(F.lit(1), col(nodes) + 2 * col(arcs) + 8 * col(endpoints)).cast("long")


def contiguous_part(node: Column | str, nodes: int, parts: int) -> Column:
    """Equal runs of node ids."""
    return F.floor(col(node) / F.lit(max(1, -(-nodes // parts)))).cast("int")


def arc_gradients(flow: Column | str, cap: Column | str, rcap: Column | str) -> tuple[Column, Column]:
    """Residual capacities against and along an arc, for a flow with the sign of the solver's result."""
    return col(flow) + col(cap), col(flow) - col(rcap)
