"""Every query of the library by name, with its SQL where DuckDB can express it."""

from sluice.plans import cuts, duals, graphs


def queries():
    return cuts.QUERIES | graphs.QUERIES | duals.QUERIES


def oracle_sql():
    return cuts.SQL | graphs.SQL | duals.SQL
