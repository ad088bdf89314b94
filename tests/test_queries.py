"""Every query with SQL against DuckDB, and the entry module without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sluice.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    r = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    assert norm(map(tuple, df.collect()), df.columns) == norm(r.fetchall(), names)


def test_queries_without_sql(spark):
    run = lambda n: catalog.queries()[n](spark, SF).collect()
    (cut,) = run("supply_mincut")
    assert cut["proved"] and cut["cut_value"] == cut["max_flow"]
    assert run("band_mincut")[0]["no_worse"] and all(r["worker"] in (0, 1, 2) for r in run("lpt_assignment"))
    (dd,) = run("dd_equals_direct")
    assert dd["bounded"] and dd["equal"]
    assert all(r["lower_bound"] <= cut["cut_value"] <= r["upper_bound"] for r in run("dd_round_trace"))


def test_bands_cover_the_whole_network(spark):
    from sluice.plans.networks import supply_network

    net, near = supply_network(spark, SF), {}
    for r in net.arcs.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
        near.setdefault(r["dst"], set()).add(r["src"])
    want, edge = {0: 0, 1: 0}, {0, 1}
    for d in (1, 2, 3):
        edge = {b for a in edge for b in near.get(a, ())} - want.keys()
        want |= dict.fromkeys(edge, d)
    assert {r["node"]: r["distance"] for r in catalog.queries()["band_bfs"](spark, SF).collect()} == want
    zero = net.cut_value(net.terminals.selectExpr("node", "0 AS label")).first()["value"]
    assert catalog.queries()["band_mincut"](spark, SF).first()["before"] == zero


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data_operators(tmp_path, left):
    for p in ("sluice", "__spark_entry__.py", *(x for x in left if (ROOT / x).exists())):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "sluice/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'arc_merge' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
