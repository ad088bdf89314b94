import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """The query equals its SQL on a table folder."""

    def check(query, sql):
        df = query(spark, sf)
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(df.columns) == sorted(names)
        assert norm([tuple(x) for x in df.collect()], df.columns) == norm(r.fetchall(), names)

    return check
