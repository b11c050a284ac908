import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings labels events pages conversations benchmark".split()
CORE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() == 500


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    if name not in entry.oracle_sql():
        assert got.count() >= 0
        return
    rel = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(got.columns)
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    wanted = sorted(tuple(show(float(v) if type(v).__name__ == "Decimal" else v) for v in row) for row in rel.fetchall())
    assert sorted(tuple(show(v) for v in row) for row in got.select(*names).collect()) == wanted
