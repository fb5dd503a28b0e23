"""Every catalog query against its SQL in DuckDB, on the driver's smallest tables."""

import math
import pathlib

import pytest

import __spark_entry__ as contract
from strobila.plans import catalog

DIR = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) or not math.isnan(v) else 0.0) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DIR))
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted((tuple(r) for r in got.select(*sorted(names)).collect()), key=key)
    order = sorted(range(len(names)), key=lambda k: names[k])
    b = sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=key)
    assert a == b


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_no_accidental_products(spark):
    for name, f in catalog.QUERIES.items():
        plan = f(spark, str(DIR))._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
