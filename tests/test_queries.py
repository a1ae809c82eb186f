import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from lectern.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the shared tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.SQL])
def test_equals_its_sql(spark, tables, name):
    found = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    got = sorted(tuple(map(plain, r)) for r in found.select(*columns).collect())
    want = tables.sql(catalogue.SQL[name])
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL])
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark):
    d = str(DATA)
    top = plan(catalogue.QUERIES["vector_topk"](spark, d))
    assert "TakeOrderedAndProject" in top and "CartesianProduct" not in top
    scoped = plan(catalogue.QUERIES["scope_filter"](spark, d))
    assert "PushedFilters: [" in scoped and "o_totalprice" not in scoped
    neighbours = plan(catalogue.QUERIES["context_neighbours"](spark, d))
    assert "NestedLoop" not in neighbours and "Cartesian" not in neighbours
