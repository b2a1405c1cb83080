"""Every query with SQL against it on the smallest tables, and plan checks."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if isinstance(v, (bool, int, str)) or v is None else v if hasattr(v, "year") else float(f"{float(v):.9g}")


@pytest.mark.parametrize("name", sorted(n for n in entry_module.registry.QUERIES if n in entry_module.registry.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    from souqframe.session import read_table

    plan = read_table(spark, SF, "listings").where("listing_id = 5").select("listing_id", "brand")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(listing_id,5)" in plan and "ReadSchema: struct<listing_id:bigint,brand:string>" in plan


@pytest.mark.parametrize("name", ["capacity_to_gb", "market_by_city", "use_flags", "regression_panel", "association_rules"])
def test_no_python_in_plain_queries(spark, name):
    plan = entry_module.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan


def test_nothing_outside_imports_the_training_data_operators():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "souqframe")
    for f in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            with open(f, encoding="utf-8") as h:
                assert "souqframe.llm" not in h.read(), f
