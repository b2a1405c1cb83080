"""Every query of the training-data operators with SQL against it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from souqframe.llm import queries
from tests.test_queries import SF, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(queries.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_splits_of_chained_documents(spark):
    rows = queries.p1_document_groups(spark, SF).collect()
    part = {r.doc_id: r.split for r in queries.p1_document_split(spark, SF).collect()}
    assert {r.doc_id for r in rows} == set(part)
    assert all(part[r.doc_id] == part[r.first_id] for r in rows)
    assert len({r.first_id for r in rows}) < len(rows)
