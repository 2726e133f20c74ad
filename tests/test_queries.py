"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from factloom.plans import constructed  # noqa: F401 - registers its queries
from factloom.plans import tables
from factloom.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(norm, r)) for r in df.select(*columns).collect())
    assert rows
    if name in SQL:
        found = duck.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert sorted(tuple(norm(r[i]) for i in at) for r in found.fetchall()) == rows


def test_hybrid_merge_joins_by_equal_keys(spark):
    """No row is laid beside all others outside the vectors' tiles."""
    plan = QUERIES["hybrid_merge"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_inverse_edges_has_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert QUERIES["inverse_edges"](spark, DIR).rdd.getNumPartitions() >= lines // 100
