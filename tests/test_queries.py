"""Every registered query runs; those with SQL give DuckDB's rows on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tidegauge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = ("model_", "stream_")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE])
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = duck.execute(registry.ORACLE[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE and not n.startswith(SLOW)])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).columns


def test_no_nested_loops_in_the_central_joins(spark):
    for name in ("slice_features_60m", "asof_backward_12h", "asof_nearest_2m", "slice_by_unit", "rolling_time_windows"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan, name


def test_pushdown_and_pruning(spark):
    plan = registry.QUERIES["topk_per_group"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "user_id" not in plan
