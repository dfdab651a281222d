"""Every registered query: equal to DuckDB where SQL exists, sane rows and a clean plan otherwise."""

import math

import pytest

import __spark_entry__ as entry
from tests.conftest import SF

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def canon(row):
    return tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(name, spark, duck):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((canon(r[c] for c in cols) for r in df.collect()), key=str)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    theirs = sorted((canon(r[i] for i in order) for r in rel.fetchall()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(name, spark):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.limit(1).count() == 1


@pytest.mark.parametrize(
    "name", ["WN1_dedup_pool", "AG7_duplicate_types", "LK2_leakage_matrix_reviews", "SP5_matched_tests", "DR1_yearly_slope", "JN9_recover_timestamp"]
)
def test_no_nested_loops(name, spark):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(views):
    from tidemark.operators.duplicates import dedup_pool

    views.spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = dedup_pool(views.reviews, 1996, 1997)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "rating" in plan


def test_entry(spark):
    assert entry.entry(spark).columns == ["yr", "n", "neg", "neu", "pos", "median_len"]
