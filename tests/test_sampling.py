"""Sampling against brute force, with skewed strata and different partitionings."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sampling as S
from tidemark.operators import splits as SP


def ph(s: str) -> int:
    return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)


def order(seed, ids):
    return sorted(ids, key=lambda i: (ph(f"{seed}:{i}"), i))


@pytest.fixture(scope="module")
def rows(spark):
    # one stratum holds more than a third of all rows, one holds a single row
    return spark.range(3000).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("item_id"),
        F.when(F.col("id") < 1200, "hot").when(F.col("id") == 1200, "lone").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("g"),
    )


@pytest.mark.parametrize("n", [0, 1, 10, 2999, 3000, 5000])
def test_bottom_n_is_order_by_limit(rows, n):
    got = {r.item_id for r in S.bottom_n(rows, "item_id", n, 42).collect()}
    assert got == set(order(42, [f"r{i}" for i in range(3000)])[:n])


def test_bottom_n_per_stratum(rows):
    got = {}
    for r in S.bottom_n(rows, "item_id", 50, 7, ["g"], 9).collect():
        got.setdefault(r.g, set()).add(r.item_id)
    by = {}
    for r in rows.collect():
        by.setdefault(r.g, []).append(r.item_id)
    assert got == {g: set(order(7, ids)[:50]) for g, ids in by.items()}


def test_same_sample_under_any_partitioning(rows):
    a = {r.item_id for r in S.sample_n(rows.repartition(1), 100, 3).collect()}
    b = {r.item_id for r in S.sample_n(rows.repartition(17, "g"), 100, 3).collect()}
    c = {r.item_id for r in S.bottom_n(rows, "item_id", 100, 3, bits=2).collect()}
    assert a == b == c and len(a) == 100


def test_dense_index(rows):
    got = {r.item_id: r.i for r in S.dense_index(rows, "item_id", 5, "i").collect()}
    want = {x: i for i, x in enumerate(order(5, got))}
    assert got == want


def test_dense_index_in_groups(rows):
    out = S.dense_index(rows, "item_id", 5, "i", ["g"], 9).groupBy("g").agg(
        F.min("i").alias("lo"), F.max("i").alias("hi"), F.count_distinct("i").alias("n")
    )
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in out.collect())


def test_seed_subsamples_differ_by_seed(rows):
    out = S.seed_subsamples(rows, 200, [42, 43])
    sets = {s: {r.item_id for r in out.filter(F.col("seed") == s).collect()} for s in (42, 43)}
    assert all(len(x) == 200 for x in sets.values()) and sets[42] != sets[43]


def test_splits_are_disjoint_and_grouped(views):
    d = SP.split_by_key(views.pool, "user_id")
    mixed = d.groupBy("user_id").agg(F.count_distinct("is_train").alias("k")).filter("k > 1").count()
    assert mixed == 0
    share = d.agg(F.avg(F.col("is_train").cast("double"))).first()[0]
    assert 0.7 < share < 0.9


def test_matched_quotas_are_exact(views):
    prior = SP.class_prior(views.pool)
    want = {r.y: round(300 * r.prior) for r in prior.collect()}
    out = SP.matched_tests(views.pool.select("item_id", "yr", "y"), prior, 300, (1997, 1998), 7)
    have = {(r.yr, r.y): r["count"] for r in views.pool.groupBy("yr", "y").count().collect()}
    for r in out.groupBy("yr", "y").count().collect():
        assert r["count"] == min(want[r.y], have[(r.yr, r.y)])


def test_retraining_sample_avoids_tests(views):
    s = views.samples
    tests = s.filter(F.col("sample").startswith("test"))
    assert SP.overlap_count(s.filter("sample = 'train_1999_2000'"), tests).first().overlap == 0


def test_stratum_smaller_than_quota(rows):
    assert S.bottom_n(rows, "item_id", 50, 1, ["g"]).filter("g = 'lone'").count() == 1
