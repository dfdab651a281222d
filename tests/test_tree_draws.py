"""Replicates drawn down a tree of cells: exact binomial quantiles, trees that can be cut, draws that repeat anywhere."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap as B


@pytest.mark.parametrize("m,p", [(1, 0.3), (7, 0.5), (50, 0.02), (900, 0.37), (3, 0.999), (40, 1.0)])
def test_quantiles_of_the_binomial(m, p):
    mass = [math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1)]
    u = np.concatenate([np.random.default_rng(1).random(3000), [0.0, 1 - 2**-53]])
    got = B.binomial_quantile(u, np.full(len(u), m), p)
    inside = np.abs(np.subtract.outer(u, np.cumsum(mass))).min(axis=1) > 1e-12
    assert (got == np.searchsorted(np.cumsum(mass), u, side="right").clip(0, m))[inside].all()
    assert B.binomial_quantile(u[:3], np.array([0, m, 0]), p)[[0, 2]].tolist() == [0, 0]


def test_large_numbers_of_draws():
    u = np.random.default_rng(2).random(4000)
    got = B.binomial_quantile(u, np.full(4000, 10**7), 0.3)
    assert abs(got.mean() - 3e6) < 200 and 0.9 < got.std() / (10**7 * 0.21) ** 0.5 < 1.1


def test_tree_follows_the_multinomial_law_and_can_be_cut():
    sizes = np.array([5, 3, 9, 1, 2, 40, 0, 0, 7, 1, 0, 0, 0, 0, 0, 0], float)
    n, total = 4000, int(sizes.sum())
    whole = B.split_draws(sizes, np.full(n, total), "s:1")
    share = sizes / total
    assert (whole.sum(axis=1) == total).all() and (whole[:, sizes == 0] == 0).all()
    assert np.abs(whole.mean(axis=0) - sizes).max() < 0.5
    assert np.allclose(np.cov(whole[:, :6].T), (total * (np.diag(share) - np.outer(share, share)))[:6, :6], atol=1.6)
    # Subtrees of their own, and empty levels above, draw the same.
    top = B.split_draws(sizes.reshape(4, 4).sum(axis=1), np.full(n, total), "s:1", 2)
    assert (np.concatenate([B.split_draws(sizes[4 * p : 4 * p + 4], top[:, p], "s:1", 0, p) for p in range(4)], axis=1) == whole).all()
    assert (B.split_draws(np.concatenate([sizes, np.zeros(16)]), np.full(n, total), "s:1")[:, :16] == whole).all()


def test_weights_repeat_on_any_partitioning(spark):
    rows = [(yr, y, code, 1 + (7 * code + yr) % 5) for yr in (1, 2) for y in range(3) for code in range(90)] + [(3, 0, 0, 4)]
    cells = spark.createDataFrame(rows, "yr int, y int, code_0 long, n long")
    one = {tuple(r) for r in B.tree_weights(cells.coalesce(1), ["yr"], ["y", "code_0"], 20, 9).collect()}
    two = {tuple(r) for r in B.tree_weights(cells.repartition(7), ["yr"], ["y", "code_0"], 20, 9).collect()}
    assert one == two
    sums = {}
    for yr, _, _, rep, w in one:
        sums[yr, rep] = sums.get((yr, rep), 0) + w
    assert sums == {(yr, rep): sum(r[3] for r in rows if r[0] == yr) for yr in (1, 2, 3) for rep in range(20)}


def test_groups_of_texts_are_not_expanded(views):
    from tidemark.operators.duplicates import duplicate_groups

    plan = duplicate_groups(views.reviews)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    empty = duplicate_groups(views.reviews.withColumn("rating", F.lit(None).cast("double")).limit(50)).first()
    assert empty is None or (empty.mean_rating is None and empty.sd_rating is None)
