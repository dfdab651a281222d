"""Grouped regressions against Spark's own fit, dense least squares and closed cases."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from tidemark.operators import fits as X


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(1500):
        x, z, cat, g = rng.randrange(8), rng.random(), rng.choice("uvwq"), rng.choice(["A", "B", None])
        p = 1 / (1 + math.exp(-(-1 + 0.25 * x - 0.4 * z + (0.5 if cat == "v" else 0) + (0.7 if g == "A" else 0))))
        rows.append((x, z, cat, g, int(rng.random() < p)))
    rows += [(i % 8, 0.5, "none", "A", 0) for i in range(20)] + [(i % 8, 0.1 * i, "all", "B", 1) for i in range(9)]
    rows += [(i % 5, float(i % 5), "u", "twin", i % 2) for i in range(40)] + [(1, 0.3, "u", "one", 1), (None, 0.5, "u", "A", 1)]
    return spark.createDataFrame(rows, "x int, z double, cat string, g string, y int").cache()


def spark_fit(rows):
    rows = StringIndexer(inputCol="cat", outputCol="i", stringOrderType="alphabetDesc").fit(rows).transform(rows)
    rows = OneHotEncoder(inputCol="i", outputCol="v", dropLast=True).fit(rows).transform(rows)
    model = GeneralizedLinearRegression(family="binomial", labelCol="y", featuresCol="f", maxIter=50, tol=1e-12).fit(VectorAssembler(inputCols=["x", "z", "v"], outputCol="f").transform(rows))
    return dict(zip(["x", "z", "cat=w", "cat=v", "cat=u", "(intercept)"], zip([*model.coefficients, model.intercept], model.summary.coefficientStandardErrors, model.summary.pValues)))


def test_groups_equal_single_fits(data):
    got = {(r.g, r.term): r for r in X.grouped_logit(data, "y", ["x", "z"], "cat", ["g"]).collect()}
    for g in ("A", "B", None):
        rows = data.filter(F.col("g").eqNullSafe(F.lit(g)) & F.col("x").isNotNull() & F.col("cat").isin(*"uvwq"))
        for term, (b, se, p) in spark_fit(rows).items():
            r = got[g, term]
            assert (r.b, r.se, r.p) == (pytest.approx(b, rel=1e-6, abs=1e-9), pytest.approx(se, rel=1e-6), pytest.approx(p, rel=1e-4, abs=1e-9))
            assert r.odds_ratio == pytest.approx(math.exp(b)) and r.lo < r.odds_ratio < r.hi
    # Levels of one outcome stand apart, dependent covariates have no estimate.
    assert got["A", "cat=none"].b == -math.inf and got["B", "cat=all"].b == math.inf and got["A", "cat=none"].se is None
    assert got["twin", "x"].b is None and got["twin", "z"].p is None
    assert got["one", "x"].b is None and got["one", "cat=u"].b == math.inf


def test_least_squares_equal_the_dense_fit(data):
    got = {(r.g, r.term): r for r in X.grouped_ols_hc1(data, "y", ["x", "z"], "cat", ["g"]).collect()}
    for g in ("A", "B", None):
        rows = [r for r in data.collect() if r.g == g and r.x is not None]
        levels = sorted({r.cat for r in rows})
        m = np.array([[1.0, r.x, r.z, *(float(r.cat == c) for c in levels[1:])] for r in rows])
        y = np.array([float(r.y) for r in rows])
        inv = np.linalg.inv(m.T @ m)
        beta = inv @ m.T @ y
        e = y - m @ beta
        se = np.sqrt(np.diag(inv @ (m.T * e**2) @ m @ inv) * len(y) / (len(y) - m.shape[1]))
        for term, b, s in zip(["(intercept)", "x", "z", *(f"cat={c}" for c in levels[1:])], beta, se, strict=True):
            r = got[g, term]
            assert (r.b, r.se_hc1) == (pytest.approx(b), pytest.approx(s)) and r.p == pytest.approx(math.erfc(abs(b / s) / math.sqrt(2)), abs=1e-12)


def test_very_many_levels_meet_the_score_equations(spark):
    """100,000 levels of four rows: residuals of the fit sum to zero over every level and against x."""
    rows = spark.range(400_000).select((F.col("id") % 100_000).cast("string").alias("cat"), (F.floor(F.col("id") / 100_000) % 2).alias("x"), "id")
    rows = rows.withColumn("y", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 < 0.35 + 0.3 * F.col("x")).cast("int"))
    fit = X.grouped_logit(rows, "y", ["x"], "cat").cache()
    slope = fit.filter("term = 'x'").first().b
    first = fit.filter("term = '(intercept)'").first().b
    effects = fit.filter(F.col("term").startswith("cat=") & ~F.col("b").isin(math.inf, -math.inf)).select(F.substring("term", 5, 20).alias("cat"), "b")
    resid = F.col("y") - 1 / (1 + F.exp(-(F.col("b") + first + slope * F.col("x"))))
    left = rows.join(effects, "cat").withColumn("r", resid)
    worst, n = left.groupBy("cat").agg(F.sum("r").alias("r")).agg(F.max(F.abs("r")), F.count(F.lit(1))).first()
    assert n > 60_000 and worst < 1e-6 and abs(left.agg(F.sum(F.col("r") * F.col("x"))).first()[0]) < 2  # less the two rows of the first level
    ols = {r.term: r for r in X.grouped_ols_hc1(rows, "y", ["x"], "cat").filter("term = 'x'").collect()}["x"]
    share = {r.x: r.m for r in rows.groupBy("x").agg(F.avg("y").alias("m")).collect()}
    assert ols.b == pytest.approx(share[1] - share[0]) and 0 < ols.se_hc1 < 0.01


def test_empty_and_unusable_tables(spark):
    none = spark.createDataFrame([], "x int, cat string, g string, y int")
    for f in (X.grouped_logit, X.grouped_ols_hc1):
        assert f(none, "y", ["x"], "cat").count() == 0 and f(none, "y", ["x"], "cat", ["g"]).count() == 0
    same = spark.createDataFrame([(1, "u", 1), (2, "u", 1)], "x int, cat string, y int")
    got = {r.term: r for r in X.grouped_logit(same, "y", ["x"]).collect()}
    assert got["(intercept)"].b == math.inf and got["x"].b is None
