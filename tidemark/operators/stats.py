"""Trend regressions on labelled items.

Rows with equal regressors are counted first and enter as frequency weights, so a fit reads
distinct rows, not items.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fits import Z95, grouped_logit, grouped_ols_hc1
from tidemark.session import broadcast_checked, cut


def collapse_rare(df: DataFrame, col: str, min_n: int = 30, name: str = "cat", other: str = "(other)") -> DataFrame:
    """Values seen fewer than min_n times become one value."""
    common = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_n).select(col, F.lit(True).alias("_keep"))
    return df.join(broadcast_checked(common), col, "left").withColumn(name, F.when(F.col("_keep"), F.col(col)).otherwise(other)).drop("_keep")


def quantile_bins(df: DataFrame, col: str, labels: Sequence[str] = ("short", "medium", "long"), name: str = "bin") -> DataFrame:
    """Equal-count bins by cut points, so equal values stay together (right edge inclusive)."""
    k = len(labels)
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_f"))
    cuts = counts.agg(F.percentile(col, F.array(*[F.lit(i / k) for i in range(1, k)]), F.col("_f"))).scalar()
    out = F
    for i in range(1, k):
        out = out.when(F.col(col) <= F.col("_cuts")[i - 1], labels[i - 1])
    return df.withColumn("_cuts", cuts).withColumn(name, out.otherwise(labels[-1])).drop("_cuts")


def logit_trend(df: DataFrame, y: str, x: Sequence[str], factor: str | None = None, max_iter: int = 50) -> DataFrame:
    """Binary logit of y on x with optional category effects: coefficient, error, odds ratio, 95 % interval, p."""
    return grouped_logit(df, y, x, factor, max_iter=max_iter)


def binary_logit(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Logit of y on a 0/1 regressor in closed form from the two-by-two table; null where a cell is empty."""
    at = lambda a, b: F.count_if((F.col(y) == a) & (F.col(x) == b)).cast("double")
    cells = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), at(1, 1).alias("_a"), at(0, 1).alias("_b"), at(1, 0).alias("_c"), at(0, 0).alias("_d")
    )
    a, b, c, d = (F.col(v) for v in ("_a", "_b", "_c", "_d"))
    beta = F.log(F.try_divide(a * d, b * c))
    one = F.lit(1.0)
    se = F.sqrt(F.try_divide(one, a) + F.try_divide(one, b) + F.try_divide(one, c) + F.try_divide(one, d))
    beta = F.when(se.isNotNull(), beta)
    return cells.select(
        *keys,
        "n",
        F.try_divide(c, c + d).alias("share_0"),
        F.try_divide(a, a + b).alias("share_1"),
        beta.alias("b"),
        se.alias("se"),
        F.exp(beta).alias("odds_ratio"),
        F.exp(beta - F.lit(Z95) * se).alias("lo"),
        F.exp(beta + F.lit(Z95) * se).alias("hi"),
    )


def lpm_hc1(df: DataFrame, y: str, x: Sequence[str], factor: str | None = None) -> DataFrame:
    """Linear probability model with HC1 errors: (term, b, se_hc1, p)."""
    return grouped_ols_hc1(df, y, x, factor)


def lpm_hc1_single(df: DataFrame, y: str, x: str) -> DataFrame:
    """The same for one regressor, in closed form: distinct (x, y) pairs, then sums of moments.

    Null slope and error on a constant regressor, null error with two rows or fewer."""
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).groupBy("x", "y").agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )
    w, xx, yy = F.col("w"), F.col("x"), F.col("y")
    pairs = cut(pairs)
    m = pairs.agg(F.struct(F.sum(w).alias("n"), (F.sum(w * xx) / F.sum(w)).alias("x"), (F.sum(w * yy) / F.sum(w)).alias("y"))).scalar()
    centred = pairs.withColumn("_m", m).select("w", (xx - F.col("_m.x")).alias("dx"), (yy - F.col("_m.y")).alias("dy"), "_m.n")
    dx, dy, n = F.col("dx"), F.col("dy"), F.col("n")
    fit = centred.agg(F.struct(F.try_divide(F.sum(w * dx * dy), F.sum(w * dx * dx)).alias("b"), F.sum(w * dx * dx).alias("sxx"))).scalar()
    e = dy - F.col("_f.b") * dx
    out = centred.withColumn("_f", fit).groupBy("n", "_f.b", "_f.sxx").agg(F.sum(w * dx * dx * e * e).alias("meat"))
    return out.select("n", "b", F.sqrt(F.try_divide(F.try_divide(n, n - 2) * F.col("meat"), F.col("sxx") * F.col("sxx"))).alias("se_hc1"))


def stratified_trend(
    df: DataFrame, strata: str, values: Sequence, y: str, x: Sequence[str], factor: str | None = None
) -> DataFrame:
    """The trend inside each named stratum, all of them fitted in one job."""
    fits = grouped_logit(df.filter(F.col(strata).isin(*values)), y, x, factor, [strata])
    return fits.withColumnRenamed(strata, "stratum")


def sensitivity_set(df: DataFrame, variants: dict, x: Sequence[str], factor: str | None = None) -> DataFrame:
    """The trend under several definitions: name -> (row filter or None, outcome column). One job fits all of them.

    A row enters each variant that keeps it; rows with equal regressors are counted before the first round.
    """
    kept = [(F.lit(True) if keep is None else F.coalesce(keep, F.lit(False)), F.struct(F.lit(name).alias("variant"), outcome.cast("int").alias("_out"))) for name, (keep, outcome) in variants.items()]
    each = F.explode(F.array_compact(F.array(*[F.when(keep, value) for keep, value in kept])))
    rows = df.select(*x, *([factor] if factor else []), each.alias("_v")).select(*x, *([factor] if factor else []), "_v.variant", "_v._out")
    return grouped_logit(rows, "_out", x, factor, ["variant"]).filter(F.col("term") == x[0])


def _t_two_sided(t: float, dof: float) -> float:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t) or dof <= 0:
        return float("nan")
    x, a, b = dof / (dof + t * t), dof / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1.0 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d or 1e-300)
    h = d
    for m in range(1, 500):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / ((1.0 + up * d) or 1e-300)
        c = (1.0 + up / c) or 1e-300
        h *= d * c
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + down * d) or 1e-300)
        c = (1.0 + down / c) or 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    tail = front * h
    return 1.0 - tail if flip else tail


def linear_trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares slope with its error and t value per group; null where two points or a perfect line leave no error."""
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.groupBy(*keys).agg(
        F.regr_count(yy, xx).alias("n"), F.regr_slope(yy, xx).alias("slope"), F.regr_sxx(yy, xx).alias("_sxx"),
        F.regr_syy(yy, xx).alias("_syy"), F.regr_sxy(yy, xx).alias("_sxy"),
    )
    rss = F.col("_syy") - F.col("slope") * F.col("_sxy")
    variance = F.try_divide(F.try_divide(rss, F.col("n") - 2), F.col("_sxx"))
    se = F.when(variance >= 0, F.sqrt(variance))
    return s.select(*keys, "n", "slope", se.alias("se"), F.try_divide(F.col("slope"), se).alias("t"))


def linear_trend_p(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """The same with a two-sided p value, computed on the one row per group."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else _t_two_sided(a, b - 2) for a, b in zip(t, n)], dtype="float64")

    return linear_trend(df, keys, x, y).withColumn("p", p_value("t", F.col("n").cast("double")))


def negative_share_by_year_star(labels: DataFrame) -> DataFrame:
    return labels.groupBy("rating_star", "yr").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("majority") == "NEGATIVE").cast("double")).alias("share")
    )
