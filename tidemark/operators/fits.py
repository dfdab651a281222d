"""Grouped regressions: all strata and variants in one job, factor effects absorbed by block elimination.

A fit has a few covariates and, for every level of a factor, an effect of its own. Levels are never columns: each keeps the
sums of its own rows (a scalar block and a vector), which are folded into the covariates' p x p system, so that p counts
covariates only and a factor may have any number of levels. One aggregate by (group, level) and one by group make a round;
every group's small system is solved in the task that holds its row. Nothing but the size of the largest step reaches the
driver. Rows with equal regressors are counted first and enter as frequency weights.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut

Z95 = 1.959963984540054  # Fixed value: normal quantile of a 95 % interval.


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be null."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row: the only group
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def _total(terms: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def _cells(df: DataFrame, y: str, x: Sequence[str], factor: str | None, groups: Sequence[str]) -> DataFrame:
    """(groups, level, y, x0.., w): distinct rows with their number; rows without outcome or covariate are left out."""
    level = F.coalesce(F.col(factor).cast("string"), F.lit("(null)")) if factor else F.lit("")
    cols = [*groups, level.alias("_level"), F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x)]]
    rows = df.select(*cols)
    names = ["_y", *[f"_x{i}" for i in range(len(x))]]
    return rows.dropna(subset=names).groupBy(*groups, "_level", *names).agg(F.count(F.lit(1)).cast("double").alias("_w"))


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _solved(groups: DataFrame, p: int) -> DataFrame:
    """Adds ``_step`` (solution of A step = b) and ``_inv`` (row-major inverse) to rows with arrays ``_a`` (p x p) and ``_b``;
    both null where A is singular."""
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*groups.schema, T.StructField("_step", doubles), T.StructField("_inv", doubles)])

    def run(batches):
        for batch in batches:
            steps, inverses = [], []
            for a, b in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True):
                step = inverse = None
                m = np.array(a, dtype=float).reshape(p, p)
                if np.isfinite(m).all() and np.linalg.cond(m) < 1e13:
                    own = np.linalg.inv(m)
                    inverse, step = own.ravel().tolist(), (own @ np.array(b)).tolist()
                steps.append(step)
                inverses.append(inverse)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(steps, kind), pa.array(inverses, kind)], names=[*batch.schema.names, "_step", "_inv"])

    return groups.mapInArrow(run, schema)


def _square(name: str, p: int) -> Column:
    """Array of a symmetric p x p matrix from its columns on and above the diagonal."""
    return F.array(*[F.col(f"{name}_{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])


def _form(inverse: str, p: int, left: Sequence[Column], right: Sequence[Column]) -> Column:
    """left' * inverse * right."""
    return _total([F.col(inverse)[i * p + j] * left[i] * right[j] for i in range(p) for j in range(p)])


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)) for v in z], dtype="float64")


def _reference(levels: DataFrame, groups: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Each group's first level by name, its columns renamed to ``_ref_*``."""
    first = levels.groupBy(*groups).agg(F.min("_level").alias("_level"))
    own = _join(levels.select(*groups, "_level", *cols), first, [*groups, "_level"])
    return own.withColumnsRenamed({c: f"_ref{c}" for c in ["_level", *cols]})


def grouped_logit(
    df: DataFrame, y: str, x: Sequence[str], factor: str | None = None, groups: Sequence[str] = (), max_iter: int = 50, tol: float = 1e-10
) -> DataFrame:
    """Binary logit of y (0 or 1) on x with optional effects of a factor's levels, in every group at once.

    (groups, term, b, se, odds_ratio, lo, hi, p): the covariates, ``(intercept)`` of the first level by name, and
    ``factor=level`` against it; 95 % intervals and p of the normal law. A level whose outcomes are all alike has no finite
    effect: it takes no part in the fit, is no first level, and has b of plus or minus infinity without an error. A group
    whose covariates depend on each other has null for them. Newton's steps, halved where the likelihood falls; a fit that
    has not converged after ``max_iter`` rounds is returned as it stands. A null level is the level ``(null)``.
    """
    p, groups = len(x), list(groups)
    keys = [*groups, "_level"]
    xs = [F.col(f"_x{i}") for i in range(p)]
    cells = cut(_cells(df, y, x, factor, groups))
    sizes = cut(cells.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_y")).alias("_s")))
    mixed = (F.col("_s") > 0) & (F.col("_s") < F.col("_n"))
    zeros = F.array(*[F.lit(0.0)] * p)
    state = cut(sizes.filter(mixed).select(*keys, F.log(F.col("_s") / (F.col("_n") - F.col("_s"))).alias("_a"), F.lit(0.0).alias("_da"), zeros.alias("_beta"), zeros.alias("_dbeta"), F.lit(None).cast("double").alias("_best")))
    for _ in range(max_iter):
        eta = F.col("_a") + _total([F.col("_beta")[i] * xs[i] for i in range(p)])
        point = _join(cells, state.select(*keys, "_a", "_beta"), keys).withColumn("_eta", eta)
        # Of both forms of the same value the one that cannot overflow.
        small = F.exp(-F.abs(F.col("_eta")))
        mu = F.when(F.col("_eta") >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))
        loss = F.greatest(F.col("_eta"), F.lit(0.0)) + F.log1p(small) - F.col("_y") * F.col("_eta")
        point = point.withColumns({"_h": F.col("_w") * small / ((1.0 + small) * (1.0 + small)), "_r": F.col("_w") * (F.col("_y") - mu), "_l": -F.col("_w") * loss})
        h, r = F.col("_h"), F.col("_r")
        levels = cut(
            point.groupBy(*keys).agg(
                F.sum(h).alias("_S"), F.sum(r).alias("_g"), F.sum("_l").alias("_ll"),
                *[F.sum(h * xs[i]).alias(f"_v_{i}") for i in range(p)], *[F.sum(r * xs[i]).alias(f"_G_{i}") for i in range(p)],
                *[F.sum(h * xs[i] * xs[j]).alias(f"_H_{i}_{j}") for i, j in _pairs(p)],
            )
        )
        v = [F.col(f"_v_{i}") for i in range(p)]
        folded = levels.groupBy(*groups).agg(
            F.sum("_ll").alias("_ll"),
            *[F.sum(F.col(f"_H_{i}_{j}") - F.try_divide(v[i] * v[j], F.col("_S"))).alias(f"_A_{i}_{j}") for i, j in _pairs(p)],
            *[F.sum(F.col(f"_G_{i}") - F.try_divide(v[i] * F.col("_g"), F.col("_S"))).alias(f"_B_{i}") for i in range(p)],
        )
        systems = folded.select(*groups, "_ll", _square("_A", p).alias("_a"), F.array(*[F.col(f"_B_{i}") for i in range(p)]).alias("_b"))
        solved = cut(_solved(systems, p).select(*groups, "_ll", "_step", "_inv"))
        step = F.coalesce("_step", zeros)
        new = _join(_join(state, levels.select(*keys, "_S", "_g", *[f"_v_{i}" for i in range(p)]), keys), solved, groups).withColumn("_step", step)
        worse = F.coalesce(F.col("_ll") < F.col("_best") - 1e-9 * F.abs("_best"), F.lit(False))
        fresh = F.coalesce(F.try_divide(F.col("_g") - _total([v[i] * F.col("_step")[i] for i in range(p)]), F.col("_S")), F.lit(0.0))
        new = new.withColumns({"_worse": worse, "_fresh": fresh})
        # A step that made things worse is taken back by half, then by half of that: ``back`` is minus half of it.
        back = F.lit(-0.5)
        da = F.when(F.col("_worse"), F.col("_da") * back).otherwise(F.col("_fresh"))
        dbeta = F.when(F.col("_worse"), F.transform("_dbeta", lambda d: d * back)).otherwise(F.col("_step"))
        turn = F.when(F.col("_worse"), -1.0).otherwise(1.0)  # what is left of the step points forward again
        new = new.withColumns({"_da": da, "_dbeta": dbeta}).select(
            *keys, (F.col("_a") + F.col("_da")).alias("_a"), (F.col("_da") * turn).alias("_da"),
            F.zip_with("_beta", "_dbeta", lambda a, b: a + b).alias("_beta"), F.transform("_dbeta", lambda d: d * turn).alias("_dbeta"),
            F.when(F.col("_worse"), F.col("_best")).otherwise(F.col("_ll")).alias("_best"),
        )
        state = cut(new)
        far = lambda d, at: F.abs(d) / (1.0 + F.abs(at))
        most = state.agg(F.max(F.greatest(far(F.col("_da"), F.col("_a")), F.array_max(F.zip_with("_dbeta", "_beta", far))))).first()[0]
        if most is None or most < tol:
            break

    level_names = levels.select(*keys, "_S", *[(F.try_divide(F.col(f"_v_{i}"), F.col("_S"))).alias(f"_u_{i}") for i in range(p)])
    level_rows = _join(_join(level_names, state.select(*keys, "_a"), keys), solved.select(*groups, "_inv"), groups)
    us = [f"_u_{i}" for i in range(p)]
    ref = _reference(level_rows.select(*keys, "_a", "_S", *us), groups, ["_a", "_S", *us])
    level_rows = _join(level_rows, ref, groups)
    own, base = [F.col(u) for u in us], [F.col(f"_ref{u}") for u in us]
    apart = [a - b for a, b in zip(own, base, strict=True)]
    is_ref = F.col("_level") == F.col("_ref_level")
    term = F.when(is_ref, "(intercept)").otherwise(F.concat(F.lit(f"{factor}="), "_level"))
    b = F.when(is_ref, F.col("_a")).otherwise(F.col("_a") - F.col("_ref_a"))
    one = F.lit(1.0)
    var = F.when(is_ref, F.try_divide(one, F.col("_S")) + _form("_inv", p, own, own)).otherwise(F.try_divide(one, F.col("_S")) + F.try_divide(one, F.col("_ref_S")) + _form("_inv", p, apart, apart))
    effects = level_rows.select(*groups, term.alias("term"), b.alias("b"), F.sqrt(var).alias("se"))

    betas = state.groupBy(*groups).agg(F.max("_beta").alias("_beta"))
    # Groups of which every level has one outcome only have no covariate effects either.
    if groups:
        every = _join(_join(sizes.select(*groups).distinct(), betas, groups, "left"), solved.select(*groups, "_inv"), groups, "left")
    else:
        every = _only(sizes, betas, solved)
    slots = F.array(*[F.struct(F.lit(c).alias("term"), F.when(F.col("_inv").isNotNull(), F.col("_beta")[i]).alias("b"), F.sqrt(F.col("_inv")[i * p + i]).alias("se")) for i, c in enumerate(x)])
    slopes = every.select(*groups, F.explode(slots).alias("_t")).select(*groups, "_t.*")
    infinite = F.when(F.col("_s") == 0, float("-inf")).otherwise(float("inf"))
    lone = sizes.filter(~mixed).select(*groups, (F.concat(F.lit(f"{factor}="), "_level") if factor else F.lit("(intercept)")).alias("term"), infinite.alias("b"), F.lit(None).cast("double").alias("se"))
    out = slopes.unionByName(effects).unionByName(lone)
    beta, se = F.col("b"), F.col("se")
    return out.select(
        *groups, "term", "b", "se", F.exp(beta).alias("odds_ratio"), F.exp(beta - F.lit(Z95) * se).alias("lo"), F.exp(beta + F.lit(Z95) * se).alias("hi"),
        _normal_p(F.try_divide(beta, se)).alias("p"),
    )


def _only(sizes: DataFrame, betas: DataFrame, solved: DataFrame) -> DataFrame:
    """The one group's coefficients and inverse; nulls where nothing was fitted."""
    one = F.lit(1).alias("_one")
    any_ = sizes.agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 0").select(one)
    return any_.join(betas.select(one, "_beta"), "_one", "left").join(solved.select(one, "_inv"), "_one", "left")


def grouped_ols_hc1(df: DataFrame, y: str, x: Sequence[str], factor: str | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Least squares of y on x with optional effects of a factor's levels and HC1 errors, in every group at once.

    (groups, term, b, se_hc1, p), terms as in ``grouped_logit``; every level takes part. Covariates are centred within their
    level, which leaves slopes and their robust errors as they are with one column a level. Null slopes and errors where
    covariates depend on each other; null errors where no degree of freedom is left.
    """
    p, groups = len(x), list(groups)
    keys = [*groups, "_level"]
    w, yy = F.col("_w"), F.col("_y")
    cells = cut(_cells(df, y, x, factor, groups))
    means = cut(cells.groupBy(*keys).agg(F.sum("_w").alias("_S"), (F.sum(w * yy) / F.sum(w)).alias("_my"), *[(F.sum(w * F.col(f"_x{i}")) / F.sum(w)).alias(f"_m_{i}") for i in range(p)]))
    centred = _join(cells, means, keys).select(*keys, "_w", (yy - F.col("_my")).alias("_dy"), *[(F.col(f"_x{i}") - F.col(f"_m_{i}")).alias(f"_d_{i}") for i in range(p)])
    d = [F.col(f"_d_{i}") for i in range(p)]
    crossed = centred.groupBy(*groups).agg(*[F.sum(w * d[i] * d[j]).alias(f"_A_{i}_{j}") for i, j in _pairs(p)], *[F.sum(w * d[i] * F.col("_dy")).alias(f"_B_{i}") for i in range(p)], F.count(F.lit(1)).alias("_rows")).filter("_rows > 0")
    solved = cut(_solved(crossed.select(*groups, _square("_A", p).alias("_a"), F.array(*[F.col(f"_B_{i}") for i in range(p)]).alias("_b")), p).select(*groups, F.col("_step").alias("_beta"), "_inv"))
    e = F.col("_dy") - _total([F.col("_beta")[i] * d[i] for i in range(p)])
    spread = _join(centred, solved, groups).withColumn("_e2", w * e * e)
    e2 = F.col("_e2")
    levels = cut(
        spread.groupBy(*keys).agg(
            F.sum(w).alias("_S"), F.sum(e2).alias("_q"), *[F.sum(e2 * d[i]).alias(f"_c_{i}") for i in range(p)], *[F.sum(e2 * d[i] * d[j]).alias(f"_M_{i}_{j}") for i, j in _pairs(p)]
        )
    )
    meat = levels.groupBy(*groups).agg(F.sum("_S").alias("_n"), F.count(F.lit(1)).alias("_k"), *[F.sum(f"_M_{i}_{j}").alias(f"_M_{i}_{j}") for i, j in _pairs(p)])
    free = F.col("_n") - p - F.col("_k")
    fitted = _join(solved, meat, groups).withColumns({"_meat": _square("_M", p), "_scale": F.when(free > 0, F.col("_n") / free)})
    inv = lambda i, j: F.col("_inv")[i * p + j]
    cov = [_total([inv(i, a) * F.col("_meat")[a * p + b] * inv(b, j) for a in range(p) for b in range(p)]) for i in range(p) for j in range(p)]
    fitted = cut(fitted.select(*groups, "_beta", "_inv", "_scale", F.array(*cov).alias("_cov")))

    slots = F.array(*[F.struct(F.lit(c).alias("term"), F.col("_beta")[i].alias("b"), (F.col("_scale") * F.col("_cov")[i * p + i]).alias("var")) for i, c in enumerate(x)])
    slopes = fitted.select(*groups, F.explode(slots).alias("_t")).select(*groups, "_t.*")

    cs, ms = [f"_c_{i}" for i in range(p)], [f"_m_{i}" for i in range(p)]
    rows = _join(_join(levels.select(*keys, "_q", *cs), means, keys), fitted, groups)
    alpha = F.col("_my") - _total([F.col("_beta")[i] * F.col(ms[i]) for i in range(p)])
    rows = rows.withColumns({"_alpha": alpha, "_q": F.col("_q") / (F.col("_S") * F.col("_S")), **{c: F.col(c) / F.col("_S") for c in cs}})
    ref = _reference(rows.select(*keys, "_alpha", "_q", *cs, *ms), groups, ["_alpha", "_q", *cs, *ms])
    rows = _join(rows, ref, groups)
    is_ref = F.col("_level") == F.col("_ref_level")
    less = lambda c: F.col(c) - F.when(is_ref, 0.0).otherwise(F.col(f"_ref{c}"))
    rows = rows.withColumns({"_b": less("_alpha"), **{f"_z{c}": less(c) for c in [*cs, *ms]}, "_zq": F.col("_q") + F.when(is_ref, 0.0).otherwise(F.col("_ref_q"))})
    dm, dc = [F.col(f"_z{c}") for c in ms], [F.col(f"_z{c}") for c in cs]
    var = F.col("_scale") * (F.col("_zq") + _form("_cov", p, dm, dm) - 2.0 * _form("_inv", p, dm, dc))
    term = F.when(is_ref, "(intercept)").otherwise(F.concat(F.lit(f"{factor}="), "_level"))
    out = slopes.unionByName(rows.select(*groups, term.alias("term"), F.col("_b").alias("b"), var.alias("var")))
    se = F.when(F.col("var") >= 0, F.sqrt("var"))
    out = out.select(*groups, "term", "b", se.alias("se_hc1"))
    return out.withColumn("p", F.when(F.col("se_hc1") > 0, _normal_p(F.try_divide("b", "se_hc1"))).when(F.col("se_hc1") == 0, 0.0))
