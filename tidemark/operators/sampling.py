"""Exact, repeatable sampling by hash order, without a global sort.

Rows are ordered by ``seeded_ph(seed, id)``. The hash range is cut into 2**bits equal
buckets; one aggregation counts rows per bucket, a running sum over those few counts tells
which buckets lie wholly inside the sample and which one holds the cut, and only sampled
rows are shuffled and ranked. The result equals ORDER BY hash LIMIT n, but no task ever
holds more than one bucket of one stratum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import PH_BITS, seeded_hex, seeded_ph

DEFAULT_BITS = 12
BROADCAST_ROWS = 1_000_000


def _with_bucket(df: DataFrame, id_col: str, seed: int | str | Column, bits: int) -> DataFrame:
    """``_h`` holds the hash as hex digits of one width, which sort as the numbers do and need no conversion; so do the leading
    digits, which are the bucket unless its bits end inside a digit."""
    hashed = df.withColumn("_h", seeded_hex(seed, id_col))
    if bits % 4 == 0:
        return hashed.withColumn("_b", F.substring("_h", 1, bits // 4))
    return hashed.withColumn("_b", F.shiftright(F.conv("_h", 16, 10).cast("long"), PH_BITS - bits))


def _offsets(bucketed: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows per (stratum, bucket) and the number of rows in all earlier buckets of the stratum."""
    counts = bucketed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    part = [F.col(s) for s in strata] or [F.lit(0)]
    earlier = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")))


def _hashed(bucketed: DataFrame) -> DataFrame:
    """Rows without a hash get a bucket that no row has: a join would test a bucket that may be null in front of it, and with
    that hash every row twice."""
    none = F.lit("none") if bucketed.schema["_b"].dataType.simpleString() == "string" else F.lit(-1)
    return bucketed.withColumn("_b", F.coalesce("_b", none))


def _small(df: DataFrame, n_strata: int | None, bits: int) -> DataFrame:
    """Broadcast only when strata x buckets proves the table small; otherwise the planner decides."""
    if n_strata is not None and n_strata * (1 << bits) <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def bottom_n(
    df: DataFrame,
    id_col: str,
    n: int | DataFrame,
    seed: int | str | Column,
    strata: Sequence[str] = (),
    n_strata: int | None = None,
    bits: int = DEFAULT_BITS,
) -> DataFrame:
    """The ``n`` rows per stratum that come first in hash order; all rows of a stratum with fewer.

    ``n`` is one number or a table (strata columns, ``quota``). ``n_strata`` is an upper bound on
    the number of strata, if the caller knows one. Strata columns must not be null.
    """
    strata = list(strata)
    if not strata:
        n_strata = 1
    bucketed = _with_bucket(df, id_col, seed, bits)
    offsets = _offsets(bucketed, strata)
    if isinstance(n, DataFrame):
        quotas = F.broadcast(n) if n_strata is not None and n_strata <= BROADCAST_ROWS else n
        offsets = offsets.join(quotas, strata)
    else:
        offsets = offsets.withColumn("quota", F.lit(n))
    cut = offsets.filter("_before < quota").select(*strata, "_b", (F.col("quota") - F.col("_before")).alias("_need"))
    rank = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", id_col))
    return (
        _hashed(bucketed).join(_small(cut, n_strata, bits), [*strata, "_b"])
        .withColumn("_rank", rank)
        .filter("_rank <= _need")
        .select(*df.columns)
    )


def dense_index(
    df: DataFrame,
    id_col: str,
    seed: int | str | Column,
    name: str,
    groups: Sequence[str] = (),
    n_groups: int | None = None,
    bits: int = DEFAULT_BITS,
) -> DataFrame:
    """Adds 0..n-1 in hash order within each group: a row number without a single-task window."""
    groups = list(groups)
    if not groups:
        n_groups = 1
    bucketed = _with_bucket(df, id_col, seed, bits)
    offsets = _small(_offsets(bucketed, groups).drop("_n"), n_groups, bits)
    rank = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h", id_col))
    return (
        _hashed(bucketed).join(offsets, [*groups, "_b"])
        .withColumn(name, (F.col("_before") + rank - 1).cast("long"))
        .select(*df.columns, name)
    )


def sample_n(df: DataFrame, n: int, seed: int, id_col: str = "item_id") -> DataFrame:
    return bottom_n(df, id_col, n, seed)


def head_n(df: DataFrame, n: int, seed: int, id_col: str = "item_id") -> DataFrame:
    """'First n rows' with the order made explicit."""
    return bottom_n(df, id_col, n, seed)


def hash_shuffle(df: DataFrame, seed: int, id_col: str = "item_id") -> DataFrame:
    """A repeatable shuffle: range-partitioned and sorted by hash."""
    return df.orderBy(seeded_ph(seed, id_col), id_col)


def seed_subsamples(df: DataFrame, n: int, seeds: Sequence[int], id_col: str = "item_id") -> DataFrame:
    """(seed, item) with n items per seed, all seeds drawn from the same rows in one pass."""
    seeded = df.select(F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"), F.col(id_col))
    return bottom_n(seeded, id_col, n, F.col("seed"), ["seed"], len(seeds))


def paired_subset_sample(
    samples: DataFrame, n: int, seed: int, sample_col: str = "sample", id_col: str = "item_id", n_samples: int | None = None
) -> DataFrame:
    """A fixed number of items from every named sample, for a second model to score."""
    return bottom_n(samples, id_col, n, seed, [sample_col], n_samples)


def stratified_sample(
    df: DataFrame,
    per_value: Mapping[int, int],
    years: tuple[int, int],
    seed: int,
    value_col: str = "rating_star",
    year_col: str = "yr",
    key_col: str = "item_key",
    unique_on: Sequence[str] = ("user_id", "asin", "ts"),
    fmt: str = "R%05d",
) -> DataFrame:
    """ceil(n / years) rows per (value, year), one row per unique key, numbered in shuffled order."""
    first, last = years
    n_years = last - first + 1
    rows = df.filter(F.col(value_col).isin(*per_value) & F.col(year_col).between(first, last))
    kinds = [df.schema[c].dataType.simpleString() for c in (value_col, year_col)]
    quotas = df.sparkSession.createDataFrame(
        [(v, yr, -(-n // n_years)) for v, n in per_value.items() for yr in range(first, last + 1)],
        f"{value_col} {kinds[0]}, {year_col} {kinds[1]}, quota long",
    )
    picked = bottom_n(rows, key_col, quotas, seed, [value_col, year_col], len(per_value) * n_years)
    first_of_key = Window.partitionBy(*unique_on).orderBy(seeded_ph(seed, key_col), key_col)
    unique = picked.withColumn("_r", F.row_number().over(first_of_key)).filter("_r = 1").drop("_r")
    return surrogate_ids(unique, key_col, f"shuffle{seed}", fmt)


def surrogate_ids(df: DataFrame, key_col: str, seed: int | str, fmt: str = "R%05d", name: str = "item_id") -> DataFrame:
    """Zero-padded running ids in shuffled order."""
    numbered = dense_index(df, key_col, seed, "_i")
    return numbered.withColumn(name, F.format_string(fmt, F.col("_i"))).drop("_i")


def blind_split(df: DataFrame, text_cols: Sequence[str], key_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The text-only table raters see, and the key table that stays hidden."""
    return df.select(*text_cols), df.select(*key_cols)
