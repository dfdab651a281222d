"""Train/test splits and the named samples drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import in_tenths
from tidemark.operators.sampling import bottom_n


def split_by_key(df: DataFrame, key: str, train_tenths: int = 8, name: str = "is_train") -> DataFrame:
    """Random split when ``key`` is a row id, grouped split when it is a product or user."""
    return df.withColumn(name, in_tenths(key, train_tenths))


def split_temporal(
    df: DataFrame, train_years: tuple[int, int], test_years: tuple[int, int], year_col: str = "yr", name: str = "set"
) -> DataFrame:
    """Disjoint year ranges; rows in neither are dropped."""
    yr = F.col(year_col)
    inside = df.filter(yr.between(*train_years) | yr.between(*test_years))
    return inside.withColumn(name, F.when(yr.between(*train_years), "train").otherwise("test"))


def train_rows(pool: DataFrame, train_years: tuple[int, int], id_col: str = "item_id") -> DataFrame:
    return pool.filter(F.col("yr").between(*train_years) & in_tenths(id_col))


def class_prior(df: DataFrame, y: str = "y") -> DataFrame:
    """(y, n, prior). The window sees one row per class."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def period_tests(
    pool: DataFrame,
    n: int,
    train_years: tuple[int, int],
    test_years: tuple[int, int],
    seed: int,
    id_col: str = "item_id",
) -> DataFrame:
    """Same-period holdout and one natural sample per later year, all in one pass over the pool."""
    yr = F.col("yr")
    held_out = yr.between(*train_years) & ~in_tenths(id_col)
    name = F.when(held_out, F.lit(f"test_{train_years[0]}-{train_years[1]}_holdout")).when(
        yr.between(*test_years), F.concat(F.lit("test_"), yr.cast("string"), F.lit("_natural"))
    )
    rows = pool.withColumn("sample", name).filter("sample IS NOT NULL")
    return bottom_n(rows, id_col, n, seed, ["sample"], test_years[1] - test_years[0] + 2)


def matched_tests(
    pool: DataFrame,
    prior: DataFrame,
    n: int,
    test_years: tuple[int, int],
    seed: int,
    id_col: str = "item_id",
    n_classes: int = 3,
) -> DataFrame:
    """Per year, each class in the proportion it has in training: quota round(n * prior)."""
    years = F.array(*[F.lit(yr) for yr in range(test_years[0], test_years[1] + 1)])
    quotas = prior.select(F.explode(years).alias("yr"), "y", F.round(F.col("prior") * n).cast("long").alias("quota"))
    bound = n_classes * (test_years[1] - test_years[0] + 1)
    rows = pool.filter(F.col("yr").between(*test_years))
    order_seed = F.lit(seed) + F.col("y")
    picked = bottom_n(rows, id_col, quotas, order_seed, ["yr", "y"], bound)
    return picked.withColumn("sample", F.concat(F.lit("test_"), F.col("yr").cast("string"), F.lit("_matched")))


def train_excluding(
    pool: DataFrame, tests: DataFrame, years: tuple[int, int], n: int, seed: int, id_col: str = "item_id"
) -> DataFrame:
    """A later-period training sample that shares no item with any test sample."""
    rows = pool.filter(F.col("yr").between(*years)).join(tests.select(id_col), id_col, "left_anti")
    return bottom_n(rows, id_col, n, seed)


def overlap_count(sample: DataFrame, tests: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Rows of a sample and how many of them also sit in a test sample."""
    seen = tests.select(id_col).distinct().withColumn("_seen", F.lit(1))
    return sample.join(seen, id_col, "left").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_seen"), F.lit(0)).cast("long").alias("overlap")
    )


def stack_samples(**named: DataFrame) -> DataFrame:
    """Long (sample, item) table from named frames that lack a sample column."""
    out = None
    for name, df in named.items():
        part = df if "sample" in df.columns else df.withColumn("sample", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def temporal_samples(
    pool: DataFrame,
    train_years: tuple[int, int],
    test_years: tuple[int, int],
    n_train: int,
    n_test: int,
    train_seed: int = 42,
    test_seed: int = 7,
    columns: Sequence[str] = ("item_id", "yr", "y"),
) -> DataFrame:
    """The sample design: a training sample, and the fixed holdout, natural and prior-matched tests."""
    cols = ["sample", *columns]
    base = pool.select(*columns)
    train_all = train_rows(base, train_years)
    train = bottom_n(train_all, "item_id", n_train, train_seed).withColumn("sample", F.lit(f"train_seed{train_seed}"))
    natural = period_tests(base, n_test, train_years, test_years, test_seed)
    matched = matched_tests(base, class_prior(train_all), n_test, test_years, test_seed)
    return train.select(*cols).unionByName(natural.select(*cols)).unionByName(matched.select(*cols))
