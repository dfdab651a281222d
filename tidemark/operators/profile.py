"""Counts, shares and quantiles that describe a labelled table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import array_element
from tidemark.operators.joins import dedup_dimension
from tidemark.session import cut


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def pct_of_total(df: DataFrame, n: str = "n", name: str = "pct") -> DataFrame:
    """Percent of the grand total of a grouped result with few rows: the window saves a second pass over the input."""
    return df.withColumn(name, F.lit(100.0) * F.col(n) / F.sum(n).over(Window.partitionBy(F.lit(0))))


def share_in_partition(df: DataFrame, part: Sequence[str], n: str = "n", name: str = "share") -> DataFrame:
    return df.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy(*part)))


def basic_profile(reviews: DataFrame, min_len: int = 50, approximate: bool = False) -> DataFrame:
    """One row: sizes, distinct keys, verified share, years, empty and short texts."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return reviews.agg(
        F.count(F.lit(1)).alias("n_reviews"),
        distinct(F.col("user_id")).alias("n_users"),
        distinct(F.col("asin")).alias("n_asin"),
        distinct(F.col("parent_asin")).alias("n_parent_asin"),
        _share(F.col("verified_purchase")).alias("verified_ratio"),
        F.min("yr").alias("year_min"),
        F.max("yr").alias("year_max"),
        F.count_if(F.col("text_len") == 0).alias("n_empty_text"),
        F.count_if(F.col("text_len") < min_len).alias("n_short_text"),
    )


def rating_distribution(reviews: DataFrame) -> DataFrame:
    return pct_of_total(reviews.groupBy("rating").agg(_n())).orderBy("rating")


def profile_by_year(reviews: DataFrame) -> DataFrame:
    return (
        reviews.groupBy("yr")
        .agg(_n(), F.avg("rating").alias("mean_rating"), _share(F.col("verified_purchase")).alias("verified_ratio"))
        .orderBy("yr")
    )


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles from value counts.

    Counting equal values first leaves one row per (key, value), so a key that owns a third
    of the table costs its distinct values, not its rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_f"))
    names = list(probs)
    out = counts.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(p) for p in probs.values()]), F.col("_f")).alias("_q"))
    return out.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def length_by_rating(reviews: DataFrame, approximate: bool = False) -> DataFrame:
    """Count, length quantiles and mean helpful votes per rating."""
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    levels = F.array(*[F.lit(p) for p in probs.values()])
    if approximate:
        out = reviews.groupBy("rating").agg(
            _n(), F.percentile_approx("text_len", levels, 10_000).alias("_q"), F.avg("helpful_vote").alias("mean_helpful")
        )
    else:
        counts = reviews.groupBy("rating", "text_len").agg(
            F.count(F.lit(1)).alias("_f"), F.sum("helpful_vote").alias("_h"), F.count("helpful_vote").alias("_hn")
        )
        out = counts.groupBy("rating").agg(
            F.sum("_f").alias("n"),
            F.percentile("text_len", levels, F.col("_f")).alias("_q"),
            (F.sum("_h") / F.sum("_hn")).alias("mean_helpful"),
        )
    quantiles = [F.col("_q")[i].cast("double").alias(name) for i, name in enumerate(probs)]
    return out.select("rating", "n", *quantiles, "mean_helpful").orderBy("rating")


def top_categories(meta: DataFrame, k: int = 40, col: str = "main_category") -> DataFrame:
    return meta.groupBy(col).agg(_n()).orderBy(F.desc("n"), col).limit(k)


def label_by_year(pool: DataFrame) -> DataFrame:
    """Class shares and median length per year."""
    names = ("neg", "neu", "pos")
    counts = pool.groupBy("yr", "text_len").agg(
        F.count(F.lit(1)).alias("_f"), *[F.count_if(F.col("y") == c).alias(f"_{n}") for c, n in enumerate(names)]
    )
    return (
        counts.groupBy("yr")
        .agg(
            F.sum("_f").alias("n"),
            *[(F.sum(f"_{n}") / F.sum("_f")).alias(n) for n in names],
            F.percentile("text_len", F.lit(0.5), F.col("_f")).alias("median_len"),
        )
        .orderBy("yr")
    )


def balanced_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """(y, n, prior, weight) with weight = n / (k * n_class)."""
    classes = Window.partitionBy(F.lit(0))  # one row per class
    total, k = F.sum("n").over(classes), F.count(F.lit(1)).over(classes)
    return df.groupBy(y).agg(_n()).select(
        y, "n", (F.col("n") / total).alias("prior"), (total / (k * F.col("n"))).alias("weight")
    )


def class_shares(df: DataFrame, keys: Sequence[str], y: str = "y", prefix: str = "") -> DataFrame:
    return df.groupBy(*keys).agg(
        _n(),
        *[_share(F.col(y) == c).alias(prefix + name) for c, name in ((0, "neg"), (1, "neu"), (2, "pos"))],
    )


def category_dimension(meta: DataFrame, level: int = 2, name: str = "cat_l1") -> DataFrame:
    """(parent_asin, category): one row per product, a level of its category path."""
    return dedup_dimension(meta, ["parent_asin"], ["categories"]).select(
        "parent_asin", array_element("categories", level).alias(name)
    )


def _with_dim(rows: DataFrame, dim: DataFrame, name: str) -> DataFrame:
    joined = rows.join(dim, "parent_asin", "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit("(none)")))


def with_category(rows: DataFrame, meta: DataFrame, level: int = 2, name: str = "cat_l1") -> DataFrame:
    """Category path level per row, '(none)' when the product or the level is missing."""
    return _with_dim(rows, category_dimension(meta, level, name), name)


def count_by_category(
    rows: DataFrame, keys: Sequence[str], meta: DataFrame, name: str = "cat_l1", max_rows: int = 1_000_000,
    opened: tuple[Sequence[str], Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """(keys, category, n). A product table of checked size is broadcast to the rows; a larger one is
    joined to counts per product, so that a product owning a third of the rows joins as a few rows.

    ``opened`` holds other keys to count by and a function that makes them, several rows of one if need be, from rows that
    already know their category: what a row is opened into is neither joined nor moved.
    """
    by, open_rows = opened or (keys, lambda df: df)
    dim = cut(category_dimension(meta, name=name))
    if dim.count() <= max_rows:
        joined = _with_dim(rows.select(*keys, "parent_asin"), F.broadcast(dim), name)
        return open_rows(joined).groupBy(*by, name).agg(_n())
    per_product = rows.groupBy(*keys, "parent_asin").agg(_n())
    # Hashed, not sorted: the dimension has one row per product, so its parts are small.
    joined = _with_dim(per_product, dim.hint("shuffle_hash"), name)
    return open_rows(joined).groupBy(*by, name).agg(F.sum("n").alias("n"))


def fold_rest(df: DataFrame, col: str, k: int, name: str = "cat", other: str = "(other)") -> DataFrame:
    """Keep the k most frequent values, fold the rest. The broadcast side is k rows."""
    top = df.groupBy(col).agg(_n()).orderBy(F.desc("n"), col).limit(k).select(col, F.lit(True).alias("_top"))
    return df.join(F.broadcast(top), col, "left").withColumn(
        name, F.when(F.col("_top"), F.col(col)).otherwise(F.lit(other))
    ).drop("_top")


def category_year_counts(pool: DataFrame, meta: DataFrame, k: int = 15) -> DataFrame:
    """(yr, cat, n, n_neg, n_neu). Counts per (year, class, category) are written once; the fold works on them."""
    cells = cut(count_by_category(pool, ["yr", "y"], meta))
    top = (
        cells.groupBy("cat_l1").agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), "cat_l1").limit(k)
        .select("cat_l1", F.lit(True).alias("_top"))
    )
    of_class = lambda c: F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0))
    return (
        cells.join(F.broadcast(top), "cat_l1", "left")
        .groupBy("yr", F.when(F.col("_top"), F.col("cat_l1")).otherwise(F.lit("(other)")).alias("cat"))
        .agg(F.sum("n").alias("n"), of_class(0).alias("n_neg"), of_class(1).alias("n_neu"))
    )


def category_share_by_year(pool: DataFrame, meta: DataFrame, k: int = 15) -> DataFrame:
    cells = category_year_counts(pool, meta, k).select("yr", "cat", "n")
    return share_in_partition(cells, ["yr"]).orderBy("yr", F.desc("n"), "cat")


def class_share_by_category_year(pool: DataFrame, meta: DataFrame, k: int = 15) -> DataFrame:
    n = F.col("n")
    return (
        category_year_counts(pool, meta, k)
        .select("yr", "cat", "n", (F.col("n_neu") / n).alias("neu_share"), (F.col("n_neg") / n).alias("neg_share"))
        .orderBy("yr", "cat")
    )


def dissimilarity(shares: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Half the summed absolute share difference between two years, for each pair."""
    years = sorted({y for p in pairs for y in p})
    wide = shares.groupBy("cat").agg(
        *[F.coalesce(F.sum(F.when(F.col("yr") == y, F.col("share"))), F.lit(0.0)).alias(f"s{y}") for y in years]
    )
    gaps = wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("y0"), F.lit(b).alias("y1"), F.abs(F.col(f"s{a}") - F.col(f"s{b}")).alias("gap")
                    )
                    for a, b in pairs
                ]
            )
        ).alias("g")
    )
    return gaps.groupBy("g.y0", "g.y1").agg((F.lit(0.5) * F.sum("g.gap")).alias("dissimilarity"))


def membership_summary(samples: DataFrame) -> DataFrame:
    """Rows, distinct samples, and items that sit in both a train and a test sample."""
    is_train = F.col("sample").startswith("train")
    per_item = samples.groupBy("item_id").agg(
        _n(),
        F.max(is_train.cast("int")).alias("_tr"),
        F.max((~is_train).cast("int")).alias("_te"),
    )
    overlap = per_item.agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.col("_tr") * F.col("_te")), F.lit(0)).cast("long").alias("overlap")
    )
    names = samples.agg(F.count_distinct("sample")).scalar()
    return overlap.select("n", names.alias("n_samples"), "overlap")


def match_rate(left: DataFrame, matched: DataFrame, key: str = "item_id") -> DataFrame:
    """How many distinct left keys found a match; the rate is null if there are none."""
    hit = matched.select(key).distinct().withColumn("_hit", F.lit(1))
    return left.select(key).distinct().join(hit, key, "left").agg(
        _n(), F.coalesce(F.sum("_hit"), F.lit(0)).cast("long").alias("n_matched")
    ).withColumn("rate", F.try_divide("n_matched", "n"))


def crosstab_normalized(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Row-normalised shares, one column per value."""
    return df.groupBy(row).agg(_n(), *[_share(F.col(col) == v).alias(v) for v in values])


def mean_by_group(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(_n(), F.avg(value.cast("double")).alias(name))


def seed_summary(metrics: DataFrame, keys: Sequence[str], value: str = "macro_f1") -> DataFrame:
    """Mean and sample deviation of a metric across seeds."""
    return metrics.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n_seeds")
    )


def margins(df: DataFrame, row: str = "yr", col: str = "y") -> DataFrame:
    """Counts with row, column and grand totals (null marks a total)."""
    return df.cube(row, col).agg(_n())


def majority_class(df: DataFrame, y: str = "y") -> DataFrame:
    """Most frequent label, the lowest one on a tie."""
    return df.groupBy(y).agg(_n()).orderBy(F.desc("n"), y).limit(1).select(y)
