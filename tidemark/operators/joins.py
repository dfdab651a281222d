"""Joins that name what they are for. Dimensions are made unique first, so no join can fan out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import epoch_month, epoch_year
from tidemark.operators.winners import best_rows, split_repeated
from tidemark.session import cut, touched_rows


def dedup_dimension(dim: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key: the smallest tuple of the wanted columns."""
    return dim.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("_v")).select(*keys, *[f"_v.{c}" for c in cols])


def coverage(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Share of fact rows whose key exists in the dimension. Facts are counted per key before the join."""
    per_key = fact.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = dim.select(key).distinct().withColumn("_hit", F.lit(1))
    return per_key.join(known, key, "left").agg(
        (F.sum(F.col("_n") * F.coalesce("_hit", F.lit(0))) / F.sum("_n")).alias("ratio")
    )


def semi(df: DataFrame, ids: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return df.join(ids, [keys] if isinstance(keys, str) else list(keys), "left_semi")


def anti(df: DataFrame, ids: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """NOT IN without its null trap."""
    return df.join(ids, [keys] if isinstance(keys, str) else list(keys), "left_anti")


def attach(df: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str], how: str = "left") -> DataFrame:
    """Bring in columns of another table, which is reduced to one row per key."""
    return df.join(dedup_dimension(right, keys, cols), list(keys), how)


def annotate_key(key: DataFrame, reviews: DataFrame, meta: DataFrame) -> DataFrame:
    """Text-typed sample keys back to their record, then to the product category."""
    from tidemark.operators.profile import array_element

    wanted = key.select("asin").distinct()
    rows = semi(reviews, wanted, "asin").select(
        "user_id", "asin", F.col("ts").cast("string").alias("ts"), "parent_asin", "verified_purchase", "helpful_vote"
    )
    with_rows = attach(key, rows, ["user_id", "asin", "ts"], ["parent_asin", "verified_purchase", "helpful_vote"])
    dim = dedup_dimension(meta, ["parent_asin"], ["main_category", "categories"]).select(
        "parent_asin",
        "main_category",
        array_element("categories", 2).alias("cat_l1"),
        array_element("categories", 3).alias("cat_l2"),
    )
    return with_rows.join(dim, "parent_asin", "left")


def recover_timestamp(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Earliest raw timestamp with the item's user, product, text and year."""
    keys = ["user_id", "parent_asin", "text_hash", "yr"]
    raw = reviews.select("user_id", "parent_asin", "text_hash", epoch_year("ts").alias("yr"), "ts")
    earliest = raw.groupBy(*keys).agg(F.min("ts").alias("ts"))  # a record copied many times is one row here
    return items.select("item_id", *keys).join(earliest, keys).select("item_id", "ts", epoch_month("ts").alias("month"))


PUBLIC_KEY = ["user_id", "parent_asin", "text_hash"]


def candidate_lists(items: DataFrame, reviews: DataFrame, part_rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(key_id, item_id) and (key_id, part, n, candidates): all valid raw rows that share an item's key, once for each key.

    A key with k items and m rows is k + m values here and k x m rows when joined. Keys of more than ``part_rows`` rows are
    dealt over several lists by a hash of the row, so no list, and no task that makes one, grows with a key. ``candidates`` is
    an array of (asin, ts, rating, n): equal rows are one entry with their number.
    """
    named = cut(items.select("item_id", *PUBLIC_KEY).withColumn("key_id", F.md5(F.concat_ws("|", *PUBLIC_KEY))))
    wanted = named.select("key_id", *PUBLIC_KEY).distinct()
    valid = touched_rows(reviews.filter(F.col("rating").between(1, 5)).select(*PUBLIC_KEY, "asin", "ts", "rating"), wanted, PUBLIC_KEY)
    raw = valid.groupBy(*PUBLIC_KEY, "asin", "ts", "rating").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(raw.join(wanted, PUBLIC_KEY).select("key_id", "asin", "ts", "rating", "n"))
    parts = rows.groupBy("key_id").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")).filter("parts > 1")
    dealt = rows.join(parts, "key_id", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("asin", "ts", "rating"), F.col("parts")).cast("int"), F.lit(0)))
    lists = dealt.groupBy("key_id", "part").agg(F.sum("n").alias("n"), F.collect_list(F.struct("asin", "ts", "rating", "n")).alias("candidates"))
    return named.select("key_id", "item_id"), lists


def expand_candidates(keys: DataFrame, lists: DataFrame) -> DataFrame:
    """(item_id, asin, ts, rating) for every item and candidate row, for those who need k x m rows."""
    each = keys.join(lists, "key_id").select("item_id", F.explode("candidates").alias("c"))
    return each.select("item_id", "c.asin", "c.ts", "c.rating", F.explode(F.sequence(F.lit(1), F.col("c.n").cast("int"))).alias("_i")).drop("_i")


def candidate_rows(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """All valid raw rows that share an item's key."""
    return expand_candidates(*candidate_lists(items, reviews))


def lookup(df: DataFrame, table: dict, key: str, name: str, default=None) -> DataFrame:
    """Values of a small Python table as a column, without a join."""
    from tidemark.functions.labels import recode

    return df.withColumn(name, recode(key, table, default))


def ratio_of_counts(a: DataFrame, b: DataFrame, name: str = "ratio") -> DataFrame:
    """count(a) / count(b) with the second count as a scalar subquery; null if b is empty."""
    other = b.agg(F.count(F.lit(1))).scalar()
    return a.agg(F.count(F.lit(1)).alias("n_a")).withColumn("n_b", other).withColumn(name, F.try_divide("n_a", "n_b"))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the one that comes last in the given order. Rows of lone keys are neither shuffled nor sorted."""
    return best_rows(df, keys, order)


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def same_sets(a: DataFrame, b: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """(by, n, same) for every group of either frame: its distinct keys in both, and whether the two sets are equal."""
    sides = a.select(*by, key, F.lit(1).alias("_s")).unionByName(b.select(*by, key, F.lit(2).alias("_s")))
    met = sides.groupBy(*by, key).agg(F.bit_or("_s").alias("_m"))
    return met.groupBy(*by).agg(F.count_if(F.col("_m") == 3).alias("n"), F.bool_and(F.col("_m") == 3).alias("same"))


def same_set(a: DataFrame, b: DataFrame, key: str = "item_id") -> DataFrame:
    """One row: do both frames hold the same distinct keys?"""
    left = a.select(key).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).distinct().withColumn("_b", F.lit(1))
    lone = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    return left.join(right, key, "full").agg((lone == 0).alias("same"))


def pair_counts(items: DataFrame, pair: Sequence[str], label: str) -> DataFrame:
    """Items with ``n_pair`` and ``n_pair_label``: how many items share their pair, and their pair and label.

    Two joins by USING: the counts by pair and label take the counts by pair, the items take both. An item whose pair surely
    occurs once passes as it is; only the others are shuffled. Items with a null in these columns are left out; without a
    label they still count for their pair.
    """
    lone, repeated = split_repeated(items.select("item_id", *pair, label).dropna(subset=list(pair)), pair)
    by_label = repeated.groupBy(*pair, label).agg(F.count(F.lit(1)).alias("n_pair_label"))
    by_pair = repeated.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_pair"))
    counted = repeated.join(by_label.join(by_pair, list(pair)), [*pair, label])
    once = lone.dropna(subset=[label]).withColumns({"n_pair_label": F.lit(1).cast("long"), "n_pair": F.lit(1).cast("long")})
    return once.unionByName(counted)
