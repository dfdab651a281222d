"""Duplicate records, duplicate texts and the deduplicated pool.

Everything here groups with partial aggregation, so a text or record that makes up a third of
the table is folded on the map side before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.functions import labels as L
from tidemark.functions import text as X
from tidemark.functions.time import epoch_month, epoch_year, in_years
from tidemark.operators.profile import pct_of_total
from tidemark.operators.winners import split_repeated
from tidemark.session import cut, touched_rows

RECORD = ("user_id", "asin", "ts", "text_hash")


def normalise_reviews(raw: DataFrame) -> DataFrame:
    """Raw records to the analysis columns: renamed time, image count, text hash and length, year."""
    return raw.select(
        *(["item_key"] if "item_key" in raw.columns else []),
        "rating",
        "title",
        "text",
        "asin",
        "parent_asin",
        "user_id",
        F.col("timestamp").alias("ts"),
        "helpful_vote",
        "verified_purchase",
        F.coalesce(F.size("images"), F.lit(0)).alias("n_images"),
        X.text_hash("text").alias("text_hash"),
        X.text_len("text").alias("text_len"),
        epoch_year("timestamp").alias("yr"),
    )


def rating_sd(rating: str = "rating") -> Column:
    """Population deviation from sums. Star ratings are whole numbers, so the sums are exact and a
    group whose deviation is exactly 1 never lands below 1 by a rounding error. Null without ratings."""
    r, n = F.col(rating), F.count(rating).cast("double")
    return F.sqrt(F.try_divide(n * F.sum(r * r) - F.sum(r) * F.sum(r), n * n))


def duplicate_groups(reviews: DataFrame, min_len: int = 50) -> DataFrame:
    """Per text: rows, users, products, variants, rating mean and spread, length. Nulls are not counted as values.

    A text that occurs once, as nearly all do, is its own group and is not shuffled. For the others every counted column
    is made distinct by (text, value) on its own, where copies fold in the map tasks, and only those counts are joined: no
    row is copied once per counted column.
    """
    keys = {"n_users": "user_id", "n_parent": "parent_asin", "n_asin": "asin"}
    rows = reviews.filter(F.col("text_len") >= min_len).select("text_hash", *keys.values(), "rating", "text_len")
    lone, repeated = split_repeated(rows, ["text_hash"])
    known = lambda c: F.col(c).isNotNull().cast("long")
    single = lone.select(
        "text_hash", F.lit(1).cast("long").alias("n_rows"), *[known(c).alias(n) for n, c in keys.items()],
        F.col("rating").cast("double").alias("mean_rating"), F.when(F.col("rating").isNotNull(), F.lit(0.0)).alias("sd_rating"), F.col("text_len").alias("len"),
    )
    out = repeated.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("rating").alias("mean_rating"), rating_sd().alias("sd_rating"), F.min("text_len").alias("len"))
    for n, c in keys.items():
        pairs = repeated.filter(F.col(c).isNotNull()).groupBy("text_hash", c).agg(F.lit(1).alias("_one"))
        out = out.join(pairs.groupBy("text_hash").agg(F.count(F.lit(1)).alias(n)), "text_hash", "left").withColumn(n, F.coalesce(n, F.lit(0).cast("long")))
    return single.unionByName(out.select(single.columns))


def text_sharing(reviews: DataFrame, min_len: int = 50) -> DataFrame:
    """(text_hash, n_rows, n_users, n_parent) with the last two as none (0), one (1) or several (2); nulls don't count.

    Telling one from several needs only the smallest and largest 64-bit hash, which a hash aggregate holds: no row is
    copied and no string compared. Two different values pass for one if their hashes agree, with odds of 2^-64 a pair.
    """
    several = lambda lo, hi: F.when(F.col(lo).isNull(), 0).when(F.col(lo) == F.col(hi), 1).otherwise(2)
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    ends = (
        reviews.filter(F.col("text_len") >= min_len)
        .groupBy("text_hash")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min(hashed("user_id")).alias("_u0"),
            F.max(hashed("user_id")).alias("_u1"),
            F.min(hashed("parent_asin")).alias("_p0"),
            F.max(hashed("parent_asin")).alias("_p1"),
        )
    )
    return ends.select("text_hash", "n_rows", several("_u0", "_u1").alias("n_users"), several("_p0", "_p1").alias("n_parent"))


def _rollup(groups: DataFrame, label, name: str) -> DataFrame:
    return groups.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_rows"))


def duplicate_types(groups: DataFrame) -> DataFrame:
    """Groups and rows per kind of sharing, from ``text_sharing`` or ``duplicate_groups``."""
    rolled = _rollup(groups, L.dup_type("n_rows", "n_users", "n_parent"), "dup_type")
    return pct_of_total(rolled, "n_rows", "pct_rows").orderBy("dup_type")


def duplicate_group_sizes(reviews: DataFrame, min_len: int = 50, edges: Sequence[int] = (1, 5, 20, 100)) -> DataFrame:
    """Group sizes need only counts, so this skips the distinct users and products."""
    sizes = reviews.filter(F.col("text_len") >= min_len).groupBy("text_hash").agg(F.count(F.lit(1)).alias("n_rows"))
    order = F.min("n_rows").alias("_lo")
    rolled = sizes.groupBy(L.group_size("n_rows", edges).alias("group_size")).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_rows"), order
    )
    return rolled.orderBy("_lo").drop("_lo")


def duplicate_rating_agreement(reviews: DataFrame, min_len: int = 50) -> DataFrame:
    spread = (
        reviews.filter(F.col("text_len") >= min_len)
        .groupBy("text_hash")
        .agg(F.count(F.lit(1)).alias("n_rows"), rating_sd().alias("sd_rating"))
        .filter("n_rows > 1")
    )
    return _rollup(spread, L.rating_agreement("sd_rating"), "rating_agreement")


def variant_shared_groups(reviews: DataFrame, min_len: int = 50) -> DataFrame:
    """Same user, time and text listed more than once."""
    sizes = (
        reviews.filter(F.col("text_len") >= min_len).groupBy("user_id", "ts", "text_hash").agg(F.count(F.lit(1)).alias("k"))
    )
    return sizes.filter("k > 1").agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"))


def top_duplicate_groups(reviews: DataFrame, min_len: int = 50, n: int = 300, chars: int = 300) -> DataFrame:
    """The largest groups with an example text: n rows come back, so the detail join broadcasts them."""
    order = [F.desc("n_rows"), F.col("text_hash")]
    top = (
        reviews.filter(F.col("text_len") >= min_len).groupBy("text_hash").agg(F.count(F.lit(1)).alias("n_rows"))
        .filter("n_rows > 1").orderBy(*order).limit(n).select("text_hash")
    )
    rows = reviews.filter(F.col("text_len") >= min_len).join(F.broadcast(top), "text_hash", "left_semi")
    example = rows.groupBy("text_hash").agg(X.preview(F.min("text"), chars).alias("text_preview"))
    details = duplicate_groups(rows, min_len).drop("len")
    return details.join(example, "text_hash").orderBy(*order)


def exact_record_duplicates(reviews: DataFrame) -> DataFrame:
    """Groups, rows and redundant rows of records repeated in full."""
    sizes = reviews.groupBy(*RECORD).agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    zero = F.lit(0)
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum("k"), zero).alias("n_rows_in_groups"),
        F.coalesce(F.sum(F.col("k") - 1), zero).alias("n_redundant_rows"),
    )


def dedup_pool(reviews: DataFrame, first_year: int = 2013, last_year: int = 2023, carry: Sequence[str] = (), texts: bool = True) -> DataFrame:
    """One row per record, the most helpful copy, for valid ratings, texts and years.

    Without ``texts`` the columns text, verified_purchase and text_len are left out; all others are the same, as these three
    break ties only after them.

    Records that occur once, nearly all of them, pass without a shuffle or sort of their texts. Of the others the winner is
    found by an aggregate, not a ranking window: copies are combined before the shuffle, so a record repeated a billion
    times is still one row per map task.
    """
    if carry and not texts:
        raise ValueError("carried columns are chosen after texts")
    payload = ["rating", "parent_asin", *(["text", "text_len", "verified_purchase"] if texts else []), *carry]
    rank = F.struct("helpful_vote", "rating", "parent_asin", *(["text", "verified_purchase", *carry, "text_len"] if texts else []))
    valid = reviews.filter(F.col("rating").between(1, 5) & (F.col("text_len") > 0) & in_years("ts", first_year, last_year))
    wanted = [*RECORD, "helpful_vote", *payload]
    lone, repeated = split_repeated(valid.select(wanted), RECORD)
    best = repeated.groupBy(*RECORD).agg(F.max(rank).alias("_v")).select(*RECORD, *[f"_v.{c}" for c in wanted[len(RECORD) :]])
    return lone.unionByName(best).select(
        K.item_id(*RECORD).alias("item_id"),
        *wanted,
        epoch_year("ts").alias("yr"),
        epoch_month("ts").alias("month"),
        L.rating_to_label(F.col("rating")).alias("y"),
    )


def match_keys(rows: DataFrame, min_len: int = 50, keep: Sequence[str] = (), prefix: int = 120) -> DataFrame:
    """Exact, loose and prefix match keys per row. Loose texts travel as digests, not as text."""
    with_loose = rows.filter(F.col("text_len") >= min_len).withColumn("_loose", X.loose_norm("text"))
    return with_loose.select(
        *keep,
        F.col("text_hash").alias("exact"),
        F.md5("_loose").alias("loose"),
        F.md5(X.prefix_key("_loose", prefix)).alias("prefix"),
        F.length("_loose").alias("loose_len"),
    )


def distinct_match_keys(keys: DataFrame) -> DataFrame:
    """Rows and distinct keys per level.

    Keys nest (equal exact keys have equal loose keys, equal loose keys equal prefixes), so the
    table is reduced to distinct triples before the three counts.
    """
    triples = keys.groupBy("exact", "loose", "prefix").agg(F.count(F.lit(1)).alias("_n"))
    return triples.agg(
        F.sum("_n").alias("n_rows"),
        F.count_distinct("exact").alias("exact"),
        F.count_distinct("loose").alias("loose"),
        F.count_distinct("prefix").alias("prefix"),
    )


def _loose_groups(keys: DataFrame) -> DataFrame:
    """Groups of more than one exact text: their smallest and largest 64-bit hash differ (equal by chance: 2^-64 a pair)."""
    h = F.xxhash64("exact")
    variants = keys.groupBy("loose").agg(F.count(F.lit(1)).alias("n_rows"), F.min(h).alias("_lo"), F.max(h).alias("_hi"))
    return variants.filter("_lo <> _hi").select("loose", "n_rows")


def loose_only_totals(keys: DataFrame) -> DataFrame:
    """Loose groups that hold more than one exact text: how many groups and rows."""
    return _loose_groups(keys).agg(
        F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")
    )


def loose_only_groups(rows: DataFrame, min_len: int = 50, n: int = 200, chars: int = 250) -> DataFrame:
    """The largest such groups with an example; the n winners are broadcast back to their rows."""
    long_rows = rows.filter(F.col("text_len") >= min_len).withColumn("loose", F.md5(X.loose_norm("text")))
    keyed = long_rows.withColumnRenamed("text_hash", "exact")
    top = _loose_groups(keyed).orderBy(F.desc("n_rows"), "loose").limit(n).select("loose")
    return (
        keyed.join(F.broadcast(top), "loose", "left_semi")
        .groupBy("loose")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("exact").alias("n_exact_variants"),
            F.count_distinct("user_id").alias("n_users"),
            F.count_distinct("parent_asin").alias("n_parent"),
            X.preview(F.min("text"), chars).alias("example"),
        )
        .orderBy(F.desc("n_rows"), "loose")
    )


PUBLIC_KEY = ("user_id", "parent_asin", "text_hash")


def public_keys(pool: DataFrame, samples: DataFrame) -> DataFrame:
    """Public key, year and label name of every sampled item."""
    return pool.join(samples.select("item_id").distinct(), "item_id", "left_semi").select(
        "item_id", *PUBLIC_KEY, "yr", L.decode_class("y").alias("label")
    )


def key_uniqueness(pool: DataFrame, samples: DataFrame) -> DataFrame:
    """Key groups, repeated groups and their rows, and how many sampled rows they touch."""
    sampled = samples.select("item_id").distinct().withColumn("_s", F.lit(1))
    per_key = (
        pool.select("item_id", *PUBLIC_KEY).join(sampled, "item_id", "left").groupBy(*PUBLIC_KEY)
        .agg(F.count(F.lit(1)).alias("k"), F.count("_s").alias("s"))
    )
    dup = F.col("k") > 1
    return per_key.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(dup).alias("n_dup_keys"),
        F.sum(F.when(dup, F.col("k")).otherwise(0)).alias("n_rows"),
        F.sum(F.when(dup, F.col("s")).otherwise(0)).alias("n_sampled_rows"),
    )


def nonunique_items(pool: DataFrame, samples: DataFrame) -> DataFrame:
    """Sampled items whose public key repeats: rows with the key, and rows with key and label.

    Only rows of the touched keys are counted, and they are counted per (key, label) before the join, so a key with very
    many rows crosses the network as one row per map task. The sampled items are written once.
    """
    ids = samples.select("item_id").distinct()
    items = cut(pool.select("item_id", *PUBLIC_KEY, "y").join(ids, "item_id", "left_semi"))
    touched = items.select(*PUBLIC_KEY).distinct()
    rows = touched_rows(pool.select(*PUBLIC_KEY, "y"), touched, list(PUBLIC_KEY))
    counted = rows.groupBy(*PUBLIC_KEY, "y").agg(F.count(F.lit(1)).alias("n_key_and_label"))
    by_label = counted.join(touched, list(PUBLIC_KEY), "left_semi")
    by_key = by_label.groupBy(*PUBLIC_KEY).agg(F.sum("n_key_and_label").alias("n_key")).filter("n_key > 1")
    return (
        items.join(by_key, list(PUBLIC_KEY)).join(by_label, [*PUBLIC_KEY, "y"])
        .select("item_id", *PUBLIC_KEY, "y", "n_key", "n_key_and_label")
    )


def nonunique_summary(items: DataFrame) -> DataFrame:
    one = F.count_if(F.col("n_key_and_label") == 1)
    n = F.count(F.lit(1))
    return items.agg(n.alias("n_items"), one.alias("unique_with_label"), (n - one).alias("still_ambiguous"))
