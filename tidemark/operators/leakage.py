"""How much of a test side was already seen in training.

The seen/unseen question is answered per key, not per row: one aggregation counts train and
test rows of every key under every split at once, and a key leaks its test rows when it has a
train row. No join, one scan, and hot keys are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import composite_key, in_tenths


def seen_in_train(df: DataFrame, is_train: Column, key: str) -> DataFrame:
    """One row: test rows, test rows whose key occurs in train, percent (null without test rows)."""
    per_key = df.groupBy(key).agg(F.count_if(is_train).alias("_tr"), F.count_if(~is_train).alias("_te"))
    seen = F.when(F.col("_tr") > 0, F.col("_te")).otherwise(0)
    out = per_key.agg(F.sum("_te").alias("n_test"), F.sum(seen).alias("n_leak"))
    return out.withColumn("leak_pct", F.try_divide(F.lit(100.0) * F.col("n_leak"), F.col("n_test")))


def leakage_matrix(keys: DataFrame, splits: Mapping[str, Column], matches: Sequence[str]) -> DataFrame:
    """(split, match, n_test, n_leak, leak_pct) for every split under every match level."""
    names = list(splits)
    flagged = keys.select(*matches, *[splits[s].alias(f"_t{i}") for i, s in enumerate(names)])
    unpivoted = flagged.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("match"), F.col(m).alias("key")) for m in matches])).alias("m"),
        *[f"_t{i}" for i in range(len(names))],
    )
    counts = []
    for i in range(len(names)):
        counts += [F.count_if(F.col(f"_t{i}")).alias(f"_tr{i}"), F.count_if(~F.col(f"_t{i}")).alias(f"_te{i}")]
    per_key = unpivoted.groupBy("m.match", "m.key").agg(*counts)
    sums = []
    for i in range(len(names)):
        seen = F.when(F.col(f"_tr{i}") > 0, F.col(f"_te{i}")).otherwise(0)
        sums += [F.sum(f"_te{i}").alias(f"_n{i}"), F.sum(seen).alias(f"_l{i}")]
    wide = per_key.groupBy("match").agg(*sums)
    long = wide.select(
        "match",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("split"), F.col(f"_n{i}").alias("n_test"), F.col(f"_l{i}").alias("n_leak")
                    )
                    for i, s in enumerate(names)
                ]
            )
        ).alias("s"),
    )
    return long.select(
        "s.split", "match", "s.n_test", "s.n_leak", F.try_divide(F.lit(100.0) * F.col("s.n_leak"), F.col("s.n_test")).alias("leak_pct")
    )


def standard_splits(row_key: Column | str) -> dict[str, Column]:
    """By row, by product, by user."""
    return {
        "random_row": in_tenths(row_key),
        "group_parent_asin": in_tenths("parent_asin"),
        "group_user": in_tenths("user_id"),
    }


def leakage_exact(reviews: DataFrame, min_len: int = 50) -> DataFrame:
    """Exact-text leakage. The row key is built from the record, so exact copies stay on one side."""
    rows = reviews.filter(F.col("text_len") >= min_len)
    return leakage_matrix(rows, standard_splits(composite_key("user_id", "ts", "asin")), ["text_hash"]).drop("match")


def sampled_leakage(train: DataFrame, test: DataFrame) -> DataFrame:
    """Shares of sampled test rows whose text, and whose user, occur in the sampled train rows."""


    def seen(key: str) -> DataFrame:
        per_key = test.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        known = train.select(key).distinct().withColumn("_k", F.lit(1))
        hits = F.sum(F.when(F.col("_k").isNotNull(), F.col("_n")).otherwise(0))
        return per_key.join(known, key, "left").agg(F.sum("_n").alias("n_test"), (hits / F.sum("_n")).alias("share"))

    users = seen("user_id").select("share").scalar()
    return seen("text_hash").select("n_test", F.col("share").alias("text_leak"), users.alias("user_seen"))


def item_overlap_flags(items: DataFrame, membership: Mapping[str, DataFrame], id_col: str = "item_id") -> DataFrame:
    """One boolean per named id set, from a single join: the sets are stacked and folded per item first."""
    stacked = None
    for name, ids in membership.items():
        part = ids.select(id_col, F.lit(name).alias("_set"))
        stacked = part if stacked is None else stacked.unionByName(part)
    flags = stacked.groupBy(id_col).agg(*[F.max(F.col("_set") == n).alias(n) for n in membership])
    out = items.join(flags, id_col, "left")
    for n in membership:
        out = out.withColumn(n, F.coalesce(F.col(n), F.lit(False)))
    return out
