"""Winners, cuts and candidate lists without sorting what need not be sorted."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import duplicates as DU
from tidemark.operators import features as FT
from tidemark.operators import joins as J
from tidemark.operators import raters as R
from tidemark.operators import winners as W


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [100_000, 3])
def test_largest_n_equals_order_by_limit(spark, small):
    rng = random.Random(1)
    words = {"".join(rng.choice("abé\U0001f642") for _ in range(rng.randint(0, 6))) for _ in range(400)}
    rows = [(w, rng.choice([1, 1, 1, 2, 5, 5, 900, 10**12 + rng.randint(0, 3)]), "x") for w in sorted(words)] + [("null", None, "x")]
    frame = spark.createDataFrame(rows, "term string, cf long, more string").repartition(5)
    want = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0].encode()))
    for n in (0, 1, 7, 60, 150, len(want) - 1, len(want), 10**6):
        got = W.largest_n(frame, n, "cf", "term", small)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want[:n])
        assert "TakeOrderedAndProject" not in plan(got)
    assert W.largest_n(frame.limit(0), 3, "cf", "term").count() == 0


def test_best_rows_leave_lone_keys_alone(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b"]), rng.randint(0, 400), rng.randint(0, 9), f"text {i}") for i in range(900)] + [("hot", 1, i, "t") for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, l int, n int, text string").repartition(6)
    best = {}
    for k, l, n, text in rows:
        best[k, l] = max(best.get((k, l), (-1, "")), (n, text))
    got = {(r.k, r.l): (r.n, r.text) for r in W.best_rows(frame, ["k", "l"], ["n", "text"]).collect()}
    assert got == best
    lone, repeated = W.split_repeated(frame, ["k", "l"])
    counts = collections.Counter(r[:2] for r in rows)
    assert all(counts[r.k, r.l] == 1 for r in lone.collect())
    assert lone.count() + repeated.count() == len(rows) and lone.count() > 0.9 * sum(n == 1 for n in counts.values())
    assert W.best_rows(frame.limit(0), ["k", "l"], ["n"]).count() == 0


def test_lone_records_are_neither_shuffled_nor_sorted(views, tmp_path):
    lone, _ = W.split_repeated(views.reviews, DU.RECORD)
    own = plan(lone)
    assert "SortAggregate" not in own and "Sort [" not in own and "SortMergeJoin" not in own
    # The one exchange is that of the broadcast words: no text is in it.
    assert all("text" not in line for line in own.splitlines() if "Exchange" in line)


def test_hash_aggregates_only(views, spark):
    keys = DU.match_keys(views.reviews, keep=["user_id"])
    rated = views.raters
    for df in (DU.text_sharing(views.reviews), DU.loose_only_totals(keys), R.rater_patterns(rated, ["rater_a", "rater_b"])):
        assert "SortAggregate" not in plan(df) and "HashAggregate" in plan(df)
    docs = views.doc_samples()[0]
    assert "TakeOrderedAndProject" not in plan(FT.tfidf_terms(docs, 1, 50))


def test_sharing_without_users(spark):
    rows = [("a" * 60, None, "p"), ("a" * 60, None, "q"), ("b" * 60, "u", None), ("b" * 60, None, None), ("c" * 60, "u", "p"), ("c" * 60, "v", "p")]
    frame = spark.createDataFrame([(t, 60, u, p) for t, u, p in rows], "text_hash string, text_len int, user_id string, parent_asin string")
    got = {r.text_hash[0]: (r.n_rows, r.n_users, r.n_parent) for r in DU.text_sharing(frame).collect()}
    assert got == {"a": (2, 0, 2), "b": (2, 1, 0), "c": (2, 2, 1)}


def test_candidates_of_a_hot_key(spark):
    items = spark.range(100_000).select(F.col("id").cast("string").alias("item_id"), F.lit("u").alias("user_id"), F.lit("p").alias("parent_asin"), F.lit("t").alias("text_hash"))
    items = items.unionByName(spark.createDataFrame([("x", "v", "p", "t"), ("y", "v", "p", "t")], items.schema))
    raw = spark.range(100_000).select(F.lit("u").alias("user_id"), F.lit("p").alias("parent_asin"), F.lit("t").alias("text_hash"), F.lit("a").alias("asin"), F.col("id").alias("ts"), F.lit(5.0).alias("rating"))
    few = spark.createDataFrame([("v", "p", "t", "a", 1, 2.0), ("v", "p", "t", "a", 1, 2.0), ("v", "p", "t", "b", 1, 0.0), ("w", "p", "t", "b", 1, 3.0)], raw.schema)
    keys, lists = J.candidate_lists(items, raw.unionByName(few))
    lists = lists.cache()
    assert keys.count() == 100_002 and lists.agg(F.sum("n")).first()[0] == 100_002
    assert lists.agg(F.max(F.size("candidates"))).first()[0] < 12_000
    pair = J.expand_candidates(keys.filter("item_id in ('x', 'y')"), lists)
    assert sorted(tuple(r) for r in pair.collect()) == [("x", "a", 1, 2.0)] * 2 + [("y", "a", 1, 2.0)] * 2


def test_subsets_by_mask(spark):
    rows = [(i, r, lab) for i, labs in enumerate([("POSITIVE", "POSITIVE"), ("NEGATIVE", "MIXED"), ("UNCLEAR", "UNCLEAR"), ("POSITIVE", None)]) for r, lab in zip("ab", labs) if lab]
    labels = spark.createDataFrame(rows, "item_id long, rater string, label string")
    items = spark.createDataFrame([(0, "early"), (2, None)], "item_id long, period string")
    subsets = {"all": F.lit(True), "same": F.col("a") == F.col("b"), "early": F.col("period") == "early", "none": F.lit(False)}
    got = {r.subset: (r.n, r.agreement) for r in R.agreement_subsets(labels, ["a", "b"], subsets, items).collect()}
    assert got == {"all": (3, pytest.approx(2 / 3)), "same": (2, 1.0), "early": (1, 1.0)}
    with pytest.raises(Exception, match="unknown label"):
        R.cohen_kappa(spark.createDataFrame([(1, "a", "odd"), (1, "b", "POSITIVE")], labels.schema), ["a", "b"]).collect()
