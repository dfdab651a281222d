"""Hashes of the staged tables are made many at a time; they must be those of the column expressions."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashes import ph_prefixed
from tidemark.functions.keys import composite_key
from tidemark.functions.text import WHITESPACE, text_hash
from tidemark.plans import views as V


def ph(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("keys", [["", "1|2|3", "é" * 20, "x" * 46], ["a" * 32] * 3, ["x" * 54, "x" * 55, "y" * 200], [str(i) for i in range(20_000)], []])
def test_prefixed_hashes(keys):
    prefixes = ["d", "v", "big|early|42|", ""]
    got = ph_prefixed(prefixes, pa.array(["other", *keys], pa.string()).slice(1))
    assert [h.tolist() for h in got] == [[ph(p + k) for k in keys] for p in prefixes]


def test_record_keys_decide_as_the_expressions_do(spark):
    df = spark.range(300).select(F.concat(F.lit("1|"), F.col("id").cast("string")).alias("k")).withColumn("u", V.key_mods("k"))
    same = [(F.col("u")[name] == V.mod(V.pre(tag, F.col("k")), n)).alias(name) for name, tag, n in V.MODS]
    assert df.select(*same).filter(" OR ".join(f"NOT {name}" for name, _, _ in V.MODS)).count() == 0


def test_predictions_are_staged_once_an_item(spark, views):
    rows = views.preds
    key = composite_key("model", "train_set", "seed", "item_id")
    start = F.create_map(*[F.lit(x) for m, t, a, d in V.RUNS for x in (f"{m}|{t}", a)])[composite_key("model", "train_set")]
    slope = F.create_map(*[F.lit(x) for m, t, a, d in V.RUNS for x in (f"{m}|{t}", d)])[composite_key("model", "train_set")]
    right = V.mod(key, 1000) < start + slope * (F.col("yr") - V.TEST_YEARS[0])
    want = F.when(right, F.col("y")).otherwise(F.pmod(F.col("y") + 1 + V.mod(V.pre("e", key), 2), F.lit(3)))
    n_items = views.pool.filter(F.col("yr").between(*V.TEST_YEARS)).count()
    assert rows.count() == len(views.members) * n_items > 0
    assert rows.filter(~want.eqNullSafe(F.col("pred"))).count() == 0
    assert views.stage("preds", views._preds).count() == n_items


def test_text_hash_without_a_run_of_spaces(spark):
    texts = ["One two", " One  two ", "One\ttwo", "One\ntwo\r\n", "\fONE two", "", " ", None, "É ΟΔΟΣ ΟΔΟΣ  İ", "a  b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.md5(F.trim(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), WHITESPACE, " ")))
    assert df.filter(text_hash("t") != old).count() == 0
