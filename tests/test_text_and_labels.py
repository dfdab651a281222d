"""Column functions on edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.functions import labels as L
from tidemark.functions import text as X
from tidemark.functions import time as TM


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first().o


def test_ph_is_md5_prefix(spark):
    assert one(spark, "abc", K.ph) == int(hashlib.md5(b"abc").hexdigest()[:15], 16) == 648541476951500027


@pytest.mark.parametrize("a,b", [("Hello  World", " hello\n\tworld "), (None, ""), ("A\r\nB", "a b")])
def test_text_hash_ignores_case_and_space(spark, a, b):
    assert one(spark, a, X.text_hash) == one(spark, b, X.text_hash)


@pytest.mark.parametrize("raw,want", [("<b>Hi</b>, it's 5!", "hi it s"), (None, ""), ("123", ""), ("ÄBC", "bc")])
def test_loose_norm(spark, raw, want):
    assert one(spark, raw, X.loose_norm) == want


@pytest.mark.parametrize(
    "raw,label",
    [
        ('{"label": "positive", "reason": "x"}', "POSITIVE"),
        ('<think>{"label": "MIXED"}\n</think>{"label": "NEGATIVE"}', "NEGATIVE"),
        ('{"label": "MIXED"} and {"label": " neutral "}', "NEUTRAL"),
        ('{"label": "MIXED"} and {"label": "OTHER"}', "MIXED"),
        ('{"label": "MIXED"} and {broken', "MIXED"),
        ("{label: MIXED}", None),
        (None, None),
        ("", None),
    ],
)
def test_parse_label_reply(spark, raw, label):
    got = one(spark, raw, X.parse_label_reply)
    assert (got.label if got else None) == label


@pytest.mark.parametrize(
    "text,want",
    [("ok", True), ("this is a very good cable", True), ("el producto es muy bueno para la casa", False), ("der Artikel ist nicht gut", False), (None, True)],
)
def test_language_flag(spark, text, want):
    assert one(spark, text, X.language_flag) is want


@pytest.mark.parametrize(
    "text,want",
    [("Great but it broke", "MIXED"), ("I LOVE it", "POSITIVE"), ("it is not here", "NEGATIVE"), ("blue", "NEUTRAL"), (None, "NEUTRAL")],
)
def test_keyword_annotator(spark, text, want):
    assert one(spark, text, X.keyword_annotator) == want


@pytest.mark.parametrize(
    "pols,want",
    [([], None), (["conflict"], "MIXED"), (["positive", "negative"], "MIXED"), (["neutral", "neutral"], "NEUTRAL"),
     (["neutral", "positive"], "POSITIVE"), (["neutral", "negative"], "NEGATIVE"), (None, None)],
)
def test_aspect_gold(spark, pols, want):
    assert one(spark, pols, L.aspect_gold, "array<string>") == want


def test_tokenize(spark):
    assert one(spark, "A big-dog, a CAT", X.tokenize_words) == ["big", "dog", "cat", "big dog", "dog cat"]
    assert one(spark, "solo", X.tokenize_words) == ["solo"]
    assert one(spark, "", X.tokenize_words) == []


@pytest.mark.parametrize("r,y", [(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 2), (5.0, 2)])
def test_rating_to_label(spark, r, y):
    assert one(spark, r, L.rating_to_label, "double") == y


def test_year_boundary_is_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Taipei")
    try:
        assert one(spark, 946684799999, TM.epoch_year, "long") == 1999
        assert one(spark, 946684800000, TM.epoch_year, "long") == 2000
        assert one(spark, -1, TM.epoch_year, "long") == 1969
        assert one(spark, 946684799999, TM.epoch_month, "long") == 12
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_array_element(spark):
    f = lambda c: L.array_element(c, 2)
    assert one(spark, ["a"], f, "array<string>") == "(none)"
    assert one(spark, ["a", ""], f, "array<string>") == "(none)"
    assert one(spark, ["a", "b"], f, "array<string>") == "b"
    assert one(spark, None, f, "array<string>") == "(none)"


def test_first_largest_probability_wins(spark):
    d = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.1, 0.2, 0.7)], "p_neg double, p_neu double, p_pos double")
    assert [r.o for r in d.select(L.pred_from_probs(["p_neg", "p_neu", "p_pos"]).alias("o")).collect()] == [0, 1, 2]


def test_registered_models_run_with_the_operators_defaults(monkeypatch):
    """No smaller vocabulary, hash width or iteration count than the functions' own."""
    import inspect
    from unittest.mock import MagicMock

    import catalog
    from catalog import registry
    from tidemark.operators import features, models

    catalog.load()
    used = {}

    def record(module, name):
        signature = inspect.signature(getattr(module, name))

        def call(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            used[name] = bound.arguments
            return MagicMock()

        monkeypatch.setattr(module, name, call)
        return {k: p.default for k, p in signature.parameters.items()}

    own = {n: record(features, n) for n in ("tfidf_terms", "tfidf_vectors")} | {n: record(models, n) for n in ("text_classifier", "hashed_full_pool_model", "length_model")}
    for name in ("indexed_terms",):
        monkeypatch.setattr(features, name, MagicMock())
    for name in ("score_predictions", "score_hashed"):
        monkeypatch.setattr(models, name, MagicMock())
    monkeypatch.setattr("pyspark.sql.functions.lit", MagicMock())
    monkeypatch.setattr("tidemark.operators.metrics.class_f1", MagicMock())
    views = MagicMock()
    views.doc_samples.return_value = (MagicMock(), MagicMock())
    for name in ("ML2_length_model", "ML5_hashed_full_pool", "ML6_score_predictions"):
        registry.QUERIES[name](views)
    assert used["length_model"]["max_iter"] == own["length_model"]["max_iter"]
    assert used["text_classifier"]["max_iter"] == own["text_classifier"]["max_iter"]
    assert used["tfidf_terms"]["max_terms"] == used["tfidf_vectors"]["size"] == own["tfidf_terms"]["max_terms"]
    for k in ("bits", "max_iter"):
        assert used["hashed_full_pool_model"][k] == own["hashed_full_pool_model"][k]
