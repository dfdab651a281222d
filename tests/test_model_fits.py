"""Fits move one vector of coefficients per core and step, whatever the number of partitions, and no coefficients without a term."""

import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import functions as F

from tidemark.functions.text import tokenize_words, word_tokens
from tidemark.operators import features as FT
from tidemark.operators import models as ML

WORDS = ("bad broken awful", "okay fine average", "great good lovely")


@pytest.fixture()
def fitted_on(monkeypatch):
    """Number of partitions of everything a logistic regression is fitted on."""
    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, rows, *a: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows, *a))
    return seen


def texts(spark, n):
    words = F.array(*[F.lit(w) for w in WORDS])[(F.col("doc_id") % 3).cast("int")]
    return spark.range(0, n, 1, 40).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("y")).withColumn("text", words)


def test_text_classifier_fits_a_partition_a_core_over_the_terms_there_are(spark, fitted_on):
    docs = texts(spark, 120)
    terms = FT.indexed_terms(FT.tfidf_terms(docs, 5, 1_000_000))
    vectors = FT.tfidf_vectors(docs, terms, 1_000_000)
    assert {r.features.size for r in vectors.collect()} == {terms.count()} == {15}
    model = ML.text_classifier(vectors.repartition(40), 20, labels=docs)
    cores = spark.sparkContext.defaultParallelism
    assert fitted_on and max(fitted_on) <= cores < 40 and model.numFeatures == 15
    got = ML.score_predictions(model, vectors).collect()
    assert len(got) == 120 and all(r.pred == r.y for r in got)


def test_hashed_model_fits_a_partition_a_core(spark, fitted_on):
    docs = texts(spark, 120).repartition(40)
    model = ML.hashed_full_pool_model(docs, bits=10, max_iter=5)
    assert fitted_on and max(fitted_on) <= spark.sparkContext.defaultParallelism
    assert all(r.pred == r.y for r in ML.score_hashed(model, docs).collect())


def test_no_terms_and_no_texts_still_give_vectors(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "one word", 2)], "doc_id long, text string, y int")
    vectors = FT.tfidf_vectors(docs, FT.indexed_terms(FT.tfidf_terms(docs, 5, 100)), 100)
    assert {(r.features.size, r.features.numNonzeros()) for r in vectors.collect()} == {(1, 0)}


def test_hashed_model_over_the_buckets_there_are_is_the_model_over_all(spark, monkeypatch):
    """Fits see no bucket without a term and take rows in large blocks; models are as wide as before and the same."""
    widths, fit = [], LogisticRegression.fit
    seen = lambda self, rows, *a: widths.append((rows.first().features.size, self.getMaxBlockSizeInMB())) or fit(self, rows, *a)
    docs = texts(spark, 120).unionByName(texts(spark, 40).withColumn("text", F.lit("odd words")))
    with monkeypatch.context() as m:
        m.setattr(LogisticRegression, "fit", seen)
        model = ML.hashed_full_pool_model(docs, bits=12, max_iter=5)
    assert len(widths) == 3 and all(w == 18 and block >= 32 for w, block in widths)  # 11 words and 7 pairs
    rows = ML.with_class_weight(docs).withColumn("tokens", tokenize_words("text"))
    lr = LogisticRegression(weightCol="weight", regParam=1e-6, maxIter=5, standardization=False)
    whole = Pipeline(stages=[
        HashingTF(inputCol="tokens", outputCol="_tf", numFeatures=1 << 12), Normalizer(inputCol="_tf", outputCol="features"),
        OneVsRest(classifier=lr, labelCol="y", featuresCol="features", weightCol="weight"),
    ]).fit(rows)
    for a, b in zip(model.stages[-1].models, whole.stages[-1].models, strict=True):
        assert a.numFeatures == 1 << 12 and a.coefficients.toArray() == pytest.approx(b.coefficients.toArray(), abs=1e-6) and a.intercept == pytest.approx(b.intercept, abs=1e-6)
    got = {(r.doc_id, r.y): (r.pred, r.p_neg, r.p_neu, r.p_pos) for r in ML.score_hashed(model, docs).collect()}
    want = {(r.doc_id, r.y): (r.pred, r.p_neg, r.p_neu, r.p_pos) for r in ML.score_hashed(whole, docs).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)


def test_a_hashed_model_of_texts_without_words(spark):
    docs = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate([None, "", "a"] * 4)], "doc_id long, text string, y int")
    model = ML.hashed_full_pool_model(docs, bits=8, max_iter=2)
    assert ML.score_hashed(model, docs).count() == 12 and not any(m.coefficients.toArray().any() for m in model.stages[-1].models)


def test_a_text_is_split_into_words_once(spark):
    docs = spark.createDataFrame([("One two, two three",), ("one",), ("",), (None,)], "text string")
    split = docs.select(tokenize_words("text").alias("t"), tokenize_words("text", (2,)).alias("p"), word_tokens("text").alias("w"))
    assert [(r.t, r.p, r.w) for r in split.collect()] == [
        (["one", "two", "two", "three", "one two", "two two", "two three"], ["one two", "two two", "two three"], ["one", "two", "two", "three"]),
        (["one"], [], ["one"]), ([], [], []), ([], [], []),
    ]
    plan = docs.select(tokenize_words("text").alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_vectors_hold_every_token_of_an_id_and_shuffle_no_terms(spark):
    """Rows of one id count together, documents may span batches, and only folded numbers are dealt by id."""
    long = " ".join(f"w{i % 7}" for i in range(25_000))
    docs = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (2, long), (3, "zz"), (4, ""), (5, None), (None, "aa")], "doc_id long, text string")
    terms = spark.createDataFrame([(t, i, 1.0 + i) for i, t in enumerate(["aa", "bb", "cc", "aa bb", *[f"w{i}" for i in range(7)]])], "term string, idx int, idf double")
    vectors = FT.tfidf_vectors(docs, terms, 100)
    found = {}
    for r in vectors.collect():
        found.setdefault(r.doc_id, []).append({int(i): v for i, v in zip(r.features.indices, r.features.values)})

    def unit(counts):
        raw = {i: (1 + math.log(n)) * (1.0 + i) for i, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {i: pytest.approx(v / norm) for i, v in raw.items()}

    assert found[1] == [unit({0: 2, 1: 2, 2: 1, 3: 1})] * 2 and found[3] == found[4] == found[5] == found[None] == [{}]
    assert found[2] == [unit({4 + i: 25_000 // 7 + (i < 25_000 % 7) for i in range(7)})]
    plan = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "term" in line.split("]")[0]]


def test_frequent_terms_are_numbered_first(spark):
    terms = spark.createDataFrame([(f"t{i:03d}", 1 + i % 40, 1 + i, 0.5) for i in range(300)], "term string, df long, cf long, idf double")
    got = FT.indexed_terms(terms).orderBy("idx").collect()
    octaves = [r.df.bit_length() for r in got]
    assert [r.idx for r in got] == list(range(300)) and octaves == sorted(octaves, reverse=True)
    assert {r.term for r in got} == {f"t{i:03d}" for i in range(300)} and set(terms.columns) < set(got[0].asDict())


def test_text_classifier_takes_rows_in_large_blocks(spark, monkeypatch):
    sizes, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, rows, *a: sizes.append(self.getMaxBlockSizeInMB()) or fit(self, rows, *a))
    docs = texts(spark, 30)
    ML.length_model(docs.withColumn("text_len", F.length("text")), docs.withColumn("text_len", F.length("text")), 3)
    assert sizes and min(sizes) >= 32
