"""Baseline classifiers on Spark ML and the long prediction table they write."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, OneVsRestModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.labels import CLASSES, length_features, pred_from_probs
from tidemark.functions.text import tokenize_words
from tidemark.operators.profile import balanced_weights, majority_class
from tidemark.session import cut

#: MB of rows that a fit takes at a time. Each block is met by a vector of all coefficients, so blocks must hold much more
#: than such a vector; at Spark's 1 MB a step over sparse rows spends its time on vectors of zeros.
BLOCK_MB = 64.0
#: Vectors as long as the coefficients that a fit keeps on the driver: ten pairs of the optimiser's history and its own.
DRIVER_VECTORS = 26


def with_class_weight(train: DataFrame, y: str = "y", full: DataFrame | None = None) -> DataFrame:
    """Adds ``weight`` = n / (k * n_class), from the counts of ``full`` (the whole pool) when given."""
    weights = balanced_weights(train if full is None else full, y).select(y, "weight")
    return train.join(F.broadcast(weights), y)


def majority_baseline(train: DataFrame, tests: DataFrame) -> DataFrame:
    """Every item gets the most frequent training class."""
    return tests.withColumn("pred", majority_class(train).scalar())


def _softmax_regression(n_rows: int, max_iter: int, features: str = "features") -> LogisticRegression:
    """Multinomial logistic with the penalty of C = 1: the balanced weights sum to the row count."""
    return LogisticRegression(
        featuresCol=features, labelCol="y", weightCol="weight", family="multinomial", standardization=False,
        regParam=1.0 / max(n_rows, 1), maxIter=max_iter, tol=1e-6, maxBlockSizeInMB=BLOCK_MB,
    )


def by_core(rows: DataFrame) -> DataFrame:
    """The rows in a partition per core at most, for a fit.

    Every step of the optimiser sums one vector of all coefficients per partition, so more partitions than cores add nothing
    but vectors to move; partitions that grow with the rows made the steps dearer with them.
    """
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def text_classifier(train: DataFrame, max_iter: int = 100, labels: DataFrame | None = None) -> Model:
    """Class-balanced multinomial logistic regression on a ``features`` column.

    ``labels`` is a cheaper frame with the same ``y`` rows (the texts before vectorising), used for counts. The vectors are
    written once; the fit reads them twice.
    """
    rows = cut(train.select("y", "features"))
    counted = rows if labels is None else labels
    return _softmax_regression(counted.count(), max_iter).fit(by_core(with_class_weight(rows, full=counted)))


def add_length_features(df: DataFrame, length: str = "text_len") -> DataFrame:
    x, x2 = length_features(length)
    return VectorAssembler(inputCols=["_x", "_x2"], outputCol="features").transform(
        df.withColumn("_x", x).withColumn("_x2", x2)
    ).drop("_x", "_x2")


def length_model(train: DataFrame, tests: DataFrame, max_iter: int = 100) -> DataFrame:
    """Predictions of a classifier that sees nothing but text length."""
    model = text_classifier(add_length_features(train), max_iter, labels=train)
    return score_predictions(model, add_length_features(tests))


def score_predictions(model: Model, tests: DataFrame, tags: dict[str, Column] | None = None) -> DataFrame:
    """Adds pred and class probabilities (and run tags) to the test rows; model columns are dropped."""
    scored = model.transform(tests)
    probs = vector_to_array("probability")
    names = ("p_neg", "p_neu", "p_pos")
    out = scored.select(*tests.columns, *[probs[i].alias(n) for i, n in zip(CLASSES, names)])
    out = out.withColumn("pred", pred_from_probs(names))
    for k, v in (tags or {}).items():
        out = out.withColumn(k, v)
    return out.drop("features")


def _buckets(vectors: DataFrame, size: int) -> np.ndarray:
    """The buckets that occur in any vector, in order. A core returns one bitmap."""

    def marks(batches):
        seen = np.zeros(size, bool)
        for batch in batches:
            seen[batch["i"].flatten().to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()])], ["bits"])

    found = np.zeros(-(-size // 8), np.uint8)
    for row in by_core(vectors.select(F.unwrap_udt("features")["indices"].alias("i"))).mapInArrow(marks, "bits binary").collect():
        found |= np.frombuffer(row.bits, np.uint8)
    return np.flatnonzero(np.unpackbits(found)[:size])


def _narrowed(vectors: DataFrame, buckets: np.ndarray, size: int) -> DataFrame:
    """The vectors over these buckets only, as wide as there are buckets."""
    seen = np.zeros(size, bool)
    seen[buckets] = True
    bits, width, others = np.packbits(seen), max(len(buckets), 1), [c for c in vectors.columns if c != "features"]

    def narrow(batches):
        place = np.cumsum(np.unpackbits(bits)[:size], dtype=np.int32) - 1
        for batch in batches:
            v = batch["features"]
            fields = [v.field(i) for i in range(4)]
            at = fields[2]
            places = pa.array(place[at.flatten().to_numpy()], pa.int32())
            ends = pa.array(np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())]).astype(np.int32))
            sizes = pa.array(np.full(len(batch), width, np.int32))
            moved = pa.StructArray.from_arrays([fields[0], sizes, pa.ListArray.from_arrays(ends, places), fields[3]], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), moved], [*others, "features"])

    plain = vectors.select(*others, F.unwrap_udt("features").alias("features"))
    schema = StructType([vectors.schema[c] for c in others]).add("features", VectorUDT())
    return plain.mapInArrow(narrow, schema)


def _fits_at_once(rows: DataFrame, width: int, classes: int) -> int:
    """Classes that are fitted side by side: their vectors may take a third of the driver's memory."""
    heap = rows.sparkSession.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    return max(1, min(classes, int(heap / 3 / (8 * DRIVER_VECTORS * max(width, 1)))))


def hashed_full_pool_model(pool: DataFrame, bits: int = 22, max_iter: int = 20, reg: float = 1e-6, text: str = "text") -> Model:
    """One-against-rest logistic models on hashed unit-length unigrams and bigrams of the whole pool.

    Class weights come from full counts. The vectors are written once. A bucket without a term in the pool has a coefficient of
    0, so the fits run over the buckets that occur and the models are widened to 2**bits afterwards. A step's rows are
    short work beside its sums of long vectors, so the classes are fitted side by side as far as the driver's memory goes.
    """
    size = 1 << bits
    hashing = [HashingTF(inputCol="tokens", outputCol="_tf", numFeatures=size), Normalizer(inputCol="_tf", outputCol="features")]
    rows = with_class_weight(pool).withColumn("tokens", tokenize_words(text))
    vectors = cut(PipelineModel(stages=hashing).transform(rows).select("y", "weight", "features"))
    buckets = _buckets(vectors, size)
    narrow = cut(_narrowed(vectors, buckets, size))
    classes = int(narrow.agg(F.max("y")).first()[0]) + 1
    spark = pool.sparkSession

    def one_class(c: int) -> LogisticRegressionModel:
        lr = LogisticRegression(labelCol="_is", weightCol="weight", regParam=reg, maxIter=max_iter, standardization=False, maxBlockSizeInMB=BLOCK_MB)
        fitted = lr.fit(by_core(narrow.select((F.col("y") == c).cast("double").alias("_is"), "weight", "features")))
        wide = np.zeros(size)
        wide[buckets] = fitted.coefficients.toArray()[: len(buckets)]
        make = spark.sparkContext._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
        return LogisticRegressionModel(make(fitted.uid, _py2java(spark.sparkContext, DenseVector(wide)), float(fitted.intercept)))

    with ThreadPool(_fits_at_once(narrow, len(buckets), classes)) as threads:
        models = threads.map(inheritable_thread_target(spark)(one_class), range(classes), 1)
    return PipelineModel(stages=[*hashing, OneVsRestModel(models=models)])


def score_hashed(model: Model, tests: DataFrame, tags: dict[str, Column] | None = None, text: str = "text") -> DataFrame:
    """Adds pred, class probabilities and run tags: rows of the long prediction table.

    Each class has a model of its own against the rest; its logistic value, divided by the sum over the classes, is the
    class's probability (a third each where all three values vanish). pred is the class of the largest one.
    """
    *hashing, against_rest = model.stages
    rows = PipelineModel(stages=hashing).transform(tests.withColumn("tokens", tokenize_words(text)))
    for i, m in enumerate(against_rest.models):  # the margins alone, each a function of the vector: nothing is kept between them
        rows = m.copy({m.rawPredictionCol: f"_raw{i}", m.probabilityCol: "", m.predictionCol: ""}).transform(rows)
    margins = [vector_to_array(f"_raw{i}")[1] for i in CLASSES]
    scored = rows.select(*tests.columns, *[(1.0 / (1.0 + F.exp(-margins[i]))).alias(f"_q{i}") for i in CLASSES])
    total = F.col("_q0") + F.col("_q1") + F.col("_q2")
    names = ("p_neg", "p_neu", "p_pos")
    out = scored.withColumns({n: F.coalesce(F.try_divide(F.col(f"_q{i}"), total), F.lit(1.0 / 3)) for i, n in zip(CLASSES, names)})
    out = out.withColumn("pred", pred_from_probs(names)).drop("_q0", "_q1", "_q2")
    for k, v in (tags or {}).items():
        out = out.withColumn(k, v)
    return out
