"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import Bucketizer, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, text_of

#: Labelled rows that a fit may use; more are thinned by a hash of the key.
MOST_TRAINING_ROWS = 20_000


@dataclass(frozen=True)
class Settings:
    word_buckets: int = 4096
    stat_buckets: int = 512
    factors: int = 8
    iterations: int = 60
    step: float = 0.05
    penalty: float = 1e-4
    seed: int = 7


_SHARES = [0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.75, 0.95]
_SIZES = [1, 10, 30, 60, 120, 250, 500, 1000, 2500, 10_000]


def features(df: DataFrame, keep: list[str], text: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns with ``words`` (the different words, lower-cased) and ``stats`` (names of the levels of structure statistics).

    Metadata columns become one token each. A null text is an empty text; a null metadata value is a token of its own.
    """
    # Every step is a projection of its own, so that what several statistics need is computed once a row.
    t, w, r = F.col("_t"), F.col("_w"), F.col("_r")
    meta = [f"_m_{i}" for i in range(len(metadata))]
    base = df.select(*keep, *[F.col(c).alias(m) for c, m in zip(metadata, meta, strict=True)], text_of(text).alias("_t"))
    # No symbol, mark, digit or capital is among a-z and the space, so these are looked for in the rest of the text.
    words = F.array_remove(F.split(F.lower(t), SPACE_CLASS + "+"), "")
    base = base.withColumns({"_w": words, "_r": F.regexp_replace(t, "[a-z ]+", ""), "_l": F.split(t, "\n")})
    base = base.withColumns({"_d": F.array_distinct(w), "_n": F.size(w).cast("double"), "_c": F.length(F.array_join(w, "")).cast("double"), "_k": F.size("_l").cast("double")})
    n, chars, lines = F.col("_n"), F.col("_c"), F.col("_k")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    lost = lambda without: F.length(r) - F.length(without)
    stats = {
        "words": (n, _SIZES),
        "length": (share(chars, n), [1, 2, 3, 4, 5, 6, 8, 10, 15, 30]),
        "symbols": (share(lost(F.translate(r, "#*$%&|<>{}[]=_~^@\\", "")), chars), _SHARES),
        "marks": (share(lost(F.translate(r, "!?", "")), chars), _SHARES),
        "upper": (share(lost(F.regexp_replace(r, r"[A-ZÀ-ÖØ-Þ]+", "")), chars), _SHARES),
        "digits": (share(lost(F.regexp_replace(r, r"[0-9]+", "")), chars), _SHARES),
        "lines": (share(lines, n), _SHARES),
        "different": (share(F.size("_d").cast("double"), n), [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
        "different_lines": (share(F.size(F.array_distinct("_l")).cast("double"), lines), [0.1, 0.3, 0.5, 0.7, 0.9, 0.999]),
    }
    base = base.select(*keep, *meta, "_d", *[v.alias(f"_s_{name}") for name, (v, _) in stats.items()])
    # A statistic's level is the number of bounds that it reaches.
    ends = [[-math.inf, *map(float, bounds), math.inf] for _, bounds in stats.values()]
    base = Bucketizer(splitsArray=ends, inputCols=[f"_s_{name}" for name in stats], outputCols=[f"_v_{name}" for name in stats]).transform(base)
    tokens = [F.concat(F.lit(f"{name}="), F.col(f"_v_{name}").cast("int").cast("string")) for name in stats]
    tokens += [F.concat(F.lit(f"meta{i}="), F.coalesce(F.col(m).cast("string"), F.lit("null"))) for i, m in enumerate(meta)]
    return base.select(*keep, F.col("_d").alias("words"), F.array(*tokens).alias("stats"))


def train(labelled: DataFrame, settings: Settings = Settings()) -> PipelineModel:
    """Fit on rows of (words, stats, label): distributed gradient steps over a persisted, bounded training set."""
    parts = [
        HashingTF(numFeatures=settings.word_buckets, binary=True, inputCol="words", outputCol="_tf"),
        Normalizer(p=2.0, inputCol="_tf", outputCol="_wf"),
        HashingTF(numFeatures=settings.stat_buckets, binary=True, inputCol="stats", outputCol="_sf"),
        VectorAssembler(inputCols=["_wf", "_sf"], outputCol="_x"),
    ]
    machine = FMClassifier(
        featuresCol="_x", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_hard", factorSize=settings.factors,
        regParam=settings.penalty, maxIter=settings.iterations, stepSize=settings.step, initStd=0.05, solver="adamW", seed=settings.seed,
    )
    return Pipeline(stages=[*parts, machine]).fit(labelled)


def score(df: DataFrame, model: PipelineModel, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score``, the probability of label 1. Linear in the features of a row: the pairwise part is
    half the difference between the square of the sum and the sum of squares of the factors."""
    return model.transform(df).select(*keep, vector_to_array("_p")[1].alias("score"))


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def quality_scores(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = (), derive=None, settings: Settings = Settings(), most_rows: int = MOST_TRAINING_ROWS, threshold: float = 0.3
) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``.

    ``held_out``: crc32 of the key as text is divisible by 5 (null keys are held out); such rows are never learnt from.
    The fit uses at most about ``most_rows`` labelled rows, those with the smallest hashes of the key; a key with several
    labels gives several rows. ``score`` is between 0 and 1, higher if label 1 is likelier, also for empty and null texts;
    ``predicted`` is 1 if it is at least ``threshold``. Without rows of both labels to learn from every score is the share
    of label 1 among them, 0.5 if there are none. ``metadata`` names columns of ``docs``, which ``derive`` may add.
    """
    docs = derive(docs) if derive else docs
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(label).cast("double").alias("label"))
    n, ones = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    own = docs.select(F.col(key).alias("k"), F.coalesce(held_out(key), F.lit(True)).alias("held_out"), F.col(text).alias("t"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(metadata)])
    meta = tuple(f"m{i}" for i in range(len(metadata)))
    if not n or ones in (0, n):
        scored = own.select("k", "held_out", F.lit(ones / n if n else 0.5).alias("score"))
    else:
        share = min(1.0, most_rows / n)
        sample = chosen.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(1_000_000 * share))
        # At most about most_rows rows of two numbers.
        training = features(own.join(F.broadcast(sample), "k"), ["label"], "t", meta)
        scored = score(features(own, ["k", "held_out"], "t", meta), train(training, settings), ["k", "held_out"])
    return scored.select(F.col("k").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
