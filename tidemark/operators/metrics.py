"""Classification metrics from one grouped pass over a long prediction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import CLASSES


def _sum_if(cond: Column, weight: Column | None) -> Column:
    if weight is None:
        return F.count_if(cond)
    return F.sum(F.when(cond, weight).otherwise(F.lit(0)))


def f1_aggregates(
    y: Column, pred: Column, classes: Sequence[int] = CLASSES, weight: Column | None = None, tag: str = ""
) -> list[Column]:
    """Per class: weight of hits, and weight of true plus predicted members."""
    out = []
    for c in classes:
        out.append(_sum_if((y == c) & (pred == c), weight).alias(f"_tp{tag}{c}"))
        out.append((_sum_if(y == c, weight) + _sum_if(pred == c, weight)).alias(f"_tot{tag}{c}"))
    return out


def f1_columns(classes: Sequence[int] = CLASSES, tag: str = "") -> dict[str, Column]:
    """2tp / (true + predicted), 0 for an absent class, and the plain mean over classes."""
    f1 = {
        f"f1_{c}": F.when(F.col(f"_tot{tag}{c}") > 0, F.lit(2.0) * F.col(f"_tp{tag}{c}") / F.col(f"_tot{tag}{c}")).otherwise(F.lit(0.0))
        for c in classes
    }
    total = None
    for v in f1.values():
        total = v if total is None else total + v
    return {**f1, "macro_f1": total / F.lit(float(len(classes)))}


def class_f1(
    preds: DataFrame,
    keys: Sequence[str],
    classes: Sequence[int] = CLASSES,
    weight: Column | None = None,
    pred: Column | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    p = F.col("pred") if pred is None else pred
    grouped = preds.groupBy(*keys).agg(*f1_aggregates(F.col("y"), p, classes, weight), *extra)
    names = f1_columns(classes)
    kept = [c for c in grouped.columns if not c.startswith(("_tp", "_tot"))]
    return grouped.select(*kept, *[v.alias(k) for k, v in names.items()])


def macro_f1_variants(preds: DataFrame, keys: Sequence[str], weights: dict[str, Column], classes: Sequence[int] = CLASSES) -> DataFrame:
    """Macro F1 under several item weights in one pass: one column per name."""
    aggs = [a for name, w in weights.items() for a in f1_aggregates(F.col("y"), F.col("pred"), classes, w, f"_{name}")]
    grouped = preds.groupBy(*keys).agg(*aggs)
    return grouped.select(*keys, *[f1_columns(classes, f"_{name}")["macro_f1"].alias(name) for name in weights])


def confusion_matrix(preds: DataFrame, keys: Sequence[str], classes: Sequence = CLASSES, y: str = "y", pred: str = "pred") -> DataFrame:
    """Dense (keys, y, pred, n): empty cells are present with 0."""
    pairs = [(a, b) for a in classes for b in classes]
    wide = preds.groupBy(*keys).agg(
        *[F.count_if((F.col(y) == a) & (F.col(pred) == b)).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = F.array(
        *[F.struct(F.lit(a).alias("y"), F.lit(b).alias("pred"), F.col(f"_c{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
    )
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, F.col("c.y").alias(y), F.col("c.pred").alias(pred), "c.n")


def accuracy(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))


RUN = ("model", "train_set", "seed", "test_set")


def metric_table(preds: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Size, accuracy, macro and per-class F1 of every run."""
    n = F.count(F.lit(1)).alias("n")
    acc = F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy")
    return class_f1(preds, keys, extra=[n, acc])


def pred_share(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    share = lambda c: F.avg((F.col("pred") == c).cast("double"))
    return preds.groupBy(*keys).agg(share(0).alias("pred_neg"), share(1).alias("pred_neu"), share(2).alias("pred_pos"))
