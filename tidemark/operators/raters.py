"""Agreement between raters and with gold labels.

Every statistic is a function of how often each label pattern occurs, so items are folded to
pattern counts by one shuffle on the item and everything after works on those few counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import LABELS

NO_MAJORITY = "NO_MAJORITY"
ALL_LABELS = (*LABELS, NO_MAJORITY)


def kappa_columns(la: Column, lb: Column, n: Column, labels: Sequence[str] = ALL_LABELS) -> dict[str, Column]:
    """n, observed agreement and chance-corrected agreement of two label columns weighted by n.

    The latter is null if chance alone would agree always, as when all labels are the same one.
    """
    total = F.sum(n)
    po = F.sum(F.when(la == lb, n).otherwise(0)) / total
    pe = None
    for lab in labels:
        term = F.sum(F.when(la == lab, n).otherwise(0)) / total * (F.sum(F.when(lb == lab, n).otherwise(0)) / total)
        pe = term if pe is None else pe + term
    return {"n": total, "agreement": po, "kappa": F.try_divide(po - pe, F.lit(1.0) - pe)}


def rater_patterns(labels: DataFrame, raters: Sequence[str], by: Sequence[str] = (), label_set: Sequence[str] = ALL_LABELS) -> DataFrame:
    """(by, r0, r1, ..., n): counts of joint label patterns; null where a rater has no label.

    Labels are counted as their places in the sorted label set, small numbers that a hash aggregate holds; a label outside
    of it fails the job. Of several labels of one rater for an item the last by name counts.
    """
    wide = _wide_codes(labels, raters, by, label_set)
    cells = wide.groupBy(*by, *[f"r{i}" for i in range(len(raters))]).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(x) for x in sorted(label_set)])
    return cells.withColumns({f"r{i}": F.get(names, F.col(f"r{i}")) for i in range(len(raters))})


def _wide_codes(labels: DataFrame, raters: Sequence[str], by: Sequence[str], label_set: Sequence[str]) -> DataFrame:
    """(item_id, by, r0, r1, ...): each rater's label as its place in the sorted label set."""
    names = sorted(label_set)
    code = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("label")) - 1
    known = F.when(code >= 0, code).when(F.col("label").isNotNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.col("label"))).cast("long")).cast("int")
    coded = labels.filter(F.col("rater").isin(*raters)).select("item_id", *by, "rater", known.alias("_c"))
    return coded.groupBy("item_id", *by).agg(*[F.max(F.when(F.col("rater") == r, F.col("_c"))).alias(f"r{i}") for i, r in enumerate(raters)])


def cohen_kappa(labels: DataFrame, raters: Sequence[str], by: Sequence[str] = (), label_set: Sequence[str] = ALL_LABELS) -> DataFrame:
    """(by, a, b, n, agreement, kappa) for every pair of raters over items both labelled."""
    return _pair_kappas(rater_patterns(labels, raters, by, label_set), raters, by, label_set)


def _pair_kappas(cells: DataFrame, raters: Sequence[str], by: Sequence[str], label_set: Sequence[str]) -> DataFrame:
    """Kappa of every pair of raters from counted label patterns."""
    pairs = [(i, j) for i in range(len(raters)) for j in range(i + 1, len(raters))]
    long = cells.select(
        *by,
        "n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(raters[i]).alias("a"), F.lit(raters[j]).alias("b"),
                        F.col(f"r{i}").alias("la"), F.col(f"r{j}").alias("lb"),
                    )
                    for i, j in pairs
                ]
            )
        ).alias("p"),
    ).filter("p.la IS NOT NULL AND p.lb IS NOT NULL")
    cols = kappa_columns(F.col("p.la"), F.col("p.lb"), F.col("n"), label_set)
    return long.groupBy(*by, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(*[c.alias(k) for k, c in cols.items()])


def agreement_subsets(
    labels: DataFrame, raters: Sequence[str], subsets: dict[str, Column], items: DataFrame | None = None, label_set: Sequence[str] = ALL_LABELS
) -> DataFrame:
    """(subset, a, b, n, agreement, kappa) for every pair of raters over several, possibly overlapping, subsets of items.

    ``subsets`` maps a name to a predicate over the raters' labels (columns named like the raters) and the columns of
    ``items`` (item_id and attributes; items without a row there have nulls). A predicate that is null keeps the item out.
    Items are folded once: each label pattern with the bit mask of the predicates it fulfils is one counted row, and every
    subset sums the rows whose mask has its bit. A subset without items gives no rows.
    """
    if len(subsets) > 62:
        raise ValueError("at most 62 subsets fit a mask")
    codes = [f"r{i}" for i in range(len(raters))]
    wide = _wide_codes(labels, raters, (), label_set)
    names = F.array(*[F.lit(x) for x in sorted(label_set)])
    told = wide.select("item_id", *codes, *[F.get(names, F.col(c)).alias(r) for c, r in zip(codes, raters)])
    if items is not None:
        told = told.join(items, "item_id", "left")
    mask = F.lit(0).cast("long")
    for i, keep in enumerate(subsets.values()):
        mask = mask.bitwiseOR(F.when(keep, F.lit(1 << i)).otherwise(0).cast("long"))
    cells = told.select(*codes, mask.alias("_mask")).filter("_mask <> 0").groupBy(*codes, "_mask").agg(F.count(F.lit(1)).alias("n"))
    held = F.array_compact(F.array(*[F.when(F.col("_mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(name)) for i, name in enumerate(subsets)]))
    each = cells.select(F.explode(held).alias("subset"), *[F.get(names, F.col(c)).alias(c) for c in codes], "n")
    return _pair_kappas(each, raters, ["subset"], label_set)


def _label_counts(labels: DataFrame) -> DataFrame:
    """Labels of each kind per item; a label outside the five fails the job."""
    known = F.when(F.col("label").isNull() | F.col("label").isin(*LABELS), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.col("label"))))
    return labels.withColumn("label", known).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("label") == lab).alias(f"_c{i}") for i, lab in enumerate(LABELS)]
    )


def fleiss_kappa(labels: DataFrame) -> DataFrame:
    """(n_items, kappa) for items with the same number of raters each; a different number fails the job.

    Null with one rater an item, or if chance alone would agree always.
    """
    counts = [F.col(f"_c{i}") for i in range(len(LABELS))]
    n = F.col("_n")
    squares = sum((c * c for c in counts[1:]), counts[0] * counts[0])
    p_item = F.try_divide(squares - n, n * (n - 1))
    out = _label_counts(labels).agg(
        F.count(F.lit(1)).alias("n_items"), F.avg(p_item).alias("_pb"), F.sum("_n").alias("_all"), F.min("_n").alias("_least"), F.max("_n").alias("_most"),
        *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(counts)],
    )
    share = [F.try_divide(f"_s{i}", "_all") for i in range(len(LABELS))]
    pe = sum((s * s for s in share[1:]), share[0] * share[0])
    unequal = F.raise_error(F.lit("items have different numbers of raters")).cast("double")
    kappa = F.try_divide(F.col("_pb") - pe, F.lit(1.0) - pe)
    return out.select("n_items", F.when(F.col("_least") < F.col("_most"), unequal).otherwise(kappa).alias("kappa"))


def majority_vote(labels: DataFrame) -> DataFrame:
    """(item_id, majority, unanimous): a label needs more than half of the item's raters."""
    counts = [F.col(f"_c{i}") for i in range(len(LABELS))]
    top = F.greatest(*counts)
    pick = F.when(top * 2 <= F.col("_n"), NO_MAJORITY)
    for lab, c in zip(LABELS, counts):
        pick = pick.when(c == top, lab)
    return _label_counts(labels).select("item_id", pick.alias("majority"), (top == F.col("_n")).alias("unanimous"))


def complete_cases(labels: DataFrame, n_raters: int, excluded: DataFrame | None = None) -> DataFrame:
    """Labels of items that every rater labelled, minus excluded items."""
    full = labels.groupBy("item_id").agg(F.count_distinct("rater").alias("_n")).filter(F.col("_n") == n_raters).select("item_id")
    if excluded is not None:
        full = full.join(excluded.select("item_id"), "item_id", "left_anti")
    return labels.join(full, "item_id", "left_semi")


def with_majority(labels: DataFrame) -> DataFrame:
    """Stack the majority vote under the raters as one more rater."""
    vote = majority_vote(labels).select("item_id", F.lit("majority").alias("rater"), F.col("majority").alias("label"))
    return labels.select("item_id", "rater", "label").unionByName(vote)


def gold_accuracy(labels: DataFrame, gold: DataFrame, gold_labels: Sequence[str] = LABELS[:4]) -> DataFrame:
    """(rater, n, accuracy, kappa, recall per gold class) for every rater and the majority."""
    cells = (
        with_majority(labels).join(gold.select("item_id", "gold"), "item_id").groupBy("rater", "label", "gold")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    k = kappa_columns(F.col("label"), F.col("gold"), F.col("n"))
    recall = []
    for g in gold_labels:
        members = F.sum(F.when(F.col("gold") == g, F.col("n")).otherwise(0))
        hits = F.sum(F.when((F.col("gold") == g) & (F.col("label") == g), F.col("n")).otherwise(0))
        recall.append((hits / F.greatest(members, F.lit(1))).alias(f"recall_{g}"))
    return cells.groupBy("rater").agg(k["n"].alias("n"), k["agreement"].alias("accuracy"), k["kappa"].alias("kappa"), *recall)


def gold_confusion(labels: DataFrame, gold: DataFrame) -> DataFrame:
    """Dense (rater, gold, label, n), with a column for items without a majority."""
    from tidemark.operators.metrics import confusion_matrix

    joined = with_majority(labels).join(gold.select("item_id", "gold"), "item_id")
    return confusion_matrix(joined, ["rater"], ALL_LABELS, "gold", "label").filter(F.col("gold") != NO_MAJORITY)
