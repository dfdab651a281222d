"""Trends of a metric over years and checks that explain them away."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import binary_pred
from tidemark.operators import metrics as M
from tidemark.operators.profile import count_by_category, share_in_partition
from tidemark.session import cut


def yearly_slope(metrics: DataFrame, keys: Sequence[str], value: str = "macro_f1", year: str = "yr") -> DataFrame:
    """Least-squares slope per year, and the slope relative to the first year's value (null if that is 0)."""
    out = metrics.groupBy(*keys).agg(
        F.regr_slope(value, F.col(year).cast("double")).alias("slope"), F.min_by(value, year).alias("first")
    )
    return out.select(*keys, "slope", F.try_divide("slope", "first").alias("rel_slope"))


def seed_averaged(metrics: DataFrame, keys: Sequence[str], value: str = "macro_f1") -> DataFrame:
    return metrics.groupBy(*keys).agg(F.avg(value).alias(value))


def model_slopes(preds: DataFrame, keys: Sequence[str] = ("model", "train_set"), **f1_args) -> DataFrame:
    """F1 per run and year, seeds averaged, slope per model: two small aggregations after one pass."""
    f1 = M.class_f1(preds, [*keys, "seed", "yr"], **f1_args)
    return yearly_slope(seed_averaged(f1, [*keys, "yr"]), keys)


def per_seed_slopes(preds: DataFrame, keys: Sequence[str] = ("model", "train_set")) -> DataFrame:
    """Slope of every seed with mean and deviation over the seeds of a model."""
    f1 = M.class_f1(preds, [*keys, "seed", "yr"])
    per_seed = yearly_slope(f1, [*keys, "seed"]).select(*keys, "seed", "slope")
    w = Window.partitionBy(*keys)
    return per_seed.withColumn("mean", F.avg("slope").over(w)).withColumn("sd", F.stddev_samp("slope").over(w))


def drop_period(preds: DataFrame, years: Sequence[int]) -> DataFrame:
    return model_slopes(preds.filter(~F.col("yr").isin(*years)))


def binary_task(preds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neutral items removed, class decided by the two outer probabilities. (F1 per year, slopes)."""
    two = preds.filter(F.col("y") != 1)
    keys = ["model", "train_set", "seed", "yr"]
    f1 = M.class_f1(two, keys, classes=(0, 2), pred=binary_pred())
    return f1, yearly_slope(seed_averaged(f1, ["model", "train_set", "yr"]), ["model", "train_set"])


def month_mix(items: DataFrame, last_month: int = 9) -> DataFrame:
    """Share of a year's items up to a month and the label mix of those items (null in a year without any)."""
    kept = F.col("month") <= last_month
    share = lambda c: F.try_divide(F.count_if(kept & (F.col("y") == c)), F.count_if(kept))
    return items.groupBy("yr").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(kept.cast("double")).alias("kept_share"),
        share(0).alias("neg"),
        share(1).alias("neu"),
        share(2).alias("pos"),
    )


def month_matched_slopes(preds: DataFrame, last_month: int = 9) -> DataFrame:
    """Slopes over all months next to slopes over the first months only."""
    weights = {"all": F.lit(1), "matched": F.when(F.col("month") <= last_month, 1).otherwise(0)}
    f1 = M.macro_f1_variants(preds, ["model", "train_set", "seed", "yr"], weights)
    per_year = f1.groupBy("model", "train_set", "yr").agg(F.avg("all").alias("all"), F.avg("matched").alias("matched"))
    x = F.col("yr").cast("double")
    return per_year.groupBy("model", "train_set").agg(
        F.regr_slope("all", x).alias("slope_all"), F.regr_slope("matched", x).alias("slope_matched")
    )


#: Three-class slope of all items, without the years left out, of the outer classes by probabilities, of the first months.
VARIANTS = ("all", "dropped", "binary", "months")


def robustness(
    preds: DataFrame, members: Sequence[tuple], pairs: Sequence[tuple], drop_years: Sequence[int], B: int, seed: int, last_month: int = 9, draws: str = "tree"
) -> tuple[DataFrame, DataFrame]:
    """Yearly slopes of every robustness run with intervals, and differences between models, under one set of draws.

    (variant, model, train_set, slope, lo, hi) and (variant, a, b, slope_diff, lo, hi), variants as in ``VARIANTS``. A cell
    carries every run's class twice, as predicted and as decided between the outer classes by probabilities, and a flag for
    the first months. A replicate weighs the cells once; each variant reads its own classes from the same weights, so slopes
    are paired over variants and models. ``pairs`` name runs as 'model/train_set'.
    """
    from tidemark.operators import bootstrap as bs

    cols = [*bs.MEMBER, "_decoding"]
    both = F.explode(F.array(F.struct(F.lit("as predicted").alias("_decoding"), F.col("pred")), F.struct(F.lit("outer").alias("_decoding"), binary_pred().cast("int").alias("pred"))))
    first = F.coalesce((F.col("month") <= last_month).cast("int"), F.lit(0))
    long = preds.select("item_id", "yr", "y", *bs.MEMBER, first.alias("_first"), "pred", "p_neg", "p_pos").select("item_id", "yr", "y", *bs.MEMBER, "_first", both.alias("_d")).select("item_id", "yr", "y", *bs.MEMBER, "_first", "_d.*")
    twice = [(*m, decoding) for m in members for decoding in ("as predicted", "outer")]
    cells = bs.joint_cells(long, twice, ["yr"], cols, ["_first"])
    order = ["y", *bs._codes(len(twice)), "_first"]
    make = {"tree": bs.tree_weights, "multinomial": bs.multinomial_weights, "hash": bs.draw_cells}[draws]
    weights = cut(make(cells, ["yr"], order, B, seed))

    def slopes(weighted: DataFrame, weight: str, reps: Sequence[str]) -> DataFrame:
        """One pass: F1 of every variant from the decoded cells."""
        rows = weighted.select("yr", *reps, "y", "_first", F.col(weight).alias("_w"), F.explode(bs._member_structs(twice, cols)).alias("m"))
        flat = rows.select("yr", *reps, "y", "_first", "_w", "m.*")
        keys = [*bs.MEMBER, "yr", *reps]
        three = F.col("_decoding") == "as predicted"
        weight_of = {"all": F.when(three, F.col("_w")), "months": F.when(three & (F.col("_first") == 1), F.col("_w"))}
        two = F.when(~three & (F.col("y") != 1), F.col("_w"))
        zero = lambda w: F.coalesce(w, F.lit(0))
        aggs = [a for name, w in weight_of.items() for a in M.f1_aggregates(F.col("y"), F.col("pred"), weight=zero(w), tag=f"_{name}")]
        aggs += M.f1_aggregates(F.col("y"), F.col("pred"), (0, 2), zero(two), "_binary")
        f1 = flat.groupBy(*keys).agg(*aggs)
        macro = {name: M.f1_columns(tag=f"_{name}")["macro_f1"] for name in weight_of} | {"binary": M.f1_columns((0, 2), "_binary")["macro_f1"]}
        per_year = f1.select(*keys, *[c.alias(name) for name, c in macro.items()]).groupBy("model", "train_set", "yr", *reps).agg(*[F.avg(n).alias(n) for n in macro])
        kept = F.when(~F.col("yr").isin(*drop_years), F.col("all"))
        x = F.col("yr").cast("double")
        wide = per_year.withColumn("dropped", kept).groupBy("model", "train_set", *reps).agg(*[F.regr_slope(n, x).alias(n) for n in VARIANTS])
        listed = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("slope")) for n in VARIANTS])).alias("v")
        return wide.select("model", "train_set", *reps, listed).select("v.variant", "model", "train_set", *reps, "v.slope")

    point, reps = slopes(cells, "n", []), cut(slopes(weights, "w", ["rep"]))
    who = ["variant", "model", "train_set"]
    spread = point.join(bs.interval(reps, who, "slope"), who)
    named = bs._pair_diffs(point, pairs, ["variant"], ["slope"])
    diffs = named.join(bs.interval(bs._pair_diffs(reps, pairs, ["variant", "rep"], ["slope"]), ["variant", "a", "b"], "slope_diff"), ["variant", "a", "b"])
    return spread, diffs


def mix_weights(items: DataFrame, meta: DataFrame, ref_year: int) -> DataFrame:
    """(yr, cat_l1, w): reference-year share of a category over its share in the year."""
    shares = share_in_partition(cut(count_by_category(items, ["yr"], meta)), ["yr"])
    ref = shares.filter(F.col("yr") == ref_year).select("cat_l1", F.col("share").alias("_ref"))
    return shares.join(ref, "cat_l1", "left").select(
        "yr", "cat_l1", (F.coalesce("_ref", F.lit(0.0)) / F.col("share")).alias("w")
    )


def _cells_of_runs(items: DataFrame, runs: Mapping[tuple, str], meta: DataFrame) -> DataFrame:
    """(model, train_set, seed, yr, y, pred, cat_l1, n) from one row per item with a column of classes per run.

    The classes are packed, two bits each and 3 for none, so that an item meets its category once and not once per run.
    """
    at = {c: (f"_code{i // 31}", 2 * (i % 31)) for i, c in enumerate(runs.values())}
    digit = lambda c: F.shiftleft(F.coalesce(F.col(c), F.lit(3)).cast("long"), at[c][1])
    codes = sorted({code for code, _ in at.values()})
    packed = {code: reduce(Column.bitwiseOR, [digit(c) for c in at if at[c][0] == code]) for code in codes}
    rows = items.select("parent_asin", "yr", "y", *[v.alias(k) for k, v in packed.items()])
    each = [
        F.struct(F.lit(i).alias("_run"), F.nullif(F.shiftright(code, shift).bitwiseAND(3), F.lit(3)).cast("int").alias("pred"))
        for i, (code, shift) in enumerate(at.values())
    ]
    opened = lambda df: df.withColumn("_r", F.explode(F.array(*each))).select("*", "_r.*")
    cells = count_by_category(rows, ["yr", "y", *codes], meta, opened=(["_run", "yr", "y", "pred"], opened))
    names = ("model", "train_set", "seed")
    who = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, run)]) for run in runs])[F.col("_run")]
    return cells.select(*[who[n].alias(n) for n in names], "yr", "y", "pred", "cat_l1", "n")


def mix_reweighted_f1(preds: DataFrame, items: DataFrame, meta: DataFrame, ref_year: int, runs: Mapping[tuple, str] | None = None) -> DataFrame:
    """(model, train_set, yr, raw, reweighted): macro F1 with every year given the reference year's category mix.

    Predictions are counted per (run, year, category, y, pred) first; weights join those counts. A year and category
    that ``items`` does not have has no weight: its predictions count in ``raw`` and not in ``reweighted``. With ``runs``,
    which names the column of each (model, train_set, seed), ``preds`` has one row per item.
    """
    keys = ["model", "train_set", "seed", "yr"]
    cells = count_by_category(preds, [*keys, "y", "pred"], meta) if runs is None else _cells_of_runs(preds, runs, meta)
    weighted = cells.join(mix_weights(items, meta, ref_year), ["yr", "cat_l1"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    both = M.macro_f1_variants(weighted, keys, {"raw": F.col("n"), "reweighted": F.col("n") * F.col("w")})
    return both.groupBy("model", "train_set", "yr").agg(F.avg("raw").alias("raw"), F.avg("reweighted").alias("reweighted"))


def mix_reweighted_slopes(per_year: DataFrame) -> DataFrame:
    x = F.col("yr").cast("double")
    return per_year.groupBy("model", "train_set").agg(
        F.regr_slope("raw", x).alias("raw_slope"), F.regr_slope("reweighted", x).alias("reweighted_slope")
    )


def recovery_share(
    metrics: DataFrame, base_year: int, years: Sequence[int], old: str = "early", new: str = "recent", value: str = "macro_f1"
) -> DataFrame:
    """Loss of the old training set since the base year and the share the new one wins back (null without a loss)."""
    is_old, is_new = F.col("train_set") == old, F.col("train_set") == new
    late = F.col("yr").isin(*years)
    per_year = seed_averaged(metrics, ["model", "train_set", "yr"], value)
    at = per_year.groupBy("model").agg(
        F.avg(F.when(is_old & (F.col("yr") == base_year), F.col(value))).alias("old_base"),
        F.avg(F.when(is_old & late, F.col(value))).alias("old_late"),
        F.avg(F.when(is_new & late, F.col(value))).alias("new_late"),
    )
    loss = F.col("old_late") - F.col("old_base")
    return at.select("*", loss.alias("loss"), F.try_divide(F.col("new_late") - F.col("old_late"), -loss).alias("recovered"))


def seed_vote_share(preds: DataFrame, keys: Sequence[str] = ("item_id",)) -> DataFrame:
    """Share of seeds that predict each class, per item."""
    share = lambda c: F.avg((F.col("pred") == c).cast("double"))
    return preds.groupBy(*keys).agg(share(0).alias("share_neg"), share(1).alias("share_neu"), share(2).alias("share_pos"))


TERMS = ("r_early", "r_late", "total", "composition", "within", "interaction")


def shift_share(items: DataFrame, group: str = "label", value: str = "share_neu", keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Change of a mean between periods split into composition, within-group and interaction parts.

    ``items`` has ``period`` ('early'/'late'), a group and a value per row; ``weight`` counts rows.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    v = F.col(value)
    cells = items.groupBy(*keys, group).agg(
        *[
            F.sum(F.when(F.col("period") == p, x).otherwise(0.0)).alias(f"_{n}{p}")
            for p in ("early", "late")
            for n, x in (("n", w), ("s", w * v))
        ]
    )
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    share = lambda p: F.try_divide(F.col(f"_n{p}"), F.sum(f"_n{p}").over(part))
    rate = lambda p: F.when(F.col(f"_n{p}") > 0, F.col(f"_s{p}") / F.col(f"_n{p}")).otherwise(0.0)
    rated = cells.select(
        *keys, share("early").alias("we"), share("late").alias("wl"), rate("early").alias("re"), rate("late").alias("rl")
    )
    we, wl, re, rl = (F.col(c) for c in ("we", "wl", "re", "rl"))
    return rated.groupBy(*keys).agg(
        F.sum(we * re).alias("r_early"),
        F.sum(wl * rl).alias("r_late"),
        (F.sum(wl * rl) - F.sum(we * re)).alias("total"),
        F.sum((wl - we) * re).alias("composition"),
        F.sum(we * (rl - re)).alias("within"),
        F.sum((wl - we) * (rl - re)).alias("interaction"),
    )


def shift_share_bootstrap(
    items: DataFrame, B: int, seed: int, group: str = "label", value: str = "share_neu", draws: str = "multinomial"
) -> DataFrame:
    """(term, estimate, lo, hi): items resampled within each period, drawn over cells of equal rows."""
    from tidemark.operators.bootstrap import draw_cells, multinomial_weights

    cells = cut(items.groupBy("period", group, value).agg(F.count(F.lit(1)).alias("n")))
    draw = multinomial_weights if draws == "multinomial" else draw_cells
    reps = shift_share(draw(cells, ["period"], [group, value], B, seed), group, value, ["rep"], F.col("w"))
    point = shift_share(cells, group, value, [], F.col("n"))

    def long(df: DataFrame, keys: list[str]) -> DataFrame:
        terms = F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("v")) for t in TERMS])
        return df.select(*keys, F.explode(terms).alias("t")).select(*keys, "t.term", "t.v")

    spread = long(reps, ["rep"]).groupBy("term").agg(
        F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi")
    )
    return long(point, []).withColumnRenamed("v", "estimate").join(spread, "term")


def pred_dist_given_text(items: DataFrame, label: str, group: str = "label") -> DataFrame:
    """Mean predicted-class shares of the items with one text label, per period."""
    return items.filter(F.col(group) == label).groupBy("period").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"share_{c}").alias(f"share_{c}") for c in ("neg", "neu", "pos")],
    )


def figure_series(preds: DataFrame, members: Sequence[tuple], B: int, seed: int, draws: str = "tree") -> DataFrame:
    """(yr, model, train_set, macro, lo, hi, neu): seed means with bootstrap bands, from one set of replicates."""
    from tidemark.operators import bootstrap as bs

    keys = ["yr", "model", "train_set"]
    cells = bs.joint_cells(preds, members, ["yr"])
    point = bs.member_f1(cells, members, ["yr"]).groupBy(*keys).agg(F.avg("macro_f1").alias("macro"), F.avg("f1_1").alias("neu"))
    reps = bs.seed_mean(bs.replicate_f1(cells, members, ["yr"], B, seed, draws), [*keys, "rep"])
    return point.join(bs.interval(reps, keys, "f1"), keys).select(*keys, "macro", "lo", "hi", "neu")
