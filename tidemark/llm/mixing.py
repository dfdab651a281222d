"""Mix sources to target weights by thresholds on a hash, found from histograms instead of a sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, positions
from tidemark.session import cut

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
#: Bits of the hash that one histogram resolves: at most 4,096 sums for each source.
LEVEL_BITS = 12


def ranked_sources(sizes: DataFrame, source: str) -> DataFrame:
    """Sources numbered in code-point order from 0, null last: a range of sources a partition, numbered inside it."""
    named = sizes.filter(F.col(source).isNotNull())
    ranged = cut(named.repartitionByRange(source).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(source)) - 1
    ranked = ranged.withColumn("_inside", inside).join(counts.select("_part", before.alias("_before")), "_part")
    nulls = sizes.filter(F.col(source).isNull()).withColumn("rank", F.lit(ranged.count()).cast("long"))
    return ranked.select(*sizes.columns, (F.col("_before") + F.col("_inside")).alias("rank")).unionByName(nulls)


def targets(sizes: DataFrame, source: str, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): weighted shares of ``total_share`` of all sizes, none above ``most`` times its source.

    Shares above their limit stop there and the excess is dealt again by weight until none is above. The level
    ``share / weight`` is the same for all sources below their limit, so every step is one sum over the sources.
    """
    ranked = ranked_sources(sizes, source)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limited = cut(ranked.withColumns({"_weight": weight, "_limit": most * F.col("source_size").cast("double")}))
    level = 0.0
    while True:
        over = F.col("_limit") <= F.lit(level) * F.col("_weight")
        total, spent, free = limited.agg(
            F.sum(F.col("source_size").cast("double")), F.sum(F.when(over, F.col("_limit")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_weight")))
        ).first()
        if not total or not free:
            level = float("inf")
            break
        new = max(0.0, total_share * total - spent) / free
        if new <= level:
            break
        level = new
    target = F.least("_limit", F.lit(level) * F.col("_weight")) if level != float("inf") else F.col("_limit")
    return limited.select(source, "source_size", target.alias("target"))


def thresholds(thin: DataFrame, goals: DataFrame, source: str) -> DataFrame:
    """(source, whole, cut_hash, cut_rows, cut_take): where the hash order of every source meets its budget.

    ``whole`` copies of all rows, and one more of rows whose hash is below ``cut_hash``; of the ``cut_rows`` rows with
    exactly that hash, ``cut_take`` more. The first histogram has the sums of sizes by the top bits of the hash; each
    further one only looks into the bucket that holds the budget, until that bucket is one hash value. Thresholds
    of a smaller budget are never above those of a larger one, so mixes of growing budgets are nested.
    """
    whole = F.floor(F.try_divide(F.col("target"), F.col("source_size")))
    todo = goals.select(
        F.col(source).alias("_s"),
        F.coalesce(whole, F.lit(0)).cast("long").alias("whole"),
        (F.col("target") - F.coalesce(whole, F.lit(0)) * F.col("source_size")).alias("_left"),
        F.lit(0).cast("long").alias("_prefix"),
    )
    bits, done = 0, None
    while bits < 64:
        step = min(LEVEL_BITS, 64 - bits)
        bucket = F.shiftrightunsigned("_h", 64 - bits - step) if bits + step < 64 else F.col("_h")
        inside = F.col("_prefix") == (F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
        sums = (
            thin.join(todo, F.col(source).eqNullSafe(F.col("_s")) & inside)
            .groupBy("_s", bucket.alias("_b"))
            .agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
        )
        # Unsigned order: signed order with the top bit turned.
        order = F.col("_b").bitwiseXOR(F.lit(-(2**63))) if bits + step == 64 else F.col("_b")
        run = Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        found = sums.withColumn("_upto", F.sum("_sum").over(run)).alias("f")
        t = todo.alias("t")
        joined = found.join(t, F.col("f._s").eqNullSafe(F.col("t._s")))
        # The bucket with the budget: the first whose running sum is above it. None: the budget takes all rows.
        hit = (
            joined.filter((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_sum") <= F.col("_left")))
            .select("t._s", "whole", (F.col("_left") - (F.col("_upto") - F.col("_sum"))).alias("_left"), F.col("_b").alias("_prefix"), "_sum", "_n", "_lo", "_hi")
        )
        hit = cut(hit)
        take = F.least(F.round(F.col("_left") / (F.col("_sum") / F.col("_n"))), F.col("_n"))
        ended = hit.filter("_lo = _hi").select(
            F.col("_s").alias(source), "whole", F.col("_lo").alias("cut_hash"), F.col("_n").alias("cut_rows"), take.cast("long").alias("cut_take")
        )
        done = ended if done is None else done.unionByName(ended)
        todo = hit.filter("_lo <> _hi").select("_s", "whole", "_left", "_prefix")
        bits += step
        if not todo.head(1):
            break
    return done


def mix(
    docs: DataFrame, size, source: str = "source", key: tuple[str, ...] = ("doc_id", "text"), weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST_REPEATS
) -> DataFrame:
    """All columns of ``docs`` with ``mix_size``, ``source_size``, ``target`` and ``copies`` (0 to ``most``, how often the mix takes the row).

    ``size`` is a column expression, nulls counting 0. A row's place in its source is a hash of ``key``, so a rerun
    takes the same rows, on any partitioning. Rows of one source with the same key value stand at the same place; where
    a budget ends there, as many of them as come nearest are taken, told apart by a written copy of those rows only.
    The source column may be null (a source of its own). Sources without words and empty tables give no copies. Sources
    of any size are summed up in the map tasks; no rows are sorted. The four output columns replace columns of the input
    of these names, so ``size`` may not refer to them afterwards.
    """
    h, out = fresh(docs, "h"), [c for c in docs.columns if c not in ("mix_size", "source_size", "target", "copies")]
    sized = docs.withColumns({h: F.xxhash64(*[F.col(k) for k in key]), "mix_size": F.coalesce(size, F.lit(0)).cast("long")})
    thin = cut(sized.select(F.col(source).alias("_source"), F.col("mix_size").alias("size"), F.col(h).alias("_h")))
    placed = thin.filter("size > 0")
    goals = cut(targets(thin.groupBy("_source").agg(F.sum("size").alias("source_size")), "_source", weights, total_share, most))
    ends = cut(thresholds(placed, goals, "_source"))
    g, e = goals.alias("g"), ends.alias("e")
    name = {c: fresh(sized, f"mix_{c}") for c in ("source", "source_size", "target", "whole", "cut_hash", "cut_rows", "cut_take")}
    plan = cut(
        g.join(e, F.col("g._source").eqNullSafe(F.col("e._source")), "left").select(
            F.col("g._source").alias(name["source"]), F.col("source_size").alias(name["source_size"]), F.col("target").alias(name["target"]),
            F.coalesce("whole", F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long").alias(name["whole"]),
            *[F.col(c).alias(name[c]) for c in ("cut_hash", "cut_rows", "cut_take")],
        )
    )
    joined = sized.join(plan, F.col(source).eqNullSafe(F.col(name["source"])), "left")
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(2**63)))
    at, rows, take = (F.col(name[c]) for c in ("cut_hash", "cut_rows", "cut_take"))
    tied = F.coalesce((F.col("mix_size") > 0) & (F.col(h) == at) & take.between(1, rows - 1), F.lit(False))
    under = F.coalesce((flip(h) < flip(name["cut_hash"])) | ((F.col(h) == at) & (take >= rows)), F.lit(False))
    copies = lambda extra: F.when(F.col("mix_size") > 0, F.col(name["whole"]) + extra.cast("long")).otherwise(0).cast("long")
    final = lambda df, extra: df.select(*out, "mix_size", *[F.col(name[c]).alias(c) for c in ("source_size", "target")], copies(extra).alias("copies"))
    settled = final(joined.filter(~tied), under)
    if not plan.filter(take.between(1, rows - 1)).head(1):
        return settled
    place = fresh(docs, "place")
    ties = positions(joined.filter(tied), source, name=place)
    return settled.unionByName(final(ties, F.col(place) < take))
