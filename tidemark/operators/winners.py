"""One row per key without sorting or shuffling the rows whose key occurs once.

Keys are hashed to 64 bits and counted by a hash aggregate over longs. The hashes that repeat become a bitmap of bounded
size, which goes to every task: rows outside of it pass as they are, with their texts, and only the others are grouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: Bits of the map: 16 for each repeated key, at most 2^26, which are 2^20 words of 64 bits (16 MB sent to a task). A fuller
#: map sends more lone rows through the grouping and changes no result.
MAP_BITS = 26


def split_repeated(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key surely occurs once, all other rows); nulls are key values like others.

    Runs one job over the key columns. ``df`` is read once more for each of the two frames, so write it first if it is dear.
    """
    h = F.xxhash64(*keys)
    repeated = cut(df.select(h.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h"))
    size = 1 << min(MAP_BITS, max(10, (16 * repeated.count()).bit_length()))
    cell = lambda c: F.pmod(c, F.lit(size))
    bit = F.expr(f"shiftleft(1L, cast(pmod(_h, {size}) % 64 as int))")
    words = repeated.groupBy(F.shiftright(cell(F.col("_h")), 6).alias("_w")).agg(F.bit_or(bit).alias("_v"))
    marked = df.withColumn("_h", h).withColumn("_w", F.shiftright(cell(F.col("_h")), 6)).join(F.broadcast(words), "_w", "left")
    hit = F.coalesce(F.expr(f"getbit(_v, cast(pmod(_h, {size}) % 64 as int)) = 1"), F.lit(False))
    return marked.filter(~hit).select(df.columns), marked.filter(hit).select(df.columns)


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the one that comes last in the given order; columns as in ``df``.

    Copies of a key are combined before the shuffle, so a key that a third of all rows share is a row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    lone, repeated = split_repeated(df, keys)
    best = repeated.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_b"))
    return lone.select(df.columns).unionByName(best.select(*keys, *[f"_b.{c}" for c in rest]).select(df.columns))


def largest_n(df: DataFrame, n: int, value: str, tie: str, small: int = 100_000) -> DataFrame:
    """The n rows of largest ``value`` (a long), of equal ones those of the smallest ``tie`` (a string, unique): ORDER BY value
    DESC, tie LIMIT n, without a global sort or one task that gathers n rows.

    The cut is found in histograms of at most 4,096 cells over the range that holds it, then among rows tied at the cut in
    counts by one more leading character a round. Rows are ranked only in the last group of those, of about ``small`` rows.
    Null values come last and are never taken.
    """
    rows = cut(df)
    known = rows.filter(F.col(value).isNotNull())
    total, lo, hi = known.agg(F.count(F.lit(1)), F.min(value), F.max(value)).first()
    if n <= 0:
        return rows.limit(0)
    if total <= n:
        return known
    need = n
    while lo < hi:
        width = (hi - lo) // 4096 + 1
        cells = known.filter(F.col(value).between(lo, hi)).groupBy(F.expr(f"({value} - {lo}) div {width}").alias("c")).count().collect()
        for c, m in sorted(map(tuple, cells), reverse=True):
            if m >= need:
                lo, hi = lo + c * width, min(hi, lo + (c + 1) * width - 1)
                break
            need -= m
    tied = known.filter(F.col(value) == lo)
    prefix, left, ended = "", tied.count(), False
    while left > max(need, small):
        k = len(prefix) + 1
        own = tied.filter(F.left(tie, F.lit(k - 1)) == prefix) if prefix else tied
        groups = own.groupBy(F.left(tie, F.lit(k)).alias("g")).count().collect()  # as many as characters follow the prefix
        for g, m in sorted((tuple(r) for r in groups), key=lambda r: r[0].encode()):
            if m >= need:
                prefix, left = g, m
                break
            need -= m
        ended = len(prefix) < k  # the group is the one value that ends here
        if ended:
            break
    k = F.lit(len(prefix))
    taken = known.filter((F.col(value) > lo) | ((F.col(value) == lo) & (F.left(tie, k) < prefix)))
    last = tied.filter((F.col(tie) if ended else F.left(tie, k)) == prefix) if prefix or ended else tied
    if left > need:
        from pyspark.sql import Window

        ranked = last.withColumn("_rank", F.row_number().over(Window.partitionBy(F.left(tie, k)).orderBy(tie)))
        last = ranked.filter(F.col("_rank") <= need).drop("_rank")
    return taken.unionByName(last)
