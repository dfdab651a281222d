"""Contiguous shards of the smallest possible largest size, over atomic groups in hash order."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: Bits of the group hash that each further histogram resolves; the first has 4,096 ranges, each later one 256 for a range.
FIRST_BITS, STEP_BITS = 12, 8
#: Ranges of the row hash inside which slots are numbered, for each shard.
SLOT_RANGES = 4096


class Segments:
    """Consecutive hash ranges with their sums: an outline of all groups in order, fine only where a cut may fall.

    Each item is (prefix, bits, groups, size, largest group). A range with one group can't be cut.
    """

    def __init__(self, items: list[tuple[int, int, int, int, int]]):
        self.items = sorted(items, key=lambda x: x[0] << (64 - x[1]))
        self.ends = [0]
        for x in self.items:
            self.ends.append(self.ends[-1] + x[3])
        self.total = self.ends[-1]
        self.largest = max((x[4] for x in self.items), default=0)

    def whole_step(self, start: int, capacity: int) -> int:
        """Index of the last range end that a shard from range ``start`` on reaches without cutting a range."""
        return bisect.bisect_right(self.ends, self.ends[start] + capacity) - 1

    def reach(self, position: int, capacity: int) -> int:
        """Size position that a shard from ``position`` on can't get beyond, ranges of several groups cut anywhere."""
        end = position + capacity
        if end >= self.total:
            return self.total
        i = bisect.bisect_right(self.ends, end) - 1
        return end if self.items[i][2] > 1 else max(self.ends[i], position)

    def walk(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy cuts, as range indexes, or None if ``shards`` shards of this capacity don't hold everything."""
        at, cuts = 0, []
        for _ in range(shards):
            at = self.whole_step(at, capacity)
            cuts.append(at)
        return cuts if at == len(self.items) else None

    def bound(self, capacity: int, shards: int) -> list[int]:
        at, ends = 0, []
        for _ in range(shards):
            at = self.reach(at, capacity)
            ends.append(at)
        return ends

    def smallest(self, feasible, low: int, high: int) -> int:
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if feasible(middle) else (middle + 1, high)
        return low

    def bracket(self, shards: int) -> tuple[int, int]:
        """Capacities between which the smallest feasible one lies: if ranges could be cut anywhere, and if nowhere."""
        low = max(-(-self.total // shards), self.largest)
        low = self.smallest(lambda c: self.bound(c, shards)[-1] >= self.total, low, self.total)
        return low, self.smallest(lambda c: self.walk(c, shards) is not None, low, self.total)

    def open_ranges(self, shards: int, low: int, high: int) -> list[int]:
        """Ranges of several groups in which a greedy cut may fall for a capacity in the bracket."""
        at, found = 0, set()
        for upper in self.bound(high, shards)[:-1]:
            at = self.whole_step(at, low)
            last = min(bisect.bisect_left(self.ends, upper), len(self.items))
            found |= {i for i in range(at, last) if self.items[i][2] > 1}
        return sorted(found)

    def even_cuts(self, capacity: int, shards: int) -> list[int]:
        """Cuts of shards within the capacity, each as near to an equal part of what is left as the rest allows."""
        latest, at = [len(self.items)], len(self.items)
        for _ in range(shards - 1):  # the earliest place for each cut, walked from the end
            at = bisect.bisect_left(self.ends, self.ends[at] - capacity)
            latest.append(at)
        earliest = latest[::-1]
        cuts, at = [], 0
        for k in range(shards - 1):
            goal = self.ends[at] + (self.total - self.ends[at]) / (shards - k)
            i = bisect.bisect_left(self.ends, goal)
            if i > at and goal - self.ends[i - 1] < self.ends[min(i, len(self.items))] - goal:
                i -= 1
            at = max(earliest[k], min(i, self.whole_step(at, capacity)), at)
            cuts.append(at)
        return cuts


def _histogram(groups: DataFrame, bits: int, within: list[tuple[int, int]] | None) -> list[tuple[int, int, int, int, int]]:
    """Ranges of ``bits`` bits with their sums; ``within``: only inside these (prefix, bits) ranges."""
    prefix = F.shiftrightunsigned("g", 64 - bits) if bits < 64 else F.col("g")
    if within is not None:
        parents: dict[int, list[int]] = {}
        for p, b in within:
            parents.setdefault(b, []).append(p)
        spark = groups.sparkSession
        rows = [(b, p if p < 2**63 else p - 2**64) for b, ps in parents.items() for p in ps]
        wanted = spark.createDataFrame(rows, "b int, p long")
        (b,) = parents
        groups = groups.join(F.broadcast(wanted.filter(F.col("b") == b).select(F.col("p").alias("_p"))), F.shiftrightunsigned("g", 64 - b) == F.col("_p"))
    rows = groups.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.max("size").alias("m")).collect()
    return [(r.p % 2**64, bits, r.n, int(r.s), int(r.m)) for r in rows]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """(first hash of every shard but the first, capacity) for ``groups`` (g long: hash order unsigned, size long).

    The smallest capacity that ``shards`` contiguous shards can have is binary-searched, each probe being a greedy walk.
    The walk runs on sums of hash ranges. Ranges in which a cut may fall are resolved by further histograms until the
    walk that may cut ranges and the one that may not agree, which makes the capacity exact over single groups.
    The driver holds 4,096 range sums and 256 for each range resolved, whatever the number of groups.
    """
    outline = Segments(_histogram(groups, FIRST_BITS, None))
    if not outline.items:
        return [], 0

    def resolve(indexes: list[int]) -> Segments:
        chosen, items = set(indexes), [x for i, x in enumerate(outline.items) if i not in set(indexes)]
        for bits in {outline.items[i][1] for i in chosen}:
            within = [(outline.items[i][0], bits) for i in chosen if outline.items[i][1] == bits]
            items += _histogram(groups, min(64, bits + STEP_BITS), within)
        return Segments(items)

    while True:
        low, high = outline.bracket(shards)
        ranges = outline.open_ranges(shards, low, high)
        if low == high or not ranges:
            break
        outline = resolve(ranges)
    while True:  # the same for the cuts themselves: none may border a range that a nearer cut could split
        cuts = outline.even_cuts(high, shards)
        near = {i for c in cuts for i in (c - 1, c) if 0 <= i < len(outline.items) and outline.items[i][2] > 1}
        if not near:
            break
        outline = resolve(sorted(near))
    ends = len(outline.items)
    return [outline.items[c][0] << (64 - outline.items[c][1]) if c < ends else 2**64 for c in cuts], high


def shard(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of ``docs``: law ``bytes``.

    Size is the UTF-8 bytes of the text plus 1, a null text having none. Rows of equal texts (null and empty are equal)
    are an atomic group and stay together; groups follow each other in hash order and are cut into ``shards`` contiguous
    shards whose largest size is as small as can be, then as even as that allows. Two texts whose 64-bit hashes agree
    count as one group, which is still a valid sharding. Slots count each shard's rows from 0 without gaps, in an order
    that depends on key and text alone. Rows may repeat; a shard may be empty when groups are fewer than shards.
    The hash thresholds are literals in a projection: no row is moved to get its shard. Slots are numbered inside
    4,096 hash ranges a shard, rows that agree in everything being counted as one before, so a hot text or key is
    never in one task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(
        F.col(key).alias("key"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("g")
    )
    thin = cut(thin.groupBy("key", "size", "text_crc32", "g").agg(F.count(F.lit(1)).alias("rows")))
    groups = cut(thin.groupBy("g").agg(F.sum(F.col("size") * F.col("rows")).alias("size")))
    starts, _ = minimax_cuts(groups, shards)
    flip = lambda x: x - 2**63  # noqa: E731  unsigned order as signed order
    order = F.col("g").bitwiseXOR(F.lit(-(2**63)))
    number = F.lit(0)
    for s in starts:
        number = number + (F.lit(False) if s >= 2**64 else order >= F.lit(flip(s))).cast("int")
    placed = thin.withColumn("shard", number).withColumn("range", F.pmod(F.xxhash64("key", "g"), F.lit(SLOT_RANGES)).cast("int"))
    counts = placed.groupBy("shard", "range").agg(F.sum("rows").alias("n"))
    upto = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "range").orderBy("key", "g", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("before", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    slots = numbered.join(F.broadcast(offsets), ["shard", "range"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    return slots.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("offset") + F.col("before") + F.col("copy")).alias("slot"))
