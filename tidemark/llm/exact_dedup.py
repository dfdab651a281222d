"""Exact deduplication by an extendible-hash index: a directory of key ranges, owner tasks that chain and compare bytes.

A key is the 64-bit hash of a text. The index starts as one bucket that owns all keys; a bucket with more text than its
capacity is split at its next bit, and where its depth is the directory's, the directory doubles: each of its slots is a
prefix of the key and names the bucket that owns it. Every bucket is one contiguous range of keys, and one task owns it.
Equal texts are folded in the tasks that read them, so a text that a third of all rows share reaches its owner a few times.
Only texts whose key occurs twice move at all. The owner keeps a chain of the different texts of a key and compares bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import byte_lengths, steps, text_of
from tidemark.session import cut

#: Bytes of different texts that a bucket may own before it is split.
CAPACITY = 4_000_000
#: Bits of a key that the directory may use: at most 65,536 slots, and as many sums on the driver. A bucket of that depth
#: is split no further; its owner streams through it key by key, so only its time grows.
MOST_DEPTH = 16
#: Bits of the map of repeated keys: at least 16 for each of them up to this many, which are 2^20 words of 64 bits (16 MB).
#: A fuller map lets more texts through to their owners and changes no result.
MAP_BITS = 26
#: Bytes of different texts that a reading task holds before it passes them on.
HELD_BYTES = 24_000_000


@dataclass(frozen=True)
class Directory:
    """``slots[p]`` is the bucket that owns the keys whose first ``depth`` bits are ``p``; ``depths`` has each bucket's own."""

    depth: int
    slots: tuple[int, ...]
    depths: tuple[int, ...]

    @staticmethod
    def build(cells: dict[int, int], capacity: int = CAPACITY, bits: int = MOST_DEPTH) -> Directory:
        """From the bytes under every prefix of ``bits`` bits."""
        sums = [dict(cells)]
        for _ in range(bits):
            half: dict[int, int] = {}
            for prefix, n in sums[0].items():
                half[prefix >> 1] = half.get(prefix >> 1, 0) + n
            sums.insert(0, half)
        depth, slots, depths = 0, [0], [0]
        full = [(0, 0, 0)] if sums[0].get(0, 0) > capacity else []  # (bucket, its depth, its prefix)
        while full:
            bucket, own, prefix = full.pop()
            if own == bits:
                continue
            if own == depth:
                slots = [b for b in slots for _ in range(2)]
                depth += 1
            new = len(depths)
            depths.append(own + 1)
            depths[bucket] = own + 1
            width = 1 << (depth - own - 1)
            first = (2 * prefix + 1) * width
            slots[first : first + width] = [new] * width
            full += [(b, own + 1, p) for b, p in ((bucket, 2 * prefix), (new, 2 * prefix + 1)) if sums[own + 1].get(p, 0) > capacity]
        return Directory(depth, tuple(slots), tuple(depths))


class Chains:
    """Of each key the different texts with their number of rows, largest id and number of rows of that id."""

    def __init__(self):
        self.of: dict[int, list[list]] = {}
        self.held = 0

    def add(self, key: int, text: bytes, rows: int, top, tops: int) -> None:
        chain = self.of.setdefault(key, [])
        for link in chain:
            if link[0] == text:
                link[1] += rows
                if top == link[2]:
                    link[3] += tops
                elif link[2] is None or top is not None and top > link[2]:
                    link[2:] = top, tops
                return
        chain.append([text, rows, top, tops])
        self.held += len(text) + 200

    def take(self, names: list[str], kind: pa.DataType, seal=None):
        """All links as batches of bounded size; ``seal`` turns the text of a link into what leaves the task."""
        flat = [(key, *link) for key, chain in self.of.items() for link in chain]
        self.of, self.held = {}, 0
        for start, stop in steps(np.array([len(x[1]) + 50 for x in flat], dtype=np.int64), 8_000_000):
            keys, texts, rows, top, tops = zip(*flat[start:stop], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(map(seal, texts) if seal else texts, pa.binary()), pa.array(rows, pa.int64()), pa.array(top, kind), pa.array(tops, pa.int64())], names=names
            )


_LINK = ["h", "body", "rows", "top", "tops"]


def _fold(batches, kind: pa.DataType):
    """Equal texts of a task as one link; what it holds is bounded by ``HELD_BYTES``."""
    chains = Chains()
    for batch in batches:
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        bodies = batch.column(2)
        for start, stop in steps(byte_lengths(bodies)):
            for i, text in enumerate(bodies.slice(start, stop - start).to_pylist(), start):
                chains.add(keys[i], text, 1, ids[i], 1)
            if chains.held > HELD_BYTES:
                yield from chains.take(_LINK, kind)
    yield from chains.take(_LINK, kind)


def _own(batches, kind: pa.DataType):
    """The owner's work: links come in the order of their keys; a key's chain ends where the next key begins."""
    import hashlib

    names = ["h", "sha", "rows", "top", "tops"]
    seal = lambda text: hashlib.sha256(text).digest()
    chains, last = Chains(), None
    done: list[pa.RecordBatch] = []
    for batch in batches:
        keys, bodies = batch.column(0).to_pylist(), batch.column(1)
        rest = [batch.column(i).to_pylist() for i in (2, 3, 4)]
        for start, stop in steps(byte_lengths(bodies)):
            for i, text in enumerate(bodies.slice(start, stop - start).to_pylist(), start):
                if keys[i] != last and chains.held > HELD_BYTES:
                    done += chains.take(names, kind, seal)
                last = keys[i]
                chains.add(last, text, *(x[i] for x in rest))
            yield from done
            done = []
    yield from chains.take(names, kind, seal)


def _map_bits(n: int) -> int:
    """Bits of the map for ``n`` repeated keys, as a power of two."""
    return min(MAP_BITS, max(12, (16 * n).bit_length()))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows are equal if their whole texts are the same bytes; a null text is the empty text. Of equal rows the one with the
    largest key stays (``keep_id``), nulls below all others. Where several rows of a group have that key, exactly one of them
    has ``kept``. ``group_size`` (long) counts the rows of the group, ``text_sha256`` is lowercase hex. An empty table gives
    no rows; other columns of ``docs`` play no part, whatever their names. Long texts are single values of their row.

    Work: one pass over all texts for keys and digests, which are written; one for the texts whose key is in the map of
    repeated keys. Rows and groups meet by (key, digest) in a plain join, whose large keys Spark splits.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(key).alias("id"), text_of(text).alias("body"))
    entries = body.select("id", F.xxhash64("body").alias("h"), F.unhex(F.sha2("body", 256)).alias("sha"), F.octet_length("body").alias("size"))
    entries = cut(entries.withColumn("row", F.monotonically_increasing_id()))

    # Keys that occur twice or more, and the bytes that one text of each has.
    repeated = cut(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("size").cast("long").alias("size")).filter("n > 1").select("h", "size"))
    prefix = lambda bits: F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    cells = repeated.groupBy(prefix(MOST_DEPTH).alias("p")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("keys")).collect()
    directory = Directory.build({r.p: r.n for r in cells}, capacity)
    bits = _map_bits(sum(r["keys"] for r in cells))
    place = F.pmod("h", F.lit(1 << bits))
    one = F.expr(f"shiftleft(1L, cast(pmod(h, {1 << bits}) % 64 as int))")
    # At most 2^(MAP_BITS - 6) rows of two longs.
    words = F.broadcast(repeated.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(one).alias("v")))

    kind = to_arrow_type(docs.schema[key].dataType)
    links = T.StructType([T.StructField("h", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("rows", T.LongType()), T.StructField("top", docs.schema[key].dataType), T.StructField("tops", T.LongType())])
    likely = body.withColumn("h", F.xxhash64("body")).withColumn("w", F.shiftright(place, 6)).join(words, "w").filter(F.expr(f"getbit(v, cast(pmod(h, {1 << bits}) % 64 as int))") == 1)
    folded = likely.select("id", "h", F.col("body").cast("binary").alias("body")).mapInArrow(partial(_fold, kind=kind), links)
    slots = F.broadcast(spark.createDataFrame(list(enumerate(directory.slots)), "slot long, bucket int"))
    owned = folded.join(slots, prefix(directory.depth) == F.col("slot")).repartition("bucket").sortWithinPartitions("bucket", "h").select(*_LINK)
    classes = T.StructType([T.StructField("sha", T.BinaryType()) if f.name == "body" else f for f in links])
    groups = cut(owned.mapInArrow(partial(_own, kind=kind), classes))

    best = F.col("id").eqNullSafe(F.col("top"))
    # Several rows with the largest id: the first of them stays. Only those rows are looked at once more.
    tied = entries.join(groups.filter("tops > 1").select("h", "sha", "top"), ["h", "sha"]).filter(best).groupBy("h", "sha").agg(F.min("row").alias("first"))
    several = cut(groups.filter("rows > 1").join(tied, ["h", "sha"], "left"))
    # The one join of all rows stands alone, so that Spark may split a key that very many of them share.
    found = entries.select("id", "h", "sha", "row").join(several, ["h", "sha"], "left")
    return found.select(
        F.col("id").alias(key),
        F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("top")).alias("keep_id"),
        F.coalesce("rows", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("rows").isNull(), True).when(F.col("tops") > 1, F.col("row") == F.col("first")).otherwise(best).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

