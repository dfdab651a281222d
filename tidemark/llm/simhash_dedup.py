"""SimHash near-duplicates: every pair of fingerprints within a radius, found by tiles of exclusive-or and bit counts."""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import LOWER_ASCII, Forest, fresh, schema_with, text_of, text_steps, with_columns
from tidemark.llm.components import components
from tidemark.session import cut

SEED = 42
#: Words whose shingles are hashed at a time, so a very long text needs no more memory than this.
STEP_WORDS = 200_000
#: Fingerprints of one tile.
TILE = 65_536
#: Widths of the parts of a fingerprint whose population counts name a cell.
PARTS = (22, 21, 21)


def _word_runs(text: bytes, shingle: int, step: int):
    """Lower-cased words of a text, some at a time; every run after the first begins with the last ``shingle - 1`` words.

    A long text is cut into slices of bytes first, each ending at white space, so no list of all its words exists.
    """
    chunk, start, carry, found = 16 * step, 0, [], False
    while start < len(text):
        stop = min(len(text), start + chunk)
        if stop < len(text):
            back = max(text.rfind(bytes([c]), start, stop) for c in (32, 9, 10, 11, 12, 13))
            while back <= start and stop < len(text) and text[stop] not in b" \t\n\x0b\x0c\r":
                stop += 1  # a word longer than the slice
            stop = back + 1 if back > start else stop
        words = carry + text[start:stop].translate(LOWER_ASCII).split()
        start = stop
        if start < len(text) and len(words) < shingle:
            carry = words
            continue
        if len(words) > len(carry) or not found:
            found = True
            yield words
        carry = words[-(shingle - 1) :] if shingle > 1 else []


def simhash(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text: a bit is set if it is in more than half of the shingle hashes."""
    from xxhash import xxh64_intdigest as digest

    ones, n = np.zeros(64, np.int64), 0
    for words in _word_runs(text, shingle, STEP_WORDS):
        if not words:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        if len(words) < shingle:
            hashes = [digest(line, SEED)]
        else:
            starts = np.concatenate([[0], ends[:-1] + 1])
            hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _hash_batches(batches, text: str, keep: list[str], shingle: int):
    for batch in batches:
        found = []
        for _, _, raw in text_steps(batch.column(batch.schema.get_field_index(text))):
            found += [simhash(x, shingle) for x in raw]
        yield with_columns(batch, keep, fp=pa.array(np.array(found, np.uint64).view(np.int64)))


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """``keep`` columns with ``fp`` (long, the 64 bits): SimHash of the text, A-Z lower-cased, words split at ASCII white space.

    Shingles are ``shingle`` words, space-joined, repeats included; a shorter text is one shingle. A text without words,
    or a null, has fingerprint 0. Hash: XXH64, seed 42. ``keep`` must not name ``fp``.
    """
    body = fresh(df, "body")
    lean = df.select(*keep, text_of(text).alias(body))
    return lean.mapInArrow(partial(_hash_batches, text=body, keep=keep, shingle=shingle), schema_with(lean, keep, fp=T.LongType()))


def _compare(a: np.ndarray, b: np.ndarray, radius: int, same: bool, forest: Forest, block: int = 1024) -> None:
    """Add all links between two sorted tiles; pairs of blocks too far apart in population counts are skipped."""
    counts = [np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4)).astype(np.int16) for x in (a, b)]
    signed = [x.view(np.int64) for x in (a, b)]
    spans = []
    for c in counts:
        at = range(0, len(c), block)
        spans.append((np.array([c[i : i + block].min(axis=0) for i in at]), np.array([c[i : i + block].max(axis=0) for i in at])))
    (low_a, high_a), (low_b, high_b) = spans
    for i in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_b - high_a[i], low_a[i] - high_b)).sum(axis=1)
        rows = a[i * block : (i + 1) * block, None]
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            near = np.bitwise_count(rows ^ b[None, j * block : (j + 1) * block]) <= radius
            if same and i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                forest.add(signed[0][i * block + x], signed[1][j * block + y])


def _ordered(fp: np.ndarray) -> np.ndarray:
    """Fingerprints in order of the population counts of their four 16-bit parts, so that blocks are narrow."""
    c = np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4))
    return fp[np.lexsort(c.T)]


def _tile_links(key, group: pa.Table, radius: int) -> pa.Table:
    fp = group.column("fp").to_numpy().view(np.uint64)
    home = group.column("home").to_numpy(zero_copy_only=False).astype(bool)
    a, b = _ordered(fp[home]), _ordered(fp[~home])
    forest = Forest()
    if len(a):
        if key[2].as_py() == 0:
            _compare(a, a, radius, True, forest)
        if len(b):
            _compare(a, b, radius, False, forest)
    node, root = forest.edges()
    return pa.table({"a": pa.array(node, pa.int64()), "b": pa.array(root, pa.int64())})


def _cell_plan(sizes: dict[tuple[int, ...], int], radius: int, tile: int) -> list[tuple]:
    """For every cell: its tiles, the tile numbers its own fingerprints meet, and the cells they visit.

    Two fingerprints within the radius differ by no more than it in the sum of the differences of their parts'
    population counts, so a cell's fingerprints visit only cells at such a distance that come later in order.
    """
    tiles = {c: -(-n // tile) for c, n in sizes.items()}
    names = {c: i for i, c in enumerate(sorted(sizes))}
    width = len(next(iter(sizes), ()))
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=width) if any(d) and sum(map(abs, d)) <= radius]
    meets = dict(tiles)
    visits = {c: [] for c in tiles}
    for c in tiles:
        for d in steps:
            other = tuple(x + y for x, y in zip(c, d, strict=True))
            if other in tiles and other > c:
                visits[c].append((names[other], tiles[other]))
                meets[other] = max(meets[other], tiles[c])
    return [(*c, names[c], tiles[c], meets[c], visits[c]) for c in tiles]


def near_links(prints: DataFrame, radius: int = 3, parts: tuple[int, ...] = PARTS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``prints.fp`` into the classes of "at most ``radius`` bits apart".

    Exact: every pair that can be within the radius is compared, by exclusive-or and bit counts over tiles. A cell is a
    vector of population counts of the parts (at most 23 x 22 x 22 cells, whose sizes the driver holds); large cells
    are cut into tiles of about ``tile``. Each pair of tiles meets in one group, which returns a forest of its links and
    never the links themselves.
    """
    shifts = [sum(parts[i + 1 :]) for i in range(len(parts))]
    count = [F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(2**w - 1))).cast("int").alias(f"p{i}") for i, (w, s) in enumerate(zip(parts, shifts, strict=True))]
    celled = prints.select("fp", *count)
    names = [f"p{i}" for i in range(len(parts))]
    sizes = {tuple(r[n] for n in names): r["n"] for r in celled.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = ", ".join(f"{n} int" for n in names) + ", cell int, tiles int, meets int, visits array<struct<cell:int,tiles:int>>"
    plan = prints.sparkSession.createDataFrame(_cell_plan(sizes, radius, tile), schema)
    placed = celled.join(F.broadcast(plan), names).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    at = lambda cell, home, visitor, is_home: F.struct(cell.alias("cell"), home.alias("tile"), visitor.alias("met"), F.lit(is_home).alias("home"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own, cell = F.col("tile"), F.col("cell")
    at_home = F.transform(upto(F.col("meets")), lambda v: at(cell, own, v, True))
    lower = F.when(own > 0, F.transform(upto(F.greatest(own, F.lit(1))), lambda h: at(cell, h, own, False))).otherwise(F.expr("array()"))
    away = F.flatten(F.transform("visits", lambda v: F.transform(upto(v["tiles"]), lambda h: at(v["cell"], h, own, False))))
    rows = placed.select("fp", F.explode(F.concat(at_home, lower, away)).alias("g")).select("fp", "g.*")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return _tile_links(key, group, radius)

    return rows.groupBy("cell", "tile", "met").applyInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """(key, fp, component_id) for every row: rows whose fingerprints are linked, directly or through others, share a component.

    ``component_id`` is the smallest key of the component (null keys are ignored; null if it has no other). Equal
    fingerprints are folded to one before anything is compared, so a group of copies of any size costs one fingerprint.
    Texts without words have fingerprint 0 and are linked like any other. An empty table gives an empty result.
    """
    rows = cut(fingerprints(df.select(F.col(key).alias("key"), F.col(text).alias("text")), ["key"], "text", shingle))
    prints = cut(rows.groupBy("fp").agg(F.min("key").alias("least")))
    links = cut(near_links(prints, radius))
    roots = components(links)
    classes = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")
