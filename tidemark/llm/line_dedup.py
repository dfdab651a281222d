"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, one line kept per component."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Forest, fresh, schema_with, text_of, text_steps, with_columns
from tidemark.llm.components import components
from tidemark.session import cut

#: Characters of a shingle, least Jaccard similarity of a link.
SHINGLE, SIMILARITY = 7, 0.8
#: A signature of BANDS x ROWS minima; lines of similarity 0.8 share a band with a chance of 0.998, of 0.9 with 0.99999.
BANDS, ROWS = 12, 4
BLANK = " \t\n\x0b\x0c\r"
_BLANK = BLANK.encode()
#: Rows of one band value that one task may get beyond twice the mean of its cell; more are dealt by the line's hash.
BUCKET_ROWS = 200_000
CELLS = 1 << 14
#: Lines on either side of one comparison of a bucket whose lines are not all like its smallest.
TILE = 256
#: Bits of the map of line hashes whose text is wanted: 2 MB, whatever the number of lines.
MAP_BITS = 1 << 24

_EMPTY = np.uint32(0xFFFFFFFF)


def line_hash(line: bytes) -> int:
    """The hash that Spark's xxhash64 gives the line as a string."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(line, 42)
    return h - (1 << 64) if h >> 63 else h


def _mix32(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return h


def signatures(lines: list[str], shingle: int = SHINGLE, bins: int = BANDS * ROWS) -> np.ndarray:
    """One minimum of the shingle hashes for each of ``bins`` parts of the hash range, for lines of at least one shingle.

    One hash function serves all bins (one-permutation MinHash); a bin that no shingle falls in borrows the value of
    another one, picked by a fixed sequence of the bin's own, so two lines borrow alike.
    """
    n = len(lines)
    points = np.frombuffer("\n".join(lines).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, lines), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    h = np.zeros(len(points) - shingle + 1, np.uint32)
    for i in range(shingle):
        h *= np.uint32(0x01000193)
        h += points[i : i + len(h)]
    h = _mix32(h)
    owner = np.repeat(np.arange(n, dtype=np.int32), lengths - shingle + 1)
    inside = np.zeros(len(points) + 1, np.int8)
    inside[starts] += 1
    np.add.at(inside, starts + lengths - shingle + 1, -1)
    h = h[np.cumsum(inside[: len(h)], dtype=np.int8).astype(bool)]
    slot = owner.astype(np.int64) * bins + ((h.astype(np.uint64) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    out = np.full(n * bins, _EMPTY, np.uint32)
    np.minimum.at(out, slot, h)
    out = out.reshape(n, bins)
    empty, known = out == _EMPTY, out.copy()
    line, bin_ = np.nonzero(empty)
    attempt = 0
    while len(line):
        attempt += 1
        source = _mix32(bin_.astype(np.uint32) * np.uint32(2654435761) + np.uint32(attempt)) % np.uint32(bins) if attempt < 8 * bins else (bin_ + attempt) % bins
        value = known[line, source.astype(np.int64)]
        out[line, bin_] = value
        left = value == _EMPTY
        line, bin_ = line[left], bin_[left]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each line; the band's number is part of it."""
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for r in range(parts.shape[2]):
        h = (h ^ parts[:, :, r]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _sign(batches, text: str, shingle: int, bands: int, rows: int):
    """(k, row, row2, head, line number, line hash, band keys) of every line with a word; ``head`` marks a row's first one.

    Bands come once a step and line.
    """
    for batch in batches:
        names = batch.schema.names
        for start, _, raw in text_steps(batch.column(names.index(text)), 1_500_000):
            place, number, hashes, new, order = [], [], [], {}, []
            for i, x in enumerate(raw, start):
                for j, line in enumerate(x.split(b"\n")):
                    line = line.strip(_BLANK)
                    if line:
                        place.append(i)
                        number.append(j)
                        h = line_hash(line)
                        hashes.append(h)
                        order.append(h in new)
                        if h not in new:
                            new[h] = line.decode("utf-8", "replace")
            long = {h: i for i, h in enumerate(h for h, line in new.items() if len(line) >= shingle)}
            if long:
                keyed = band_keys(signatures([new[h] for h in long], shingle, bands * rows), bands)
            lists = [None if again or h not in long else keyed[long[h]] for h, again in zip(hashes, order, strict=True)]
            sizes = np.array([0 if x is None else bands for x in lists], np.int32)
            flat = pa.array(np.concatenate([x for x in lists if x is not None]) if sizes.any() else np.empty(0, np.int64), pa.int64())
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            at = np.array(place, np.int64)
            head = np.ones(len(at), bool)
            head[1:] = at[1:] != at[:-1]
            told = [batch.column(names.index(c)).take(pa.array(at)) for c in ("k", "row", "row2")]
            yield pa.RecordBatch.from_arrays(
                [*told, pa.array(head), pa.array(number, pa.int32()), pa.array(hashes, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                names=["k", "row", "row2", "head", "no", "h", "bands"],
            )


def shared_buckets(signed: DataFrame) -> DataFrame:
    """(bucket, h, rep): lines that share a band value with others, with the smallest line hash of the bucket.

    A band value's rows are brought together once. Cells of band values with very many rows are dealt over several tasks
    by the line's hash; every line of every part gets the smallest of all parts.
    """
    rows = signed.select("h", F.explode("bands").alias("bucket")).withColumn("cell", F.pmod("bucket", F.lit(CELLS)).cast("int"))
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first().t
    most = 2 * total // CELLS + BUCKET_ROWS
    hot = sizes.filter(F.col("n") > most).select("cell", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    # At most total / BUCKET_ROWS and never more than CELLS rows of two numbers.
    dealt = rows.join(F.broadcast(hot), "cell", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"), F.lit(0)))
    group = Window.partitionBy("bucket", "part")
    found = dealt.select("bucket", "h", "part", F.coalesce("parts", F.lit(1)).alias("parts")).withColumns({"rep": F.min("h").over(group), "top": F.max("h").over(group)})
    found = cut(found.filter("rep <> top or parts > 1"))
    heads = found.filter("parts > 1").groupBy("bucket", "part").agg(F.min("rep").alias("head"))
    heads = heads.select("bucket", "part", F.min("head").over(Window.partitionBy("bucket")).alias("rep"))
    # Joined back by part, so that a hot band value stays dealt.
    split = found.filter("parts > 1").drop("rep").join(heads, ["bucket", "part"]).select("bucket", "h", "rep")
    return found.filter("parts = 1").select("bucket", "h", "rep").unionByName(split).filter("h <> rep").distinct()


def _pick(batches, text: str, wanted, shingle: int, bands: int, rows: int):
    """(h, line, band keys) of lines whose hash may be wanted and that have a shingle; once a step."""
    words = wanted.value
    for batch in batches:
        for _, _, raw in text_steps(batch.column(batch.schema.get_field_index(text))):
            found = {}
            for x in raw:
                for line in x.split(b"\n"):
                    line = line.strip(_BLANK)
                    if line:
                        h = line_hash(line)
                        bit = h % MAP_BITS
                        if words[bit >> 6] >> (bit & 63) & 1 and h not in found:
                            found[h] = line
            lines = {h: decoded for h, line in found.items() if len(decoded := line.decode("utf-8", "replace")) >= shingle}
            if lines:
                keys = band_keys(signatures(list(lines.values()), shingle, bands * rows), bands)
                ends = pa.array(np.arange(0, bands * len(lines) + 1, bands, dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int64()), pa.array(list(lines.values()), pa.string()), lists], names=["h", "line", "bands"])


def lines_of(docs: DataFrame, text: str, hashes: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(h, line, bands) for the wanted line hashes. A map of fixed size, sent to all tasks, spares the shuffle most other lines."""
    bit = F.pmod("h", F.lit(MAP_BITS))
    words = hashes.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {MAP_BITS}) % 64 as int))")).alias("v")).collect()
    bits = [0] * (MAP_BITS // 64)
    for r in words:
        bits[r.w] = r.v % (1 << 64)
    wanted = docs.sparkSession.sparkContext.broadcast(bits)
    picked = partial(_pick, text=text, wanted=wanted, shingle=shingle, bands=bands, rows=rows)
    likely = docs.select(text).mapInArrow(picked, "h long, line string, bands array<long>")
    return likely.join(hashes, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"), F.first("bands").alias("bands"))


def shingle_sets(lines: list[str], k: int) -> list[np.ndarray]:
    """The set of shingles of every line of at least ``k`` characters, as sorted numbers that mean the same in all of them.

    A shingle is the number whose digits are its characters, these being numbered within the call: exact, no hash. Where too
    many different characters occur for a number of 63 bits, the different shingles themselves are numbered.
    """
    if not lines:
        return []
    text = "".join(lines)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    base = int(code.max()) + 1
    if base**k >= 2**63:
        known = np.array(sorted(map(ord, set(text))), np.int64)
        code, base = np.searchsorted(known, code), len(known)
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    if base**k < 2**63:
        value = np.zeros(max(0, len(code) - k + 1), np.int64)
        for i in range(k):
            value *= base
            value += code[i : i + len(value)]
        return [np.unique(value[end - len(line) : end - k + 1]) for line, end in zip(lines, ends.tolist(), strict=True)]
    names: dict[str, int] = {}
    return [np.unique([names.setdefault(line[i : i + k], len(names)) for i in range(len(line) - k + 1)]) for line in lines]


def jaccard_at_least(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both >= least * (len(a) + len(b) - both)


def _verify(batches, shingle: int, least: float):
    """(h, rep, alike) for pairs of lines with their texts; every line of a step is cut into shingles once."""
    for batch in batches:
        h, rep, one, two = batch.columns
        for start, stop, raw in text_steps(one, 2_000_000):
            pairs = list(zip([x.decode("utf-8", "replace") for x in raw], two.slice(start, stop - start).to_pylist(), strict=True))
            lines = list({line for pair in pairs for line in pair})
            sets = dict(zip(lines, shingle_sets(lines, shingle), strict=True))
            out = [jaccard_at_least(sets[a], sets[b], least) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([h.slice(start, stop - start), rep.slice(start, stop - start), pa.array(out, pa.bool_())], names=["h", "rep", "alike"])


def _compare_tile(group: pa.Table, shingle: int, least: float) -> pa.Table:
    """Links between lines apart from their bucket's smallest and its other lines.

    Two lines that share several bands meet in as many buckets and are compared in the one of the smallest key only: there
    at least one of them stands apart, or both are connected already. Lines of one component are never compared.
    """
    bucket = group.column("bucket")[0].as_py()
    group = group.combine_chunks()
    lines = group.column("line").to_pylist()
    keys = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(lines), -1)
    roots, hashes = group.column("root").to_numpy(), group.column("h").to_pylist()
    doubtful = group.column("doubtful").to_numpy(zero_copy_only=False).astype(bool)
    left, right = np.flatnonzero(doubtful), np.flatnonzero(~doubtful)
    found = []
    for start in range(0, len(left), 64):
        i = left[start : start + 64]
        mine = keys[i][:, None, :]
        first = np.where(mine == keys[right][None, :, :], mine, np.iinfo(np.int64).max).min(axis=2)
        p, q = np.nonzero((first == bucket) & (roots[i][:, None] != roots[right][None, :]))
        found += zip(i[p].tolist(), right[q].tolist(), strict=True)
    if not found:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    wanted = list({lines[i] for pair in found for i in pair})
    # Compared many times, so as sets; the numbers are the same.
    sets = {line: set(own.tolist()) for line, own in zip(wanted, shingle_sets(wanted, shingle), strict=True)}
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    a, b = [], []
    root = roots.tolist()
    for i, j in found:
        one, two = sets[lines[i]], sets[lines[j]]
        small, large = (one, two) if len(one) < len(two) else (two, one)
        if len(small) >= least * len(large) and find(root[i]) != find(root[j]) and (both := len(small & large)) >= least * (len(small) + len(large) - both):
            parent[find(root[i])] = find(root[j])
            a.append(hashes[i])
            b.append(hashes[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _mixed_links(stars: DataFrame, roots: DataFrame, lines: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b) in buckets whose lines are not all connected by ``roots``, the components of the links found so far.

    The lines apart from the bucket's smallest are compared with all others of the bucket, tile by tile. Two lines that
    share several bands meet in as many buckets; of buckets with the same lines one is enough, and a bucket of two lines
    has nothing left to compare.
    """
    known = roots.select(F.col("node").alias("h"), F.col("component").alias("root"))
    named = stars.join(known, "h", "left").withColumn("root", F.coalesce("root", "h"))
    named = named.join(known.select(F.col("h").alias("rep"), F.col("root").alias("rep_root")), "rep", "left")
    named = named.withColumn("doubtful", F.col("root") != F.coalesce("rep_root", "rep")).select("bucket", "rep", "h", "root", "doubtful")
    sets = named.groupBy("bucket").agg(
        F.min("rep").alias("rep"), F.count(F.lit(1)).alias("n"), F.count_if("doubtful").alias("apart"),
        F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "h")).alias("y"),
    )
    chosen = sets.filter("n > 1 and apart > 0").groupBy("rep", "n", "x", "y").agg(F.min("bucket").alias("bucket"))
    sizes = chosen.select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    members = cut(named.join(sizes, "bucket"))
    own = F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = members.filter("doubtful").select("bucket", "h", "root", own.alias("i"), every.alias("j"), F.lit(True).alias("doubtful"))
    right = members.select("bucket", "h", "root", own.alias("j"), every.alias("i"), F.lit(False).alias("doubtful")).select(left.columns)
    met = left.unionByName(right).join(lines, "h").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return met.select("bucket", "i", "j", "h", "root", "doubtful", "line", "bands").mapInArrow(partial(_compare_tiles, shingle=shingle, least=least), "a long, b long")


def _compare_tiles(batches, shingle: int, least: float):
    """Links of all tiles of a partition, which come one after another; most are of a few lines, so many share a batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        ids = [table.column(c).to_numpy() for c in ("bucket", "i", "j")]
        changed = np.zeros(max(0, len(table) - 1), bool)
        for x in ids:
            changed |= x[1:] != x[:-1]
        ends = np.flatnonzero(changed) + 1
        starts = np.concatenate([[0], ends])
        for a, b in zip(starts.tolist(), ends.tolist(), strict=False):
            yield from _compare_tile(table.slice(a, b - a), shingle, least).to_batches()
        rest = table.slice(int(starts[-1])) if len(table) else rest
    if rest is not None and len(rest):
        yield from _compare_tile(rest.combine_chunks(), shingle, least).to_batches()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links: only the components that these touch go through the rounds again."""
    root = roots.select("node", "component")
    for side in ("a", "b"):
        links = links.join(root.withColumnsRenamed({"node": side, "component": f"_{side}"}), side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    moved = cut(components(links.select("a", "b")))
    again = moved.select(F.col("node").alias("component"), F.col("component").alias("new"))
    return root.join(again, "component", "left").select("node", F.coalesce("new", "component").alias("component")).unionByName(moved.select("node", "component"))


def _rebuild(batches, text: str, drops: str, copy: str, keep: list[str], name: str):
    for batch in batches:
        texts, dropped, again = (batch.column(batch.schema.get_field_index(c)) for c in (text, drops, copy))
        for start, stop, raw in text_steps(texts):
            out, counts = [], []
            for x, gone, is_copy in zip(raw, dropped.slice(start, stop - start).to_pylist(), again.slice(start, stop - start).to_pylist(), strict=True):
                lines = x.split(b"\n") if gone or is_copy else []
                lost = {i for i, line in enumerate(lines) if line.strip(_BLANK)} if is_copy else set(gone or ())
                out.append(b"\n".join([line for i, line in enumerate(lines) if i not in lost]) if lost else x)
                counts.append(len(lost))
            nulls = np.asarray(texts.slice(start, stop - start).is_null())
            part = batch.slice(start, stop - start)
            yield with_columns(part, keep, **{name: pa.array(out, pa.binary(), mask=nulls).cast(pa.string()), "n_dropped": pa.array(counts, pa.int64())})


def _with_copies(rows: DataFrame, repeated: DataFrame, row: list[str], copy: str) -> DataFrame:
    """Rows with ``copy``: true for all but one of those that agree in the columns ``row``, which ``repeated`` lists.

    Only rows that repeat are written, with the numbers that pick one of them.
    """
    number = fresh(rows, "number")
    several = cut(rows.join(repeated, row, "left_semi").withColumn(number, F.monotonically_increasing_id()))
    first = several.groupBy(*row).agg(F.min(number).alias(number)).select(number, F.lit(False).alias(copy))
    picked = several.join(first, number, "left").withColumn(copy, F.coalesce(copy, F.lit(True))).drop(number)
    return rows.join(repeated, row, "left_anti").withColumn(copy, F.lit(False)).unionByName(picked)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", scan: bool = False, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """All columns of ``docs`` with repeated lines taken out of ``text``, and ``n_dropped`` (long), the lines taken out.

    Lines are split at ``\\n`` and compared without white space at their ends; lines of white space alone stay. Lines are
    linked if they are equal, or if the Jaccard similarity of their sets of ``shingle``-character shingles is at least
    ``similarity``; lines shorter than a shingle only if equal. Of each component of links the line of the smallest
    (key, hash of the row, line number) stays, null keys first, and all others go, wherever they are. Rows are never dropped: a text
    may become empty. Null and empty texts stay as they are. Repeated rows are rows of their own. ``n_dropped`` replaces a
    column of that name.

    Candidates share one of ``bands`` bands of a MinHash signature. All lines of a bucket are verified exactly against its
    smallest; where one is unlike it, that line is compared with all others of the bucket, so no candidate link is lost.
    Equal lines are one line throughout (64-bit hashes; for 10^9 different lines some two agree with a chance of 3 %).

    A row is told by its key and two 64-bit hashes of its text, which every job finds again whatever the splits of its scan;
    rows that agree in all of them have the same lines, so all but one lose every line. Only such rows are written with
    numbers to pick that one. ``scan`` says that ``docs`` is a plain scan of files, which is read three times; anything else
    is written first.
    """
    docs = docs.drop("n_dropped")
    if not scan:
        docs = cut(docs)
    row = [fresh(docs, "row"), fresh(docs, "row2")]
    whole = text_of(text)
    told = docs.withColumns({row[0]: F.xxhash64(key, whole), row[1]: F.xxhash64(F.lit(1), key, whole)})
    plain = told.select(F.col(key).alias("k"), F.col(row[0]).alias("row"), F.col(row[1]).alias("row2"), whole.alias("body"))
    schema = schema_with(plain, ["k", "row", "row2"], head=T.BooleanType(), no=T.IntegerType(), h=T.LongType(), bands=T.ArrayType(T.LongType()))
    signed = cut(plain.mapInArrow(partial(_sign, text="body", shingle=shingle, bands=bands, rows=rows), schema))
    stars = cut(shared_buckets(signed.filter(F.size("bands") > 0)))
    pairs = stars.select("h", "rep").distinct()
    lines = cut(lines_of(plain, "body", pairs.select("h").union(pairs.select(F.col("rep").alias("h"))).distinct(), shingle, bands, rows))
    texts = pairs.join(lines.select("h", F.col("line").alias("one")), "h").join(lines.select(F.col("h").alias("rep"), F.col("line").alias("two")), "rep")
    checked = cut(texts.select("h", "rep", "one", "two").mapInArrow(partial(_verify, shingle=shingle, least=similarity), "h long, rep long, alike boolean"))
    starred = components(checked.filter("alike"), "h", "rep")
    more = _mixed_links(stars, starred, lines, shingle, similarity)
    roots = _merged(starred, more)
    place = F.struct("k", "row", "row2", "no")
    first = signed.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    rooted = first.join(roots, first.h == roots.node, "left").select("h", "first", "n", F.coalesce("component", "h").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("all")).filter("all > 1")
    repeated = rooted.join(groups, "root").select("h", "kept")
    kept = (F.col("row") == F.col("kept.row")) & (F.col("row2") == F.col("kept.row2")) & (F.col("no") == F.col("kept.no"))
    drops = signed.select("h", "row", "row2", "no").join(repeated, "h").filter(~kept).select("row", "row2", "no")
    copies = cut(signed.filter("head").groupBy("row", "row2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("row").alias(row[0]), F.col("row2").alias(row[1])))
    copy, gone = fresh(docs, "copy"), fresh(docs, "gone")
    if copies.head(1):
        told, drops = _with_copies(told, copies, row, copy), drops.distinct()
    else:
        told = told.withColumn(copy, F.lit(False))
    lost = drops.groupBy(F.col("row").alias(row[0]), F.col("row2").alias(row[1])).agg(F.collect_list("no").alias(gone))
    joined = told.join(lost, row, "left").drop(*row)
    keep = [c for c in docs.columns if c != text]
    name = fresh(docs, "rebuilt")
    rebuild = partial(_rebuild, text=text, drops=gone, copy=copy, keep=keep, name=name)
    out = joined.mapInArrow(rebuild, schema_with(joined, keep, **{name: T.StringType(), "n_dropped": T.LongType()}))
    return out.select(*[F.col(name).alias(text) if c == text else F.col(c) for c in docs.columns], "n_dropped")
