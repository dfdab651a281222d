"""Near-duplicate embeddings through a pivot-permutation index."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Forest
from tidemark.llm.components import components
from tidemark.session import cut

#: Reference points of every width: 4 for each square root of the number of its vectors. Of all widths together they are at
#: most so many numbers (64 MB), shared by the widths' rows, and one vector a width beyond that: vectors near one pivot only
#: are compared all with all, in tiles.
PIVOTS_PER_ROOT, LEAST_PIVOTS, MOST_NUMBERS = 4, 64, 1 << 23
#: Nearest pivots that describe a vector, and how many two vectors must share to be compared.
NEAREST, SHARED = 12, 3
#: Greatest cosine between two pivots. Pivots that are near copies of each other would fill the places of all vectors near
#: them in an order that is noise, and such vectors might share few.
PIVOT_LIKENESS = 0.8
#: Vectors of one tile of a pivot's list.
TILE = 512


def spread_pivots(points: np.ndarray, most: float = PIVOT_LIKENESS) -> np.ndarray:
    """The points that are less like every point kept before them than ``most``, in order."""
    kept = points[:0]
    for i in range(0, len(points), 1024):
        block = points[i : i + 1024]
        for j in range(0, len(kept), 16_384):
            block = block[(block @ kept[j : j + 16_384].T < most).all(axis=1)]
        like, alive = block @ block.T, np.ones(len(block), bool)
        for k in range(len(block)):
            if alive[k]:
                alive[k + 1 :] &= like[k, k + 1 :] < most
        kept = np.concatenate([kept, block[alive]])
    return kept


def _unit(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _describe(batches, pivots, nearest: int):
    """(id, copies, vector, its nearest pivots, sorted by number) for every vector; ties go to the smaller number.

    ``pivots``: of every width the number of its first pivot and the points.
    """
    for batch in batches:
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(sizes).tolist():
            first, points = pivots.value[width]
            yield from _describe_width(batch.filter(pa.array(sizes == width)), width, first, points, nearest)


def _describe_width(batch: pa.RecordBatch, width: int, first: int, points: np.ndarray, nearest: int):
    for start in range(0, batch.num_rows, 1024):
        part = batch.slice(start, 1024)
        x = _unit(part.column(2), width)
        like = x @ points.T
        k = min(nearest, len(points))
        order = np.argsort(-like, axis=1, kind="stable")[:, :k] if len(points) <= 64 else _top(like, k)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k, dtype=np.int32)), pa.array((first + np.sort(order, axis=1)).astype(np.int32).ravel()))
        yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["id", "copies", "vector", "near"])


def _top(like: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest of every row."""
    return np.argpartition(-like, k - 1, axis=1)[:, :k]


def _verify(key, group: pa.Table, threshold: float, most_shared: int) -> pa.Table:
    """Links between the vectors of two tiles of one pivot's list.

    Shared pivots are counted by a product of membership matrices. A pair belongs to the list of its smallest shared
    pivot, so it is verified once. Returns (id, links found) and a forest of the links as (id, other, 0).
    """
    pivot, one, two = (k.as_py() for k in key)
    group = group.combine_chunks()
    ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
    tile = group.column("own").to_numpy()
    near_column = group.column("near").combine_chunks()
    near = near_column.flatten().to_numpy().reshape(len(ids), -1)
    shared = min(most_shared, near.shape[1])  # all pivots of a list are of one width, which may have few
    vectors = group.column("vector").combine_chunks()
    x = _unit(vectors, len(vectors.flatten()) // len(ids))
    named, local = np.unique(near, return_inverse=True)
    member = np.zeros((len(ids), len(named)), np.float32)
    np.put_along_axis(member, local.reshape(near.shape), 1.0, axis=1)
    lower = member[:, named < pivot]
    rows_a, rows_b = np.flatnonzero(tile == one), np.flatnonzero(tile == two)
    found, forest = np.zeros(len(ids), np.int64), Forest()
    for i in range(0, len(rows_a), 512):
        a = rows_a[i : i + 512]
        for j in range(0, len(rows_b), 2048):
            b = rows_b[j : j + 2048]
            if one == two and b[-1] < a[0]:
                continue
            candidate = (member[a] @ member[b].T >= shared) & (lower[a] @ lower[b].T < 0.5)
            if one == two:
                candidate &= a[:, None] < b[None, :]
            p, q = np.nonzero(candidate)
            for s in range(0, len(p), 100_000):
                u, v = a[p[s : s + 100_000]], b[q[s : s + 100_000]]
                close = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
                u, v = u[close], v[close]
                np.add.at(found, u, copies[v])
                np.add.at(found, v, copies[u])
                forest.add(ids[u], ids[v])
    node, root = forest.edges()
    linked = np.flatnonzero(found)
    return pa.table(
        {
            "id": pa.array(np.concatenate([ids[linked], node]), pa.int64()),
            "other": pa.array(np.concatenate([np.zeros(len(linked), np.int64), root]), pa.int64(), mask=np.concatenate([np.ones(len(linked), bool), np.zeros(len(node), bool)])),
            "n": pa.array(np.concatenate([found[linked], np.zeros(len(node), np.int64)]), pa.int64()),
        }
    )


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, nearest: int = NEAREST, shared: int = SHARED, tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``df``.

    Vectors are linked if their cosine in double precision is at least ``threshold``. A vector is described by its
    ``nearest`` most similar pivots of its length; pivots are the distinct vectors with the smallest hashes, about 4 times the
    square root of their number within 64 MB, less those of a cosine of 0.8 or more to another pivot. Vectors that share at least ``shared`` pivots meet in the inverted list of
    the smallest pivot they share and are verified there. Lists are cut into tiles and every two tiles of a list meet in
    one group, so a pivot near a third of all vectors is dealt over many tasks. Every row is indexed; recall against
    brute force is measured in the tests.

    Equal vectors are folded to one before, with their number. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest key reachable, ``kept``
    is ``key = component_id``. Rows of one key are one node of the graph; rows without a key link with nothing. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. Vectors of different lengths never link; each length has pivots of its own.
    """
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("v", F.when(F.col("good"), F.transform("v", lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c))))
    fits = F.col("good")
    keyed = rows.select("k", F.when(fits, F.col("v")).alias("v"), F.when(fits, F.xxhash64("v")).alias("h1"), F.when(fits, F.xxhash64(F.lit(1), "v")).alias("h2"))
    # One row for each different vector; of equal vectors any one is the vector, so it can be a plain first value.
    folded = keyed.filter("h1 is not null and k is not null").groupBy("h1", "h2").agg(F.min("k").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("vector"))
    folded = cut(folded)
    widths = {r.w: r.n for r in folded.groupBy(F.size("vector").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(widths.values())
    if not n:
        return keyed.select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    numbers = sum(w * m for w, m in widths.items())
    wanted = {w: int(max(1, min(max(LEAST_PIVOTS, PIVOTS_PER_ROOT * m**0.5), MOST_NUMBERS * m / numbers))) for w, m in widths.items()}
    # The smallest hashes of every width: a part of the hash range that holds a few more than are wanted.
    spark = df.sparkSession
    range_of = [(w, float(-(2**63) + 2**64 * min(1.0, (m + 8 * m**0.5 + 20) / widths[w]))) for w, m in wanted.items()]
    near_start = folded.join(F.broadcast(spark.createDataFrame(range_of, "w int, below double")), F.size("vector") == F.col("w")).filter(F.col("h1").cast("double") <= F.col("below"))
    drawn: dict[int, list] = {w: [] for w in widths}
    for r in near_start.select("w", "h1", "h2", "vector").collect():
        drawn[r.w].append((r.h1, r.h2, r.vector))
    first, pivots_of = 0, {}
    for w in sorted(drawn):
        points = np.array([v for *_, v in sorted(drawn.pop(w), key=lambda x: x[:2])[: wanted[w]]], dtype=np.float64).reshape(-1, w)
        points /= np.abs(points).max(axis=1, keepdims=True)
        points /= np.sqrt((points * points).sum(axis=1, keepdims=True))
        pivots_of[w] = (first, spread_pivots(points))
        first += len(pivots_of[w][1])
    shared = min(shared, nearest)
    pivots = spark.sparkContext.broadcast(pivots_of)
    described = cut(
        folded.select("id", "copies", "vector").mapInArrow(partial(_describe, pivots=pivots, nearest=nearest), "id long, copies long, vector array<double>, near array<int>")
    )
    listed = described.withColumn("pivot", F.explode("near"))
    # At most one row a pivot; the number of tiles of its list.
    lengths = listed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    tiled = listed.join(F.broadcast(lengths), "pivot").withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    own, last = F.col("own"), F.col("tiles") - 1
    meets = F.concat(
        F.transform(F.sequence(F.lit(0), own), lambda t: F.struct(t.alias("one"), own.alias("two"))),
        F.when(own < last, F.transform(F.sequence(F.least(own + 1, last), last), lambda t: F.struct(own.alias("one"), t.alias("two")))).otherwise(F.expr("array()")),
    )
    met = tiled.withColumn("m", F.explode(meets)).select("pivot", "m.*", "id", "copies", "vector", "near", "own")

    def verify(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return _verify(key, group, threshold, shared)

    found = cut(met.groupBy("pivot", "one", "two").applyInArrow(verify, "id long, other long, n long"))
    links = found.filter("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other is not null"), "id", "other")
    named = (
        folded.join(links, "id", "left").join(roots, folded.id == roots.node, "left")
        .select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    out = keyed.join(named, ["h1", "h2"], "left").select("k", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "k").alias("component_id"))
    return out.select(F.col("k").alias(key), "n_links", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))
