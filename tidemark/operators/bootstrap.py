"""Bootstrap of F1 and drift statistics on joint cells.

F1 depends on an item only through its true class and the class each run predicted, so items
with the same pattern are counted into one cell and replicates are drawn over cells. All runs
share a cell, hence share draws: differences between runs are paired without extra work.

Three ways to draw, all of one law. ``tree``, the default, splits a replicate's draws down a fixed binary tree over the
ordered cells: each split is the binomial quantile of ``ph(seed:group:replicate:height:node)``, so it costs B x cells
whatever the number of items, repeats on any partitioning, and SQL can draw the same replicates. ``multinomial`` draws cell
counts by a random generator. ``hash`` places draw j of replicate b by ``ph(seed:group:b:j) mod n``: B x n hashes, counted
in the tasks that make them.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashes import ph_numbered
from tidemark.functions.keys import composite_key, ph
from tidemark.functions.labels import CLASSES
from tidemark.operators import metrics as M
from tidemark.operators.sampling import dense_index
from tidemark.session import cut

MEMBER = ("model", "train_set", "seed")
DIGITS = 39  # class digits of base 3 that fit a signed 64-bit integer


def _codes(n_members: int) -> list[str]:
    return [f"code_{i}" for i in range(-(-n_members // DIGITS))]


def align_predictions(
    preds: DataFrame,
    members: Sequence[tuple],
    by: Sequence[str],
    member_cols: Sequence[str] = MEMBER,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per item: true class, run count, and all runs' classes as base-3 digits.

    ``complete``: every run has exactly one row for the item, with a class from 0 to 2, and all agree on its true class.
    A doubled, missing or null prediction makes it false.
    """
    index = {"|".join(str(v) for v in m): i for i, m in enumerate(members)}
    table = F.create_map(*[F.lit(x) for pair in index.items() for x in pair])
    rows = preds.withColumn("_i", F.try_element_at(table, composite_key(*member_cols))).filter("_i IS NOT NULL")
    powers = F.array(*[F.lit(3**d).cast("long") for d in range(DIGITS)])
    digit = F.col("pred").cast("long") * powers[F.col("_i") % DIGITS]
    codes = [
        F.sum(F.when(F.floor(F.col("_i") / DIGITS) == k, digit).otherwise(F.lit(0).cast("long"))).alias(name)
        for k, name in enumerate(_codes(len(members)))
    ]
    bit = F.array(*[F.lit(1 << d).cast("long") for d in range(DIGITS)])[F.col("_i") % DIGITS]
    seen = [F.bit_or(F.when(F.floor(F.col("_i") / DIGITS) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"_seen{k}") for k in range(len(codes))]
    wanted = [(1 << min(DIGITS, len(members) - k * DIGITS)) - 1 for k in range(len(codes))]
    known = lambda c: F.coalesce(F.col(c).isin(*CLASSES), F.lit(False))
    out = rows.groupBy(*by, "item_id").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.min("y").alias("y"),
        F.max("y").alias("_ymax"),
        F.bool_and(known("pred") & known("y")).alias("_known"),
        *seen,
        *codes,
        *[F.min(c).alias(c) for c in carry],
    )
    whole = (F.col("n_runs") == len(members)) & F.col("_known") & (F.col("y") == F.col("_ymax"))
    for k, mask in enumerate(wanted):
        whole &= F.col(f"_seen{k}") == mask
    return out.withColumn("complete", F.coalesce(whole, F.lit(False))).drop("_ymax", "_known", *[f"_seen{k}" for k in range(len(codes))])


def joint_cells(
    preds: DataFrame,
    members: Sequence[tuple],
    by: Sequence[str],
    member_cols: Sequence[str] = MEMBER,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(by, carry, y, codes, n). Fails when a run misses an item that another run scored.

    Cells are written out once: the pass over all predictions is the expensive step, and point
    values, totals and replicates all start from the few cells.
    """
    aligned = align_predictions(preds, members, by, member_cols, carry)
    codes = _codes(len(members))
    checked = aligned.withColumn(
        codes[0],
        F.when(F.col("complete"), F.col(codes[0])).otherwise(
            F.raise_error(F.lit("runs do not cover the same items with the same labels")).cast("long")
        ),
    )
    return cut(checked.groupBy(*by, *carry, "y", *codes).agg(F.count(F.lit(1)).alias("n")))


def _member_structs(members: Sequence[tuple], member_cols: Sequence[str]):
    structs = []
    for i, m in enumerate(members):
        digit = F.expr(f"(code_{i // DIGITS} DIV {3 ** (i % DIGITS)}L) % 3")
        structs.append(F.struct(*[F.lit(v).alias(c) for c, v in zip(member_cols, m)], digit.cast("int").alias("pred")))
    return F.array(*structs)


def member_f1(
    cells: DataFrame, members: Sequence[tuple], keys: Sequence[str], weight: str = "n", member_cols: Sequence[str] = MEMBER
) -> DataFrame:
    """F1 per (keys, run) from weighted cells."""
    long = cells.select(*keys, "y", F.col(weight).alias("_w"), F.explode(_member_structs(members, member_cols)).alias("m"))
    flat = long.select(*keys, "y", "_w", *[F.col(f"m.{c}").alias(c) for c in (*member_cols, "pred")])
    return M.class_f1(flat, [*keys, *member_cols], weight=F.col("_w"))


def _tasks(df: DataFrame) -> int:
    """Partitions for work that is heavy per byte: a fixed number is not coalesced for being small."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _paired(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """Both sides on the same fixed partitioning, grouped for a joint Arrow function."""
    n = _tasks(left)
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys))


def hash_draws(totals: DataFrame, by: Sequence[str], B: int, seed: int | str, chunk: int = 1 << 14) -> DataFrame:
    """(by, total, rep, pos): ``total`` positions per group and replicate, spread in chunks of draws."""
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / chunk))
    starts = (
        totals.filter("total > 0")
        .select(*by, "total", F.explode(F.sequence(F.lit(0), F.lit(B - 1))).alias("rep"))
        .select(*by, "total", "rep", F.explode(steps).alias("_k"))
        .repartition(_tasks(totals), *by, "rep", "_k")
    )
    last = F.least(F.col("total"), (F.col("_k") + 1) * chunk) - 1
    draws = starts.select(*by, "total", "rep", F.explode(F.sequence(F.col("_k") * chunk, last)).alias("_j"))
    key = composite_key(F.lit(seed), *by, "rep", "_j", sep=":")
    return draws.select(*by, "total", "rep", F.pmod(ph(key), F.col("total")).alias("pos"))


#: Draws of a unit of work, and draws hashed at a time.
UNIT, STEP = 1 << 22, 1 << 15


def _draw_units(totals: DataFrame, by: Sequence[str], B: int, seed: int | str) -> DataFrame:
    """(by, total, rep, _tag, _k): the draws of a replicate in units of ``UNIT``; draw j is ``ph(_tag || j)``. Groups with a
    null key have no draws."""
    units = F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / UNIT))
    known = totals.filter("total > 0")
    for c in by:
        known = known.filter(F.col(c).isNotNull())
    reps = known.select(*by, "total", F.explode(F.sequence(F.lit(0), F.lit(B - 1))).alias("rep"))
    tag = F.concat(composite_key(F.lit(seed), *by, "rep", sep=":"), F.lit(":"))
    return reps.select(*by, "total", "rep", tag.alias("_tag"), F.explode(units).alias("_k"))


def _unit_positions(tag: str, k: int, total: int, unit: int):
    """Positions of a unit's draws, some at a time."""
    last = min(total, (k + 1) * unit)
    for first in range(k * unit, last, STEP):
        yield ph_numbered(tag, first, min(first + STEP, last)) % total


def _dealt_draws(cells: DataFrame, by: Sequence[str], order: Sequence[str], B: int, seed: int | str, shares: int) -> tuple[DataFrame, DataFrame]:
    """(cells in order with their number and upper end, units of draws dealt over ``shares`` tasks a group)."""
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut(cells.withColumn("_hi", F.sum("n").over(running)).withColumn("_cell", F.row_number().over(running) - 1))
    dealt = F.pmod(F.col("rep") + F.col("_k"), F.lit(shares))
    units = _draw_units(placed.groupBy(*by).agg(F.max("_hi").alias("total")), by, B, seed).withColumn("_share", dealt.cast("int"))
    return placed, units


def _each_share(placed: DataFrame, cols: Sequence[str], shares: int) -> DataFrame:
    return placed.select(*cols, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"))


def _counted(group: pd.DataFrame, hi: np.ndarray, unit: int) -> np.ndarray:
    """How many draws of these units fall into each cell, given the cells' upper ends."""
    n = np.zeros(len(hi), np.int64)
    for tag, k, total in zip(group["_tag"], group["_k"], group["total"]):
        for pos in _unit_positions(tag, int(k), int(total), unit):
            n += np.bincount(np.searchsorted(hi, pos, side="right"), minlength=len(hi))
    return n


def draw_cells(
    cells: DataFrame, by: Sequence[str], order: Sequence[str], B: int, seed: int | str, shares: int = 64
) -> DataFrame:
    """Replicate weights (by, order, rep, w) by hash draws.

    The draws of a group are dealt over ``shares`` tasks. Each has the upper ends of the group's cells, finds the cell of
    every draw by binary search and returns counts, so draws are neither written nor shuffled.
    """
    placed, units = _dealt_draws(cells, by, order, B, seed, shares)
    ends, unit = _each_share(placed, [*by, "_hi"], shares), UNIT

    def count(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        hi, out = np.sort(edges["_hi"].to_numpy()), []
        for rep, group in own.groupby("rep"):
            n = _counted(group, hi, unit)
            hit = np.flatnonzero(n)
            out.append(pd.DataFrame({"rep": rep, "_cell": hit, "w": n[hit]}))
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame({"rep": [], "_cell": [], "w": []})
        return found.assign(**{c: edges[c].iloc[0] if len(edges) else None for c in by})

    found = _paired(units, ends, [*by, "_share"]).applyInPandas(count, f"{_typed(cells, by)}, rep int, _cell int, w long")
    summed = found.groupBy(*by, "rep", "_cell").agg(F.sum("w").alias("w"))
    return summed.join(placed.select(*by, *order, "_cell"), [*by, "_cell"]).select(*by, *order, "rep", "w")


#: Positions of a part of a group: few enough for offsets and counts in memory.
PART = 1 << 14


def draws_in_parts(totals: DataFrame, by: Sequence[str], B: int, seed: int | str) -> DataFrame:
    """(by, _part, rep, hits): hash draws among ``total`` positions, dealt to parts of ``PART`` neighbouring positions.

    ``hits`` is the compressed count of every position of the part, from one unit of draws: rows of a unit and part, not of
    a draw, are shuffled.
    """
    units = _draw_units(totals, by, B, seed)
    kept, unit, width = [*by, "rep", "total", "_tag", "_k"], UNIT, PART

    def deal(batches):
        for batch in batches:
            for row in batch[kept].itertuples(index=False):
                *keys, rep, total, tag, k = row
                pos = np.sort(np.concatenate(list(_unit_positions(tag, int(k), int(total), unit))))
                parts = np.arange(pos[0] // width, pos[-1] // width + 1)
                at = np.searchsorted(pos, np.append(parts, parts[-1] + 1) * width)
                hits = [_packed(pos[i:j] - p * width) for p, i, j in zip(parts, at, at[1:])]
                yield pd.DataFrame({**dict(zip(by, keys)), "_part": parts, "rep": rep, "hits": hits})

    spread = units.repartition(max(_tasks(totals), 64), *by, "rep", "_k")
    return spread.select(*kept).mapInPandas(deal, f"{_typed(totals, by) + ', ' if by else ''}_part long, rep int, hits binary")


def _packed(offsets: np.ndarray) -> bytes:
    n = np.bincount(offsets, minlength=1)
    return zlib.compress(n.astype("<u1" if n.max() < 255 else "<u4").tobytes() + (b"\1" if n.max() < 255 else b"\4"), 1)


def _added_hits(reps: np.ndarray, hits: Sequence[bytes], size: int) -> np.ndarray:
    """(replicates, positions) of a block of replicates, units added up. ``reps`` counts from 0."""
    m = np.zeros((int(reps.max()) + 1, size), np.int32)
    for rep, packed in zip(reps, hits):
        raw = zlib.decompress(packed)
        n = np.frombuffer(raw[:-1], "<u1" if raw[-1] == 1 else "<u4")
        m[rep, : len(n)] += n.astype(np.int32)
    return m


def _tally_frame(y: np.ndarray, digits: np.ndarray, weights: np.ndarray, reps: np.ndarray) -> pd.DataFrame:
    """Hits and class totals of every run under every weight vector: rows are (replicate, run)."""
    parts = []
    for i in range(digits.shape[1]):
        cols = {"rep": reps, "_i": np.full(len(reps), i)}
        for c in CLASSES:
            true, pred = (y == c), (digits[:, i] == c)
            cols[f"_tp{c}"] = weights @ (true & pred).astype(float)
            cols[f"_tot{c}"] = weights @ (true.astype(float) + pred)
        parts.append(pd.DataFrame(cols))
    return pd.concat(parts, ignore_index=True)


def _digits(pdf: pd.DataFrame, n_members: int) -> np.ndarray:
    cols = [(pdf[f"code_{i // DIGITS}"].to_numpy() // 3 ** (i % DIGITS)) % 3 for i in range(n_members)]
    return np.stack(cols, axis=1)


def _named_members(df: DataFrame, members: Sequence[tuple], member_cols: Sequence[str]) -> DataFrame:
    structs = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(member_cols, m)]) for m in members])
    m = structs[F.col("_i")]
    return df.withColumn("_m", m).select(
        *[c for c in df.columns if c != "_i"], *[F.col(f"_m.{c}").alias(c) for c in member_cols]
    )


def _typed(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)


def part_draws(sizes: DataFrame, by: Sequence[str], B: int, seed: int) -> DataFrame:
    """(by, _part, draws): how many of the group's draws fall into each part, for B replicates.

    ``sizes`` holds one row (by, _part, k) per part, so a group here is a list of part sizes.
    """
    seeded = sizes.withColumn("_seed", ph(composite_key(F.lit(seed), *by, sep=":")))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        k = pdf["k"].to_numpy(dtype=float)
        n = np.random.default_rng(int(pdf["_seed"].iloc[0])).multinomial(int(k.sum()), k / k.sum(), size=B)
        return pdf[[*by, "_part"]].assign(draws=list(n.T))

    return seeded.groupBy(*by).applyInPandas(split, f"{_typed(sizes, by)}, _part int, draws array<long>")


#: Parts that cells or clusters of a group are hashed into; the same at every size, so replicates don't depend on it.
PARTS = 64


def multinomial_weights(cells: DataFrame, by: Sequence[str], order: Sequence[str], B: int, seed: int, parts: int = PARTS, block: int = 100) -> DataFrame:
    """Replicate weights (by, order, rep, w) by multinomial draws over cells (by, order, n); weights of 0 are left out."""
    parted = cells.withColumn("_part", F.pmod(ph(composite_key(F.lit(f"p{seed}"), *order, sep=":")), F.lit(parts)).cast("int"))
    header = part_draws(parted.groupBy(*by, "_part").agg(F.sum("n").alias("k")), by, B, seed)
    seeded = header.withColumn("_seed", ph(composite_key(F.lit(seed), *by, "_part", sep=":")))

    def draw(pdf: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order)).reset_index(drop=True)
        n = pdf["n"].to_numpy(dtype=float)
        quota, rng, out = np.asarray(head["draws"].iloc[0]), np.random.default_rng(int(head["_seed"].iloc[0])), []
        for first in range(0, B, block):
            rep, cell = np.nonzero(w := rng.multinomial(quota[first : first + block], n / n.sum()))
            out.append(pdf.loc[cell, [*by, *order]].assign(rep=rep + first, w=w[rep, cell]))
        return pd.concat(out, ignore_index=True)

    return _paired(parted, seeded, [*by, "_part"]).applyInPandas(draw, f"{_typed(cells, [*by, *order])}, rep int, w long")


def multinomial_f1(
    cells: DataFrame,
    members: Sequence[tuple],
    by: Sequence[str],
    B: int,
    seed: int,
    member_cols: Sequence[str] = MEMBER,
    block: int = 100,
    parts: int = PARTS,
) -> DataFrame:
    """Replicate F1 from multinomial cell counts.

    Cells are hashed into a fixed number of parts; a draw over parts fixes how many draws each part gets, then
    every part draws its own cells, a block of replicates at a time. Parts return class totals, which are added
    up per replicate, so no task needs all cells of a group. Raise ``parts`` for more than some millions of cells
    a group; it is a parameter of the result, like the seed.
    """
    codes, n_members = _codes(len(members)), len(members)
    part = F.pmod(ph(composite_key(F.lit(f"p{seed}"), "y", *codes, sep=":")), F.lit(parts)).cast("int")
    parted = cells.withColumn("_part", part)
    header = part_draws(parted.groupBy(*by, "_part").agg(F.sum("n").alias("k")), by, B, seed)
    seeded = header.withColumn("_seed", ph(composite_key(F.lit(seed), *by, "_part", sep=":")))

    def draw(pdf: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", *codes])
        n = pdf["n"].to_numpy(dtype=float)
        quota, rng, out = np.asarray(head["draws"].iloc[0]), np.random.default_rng(int(head["_seed"].iloc[0])), []
        for first in range(0, B, block):
            reps = np.arange(first, min(first + block, B))
            w = rng.multinomial(quota[reps], n / n.sum()).astype(float)
            out.append(_tally_frame(pdf["y"].to_numpy(), _digits(pdf, n_members), w, reps))
        found = pd.concat(out, ignore_index=True)
        return found.assign(**{c: head[c].iloc[0] for c in by})

    sums = [f"_{k}{c}" for c in CLASSES for k in ("tp", "tot")]
    schema = f"{_typed(cells, by)}, rep int, _i int, " + ", ".join(f"{c} double" for c in sums)
    tallies = _paired(parted, seeded, [*by, "_part"]).applyInPandas(draw, schema)
    added = tallies.groupBy(*by, "rep", "_i").agg(*[F.sum(c).alias(c) for c in sums])
    f1 = added.select(*by, "rep", "_i", *[v.alias(k) for k, v in M.f1_columns().items()])
    return _named_members(f1, members, member_cols)


def binomial_quantile(u: np.ndarray, m: np.ndarray, p: float) -> np.ndarray:
    """Smallest k with P(Binomial(m, p) <= k) > u, for each u and m. Values beyond ten deviations and ten are left out: their
    mass is below 1e-20. Probabilities are ratios from the mode outwards, so m may be large."""
    if p >= 1.0:
        return m.copy()
    out = np.zeros(len(m), np.int64)
    for size in np.unique(m[m > 0]).tolist():
        mean, wide = size * p, 10.0 * (size * p * (1.0 - p)) ** 0.5 + 10.0
        lo, hi = max(0, int(mean - wide)), min(size, int(mean + wide) + 1)
        mode = min(max(int((size + 1) * p), lo), hi)
        up, down = np.arange(mode, hi, dtype=float), np.arange(mode, lo, -1, dtype=float)
        odds = p / (1.0 - p)
        mass = np.concatenate([np.cumprod(down / (size - down + 1.0) / odds)[::-1], [1.0], np.cumprod((size - up) / (up + 1.0) * odds)])
        cdf = np.cumsum(mass)
        own = m == size
        out[own] = np.minimum(lo + np.searchsorted(cdf / cdf[-1], u[own], side="right"), hi)
    return out


def split_draws(sizes: np.ndarray, draws: np.ndarray, name: str, height: int = 0, node: int = 0) -> np.ndarray:
    """(replicates, leaves): ``draws`` of every replicate split down to leaves of the given sizes, 2^d of them, empty ones last.

    The root is node ``node`` at ``height`` + d; a node's children are 2j and 2j + 1 one level below. A node is split by its
    own hash whatever tree it is part of, so a tree may be cut into subtrees, and empty levels above change nothing.
    """
    import hashlib

    counts = draws.reshape(len(draws), 1).astype(np.int64)
    depth = int(len(sizes)).bit_length() - 1
    for h in range(depth, 0, -1):
        halves = sizes.reshape(2 ** (depth - h + 1), -1).sum(axis=1)
        new = np.zeros((len(draws), 2 * counts.shape[1]), np.int64)
        for j in range(counts.shape[1]):
            m, left, right = counts[:, j], float(halves[2 * j]), float(halves[2 * j + 1])
            if not right:
                new[:, 2 * j] = m
                continue
            at = np.flatnonzero(m)
            tail = f":{height + h}:{(node << (depth - h)) + j}"
            u = np.array([int(hashlib.md5(f"{name}:{b}{tail}".encode()).hexdigest()[:15], 16) for b in at.tolist()], np.int64) / 2.0**60
            new[at, 2 * j] = binomial_quantile(u, m[at], left / (left + right))
            new[:, 2 * j + 1] = m - new[:, 2 * j]
        counts = new
    return counts


#: Levels of a tree that are split first, one row a group: 64 subtrees, each a task of its own.
TOP_LEVELS = 6


def _in_subtrees(cells: DataFrame, by: Sequence[str], order: Sequence[str], B: int, seed: int, schema: str, use) -> DataFrame:
    """Replicates by tree draws: ``use(cells of a subtree in order, weights (B, cells))`` gives rows of ``schema`` without ``by``."""
    place = Window.partitionBy(*by).orderBy(*order)
    indexed = cut(cells.withColumn("_leaf", F.row_number().over(place) - 1))
    most = indexed.agg(F.max("_leaf")).first()[0] or 0
    low = max(0, int(most).bit_length() - TOP_LEVELS)
    parted = indexed.withColumn("_part", F.shiftright("_leaf", low).cast("int"))
    names = ":".join
    tag = lambda pdf: names([str(seed), *(str(pdf[c].iloc[0]) for c in by)])

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = np.zeros(1 << int(pdf["_part"].max()).bit_length())
        sizes[pdf["_part"]] = pdf["k"]
        drawn = split_draws(sizes, np.full(B, int(sizes.sum())), tag(pdf), low)
        return pdf[[*by, "_part"]].assign(draws=[drawn[:, p] for p in pdf["_part"]])

    header = parted.groupBy(*by, "_part").agg(F.sum("n").alias("k")).groupBy(*by).applyInPandas(top, f"{_typed(cells, by)}, _part int, draws array<long>")

    def below(pdf: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_leaf")
        sizes = np.zeros(1 << low)
        own = pdf["_leaf"].to_numpy() & ((1 << low) - 1)
        sizes[own] = pdf["n"]
        drawn = split_draws(sizes, np.asarray(head["draws"].iloc[0]), tag(pdf), 0, int(pdf["_part"].iloc[0]))
        return use(pdf, drawn[:, own]).assign(**{c: pdf[c].iloc[0] for c in by})

    return _paired(parted, header, [*by, "_part"]).applyInPandas(below, f"{_typed(cells, by)}, {schema}")


def tree_weights(cells: DataFrame, by: Sequence[str], order: Sequence[str], B: int, seed: int) -> DataFrame:
    """Replicate weights (by, order, rep, w) by tree draws over cells (by, order, n); weights of 0 are left out."""

    def use(pdf: pd.DataFrame, weights: np.ndarray) -> pd.DataFrame:
        rep, cell = np.nonzero(weights)
        return pdf.iloc[cell][list(order)].assign(rep=rep, w=weights[rep, cell])

    return _in_subtrees(cells, by, order, B, seed, f"{_typed(cells, order)}, rep int, w long", use).select(*by, *order, "rep", "w")


def tree_f1(cells: DataFrame, members: Sequence[tuple], by: Sequence[str], B: int, seed: int, member_cols: Sequence[str] = MEMBER) -> DataFrame:
    """Replicate F1 by tree draws; subtrees return class totals, which are added up per replicate."""
    codes, n_members = _codes(len(members)), len(members)
    sums = [f"_{k}{c}" for c in CLASSES for k in ("tp", "tot")]

    def use(pdf: pd.DataFrame, weights: np.ndarray) -> pd.DataFrame:
        return _tally_frame(pdf["y"].to_numpy(), _digits(pdf, n_members), weights.astype(float), np.arange(B))

    tallies = _in_subtrees(cells, by, ["y", *codes], B, seed, "rep int, _i int, " + ", ".join(f"{c} double" for c in sums), use)
    added = tallies.groupBy(*by, "rep", "_i").agg(*[F.sum(c).alias(c) for c in sums])
    return _named_members(added.select(*by, "rep", "_i", *[v.alias(k) for k, v in M.f1_columns().items()]), members, member_cols)


def hash_f1(
    cells: DataFrame, members: Sequence[tuple], by: Sequence[str], B: int, seed: int | str, member_cols: Sequence[str] = MEMBER, shares: int = 64
) -> DataFrame:
    """Replicate F1 by hash draws. Tasks return class totals, which are added up per replicate: the weights of cells, replicates x
    cells rows, are neither shuffled nor opened into one row a run."""
    codes, n_members = _codes(len(members)), len(members)
    placed, units = _dealt_draws(cells, by, ["y", *codes], B, seed, shares)
    ends, unit = _each_share(placed, [*by, "_hi", "y", *codes], shares), UNIT
    sums = [f"_{k}{c}" for c in CLASSES for k in ("tp", "tot")]

    def tally(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values("_hi", ignore_index=True)
        hi, y, digits, out = edges["_hi"].to_numpy(), edges["y"].to_numpy(), _digits(edges, n_members), []
        for rep, group in own.groupby("rep"):
            w = _counted(group, hi, unit).astype(float)
            out.append(_tally_frame(y, digits, w[None, :], np.array([rep])))
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["rep", "_i", *sums])
        return found.assign(**{c: edges[c].iloc[0] if len(edges) else None for c in by})

    schema = f"{_typed(cells, by)}, rep int, _i int, " + ", ".join(f"{c} double" for c in sums)
    tallies = _paired(units, ends, [*by, "_share"]).applyInPandas(tally, schema)
    added = tallies.groupBy(*by, "rep", "_i").agg(*[F.sum(c).alias(c) for c in sums])
    return _named_members(added.select(*by, "rep", "_i", *[v.alias(k) for k, v in M.f1_columns().items()]), members, member_cols)


def replicate_f1(
    cells: DataFrame,
    members: Sequence[tuple],
    by: Sequence[str],
    B: int,
    seed: int,
    draws: str = "tree",
    member_cols: Sequence[str] = MEMBER,
) -> DataFrame:
    """(by, rep, run, f1_*, macro_f1) for B replicates."""
    if draws == "tree":
        return tree_f1(cells, members, by, B, seed, member_cols)
    if draws == "multinomial":
        return multinomial_f1(cells, members, by, B, seed, member_cols)
    return hash_f1(cells, members, by, B, seed, member_cols)


def interval(df: DataFrame, keys: Sequence[str], value: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """2.5 and 97.5 percentiles over replicates."""
    return df.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.025)).alias(lo), F.percentile(value, F.lit(0.975)).alias(hi)
    )


def bootstrap_macro_f1(
    preds: DataFrame, members: Sequence[tuple], by: Sequence[str], B: int, seed: int, draws: str = "tree"
) -> DataFrame:
    """Point value and interval of macro F1 per (by, run)."""
    cells = joint_cells(preds, members, by)
    keys = [*by, *MEMBER]
    point = member_f1(cells, members, by).select(*keys, F.col("macro_f1").alias("f1"))
    return point.join(interval(replicate_f1(cells, members, by, B, seed, draws), keys, "macro_f1"), keys)


def seed_mean(f1: DataFrame, keys: Sequence[str], value: str = "macro_f1") -> DataFrame:
    return f1.groupBy(*keys).agg(F.avg(value).alias("f1"))


def slopes(f1: DataFrame, keys: Sequence[str], year: str = "yr", value: str = "f1") -> DataFrame:
    return f1.groupBy(*keys).agg(F.regr_slope(value, F.col(year).cast("double")).alias("slope"), F.avg(value).alias("level"))


def _point_and_reps(
    preds: DataFrame, members: Sequence[tuple], B: int, seed: int, value: str, draws: str, group: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    cells = joint_cells(preds, members, ["yr"])
    point = seed_mean(member_f1(cells, members, ["yr"]), [*group, "yr"], value)
    reps = seed_mean(replicate_f1(cells, members, ["yr"], B, seed, draws), [*group, "yr", "rep"], value)
    return slopes(point, group), slopes(reps, [*group, "rep"])


def bootstrap_slope(
    preds: DataFrame, members: Sequence[tuple], B: int, seed: int, value: str = "macro_f1", draws: str = "tree"
) -> DataFrame:
    """Yearly slope per (model, train_set) with interval; seeds are averaged inside a replicate."""
    group = ["model", "train_set"]
    point, reps = _point_and_reps(preds, members, B, seed, value, draws, group)
    return point.select(*group, "slope").join(interval(reps, group, "slope"), group)


def _pair_diffs(df: DataFrame, pairs: Sequence[tuple], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Differences between named (model, train_set) pairs, by conditional aggregation."""
    who = F.concat_ws("/", "model", "train_set")
    names = sorted({n for p in pairs for n in p})
    wide = df.groupBy(*(keys or [F.lit(0).alias("_one")])).agg(
        *[F.max(F.when(who == n, F.col(v))).alias(f"{v}_{i}") for i, n in enumerate(names) for v in values]
    )
    at = {n: i for i, n in enumerate(names)}
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                *[(F.col(f"{v}_{at[a]}") - F.col(f"{v}_{at[b]}")).alias(f"{v}_diff") for v in values],
            )
            for a, b in pairs
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("d")).select(*keys, "d.*")


def _diff_summary(point: DataFrame, reps: DataFrame, pairs: Sequence[tuple]) -> DataFrame:
    values = ["slope", "level"]
    p = _pair_diffs(point, pairs, [], values)
    r = _pair_diffs(reps, pairs, ["rep"], values)
    q = lambda c, x: F.percentile(c, F.lit(x))
    spread = r.groupBy("a", "b").agg(
        q("slope_diff", 0.025).alias("slope_lo"),
        q("slope_diff", 0.975).alias("slope_hi"),
        F.avg((F.col("slope_diff") < 0).cast("double")).alias("p_neg"),
        q("level_diff", 0.025).alias("level_lo"),
        q("level_diff", 0.975).alias("level_hi"),
    )
    return p.join(spread, ["a", "b"])


def paired_slope_diff(
    preds: DataFrame, members: Sequence[tuple], pairs: Sequence[tuple], B: int, seed: int, value: str = "macro_f1", draws: str = "tree"
) -> DataFrame:
    """Slope and level differences under shared draws. Pairs name runs as 'model/train_set'."""
    point, reps = _point_and_reps(preds, members, B, seed, value, draws, ["model", "train_set"])
    return _diff_summary(point, reps, pairs)


def cluster_cells(preds: DataFrame, members: Sequence[tuple], cluster: str) -> DataFrame:
    return joint_cells(preds, members, ["yr"], carry=[cluster])


def cluster_hash_f1(
    cells: DataFrame, cluster: str, members: Sequence[tuple], B: int, seed: int, member_cols: Sequence[str] = MEMBER, block: int = 4_000_000
) -> DataFrame:
    """(yr, rep, run, f1_*, macro_f1) after drawing whole clusters with replacement, by hash draws.

    Clusters are numbered and cut into parts of neighbouring numbers. A part meets the draws that fell into it and returns
    class totals, which are added up per replicate: neither draws nor weights of cells are joined or shuffled one by one.
    """
    codes, n_members = _codes(len(members)), len(members)
    clusters = cut(dense_index(cells.select("yr", cluster).distinct(), cluster, seed, "_pos", ["yr"]))
    hits = draws_in_parts(clusters.groupBy("yr").agg(F.count(F.lit(1)).alias("total")), ["yr"], B, f"{seed}:{cluster}")
    numbered = cells.hint("merge").join(clusters, ["yr", cluster]).select(
        "yr", F.floor(F.col("_pos") / PART).alias("_part"), F.pmod(F.col("_pos"), F.lit(PART)).cast("int").alias("_at"), "y", *codes, "n"
    )
    sums = [f"_{k}{c}" for c in CLASSES for k in ("tp", "tot")]

    def tally(own: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        out = []
        # Rows of a cell lie together, so a cell's weight is the sum over a run of rows.
        own = own.sort_values(["y", *codes], ignore_index=True)
        starts = np.flatnonzero((own[["y", *codes]] != own[["y", *codes]].shift()).any(axis=1))
        y, digits = own["y"].to_numpy()[starts], _digits(own.iloc[starts], n_members)
        at, n = own["_at"].to_numpy(), own["n"].to_numpy()
        step = max(1, block // max(len(own), PART))
        drawn = drawn.sort_values("rep")
        reps = drawn["rep"].to_numpy()
        for first in range(0, B if len(own) else 0, step):
            i, j = np.searchsorted(reps, [first, first + step])
            if i < j:
                m = _added_hits(reps[i:j] - first, drawn["hits"].iloc[i:j], PART)
                w = np.add.reduceat(m[:, at] * n, starts, axis=1)
                out.append(_tally_frame(y, digits, w.astype(float), np.arange(first, first + len(m))))
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["rep", "_i", *sums])
        return found.assign(yr=own["yr"].iloc[0] if len(own) else None)

    schema = f"{_typed(cells, ['yr'])}, rep int, _i int, " + ", ".join(f"{c} double" for c in sums)
    tallies = _paired(numbered, hits, ["yr", "_part"]).applyInPandas(tally, schema)
    added = tallies.groupBy("yr", "rep", "_i").agg(*[F.sum(c).alias(c) for c in sums])
    return _named_members(added.select("yr", "rep", "_i", *[v.alias(k) for k, v in M.f1_columns().items()]), members, member_cols)


def cluster_multinomial_f1(
    cells: DataFrame, cluster: str, members: Sequence[tuple], B: int, seed: int, parts: int = PARTS, member_cols: Sequence[str] = MEMBER
) -> DataFrame:
    """The same by a random generator: clusters are hashed into parts, a draw over parts fixes how many
    draws each part gets, and every task draws its own clusters. Only class totals of a replicate leave a task."""
    codes, n_members = _codes(len(members)), len(members)
    sums = [f"_{k}{c}" for c in CLASSES for k in ("tp", "tot")]
    by_cluster = cells.withColumn("_part", F.pmod(ph(F.concat(F.lit(f"{seed}:"), F.col(cluster))), F.lit(parts)).cast("int"))
    sizes = by_cluster.select("yr", "_part", cluster).distinct().groupBy("yr", "_part").agg(F.count(F.lit(1)).alias("k"))
    header = part_draws(sizes, ["yr"], B, seed).withColumn("_seed", ph(composite_key(F.lit(seed), "yr", "_part", sep=":")))

    def draw(pdf: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        mine = np.asarray(head["draws"].iloc[0])
        names, cluster_of = np.unique(pdf[cluster].to_numpy().astype(str), return_inverse=True)
        cell_keys, cell_of = np.unique(pdf[["y", *codes]].to_numpy(), axis=0, return_inverse=True)
        order = np.argsort(cell_of.ravel(), kind="stable")
        starts = np.searchsorted(cell_of.ravel()[order], np.arange(len(cell_keys)))
        row_cluster, row_n = cluster_of.ravel()[order], pdf["n"].to_numpy(dtype=float)[order]
        rng = np.random.default_rng(int(head["_seed"].iloc[0]))
        y, digits = cell_keys[:, 0], _digits(pd.DataFrame(cell_keys, columns=["y", *codes]), n_members)
        step = max(1, 4_000_000 // max(len(row_n), len(names)))
        out = []
        for first in range(0, B, step):
            k_block = mine[first : first + step]
            rep = np.repeat(np.arange(len(k_block)), k_block)
            hit = rng.integers(0, len(names), len(rep))
            m = np.bincount(rep * len(names) + hit, minlength=len(k_block) * len(names)).reshape(len(k_block), -1)
            w = np.add.reduceat(m[:, row_cluster] * row_n, starts, axis=1)
            out.append(_tally_frame(y, digits, w, np.arange(first, first + len(w))))
        return pd.concat(out, ignore_index=True).assign(yr=head["yr"].iloc[0])

    schema = f"{_typed(cells, ['yr'])}, rep int, _i int, " + ", ".join(f"{c} double" for c in sums)
    tallies = _paired(by_cluster, header, ["yr", "_part"]).applyInPandas(draw, schema)
    added = tallies.groupBy("yr", "rep", "_i").agg(*[F.sum(c).alias(c) for c in sums])
    return _named_members(added.select("yr", "rep", "_i", *[v.alias(k) for k, v in M.f1_columns().items()]), members, member_cols)


def cluster_bootstrap(
    preds: DataFrame, members: Sequence[tuple], cluster: str, B: int, seed: int, draws: str = "multinomial"
) -> tuple[DataFrame, DataFrame]:
    """(slopes with interval, per-replicate slopes) under resampling of products or users."""
    group = ["model", "train_set"]
    cells = cluster_cells(preds, members, cluster)
    point = slopes(seed_mean(member_f1(cells, members, ["yr"]), [*group, "yr"]), group)
    make = cluster_multinomial_f1 if draws == "multinomial" else cluster_hash_f1
    f1 = make(cells, cluster, members, B, seed)
    reps = slopes(seed_mean(f1, [*group, "yr", "rep"]), [*group, "rep"])
    return point.select(*group, "slope").join(interval(reps, group, "slope"), group), reps


def cluster_pair_diff(reps: DataFrame, pairs: Sequence[tuple]) -> DataFrame:
    return interval(_pair_diffs(reps, pairs, ["rep"], ["slope"]), ["a", "b"], "slope_diff")


def retraining_gain(
    preds: DataFrame, models: Sequence[str], seeds: Sequence[int], years: Sequence[int], B: int, seed: int,
    old: str = "early", new: str = "recent", draws: str = "tree",
) -> DataFrame:
    """(model, cls, old, new, gain, lo, hi): F1 averaged over seeds and years, gain of the newer training set."""
    members = [(m, t, s) for m in models for t in (old, new) for s in seeds]
    cells = joint_cells(preds.filter(F.col("yr").isin(*years)), members, ["yr"])
    kinds = [("macro", "macro_f1"), *[(str(c), f"f1_{c}") for c in CLASSES]]

    def gains(f1: DataFrame, keys: list[str]) -> DataFrame:
        both = F.array(*[F.struct(F.lit(k).alias("cls"), F.col(c).alias("v")) for k, c in kinds])
        long = f1.select(*keys, "model", "train_set", F.explode(both).alias("x"))
        at = lambda t: F.avg(F.when(F.col("train_set") == t, F.col("x.v")))
        return long.groupBy(*keys, "model", "x.cls").agg(at(old).alias("old"), at(new).alias("new")).withColumn(
            "gain", F.col("new") - F.col("old")
        )

    point = gains(member_f1(cells, members, ["yr"]), [])
    reps = gains(replicate_f1(cells, members, ["yr"], B, seed, draws), ["rep"])
    return point.join(interval(reps, ["model", "cls"], "gain"), ["model", "cls"])


def gain_contrast(
    preds: DataFrame, contrasts: dict[str, tuple[str, str]], members: Sequence[tuple], years: Sequence[int], B: int, seed: int,
    draws: str = "tree",
) -> DataFrame:
    """(contrast, diff, lo, hi): macro F1 of run a minus run b, e.g. a retrained small model against an old big one."""
    cells = joint_cells(preds.filter(F.col("yr").isin(*years)), members, ["yr"])
    group = ["model", "train_set"]
    point = seed_mean(member_f1(cells, members, ["yr"]), group)
    reps = seed_mean(replicate_f1(cells, members, ["yr"], B, seed, draws), [*group, "rep"])
    pairs = list(contrasts.values())
    p = _pair_diffs(point, pairs, [], ["f1"]).withColumnRenamed("f1_diff", "diff")
    r = interval(_pair_diffs(reps, pairs, ["rep"], ["f1"]), ["a", "b"], "f1_diff")
    name = F
    for k, (a, b) in contrasts.items():
        name = name.when((F.col("a") == a) & (F.col("b") == b), k)
    return p.join(r, ["a", "b"]).select(name.alias("contrast"), "diff", "lo", "hi")


def resample_with_replacement(df: DataFrame, B: int, seed: int, id_col: str = "item_id", block: int = 64) -> DataFrame:
    """(rep, item, weight): n draws with replacement per replicate."""
    indexed, hits = _item_draws(df, B, seed, id_col)

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["rep"].min())
        m = _added_hits(pdf["rep"].to_numpy() - first, pdf["hits"], PART)
        rep, at = np.nonzero(m)
        return pd.DataFrame({"_pos": at + pdf["_part"].iloc[0] * PART, "rep": rep + first, "weight": m[rep, at]})

    blocks = hits.withColumn("_block", F.floor(F.col("rep") / block)).repartition(_tasks(df), "_part", "_block")
    weights = blocks.groupBy("_part", "_block").applyInPandas(weigh, "_pos long, rep int, weight long")
    return weights.hint("merge").join(indexed, "_pos").select("rep", id_col, "weight")


def resample_totals(df: DataFrame, B: int, seed: int, id_col: str = "item_id", block: int = 64) -> DataFrame:
    """(item, drawn, n_reps, most) over the same replicates: all draws of an item, replicates that have it, its largest weight.

    Added up where a part of the items meets its draws, so the table of all weights, ``B`` samples long, is never made.
    """
    indexed, hits = _item_draws(df, B, seed, id_col)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        drawn, n_reps, most = np.zeros((3, PART), np.int64)
        for _, own in pdf.groupby(pdf["rep"] // block):
            m = _added_hits((own["rep"] % block).to_numpy(), own["hits"], PART)
            drawn += m.sum(axis=0)
            n_reps += np.count_nonzero(m, axis=0)
            most = np.maximum(most, m.max(axis=0))
        at = np.flatnonzero(drawn)
        return pd.DataFrame({"_pos": at + pdf["_part"].iloc[0] * PART, "_drawn": drawn[at], "_reps": n_reps[at], "_most": most[at]})

    sums = hits.repartition(_tasks(df), "_part").groupBy("_part").applyInPandas(add, "_pos long, _drawn long, _reps long, _most long")
    named = sums.hint("merge").join(indexed, "_pos").groupBy(id_col)
    return named.agg(F.sum("_drawn").alias("drawn"), F.sum("_reps").alias("n_reps"), F.max("_most").alias("most"))


def _item_draws(df: DataFrame, B: int, seed: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    indexed = cut(dense_index(df.select(id_col), id_col, seed, "_pos"))
    return indexed, draws_in_parts(indexed.agg(F.count(F.lit(1)).alias("total")), [], B, seed)
