"""Conversation structure repair: the cheapest edits that make turns follow ``(s?(ua)+)?``, found in linear space.

The initials of the roles run through four states: nothing yet, after a system turn, after a user turn, after an assistant
turn. Every row is an element that leads from a state to a state at a cost, with the least string of edit letters that
does it at that cost; so is every block of rows, and a conversation is a sequence of blocks. Which states the best edits
pass is found by divide and conquer: costs from the start to the middle and from the end back to the middle meet there, of
the optimal states the one with the least letters is chosen, and both halves are solved alike. The strings that arrive at a
middle end in the edit of the same row, so none is the beginning of another, and their order can be kept as four ranks.

Rows are ordered and numbered by ranges of (conversation, turn), so one conversation may lie on many tasks; blocks are
bounded, and only a few numbers a block meet again by conversation. Texts are rewritten in a stream in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.session import cut

#: Costs of edits and of a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a block are those whose numbers agree but for this many bits.
BLOCK_BITS = 16

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: State after a user or assistant turn that the state asks for; its role; inserts that end a conversation.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = ("user", "user", "assistant", "user")
_TAIL = (0, 2, 1, 0)
_INITIALS = "sua"
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_SOUND, _BLANK, _DUPLICATE, _CUT_SHORT = range(4)
_FAR = 1 << 60


@dataclass(frozen=True)
class Element:
    """``moves``: (from, to, cost, rank of the letters among those of the same start); ``letters`` of a single row."""

    moves: tuple[tuple[int, int, int, int], ...]
    letters: dict[tuple[int, int], str] | None = None


@cache
def row_element(code: int) -> Element:
    """Of a row with role initial ``code // 4`` and fault ``code % 4``: inserts before it, then its own edit."""
    initial, fault = (_INITIALS + "?")[code >> 2], code & 3
    extra = TRUNCATED if fault == _CUT_SHORT else 0
    moves, letters = [], {}
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state = start
        for inserts in range(4):
            ways = [(DELETE, "D", state)]
            if fault in (_SOUND, _CUT_SHORT):
                ways.append((RENAME + extra, "R", _NEXT[state]))
                if (state, initial) in _KEPT:
                    ways.append((extra, "K", _KEPT[state, initial]))
            for cost, letter, end in ways:
                way = (cost + INSERT * inserts, "I" * inserts + letter)
                best[end] = min(best.get(end, way), way)
            state = _NEXT[state]
        order = sorted(text for _, text in best.values())
        for end, (cost, text) in best.items():
            moves.append((start, end, cost, order.index(text)))
            letters[start, end] = text
    return Element(tuple(moves), letters)


def forward(items: list[Element], lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Costs of reaching each state from ``start``, and the ranks of the least letters that do so."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[start] = 0
    for i in range(lo, hi):
        best: list[tuple[int, int, int] | None] = [None] * 4
        for a, b, c, order in items[i].moves:
            if cost[a] < _FAR:
                way = (cost[a] + c, rank[a], order)
                if best[b] is None or way < best[b]:
                    best[b] = way
        found = sorted((x[1], x[2], b) for b, x in enumerate(best) if x)
        cost = [x[0] if x else _FAR for x in best]
        rank = [0] * 4
        for r, (_, _, b) in enumerate(found):
            rank[b] = r
    return cost, rank


def backward(items: list[Element], lo: int, hi: int, end: int) -> list[int]:
    """Costs of reaching ``end`` from each state."""
    cost = [_FAR] * 4
    cost[end] = 0
    for i in range(hi - 1, lo - 1, -1):
        new = [_FAR] * 4
        for a, b, c, _ in items[i].moves:
            new[a] = min(new[a], c + cost[b])
        cost = new
    return cost


def crossings(items: list[Element], start: int, end: int) -> list[tuple[int, int]]:
    """The states before and after every element on the best way from ``start`` to ``end``."""
    out: list[tuple[int, int]] = []

    def solve(lo: int, hi: int, a: int, b: int) -> None:
        if hi - lo == 1:
            out.append((a, b))
            return
        mid = (lo + hi) // 2
        there, rank = forward(items, lo, mid, a)
        back = backward(items, mid, hi, b)
        state = min((there[s] + back[s], rank[s], s) for s in range(4))[2]
        solve(lo, mid, a, state)
        solve(mid, hi, state, b)

    if items:
        solve(0, len(items), start, end)
    return out


def last_state(items: list[Element]) -> tuple[int, int]:
    """The state after the last row on the best way, and the cost of the whole with the inserts at the end."""
    cost, rank = forward(items, 0, len(items), _START)
    total, _, state = min((cost[s] + INSERT * _TAIL[s], rank[s], s) for s in range(4))
    return state, total


def block_element(codes: bytes) -> Element:
    items = [row_element(c) for c in codes]
    moves = []
    for start in range(4):
        cost, rank = forward(items, 0, len(items), start)
        moves += [(start, b, cost[b], rank[b]) for b in range(4) if cost[b] < _FAR]
    return Element(tuple(moves))


def block_letters(codes: bytes, start: int, end: int) -> str:
    items = [row_element(c) for c in codes]
    return "".join(item.letters[step] for item, step in zip(items, crossings(items, start, end), strict=True))


#: Conversations repeat the same few patterns; a task remembers those of short blocks.
_short_element = lru_cache(100_000)(block_element)
_short_letters = lru_cache(100_000)(block_letters)


def _summarise(batches):
    """Of every block its counts, the initials at its ends and its element as moves."""
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for codes in batch.column(2).to_pylist():
            codes = bytes(codes)
            faults = [c & 3 for c in codes]
            names = [(_INITIALS + "?")[c >> 2] for c in codes]
            element = (_short_element if len(codes) <= 64 else block_element)(codes)
            row = [*(faults.count(f) for f in (_BLANK, _DUPLICATE, _CUT_SHORT)), sum(a + b not in _LEGAL for a, b in zip(names, names[1:])), names[0], names[-1]]
            for column, x in zip(out, [*row, [m[0] * 4 + m[1] for m in element.moves], [x for m in element.moves for x in m[2:]]], strict=True):
                column.append(x)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.int64())] * 2
        arrays = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=[*batch.schema.names[:2], *_SUMMARY])


_SUMMARY = ["blank", "duplicate", "truncated", "illegal", "first", "last", "ways", "costs"]
_PATH = pa.list_(pa.struct([("block", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("tail", pa.int64())]))


def _plan(batches):
    """Of every conversation, from its blocks in order: counts, cost, and the states at the ends of every block."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for blocks in batch.column(1).to_pylist():
            items = [Element(tuple((w >> 2, w & 3, *b["costs"][2 * i : 2 * i + 2]) for i, w in enumerate(b["ways"]))) for b in blocks]
            end, cost = last_state(items)
            path = [{"block": b["block"], "start": s, "end": e, "tail": 0} for b, (s, e) in zip(blocks, crossings(items, _START, end), strict=True)]
            path[-1]["tail"] = _TAIL[end]
            joints = sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(blocks, blocks[1:]))
            sums = [sum(b[n] for b in blocks) for n in _SUMMARY[:4]]
            for column, x in zip(out, [*sums[:3], sums[3] + joints, cost, path], strict=True):
                column.append(x)
        arrays = [pa.array(x, t) for x, t in zip(out, [pa.int64()] * 5 + [_PATH], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["conv", *_SUMMARY[:4], "cost", "path"])


def _letters(batches):
    """The edit letters of every block."""
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
        letters = [(_short_letters if len(codes) <= 64 else block_letters)(bytes(codes), start, end) + "I" * tail for codes, start, end, tail in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(letters)], names=["conv", "block", "start", "letters"])


def _edited(batches) -> Iterator[tuple]:
    """(conversation, edit, role, text) in order; a new conversation begins with (conversation, None, None, None).

    The rows of a block follow the block's letters. Deleted rows come with the edit D.
    """
    missing = object()
    current, state, letters, at = missing, _START, "", 0
    keep = _INITIALS

    def inserted():
        nonlocal state, at
        while at < len(letters) and letters[at] == "I":
            yield (current, "I", _ROLE[state], "")
            state, at = _NEXT[state], at + 1

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for conv, start, own, role, text in zip(*columns, strict=True):
            if own is not None:
                yield from inserted()
                if current is missing or conv != current:
                    current = conv
                    yield (conv, None, None, None)
                letters, at, state = own, 0, start
                continue
            yield from inserted()
            edit, at = letters[at], at + 1
            if edit == "R":
                role, state = _ROLE[state], _NEXT[state]
            elif edit == "K":
                state = _KEPT[state, role[:1] if role[:1] in keep else "?"]
            yield (current, edit, role, text)
    yield from inserted()


def _rows(batches, kind: pa.DataType):
    held, size, place = [], 0, 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv", "place", "edit", "role", "text"])

    for conv, edit, role, text in _edited(batches):
        place = place + 1 if edit else 0
        if edit:
            held.append((conv, place, edit, role, text))
            size += len(text) + 50
        if size > 4_000_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _digest(batches, kind: pa.DataType):
    """(conversation, audit, hash of its repaired lines); of the texts only the running hash is kept."""
    import hashlib

    done: list[tuple] = []
    conv, audit, run, lines = None, None, None, 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.string(), pa.string()), strict=True)], names=["conv", "audit", "repaired_sha256"])

    for own, edit, role, text in _edited(batches):
        if edit is None:
            if audit is not None:
                done.append((conv, "".join(audit), run.hexdigest()))
            if len(done) >= 10_000:
                yield batch()
                done = []
            conv, audit, run, lines = own, [], hashlib.sha256(), 0
            continue
        audit.append(edit)
        if edit != "D":
            run.update((("\n" if lines else "") + role + ":" + text).encode())
            lines += 1
    if audit is not None:
        done.append((conv, "".join(audit), run.hexdigest()))
    if done:
        yield batch()


def _by(left: DataFrame, right: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """Join on columns that may be null."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"_{k}" for k in keys])


class Repair:
    """Faults and cheapest edits of every conversation of a table of (conversation, turn, role, text).

    Rows are ordered by turn, nulls first, then by role and text; a null role or text is one space. A row's first fault
    counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated (the
    last character that is not white space is none of ``.!?``). Duplicates are found by MD5 of role and text. Blank and
    duplicate rows must go; a truncated row that stays costs ``TRUNCATED``. Of the cheapest edits those with the least
    letters (D, I, K, R in this order) are taken. A null conversation is a conversation of its own; repeated rows are
    duplicates; an empty table gives no rows; more columns, whatever their names, play no part.

    ``summary``: (conv, turns .. cost) one row a conversation. ``rows()``: the repaired rows with their edits. ``digest()``:
    the letters of the edits and a SHA-256 of the repaired lines; a hash runs over a conversation from its first line to
    its last, so this one step takes a conversation as a stream in one task; everything else is split.
    """

    def __init__(self, conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_bits: int = BLOCK_BITS):
        self.kind = conversations.schema[conv].dataType
        space = F.lit(" ")
        plain = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))
        # Long texts only break ties, so a short beginning of them is enough to choose the ranges; the sort has them whole.
        ordered = plain.repartitionByRange("conv", F.asc_nulls_first("turn"), "role", F.left("text", F.lit(50))).sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
        body = F.rtrim("text", F.lit(SPACE))
        initial = F.left("role", F.lit(1))
        self.ordered = cut(
            ordered.select(
                F.monotonically_increasing_id().alias("pos"), "conv", "turn", "role", "text",
                F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("same"),
                F.when(body == "", _BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), _SOUND).otherwise(_CUT_SHORT).alias("fault"),
                F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
            )
        )
        first = self.ordered.groupBy("conv", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
        marked = self.ordered.select("pos", "conv", "fault", "initial").join(first, "pos", "left")
        fault = F.when((F.col("fault") != _BLANK) & F.col("is_first").isNull(), _DUPLICATE).otherwise(F.col("fault"))
        coded = marked.select("conv", F.shiftright("pos", block_bits).alias("block"), F.struct("pos", (F.col("initial") * 4 + fault).cast("int").alias("code")).alias("at"))
        codes = F.transform(F.sort_array(F.collect_list("at")), lambda x: x["code"])
        self.block_bits = block_bits
        self.blocks = cut(coded.groupBy("conv", "block").agg(codes.alias("codes")))  # at most 2^block_bits rows each
        longs, fields = T.ArrayType(T.LongType()), [T.StructField("conv", self.kind)]
        kinds = dict.fromkeys(_SUMMARY[:4], T.LongType()) | dict.fromkeys(_SUMMARY[4:6], T.StringType()) | dict.fromkeys(_SUMMARY[6:], longs)
        summaries = self.blocks.mapInArrow(_summarise, T.StructType([*fields, T.StructField("block", T.LongType()), *(T.StructField(k, v) for k, v in kinds.items())]))
        whole = summaries.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", *_SUMMARY))).alias("blocks"))
        steps = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("block", "start", "end", "tail")]))
        planned = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in (*_SUMMARY[:4], "cost")), T.StructField("path", steps)])
        self.planned = cut(whole.mapInArrow(_plan, planned))

    @property
    def summary(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost) of every conversation that has rows."""
        turns = self.ordered.groupBy("conv").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("n"))
        gaps = turns.select("conv", F.coalesce((F.col("hi").cast("decimal(38,0)") - F.col("lo") + 1 - F.col("n")).cast("decimal(38,0)"), F.lit(0)).alias("gaps"))
        return _by(self.planned.drop("path"), gaps.withColumn("gaps", F.expr("try_cast(gaps as bigint)")), "conv").select("conv", "gaps", *_SUMMARY[:4], "cost")

    def _stream(self) -> DataFrame:
        """The letters of every block followed by its rows; a conversation's blocks in order on one task."""
        path = self.planned.select("conv", F.explode("path").alias("p")).select("conv", "p.*")
        lettered = T.StructType([T.StructField("conv", self.kind), T.StructField("block", T.LongType()), T.StructField("start", T.LongType()), T.StructField("letters", T.StringType())])
        heads = _by(self.blocks, path, "conv", "block", how="inner").select("conv", "block", "codes", "start", "end", "tail").mapInArrow(_letters, lettered)
        none = lambda kind: F.lit(None).cast(kind)
        heads = heads.select("conv", "block", F.lit(-1).cast("long").alias("pos"), "start", "letters", none("string").alias("role"), none("string").alias("text"))
        rows = self.ordered.select("conv", F.shiftright("pos", self.block_bits).alias("block"), "pos", none("long").alias("start"), none("string").alias("letters"), "role", "text")
        return heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "block", "pos").select("conv", "start", "letters", "role", "text")

    def rows(self) -> DataFrame:
        """(conv, place, edit, role, text): every kept, re-roled, inserted or deleted row in order, from 1; D rows are out."""
        fields = [("conv", self.kind), ("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())]
        return self._stream().mapInArrow(partial(_rows, kind=to_arrow_type(self.kind)), T.StructType([T.StructField(*f) for f in fields]))

    def digest(self) -> DataFrame:
        """(conv, audit, repaired_sha256)."""
        fields = [("conv", self.kind), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]
        return self._stream().mapInArrow(partial(_digest, kind=to_arrow_type(self.kind)), T.StructType([T.StructField(*f) for f in fields]))


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A fixed fifth of the rows made faulty, for measuring a repair: by crc32 of ``conv:turn`` modulo 20 a row is dropped,
    emptied, loses its ``.!?``, comes twice, or gets the role user. Nulls become one space, but for conversation and turn."""
    space = F.lit(" ")
    told = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(told(conv), F.lit(":"), told(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), told(role).alias("role"), told(text).alias("text"), kind.alias("kind")).filter("kind <> 0")
    body: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text))


def damaged_and_repaired(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Every conversation of the table after ``damage``: its faults, the cost and letters of its repair, and a digest."""
    repair = Repair(damage(conversations, conv), conv)
    all_ = conversations.select(F.col(conv).alias("conv")).distinct()
    out = _by(_by(all_, repair.summary, "conv"), repair.digest(), "conv")
    zero = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", *_SUMMARY[:4], "cost")]
    return out.select(F.col("conv").alias(conv), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
