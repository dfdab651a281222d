"""Byte-level BPE by the ranks of a vocabulary file: ids with character offsets, and back to bytes.

The ``tokenizers`` library does the merges. It works on characters, so every byte stands for one printable character
(the usual byte table of byte-level BPE), and a rank file becomes its vocabulary and merge list. Texts are cut as for
token counts; equal cuts are encoded once a task. Decoding goes through the byte table backwards: ids give bytes, and
bytes give text even where one character's bytes are spread over several ids.
"""

from __future__ import annotations

import base64
import codecs
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import fresh, schema_with, steps, text_of, text_steps, with_columns
from tidemark.llm.token_counts import CutCache, safe_cuts


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, spare = [], 0x100
    for b in range(256):
        table.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _merged_from(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last merge that makes a token when only lower-ranked tokens are merged before it."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], own)) < own]
        if not found:
            return None
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def library_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A tokenizer of the library that encodes every match of ``pattern`` by ``ranks``."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    name = lambda token: "".join(shown[b] for b in token)
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        first = _merged_from(token, ranks) if len(token) > 1 else None
        splits = [(token[:i], token[i:]) for i in range(1, len(token))]
        splits.sort(key=lambda s: s != first)
        merges += [(name(a), name(b)) for a, b in splits if a in ranks and b in ranks]
    library = Tokenizer(models.BPE({name(t): r for t, r in ranks.items()}, merges))
    library.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)]
    )
    return library


def load(definition: str):
    """The library's tokenizer from its text form, to run on one thread of a task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def _encode(batches, definition, text: str, keep: list[str], offsets: bool):
    library = load(definition.value)

    def encode(pieces: list[str]) -> list:
        if offsets:
            return [(np.array(e.ids, np.int32).tobytes(), np.array(e.offsets, np.int32).reshape(-1, 2)) for e in library.encode_batch(pieces, add_special_tokens=False)]
        return [np.array(e.ids, np.int32).tobytes() for e in library.encode_batch_fast(pieces, add_special_tokens=False)]

    cache = CutCache(encode)

    def lists(values: bytes, sizes: list[int]) -> pa.Array:
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), len(values) // 4, [None, pa.py_buffer(values)]))

    for batch in batches:
        for start, stop, raw in text_steps(batch.column(batch.schema.get_field_index(text))):
            pieces = [safe_cuts(x.decode("utf-8", "replace")) for x in raw]
            known = cache.look_up(pieces)
            out = {}
            if offsets:
                ids = [b"".join([known[p][0] for p in ps]) for ps in pieces]
                spans = []
                for ps in pieces:
                    at, own = 0, []
                    for p in ps:
                        own.append(known[p][1] + at)
                        at += len(p)
                    spans.append(np.concatenate(own) if own else np.empty((0, 2), np.int32))
                for i, side in enumerate(("starts", "ends")):
                    out[side] = lists(b"".join(s[:, i].astype(np.int32).tobytes() for s in spans), [len(s) for s in spans])
            else:
                ids = [b"".join(map(known.__getitem__, ps)) for ps in pieces]
            out = {"ids": lists(b"".join(ids), [len(x) // 4 for x in ids])} | out
            yield with_columns(batch.slice(start, stop - start), keep, **out)


def encode(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", offsets: bool = False) -> DataFrame:
    """``keep`` columns with ``ids`` (array of int) of every row's whole text.

    ``path`` is a rank file (base64 token and rank a line) that the driver can open; the tokenizer is built there once and its
    text form, bounded by the vocabulary, goes to every task. ``pattern`` splits the text before the merges. With ``offsets`` also ``starts`` and ``ends``: for each id the characters of the text it comes
    from; ids that share a character share its place. No special tokens. A null or empty text has no ids. One row for
    each input row, repeated rows included; ``keep`` must not name ``ids``, ``starts`` or ``ends``.
    """
    body = fresh(df, "body")
    lean = df.select(*keep, text_of(text).alias(body))
    ints = T.ArrayType(T.IntegerType(), True)
    types = {"ids": ints} | ({"starts": ints, "ends": ints} if offsets else {})
    definition = df.sparkSession.sparkContext.broadcast(library_tokenizer(read_ranks(path), pattern).to_str())
    return lean.mapInArrow(partial(_encode, definition=definition, text=body, keep=keep, offsets=offsets), schema_with(lean, keep, **types))


def id_bytes(library) -> list[bytes]:
    """Bytes of every id: the characters of the library's vocabulary through the byte table backwards."""
    back = {c: b for b, c in enumerate(byte_characters())}
    names = library.get_vocab()
    table = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        table[i] = bytes(map(back.__getitem__, name))
    return table


def stream_text(table: list[bytes], ids: list[int]) -> list[str]:
    """The text that each further id completes; an id that ends inside a character adds nothing until the rest comes."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return [decoder.decode(table[i], last) for i, last in zip(ids, [False] * (len(ids) - 1) + [True], strict=True)] if ids else []


def _decode(batches, definition, ids: str, keep: list[str], as_text: bool):
    table = id_bytes(load(definition.value))
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(ids))
        sizes = np.diff(column.offsets.to_numpy()).astype(np.int64) * 8
        for start, stop in steps(sizes, 8_000_000):
            got = [None if x is None else b"".join(map(table.__getitem__, x)) for x in column.slice(start, stop - start).to_pylist()]
            out = pa.array([x if x is None else x.decode("utf-8", "replace") for x in got], pa.string()) if as_text else pa.array(got, pa.binary())
            yield with_columns(batch.slice(start, stop - start), keep, decoded=out)


def decode(df: DataFrame, path: str, pattern: str, keep: list[str], ids: str = "ids", as_text: bool = False) -> DataFrame:
    """``keep`` columns with ``decoded``: the bytes of every row's ids, or their text (broken UTF-8 replaced).

    Null ids give null, no ids give no bytes; an id outside the vocabulary fails the job.
    """
    lean = df.select(*keep, ids)
    out = T.StringType() if as_text else T.BinaryType()
    definition = df.sparkSession.sparkContext.broadcast(library_tokenizer(read_ranks(path), pattern).to_str())
    return lean.mapInArrow(partial(_decode, definition=definition, ids=ids, keep=keep, as_text=as_text), schema_with(lean, keep, decoded=out))


def _digests(batches, definition, text: str, keep: list[str]):
    from hashlib import sha256

    library = load(definition.value)
    table = id_bytes(library)
    decimal = [str(i) for i in range(len(table))]

    def encode(pieces: list[str]) -> list[tuple[int, bytes, bytes]]:
        found = [e.ids for e in library.encode_batch_fast(pieces, add_special_tokens=False)]
        return [(len(ids), ",".join([decimal[i] for i in ids]).encode(), b"".join([table[i] for i in ids])) for ids in found]

    cache = CutCache(encode)
    for batch in batches:
        sizes, ids, decoded = [], [], []
        for _, _, raw in text_steps(batch.column(batch.schema.get_field_index(text))):
            pieces = [safe_cuts(x.decode("utf-8", "replace")) for x in raw]
            known = cache.look_up(pieces)
            for own in pieces:
                values = [known[p] for p in own]
                sizes.append(sum([v[0] for v in values]))
                ids.append(sha256(b",".join([v[1] for v in values])).hexdigest())
                decoded.append(sha256(b"".join([v[2] for v in values])).hexdigest())
        yield with_columns(batch, keep, n_tokens=pa.array(sizes, pa.int64()), ids_sha256=pa.array(ids, pa.string()), decoded_sha256=pa.array(decoded, pa.string()))


def round_trip(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and ``decoded_sha256`` (bytes of the ids).

    Every whole text is encoded as by ``encode`` and decoded as by ``decode`` in one pass: a cut's ids, their decimal form and
    their bytes are kept together, and only the two hashes and the count of a text leave the task. Nulls, empty texts and
    repeated rows as there.
    """
    body = fresh(df, "body")
    lean = df.select(*keep, text_of(text).alias(body))
    definition = df.sparkSession.sparkContext.broadcast(library_tokenizer(read_ranks(path), pattern).to_str())
    types = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return lean.mapInArrow(partial(_digests, definition=definition, text=body, keep=keep), schema_with(lean, keep, **types))


def digests(encoded: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The columns of ``round_trip`` from rows that are encoded already."""
    from pyspark.sql import functions as F

    listed = encoded.select(*keep, "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    back = decode(listed, path, pattern, [*keep, "n_tokens", "ids_sha256"])
    return back.select(*keep, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
