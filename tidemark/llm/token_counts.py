"""Token counts of whole texts with a vocabulary of the ``tokenizers`` library: lengths only, no ids leave a task.

A text is cut before every plain space that a non-space follows. The library's byte-level splitter always starts a new
match there (a run of white space leaves its last space to the word that follows), so the tokens of a text are the tokens
of its cuts one after another. Cuts repeat a lot, so a task encodes each one once, in groups balanced by bytes, and sums.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, schema_with, steps, text_of, text_steps, with_columns

#: White space in Python is a superset of the library's, so a cut made here is always a cut there.
_CUT = re.compile(r"(?= \S)")
#: Cuts remembered by a task before it forgets all of them; limits memory only.
REMEMBERED = 250_000


def safe_cuts(text: str) -> list[str]:
    """The text as pieces that tokenise independently; together they are the text."""
    return _CUT.split(text) if text else []


class CutCache:
    """Value of every cut seen, computed for unseen cuts by ``encode`` in calls of bounded size."""

    def __init__(self, encode, remembered: int = REMEMBERED):
        self.encode, self.remembered, self.values = encode, remembered, {}

    def look_up(self, pieces: list[list[str]]) -> dict:
        if len(self.values) > self.remembered:
            self.values = {}
        new = list(set().union(*pieces).difference(self.values)) if pieces else []
        new.sort(key=len)
        for start, stop in steps(np.array([len(p) for p in new], dtype=np.int64), 500_000):
            self.values.update(zip(new[start:stop], self.encode(new[start:stop]), strict=True))
        return self.values


def _count(batches, path: str, text: str, keep: list[str]):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    cache = CutCache(lambda pieces: [len(e) for e in library.encode_batch_fast(pieces, add_special_tokens=False)])
    for batch in batches:
        counts: list[int] = []
        for _, _, raw in text_steps(batch.column(batch.schema.get_field_index(text))):
            pieces = [safe_cuts(x.decode("utf-8", "replace")) for x in raw]
            known = cache.look_up(pieces)
            counts.extend(sum(map(known.__getitem__, p)) for p in pieces)
        yield with_columns(batch, keep, n_tokens=pa.array(counts, pa.int64()))


def token_counts(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``n_bytes`` (UTF-8) and ``n_tokens`` of every row's whole text.

    ``path`` is a tokenizer file of the tokenizers library that every executor can open. No begin, end or other added
    tokens; special strings inside a text count as the library's default has it; nothing is truncated or padded.
    A null or empty text has 0 bytes and 0 tokens. Every row gives one row, repeated rows included; an empty table
    gives an empty result; columns of the input named ``n_bytes`` or ``n_tokens`` must not be in ``keep``.
    """
    body = fresh(df, "body")
    lean = df.select(*keep, text_of(text).alias(body)).withColumn("n_bytes", F.octet_length(body).cast("long"))
    keep = [*keep, "n_bytes"]
    return lean.mapInArrow(partial(_count, path=path, text=body, keep=keep), schema_with(lean, keep, n_tokens=T.LongType()))
