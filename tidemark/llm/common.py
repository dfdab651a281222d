"""What the operators of this subpackage share: word classes, bounded arrow batches, row numbers, local forests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a longest run of characters other than the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Bytes of text that one Python step holds as Python objects at a time.
STEP_BYTES = 4_000_000

#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, a null being the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def split_words(text: Column) -> Column:
    """Array of the words of a text that is not null."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def steps(lengths: np.ndarray, budget: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths sum to about ``budget``; a longer single item is a range of its own."""
    start = 0
    while start < len(lengths):
        stop = start + max(1, int(np.searchsorted(np.cumsum(lengths[start:]), budget, side="right")))
        yield start, stop
        start = stop


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_steps(column: pa.Array, budget: int = STEP_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """The texts of an arrow column as UTF-8 bytes, a bounded number of bytes at a time; a null is the empty text."""
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for start, stop in steps(byte_lengths(raw), budget):
        yield start, stop, [x or b"" for x in raw.slice(start, stop - start).to_pylist()]


def with_columns(batch: pa.RecordBatch, keep: Iterable[str], **columns: pa.Array) -> pa.RecordBatch:
    """The kept columns of a batch followed by new ones."""
    keep = list(keep)
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + list(columns.values()), names=keep + list(columns))


def schema_with(df: DataFrame, keep: Iterable[str], **types: T.DataType) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in types.items()])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    name = f"_{stem}"
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def positions(df: DataFrame, *keys: str, name: str = "position") -> DataFrame:
    """Number the rows of every key from 0 in the order they are stored, without bringing a key to one task.

    The rows are written once with their partition and row number, so all jobs see the same ones. Rows are counted by
    (partition, key), the counts summed up before each partition, and the rows of one partition numbered among themselves.
    """
    from pyspark.sql import Window

    from tidemark.session import cut

    part, row, count, earlier, own = (fresh(df, stem) for stem in ("part", "row", "count", "earlier", "own"))
    marked = cut(df.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()}))
    counts = marked.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(count))
    before = counts.withColumn(
        earlier,
        F.coalesce(F.sum(count).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    inside = marked.withColumn(own, F.row_number().over(Window.partitionBy(*keys, part).orderBy(row)) - 1)
    b, i = before.alias("b"), inside.alias("i")
    on = F.col(f"b.{part}") == F.col(f"i.{part}")
    for k in keys:
        on &= F.col(f"b.{k}").eqNullSafe(F.col(f"i.{k}"))
    return i.join(b, on).select("i.*", (F.col(f"b.{earlier}") + F.col(f"i.{own}")).alias(name)).drop(part, row, own)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the graph with edges a-b, roots left out. Works in arrays only."""
    if not len(a):
        return a, b
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class Forest:
    """Edges seen by one task, kept as a forest so that memory follows nodes and not links."""

    def __init__(self, most: int = 400_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b))
            self.size += len(a)
            if self.size > self.most:
                self.edges()
                self.most = max(self.most, 2 * self.size)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        node, root = local_forest(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.size = [(node, root)], len(node)
        return node, root
