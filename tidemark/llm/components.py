"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Forest
from tidemark.session import cut


def _fold(batches):
    """The links of one partition as a forest: as many rows as nodes, however many links came in."""
    import numpy as np

    forest = Forest()
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        forest.add(a, b)
    node, root = forest.edges()
    for i in range(0, len(node), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 100_000]), pa.array(root[i : i + 100_000])], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link that is not its component's smallest node.

    Links are pairs of longs; nulls and self-links are ignored. Every task first folds its links to a forest; then
    large and small stars alternate until nothing moves. A star's smallest node comes from a partial aggregate and
    goes back over a plain equi-join, whose large keys Spark splits, so a node with very many links is no bottleneck.
    Every round is a written table: a lost executor costs one round at most. The driver sees two numbers a round.
    """
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    edges = cut(edges.mapInArrow(_fold, "a long, b long"))
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = tuple(mark)
        edges = cut(_small_star(_large_star(edges)))
