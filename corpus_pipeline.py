"""Training-data pipeline: quality rules, line dedup, near-duplicate dedup, source mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared folder
and reads it back as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import importlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, line_dedup, mixing, quality_rules, simhash_dedup
from tidemark.llm.common import WORD_CLASS, fresh, table
from tidemark.session import configure, cut, shared_folder


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps; null and empty texts go."""
    kept = fresh(docs, "kept")
    columns = docs.columns
    names = {c: f"_c{i}" for i, c in enumerate(columns)}  # input columns may be named like a measure
    out = quality_rules.quality_rules(docs.withColumnsRenamed(names), list(names.values()), names["text"])
    return out.withColumnRenamed("kept", kept).filter(kept).select([F.col(names[c]).alias(c) for c in columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier line exactly or nearly; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, scan=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id, of rows with that id one; null ids come last.

    Rows are told apart by a written number, so texts under one id are documents of their own.
    """
    row = fresh(docs, "row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    classes = simhash_dedup.near_duplicates(numbered.select(place.alias("place"), "text"), "place")
    first = classes.filter("place = component_id").select(F.col("place.row").alias(row))
    return numbered.join(first, row, "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: left out, once or twice."""
    copies, copy = fresh(docs, "copies"), fresh(docs, "copy")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.withColumnsRenamed(names)
    size = F.regexp_count(F.col(names["text"]), F.lit(WORD_CLASS + "+"))
    mixed = mixing.mix(plain, size, names["source"], (names["doc_id"], names["text"])).withColumnRenamed("copies", copies).filter(F.col(copies) > 0)
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select([F.col(n).alias(c) for c, n in names.items()])


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    tokenizers = importlib.import_module("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, tokenizers.PATTERN, ["doc_id"])


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: Near-duplicate stages, hash thresholds and byte-pair merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = configure(spark)
    folder = f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}/pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
