"""Readers. Each returns a DataFrame with a declared schema; file names become columns where they carry meaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import dedup_dimension, keep_last
from tidemark.operators.winners import split_repeated
from tidemark.session import cut
from tidemark.sources import schemas


def read_reviews_jsonl(spark: SparkSession, path: str, schema: str = schemas.REVIEW, partitions: int | None = None) -> DataFrame:
    """Gzip or plain JSON lines. A gzip file is one task, so spread its rows before anything heavy."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def read_meta_jsonl(spark: SparkSession, path: str, schema: str = schemas.META) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_parquet(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def read_named_samples(
    spark: SparkSession, path: str, pattern: str = r"^([^/]+?)(?:\.parquet)?$", name: str = "sample", folders: bool = False
) -> DataFrame:
    """Many sample files as one table; the sample name is cut out of the file (or folder) name."""
    source = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2) if folders else F.col("_metadata.file_name")
    df = spark.read.parquet(path)
    return df.select(F.regexp_extract(source, pattern, 1).alias(name), *df.columns)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV with every column as text, so long numbers keep their digits."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(path)


def read_csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def effective_labels(log: DataFrame) -> DataFrame:
    """The label that counts per (source, model, item): the last one that is not null."""
    labelled = log.filter(F.col("label").isNotNull()).select("source", "model", "item_id", "label", "utc")
    return keep_last(cut(labelled), ["source", "model", "item_id"], ["utc", "label"]).select("source", "model", "item_id", "label")


# Fixed value: ``<source>__<model>`` in the name of a log file, or of the folder Spark wrote it to.
LOG_NAME = r"([^/=]+?)__([^/]+?)(?:\.jsonl(?:\.gz)?)?(?:/part-[^/]*)?$"


def read_annotation_log(spark: SparkSession, path: str, schema: str = schemas.RATER_LOG, pattern: str = LOG_NAME) -> DataFrame:
    """Annotation logs named ``<source>__<model>.jsonl``: source and model from the name, last label per item."""
    df = spark.read.schema(schema).json(path)
    where = F.col("_metadata.file_path")
    named = df.select(
        F.regexp_extract(where, pattern, 1).alias("source"),
        F.regexp_extract(where, pattern, 2).alias("model"),
        "item_id",
        "label",
        "utc",
    )
    return effective_labels(named)


# Fixed value: an item id is S, the first three characters of the file's name, an underline and the sentence's own id.
XML_NAME = r"([^/=]+?)(?:\.xml)?(?:/part-[^/]*)?$"
ITEM_ID = "S{0}_{1}"


def read_aspect_xml(spark: SparkSession, path: str, row_tag: str = "sentence", pattern: str = XML_NAME) -> DataFrame:
    """(sentence_id, text, polarities) from XML files of sentences with nested aspect terms, one row per sentence.

    Ids of several files may be alike, so ``sentence_id`` also names the file, or the folder that Spark wrote it to. Of
    sentences with one id the one of the smallest text and polarities stays.
    """
    schema = "_id string, text string, aspectTerms struct<aspectTerm: array<struct<_polarity: string>>>"
    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    source = F.left(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), F.lit(3))
    terms = F.coalesce(F.col("aspectTerms.aspectTerm._polarity"), F.array().cast("array<string>"))
    named = df.select(F.format_string(ITEM_ID.format("%s", "%s"), source, "_id").alias("sentence_id"), "text", terms.alias("polarities"))
    lone, repeated = split_repeated(cut(named), ["sentence_id"])
    return lone.unionByName(dedup_dimension(repeated, ["sentence_id"], ["text", "polarities"]))
