"""Incremental batch operators: work that is picked up where the last run stopped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a write to this path has finished (it then holds the success marker)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def build_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], partition_by: Sequence[str] = ()) -> DataFrame:
    """Read the table, building it first if no finished copy exists. An unfinished copy is replaced."""
    if not exists(spark, path):
        w = make().write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.parquet(path)


def remaining(todo: DataFrame, log: DataFrame, key: str = "item_id") -> DataFrame:
    """Items without a label in the log yet: failures are tried again, successes are skipped."""
    return todo.join(log.filter(F.col("label").isNotNull()).select(key), key, "left_anti")


def append_resume(
    todo: DataFrame, log_path: str, label: Callable[[DataFrame], DataFrame], key: str = "item_id"
) -> DataFrame:
    """Label what is left and append it to the log; returns the whole log. Safe to run again after a failure."""
    spark = todo.sparkSession
    left = remaining(todo, spark.read.parquet(log_path), key) if exists(spark, log_path) else todo
    label(left).write.mode("append").parquet(log_path)
    return spark.read.parquet(log_path)


def score_with(df: DataFrame, fn: Callable, text_col: str = "text", key: str = "item_id") -> DataFrame:
    """Run a user's text -> label function over Arrow batches: (key, label)."""

    def run(batches):
        for pdf in batches:
            yield pdf[[key]].assign(label=[fn(t) for t in pdf[text_col]])

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, text_col).mapInPandas(run, f"{key} {key_type}, label string")
