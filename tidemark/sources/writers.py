"""Writers. All of them write from the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet_zstd(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error", compression: str = "none") -> None:
    df.write.mode(mode).option("header", True).option("compression", compression).csv(path)


def summary_struct(**parts: DataFrame) -> DataFrame:
    """One row with a nested struct per named one-row frame."""
    first = next(iter(parts.values()))
    return first.sparkSession.range(1).select(
        *[df.select(F.struct(*df.columns)).scalar().alias(name) for name, df in parts.items()]
    )


def write_summary(df_one_row: DataFrame, path: str, mode: str = "error") -> None:
    df_one_row.coalesce(1).write.mode(mode).json(path)


def save_samples(samples: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per sample."""
    samples.withColumn("set", F.col("sample")).write.mode(mode).partitionBy("set").parquet(path)


def save_membership(samples: DataFrame, path: str, mode: str = "error") -> None:
    """Sorted (sample, item) list: range-partitioned, so file order is global order."""
    write_csv(samples.select("sample", "item_id").orderBy("sample", "item_id"), path, mode)
