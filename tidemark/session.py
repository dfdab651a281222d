"""Session defaults. Nothing here sizes a cluster: executors and memory come from the submit command."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan in this package relies on. Safe to call more than once."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", app: str = "tidemark") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for stage tables: the session's spark.checkpoint.dir, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _OWN_FOLDERS[app]


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, lineage cut, sizes known.

    The copy is plain Parquet, so losing executors does not lose it.
    """
    path = f"{shared_folder(df.sparkSession)}/tidemark/{df.sparkSession.sparkContext.applicationId}/cut/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_checked(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast a frame whose size is not known in advance only after counting it; else leave the join to the planner."""
    written = cut(df)
    return F.broadcast(written) if written.count() <= max_rows else written


def touched_rows(rows: DataFrame, keys: DataFrame, on: list[str], max_rows: int = 1_000_000) -> DataFrame:
    """The rows whose key is in ``keys``, picked where they are read if the distinct keys are few enough to be sent to every
    task; else all rows, so that the caller folds them before it joins them with the keys."""
    written = cut(keys.select(*on).distinct())
    return rows.join(F.broadcast(written), on, "left_semi") if written.count() <= max_rows else rows
