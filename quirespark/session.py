"""Session helpers: nothing here overrides what a cluster has already set."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quirespark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    where = tempfile.mkdtemp(prefix=f"quirespark-{os.getpid()}-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    where = shared_dir(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return df.checkpoint(eager)


def written(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: smaller on disk than a checkpoint."""
    where = f"{shared_dir(df.sparkSession)}/rows-{uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


#: What is broadcast after a check holds at most so many bytes, written out as JSON.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast behind a check of the size in bytes; beyond it the join shuffles. Give it a written table, as the check reads it once."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df
