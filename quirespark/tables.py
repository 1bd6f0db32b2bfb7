"""Reading the input tables and collapsing repeated deliveries."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver did; elsewhere it is installed or shipped."""
    env = getattr(getattr(spark, "sparkContext", None), "environment", None)
    if env is not None and _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, env.get("PYTHONPATH", "")) if p)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, pruned to the named columns so that only they are scanned."""
    reachable(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, keys: list[str], order: str = "ingested_at") -> DataFrame:
    """One row per key: the last delivered (ties: any, deliveries carry the same content).

    Pre-aggregates on the map side (max_by is a partial aggregate), so a key
    delivered very often does not gather in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.coalesce(F.col(order).cast("long"), F.lit(-1)))
    return df.groupBy(*keys).agg(packed.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def source_key(c: Column | str) -> Column:
    """Sources are the same up to case and outer spaces; blank is null."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(k != "", k)
