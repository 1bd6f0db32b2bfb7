"""Writing blocks, reports, diffs and plans."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version of the written block representation; other versions are refused.
SCHEMA_VERSION = 1
BLOCKS = "doc_id bigint, block_id string, ord int, kind string, level int, text string, trailer string, page_idx int, schema int"


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks as JSON lines, sorted within files by document and order."""
    cols = [c.split(" ")[0] for c in BLOCKS.split(", ")][:-1]
    b = blocks.select(*[F.col(c) if c in blocks.columns else F.lit(None).alias(c) for c in cols], F.lit(SCHEMA_VERSION).alias("schema"))
    b.repartition("doc_id").sortWithinPartitions("doc_id", "ord").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Written blocks; a row of another schema version raises an error."""
    b = spark.read.schema(BLOCKS).json(path)
    ok = F.when(F.col("schema") == SCHEMA_VERSION, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown schema "), F.coalesce(F.col("schema").cast("string"), F.lit("null")))))
    return b.where(ok).drop("schema")


@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """For display: null where either side is null."""
    return pd.Series(["".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), "before", "after")) if isinstance(a, str) and isinstance(b, str) else None for a, b in zip(before, after, strict=True)], dtype=object)


def changed_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, text) of documents whose text changed."""
    return after.join(before.select("doc_id", F.col("text").alias("_b")), "doc_id").where(~F.col("text").eqNullSafe(F.col("_b"))).drop("_b")
