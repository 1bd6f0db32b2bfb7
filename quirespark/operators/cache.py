"""Results kept by key: what can be used again, what is missing, what may be adopted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("backend", "part", "source_fp", "variant")


def hits(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Wanted parts (KEY, params_fp) with column hit: a stored part of the same key; parameters count only where the store recorded them."""
    w = wanted.withColumn("variant", F.coalesce("variant", F.lit("original")))
    s = store.select("backend", "part", "source_fp", F.coalesce("variant", F.lit("original")).alias("variant"), F.col("params_fp").alias("_p")).distinct()
    good = s.withColumnsRenamed({c: f"_{c}" for c in KEY})
    cond = [w[c] == good[f"_{c}"] for c in KEY] + [good["_p"].isNull() | w["params_fp"].eqNullSafe(good["_p"])]
    j = w.join(good, cond, "left")
    return j.groupBy(*w.columns).agg(F.max(F.col("_part").isNotNull()).alias("hit"))


def missing(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """The wanted parts without a stored one: only these are submitted."""
    return hits(wanted, store).where(~F.col("hit")).drop("hit")


def adopted(own: DataFrame, others: DataFrame, variant: str) -> DataFrame:
    """Own parts, and those of another variant relabelled where the own one is missing."""
    o = others.withColumn("variant", F.lit(variant))
    return own.unionByName(o.join(own.select("backend", "part", "source_fp").distinct(), ["backend", "part", "source_fp"], "left_anti"), allowMissingColumns=True)


def outcome(parts: DataFrame) -> DataFrame:
    """(task, done, failed, pending, status): a task fails if any part failed, is done when all are; finished parts stay usable."""
    last = parts.groupBy("task", "part").agg(F.max_by("state", "ts").alias("state"))
    g = last.groupBy("task").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("done", "failed")], F.count("*").alias("n"))
    status = F.when(F.col("failed") > 0, "failed").when(F.col("done") == F.col("n"), "done").otherwise("pending")
    return g.select("task", "done", "failed", (F.col("n") - F.col("done") - F.col("failed")).alias("pending"), status.alias("status"))


def preferred(*values: Column) -> Column:
    """The first value that is not null or blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", F.trim(v)) for v in values])


def changed_options(options: Column, baseline: Column) -> Column:
    """Of a map of options those that differ from the baseline."""
    return F.map_filter(options, lambda k, v: ~v.eqNullSafe(F.element_at(baseline, k)))


def backoff_seconds(attempt: Column, most: int = 60) -> Column:
    """2 to the power of the attempt, bounded."""
    return F.least(F.lit(most), F.pow(F.lit(2), attempt)).cast("int")
