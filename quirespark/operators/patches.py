"""Patches: auditable changes of blocks, applied through gates and revertible.

Gates that look at one patch and its block are one CASE over a join. Patches of
one block form a chain (each must find what the one before left): a window
numbers them, and the few blocks with several are folded in one Arrow function
by (doc_id, block_id), so that books of any length spread over all tasks.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import POLICY

# What a patch can say and become.
OPERATIONS = ("replace_text", "delete_block", "set_level", "noop", "set_prefix", "merge_blocks")
STATUSES = ("proposed", "applied", "suggested", "skipped", "rejected", "failed", "unknown")
DECIDED = ("suggested", "skipped", "rejected", "unknown")
DESTRUCTIVE = ("delete_block", "merge_blocks")
AUTO_RULES = tuple(r for r, _, auto in POLICY if auto)


def first_of_each(patches: DataFrame) -> DataFrame:
    """Patches once per (doc_id, patch_id), with their place in the document's order."""
    w = W.partitionBy("doc_id", "patch_id").orderBy(F.col("created_at"), F.col("ingested_at"))
    return patches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def gates(allowed: tuple[str, ...] = AUTO_RULES) -> Column:
    """status:reason of one patch joined with its block (columns text, kind, editable; null text: no such block)."""
    heuristic = (F.col("confidence") == "heuristic") & ~F.col("rule_id").isin(*allowed)
    enough = F.coalesce(F.col("evidence_ok"), F.lit(False))
    same_hash = F.sha2(F.col("text"), 256) == F.col("before_sha256")
    out = (
        F.when(F.col("patch_status").isin(*DECIDED), F.concat(F.col("patch_status"), F.lit(":"), F.coalesce("skip_reason", F.lit(""))))
        .when(F.col("rule_id").isNull() | ~F.col("operation").isin(*OPERATIONS), "unknown:unknown_rule")
        .when(F.col("text").isNull(), F.when(F.col("operation") == "delete_block", "skipped:already_applied").otherwise("failed:target_missing"))
        .when(~F.coalesce(F.col("editable"), F.lit(True)), "rejected:readonly_block")
        .when((F.col("operation") == "replace_text") & (F.col("text") == F.col("after_text")), "skipped:already_applied")
        .when(~F.coalesce(same_hash, F.lit(False)), "failed:before_mismatch")
        .when(heuristic, "suggested:evidence_insufficient")
        .when(F.col("operation").isin(*DESTRUCTIVE) & ~enough, "suggested:evidence_insufficient")
        .when((F.col("operation") == "replace_text") & (F.col("after_text") == F.col("before_text")), "skipped:no_change")
        .when(F.col("operation") == "merge_blocks", "rejected:merge_not_supported")
        .otherwise("applied:")
    )
    return out


def decided(patches: DataFrame, blocks: DataFrame, allowed: tuple[str, ...] = AUTO_RULES) -> DataFrame:
    """Each patch once with status and reason against the block as it stands (the first patch of a block is the chain's head)."""
    p = first_of_each(patches).withColumnRenamed("target_block_id", "block_id")
    if "evidence_ok" not in p.columns:
        # a deletion carries its own evidence where it names the whole block
        p = p.withColumn("evidence_ok", (F.col("operation") == "delete_block") & F.col("confidence").isin("explicit", "derived"))
    b = blocks.select("doc_id", "block_id", "text", "kind").withColumn("editable", F.lit(True))
    j = p.join(b, ["doc_id", "block_id"], "left").withColumn("_g", gates(allowed))
    w = W.partitionBy("doc_id", "block_id").orderBy("created_at", "patch_id")
    applied = F.substring_index("_g", ":", 1) == "applied"
    before = F.sum(applied.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    # a second patch on a block finds what the first left, not what it expects
    j = j.withColumn("_g", F.when(applied & (F.coalesce(before, F.lit(0)) > 0), "failed:before_mismatch").otherwise(F.col("_g")))
    if "source_sha256" in j.columns:
        # made for another state of the document; sources: (doc_id, source_now) joined by the caller
        j = j.withColumn("_g", F.when((F.substring_index("_g", ":", 1) == "applied") & (F.col("source_sha256") != F.col("source_now")), "failed:source_changed").otherwise(F.col("_g")))
    j = j.withColumns({"status": F.substring_index("_g", ":", 1), "reason": F.nullif(F.substring_index("_g", ":", -1), F.lit(""))}).drop("_g")
    return depending(j) if "depends_on" in j.columns else j


def depending(decided_: DataFrame, longest: int = 8) -> DataFrame:
    """Patches that rest on one that was not applied fail too, down rows of ``longest`` dependences.

    What is no patch of the document counts as not applied. Each step is a join by (doc_id, patch_id).
    """
    d = decided_
    for _ in range(longest):
        good = d.where("status = 'applied'").select("doc_id", F.col("patch_id").alias("depends_on"), F.lit(True).alias("_ok"))
        lost = (F.col("status") == "applied") & F.col("depends_on").isNotNull() & F.col("_ok").isNull()
        d = d.join(good, ["doc_id", "depends_on"], "left").withColumns({"reason": F.when(lost, "dependency_failed").otherwise(F.col("reason")), "status": F.when(lost, "failed").otherwise(F.col("status"))}).drop("_ok")
    return d


def verified(before: DataFrame, after: DataFrame, decided_: DataFrame) -> DataFrame:
    """(doc_id, block_id, problem) of blocks that are not what the applied patches make of them.

    Problems: 'not_replaced', 'not_deleted', 'lost' (gone without a patch), 'changed' (another text without a patch),
    'unknown' (not there before).
    """
    a = decided_.where("status = 'applied'").groupBy("doc_id", "block_id").agg(F.max_by("operation", "created_at").alias("operation"), F.max_by("after_text", "created_at").alias("want"))
    b = before.select("doc_id", "block_id", F.col("text").alias("old"), F.lit(True).alias("was"))
    n = after.select("doc_id", "block_id", F.col("text").alias("new"), F.lit(True).alias("stands"))
    j = b.join(n, ["doc_id", "block_id"], "full").join(a, ["doc_id", "block_id"], "left")
    gone = F.col("operation") == "delete_block"
    problem = (
        F.when(F.col("was").isNull(), "unknown").when(F.coalesce(gone, F.lit(False)), F.when(F.col("stands"), "not_deleted"))
        .when(F.col("stands").isNull(), "lost").when(F.col("operation") == "replace_text", F.when(~F.col("new").eqNullSafe(F.col("want")), "not_replaced"))
        .when(~F.col("new").eqNullSafe(F.col("old")), "changed")
    )
    return j.select("doc_id", "block_id", problem.alias("problem")).where("problem is not null")


def applied_blocks(blocks: DataFrame, decided_: DataFrame) -> DataFrame:
    """Blocks after the applied patches: texts replaced, levels set, deleted ones gone."""
    a = decided_.where("status = 'applied'").select("doc_id", "block_id", "operation", "after_text", *(["after_level"] if "after_level" in decided_.columns else []))
    j = blocks.join(a, ["doc_id", "block_id"], "left").where("operation is null or operation <> 'delete_block'")
    level = F.coalesce("after_level", "level") if "after_level" in a.columns else F.col("level")
    return j.withColumns({"text": F.when(F.col("operation") == "replace_text", F.col("after_text")).otherwise(F.col("text")), "level": level}).drop("operation", "after_text", "after_level")


_CHAIN = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("block_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("statuses", T.ArrayType(T.StringType()))])


def _sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def chain(text: str | None, patches: list[dict]) -> tuple[str | None, list[str]]:
    """(text, statuses) after one block's patches in order; each must find the text it was made for."""
    out = []
    for p in patches:
        if text is None:
            out.append("skipped:already_applied" if p["operation"] == "delete_block" else "failed:target_missing")
        elif p["operation"] == "replace_text" and p["after_text"] == text:
            out.append("skipped:already_applied")
        elif p["before_sha256"] is not None and _sha(text) != p["before_sha256"]:
            out.append("failed:before_mismatch")
        elif p["operation"] == "delete_block":
            text = None
            out.append("applied:")
        elif p["operation"] == "replace_text" and p["after_text"] is not None:
            text = p["after_text"]
            out.append("applied:")
        else:
            out.append("skipped:no_change")
    return text, out


def apply_chains(blocks: DataFrame, patches: DataFrame) -> DataFrame:
    """(doc_id, block_id, text, statuses) of blocks with patches, in the order of column step, ord within a block."""
    p = patches.groupBy("doc_id", "block_id").agg(F.sort_array(F.collect_list(F.struct("step", "operation", "before_sha256", "after_text"))).alias("p"))
    j = blocks.select("doc_id", "block_id", "text").join(p, ["doc_id", "block_id"])

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("statuses", T.ArrayType(T.StringType()))]))
    def run(texts: pd.Series, ps: pd.Series) -> pd.DataFrame:
        got = [chain(t if isinstance(t, str) else None, list(q)) for t, q in zip(texts, ps, strict=True)]
        return pd.DataFrame({"text": [g[0] for g in got], "statuses": [g[1] for g in got]})

    return j.select("doc_id", "block_id", run("text", "p").alias("r")).select("doc_id", "block_id", "r.text", "r.statuses")


def reverted(blocks: DataFrame, decided_: DataFrame) -> DataFrame:
    """Blocks with applied patches taken back, each only where the text is still what the patch left; deleted blocks return."""
    a = decided_.where("status = 'applied'").select("doc_id", "block_id", "operation", "before_text", F.col("after_text").alias("left"))
    j = blocks.join(a.where("operation = 'replace_text'"), ["doc_id", "block_id"], "left")
    back = j.withColumn("text", F.when((F.col("operation") == "replace_text") & (F.col("text") == F.col("left")), F.col("before_text")).otherwise(F.col("text"))).drop("operation", "before_text", "left")
    gone = a.where("operation = 'delete_block'").select("doc_id", "block_id", F.col("before_text").alias("text"))
    missing = gone.join(blocks.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti")
    return back.unionByName(missing, allowMissingColumns=True)


def stats(decided_: DataFrame) -> DataFrame:
    """(rule_id, status, n) over all documents."""
    return decided_.groupBy("rule_id", "status").agg(F.count("*").alias("n"))


def report(decided_: DataFrame) -> DataFrame:
    """(doc_id, report): one JSON text per document with its patches in order."""
    rows = F.struct("patch_id", "rule_id", "block_id", "operation", "status", "reason")
    d = decided_.groupBy("doc_id").agg(F.sort_array(F.collect_list(rows)).alias("patches"), F.count("*").alias("n"), F.count_if(F.col("status") == "applied").alias("applied"))
    return d.select("doc_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.struct("n", "applied").alias("stats"), "patches")).alias("report"))


def policy(spark) -> DataFrame:
    """The rules in order, with confidence and whether they apply by themselves."""
    return spark.createDataFrame([(i, r, c, a) for i, (r, c, a) in enumerate(POLICY)], "step int, rule_id string, confidence string, auto_apply boolean")
