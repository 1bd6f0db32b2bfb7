import hashlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quirespark.operators import patches as P

DAY = datetime(2024, 1, 1)
SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


def patch(n, target, op="replace_text", before="alt", after="neu", rule="page_numbers", conf="derived", status="proposed", reason=None, sha=None, delay=0):
    return (1, f"p{n:04d}", rule, target, op, before, SHA(before) if sha is None else sha, after, conf, status, reason, DAY + timedelta(hours=n), DAY + timedelta(hours=n + delay))


COLS = "doc_id long, patch_id string, rule_id string, target_block_id string, operation string, before_text string, before_sha256 string, after_text string, confidence string, patch_status string, skip_reason string, created_at timestamp, ingested_at timestamp"


def tables(spark, rows):
    b = spark.createDataFrame([(1, f"b{i}", i, "text", None, t, "\n") for i, t in enumerate(["alt", "alt", "neu", "alt", "alt", "alt", "alt", "alt"])], "doc_id long, block_id string, ord int, kind string, level int, text string, trailer string")
    return b, spark.createDataFrame(rows, COLS)


ROWS = [
    patch(1, "b0"), patch(1, "b0", delay=3), patch(2, "b0"), patch(3, "gone"), patch(4, "gone", "delete_block", after=None), patch(5, "b2"), patch(6, "b1", before="anders"), patch(7, "b3", rule="own_rule", conf="heuristic"),
    patch(8, "b3", rule="join_lines", conf="heuristic"), patch(9, "b4", "delete_block", after=None), patch(10, "b5", "delete_block", after=None, conf="heuristic", rule="join_lines"), patch(11, "b6", "merge_blocks"), patch(12, "b6", "other"), patch(13, "b6", status="skipped", reason="policy"), patch(14, "b7", after="alt"), patch(15, None),
]
WANT = {
    1: ("applied", None), 2: ("failed", "before_mismatch"), 3: ("failed", "target_missing"), 4: ("skipped", "already_applied"), 5: ("skipped", "already_applied"), 6: ("failed", "before_mismatch"), 7: ("suggested", "evidence_insufficient"),
    8: ("applied", None), 9: ("applied", None), 10: ("suggested", "evidence_insufficient"), 11: ("suggested", "evidence_insufficient"), 12: ("unknown", "unknown_rule"), 13: ("skipped", "policy"), 14: ("skipped", "already_applied"), 15: ("failed", "target_missing"),
}


def test_gates(spark):
    b, p = tables(spark, ROWS)
    assert {int(r.patch_id[1:]): (r.status, r.reason) for r in P.decided(p, b).collect()} == WANT


def test_apply_and_revert(spark):
    b, p = tables(spark, ROWS)
    d = P.decided(p, b)
    new = P.applied_blocks(b, d)
    assert {r.block_id: r.text for r in new.collect()} == {"b0": "neu", "b1": "alt", "b2": "neu", "b3": "neu", "b5": "alt", "b6": "alt", "b7": "alt"}
    back = {r.block_id: r.text for r in P.reverted(new, d).collect()}
    assert back == {r.block_id: r.text for r in b.collect()}
    touched = new.withColumn("text", F.when(F.col("block_id") == "b0", "von Hand").otherwise(F.col("text")))
    assert {r.block_id: r.text for r in P.reverted(touched, d).collect()}["b0"] == "von Hand"


def test_reports(spark):
    b, p = tables(spark, ROWS)
    d = P.decided(p, b)
    assert sum(r.n for r in P.stats(d).collect()) == 15
    r = P.report(d).collect()[0].report
    assert r.startswith('{"schema_version":1,"stats":{"n":15,"applied":3}') and r.index("p0001") < r.index("p0015")
    assert P.decided(p.where("false"), b).count() == 0 and P.policy(spark).count() == 10


def test_chains(spark):
    rows = [(1, "b0", 1, "replace_text", SHA("alt"), "mitte"), (1, "b0", 2, "replace_text", SHA("mitte"), "neu"), (1, "b0", 3, "replace_text", SHA("alt"), "x"), (1, "b1", 1, "delete_block", SHA("alt"), None), (1, "b1", 2, "replace_text", SHA("alt"), "x"), (1, "b2", 1, "noop", SHA("neu"), None)]
    p = spark.createDataFrame(rows, "doc_id long, block_id string, step int, operation string, before_sha256 string, after_text string")
    got = {r.block_id: (r.text, r.statuses) for r in P.apply_chains(tables(spark, ROWS)[0], p).collect()}
    assert got == {"b0": ("neu", ["applied:", "applied:", "failed:before_mismatch"]), "b1": (None, ["applied:", "failed:target_missing"]), "b2": ("neu", ["skipped:no_change"])}


def test_dependences_and_sources(spark):
    b, p = tables(spark, ROWS)
    d = P.decided(p, b)
    applied = sorted(r.patch_id for r in d.where("status = 'applied'").collect())
    failed = sorted(r.patch_id for r in d.where("status = 'failed'").collect())[0]
    rests = {applied[0]: failed, applied[1]: applied[0], applied[2]: None}
    on = spark.createDataFrame(list(rests.items()), "patch_id string, depends_on string")
    got = {r.patch_id: (r.status, r.reason) for r in P.decided(p.join(on, "patch_id", "left"), b).collect()}
    assert got[applied[0]] == got[applied[1]] == ("failed", "dependency_failed") and got[applied[2]][0] == "applied"
    other = p.withColumn("source_sha256", F.lit("a")).withColumn("source_now", F.when(F.col("patch_id") == applied[0], "b").otherwise("a"))
    got = {r.patch_id: (r.status, r.reason) for r in P.decided(other, b).collect()}
    assert got[applied[0]] == ("failed", "source_changed") and got[applied[1]][0] == "applied"


def test_verification(spark):
    b, p = tables(spark, ROWS)
    d = P.decided(p, b)
    after = P.applied_blocks(b, d)
    assert P.verified(b, after, d).count() == 0
    wrong = after.where("block_id <> 'b7'").withColumn("text", F.when(F.col("block_id").isin("b0", "b1"), "von Hand").otherwise(F.col("text"))).unionByName(b.limit(1).withColumn("block_id", F.lit("zz")).select(after.columns))
    assert {(r.block_id, r.problem) for r in P.verified(b, wrong, d).collect()} == {("b0", "not_replaced"), ("b1", "changed"), ("b7", "lost"), ("zz", "unknown")}
