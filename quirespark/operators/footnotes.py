"""Footnote references and notes: scan, match, rewrite."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "[①-⑳]"


def notes(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, page, marker, body): lines (doc_id, line_no, line, page) that begin with a circled number."""
    n = lines.where(F.trim("line").rlike(f"^{MARK}"))
    return n.select("doc_id", "line_no", "page", F.substring(F.trim("line"), 1, 1).alias("marker"), F.trim(F.expr("substring(trim(line), 2)")).alias("body"))


def references(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, at, page, marker): circled numbers in lines that are no notes and stand outside fences."""
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    fenced = F.sum(F.col("line").startswith("```").cast("int")).over(w)
    free = lines.withColumn("f", fenced).where((F.col("f") % 2 == 0) & ~F.col("line").startswith("```") & ~F.trim("line").rlike(f"^{MARK}"))
    return free.select("doc_id", "line_no", "page", F.posexplode(F.regexp_extract_all("line", F.lit(f"({MARK})"), F.lit(1))).alias("at", "marker"))


def match(refs: DataFrame, notes_: DataFrame, tolerance: int = 1) -> DataFrame:
    """(doc_id, marker, ref_line, ref_at, note_line, confidence).

    Markers whose references and notes are equally many pair in order, if every note stands on its reference's page
    or at most ``tolerance`` pages later; otherwise none of the group pairs. (Unequal groups: see match_rest.)
    """
    r = refs.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "marker").orderBy("line_no", "at")))
    n = notes_.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "marker").orderBy(F.col("page").asc_nulls_last(), "line_no")))
    size = lambda d, c: d.groupBy("doc_id", "marker").agg(F.count("*").alias(c))
    even = size(r, "a").join(size(n, "b"), ["doc_id", "marker"]).where("a = b").select("doc_id", "marker")
    j = r.select("doc_id", "marker", "k", F.col("line_no").alias("ref_line"), F.col("at").alias("ref_at"), F.col("page").alias("rp")).join(
        n.select("doc_id", "marker", "k", F.col("line_no").alias("note_line"), F.col("page").alias("np")), ["doc_id", "marker", "k"]
    ).join(even, ["doc_id", "marker"], "left_semi")
    ok = F.min((F.coalesce(F.col("np") - F.col("rp"), F.lit(-1)).between(0, tolerance)).cast("int")).over(W.partitionBy("doc_id", "marker"))
    return j.withColumn("ok", ok).where("ok = 1").select("doc_id", "marker", "ref_line", "ref_at", "note_line", F.when(F.col("np") == F.col("rp"), "high").otherwise("medium").alias("confidence"))


_PAIR = T.StructType([T.StructField("ref", T.IntegerType()), T.StructField("note", T.IntegerType()), T.StructField("confidence", T.StringType())])


def pair_rest(ref_pages: list, note_pages: list, tolerance: int = 1) -> list[tuple[int, int, str]]:
    """Notes of an unequal group in order take the only free reference on their page, else the only one within the tolerance before."""
    used: set[int] = set()
    out = []
    for k, page in enumerate(note_pages):
        if page is None or page != page:
            continue
        free = [i for i, p in enumerate(ref_pages) if i not in used and p is not None and p == p]
        same = [i for i in free if ref_pages[i] == page]
        near = [i for i in free if 0 < page - ref_pages[i] <= tolerance]
        pick = (same[0], "high") if len(same) == 1 else (near[0], "medium") if len(near) == 1 else None
        if pick:
            used.add(pick[0])
            out.append((pick[0], k, pick[1]))
    return out


def match_rest(refs: DataFrame, notes_: DataFrame, tolerance: int = 1) -> DataFrame:
    """The pairs of groups with unequal numbers, one fold per (doc_id, marker)."""
    r = refs.groupBy("doc_id", "marker").agg(F.sort_array(F.collect_list(F.struct("line_no", "at", "page"))).alias("r"))
    n = notes_.groupBy("doc_id", "marker").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("page", F.lit(1 << 30)).alias("o"), "line_no", "page"))).alias("n"))

    @F.pandas_udf(T.ArrayType(_PAIR))
    def run(rp: pd.Series, np_: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("ref", "note", "confidence"), x, strict=True)) for x in pair_rest(list(a), list(b), tolerance)] for a, b in zip(rp, np_, strict=True)], dtype=object)

    j = r.join(n, ["doc_id", "marker"]).where("size(r) <> size(n)").select("doc_id", "marker", "r", "n", F.explode(run(F.col("r.page"), F.col("n.page"))).alias("p"))
    return j.select("doc_id", "marker", F.get("r", F.col("p.ref"))["line_no"].alias("ref_line"), F.get("r", F.col("p.ref"))["at"].alias("ref_at"), F.get("n", F.col("p.note"))["line_no"].alias("note_line"), "p.confidence")


def numbered(links: DataFrame) -> DataFrame:
    """Links with their number in the document, by place of the reference."""
    return links.withColumn("number", F.row_number().over(W.partitionBy("doc_id").orderBy("ref_line", "ref_at")))


def rewritten(lines: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) with matched references as [^n] and matched notes as definitions; other lines unchanged."""
    n = numbered(links)
    as_ref = n.groupBy("doc_id", F.col("ref_line").alias("line_no")).agg(F.map_from_entries(F.collect_list(F.struct("ref_at", "number"))).alias("refs"))
    as_note = n.select("doc_id", F.col("note_line").alias("line_no"), F.col("number").alias("note"))
    j = lines.join(as_ref, ["doc_id", "line_no"], "left").join(as_note, ["doc_id", "line_no"], "left")
    parts = F.split("line", MARK, -1)
    marks = F.regexp_extract_all("line", F.lit(f"({MARK})"), F.lit(1))
    built = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(marks, lambda m, i: F.concat(F.coalesce(F.concat(F.lit("[^"), F.element_at("refs", i).cast("string"), F.lit("]")), m), F.get(parts, i + 1))), ""))
    definition = F.concat(F.lit("[^"), F.col("note").cast("string"), F.lit("]: "), F.trim(F.expr("substring(trim(line), 2)")))
    return j.select("doc_id", "line_no", F.when(F.col("note").isNotNull(), definition).when(F.col("refs").isNotNull(), built).otherwise(F.col("line")).alias("line"))
