"""Page types, routing, OCR runs and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

# Thresholds of a page with a text layer, and of document types.
TEXT_CHARS, BAD_SHARE, HIGH, LOW = 50, 0.25, 0.9, 0.1
MAX_RUNS, PAGES_PER_TASK = 8, 200


def page_texts(markers: DataFrame) -> DataFrame:
    """(doc_id, page_idx, valid, bad): characters of each page over its items."""
    m = markers.where("page_idx is not null").groupBy("doc_id", "item_no").agg(F.max_by(F.struct("page_idx", "text"), "ingested_at").alias("r")).select("doc_id", "r.*")
    t = F.coalesce("text", F.lit(""))
    return m.select("doc_id", "page_idx", S.valid_chars(t).alias("v"), S.suspicious_chars(t).alias("b")).groupBy("doc_id", "page_idx").agg(F.sum("v").cast("long").alias("valid"), F.sum("b").cast("long").alias("bad"))


def is_text_page(valid: Column, bad: Column) -> Column:
    return (valid >= TEXT_CHARS) & (bad <= (valid + bad) * BAD_SHARE)


def document_types(pages: DataFrame) -> DataFrame:
    """(doc_id, type, total, text_pages, suspicious): text, scanned or hybrid by the share of pages with a text layer."""
    chars = F.col("valid") + F.col("bad")
    d = pages.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(is_text_page(F.col("valid"), F.col("bad"))).alias("text_pages"), F.count_if((chars > 0) & (F.col("bad") > chars * BAD_SHARE)).alias("suspicious"))
    share = F.col("text_pages") / F.col("total")
    return d.select("doc_id", F.when(share >= HIGH, "text").when(share <= LOW, "scanned").otherwise("hybrid").alias("type"), "total", "text_pages", "suspicious")


def runs(pages: DataFrame) -> DataFrame:
    """(doc_id, run, first, last, n): runs of consecutive page numbers (doc_id, page_idx), numbered from 0."""
    d = pages.select("doc_id", "page_idx").distinct()
    w = W.partitionBy("doc_id").orderBy("page_idx")
    g = d.withColumn("g", F.col("page_idx") - F.row_number().over(w)).groupBy("doc_id", "g").agg(F.min("page_idx").alias("first"), F.max("page_idx").alias("last"), F.count("*").alias("n"))
    return g.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("first")) - 1).alias("run"), "first", "last", "n")


def buckets(r: DataFrame, limit: int = MAX_RUNS) -> DataFrame:
    """(doc_id, bucket, runs, pages): runs merged evenly into at most ``limit`` buckets, in order."""
    n = F.count("*").over(W.partitionBy("doc_id"))
    # bucket b holds runs [b*n/limit, (b+1)*n/limit)
    b = r.withColumn("of", n).withColumn("bucket", F.when(F.col("of") <= limit, F.col("run")).otherwise(F.floor(((F.col("run") + 1) * limit - 1) / F.col("of"))).cast("int"))
    return b.groupBy("doc_id", "bucket").agg(F.count("*").alias("runs"), F.sum("n").alias("pages"))


def plan(types: DataFrame, ocr: str = "cloud", override: str | None = None, per_task: int = PAGES_PER_TASK) -> DataFrame:
    """(doc_id, kind, backend, ocr_pages, shards): how each document would be read."""
    t = F.col("type")
    local, all_ocr = F.lit(override == "local") | ((t == "text") & F.lit(override is None)), F.lit(override == "ocr") | ((t == "scanned") & F.lit(override is None))
    kind = F.when(local, "pdf-text").when(all_ocr, "pdf-scanned").otherwise("pdf-hybrid")
    pages = F.when(local, 0).when(all_ocr, F.col("total")).otherwise(F.col("total") - F.col("text_pages"))
    p = types.select("doc_id", kind.alias("kind"), F.when(local, "local").when(all_ocr, ocr).otherwise(f"hybrid({ocr})").alias("backend"), pages.cast("long").alias("ocr_pages"))
    return p.withColumn("shards", S.shards(F.col("ocr_pages"), F.lit(per_task)))


def plan_totals(p: DataFrame, quota: int = 1000) -> DataFrame:
    """One row: documents, OCR pages, shards, and whether the daily quota is passed."""
    return p.agg(F.count("*").alias("documents"), F.sum("ocr_pages").cast("long").alias("ocr_pages"), F.sum("shards").cast("long").alias("shards")).withColumn("over_quota", F.col("ocr_pages") > quota)


def page_ranges(meta: DataFrame, per_task: int = PAGES_PER_TASK) -> DataFrame:
    """(doc_id, part, first_page, last_page): ranges of at most per_task pages."""
    m = meta.where("total_pages > 0").select("doc_id", "total_pages", F.explode(F.sequence(F.lit(0), F.floor((F.col("total_pages") - 1) / per_task).cast("int"))).alias("part"))
    return m.select("doc_id", "part", (F.col("part") * per_task + 1).alias("first_page"), F.least("total_pages", (F.col("part") + 1) * per_task).alias("last_page"))


def cover_kind(image_share: Column, chars: Column, images: Column, blocks: Column, prose: Column) -> Column:
    """image, image_text, text or null: whether a first page looks like a cover."""
    return F.when(image_share >= 0.6, "image").when((images > 0) & (chars <= 80), "image_text").when(chars.between(3, 120) & (blocks <= 6) & ~prose, "text")
