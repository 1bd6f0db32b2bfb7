"""Checks of a result against its source, and of a book's container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Shares that must be kept.
TEXT_ERROR, TEXT_WARN, MATH_KEEP, HEADINGS_KEEP, HEADINGS_MIN, PAGES_KEEP, BREAKS_KEEP = 0.4, 0.9, 0.5, 0.8, 5, 0.9, 0.9
COUNTERS = ("images", "math", "chars", "headings", "breaks", "tables", "code", "footnotes", "links")


def counters(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, *COUNTERS, pages): a projection, no shuffle."""
    t = F.col(text)
    return documents.where(t.isNotNull()).select(
        "doc_id", F.size(S.image_names(t)).alias("images"), S.math_count(t).alias("math"), S.text_chars(t).alias("chars"), S.heading_count(t).alias("headings"), S.hard_breaks(t).alias("breaks"), S.table_count(t).alias("tables"),
        S.code_count(t).alias("code"), S.footnote_defs(t).alias("footnotes"), S.count(F.regexp_replace(S.unfenced(t), S.IMAGE, ""), r"\[[^\]\n]+\]\([^)\n]+\)").alias("links"), F.size(S.page_marks(t)).alias("pages"),
    )


def content_issues(source: DataFrame, target: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(doc_id, code, level): what a result lost of its source; both are tables of counters. A missing target is unreadable."""
    s = source.select("doc_id", *[F.col(c).alias(f"s_{c}") for c in (*COUNTERS, "pages")])
    t = target.select("doc_id", *[F.col(c).alias(f"t_{c}") for c in COUNTERS], F.lit(True).alias("there"))
    j = s.join(t, "doc_id", "left")
    j = j.withColumn("expected", F.lit(None).cast("int")) if expected is None else j.join(expected.select("doc_id", F.col("total_pages").alias("expected")), "doc_id", "left")
    a, b = lambda c: F.col(f"s_{c}"), lambda c: F.col(f"t_{c}")

    def issue(when: Column, code: str, level: str = "warning") -> Column:
        return F.when(when, F.struct(F.lit(f"content_{code}").alias("code"), F.lit(level).alias("level")))

    there = F.col("there").isNotNull()
    rules = [
        issue(~there, "target_unreadable", "error"),
        issue(there & (b("images") < a("images")), "images_lost", "error"), issue(there & (b("images") > a("images")), "images_extra"),
        issue((a("math") > 0) & (b("math") == 0), "math_lost", "error"), issue((b("math") > 0) & (b("math") < a("math") * MATH_KEEP), "math_shrunk"),
        issue((a("chars") > 0) & (b("chars") < a("chars") * TEXT_ERROR), "text_shrunk", "error"), issue((b("chars") >= a("chars") * TEXT_ERROR) & (b("chars") < a("chars") * TEXT_WARN), "text_less"),
        issue((a("headings") >= HEADINGS_MIN) & (b("headings") < a("headings") * HEADINGS_KEEP), "headings_lost"), issue((a("breaks") > 0) & (b("breaks") < a("breaks") * BREAKS_KEEP), "breaks_lost"),
        *[x for c in ("tables", "code", "footnotes") for x in (issue((a(c) > 0) & (b(c) == 0), f"{c}_lost", "error"), issue((b(c) > 0) & (b(c) < a(c)), f"{c}_shrunk"))],
        issue((a("links") > 0) & (b("links") == 0), "links_lost"), issue((F.col("expected") > 0) & (a("pages") > 0) & (a("pages") < F.col("expected") * PAGES_KEEP), "page_coverage"),
    ]
    return j.select("doc_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("i")).select("doc_id", "i.code", "i.level")


def is_fatal(code: Column, level: Column, strict: bool = False) -> Column:
    return (level == "error") | (F.lit(strict) & (level == "warning") & code.startswith("content_"))


def summary(issues: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, errors, warnings, fatal)."""
    return issues.groupBy("doc_id").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"), F.max(is_fatal(F.col("code"), F.col("level"), strict)).alias("fatal"))


def batch_summary(tasks: DataFrame) -> DataFrame:
    """(status, n, seconds)."""
    return tasks.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("elapsed"), 3).alias("seconds"))


def broken_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, href) whose file is not among the targets (doc_id, path), neither as written nor percent-decoded; the web is left alone."""
    rel = links.where(~F.col("href").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//|#)")).withColumn("path", F.regexp_replace("href", "#.*$", "")).where("path <> ''")
    rel = rel.withColumn("decoded", F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    t = targets.select("doc_id", "path").distinct()
    return rel.join(t, ["doc_id", "path"], "left_anti").join(t.withColumnRenamed("path", "decoded"), ["doc_id", "decoded"], "left_anti").select("doc_id", "href")


def chapter_mass(n_chapters: Column, n_empty: Column) -> Column:
    """Whether so many chapters are empty that the book is broken: at least 3 and half of all."""
    return n_empty >= F.greatest(F.lit(3), F.ceil(n_chapters * 0.5))
