"""Queries of the problems; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import latest, table
from . import boilerplate, confusables, languages, leakage, levels, markup, mixture, scans

Query = Callable[[SparkSession, str], DataFrame]


# 1: languages of books, titles and passages
def _books(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "blocks", "doc_id", "block_id", "ord", "kind", "text"), table(spark, d, "book_meta", "doc_id", "title", "lang")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.cases(*_books(spark, d))


def p1_books(spark: SparkSession, d: str) -> DataFrame:
    return languages.all_books(*_books(spark, d))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(*_books(spark, d))


# 2: noise in text from scanned pages
def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "blocks", "doc_id", "block_id", "kind", "text"), table(spark, d, "page_markers", "doc_id", "item_no", "item_type", "text", "text_level", "ingested_at"), table(spark, d, "book_meta", "doc_id", "title")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(*_scans(spark, d))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_texts(*_scans(spark, d))


# 3: lines repeated across one site's documents
def _repeated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    blocks = table(spark, d, "blocks")
    lines, found = boilerplate.repeated(blocks, table(spark, d, "doc_meta", "doc_id", "source", "ingested_at"), table(spark, d, "book_meta", "doc_id", "title"))
    return blocks, lines, found


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _repeated(spark, d)[1].select("doc_id", "block_id", "line_no")


def p3_repeated_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Repeated blocks of lines by source, with their forms."""
    _, lines, found = _repeated(spark, d)
    names = lines.groupBy("key").agg(F.min("form").alias("form"))
    at = found.select("source", "keys", "n_docs", F.posexplode("keys").alias("i", "key")).join(names, "key")
    return at.groupBy("source", "keys", "n_docs").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "form"))), lambda x: x["form"]), " / ").alias("block")).select("source", "block", "n_docs")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    blocks, lines, _ = _repeated(spark, d)
    return boilerplate.removed(blocks, lines)


# 4: markup residue
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.residue_rows(table(spark, d, "blocks", "doc_id", "block_id", "kind", "text"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned(table(spark, d, "blocks", "doc_id", "block_id", "kind", "text"))


# 5: visually identical text
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.look_alike_patches(table(spark, d, "patches", "doc_id", "patch_id", "target_block_id", "before_text"), table(spark, d, "blocks", "doc_id", "block_id", "text"))


def p5_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = latest(table(spark, d, "blocks", "doc_id", "block_id", "text", "ingested_at"), ["doc_id", "block_id"])
    return confusables.with_consistent_form(b, "text").select("doc_id", "block_id", "consistent", "consistent_mixed", "consistent_whole")


def p5_patches(spark: SparkSession, d: str) -> DataFrame:
    p = latest(table(spark, d, "patches", "doc_id", "patch_id", "before_text", "ingested_at"), ["doc_id", "patch_id"])
    return confusables.with_consistent_form(p, "before_text").select("doc_id", "patch_id", "consistent", "consistent_mixed", "consistent_whole")


# 6: evaluation texts in documents
def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text", "answer"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.by_item(_leaks(spark, d))


# 7: mixing sources to target weights
def _mix(spark: SparkSession, d: str, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    return mixture.mixed(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets", "source", "target_share", "max_repeats"), total)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixture in which every source that has documents reaches its share."""
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p7_sized_mixture(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of a billion tokens, or what the caps on repeats allow of it; shares below target are those of short sources."""
    return _mix(spark, d, 1_000_000_000)[0]


def p7_sized_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, 1_000_000_000)[1]


# 8: reading level of each document
def _levels(spark: SparkSession, d: str) -> DataFrame:
    return levels.levels(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "level_ratings", "doc_id", "band"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("long_enough").select("doc_id", "band")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "n_chars", F.round("score", 5).alias("score"), "band", "long_enough")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return levels.profile(_levels(spark, d))


def queries() -> dict[str, Query]:
    return {k: f for k, f in sorted(globals().items()) if k[0] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
