"""Whole documents through the rule pipeline: Markdown in, cleaned Markdown out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markdown, rules


def clean_documents(documents: DataFrame, titles: DataFrame | None = None, disabled: tuple[str, ...] = (), pages: DataFrame | None = None, linked: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) of the documents after all enabled rules in their order; see rules.run.

    titles: (doc_id, title), against which the first page is compared. pages: (doc_id, block_id, page_idx) and
    linked: (doc_id, block_id), what evidence tells of the blocks named by markdown.blocks_of. White space in
    front of a document goes. Null texts stay null, a text of blanks becomes ''.
    """
    blocks = markdown.blocks_of(markdown.parsed(documents.where("text is not null")))
    blocks = blocks.select("doc_id", "block_id", "ord", "kind", "level", "text", "trailer", "page_idx")
    if pages is not None:
        known = pages.select("doc_id", "block_id", F.col("page_idx").alias("_p"))
        blocks = blocks.join(known, ["doc_id", "block_id"], "left").withColumn("page_idx", F.coalesce("_p", "page_idx")).drop("_p")
    done = markdown.render_blocks(rules.cleaned(rules.written(blocks), titles, disabled, linked)).withColumnRenamed("text", "cleaned")
    return documents.select("doc_id", "text").join(done, "doc_id", "left").select("doc_id", F.when(F.col("text").isNotNull(), F.coalesce("cleaned", F.lit(""))).alias("text"))


def changes(documents: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(doc_id, chars_before, chars_after, changed) of documents and their cleaned texts."""
    d = documents.select("doc_id", "text").join(cleaned.select("doc_id", F.col("text").alias("after")), "doc_id")
    return d.select("doc_id", F.length("text").alias("chars_before"), F.length("after").alias("chars_after"), (~F.col("text").eqNullSafe(F.col("after"))).alias("changed"))
