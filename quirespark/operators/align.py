"""Pages of blocks: alignment with layout evidence, filling, and audits.

Candidate pairs come from equi-joins on (doc_id, anchor); only picking the
monotone sequence is a fold, over one document's candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import text as X

# Kinds of layout items by their type or label.
EVIDENCE_KINDS = {
    "text": "text", "title": "heading", "header": "header", "footer": "footer", "page_number": "page_number", "page_footnote": "footnote", "footnote": "footnote",
    "image": "image", "figure": "image", "table": "table", "equation": "equation", "interline_equation": "equation", "code": "code", "list": "list_item",
}
SKIPPED_TYPES = ("page_break", "discarded", "page_group")


def evidence(markers: DataFrame) -> DataFrame:
    """(doc_id, ev_ord, kind, text, page_idx, level): layout items in reading order, once each."""
    kinds = F.create_map(*[F.lit(x) for kv in EVIDENCE_KINDS.items() for x in kv])
    m = markers.where(~F.coalesce(F.col("item_type"), F.lit("")).isin(*SKIPPED_TYPES)).groupBy("doc_id", "item_no").agg(F.max_by(F.struct("item_type", "text", "page_idx", "text_level"), "ingested_at").alias("r"))
    kind = F.when(F.col("r.text_level").isNotNull(), "heading").otherwise(F.coalesce(F.element_at(kinds, F.col("r.item_type")), F.lit("unknown")))
    return m.select("doc_id", F.col("item_no").alias("ev_ord"), kind.alias("kind"), "r.text", "r.page_idx", F.col("r.text_level").alias("level"))


def candidates(blocks: DataFrame, ev: DataFrame) -> DataFrame:
    """(doc_id, ord, ev_ord, tier, page_idx): tier 1 equal anchors, tier 2 equal beginnings of MIN_PREFIX characters."""
    none = F.lit(None).cast("string")
    b = blocks.select("doc_id", "ord", S.anchor(F.col("kind"), F.col("text"), none).alias("a")).where("a <> ''")
    e = ev.where("text is not null").select("doc_id", "ev_ord", F.col("page_idx").alias("page"), S.anchor(F.col("kind"), F.col("text"), none, False).alias("a")).where("a <> ''")
    first = b.join(e, ["doc_id", "a"]).select("doc_id", "ord", "ev_ord", F.lit(1).alias("tier"), F.col("page").alias("page_idx"))
    cut = lambda d: d.where(F.length("a") >= S.MIN_PREFIX).withColumn("p", F.substring("a", 1, S.MIN_PREFIX))
    second = cut(b).alias("b").join(cut(e).alias("e"), ["doc_id", "p"]).where("b.a <> e.a").select("doc_id", "ord", "ev_ord", F.lit(2).alias("tier"), F.col("page").alias("page_idx"))
    return first.unionByName(second)


_LINK = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("ev_ord", T.IntegerType()), T.StructField("tier", T.IntegerType())])


def links(cands: DataFrame) -> DataFrame:
    """(doc_id, ord, ev_ord, tier) by the monotone pick.

    Candidates are sorted by document, block, tier and evidence; of each block the first one beyond the cursor is
    its link. The pick runs through the sorted rows batch by batch and holds a cursor only, however long a document is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc = block = None
        cursor = -1
        for b in batches:
            out = []
            for d, o, e, t in zip(b["doc_id"].tolist(), b["ord"].tolist(), b["ev_ord"].tolist(), b["tier"].tolist(), strict=True):
                if d != doc:
                    doc, block, cursor = d, None, -1
                if o != block and e > cursor:
                    block, cursor = o, e
                    out.append((d, o, e, t))
            yield pd.DataFrame(out, columns=["doc_id", "ord", "ev_ord", "tier"]).astype({"doc_id": "int64", "ord": "int32", "ev_ord": "int32", "tier": "int32"})

    c = cands.select(F.col("doc_id").cast("long").alias("doc_id"), "ord", "ev_ord", "tier").where("doc_id is not null and ord is not null and ev_ord is not null")
    return c.repartition("doc_id").sortWithinPartitions("doc_id", "ord", "tier", "ev_ord").mapInPandas(run, _LINK)


def short_links(blocks: DataFrame, ev: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc_id, ord, ev_ord): short texts and headings whose text stands once between their neighbours' evidence."""
    w = W.partitionBy("doc_id").orderBy("ord")
    b = blocks.join(linked.select("doc_id", "ord", F.col("ev_ord").alias("hit")), ["doc_id", "ord"], "left")
    b = b.withColumns({"lo": F.last("hit", True).over(w.rowsBetween(W.unboundedPreceding, -1)), "hi": F.first("hit", True).over(w.rowsBetween(1, W.unboundedFollowing)), "norm": X.visible(F.regexp_replace("text", r"^#+", ""))})
    short = b.where("hit is null and kind in ('text', 'heading')").where(F.length("norm").between(2, 11))
    e = ev.where("text is not null").select("doc_id", F.col("ev_ord").alias("e"), X.visible(F.col("text")).alias("norm"))
    j = short.join(e, ["doc_id", "norm"]).where((F.col("e") > F.coalesce("lo", F.lit(-1))) & (F.col("e") < F.coalesce("hi", F.lit(2**31 - 1))))
    return j.groupBy("doc_id", "ord").agg(F.count("*").alias("n"), F.min("e").alias("ev_ord")).where("n = 1").select("doc_id", "ord", "ev_ord")


def filled_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, ord, page_idx, filled_page): a missing page is that of both neighbours where they agree."""
    w = W.partitionBy("doc_id").orderBy("ord", "block_id")
    before = F.last("page_idx", True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("page_idx", True).over(w.rowsBetween(1, W.unboundedFollowing))
    return blocks.select("doc_id", "block_id", "ord", "page_idx", F.coalesce(F.col("page_idx"), F.when(before == after, before)).alias("filled_page"))


def page_regressions(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, page_idx, reached): blocks on an earlier page than one before them."""
    w = W.partitionBy("doc_id").orderBy("ord", "block_id").rowsBetween(W.unboundedPreceding, -1)
    return blocks.where("page_idx is not null").withColumn("reached", F.max("page_idx").over(w)).where("page_idx < reached").select("doc_id", "block_id", "page_idx", "reached")


def page_gaps(meta: DataFrame, blocks: DataFrame, ev: DataFrame) -> DataFrame:
    """(doc_id, page, state): pages 1..total that no block covers: unattributed, no_text, blank, or unavailable without evidence."""
    pages = meta.where("total_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "total_pages")).alias("page"))
    have = blocks.where("page_idx is not null").select("doc_id", (F.col("page_idx") + 1).alias("page")).distinct()
    open_ = pages.join(have, ["doc_id", "page"], "left_anti")
    e = ev.where("page_idx is not null").groupBy("doc_id", (F.col("page_idx") + 1).alias("page")).agg(
        F.count("*").alias("items"),
        F.count_if(~F.col("kind").isin("page_number", "header", "footer") & (X.strip(F.coalesce("text", F.lit(""))) != "")).alias("content"),
    )
    known = ev.select("doc_id").distinct().withColumn("known", F.lit(True))
    j = open_.join(e, ["doc_id", "page"], "left").join(known, "doc_id", "left")
    state = F.when(F.col("content") > 0, "unattributed").when(F.col("items") > 0, "no_text").when(F.col("known"), "blank").otherwise("unavailable")
    return j.select("doc_id", "page", state.alias("state"))


def attribution(blocks: DataFrame) -> DataFrame:
    """(kind, required, attributed, coverage): how many blocks have a page."""
    g = blocks.groupBy("kind").agg(F.count("*").alias("required"), F.count("page_idx").alias("attributed"))
    return g.select("kind", "required", "attributed", F.round(F.col("attributed") / F.col("required"), 6).alias("coverage"))


def page_of_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, page): the page comment last seen at or before each line that is not blank."""
    d = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    mark = F.regexp_extract("line", r"^<!-- page (\d+)(?: ocr)? -->$", 1)
    d = d.select("doc_id", (F.col("line_no") + 1).alias("line_no"), "line", F.when(mark != "", mark.cast("int")).alias("mark"))
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("page", F.last("mark", True).over(w)).where(F.col("mark").isNull() & (F.trim("line") != "")).select("doc_id", "line_no", "page")
