"""Tables of contents, headings by evidence, running heads by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# Pages from which on a repeated title is a running head; lines of a table of contents.
HEAD_PAGES, TOC_RUN, TOP_SHARE = 3, 3, 0.25
_TOC = rf"(/|\.{{2,}}|…+|·{{2,}}|{X.WS}){X.WS}*(\p{{Nd}}{{1,4}}){X.WS}*$"


def title_key(c):
    """Letters and digits in lower case, full-width ones as ASCII."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    plain = "".join(chr(0x21 + i) for i in range(94))
    return F.lower(F.regexp_replace(F.translate(c, wide, plain), r"[^\p{L}\p{N}]+", ""))


def heads_by_page(ev: DataFrame) -> DataFrame:
    """(doc_id, key, pages): texts of layout items that stand on at least HEAD_PAGES pages."""
    e = ev.where("text is not null and page_idx is not null").select("doc_id", "page_idx", title_key(F.col("text")).alias("key")).where(F.length("key").between(2, 40))
    return e.groupBy("doc_id", "key").agg(F.countDistinct("page_idx").alias("pages")).where(F.col("pages") >= HEAD_PAGES)


def toc_entries(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, title, page): entries of at least TOC_RUN that follow each other, blank lines aside; the first of a title."""
    s = lines.select("doc_id", "line_no", X.strip(F.col("line")).alias("s")).where("s <> ''")
    w = W.partitionBy("doc_id").orderBy("line_no")
    s = s.withColumn("hit", (F.col("s").rlike(_TOC) & X.is_catalog_entry(F.col("s"))).cast("int"))
    s = s.withColumn("g", F.row_number().over(w) - F.sum("hit").over(w.rowsBetween(W.unboundedPreceding, 0))).where("hit = 1")
    s = s.withColumn("run", F.count("*").over(W.partitionBy("doc_id", "g"))).where(F.col("run") >= TOC_RUN)
    t = s.select("doc_id", "line_no", X.strip(F.regexp_replace("s", _TOC, "")).alias("title"), F.regexp_extract("s", _TOC, 2).cast("int").alias("page")).where("title <> ''")
    return t.withColumn("n", F.row_number().over(W.partitionBy("doc_id", title_key(F.col("title"))).orderBy("line_no"))).where("n = 1").drop("n")


def proposed_headings(blocks: DataFrame, ev: DataFrame) -> DataFrame:
    """(doc_id, block_id, title, action): what the evidence says of headings.

    'promote': a text block that is the title of a heading item; 'demote': a heading whose text is a running head.
    """
    heads = heads_by_page(ev).select("doc_id", "key")
    titles = ev.where("kind = 'heading' and text is not null and page_idx > 0").select("doc_id", title_key(F.col("text")).alias("key")).where("length(key) between 1 and 40").distinct().join(heads, ["doc_id", "key"], "left_anti")
    b = blocks.where("kind in ('text', 'heading') and text is not null and not contains(text, '\n')").select("doc_id", "block_id", "kind", F.regexp_replace("text", r"^#+\s*", "").alias("title")).withColumn("key", title_key(F.col("title")))
    up = b.where("kind = 'text'").join(titles, ["doc_id", "key"], "left_semi").select("doc_id", "block_id", "title", F.lit("promote").alias("action"))
    down = b.where("kind = 'heading'").join(heads, ["doc_id", "key"], "left_semi").select("doc_id", "block_id", "title", F.lit("demote").alias("action"))
    return up.unionByName(down)


def missing_headings(blocks: DataFrame, ev: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc_id, before_ord, title): titles of the evidence that no heading or text block carries, and the block before which they belong.

    That is the first block linked to evidence after the title's own. Titles of the first page, running heads and
    titles after which nothing is linked are left out.
    """
    heads = heads_by_page(ev).select("doc_id", "key")
    t = ev.where("kind = 'heading' and text is not null and page_idx > 0").select("doc_id", "ev_ord", F.col("text").alias("title"), title_key(F.col("text")).alias("key")).where("length(key) between 1 and 40")
    have = blocks.where("kind in ('heading', 'text') and text is not null and not contains(text, '\n')").select("doc_id", title_key(F.regexp_replace("text", r"^#+\s*", "")).alias("key")).distinct()
    t = t.join(heads, ["doc_id", "key"], "left_anti").join(have, ["doc_id", "key"], "left_anti").groupBy("doc_id", "key").agg(F.min_by(F.struct("ev_ord", "title"), "ev_ord").alias("t")).select("doc_id", "t.*")
    # the next link by evidence order: an as-of join by a window over titles and links together
    both = t.select("doc_id", F.col("ev_ord").alias("e"), F.lit(0).alias("side"), "title", F.lit(None).cast("int").alias("ord")).unionByName(linked.select("doc_id", F.col("ev_ord").alias("e"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("title"), "ord"))
    w = W.partitionBy("doc_id").orderBy("e", "side").rowsBetween(1, W.unboundedFollowing)
    return both.withColumn("before_ord", F.first("ord", True).over(w)).where("side = 0 and before_ord is not null").select("doc_id", "before_ord", "title")


def last_of_title(headings: DataFrame) -> DataFrame:
    """Of headings with one title key in a document, the last."""
    w = W.partitionBy("doc_id", title_key(F.col("title"))).orderBy(F.desc("ord"))
    return headings.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
