"""Titles, authors, languages, names and catalogues."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

# Names that say nothing about a book.
SCAN_NAME = r"(?i)^(扫描|掃描|扫描件|扫描全|scan(ned)?|img|image|pic|dsc|dscn|photo|doc|document|file|new|新建|未命名|无标题|untitled|unnamed|ebook|电子书|output|out|book)[ \t_-]*(no\.?)?[ \t]*\p{Nd}*$"
BLANK_DOC = r"(?i)^(新建|new)[ \t]*([A-Za-z]+[ \t]*)*(文档|文本文档|document|doc)$"
OFFICE_TITLE = r"(?i)microsoft[ \t]+(word|powerpoint|excel)|untitled|无标题|未命名"
DOC_SUFFIX = r"(?i)\.(docx?|pdf|indd|pages|rtf|txt|md|wps|odt|html?)$"
JUNK_AUTHORS = ("administrator", "admin", "user", "owner", "author", "作者", "unknown", "none", "null", "microsoft office user", "wps", "lenovo", "hp", "pc", "windows user", "微软用户", "微软中国")
STRUCT_HEADINGS = ("前言", "序", "序言", "自序", "导言", "导论", "引言", "绪论", "目录", "目次", "后记", "跋", "附录", "参考文献", "译后记", "译序", "编者的话", "出版说明", "版权页", "扉页", "内容简介", "作者简介")
AUTHOR_TAIL = r"[ \t\x{3000}]*(著|编著|主编|合著|编|等|撰|译)$"
FIELDS = {"title": "书[ \t]*名|题[ \t]*名", "author": "作[ \t]*者|著[ \t]*者", "translator": "译[ \t]*者|翻[ \t]*译", "publisher": "出[ \t]*版[ \t]*社|出版者|出版发行"}
OTHER_FIELDS = "编[ \t]*者|主[ \t]*编|出版日期|出版时间|定[ \t]*价|(?i:isbn)|页[ \t]*数|字[ \t]*数|开[ \t]*本"


def cleaned(c: Column) -> Column:
    return X.strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{X.WS}+", " "))


def is_junk_name(c: Column) -> Column:
    t = cleaned(c)
    return (F.length(t) < 2) | ~t.rlike(r"\p{L}") | t.rlike(SCAN_NAME) | t.rlike(BLANK_DOC)


def is_junk_title(c: Column) -> Column:
    t = cleaned(c)
    return is_junk_name(c) | t.rlike(OFFICE_TITLE) | t.rlike(DOC_SUFFIX)


def is_junk_author(c: Column) -> Column:
    t = cleaned(c)
    return (t == "") | F.lower(t).isin(*JUNK_AUTHORS) | is_junk_name(c)


def person(c: Column) -> Column:
    return cleaned(F.regexp_replace(F.regexp_replace(cleaned(c), AUTHOR_TAIL, ""), r"^[ ，,、;；]+|[ ，,、;；]+$", ""))


def plain_title(c: Column) -> Column:
    """A title without spaces, quotes and separators, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x{3000}《》〈〉“”‘’\"'·・:：,，.。、!！?？\-—–_/\\()（）\[\]【】]+", ""))


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two plain titles, 0 to 1: matching blocks, at least the share of a title contained in the other."""

    def one(x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        ratio = SequenceMatcher(None, x, y).ratio()
        return max(ratio, min(len(x), len(y)) / max(len(x), len(y))) if x in y or y in x else ratio

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])


def same_title(a: Column, b: Column, least: float = 0.7) -> Column:
    """Whether two titles name one book: equal, one of at least 4 characters inside the other, or similar enough."""
    x, y = plain_title(a), plain_title(b)
    inside = (F.contains(x, y) | F.contains(y, x)) & (F.least(F.length(x), F.length(y)) >= 4)
    return (x != "") & (y != "") & ((x == y) | inside | (title_similarity(x, y) >= least))


def is_structural(c: Column) -> Column:
    plain = F.regexp_replace(c, rf"({X.WS}|[\p{{Nd}}.、,，:：])+", "")
    return plain.isin(*STRUCT_HEADINGS) | X.is_chapter_anchor(c)


def title_author(stem: Column) -> tuple[Column, Column]:
    """'Title - Author' in two; without that form the whole and null."""
    t, a = cleaned(F.regexp_extract(stem, r"^(.*?)[ \t]+-[ \t]+(.+)$", 1)), cleaned(F.regexp_extract(stem, r"^(.*?)[ \t]+-[ \t]+(.+)$", 2))
    ok = (F.length(t) >= 2) & (a != "")
    return F.when(ok, t).otherwise(stem), F.when(ok, a)


def front_field(text: Column, field: str) -> Column:
    """The value behind a field's label in the first 40 lines, up to the next label; null if none or a sentence."""
    head = F.array_join(F.slice(F.split(text, "\n", -1), 1, 40), "\n")
    labels = "|".join([*FIELDS.values(), OTHER_FIELDS])
    value = F.regexp_extract(head, rf"(?m)^[ \t>#*•·|-]*(?:.*?[ \t])?(?:{FIELDS[field]})[ \t]*[:：][ \t]*(.*?)(?=[ \t]+(?:{labels})[ \t]*[:：]|$)", 1)
    v = cleaned(value)
    return F.when((v != "") & ~v.rlike("[。!?…；;]$"), v)


def first_heading(md: Column) -> Column:
    """The first heading that is a title: not structural, not junk."""
    heads = F.regexp_extract_all(md, F.lit(r"(?m)^#{1,6}[ \t]+([^\n]+?)[ \t]*#*[ \t]*$"), F.lit(1))
    return F.get(F.filter(heads, lambda h: ~is_structural(h) & ~is_junk_name(h)), F.lit(0))


def resolved(df: DataFrame, stem: str = "stem", pdf_title: str = "pdf_title", front: str = "front_title", heading: str = "heading") -> DataFrame:
    """Adds title and title_source by precedence: file name, document metadata, front matter, first heading; never empty."""
    tries = [("filename", F.col(stem), ~is_junk_name(F.col(stem))), ("pdf", F.col(pdf_title), ~is_junk_title(F.col(pdf_title))), ("front_matter", F.col(front), ~is_junk_name(F.col(front))), ("heading", F.col(heading), ~is_junk_name(F.col(heading)) & ~is_structural(cleaned(F.col(heading))))]
    title, source = F.coalesce(F.nullif(cleaned(F.col(stem)), F.lit("")), F.lit("未命名")), F.lit("filename")
    for name, value, good in reversed(tries):
        title, source = F.when(good, cleaned(value)).otherwise(title), F.when(good, name).otherwise(source)
    return df.withColumns({"title": title, "title_source": source})


def work_name(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(X.strip(c), f"{X.WS}+", "_"), r'[\\/:*?"<>|]+', "_")
    return F.when(s == "", "book").otherwise(s)


def output_name(c: Column) -> Column:
    s = X.strip(F.regexp_replace(F.regexp_replace(X.strip(c), r'[\\/:*?"<>|]+', "_"), "[. ]+$", ""))
    return F.when(s == "", "book").otherwise(s)


def name_conflicts(sources: DataFrame) -> DataFrame:
    """(kind, name, n, ids): different inputs (id, stem) that would write to one working folder or one output."""
    s = sources.select("id", F.explode(F.array(F.struct(F.lit("work").alias("kind"), F.lower(work_name(F.col("stem"))).alias("name")), F.struct(F.lit("out").alias("kind"), F.lower(output_name(F.col("stem"))).alias("name")))).alias("k")).select("id", "k.*")
    return s.groupBy("kind", "name").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) > 1").select("kind", "name", F.size("ids").alias("n"), "ids")


def catalogue(entries: DataFrame) -> DataFrame:
    """One row per path up to case and slashes: latest change, first arrival, a title that does not begin with '_' if any."""
    p = F.lower(F.regexp_replace("path", r"\\", "/"))
    return entries.groupBy(p.alias("path_key")).agg(F.max("mtime").alias("mtime"), F.min("added_at").alias("added_at"), F.max_by("title", F.struct((~F.col("title").startswith("_")).cast("int"), F.col("mtime"), F.col("title"))).alias("title"))


def synced(scan: DataFrame, known: DataFrame) -> DataFrame:
    """Scan and catalogue by path: state new, changed, same or gone."""
    j = scan.select("path_key", F.col("mtime").alias("m")).join(known.select("path_key", F.col("mtime").alias("k")), "path_key", "full")
    return j.select("path_key", F.when(F.col("k").isNull(), "new").when(F.col("m").isNull(), "gone").when(F.col("m") > F.col("k"), "changed").otherwise("same").alias("state"))


def parts_by_content(files: DataFrame) -> DataFrame:
    """(doc_id, part, name, new_name): files of one name share it if their bytes are equal, else later parts get a prefix."""
    w = W.partitionBy("doc_id", "name").orderBy("part")
    f = files.withColumn("first", F.first("hash").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return f.select("doc_id", "part", "name", F.when(F.col("hash") == F.col("first"), F.col("name")).otherwise(F.concat(F.lit("p"), F.col("part").cast("string"), F.lit("_"), F.col("name"))).alias("new_name"))
