"""Scalar functions of the document operators, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, strip, visible

# Script ranges and thresholds of the script-share language guess.
KANA = r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}]"
HANGUL = r"[\x{1100}-\x{11ff}\x{ac00}-\x{d7af}]"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
LATIN = "[A-Za-z]"
DEFAULT_LANGUAGE = "zh-CN"
# Characters of a broken text layer.
SUSPICIOUS = r"[\x{e000}-\x{f8ff}\x{10000}-\x{10ffff}\x{fffd}\x{2e00}-\x{2e7f}\x{2190}-\x{21ff}\x{2500}-\x{257f}\x{25a0}-\x{25ff}\x{2600}-\x{26ff}\x{2700}-\x{27bf}\x{2b00}-\x{2bff}\x{3400}-\x{4dbf}]"
# Anchor lengths of the alignment.
ANCHOR, MIN_PREFIX, MIN_HEADING = 24, 12, 4


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def language_guess(text: Column, scan: int = 50_000) -> Column:
    """ja, ko, zh-CN or en by script shares; null when unsure. The prefix is the definition of this guess."""
    t = F.substring(text, 1, scan)
    kana, hangul, han, latin = (count(t, p) for p in (KANA, HANGUL, HAN, LATIN))
    every = kana + hangul + han + latin
    least = F.greatest(F.lit(10.0), every * 0.02)
    return (
        F.when(every < 20, None)
        .when(kana >= least, "ja")
        .when(hangul >= least, "ko")
        .when(han + latin == 0, None)
        .when(han >= (han + latin) * 0.3, "zh-CN")
        .when(latin >= (han + latin) * 0.6, "en")
    )


def resolved_language(text: Column, override: Column, default: str = DEFAULT_LANGUAGE) -> Column:
    """An override of blanks gives the default, an empty or missing one the guess."""
    o = strip(override)
    return F.when(F.length(override) > 0, F.when(o == "", default).otherwise(o)).otherwise(F.coalesce(language_guess(text), F.lit(default)))


def valid_chars(text: Column) -> Column:
    """Visible characters without suspicious ones."""
    v = visible(text)
    return F.length(v) - count(v, SUSPICIOUS)


def suspicious_chars(text: Column) -> Column:
    return count(visible(text), SUSPICIOUS)


def compress_blank_runs(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def anchor(kind: Column, text: Column, image: Column, enforce: bool = True) -> Column:
    """The first ANCHOR visible characters; images by file name; too short ones give ''."""
    body = F.when(kind == "heading", F.regexp_replace(text, f"^#+{WS}*", "")).when(kind == "footnote", F.regexp_replace(text, rf"^\[\^[^\]\s]+\]:{WS}*", "")).otherwise(text)
    norm = visible(body)
    least = F.when(kind == "heading", MIN_HEADING).otherwise(MIN_PREFIX) if enforce else F.lit(1)
    name = F.element_at(F.split(F.regexp_replace(image, r"\\", "/"), "/"), -1)
    return F.when(kind == "image", F.coalesce(name, F.lit(""))).otherwise(F.when(F.length(norm) >= least, F.substring(norm, 1, ANCHOR)).otherwise(""))


def snippet(c: Column, n: int = 40) -> Column:
    return F.substring(F.regexp_replace(strip(c), "\n", " "), 1, n)


def format_pages(pages: Column) -> Column:
    """[0,1,2,4] (sorted) -> '1-3,5'."""
    runs = F.aggregate(
        pages, F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, p: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] == p - 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), p.cast("int").alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(p.cast("int").alias("a"), p.cast("int").alias("b"))))),
    )
    return F.array_join(F.transform(runs, lambda r: F.when(r["a"] == r["b"], (r["a"] + 1).cast("string")).otherwise(F.concat((r["a"] + 1).cast("string"), F.lit("-"), (r["b"] + 1).cast("string")))), ",")


def shards(pages: Column, per_task: Column) -> Column:
    """Tasks for so many pages: 0 for none, 1 without a limit, else the quotient rounded up."""
    return F.when(F.coalesce(pages, F.lit(0)) <= 0, 0).when(F.coalesce(per_task, F.lit(0)) <= 0, 1).otherwise(F.ceil(pages / per_task)).cast("int")


def sanitize_name(c: Column) -> Column:
    """A file name without characters that file systems refuse."""
    s = strip(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]', "_"))
    return F.when(s == "", "untitled").otherwise(s)


def iso_pdf_date(c: Column) -> Column:
    """'D:20240131…' -> '2024-01-31', null otherwise."""
    return F.when(c.rlike(r"^D:\d{8}"), F.concat_ws("-", F.substring(c, 3, 4), F.substring(c, 7, 2), F.substring(c, 9, 2)))


# markdown counters (fenced code is left out where it could mislead)
FENCE = r"(?s)```.*?```"
IMAGE = r"!\[[^\]\n]*\]\(([^)\n]+)\)"


def unfenced(md: Column) -> Column:
    return F.regexp_replace(md, FENCE, "")


def image_names(md: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(md, F.lit(IMAGE), F.lit(1)), lambda r: F.regexp_replace(r, r"^.*[/\\]", ""))))


def heading_count(md: Column) -> Column:
    return count(md, r"(?m)^#{1,6}[ \t]+[^ \t\n]")


def math_count(md: Column) -> Column:
    body = unfenced(md)
    display = count(body, r"(?s)\$\$.+?\$\$")
    return display + count(F.regexp_replace(body, r"(?s)\$\$.+?\$\$", ""), r"\$[^$\n]+\$")


def table_count(md: Column) -> Column:
    return count(unfenced(md), r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$")


def code_count(md: Column) -> Column:
    return F.floor(count(md, "(?m)^```") / 2).cast("int")


def footnote_defs(md: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(unfenced(md), F.lit(r"(?m)^\[\^([^\]\s]+)\]:"), F.lit(1))))


def hard_breaks(md: Column) -> Column:
    body = unfenced(md)
    return count(body, r"(?m)[^ \n] {2,}$") + count(body, r"(?i)</?br[ \t]*/?>")


def text_chars(md: Column) -> Column:
    t = unfenced(md)
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, IMAGE, "")
    t = F.regexp_replace(t, r"(?i)</?br[ \t]*/?>", "")
    t = F.regexp_replace(t, r"\[([^\]\n]+)\]\([^)\n]+\)", "$1")
    t = F.regexp_replace(t, r"(?m)^#{1,6}[ \t]*", "")
    return F.length(visible(F.regexp_replace(t, r"[*_`>|#]", "")))


def page_marks(md: Column) -> Column:
    """Distinct page numbers of the page comments, ranges and lists opened out."""
    groups = F.regexp_extract_all(md, F.lit(r"<!--\s*page\s+([\d, \-]+?)(?:\s+ocr)?\s*-->"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    ends = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("a"), F.regexp_extract(p, r"(\d+)\D*$", 1).cast("int").alias("b")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(ends, lambda e: e["a"].isNotNull() & (e["b"] >= e["a"])), lambda e: F.sequence(e["a"], e["b"])))))
