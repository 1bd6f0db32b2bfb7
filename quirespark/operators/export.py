"""Markdown made safe for conversion to XHTML, as expressions over its segments.

A text is cut into fences, formulas, code spans, tags and the rest by one
pattern; each kind of segment is rewritten or left alone; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Elements that may stand in Markdown, and those without content.
RAW_TAGS = (
    "a abbr b big blockquote br center cite code dd del details div dl dt em figcaption figure font h1 h2 h3 h4 h5 h6 hr i img ins kbd li mark ol p pre q "
    "rp rt ruby s samp small span strike strong sub summary sup table tbody td tfoot th thead tr tt u ul var"
).split()
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()

_FENCE = r"```[^\n]*\n(?:[^`]|`{1,2}[^`])*```"
_MATH = r"\$\$(?:[^$]|\$[^$])+\$\$|\$[^$\n]+\$|\\\[(?:[^\\]|\\[^\]])+\\\]|\\\((?:[^\\]|\\[^)])+\\\)"
_CODE = r"`[^`\n]+`"
_TAG = r"</?[A-Za-z][A-Za-z0-9:_.-]*[^<>]*>"
SEGMENT = rf"({_FENCE}|{_MATH}|{_CODE}|{_TAG}|[^`$\\<]+|[`$\\<])"
_NAME = r"^</?([A-Za-z][A-Za-z0-9:_.-]*)"
_ATTRS = r"""^</?[A-Za-z][A-Za-z0-9:_.-]*(\s+[A-Za-z_:][A-Za-z0-9_:.-]*\s*=\s*("[^"]*"|'[^']*'))*\s*/?>$"""
_LINK = r"^<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^<>]*|[^<>@\s]+@[^<>\s]+)>$"


def segments(md: Column) -> Column:
    return F.regexp_extract_all(md, F.lit(f"(?s){SEGMENT}"), F.lit(1))


def _rewritten(md: Column, change) -> Column:
    return F.array_join(F.transform(segments(md), change), "")


def math_tags(md: Column) -> Column:
    r"""\tag{n} in formulas becomes a visible (n), \tag*{n} an n."""

    def one(s: Column) -> Column:
        t = F.regexp_replace(s, r"\\tag\*\s*\{\s*([^{}]*?)\s*\}", r"\\qquad{$1}")
        t = F.regexp_replace(t, r"\\tag\s*\{\s*([^{}]*?)\s*\}", r"\\qquad{($1)}")
        return F.when(s.rlike(r"^(\$[^$]|\$\$.|\\\[|\\\()"), t).otherwise(s)

    return _rewritten(md, one)


def void_tags(md: Column) -> Column:
    """Elements without content close themselves."""

    def one(s: Column) -> Column:
        name = F.lower(F.regexp_extract(s, _NAME, 1))
        inside = X.strip(F.regexp_replace(F.regexp_replace(s, _NAME, ""), r"/?>$", ""))
        new = F.concat(F.lit("<"), F.regexp_extract(s, _NAME, 1), F.when(inside == "", "").otherwise(F.concat(F.lit(" "), inside)), F.lit(" />"))
        return F.when(s.startswith("<") & ~s.startswith("</") & name.isin(*VOID_TAGS), new).otherwise(s)

    return _rewritten(md, one)


def pseudo_tags(md: Column) -> Column:
    """What looks like a tag but is none (unknown name, malformed, never paired) becomes text."""
    names = lambda p: F.transform(F.regexp_extract_all(md, F.lit(p), F.lit(1)), F.lower)
    opened, closed = names(r"<([A-Za-z][A-Za-z0-9]*)"), names(r"</([A-Za-z][A-Za-z0-9]*)")

    def one(s: Column) -> Column:
        name = F.lower(F.regexp_extract(s, _NAME, 1))
        good = name.isin(*RAW_TAGS) & s.rlike(_ATTRS) & F.when(s.startswith("</"), F.array_contains(opened, name)).otherwise(name.isin(*VOID_TAGS) | F.array_contains(closed, name))
        text = F.concat(F.lit("\\<"), F.substring(s, F.lit(2), F.length(s) - 2), F.lit("\\>"))
        return F.when(s.rlike("^</?[A-Za-z]") & s.endswith(">") & ~s.rlike(_LINK) & ~good, text).otherwise(s)

    return _rewritten(md, one)


def prepared(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, changed) ready for conversion; null stays null."""
    new = void_tags(pseudo_tags(math_tags(F.col(text))))
    return documents.select("doc_id", new.alias("text"), (~new.eqNullSafe(F.col(text))).alias("changed"))


def bold_lines(lines: DataFrame, runs: DataFrame, shortest: int = 4) -> DataFrame:
    """(doc_id, line_no, line): paragraphs that hold an emphasised run (doc_id, run) of their document wrapped in **.

    Lines meet the runs of their document as one array per document.
    """
    r = runs.select("doc_id", X.visible(F.col("run")).alias("run")).where(F.length("run") >= shortest).groupBy("doc_id").agg(F.collect_set("run").alias("runs"))
    s = X.strip(F.col("line"))
    flat = X.visible(F.regexp_replace(s, "<[^>]+>", ""))
    hit = (s != "") & ~s.rlike(r"^(#|>|\||```|<|!\[)") & F.exists("runs", lambda x: F.contains(flat, x))
    return lines.join(r, "doc_id", "left").select("doc_id", "line_no", F.when(hit, F.concat(F.lit("**"), s, F.lit("**"))).otherwise(F.col("line")).alias("line"))


def heading_depth(md: Column) -> Column:
    """The deepest heading outside fences, 1 without any."""
    marks = F.regexp_extract_all(F.regexp_replace(md, r"(?s)```.*?```", ""), F.lit(r"(?m)^(#{1,6})[ \t]"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(marks, F.length)), F.lit(1))


def inferred_title(md: Column) -> Column:
    """The first first-level heading, else the first line that is not blank; null without one."""
    h = F.regexp_extract(md, r"(?m)^#[ \t]+([^\n]+?)[ \t]*#*[ \t]*$", 1)
    first = F.get(F.filter(F.transform(F.split(md, "\n", -1), X.strip), lambda s: s != ""), F.lit(0))
    return F.when(h != "", h).otherwise(F.regexp_replace(first, r"^#+[ \t]*", ""))
