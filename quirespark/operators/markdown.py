"""Lossless block representation of Markdown documents.

Parsing is sequential within one document, so it is one Arrow function from text
to an array of blocks (no shuffle); everything after it is relational. Rendering
the blocks in order gives the document back byte for byte.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Forms that begin a block, tried in this order: (kind, how it goes on, pattern).
FORMS = (
    ("heading", "line", re.compile(r"(?P<mark>#{1,6})(?:[ \t]+.*|$)")),
    ("code", "fence", re.compile(r" {0,3}(?P<mark>`{3,}|~{3,})[^\r\n]*$")),
    ("unknown", "comment", re.compile(r"<!--")),
    ("unknown", "rule", re.compile(r"(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")),
    ("equation", "math", re.compile(r"\$\$|\\\[")),
    ("table", "table", re.compile(r"\|")),
    ("footnote", "indented", re.compile(r"\[\^(?P<mark>[^\]\s]+)\]:")),
    ("list_item", "indented", re.compile(r"(?P<mark>[-*+]|\d{1,9}[.)])[ \t]+")),
    ("image", "line", re.compile(r"!\[[^\]]*\]\((?P<mark>[^)]+)\)$")),
)
_PAGE = re.compile(r"<!--\s*page\s+(\d+)\s*-->$", re.I)

BLOCK = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("trailer", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("role", T.StringType()), T.StructField("page_mark", T.IntegerType()), T.StructField("marker", T.StringType()),
])
PARSED = T.StructType([T.StructField("prefix", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK))])


def _form(line: str):
    """(kind, how, match) of the block that a line begins; an indented line begins none but a fence or code."""
    for kind, how, p in FORMS:
        m = p.match(line)
        if m and (how == "fence" or line[:1] not in " \t"):
            return kind, how, m
    return ("code", "indent", None) if line.startswith(("    ", "\t")) else ("text", "paragraph", None)


def _body(line: str) -> str:
    return line[:-2] if line.endswith("\r\n") else line[:-1] if line.endswith(("\n", "\r")) else line


def _end(rows: list[str], i: int, how: str, m) -> int:
    """The first row after the block that begins at row i."""
    n = len(rows)
    first = _body(rows[i])

    def until(stop) -> int | None:
        return next((j + 1 for j in range(i + 1, n) if stop(_body(rows[j]))), None)

    def while_(more) -> int:
        return next((j for j in range(i + 1, n) if not more(_body(rows[j]))), n)

    if how == "fence":
        sign = m["mark"]
        return until(lambda s: len(s.strip()) >= len(sign) and set(s.strip()) == {sign[0]} and len(s) - len(s.lstrip(" ")) <= 3) or n
    if how == "comment":
        return i + 1 if "-->" in first else until(lambda s: "-->" in s) or n
    if how == "math":
        closer = "$$" if first.startswith("$$") else "\\]"
        if first.rstrip().endswith("$$") and len(first.strip()) > 4 or closer == "\\]" and first.rstrip().endswith(closer):
            return i + 1
        return until(lambda s: s.rstrip().endswith(closer)) or -1
    if how == "table":
        return while_(lambda s: s.strip().startswith("|"))
    if how == "indented":
        return while_(lambda s: bool(s.strip()) and s[:1].isspace())
    if how == "indent":
        return while_(lambda s: bool(s.strip()) and s.startswith(("    ", "\t")))
    if how == "paragraph":
        return while_(lambda s: bool(s.strip()) and _form(s)[1] in ("paragraph", "indent"))
    return i + 1


def parse(md: str | None) -> dict | None:
    """{prefix, blocks}; null stays null, a text of blanks is all prefix."""
    if md is None:
        return None
    rows = md.splitlines(keepends=True)
    i = next((k for k, r in enumerate(rows) if r.strip()), len(rows))
    at = sum(map(len, rows[:i]))
    out = {"prefix": md[:at], "blocks": []}
    while i < len(rows):
        kind, how, m = _form(_body(rows[i]))
        j = _end(rows, i, how, m)
        if j < 0:  # a formula that never closes is a paragraph
            kind, how, m = "text", "paragraph", None
            j = max(i + 1, _end(rows, i, how, m))
        whole = "".join(rows[i:j])
        text = whole[: len(whole) - len(rows[j - 1]) + len(_body(rows[j - 1]))]
        k = next((k for k in range(j, len(rows)) if rows[k].strip()), len(rows))
        trailer = whole[len(text) :] + "".join(rows[j:k])
        page = _PAGE.match(text.strip()) if how == "comment" else None
        role = {"comment": "page_marker" if page else "html_comment", "rule": "horizontal_rule"}.get(how)
        out["blocks"].append({
            "ord": len(out["blocks"]), "kind": kind, "level": len(m["mark"]) if kind == "heading" else None, "text": text, "trailer": trailer, "start": at,
            "role": role, "page_mark": int(page[1]) if page else None, "marker": m["mark"] if m and "mark" in m.re.groupindex else None,
        })
        at += len(text) + len(trailer)
        i = k
    return out


@F.pandas_udf(PARSED)
def _parse_udf(texts: pd.Series) -> pd.DataFrame:
    got = [parse(t if isinstance(t, str) else None) for t in texts]
    return pd.DataFrame({"prefix": [g and g["prefix"] for g in got], "blocks": [g and g["blocks"] for g in got]})


def parsed(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, prefix, blocks) of the documents."""
    return documents.select("doc_id", _parse_udf(F.col(text)).alias("p")).select("doc_id", "p.prefix", "p.blocks")


def blocks_of(p: DataFrame, part: str = "book") -> DataFrame:
    """One row per block, block_id '<part>#m<n>', page_idx of the last page comment before it."""
    b = p.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", F.concat(F.lit(f"{part}#m"), F.col("b.ord")).alias("block_id"), "b.*")
    w = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return b.withColumn("page_idx", F.last("page_mark", ignorenulls=True).over(w) - 1)


def rendered(p: DataFrame) -> DataFrame:
    """(doc_id, text) put together from prefix and blocks, without a shuffle."""
    return p.select("doc_id", F.concat(F.col("prefix"), F.array_join(F.transform("blocks", lambda b: F.concat(b["text"], b["trailer"])), "")).alias("text"))


def render_blocks(blocks: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) from a table of blocks; a document's blocks meet in one row, as its text must."""
    t = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.concat("text", "trailer").alias("t")))), lambda x: x["t"]), "")
    d = blocks.groupBy("doc_id").agg(t.alias("text"))
    return d if prefixes is None else d.join(prefixes, "doc_id").select("doc_id", F.concat("prefix", "text").alias("text"))


def roundtrip(documents: DataFrame) -> DataFrame:
    """(doc_id, same, tiles, n_blocks): whether rendering gives the text back, and blocks lie end to end."""
    p = documents.select("doc_id", "text", _parse_udf("text").alias("p")).select("doc_id", "text", "p.prefix", "p.blocks")
    back = F.concat(F.col("prefix"), F.array_join(F.transform("blocks", lambda b: F.concat(b["text"], b["trailer"])), ""))
    ends = F.transform("blocks", lambda b: b["start"] + F.length(b["text"]) + F.length(b["trailer"]))
    tiles = F.forall(F.sequence(F.lit(1), F.greatest(F.size("blocks"), F.lit(1))), lambda i: (i >= F.size("blocks")) | (F.get(ends, i - 1) == F.get(F.col("blocks.start"), i)))
    return p.select("doc_id", (back == F.col("text")).alias("same"), tiles.alias("tiles"), F.size("blocks").alias("n_blocks"))
