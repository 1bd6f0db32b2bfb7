"""Reading Markdown files and layout items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import normalize_newlines

# Folders and names that hold no inputs.
SKIPPED_FOLDERS = ("node_modules", "__pycache__", "work", "output", "dist", "build", "venv", "target")
SKIPPED_NAMES = ("readme", "changelog", "license", "contributing")

_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("problem", T.StringType())])


def decode(data: bytes | None) -> tuple[str | None, str | None, str | None]:
    """(text, encoding, problem): UTF-8 with or without a mark, else GB18030 with a warning, else none."""
    if data is None:
        return None, None, "missing"
    raw = data[3:] if data.startswith(b"\xef\xbb\xbf") else data
    for name, problem in (("utf-8", None), ("gb18030", "decoded as gb18030")):
        try:
            return raw.decode(name), name, problem
        except UnicodeDecodeError:
            continue
    return None, None, "undecodable"


@F.pandas_udf(_TEXT)
def _decode_udf(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(d) for d in data], columns=["text", "encoding", "problem"])


def is_input(path: Column) -> Column:
    """Markdown and PDF files outside skipped and hidden folders, and no README-like names."""
    parts = F.split(F.regexp_replace(path, r"^[a-z]+:/+", ""), "/")
    name = F.lower(F.element_at(parts, -1))
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return name.rlike(r"\.(md|pdf)$") & ~stem.isin(*SKIPPED_NAMES) & ~F.exists(folders, lambda p: p.isin(*SKIPPED_FOLDERS) | p.rlike(r"^\.[^.]"))


def list_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, mtime) of the inputs below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return f.where(is_input(F.col("path"))).select("path", "length", F.col("modificationTime").alias("mtime"))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, text, encoding, problem) of the Markdown files below a folder, line ends as \\n."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder).where(is_input(F.col("path")))
    d = f.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), _decode_udf("content").alias("d"))
    return d.select("path", "stem", normalize_newlines(F.col("d.text")).alias("text"), "d.encoding", "d.problem")


ITEM = "type string, label string, text string, content string, page_idx int, text_level int, bbox array<double>, img_path string"


def parse_items(texts: DataFrame, column: str = "json") -> DataFrame:
    """Layout items of JSON texts (doc_id, json): one flat list, a list of pages, or a list under 'items'; broken JSON gives none."""
    c = F.col(column)
    flat = F.from_json(c, f"array<struct<{_fields()}>>", {"mode": "PERMISSIVE"})
    wrapped = F.from_json(c, f"struct<items: array<struct<{_fields()}>>>", {"mode": "PERMISSIVE"})["items"]
    pages = F.flatten(F.from_json(c, f"array<array<struct<{_fields()}>>>", {"mode": "PERMISSIVE"}))
    first = F.substring(F.regexp_replace(c, r"\s", ""), 1, 2)
    items = F.when(first == "[[", pages).when(F.substring(first, 1, 1) == "{", wrapped).otherwise(flat)
    e = texts.select("doc_id", F.posexplode(items).alias("item_no", "i")).where("i is not null")
    return e.select("doc_id", "item_no", F.coalesce("i.type", "i.label").alias("item_type"), F.coalesce("i.text", "i.content").alias("text"), "i.page_idx", "i.text_level", "i.bbox", "i.img_path")


def _fields() -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.split(" ", 1) for x in ITEM.split(", ")))


def collect_parts(parts: DataFrame) -> DataFrame:
    """Parts (doc_id, part, offset, pages) kept in order of their offset where they overlap none kept before."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keep(p: pd.Series) -> pd.Series:
        out = []
        for rows in p:
            end, kept = -1, []
            for r in sorted(rows, key=lambda r: (r["offset"], r["part"])):
                if r["offset"] > end:
                    kept.append(r["part"])
                    end = r["offset"] + r["pages"] - 1
            out.append(kept)
        return pd.Series(out, dtype=object)

    g = parts.groupBy("doc_id").agg(F.collect_list(F.struct("part", "offset", "pages")).alias("p"))
    return parts.join(g.select("doc_id", F.explode(keep("p")).alias("part")), ["doc_id", "part"], "left_semi")


def normalized_bbox(bbox: Column, width: Column, height: Column) -> Column:
    """A box in thousandths of the page, one decimal; null without four numbers or a size."""
    ok = (F.size(bbox) == 4) & (width > 0) & (height > 0)
    return F.when(ok, F.transform(bbox, lambda v, i: F.round(v * 1000 / F.when(i % 2 == 0, width).otherwise(height), 1)))
