"""Cleaning rules on a table of blocks (doc_id, block_id, ord, kind, level, text, trailer, page_idx).

Every rule that changes text proposes rows of patches (doc_id, block_id, ord, rule_id,
operation, after_text, after_level, after_trailer, confidence, risk); rules that only
need a block's own lines are projections without a shuffle, the others count or
look at neighbours through windows by document.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import text as X
from ..functions.text import Plain as P
from ..session import written
from .metadata import same_title

# Block kinds whose text is content as it stands.
ATOMIC = ("code", "table", "equation", "footnote")
TRAILING_SKIP = ("code", "equation", "footnote")
# Rules in their order, confidence, and whether they apply by themselves.
POLICY = (
    ("page_numbers", "derived", True), ("running_heads", "derived", True), ("front_matter", "derived", True), ("cjk_spaces", "heuristic", True),
    ("blank_lines", "derived", True), ("trailing_spaces", "derived", True), ("join_lines", "heuristic", True), ("ocr_spaces", "heuristic", True),
    ("headings", "derived", True), ("dup_headings", "derived", True),
)
ALWAYS_ON = ("blank_lines", "trailing_spaces")


def lines(blocks: DataFrame) -> DataFrame:
    """One row per line, line_no from 1; a null text has no line."""
    return blocks.where("text is not null").select(*[c for c in blocks.columns if c != "text"], F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def _split(c: str = "text") -> Column:
    return F.split(c, "\n", -1)


def _patch(df: DataFrame, rule: str, after: Column, level: Column | None = None, delete: Column | None = None, confidence: str = "derived") -> DataFrame:
    gone = F.lit(False) if delete is None else delete
    return df.select(
        "doc_id", "block_id", "ord", F.lit(rule).alias("rule_id"), F.when(gone, "delete_block").otherwise("replace_text").alias("operation"),
        F.when(~gone, after).alias("after_text"), (F.lit(None).cast("int") if level is None else F.when(~gone, level.cast("int"))).alias("after_level"),
        F.lit(None).cast("string").alias("after_trailer"),
        F.lit(confidence).alias("confidence"), F.lit("low").alias("risk"),
    )


def _can_edit(skip: tuple[str, ...] = ATOMIC) -> Column:
    return ~F.coalesce(F.col("kind"), F.lit("")).isin(*skip) & F.col("text").isNotNull() & ~X.is_page_mark(F.col("text"))


def _editable(blocks: DataFrame) -> DataFrame:
    return blocks.where(_can_edit())


def page_numbers(blocks: DataFrame) -> DataFrame:
    """Lines that are only a page number go; a block of nothing else goes whole."""
    kept = F.filter(_split(), lambda s: ~X.is_page_number(s))
    b = _editable(blocks).withColumn("_k", kept).where(F.size("_k") < F.size(_split()))
    return _patch(b, "page_numbers", F.array_join("_k", "\n"), delete=F.size("_k") == 0)


def _verse_block() -> Column:
    some = F.filter(_split(), lambda s: X.strip(s) != "")
    return (F.size(some) >= 2) & (F.size(F.filter(some, X.is_verse_line)) * 2 >= F.size(some))


def repeated_heads(blocks: DataFrame, repeats: int = X.HEAD_REPEATS) -> DataFrame:
    """(doc_id, head, n): short lines without a sentence end that a document repeats."""
    b = _editable(blocks).where(~_verse_block())
    s = lines(b.select("doc_id", "text")).select("doc_id", X.strip(F.col("line")).alias("head")).where(X.is_running_head_candidate(F.col("head")))
    return s.groupBy("doc_id", "head").agg(F.count("*").alias("n")).where(F.col("n") >= repeats)


def running_heads(blocks: DataFrame) -> DataFrame:
    """Repeated short lines go. The repeated lines of a document are few; they meet its blocks by doc_id."""
    heads = repeated_heads(blocks).groupBy("doc_id").agg(F.collect_set("head").alias("heads"))
    b = _editable(blocks).where(~_verse_block()).join(heads, "doc_id")
    kept = F.filter(_split(), lambda s: ~F.array_contains("heads", X.strip(s)))
    b = b.withColumn("_k", kept).where(F.size("_k") < F.size(_split()))
    return _patch(b, "running_heads", F.array_join("_k", "\n"), delete=F.size("_k") == 0)


def _trim_text() -> Column:
    return F.array_join(F.transform(_split(), X.strip_trailing), "\n")


def trailing_spaces(blocks: DataFrame) -> DataFrame:
    b = blocks.where(_can_edit(TRAILING_SKIP)).withColumn("_n", _trim_text()).where("_n <> text")
    return _patch(b, "trailing_spaces", F.col("_n"))


def blank_lines(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, ord, trailer, after_trailer) where three or more line ends become two."""
    return blocks.where(F.col("trailer").rlike("\n{3,}")).select("doc_id", "block_id", "ord", "trailer", S.compress_blank_runs(F.col("trailer")).alias("after_trailer"))


def heading_text(c: Column) -> Column:
    return X.strip(F.regexp_replace(X.strip(c), "^#+", ""))


def headings(blocks: DataFrame) -> DataFrame:
    """Headings with their text, in order."""
    return blocks.where((F.col("kind") == "heading") & F.col("level").isNotNull() & F.col("text").isNotNull()).withColumn("title", heading_text(F.col("text")))


def base_level(blocks: DataFrame) -> DataFrame:
    """(doc_id, base): the level at which a document's chapters stand; null where unsure."""
    h = headings(blocks).where("title <> ''").select("doc_id", "level", F.col("title").rlike(X.PATTERNS["part"]).alias("part"), F.col("title").rlike(X.PATTERNS["chapter"]).alias("chapter"))
    by = h.groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.sum(F.col("part").cast("int")).alias("parts"), F.sum((F.col("chapter") & ~F.col("part")).cast("int")).alias("chapters"))

    def mode(of: str) -> Column:
        return F.max_by(F.when(F.col(of) > 0, F.col("level")), F.when(F.col(of) > 0, F.struct(F.col(of), -F.col("level"))))

    d = by.groupBy("doc_id").agg(
        F.sum("n").alias("n"), F.sum("parts").alias("parts"), F.sum("chapters").alias("chapters"), F.min("level").alias("lowest"),
        F.min_by("n", "level").alias("at_lowest"), mode("parts").alias("part_level"), mode("chapters").alias("chapter_level"),
    )
    base = (
        F.when(F.col("n") == 1, F.col("lowest")).when(F.col("parts") >= 2, F.col("part_level")).when(F.col("chapters") >= 2, F.col("chapter_level"))
        .when(F.col("n") < 3, None).when(F.col("n") <= 4, F.col("lowest")).when(F.col("at_lowest") >= 3, F.col("lowest"))
    )
    d = d.withColumn("base", base)
    return d.select("doc_id", F.when((F.col("base") > 3) & (F.col("n") > 1) | (F.col("lowest") < F.col("base")), None).otherwise(F.col("base")).alias("base"))


def heading_levels(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, ord, title, level, new_level): shifted by the base, then at most one deeper than the one before.

    The running clamp has a closed form: least of level - row number so far, plus row number.
    """
    h = headings(blocks).where("title <> ''").join(base_level(blocks), "doc_id", "left")
    h = h.withColumn("shifted", F.greatest(F.lit(1), F.col("level") - F.coalesce(F.col("base") - 1, F.lit(0))))
    w = W.partitionBy("doc_id").orderBy("ord", "block_id")
    h = h.withColumn("rn", F.row_number().over(w))
    run = F.min(F.col("shifted") - F.col("rn")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return h.select("doc_id", "block_id", "ord", "text", "title", "level", (run + F.col("rn")).cast("int").alias("new_level"))


def heading_patches(blocks: DataFrame) -> DataFrame:
    """Empty headings go; others get their level in text and level."""
    new = F.concat(F.repeat(F.lit("#"), F.col("new_level")), F.lit(" "), F.col("title"))
    fixed = heading_levels(blocks).withColumn("_n", new).where("_n <> text or new_level <> level")
    return _patch(headings(blocks).where("title = ''"), "headings", F.lit(""), delete=F.lit(True)).unionByName(_patch(fixed, "headings", F.col("_n"), F.col("new_level")))


def duplicate_headings(blocks: DataFrame) -> DataFrame:
    """Of equal headings that follow each other with at most one blank line, every second goes."""
    w = W.partitionBy("doc_id").orderBy("ord", "block_id")
    b = blocks.where("text is not null").withColumn("title", F.when((F.col("kind") == "heading") & F.col("level").isNotNull(), heading_text(F.col("text"))))
    b = b.withColumns({"pt": F.lag("title").over(w), "pl": F.lag("level").over(w), "gap": F.greatest(F.lit(0), S.count(F.coalesce(F.lag("trailer").over(w), F.lit("")), "\n") - 1)})
    same = (F.col("title") != "") & (F.col("title") == F.col("pt")) & (F.col("level") == F.col("pl")) & (F.col("gap") <= 1)
    b = b.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    b = b.withColumn("at", F.row_number().over(W.partitionBy("doc_id", "island").orderBy("ord", "block_id")))
    return _patch(b.where("at % 2 = 0"), "dup_headings", F.lit(""), delete=F.lit(True))


def _break_text() -> Column:
    lines_ = _split()
    keep = F.transform(lines_, X.keeps_break)
    # flags beside their lines, so that each line is judged once
    here = F.zip_with(lines_, keep, lambda t, k: F.struct(t.alias("t"), k.alias("k")))
    after = F.concat(F.slice(keep, F.lit(2), F.size(keep)), F.array(F.lit(False)))

    def one(x: Column, nxt: Column) -> Column:
        return F.when(x["k"] & nxt & ~x["t"].endswith("  "), F.concat(F.regexp_replace(x["t"], "[ \t]+$", ""), F.lit("  "))).otherwise(x["t"])

    return F.array_join(F.zip_with(here, after, one), "\n")


def verse_breaks(blocks: DataFrame) -> DataFrame:
    """Lines of verse, entries and notes that follow each other within a block get a hard break, except the last of a run."""
    b = _editable(blocks).where(F.col("text").contains("\n"))
    b = b.withColumn("_n", _break_text()).where("_n <> text")
    return _patch(b, "join_lines", F.col("_n"), confidence="heuristic")


def _joined(acc: Column, cur: Column) -> Column:
    """One more line onto the lines so far: as the end of the last one if that was broken off, else by itself."""
    prev = F.element_at(acc, -1)
    s = X.strip(cur)
    open_ = ~X.is_block_start(X.strip(prev)) & ~X.is_catalog_entry(prev) & ~X.is_note(prev) & ~X.ends_sentence(X.strip(prev)) & ~prev.endswith("  ") & (F.length(X.visible(prev)) >= X.JOIN_MIN)
    fits = (s != "") & ~X.is_block_start(s) & ~X.is_catalog_entry(s) & ~X.is_note(s) & ~s.rlike(X.PATTERNS["start_punct"])
    gap = F.when(prev.rlike("[A-Za-z]$") & s.rlike("^[A-Za-z]"), F.lit(" ")).otherwise(F.lit(""))
    return F.when((F.size(acc) > 0) & open_ & fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(X.strip(prev), gap, s)))).otherwise(F.concat(acc, F.array(cur)))


def _join_text() -> Column:
    lines_ = _split()
    return F.array_join(F.aggregate(F.slice(lines_, 2, F.size(lines_)), F.slice(lines_, 1, 1), _joined), "\n")


def join_lines(blocks: DataFrame) -> DataFrame:
    """Lines of a text block that were broken off at the edge of a page or column become one line again."""
    b = _editable(blocks).where(F.col("text").contains("\n") & (F.col("kind") == "text"))
    b = b.withColumn("_n", _join_text()).where("_n <> text")
    return _patch(b, "join_lines", F.col("_n"), confidence="heuristic")


def joins_across_blocks(blocks: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(doc_id, block_id, next_id, status): text blocks broken off before the next one; without evidence of the next only suggested."""
    w = W.partitionBy("doc_id").orderBy("ord", "block_id")
    b = blocks.where("text is not null").withColumns({"nk": F.lead("kind").over(w), "nt": F.lead("text").over(w), "next_id": F.lead("block_id").over(w), "no": F.lead("ord").over(w)})
    last, first = F.element_at(_split(), -1), F.element_at(F.split("nt", "\n", -1), 1)
    gap = F.greatest(F.lit(0), S.count(F.coalesce("trailer", F.lit("")), "\n") - 1)
    j = b.where((F.col("kind") == "text") & (F.col("nk") == "text") & (gap <= 1) & (F.size(_joined(F.array(last), first)) == 1) & ~X.is_layout_line(first))
    if linked is None:
        return j.select("doc_id", "block_id", "next_id", F.lit("suggested").alias("status"))
    e = linked.select("doc_id", F.col("ord").alias("no"), F.lit(True).alias("known")).distinct()
    return j.join(e, ["doc_id", "no"], "left").select("doc_id", "block_id", "next_id", F.when(F.col("known"), "proposed").otherwise("suggested").alias("status"))


# The characters that count as Chinese text, and what stands before and after a space that goes.
_CJK = r"\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}“”‘’—…"
SPACE_PAIRS = (
    (f"[{_CJK}]", f"[{_CJK}]"), (f"[{_CJK}]", r"\p{Nd}"), (r"\p{Nd}", f"[{_CJK}]"), (f"[{_CJK}]", "<[^>]+>"),
    ("</?[a-zA-Z]{1,5}>", r"[\x{4e00}-\x{9fff}]"), (f"[{_CJK}]", "[()]"), ("[()]", f"[{_CJK}]"),
)
#: Code and formulas within a line: what is in them is content.
_INLINE = r"(`+).+?\1|\$\$.+?\$\$|(?<!\$)\$(?![\s$])[^$\n]+?(?<!\s)\$(?![\p{Nd}$])"


def outside_inline(line: Column, fix) -> Column:
    """The line with ``fix`` applied to what stands outside inline code and formulas."""
    parts = F.transform(F.split(line, _INLINE, -1), fix)
    kept = F.concat(F.regexp_extract_all(line, F.lit(_INLINE), F.lit(0)), F.array(F.lit("")))
    return F.when(line.rlike("[`$]"), F.array_join(F.flatten(F.zip_with(parts, kept, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")).otherwise(fix(line))


def cjk_fixed(line: Column) -> Column:
    """A space between Chinese characters, and between them and digits, tags or parentheses, goes; those around Latin words stay."""
    out = line
    for a, b in SPACE_PAIRS:
        out = F.regexp_replace(out, f"(?<={a}) (?={b})", "")
    return out


def _may_space() -> Column:
    return F.col("text").rlike(f"[{_CJK}()>] | [{_CJK}()]")


def _space_text(alone: Column) -> Column:
    """Structure lines and verse stay; so does a line that stands alone between blank lines and looks like a field."""
    fix = lambda s: F.when(X.is_structure_line(s) | X.is_verse_line(s) | (alone & X.is_layout_line(s)), s).otherwise(outside_inline(s, cjk_fixed))
    return F.array_join(F.transform(_split(), fix), "\n")


def _stands_alone(before: Column) -> Column:
    """Whether a block is one line with blank lines, or nothing, around it; before: the blank space in front of it."""
    blank = lambda ws: ws.isNull() | (S.count(ws, "\n") > 1)
    return ~F.col("text").contains("\n") & blank(before) & (blank(F.col("trailer")) | (F.col("trailer") == ""))


def _before() -> Column:
    return F.lag("trailer").over(W.partitionBy("doc_id").orderBy("ord", "block_id"))


def cjk_spaces(blocks: DataFrame) -> DataFrame:
    b = _editable(blocks.withColumn("_b", _before())).where(_may_space()).withColumn("_n", _space_text(_stands_alone(F.col("_b")))).where("_n <> text")
    return _patch(b, "cjk_spaces", F.col("_n"), confidence="heuristic")


_PIECES = r"(?<![A-Za-z])[A-Za-z]{1,4}(?: [A-Za-z]{1,4}){2,}(?![A-Za-z])"


def _may_close() -> Column:
    return F.col("text").rlike(f"[{_CJK}]") & F.col("text").rlike(_PIECES)


def _close_text() -> Column:
    def close(s: Column) -> Column:
        runs = F.regexp_extract_all(s, F.lit(_PIECES), F.lit(0))
        good = F.filter(runs, lambda r: (F.size(F.filter(F.split(r, " "), lambda p: F.length(p) <= 2)) >= 2) & F.exists(F.split(r, " "), lambda p: F.length(p) >= 3))
        return F.aggregate(good, s, lambda acc, r: F.replace(acc, r, F.replace(r, F.lit(" "), F.lit(""))))

    return F.array_join(F.transform(_split(), lambda s: F.when(~s.rlike(f"[{_CJK}]") | X.is_structure_line(s), s).otherwise(outside_inline(s, close))), "\n")


def ocr_spaces(blocks: DataFrame) -> DataFrame:
    """In lines with Han characters, three or more Latin pieces of at most four letters, two of them short, become one word."""
    b = _editable(blocks).where(_may_close()).withColumn("_n", _close_text()).where("_n <> text")
    return _patch(b, "ocr_spaces", F.col("_n"), confidence="heuristic")


def front_matter(blocks: DataFrame, titles: DataFrame, most_blocks: int = 8, most_chars: int = 120, longest: int = 60) -> DataFrame:
    """Blocks of the first page that only name the book: few, short, no sentence, no chapter, and a heading that is the title.

    Where pages are known (some block is on page 0) the first page ends before the first block of a later one, and
    fields alone (two or more, a chapter after them) are enough; otherwise it ends before the first chapter's heading.
    """
    w = W.partitionBy("doc_id").orderBy("ord", "block_id")
    s = X.strip(F.coalesce(F.col("text"), F.lit("")))
    b = blocks.where((s != "") & ~X.is_page_mark(s) & ~s.startswith("<!--"))
    anchor = (F.col("kind") == "heading") & X.is_chapter_anchor(heading_text(F.col("text")))
    every = b.groupBy("doc_id").agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("page_idx") == 0), F.lit(False)).alias("paged"))
    b = b.join(every, "doc_id").withColumn("anchor", anchor)
    stop = F.when(F.col("paged"), F.coalesce(F.col("page_idx") > 0, F.lit(False))).otherwise(F.col("anchor") & F.lag("ord").over(w).isNotNull())
    b = b.withColumn("later", F.max(stop).over(w.rowsBetween(W.unboundedPreceding, 0)))
    b = b.join(titles.select("doc_id", "title").where("title is not null").dropDuplicates(["doc_id"]), "doc_id", "left")
    first = ~F.col("later")
    head = F.col("kind") == "heading"
    nxt = b.where(F.col("later") & head).groupBy("doc_id").agg(F.min_by("anchor", F.struct("ord", "block_id")).alias("chapter_next"))
    t = X.strip(F.col("text"))
    # titles are compared for the few blocks of the first page only
    d = b.where(first).withColumn("same", head & same_title(heading_text(F.col("text")), F.col("title"))).groupBy("doc_id").agg(
        F.max("n").alias("n"), F.max("paged").alias("paged"), F.count("*").alias("run"), F.sum(F.length(X.visible(F.col("text")))).alias("chars"),
        F.max((F.length(t) > longest) | X.ends_sentence(t)).alias("prose"), F.max("anchor").alias("chapter"),
        F.coalesce(F.max("same"), F.lit(False)).alias("match"), F.min(X.is_front_field(t)).alias("fields"),
    ).join(nxt, "doc_id", "left")
    good = (F.col("n") >= 2) & F.col("run").between(1, most_blocks) & (F.col("run") < F.col("n")) & (F.col("chars") <= most_chars) & ~F.col("prose") & ~F.col("chapter")
    good &= F.col("match") | (F.col("paged") & F.col("fields") & (F.col("run") >= 2) & F.coalesce("chapter_next", F.lit(True)))
    hit = b.where(first).join(d.where(good).select("doc_id"), "doc_id", "left_semi")
    return _patch(hit, "front_matter", F.lit(""), delete=F.lit(True))


_MADE = "array<struct<step:int,rule_id:string,operation:string,after_text:string,after_level:int,after_trailer:string,confidence:string,risk:string>>"


def _step(state: DataFrame, i: int, after: Column, delete: Column | None = None, trailer: Column | None = None) -> DataFrame:
    """The state after one rule: where ``after`` is not null or ``delete`` holds, a patch is noted and applied; a deleted block is a row without text, kind and trailer."""
    rule, confidence, _ = POLICY[i]
    s = state.withColumn("_n", after).withColumn("_g", F.lit(False) if delete is None else F.coalesce(delete, F.lit(False)))
    s = s.withColumn("_t", F.lit(None).cast("string") if trailer is None else F.when(~F.col("_g"), trailer))
    hit = F.col("_g") | F.col("_n").isNotNull() | F.col("_t").isNotNull()
    text = F.when(~F.col("_g"), F.coalesce("_n", "text"))
    patch = F.struct(
        F.lit(i).alias("step"), F.lit(rule).alias("rule_id"), F.when(F.col("_g"), "delete_block").otherwise("replace_text").alias("operation"), text.alias("after_text"),
        F.lit(None).cast("int").alias("after_level"), F.col("_t").alias("after_trailer"), F.lit(confidence).alias("confidence"), F.lit("low").alias("risk"),
    )
    s = s.withColumn("made", F.when(hit, F.concat("made", F.array(patch))).otherwise(F.col("made")))
    kept = {c: F.when(~F.col("_g"), F.col(c)) for c in ("kind", "level")}
    return s.withColumns({"text": text, "trailer": F.when(~F.col("_g"), F.coalesce("_t", "trailer")), **kept}).drop("_n", "_g", "_t")


def _changed(state: DataFrame, i: int, where: Column, after: Column) -> DataFrame:
    """The state after a rule of a block's own lines that gives a new text."""
    s = state.withColumn("_a", F.when(where, after))
    return _step(s, i, F.when(F.col("_a") != F.col("text"), F.col("_a"))).drop("_a")


def _cut_lines(state: DataFrame, i: int, where: Column, kept: Column) -> DataFrame:
    """The state after a rule that drops lines."""
    s = state.withColumn("_k", F.when(where, kept))
    less = F.coalesce(F.col("_k").isNotNull() & (F.size("_k") < F.size(_split())), F.lit(False))
    return _step(s, i, F.when(less & (F.size("_k") > 0), F.array_join("_k", "\n")), less & (F.size("_k") == 0)).drop("_k")


def _kept(line: str) -> str:
    """A line without outer white space, but with its hard break."""
    return line.strip() + (X.HARD_BREAK if line.endswith("  ") and line.strip() else "")


def _goes_on(acc: str, line: str, gap: int, field: bool) -> bool:
    """Whether a line continues the lines put together so far; field: these are a field on a line of its own."""
    t = line.strip()
    if not acc or not t or gap > 1 or field or acc.endswith(X.HARD_BREAK) or gap and P.layout(t):
        return False
    if P.block_start(acc) or P.block_start(t) or P.entry_or_note(acc) or P.entry_or_note(t):
        return False
    return not P.ends_sentence(acc) and t[0] not in X.START_PUNCT and len("".join(acc.split())) >= X.JOIN_MIN


def join_run(run: list[dict]) -> list[tuple[str | None, str | None]]:
    """(text, trailer) of consecutive blocks after lines that were broken off are joined, within a block and onto linked ones.

    run: dicts with text, trailer, gap (blank lines in front), linked, mark (a page comment, which joins look through) and
    atomic. A block whose first
    line continues the one before becomes part of it and has no text left; the blank space after it passes to the comment
    before it, or else to the block it went into. Lines of verse that follow each other get hard breaks.
    """
    texts: list[list[str] | None] = [None] * len(run)
    trailers: list[str | None] = [b["trailer"] for b in run]
    gone: set[int] = set()
    acc, root, field, mark = None, -1, False, None
    for k, b in enumerate(run):
        gap = min(b["gap"], 1)
        if b["mark"]:
            mark = k
            continue
        if b["atomic"] or b["text"] is None:
            acc, root = None, -1
            continue
        for j, line in enumerate(b["text"].split("\n")):
            t = _kept(line)
            if acc is not None and (j or b["linked"]) and _goes_on(acc, t, 0 if j else gap, field):
                sep = " " if acc[-1].isascii() and acc[-1].isalpha() and t[0].isascii() and t[0].isalpha() else ""
                acc += sep + t
                texts[root][-1] = acc
                field = False
                if not j:
                    gone.add(k)
                    trailers[root if mark is None else mark] = "\n" * (min(max(0, (b["trailer"] or "").count("\n") - 1), 1) + 1) if b["trailer"] else b["trailer"]
            else:
                if not j:
                    root = k
                    texts[k] = []
                acc, field = t, not j and gap > 0 and P.layout(t)
                texts[root].append(t)
        mark = None
    out: list[tuple[str | None, str | None]] = []
    for k, b in enumerate(run):
        rows = texts[k]
        if rows is None:
            out.append((None if k in gone else b["text"], trailers[k]))
            continue
        keep = [P.keeps_break(t) for t in rows]
        out.append(("\n".join(t.rstrip() + X.HARD_BREAK if keep[i] and i + 1 < len(rows) and keep[i + 1] else t for i, t in enumerate(rows)), trailers[k]))
    return out


_JOINED = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("trailer", T.StringType())]))


@F.pandas_udf(_JOINED)
def _join_udf(runs: pd.Series) -> pd.Series:
    return pd.Series([[{"text": t, "trailer": r} for t, r in join_run(list(run))] for run in runs], dtype=object)


def _joined_and_broken(state: DataFrame, i: int) -> DataFrame:
    """join_lines: blocks that may go on from the one before are runs; only these and blocks of several lines are looked at.

    Column linked tells which blocks have evidence of their own and may be joined onto the one before.
    """
    cols = state.columns
    w = W.partitionBy("doc_id").orderBy("ord", "block_id")
    lines_ = _split()
    mark = F.coalesce(X.is_page_mark(F.col("text")), F.lit(False))
    s = state.withColumn("_p", F.col("text").isNotNull() & ~mark & ~F.coalesce(F.col("kind"), F.lit("")).isin(*ATOMIC))
    seen = F.when(F.col("text").isNotNull() & ~mark, F.struct("_p", X.strip(F.element_at(lines_, -1)).alias("t")))
    s = s.withColumn("_q", F.last(seen, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    goes = F.col("_p") & F.col("linked") & F.coalesce(F.col("_q")["_p"] & ~X.ends_sentence(F.col("_q")["t"]) & ~X.is_block_start(F.col("_q")["t"]), F.lit(False))
    s = s.withColumn("_s", goes | mark | F.col("text").isNull()).withColumn("_r", F.sum((~F.col("_s")).cast("int")).over(w))
    s = s.withColumn("_g", F.greatest(F.lit(0), S.count(F.coalesce(F.last("trailer", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit("")), "\n") - 1).cast("int"))
    s = s.withColumn("_m", F.max(goes.cast("int")).over(W.partitionBy("doc_id", "_r")))
    item = F.struct("ord", "block_id", "text", "trailer", F.col("_g").alias("gap"), F.coalesce("linked", F.lit(False)).alias("linked"), mark.alias("mark"), (~F.col("_p") & ~mark).alias("atomic"), F.struct(*cols).alias("row"))
    alone = s.where("_m = 0").select(F.array(item).alias("x"), (F.col("_p") & (F.col("text").contains("\n") | (X.strip(F.col("text")) != F.col("text")))).alias("look"))
    several = s.where("_m = 1").groupBy("doc_id", "_r").agg(F.sort_array(F.collect_list(item)).alias("x")).select("x", F.lit(True).alias("look"))
    runs = alone.unionByName(several)
    parts = F.transform("x", lambda x: F.struct(x["text"].alias("text"), x["trailer"].alias("trailer"), x["gap"].alias("gap"), x["linked"].alias("linked"), x["mark"].alias("mark"), x["atomic"].alias("atomic")))
    runs = runs.withColumn("y", _join_udf(F.when(F.col("look"), parts).otherwise(F.array().cast(parts_type()))))
    flat = runs.select("look", F.explode(F.arrays_zip("x", "y")).alias("z")).select("z.x.row.*", F.col("z.y.text").alias("_x"), F.col("z.y.trailer").alias("_w"), "look")
    gone = F.col("look") & F.col("_x").isNull() & F.col("text").isNotNull()
    new = F.when(F.col("look") & (F.col("_x") != F.col("text")), F.col("_x"))
    trail = F.when(F.col("look") & (F.col("_w") != F.col("trailer")), F.col("_w"))
    return _step(flat, i, new, gone, trail).drop("_x", "_w", "look")


def parts_type() -> str:
    return "array<struct<text:string,trailer:string,gap:int,linked:boolean,mark:boolean,atomic:boolean>>"


def propose(blocks: DataFrame, titles: DataFrame | None = None, disabled: tuple[str, ...] = (), linked: DataFrame | None = None) -> DataFrame:
    """Patches of all enabled rules, each rule on what the rules before it left, with the rule's place in the order."""
    return run(blocks, titles, disabled, linked)[0]


def cleaned(blocks: DataFrame, titles: DataFrame | None = None, disabled: tuple[str, ...] = (), linked: DataFrame | None = None) -> DataFrame:
    """The blocks that are left after all enabled rules, with their texts, levels and trailers; see run."""
    return run(blocks, titles, disabled, linked)[1].where("text is not null").drop("made", "linked")


def run(blocks: DataFrame, titles: DataFrame | None = None, disabled: tuple[str, ...] = (), linked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(patches, state) of all enabled rules one after the other.

    Rules of a block's own lines follow each other within the row; the state is written where a rule
    that looks at the whole document reads it more than once. linked: (doc_id, block_id) of blocks with
    evidence of their own, which may be joined onto the block before; without it lines are joined within blocks.
    """
    if linked is None:
        blocks = blocks.withColumn("linked", F.lit(False))
    else:
        blocks = blocks.join(linked.select("doc_id", "block_id").distinct().withColumn("linked", F.lit(True)), ["doc_id", "block_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    known = blocks.select("doc_id", F.lit(None).cast("string").alias("title")).limit(0) if titles is None else titles
    none = F.array().cast(_MADE)
    out: list[DataFrame] = []

    def settled(b: DataFrame) -> DataFrame:
        """The state written; what its rows have noted so far is given out."""
        b = written(b)
        out.append(b.where("size(made) > 0").select("doc_id", "block_id", "ord", F.explode("made").alias("m")).select("doc_id", "block_id", "ord", "m.rule_id", "m.operation", "m.after_text", "m.after_level", "m.after_trailer", "m.confidence", "m.risk", "m.step"))
        return b.withColumn("made", none)

    def noted(b: DataFrame, patches: DataFrame, i: int) -> DataFrame:
        """The state after patches of few blocks."""
        p = patches.select("doc_id", "block_id", F.lit(True).alias("_hit"), F.col("operation").alias("_op"), F.col("after_text").alias("_x"), F.col("after_level").alias("_l"))
        s = b.join(p, ["doc_id", "block_id"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        gone = F.col("_hit") & (F.col("_op") == "delete_block")
        out.append(patches.withColumn("step", F.lit(i)))
        return s.withColumns({
            "text": F.when(gone, None).when(F.col("_hit"), F.col("_x")).otherwise(F.col("text")), "trailer": F.when(~gone, F.col("trailer")),
            "kind": F.when(~gone, F.col("kind")), "level": F.when(~gone, F.coalesce("_l", "level")),
        }).drop("_hit", "_op", "_x", "_l")

    def heads_gone(b: DataFrame, i: int) -> DataFrame:
        heads = repeated_heads(b).groupBy("doc_id").agg(F.collect_set("head").alias("heads"))
        kept = F.filter(_split(), lambda s: ~F.array_contains("heads", X.strip(s)))
        return _cut_lines(b.join(heads, "doc_id", "left"), i, _can_edit() & ~_verse_block() & F.col("heads").isNotNull(), kept).drop("heads")

    def front_gone(b: DataFrame, i: int) -> DataFrame:
        b = settled(b)
        return noted(b, written(front_matter(b, known)), i)

    def levels_set(b: DataFrame, i: int) -> DataFrame:
        b = settled(b)
        return noted(b, written(heading_patches(b)), i)

    def doubles_gone(b: DataFrame, i: int) -> DataFrame:
        return noted(b, written(duplicate_headings(b)), i)

    made = {
        "page_numbers": lambda b, i: _cut_lines(b, i, _can_edit(), F.filter(_split(), lambda s: ~X.is_page_number(s))),
        "running_heads": heads_gone, "front_matter": front_gone,
        "cjk_spaces": lambda b, i: _changed(b.withColumn("_b", _before()), i, _can_edit() & _may_space(), _space_text(_stands_alone(F.col("_b")))).drop("_b"),
        "blank_lines": lambda b, i: _step(b, i, F.lit(None).cast("string"), trailer=F.when(F.col("trailer").rlike("\n{3,}"), S.compress_blank_runs(F.col("trailer")))),
        "trailing_spaces": lambda b, i: _changed(b, i, _can_edit(TRAILING_SKIP), _trim_text()),
        "join_lines": _joined_and_broken,
        "ocr_spaces": lambda b, i: _changed(b, i, _can_edit() & _may_close(), _close_text()),
        "headings": levels_set, "dup_headings": doubles_gone,
    }
    state, within = blocks.withColumn("made", none), False
    for i, (rule, _, _) in enumerate(POLICY):
        if rule in disabled and rule not in ALWAYS_ON:
            continue
        if rule not in made:
            raise ValueError(f"no proposer for rule {rule}")
        state = made[rule](state, i)
        within = rule not in ("front_matter", "headings", "dup_headings")
    if within:
        state = settled(state)
    return reduce(DataFrame.unionByName, out), state


def missing_images(refs: DataFrame, files: DataFrame | None) -> DataFrame:
    """(doc_id, image) referenced, relative, and not among the files (doc_id, image); without files nothing is checked."""
    if files is None:
        return refs.where("false")
    r = refs.where(~F.col("image").rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|/)")).select("doc_id", F.regexp_replace("image", r"^.*[/\\]", "").alias("image")).distinct()
    return r.join(files.select("doc_id", "image"), ["doc_id", "image"], "left_anti")
