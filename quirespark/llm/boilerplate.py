"""Problem 3: lines repeated across the books of one source.

Lines are brought to a form without case, spacing, width, punctuation,
ornaments, numbers, dates and the book's title; words too rare in the source to
belong to its repeated lines (persons) become a gap. Lines that cannot stand in
enough books, whatever their gap, drop out by an upper bound. What is left of
each book is a sequence of line ids in reading order, across its blocks; the
suffixes of all sequences of a source form a suffix array (range-partitioned,
identical suffixes once), common prefixes of neighbours give the repeated blocks
of one or more lines, and the lines of blocks that span enough books, and no
others, are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small, written
from ..tables import latest, source_key
from .confusables import consistent_form

#: A line recurs excessively from so many books and this share of its source's books on.
MIN_BOOKS, MIN_SHARE = 4, 0.2
#: Kinds whose lines are no cases.
SKIP_KINDS = ("heading", "code", "table")
#: Lines of a repeated block at most; longer blocks are found as overlapping ones of that length, so no line is lost.
LONGEST = 64
#: Blocks of a book that one task puts in order; it also sees the first LONGEST of the next ones.
CHUNK = 1024
#: Letters of a run of Han, and of one with kana, that is too long for a name.
NAME_HAN, NAME_KANA = 9, 20
TITLE = "§"
GAP = "*"

_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_WORD = re.compile(r"\d+|[぀-ヿ㐀-䶿一-鿿]+|[^\W\d_぀-ヿ㐀-䶿一-鿿]+")
_NUMBERS = re.compile(r"(?<!\S)\d+(?: \d+)*(?!\S)")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"\d")


def words(line: str) -> str:
    """Words in lower case without punctuation, joined by spaces; numbers and dates become one '0'. Han and kana runs stand apart."""
    got = " ".join(_WORD.findall(line.lower()))
    return _NUMBERS.sub("0", got) if _DIGIT.search(got) else got


def normal_line(line: str, titles: list[str]) -> str:
    """The line's words, '' if it has no letter; the book's title is one sign."""
    norm = words(line)
    for t in titles:
        if t in norm:
            if _CJK.search(t):
                norm = " ".join(norm.replace(t, f" {TITLE} ").split())
            else:
                norm = f" {norm} ".replace(f" {t} ", f" {TITLE} ").strip()
    return norm if _LETTER.search(norm) else ""


def title_words(title: str) -> str:
    return words(re.sub(r"^#+\s*", "", consistent_form(title)[0]))


def views(source: str, norm: str) -> list[int]:
    """Beginnings and ends of a line by source, as hashes: whole words with 2**k characters or more, for two values of k.

    Lines that differ in one run of words, of any number, which takes at most half of each, share one of them: what
    surrounds the run is the same in all, half of it or more stands on one side, and the lines' lengths differ by a
    factor of two at most, so that they have a k in common.
    """
    k = max(0, (len(norm) // 2).bit_length() - 1)
    out = []
    for side, line in ((">", norm), ("<", norm[::-1])):
        for d in (k, max(0, k - 1)):
            at = line.find(" ", 1 << d)
            part = line if at < 0 else line[:at]
            out.append(xxhash.xxh64_intdigest(f"{source}\n{side}{d}\n{part}".encode("utf-8", "surrogatepass")) - (1 << 63))
    return out


#: Lines of a text, each as its number, a space and its words; four views of each, one line after the other.
_LINES = T.StructType([T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("views", T.ArrayType(T.LongType()))])


@F.pandas_udf(_LINES)
def _lines(texts: pd.Series, titles: pd.Series, sources: pd.Series) -> pd.DataFrame:
    known: dict[tuple, list[str]] = {}
    lines, seen = [], []
    for text, own, source in zip(texts, titles, sources, strict=True):
        got, v = [], []
        if isinstance(text, str):
            own = tuple(own) if own is not None else ()
            forms = known.get(own)
            if forms is None:
                forms = known[own] = sorted({f for t in own if t and len(f := title_words(t)) > 1}, key=len, reverse=True)
            for i, line in enumerate(consistent_form(text, letters=True)[0].split("\n"), 1):
                norm = normal_line(line, forms)
                if norm:
                    got.append(f"{i} {norm}")
                    v += views(source, norm)
        lines.append(got)
        seen.append(np.array(v, dtype=np.int64))
    return pd.DataFrame({"lines": pd.Series(lines, dtype=object), "views": pd.Series(seen, dtype=object)})


def titles_of(blocks: DataFrame, book_meta: DataFrame | None) -> DataFrame:
    """(doc_id, titles): a book's title by its label and by its first first-level heading, two at most."""
    order = F.col("ord") if "ord" in blocks.columns else F.col("block_id")
    t = blocks.where((F.col("kind") == "heading") & F.col("text").rlike(r"^#\s*[^#\s]")).groupBy("doc_id").agg(F.min_by("text", order).alias("title"))
    if book_meta is not None:
        t = t.unionByName(book_meta.where("title is not null").groupBy("doc_id").agg(F.max("title").alias("title")))
    return t.groupBy("doc_id").agg(F.collect_set("title").alias("titles"))


def books(doc_meta: DataFrame, book_meta: DataFrame | None, blocks: DataFrame) -> DataFrame:
    """(doc_id, source, titles, n_books) of books with a source; see titles_of."""
    d = doc_meta.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(source_key("source"), F.struct(source_key("source").isNotNull(), F.col("ingested_at"))).alias("source")).where("source is not null")
    size = d.groupBy("source").agg(F.count("*").alias("n_books"))
    t = titles_of(blocks, book_meta)
    return d.join(size, "source").join(t, "doc_id", "left")


def normal_lines(blocks: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, ord, block_id, i, m, source, n_books, views, line_no, norm) of all lines with a letter, i of m in its block; a written table."""
    b = blocks.where(~F.coalesce(F.col("kind"), F.lit("")).isin(*SKIP_KINDS) & F.col("text").isNotNull()).select("doc_id", F.col("ord").cast("long") if "ord" in blocks.columns else F.lit(None).cast("long").alias("ord"), "block_id", "text")
    rows = b.join(small(of), "doc_id").select("doc_id", "ord", "block_id", "source", "n_books", _lines("text", "titles", "source").alias("l"))
    rows = rows.select("doc_id", "ord", "block_id", "source", "n_books", F.size("l.lines").alias("m"), F.col("l.views").alias("v"), F.posexplode("l.lines").alias("i", "l"))
    rows = rows.select("doc_id", "ord", "block_id", "i", "m", "source", "n_books", F.slice("v", F.col("i") * 4 + 1, F.lit(4)).alias("views"), F.substring_index("l", " ", 1).cast("int").alias("line_no"), F.expr("substr(l, instr(l, ' ') + 1)").alias("norm"))
    return written(rows)


def _enough(n: str) -> Column:
    return F.greatest(F.lit(MIN_BOOKS), F.ceil(F.col(n) * MIN_SHARE - F.lit(1e-9)))


def _may_be_name(w: Column) -> Column:
    """Runs of Han are clauses, not names, from NAME_HAN letters on; with kana from NAME_KANA letters on."""
    most = F.when(w.rlike("[぀-ヿ]"), NAME_KANA).when(w.rlike("[㐀-䶿一-鿿]"), NAME_HAN)
    return most.isNull() | (F.length(w) < most)


_LINE = ("doc_id", "ord", "block_id", "i", "m", "line_no", "source", "n_books")


def candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, block_id, i, m, line_no, source, n_books, key, form) of lines that may stand in enough books; a written table.

    1. views of a line counted over all lines (map-side partial counts) bound its number of books from above, then
       their books are counted for those that are left;
    2. words of the remaining lines are counted by book in their source; rare ones become gaps;
    3. a form without a gap that alone stands in enough books has the key of the form with a gap in place of some
       of its words, if that occurs: they differ in a person named.
    """
    seen = lines.select("n_books", F.explode("views").alias("v")).groupBy("v").agg(F.count("*").alias("n"), F.max("n_books").alias("n_books"))
    often = small(written(seen.where(F.col("n") >= _enough("n_books")).select("v")))
    pairs = written(lines.select(*_LINE, "norm", F.explode("views").alias("v")).join(often, "v", "left_semi"))
    held = pairs.select("v", "doc_id", "n_books").distinct().groupBy("v").agg(F.count("*").alias("n"), F.max("n_books").alias("n_books"))
    held = small(written(held.where(F.col("n") >= _enough("n_books")).select("v")))
    some = written(pairs.join(held, "v", "left_semi").drop("v").distinct())
    words = some.select("*", F.posexplode(F.split("norm", " ")).alias("at", "w"))
    common = words.select("source", "n_books", "w", "doc_id").distinct().groupBy("source", "w").agg(F.count("*").alias("n"), F.max("n_books").alias("n_books"))
    common = common.where((F.col("n") >= _enough("n_books")) | F.col("w").isin("0", TITLE)).select("source", "w", F.lit(1).alias("keep"))
    w = words.join(small(written(common)), ["source", "w"], "left").select(*_LINE, F.length("norm").alias("length"), F.struct("at", F.when((F.col("keep") == 1) | ~_may_be_name(F.col("w")), F.col("w")).otherwise(GAP).alias("w")).alias("x"))
    form = w.groupBy(*_LINE).agg(F.max("length").alias("length"), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["w"]), " ").alias("form"))
    form = form.withColumn("form", F.regexp_replace("form", r"(^| )\*(?: \*)+(?= |$)", "$1*")).where(F.regexp_replace("form", r"[\d\s*§]", "") != "")
    # a gap stands for a person, not for most of the line
    fixed = F.length(F.regexp_replace("form", r" ?\* ?", ""))
    form = written(form.where(~F.col("form").contains(GAP) | (fixed * 2 >= F.col("length"))).drop("length"))
    count = form.select("source", "n_books", "form", "doc_id").distinct().groupBy("source", "form").agg(F.count("*").alias("n"), F.max("n_books").alias("n_books"))
    count = written(count)
    filled = count.where((F.col("n") >= _enough("n_books")) & ~F.col("form").contains(GAP)).select("source", "form", F.explode(_with_gap("form")).alias("gapped"))
    gaps = count.where(F.col("form").contains(GAP)).select("source", F.col("form").alias("gapped"))
    same = filled.join(gaps, ["source", "gapped"], "left_semi").groupBy("source", "form").agg(F.min("gapped").alias("gapped"))
    got = form.join(small(written(same)), ["source", "form"], "left")
    return written(got.select(*_LINE, F.xxhash64("source", F.coalesce("gapped", "form")).alias("key"), F.coalesce("gapped", "form").alias("form")))


_FORMS = T.ArrayType(T.StringType())


@F.pandas_udf(_FORMS)
def _with_gap(forms: pd.Series) -> pd.Series:
    def cut(f: str) -> list[str]:
        w = f.split(" ")
        most = len(f) // 2
        name = [len(x) < (NAME_KANA if re.search("[぀-ヿ]", x) else NAME_HAN if _CJK.search(x) else 99) for x in w]
        return sorted({" ".join([*w[:i], GAP, *w[j:]]) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w) and all(name[i:j]) and sum(map(len, w[i:j])) + j - i <= most})

    return pd.Series([cut(f) for f in forms])


_INTERVAL = T.StructType([T.StructField("source", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])


def intervals(array: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], int]:
    """Common-prefix intervals of one piece of a suffix array of (suffix, books): prefix -> books added up.

    array is sorted. An interval that touches an end of the piece may go on in the next one, so the first and the
    last suffix give an interval for each of their prefixes.
    """
    out: dict[tuple[int, ...], int] = {}
    stack: list[list[int]] = []

    def close(upto: int, s: tuple[int, ...]) -> None:
        carried = 0
        while stack and stack[-1][0] > upto:
            length, books = stack.pop()
            carried += books
            out[s[:length]] = carried
        if carried and upto:
            if stack and stack[-1][0] == upto:
                stack[-1][1] += carried
            else:
                stack.append([upto, carried])

    common = [_common(a[0], b[0]) for a, b in zip(array, array[1:], strict=False)]
    for i, (s, n) in enumerate(array):
        if i:
            close(common[i - 1], array[i - 1][0])
        if stack and stack[-1][0] == len(s):
            stack[-1][1] += n
        else:
            stack.append([len(s), n])
    if array:
        close(0, array[-1][0])
        for rows, gaps in ((array, common), (array[::-1], common[::-1])):
            edge = rows[0][0]
            held = [0] * (len(edge) + 1)
            k = len(edge)
            for i, (_, n) in enumerate(rows):
                k = min(k, gaps[i - 1]) if i else k
                if not k:
                    break
                held[k] += n
            total = 0
            for k in range(len(edge), 0, -1):
                total += held[k]
                out[edge[:k]] = total
    return out


def _common(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return k


def _piece(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Intervals of the sorted rows of one partition, batch by batch: a batch is a piece of the array like a partition."""
    for pdf in batches:
        for source, part in pdf.groupby("source", sort=False):
            got = intervals([(tuple(int(x) for x in s), int(n)) for s, n in zip(part["s"], part["n"], strict=True)])
            yield pd.DataFrame({"source": pd.Series([source] * len(got), dtype=object), "keys": pd.Series([np.array(k, dtype=np.int64) for k in got], dtype=object), "n": pd.Series(list(got.values()), dtype="int64")})


def suffix_blocks(suffixes: DataFrame) -> DataFrame:
    """(source, keys, n_docs): blocks of lines repeated in enough books; a written table.

    suffixes: (source, n_books, doc_id, s array<bigint>). Identical suffixes of a source are one row with their
    number of books; the rows are sorted by range (a source or a first line that very many books share is split
    among tasks like any other), each piece gives its common-prefix intervals with their books, and intervals of
    one prefix are added up. A book with a block twice counts twice in that sum, so the books of the blocks left,
    few, are counted exactly in the end.
    """
    suffixes = suffixes.distinct()
    array = suffixes.groupBy("source", "s").agg(F.count("*").alias("n")).repartitionByRange("source", "s").sortWithinPartitions("source", "s")
    least = suffixes.groupBy("source").agg(F.max("n_books").alias("n_books"))
    found = array.mapInPandas(_piece, _INTERVAL).groupBy("source", "keys").agg(F.sum("n").alias("n")).join(least, "source")
    found = small(written(found.where(F.col("n") >= _enough("n_books")).select("source", "keys")))
    prefix = suffixes.select("source", "n_books", "doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.slice("s", F.lit(1), i))).alias("keys"))
    exact = prefix.join(found, ["source", "keys"], "left_semi").distinct().groupBy("source", "keys").agg(F.count("*").alias("n_docs"), F.max("n_books").alias("n_books"))
    exact = written(exact.where(F.col("n_docs") >= _enough("n_books")).drop("n_books"))
    # a block that always goes on alike is given by its longer form; an edge of a piece gave both
    longer = exact.where(F.size("keys") > 1).select("source", F.slice("keys", F.lit(1), F.size("keys") - 1).alias("keys"), "n_docs")
    return written(exact.join(longer, ["source", "keys", "n_docs"], "left_anti").select("source", "keys", "n_docs"))


def suffixes(rec: DataFrame) -> DataFrame:
    """(source, n_books, doc_id, s): from each candidate line on, the keys of the candidate lines that follow each other, LONGEST at most.

    Lines follow each other within a block, and from a block's last line to the first one of the next block. A
    book's blocks are put in order by chunks, so a very long book is many tasks.
    """
    at = F.floor(F.coalesce(F.col("ord"), F.lit(0)) / CHUNK)
    r = rec.select("source", "n_books", "doc_id", "ord", "block_id", "i", "m", "key").distinct()
    r = r.withColumn("own", at).withColumn("chunk", F.explode(F.when((F.col("ord") % CHUNK < LONGEST) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))))
    w = W.partitionBy("doc_id", "chunk").orderBy("ord", "block_id", "i")
    p = lambda c: F.lag(c).over(w)
    follows = (p("block_id") == F.col("block_id")) & (p("i") == F.col("i") - 1) | (p("ord") == F.col("ord") - 1) & (p("i") == p("m") - 1) & (F.col("i") == 0)
    r = r.withColumn("run", F.coalesce(follows, F.lit(False))).withColumn("run", F.sum((~F.col("run")).cast("long")).over(w))
    ahead = F.collect_list(F.struct("run", "key")).over(w.rowsBetween(0, LONGEST - 1))
    return r.withColumn("s", ahead).where(F.col("own") == F.col("chunk")).select("source", "n_books", "doc_id", F.transform(F.filter("s", lambda x: x["run"] == F.col("run")), lambda x: x["key"]).alias("s"))


def repeated(blocks: DataFrame, doc_meta: DataFrame, book_meta: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines to remove: doc_id, block_id, line_no, source, key, form; repeated blocks: source, keys, n_docs).

    Books without a source are left out; null texts have no lines; a block delivered twice gives its lines once.
    A line is removed if a repeated block of the suffix array holds it.
    """
    lines = normal_lines(blocks, written(books(doc_meta, book_meta, blocks)))
    rec = candidates(lines)
    found = suffix_blocks(written(suffixes(rec)))
    hit = small(written(found.select("source", F.explode("keys").alias("key")).distinct()))
    return rec.join(hit, ["source", "key"], "left_semi").select("doc_id", "block_id", "line_no", "source", "key", "form").distinct(), found


def removed(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, block_id, kind, clean_text, n_removed) of the blocks, once each, without their repeated lines."""
    gone = lines.groupBy("doc_id", "block_id").agg(F.collect_set("line_no").alias("gone"))
    b = latest(blocks.select("doc_id", "block_id", "kind", "text", "ingested_at"), ["doc_id", "block_id"]).drop("ingested_at")
    j = b.join(gone, ["doc_id", "block_id"], "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("gone", i + 1))
    return j.select("doc_id", "block_id", "kind", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
