"""Line predicates on a table of lines, and the same predicates in the JVM and in Python on random ones."""

import random

from pyspark.sql import functions as F

from quirespark.functions import scalars as S
from quirespark.functions import text as X

#: Lines by what holds for them: s begins a block, c catalogue entry, v line of verse, h may be a running head, p page number, k keeps its break.
LINES = {
    "": ["返回第3页。", "", "   ", "\u3000", "床前明月光。", "A line with [brackets]", "Er sagte \"ja\"", "  ", "a" * 41],
    "cvk": ["1984", "第一章 失踪与疯癫/35", "第五章……204", "第一章 绪论 35"],
    "cvpk": ["12", " 7 ", "１２"],
    "h": ["一" * 19, "一" * 20],
    "p": ["— 9 —"],
    "s": ["12.", "# Titel", "## ", "- eins", "1. eins", "12) zwei", "123. drei", "| a |", "```py", "<!-- page 4-5 ocr -->", "<!-- page 12 -->", "<!-- note -->", "+ x"],
    "sp": ["- 12 -"],
    "svk": ["> Zitat", "> 床前明月光", ">> 疑是地上霜"],
    "vhk": ["1234. vier", "本书共 12 章,合计 320", "床前明月光", "资本论 · 第一章", "ends with hard break  ", "trailing   ", "x \t", "人民出版社出版 新華書店发行"],
    "vhpk": ["第 7 页", "第8页"],
    "vk": ["① 同上", "⑳ x", "12345", "①②", "*"],
}

TRAILING = {"trailing   ": "trailing", "x \t": "x", "hard break  ": "hard break  ", "  ": "  ", "   ": "", "a": "a", "": ""}


def _flags(spark, lines):
    c = F.col("line")
    t = X.strip(c)
    found = {"s": X.is_block_start(t), "c": X.is_catalog_entry(c), "v": X.is_verse_line(c), "h": X.is_running_head_candidate(t), "p": X.is_page_number(c), "k": X.keeps_break(c)}
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    return [r.f for r in df.select("i", F.concat(*[F.when(v, k).otherwise("") for k, v in found.items()]).alias("f")).orderBy("i").collect()]


def test_predicates(spark):
    lines = [(t, flags) for flags, ts in LINES.items() for t in ts]
    assert dict(zip([t for t, _ in lines], _flags(spark, [t for t, _ in lines]), strict=True)) == dict(lines)


def test_same_in_python(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("ab 12.。#>-·…/第页①\u3000\t[]") for _ in range(rng.randint(0, 12))) for _ in range(400)] + [t for ts in LINES.values() for t in ts]
    for t, flags in zip(lines, _flags(spark, lines), strict=True):
        assert (X.Plain.block_start(t.strip()), X.Plain.keeps_break(t)) == ("s" in flags, "k" in flags), repr(t)


def test_trailing(spark):
    df = spark.createDataFrame([(t,) for t in TRAILING], "t string")
    assert {r.t: r.n for r in df.select("t", X.strip_trailing(F.col("t")).alias("n")).collect()} == TRAILING


def test_scalars(spark):
    texts = ["Das ist ein langer deutscher Satz.", "これはとてもながいにほんごのぶんしょうです。", "이것은 매우 긴 한국어 문장입니다 그리고 더 길어집니다", "这是一个很长很长的中文句子没有别的东西在里面", "12", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.g for r in df.select("i", S.language_guess(F.col("t")).alias("g")).orderBy("i").collect()] == ["en", "ja", "ko", "zh-CN", None, None, None]
    p = spark.createDataFrame([([0, 1, 2, 4, 6, 7],), ([],)], "p array<int>")
    assert [r.s for r in p.select(S.format_pages(F.col("p")).alias("s")).collect()] == ["1-3,5,7-8", ""]
    n = spark.createDataFrame([(0, 5), (10, 0), (302, 200), (200, 200), (None, 5)], "a int, b int")
    assert [r.s for r in n.select(S.shards(F.col("a"), F.col("b")).alias("s")).collect()] == [0, 1, 2, 1, 0]
    m = spark.createDataFrame([("![a](images/x.png) ![b](y/x.png)\n# T\n```\n# no\n```\n[^1]: n\n[^1]: m\nv  \n$a$ $$b$$\n<!-- page 3-4 ocr --><!-- page 2, 9 -->",)], "t string")
    r = m.select(S.image_names(F.col("t")).alias("i"), S.code_count(F.col("t")).alias("c"), S.footnote_defs(F.col("t")).alias("f"), S.hard_breaks(F.col("t")).alias("b"), S.math_count(F.col("t")).alias("m"), S.page_marks(F.col("t")).alias("p")).collect()[0]
    assert (r.i, r.c, r.f, r.b, r.m, r.p) == (["x.png"], 1, 1, 1, 2, [2, 3, 4, 9])
