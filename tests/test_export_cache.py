from pyspark.sql import functions as F

from quirespark.operators import cache as C
from quirespark.operators import export as E


def out(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.o for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_segments_give_the_text_back(spark):
    texts = ["a <b>c</b> `x` $y$ $$z$$ \\[w\\] \\( < $ ` \\", "```\n<br>\n```\n<br>", "", "<", "é小`", "$5 und $6\n$7"]
    assert out(spark, lambda c: F.array_join(E.segments(c), ""), *texts) == texts


def test_math_tags(spark):
    got = out(spark, E.math_tags, r"$$\int x \tag{1}$$ \tag{2}", r"\[ a \tag*{ * } \]", "```\n$\\tag{3}$\n```", None)
    assert got == [r"$$\int x \qquad{(1)}$$ \tag{2}", r"\[ a \qquad{*} \]", "```\n$\\tag{3}$\n```", None]


def test_void_tags(spark):
    assert out(spark, E.void_tags, 'a<br>b<BR/><img src="x">', "```\n<br>\n```", "`<br>` <b>x</b>") == ['a<br />b<BR /><img src="x" />', "```\n<br>\n```", "`<br>` <b>x</b>"]


def test_pseudo_tags(spark):
    got = out(spark, E.pseudo_tags, "<repetitio est mater> <b>x</b> <i>offen", '<a href="u">l</a> <a bare>l</a>', "<http://x.y> <a@b.c> $a<b>c$ 1 < 2", "</u> <hr>")
    assert got == ["\\<repetitio est mater\\> <b>x</b> \\<i\\>offen", '<a href="u">l</a> \\<a bare\\>l</a>', "<http://x.y> <a@b.c> $a<b>c$ 1 < 2", "\\</u\\> <hr>"]


def test_lines_and_outline(spark):
    l = spark.createDataFrame([(1, 1, "ein Wort hier"), (1, 2, "# Wort hier"), (1, 3, "nichts"), (2, 1, "Wort hier"), (1, 4, " Das <u>Wo</u>rt  hier ")], "doc_id int, line_no int, line string")
    r = spark.createDataFrame([(1, "Wort hier"), (1, "ein")], "doc_id int, run string")
    assert {(x.doc_id, x.line_no): x.line for x in E.bold_lines(l, r).collect()} == {(1, 1): "**ein Wort hier**", (1, 2): "# Wort hier", (1, 3): "nichts", (2, 1): "Wort hier", (1, 4): "**Das <u>Wo</u>rt  hier**"}
    assert out(spark, E.heading_depth, "# a\n### b\n```\n##### c\n```", "x", "") == [3, 1, 1]
    assert out(spark, E.inferred_title, "x\n# T #\n", "\n  erste\nzweite", "", None) == ["T", "erste", None, None]


def test_cache(spark):
    cols = "backend string, part int, source_fp long, variant string, params_fp string"
    w = spark.createDataFrame([("m", 0, 1, None, "p"), ("m", 1, 1, None, "p"), ("m", 2, 1, "v2", "p"), ("m", 3, 1, None, None)], cols)
    s = spark.createDataFrame([("m", 0, 1, "original", None), ("m", 0, 1, None, "q"), ("m", 1, 1, None, "q"), ("m", 2, 1, None, "p"), ("x", 3, 1, None, None)], cols)
    assert {r.part: r.hit for r in C.hits(w, s).collect()} == {0: True, 1: False, 2: False, 3: False}
    assert sorted(r.part for r in C.missing(w, s).collect()) == [1, 2, 3] and C.missing(w, s.where("false")).count() == 4
    assert sorted((r.part, r.variant) for r in C.adopted(w.where("part < 2"), s.where("part > 0"), "new").collect()) == [(0, None), (1, None), (2, "new"), (3, "new")]
    p = spark.createDataFrame([("a", 0, "pending", 1), ("a", 0, "done", 2), ("a", 1, "done", 1), ("b", 0, "failed", 3), ("b", 1, "done", 1), ("c", 0, "pending", 1)], "task string, part int, state string, ts int")
    assert {r.task: r.status for r in C.outcome(p).collect()} == {"a": "done", "b": "failed", "c": "pending"}
    r = spark.range(1).select(C.preferred(F.lit(" "), F.lit(None), F.lit(" x ")).alias("p"), C.changed_options(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(3))).alias("c"), C.backoff_seconds(F.lit(3)).alias("b")).collect()[0]
    assert (r.p, r.c, r.b) == ("x", {"b": 2}, 8)
