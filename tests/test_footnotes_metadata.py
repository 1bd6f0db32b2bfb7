from datetime import datetime

from pyspark.sql import functions as F

from quirespark.operators import footnotes as N
from quirespark.operators import metadata as M
from quirespark.operators import quality as Q


def lines(spark, rows):
    return spark.createDataFrame([(1, i + 1, t, p) for i, (t, p) in enumerate(rows)], "doc_id int, line_no int, line string, page int")


def test_footnotes(spark):
    df = lines(spark, [("Erst① dann② so", 1), ("① Note A", 1), ("② Note B", 2), ("```", 2), ("kein①", 2), ("```", 2), ("Noch①", 2), ("① Note C", 2), ("③ allein", 3)])
    r, n = N.references(df), N.notes(df)
    assert {(x.line_no, x.at, x.marker) for x in r.collect()} == {(1, 0, "①"), (1, 1, "②"), (7, 0, "①")}
    assert {(x.marker, x.body) for x in n.collect()} == {("①", "Note A"), ("②", "Note B"), ("①", "Note C"), ("③", "allein")}
    m = N.match(r, n)
    assert {(x.marker, x.ref_line, x.note_line, x.confidence) for x in m.collect()} == {("①", 1, 2, "high"), ("①", 7, 8, "high"), ("②", 1, 3, "medium")}
    out = {x.line_no: x.line for x in N.rewritten(df, m).collect()}
    assert out[1] == "Erst[^1] dann[^2] so" and out[2] == "[^1]: Note A" and out[7] == "Noch[^3]" and out[9] == "③ allein" and out[5] == "kein①"
    assert N.match(r.where("false"), n).count() == 0


def test_groups_off_page_are_refused(spark):
    df = lines(spark, [("a①", 1), ("① x", 5), ("b②", 2), ("c②", 3), ("② y", 3)])
    r, n = N.references(df), N.notes(df)
    assert N.match(r, n).count() == 0
    assert [(x.ref_line, x.note_line, x.confidence) for x in N.match_rest(r, n).collect()] == [(4, 5, "high")]


def test_pair_rest():
    assert N.pair_rest([1, 1, 2], [1, 2, 3]) == [(2, 1, "high")]
    assert N.pair_rest([1], [2, 2]) == [(0, 0, "medium")] and N.pair_rest([1], [None]) == [] and N.pair_rest([], [1]) == []


def one(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in cols.items()]).collect()


def test_names(spark):
    c = F.col("s")
    rows = [("扫描0001",), ("IMG_2043",), ("0001",), ("x",), ("Das Haus",), ("新建 DOC 文档",), ("新建 我的书 文档",), (None,), ("Microsoft Word - a.doc",)]
    assert [r.j for r in one(spark, rows, "s string", j=M.is_junk_name(c))] == [True, True, True, True, False, True, False, True, False]
    assert [r.j for r in one(spark, rows[-1:], "s string", j=M.is_junk_title(c))] == [True]
    t, a = M.title_author(c)
    got = one(spark, [("Das  Haus - Anna Tor",), ("x - y",), ("Das Haus",), ("A-B",)], "s string", t=t, a=a)
    assert [(r.t, r.a) for r in got] == [("Das Haus", "Anna Tor"), ("x - y", None), ("Das Haus", None), ("A-B", None)]
    assert [r.p for r in one(spark, [("庞德 著",), ("  Anna ",)], "s string", p=M.person(c))] == ["庞德", "Anna"]
    got = one(spark, [(' a b:c?"d" ',), ("...",), ("x. ",)], "s string", w=M.work_name(c), o=M.output_name(c))
    assert [(r.w, r.o) for r in got] == [("a_b_c_d_", "a b_c_d_"), ("...", "book"), ("x.", "x")]
    text = "> 书名：共和国  作者：柏拉图 ISBN:978\n- 译者: 郭斌和\n出版社：商务。"
    got = one(spark, [(text,)], "s string", **{k: M.front_field(c, k) for k in M.FIELDS})[0]
    assert (got.title, got.author, got.translator, got.publisher) == ("共和国", "柏拉图", "郭斌和", None)
    assert [r.h for r in one(spark, [("# 前言\n## 第一章 x\n# Das Haus #\n",), ("kein",)], "s string", h=M.first_heading(c))] == ["Das Haus", None]


def test_same_title(spark):
    rows = [("巴勒斯坦问题", "巴勒斯坦问题：一部历史", True), ("中国", "中国哲学史", False), ("Das  Haus!", "das haus", True), ("Die alte Stadt", "Die alte Stad", True), ("Haus", "Garten", False), (None, "x", False), ("", "", False)]
    df = spark.createDataFrame(rows, "a string, b string, w boolean")
    assert [r.g for r in df.select(M.same_title(F.col("a"), F.col("b")).alias("g")).collect()] == [r[2] for r in rows]


def test_precedence(spark):
    rows = [("Das Haus", "P", "F", "H"), ("扫描1", "Echt", "F", "H"), ("扫描1", "untitled", "Vorne", "H"), ("扫描1", None, None, "Kopf eins"), ("扫描1", None, None, "前言"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "stem string, pdf_title string, front_title string, heading string")
    assert [(r.title, r.title_source) for r in M.resolved(df).collect()] == [("Das Haus", "filename"), ("Echt", "pdf"), ("Vorne", "front_matter"), ("Kopf eins", "heading"), ("扫描1", "filename"), ("未命名", "filename")]


def test_catalogues(spark):
    s = spark.createDataFrame([(1, "A b"), (2, "a_b"), (3, "c"), (3, "c")], "id int, stem string")
    assert {(r.kind, r.name, r.n) for r in M.name_conflicts(s).collect()} == {("work", "a_b", 2)}
    t = datetime
    e = spark.createDataFrame([("C:\\X\\a", "_x", t(2024, 1, 2), t(2024, 1, 1)), ("c:/x/A", "Titel", t(2024, 1, 1), t(2024, 1, 3))], "path string, title string, mtime timestamp, added_at timestamp")
    r = M.catalogue(e).collect()[0]
    assert (r.path_key, r.title, r.mtime, r.added_at) == ("c:/x/a", "Titel", t(2024, 1, 2), t(2024, 1, 1))
    a = spark.createDataFrame([("a", t(2024, 1, 2)), ("b", t(2024, 1, 1)), ("n", t(2024, 1, 1))], "path_key string, mtime timestamp")
    b = spark.createDataFrame([("a", t(2024, 1, 1)), ("b", t(2024, 1, 1)), ("g", t(2024, 1, 1))], "path_key string, mtime timestamp")
    assert {(r.path_key, r.state) for r in M.synced(a, b).collect()} == {("a", "changed"), ("b", "same"), ("n", "new"), ("g", "gone")}
    f = spark.createDataFrame([(1, 0, "a.png", "x"), (1, 1, "a.png", "x"), (1, 2, "a.png", "y")], "doc_id int, part int, name string, hash string")
    assert {(r.part, r.new_name) for r in M.parts_by_content(f).collect()} == {(0, "a.png"), (1, "a.png"), (2, "p2_a.png")}


def test_quality(spark):
    md = "# a\n# b\n# c\n# d\n# e\n![x](i/x.png) $a$ [l](u)\n| a |\n|---|---|\n```\nc\n```\n[^1]: n\nzeile  \nzeile " + "wort " * 100
    docs = spark.createDataFrame([(1, md), (2, md), (3, md), (4, "")], "doc_id int, text string")
    lost = spark.createDataFrame([(1, md), (2, "# a\nwort")], "doc_id int, text string")
    issues = Q.content_issues(Q.counters(docs), Q.counters(lost))
    got = {(r.doc_id, r.code.removeprefix("content_"), r.level) for r in issues.collect()}
    assert got == {(3, "target_unreadable", "error"), (4, "target_unreadable", "error")} | {(2, c, "error") for c in ("images_lost", "math_lost", "text_shrunk", "code_lost", "tables_lost", "footnotes_lost")} | {(2, c, "warning") for c in ("headings_lost", "breaks_lost", "links_lost")}
    assert {r.doc_id: (r.errors, r.warnings, r.fatal) for r in Q.summary(issues).collect()}[2] == (6, 3, True)
    links = spark.createDataFrame([(1, "a%20b.html#x"), (1, "c.html"), (1, "http://x"), (1, "#top")], "doc_id int, href string")
    there = spark.createDataFrame([(1, "a b.html")], "doc_id int, path string")
    assert [r.href for r in Q.broken_links(links, there).collect()] == ["c.html"]
    t = spark.createDataFrame([("done", 1.5), ("done", 2.0), ("failed", 1.0)], "status string, elapsed double")
    assert {(r.status, r.n, r.seconds) for r in Q.batch_summary(t).collect()} == {("done", 2, 3.5), ("failed", 1, 1.0)}
