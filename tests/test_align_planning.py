from datetime import datetime

from pyspark.sql import functions as F

from quirespark.operators import align as A
from quirespark.operators import planning as P
from quirespark.operators import structure as ST

DAY = datetime(2024, 1, 1)
LONG = "Dies ist ein langer Absatz mit vielen Wörtern"


def blocks(spark, rows):
    return spark.createDataFrame([(1, f"b{i}", i, *r) for i, r in enumerate(rows)], "doc_id int, block_id string, ord int, kind string, text string, page_idx int")


def markers(spark, rows):
    return spark.createDataFrame([(1, i, *r, DAY) for i, r in enumerate(rows)], "doc_id int, item_no int, item_type string, text string, page_idx int, text_level int, ingested_at timestamp")


def pick(rows):
    """The pick block by block: equal anchors before beginnings, then the first evidence beyond the cursor."""
    out, cursor = [], -1
    for o in sorted({o for o, _, _ in rows}):
        ahead = sorted((t, e) for x, e, t in rows if x == o and e > cursor)
        if ahead:
            out.append((o, ahead[0][1], ahead[0][0]))
            cursor = ahead[0][1]
    return out


def test_pick_monotone(spark):
    import random

    rng = random.Random(5)
    docs = {0: [(0, 3, 1), (0, 5, 1), (1, 2, 1), (1, 4, 2), (1, 6, 1), (2, 1, 1), (3, 7, 2)]} | {d: [(rng.randint(0, 6), rng.randint(0, 9), rng.randint(1, 2)) for _ in range(rng.randint(1, 15))] for d in range(1, 40)}
    df = spark.createDataFrame([(d, *x) for d, xs in docs.items() for x in xs], "doc_id long, ord int, ev_ord int, tier int")
    got = {}
    for r in A.links(df).collect():
        got.setdefault(r.doc_id, []).append((r.ord, r.ev_ord, r.tier))
    assert {d: sorted(x) for d, x in got.items()} == {d: pick(xs) for d, xs in docs.items()}
    assert A.links(df.where("false")).count() == 0


def test_links(spark):
    b = blocks(spark, [("text", LONG, None), ("heading", "## Haus", None), ("text", "kurz", None), ("text", LONG[:20] + " anders weiter", None), ("text", None, None)])
    m = markers(spark, [("text", LONG, 2, None), ("title", "Haus", 2, 1), ("text", "kurz", 3, None), ("text", LONG[:20] + " noch etwas", 3, None), ("page_break", "x", 3, None), ("text", None, None, None)])
    e = A.evidence(m)
    c = A.candidates(b, e)
    assert {(r.ord, r.ev_ord, r.tier) for r in c.collect()} == {(0, 0, 1), (1, 1, 1), (0, 3, 2), (3, 0, 2), (3, 3, 2)}
    linked = A.links(c)
    assert {(r.ord, r.ev_ord) for r in linked.collect()} == {(0, 0), (1, 1), (3, 3)}
    assert {(r.ord, r.ev_ord) for r in A.short_links(b, e, linked).collect()} == {(2, 2)}
    assert A.candidates(b.where("false"), e).count() == 0


def test_pages(spark):
    b = blocks(spark, [("text", "a", 0), ("text", "b", None), ("text", "c", 0), ("text", "d", None), ("text", "e", 3), ("text", "f", 1)])
    assert [r.filled_page for r in A.filled_pages(b).orderBy("ord").collect()] == [0, 0, 0, None, 3, 1]
    assert [(r.block_id, r.reached) for r in A.page_regressions(b).collect()] == [("b5", 3)]
    meta = spark.createDataFrame([(1, 6), (2, 2), (3, None), (4, 0)], "doc_id int, total_pages int")
    e = A.evidence(markers(spark, [("text", "x", 2, None), ("page_number", "5", 4, None)]))
    assert {(r.doc_id, r.page, r.state) for r in A.page_gaps(meta, b, e).collect()} == {(1, 3, "unattributed"), (1, 5, "no_text"), (1, 6, "blank"), (2, 1, "unavailable"), (2, 2, "unavailable")}
    r = A.attribution(b).collect()[0]
    assert (r.required, r.attributed, r.coverage) == (6, 4, 0.666667)
    d = spark.createDataFrame([(1, "vor\n<!-- page 3 -->\na\n\n<!-- page 4 ocr -->\nb"), (2, None), (3, "")], "doc_id int, text string")
    assert {(r.doc_id, r.line_no, r.page) for r in A.page_of_lines(d).collect()} == {(1, 1, None), (1, 3, 3), (1, 6, 4)}


def test_detection_and_plan(spark):
    good, bad = 100, 0
    docs = {1: [(good, bad)] * 3, 2: [(0, 0)] * 2, 3: [(100, 0)] * 3 + [(0, 0)] * 2 + [(100, 0)] * 3, 4: [(100, 0)] * 3 + [(0, 90)] * 2, 5: [(0, 90)] * 2}
    p = spark.createDataFrame([(d, i, *x) for d, xs in docs.items() for i, x in enumerate(xs)], "doc_id int, page_idx int, valid long, bad long")
    t = P.document_types(p)
    assert {r.doc_id: (r.type, r.total, r.text_pages, r.suspicious) for r in t.collect()} == {1: ("text", 3, 3, 0), 2: ("scanned", 2, 0, 0), 3: ("hybrid", 8, 6, 0), 4: ("hybrid", 5, 3, 2), 5: ("scanned", 2, 0, 2)}
    plan = P.plan(t, "cloud", per_task=1)
    assert {r.doc_id: (r.kind, r.backend, r.ocr_pages, r.shards) for r in plan.collect()}[3] == ("pdf-hybrid", "hybrid(cloud)", 2, 2)
    assert {r.backend for r in P.plan(t, override="local").collect()} == {"local"} and P.plan_totals(plan).collect()[0].ocr_pages == 8
    m = markers(spark, [("text", "a" * 60, 0, None), ("text", "㐀㐁", 0, None), ("text", None, 1, None)])
    assert {(r.page_idx, r.valid, r.bad) for r in P.page_texts(m).collect()} == {(0, 60, 2), (1, 0, 0)}


def test_runs_and_buckets(spark):
    p = spark.createDataFrame([(1, x) for x in (0, 1, 2, 4, 5, 9, 9, 11, 13)] + [(2, 3)], "doc_id int, page_idx int")
    r = P.runs(p)
    assert {(x.doc_id, x.run, x.first, x.last, x.n) for x in r.collect()} == {(1, 0, 0, 2, 3), (1, 1, 4, 5, 2), (1, 2, 9, 9, 1), (1, 3, 11, 11, 1), (1, 4, 13, 13, 1), (2, 0, 3, 3, 1)}
    for limit in (1, 2, 3, 4, 8):
        got = sorted((x.bucket, x.runs) for x in P.buckets(r, limit).where("doc_id = 1").collect())
        n = 5
        want = [(i, 1) for i in range(n)] if n <= limit else [(i, (i + 1) * n // limit - i * n // limit) for i in range(limit)]
        assert got == want, limit
    meta = spark.createDataFrame([(1, 302), (2, 200), (3, None)], "doc_id int, total_pages int")
    assert {(x.doc_id, x.first_page, x.last_page) for x in P.page_ranges(meta).collect()} == {(1, 1, 200), (1, 201, 302), (2, 1, 200)}
    c = spark.createDataFrame([(0.7, 500, 1, 9, True), (0.1, 60, 1, 9, True), (0.0, 50, 0, 3, False), (0.0, 50, 0, 3, True), (0.0, 2, 0, 1, False)], "s double, c int, i int, b int, p boolean")
    assert [x.k for x in c.select(P.cover_kind(*map(F.col, "scibp")).alias("k")).collect()] == ["image", "image_text", "text", None, None]


def test_structure(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["目录", "第一章/1", "", "第二章……15", "第三章 32", "正文。", "a/1", "b/2", "第一章/7"])], "doc_id int, line_no int, line string")
    assert {(r.title, r.page) for r in ST.toc_entries(lines).collect()} == {("第一章", 1), ("第二章", 15), ("第三章", 32), ("a", 1), ("b", 2)}
    e = A.evidence(markers(spark, [("header", "ＢＵＣＨ 1", i, None) for i in range(3)] + [("title", "Das Haus", 2, 1), ("text", "buch-1", 3, None)]))
    assert [(r.key, r.pages) for r in ST.heads_by_page(e).collect()] == [("buch1", 4)]
    b = blocks(spark, [("text", "das haus", None), ("heading", "# Buch 1", None), ("text", "sonst", None)])
    assert {(r.block_id, r.action) for r in ST.proposed_headings(b, e).collect()} == {("b0", "promote"), ("b1", "demote")}
    m = ST.missing_headings(b, A.evidence(markers(spark, [("title", "Neu", 2, 1), ("text", "x", 2, None), ("title", "das Haus", 3, 1), ("title", "Ende", 9, 1)])), spark.createDataFrame([(1, 2, 1)], "doc_id int, ord int, ev_ord int"))
    assert [tuple(r) for r in m.collect()] == [(1, 2, "Neu")]
