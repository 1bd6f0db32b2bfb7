import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quirespark.sources import epub, files, sinks
from quirespark.streaming import events as E


def test_decode():
    assert files.decode(b"\xef\xbb\xbfabc") == ("abc", "utf-8", None)
    assert files.decode("中文".encode("gb18030"))[1:] == ("gb18030", "decoded as gb18030")
    assert files.decode(b"\xff\xff\x00\xff")[2] == "undecodable" and files.decode(None)[2] == "missing" and files.decode(b"")[0] == ""


def test_files(spark, tmp_path):
    for name, data in {"a b.md": b"x\r\ny\rz", "sub/c.md": "中文".encode("gb18030"), "README.md": b"no", ".hidden/d.md": b"no", "node_modules/e.md": b"no", "f.txt": b"no", "g.pdf": b"%PDF"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    got = {r.stem: (r.text, r.encoding) for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert got == {"a b": ("x\ny\nz", "utf-8"), "c": ("中文", "gb18030")}
    assert sorted(os.path.basename(r.path) for r in files.list_inputs(spark, str(tmp_path)).collect()) == ["a%20b.md" if "%20" in files.list_inputs(spark, str(tmp_path)).where("path like '%a%b.md'").first().path else "a b.md", "c.md", "g.pdf"]


def test_items(spark):
    flat = [{"type": "text", "text": "a", "page_idx": 0}, {"label": "title", "content": "b", "page_idx": 1, "bbox": [1, 2, 3, 4]}]
    df = spark.createDataFrame([(1, json.dumps(flat)), (2, json.dumps([flat[:1], flat[1:]])), (3, json.dumps({"items": flat})), (4, "{broken"), (5, None), (6, "[]")], "doc_id int, json string")
    got = {}
    for r in files.parse_items(df).orderBy("doc_id", "item_no").collect():
        got.setdefault(r.doc_id, []).append((r.item_type, r.text, r.page_idx))
    assert got == {k: [("text", "a", 0), ("title", "b", 1)] for k in (1, 2, 3)}
    parts = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 5, 10), (1, "c", 10, 5), (2, "a", 3, 1)], "doc_id int, part string, offset int, pages int")
    assert {(r.doc_id, r.part) for r in files.collect_parts(parts).collect()} == {(1, "a"), (1, "c"), (2, "a")}
    box = spark.createDataFrame([([10.0, 20.0, 30.0, 40.0],), ([1.0],)], "b array<double>").select(files.normalized_bbox(F.col("b"), F.lit(100), F.lit(200)).alias("n")).collect()
    assert [r.n for r in box] == [[100.0, 100.0, 300.0, 200.0], None]


def test_written_blocks(spark, tmp_path):
    b = spark.createDataFrame([(1, "a", 0, "text", None, "x\n\"y\"", "\n", None), (1, "b", 1, "heading", 2, "## z", "", 3)], "doc_id long, block_id string, ord int, kind string, level int, text string, trailer string, page_idx int")
    sinks.write_blocks(b, str(tmp_path / "out"))
    assert sorted(map(tuple, sinks.read_blocks(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, b.collect()))
    b.withColumn("schema", F.lit(9)).write.json(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="unknown schema"):
        sinks.read_blocks(spark, str(tmp_path / "bad")).collect()
    d = spark.createDataFrame([("a\nb\n", "a\nc\n"), (None, "x")], "x string, y string").select(sinks.unified_diff("x", "y").alias("d")).collect()
    assert "-b" in d[0].d and "+c" in d[0].d and d[1].d is None
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    assert [r.doc_id for r in sinks.changed_only(old, spark.createDataFrame([(1, "a"), (2, "c")], "doc_id int, text string")).collect()] == [2]


XHTML = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><link rel="stylesheet" href="s.css"/></head><body>{}</body></html>'


def book(**change):
    e = {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>',
        "OEBPS/c.opf": '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:language>zh-CN</dc:language><dc:identifier>i</dc:identifier><dc:date>2024-01-02</dc:date></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="p" href="p%20q.png" media-type="image/png"/><item id="s" href="s.css" media-type="text/css"/></manifest><spine><itemref idref="a"/></spine></package>',
        "OEBPS/a.xhtml": XHTML.format('<h1 id="x">A</h1><p>text <a href="#x">l</a><br/></p><img src="p%20q.png"/>'),
        "OEBPS/nav.xhtml": XHTML.format('<nav epub:type="toc"><a href="a.xhtml#x">A</a></nav>'),
        "OEBPS/p q.png": "png", "OEBPS/s.css": "p {}",
    }
    e |= change
    return epub.pack([(k, v.encode()) for k, v in e.items() if v is not None])


def codes(**change):
    return {c for _, c, _ in epub.check(book(**{k: v for k, v in change.items()}))}


def test_sound_container():
    assert epub.check(book()) == []
    assert epub.stats(book()) | {} == {"documents": 1, "chars": 6, "headings": 1, "images": 1, "tables": 0, "math": 0, "links": 1, "breaks": 1, "code": 0, "footnotes": 0}


def test_broken_containers():
    opf = epub.zipfile.ZipFile(epub.io.BytesIO(book())).read("OEBPS/c.opf").decode()
    cases = {
        "container_missing": {"META-INF/container.xml": None}, "container_invalid": {"META-INF/container.xml": "<x"}, "opf_missing": {"OEBPS/c.opf": None}, "opf_invalid": {"OEBPS/c.opf": "<"}, "mimetype_wrong": {"mimetype": "x"},
        "title_missing": {"OEBPS/c.opf": opf.replace("<dc:title>T</dc:title>", "")}, "language_invalid": {"OEBPS/c.opf": opf.replace("zh-CN", "z_")}, "date_invalid": {"OEBPS/c.opf": opf.replace("2024-01-02", "gestern")},
        "manifest_missing": {"OEBPS/nav.xhtml": None}, "spine_broken": {"OEBPS/c.opf": opf.replace('idref="a"', 'idref="zz"')}, "spine_empty": {"OEBPS/c.opf": opf.replace('<itemref idref="a"/>', "")}, "xhtml_invalid": {"OEBPS/a.xhtml": "<html>"},
        "image_missing": {"OEBPS/a.xhtml": XHTML.format('x<img src="no.png"/>')}, "link_broken": {"OEBPS/a.xhtml": XHTML.format('x<a href="no.xhtml">y</a>')}, "anchor_missing": {"OEBPS/a.xhtml": XHTML.format('x<a href="#no">y</a>')},
        "toc_link_broken": {"OEBPS/nav.xhtml": XHTML.format('<nav epub:type="toc"><a href="no.xhtml">A</a></nav>')}, "toc_empty": {"OEBPS/nav.xhtml": XHTML.format('<nav epub:type="toc"/>')}, "nav_not_toc": {"OEBPS/nav.xhtml": XHTML.format("<nav/>")}, "css_missing": {"OEBPS/s.css": None}, "css_link_broken": {"OEBPS/a.xhtml": XHTML.replace("s.css", "t.css").format("x")}, "image_orphan": {"OEBPS/a.xhtml": XHTML.format("x")}, "empty_chapters": {"OEBPS/a.xhtml": XHTML.format("")},
        "mime_mismatch": {"OEBPS/c.opf": opf.replace("image/png", "image/jpeg")},
    }
    for code, change in cases.items():
        assert code in codes(**change), code
    bare = XHTML.replace('<link rel="stylesheet" href="s.css"/>', "")
    assert "css_unlinked" in codes(**{"OEBPS/a.xhtml": bare.format("x"), "OEBPS/nav.xhtml": bare.format('<nav epub:type="toc"><a href="a.xhtml">A</a></nav>')})
    assert {c for _, c, _ in epub.check(book(), math=True, footnotes=True, images=2)} == {"math_expected", "footnotes_expected", "images_expected"}
    assert {c for _, c, _ in epub.check(b"nope")} == {"archive_unreadable"} and {c for _, c, _ in epub.check(book()[:200])} == {"archive_unreadable"}


def test_container_tables(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    (tmp_path / "b.epub").write_bytes(b"junk")
    c = epub.read_containers(spark, str(tmp_path))
    assert [(os.path.basename(r.path), r.code) for r in epub.structural_issues(c).collect()] == [("b.epub", "archive_unreadable")]
    assert {os.path.basename(r.path): r.counters.get("documents") for r in epub.container_counters(c).collect()} == {"a.epub": 1, "b.epub": 0}


RUN = [
    {"event": "hello", "task": "a", "ts": 0}, {"event": "stage", "name": "detect", "state": "start", "task": "a", "ts": 1}, {"event": "stage", "name": "detect", "state": "done", "task": "a", "ts": 2}, {"event": "shards", "total": 4, "task": "a", "ts": 3},
    {"event": "stage", "name": "extract", "state": "start", "task": "a", "ts": 4}, {"event": "progress", "stage": "extract", "current": 2, "total": 4, "task": "a", "ts": 5}, {"event": "progress", "stage": "extract", "current": 900, "total": 4000, "task": "a", "ts": 6}, {"event": "warning", "task": "a", "ts": 7},
    {"event": "retry", "attempt": 1, "task": "b", "ts": 1}, {"event": "error", "code": "network", "task": "b", "ts": 2}, {"event": "skip", "task": "c", "ts": 1}, {"event": "stage", "name": "clean", "state": "start", "task": "d", "ts": 1}, {"event": "complete", "task": "d", "ts": 2},
]
WANT = {"a": ("running", 0.35, 2, 4, 1), "b": ("failed", 0.0, 0, 0, 0), "c": ("skipped", 1.0, 0, 0, 0), "d": ("complete", 1.0, 0, 0, 0)}


def view(rows):
    return {r.task: (r.status, r.progress, r.shard, r.shards, r.warnings) for r in rows}


def test_event_fold(spark):
    text = [json.dumps(e) for e in RUN] + ["", "no json", "[1]", '{"x": 1}', '"event"', None]
    e = E.parse(spark.createDataFrame([(t,) for t in text], "value string"))
    assert e.count() == len(RUN) and view(E.fold(e).collect()) == WANT
    assert E.fold(e.where("false")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", []
    src.mkdir()
    for i, part in enumerate((RUN[:5], RUN[5:])):
        (src / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = E.fold_stream(E.parse(spark.readStream.option("maxFilesPerTrigger", 1).text(str(src))))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in out:
        last[r.task] = r
    assert view(last.values()) == WANT and len(out) == 5


def test_idle_state_is_dropped(spark, tmp_path):
    src, out = tmp_path / "in", []
    src.mkdir()

    def put(i, rows):
        (tmp_path / "part").write_text("\n".join(map(json.dumps, rows)))
        os.rename(tmp_path / "part", src / f"{i}.json")

    put(0, RUN[:5])
    stream = E.fold_stream(E.parse(spark.readStream.text(str(src))), idle_ms=1)
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(240):
            p = q.lastProgress
            if out and p and p["stateOperators"] and p["stateOperators"][0]["numRowsTotal"] == 0:
                break
            time.sleep(0.25)
        assert out and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        q.stop()


def test_rescaled_and_windows(spark):
    r = spark.range(1).select(*[c.alias(n) for n, c in zip("ab", E.rescaled(F.lit(2), F.lit(3), F.lit(1), F.lit(2)), strict=True)]).collect()[0]
    assert (r.a, r.b) == (1500, 3000)
    e = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 01:10:00", "y", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert {(r.event_type, r.n, r.total) for r in E.windowed(e).collect()} == {("x", 2, 3.0), ("y", 1, 3.0)}
