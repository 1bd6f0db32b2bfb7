from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.operators import markdown as M

PIECES = st.sampled_from(["# T", "##", "text", "more text", "", " ", "- item", "  cont", "1. one", "```py", "```", "~~~", "$$", "$$x$$", "\\[", "\\]", "| a |", "[^1]: n", "![i](x.png)", "<!-- page 3 -->", "<!-- open", "-->", "---", "* * *", "    code", "\tcode", "> q", "　", "\x0b", " "])
ENDS = st.sampled_from(["\n", "\r\n", "\r", "\n\n", ""])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, ENDS), max_size=14))
def test_blocks_give_the_text_back(parts):
    md = "".join(a + b for a, b in parts)
    p = M.parse(md)
    assert p["prefix"] + "".join(b["text"] + b["trailer"] for b in p["blocks"]) == md
    at = len(p["prefix"])
    for b in p["blocks"]:
        assert b["start"] == at and b["text"].strip()
        at += len(b["text"]) + len(b["trailer"])


def kinds(md):
    return [b["kind"] for b in M.parse(md)["blocks"]]


def test_kinds():
    assert kinds("# A\ntext\n- x\n  y\n\n```\n# no\n```\n| a |\n|---|\n") == ["heading", "text", "list_item", "code", "table"]
    assert kinds("$$\nx\n\ny\n$$\nz") == ["equation", "text"] and kinds("$$\nx\n\ny") == ["text", "text"]
    assert kinds("[^1]: a\n  b\n![i](x)\n---\n<!-- page 3 -->\n    c") == ["footnote", "image", "unknown", "unknown", "code"]
    b = M.parse("### T\n<!-- page 12 -->\n<!-- page 4-5 -->")["blocks"]
    assert b[0]["level"] == 3 and (b[1]["role"], b[1]["page_mark"]) == ("page_marker", 12) and b[2]["role"] == "html_comment"
    assert M.parse(None) is None and M.parse("")["blocks"] == [] and M.parse(" \n")["prefix"] == " \n"


def test_tables(spark):
    docs = spark.createDataFrame([(1, "# A\n\n<!-- page 2 -->\ntext\n"), (2, None), (3, ""), (4, "x\n" * 20000)], "doc_id int, text string")
    assert all(r.same and r.tiles for r in M.roundtrip(docs.where("text is not null")).collect())
    p = M.parsed(docs)
    b = {(r.doc_id, r.ord): r for r in M.blocks_of(p).collect()}
    assert b[(1, 2)].page_idx == 1 and b[(1, 0)].page_idx is None and b[(1, 0)].block_id == "book#m0"
    assert {r.doc_id: r.text for r in M.rendered(p).collect()} == {1: "# A\n\n<!-- page 2 -->\ntext\n", 2: None, 3: "", 4: "x\n" * 20000}
    back = M.render_blocks(M.blocks_of(p), p.select("doc_id", "prefix"))
    assert {r.doc_id: r.text for r in back.collect()} == {1: "# A\n\n<!-- page 2 -->\ntext\n", 4: "x\n" * 20000}
