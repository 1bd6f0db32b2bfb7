import pytest
from pyspark.sql import functions as F

from quirespark.operators import rules as R


def blocks(spark, *docs):
    rows = [(d, f"b{i}", i, *b) for d, bs in enumerate(docs) for i, b in enumerate(bs)]
    return spark.createDataFrame(rows, "doc_id int, block_id string, ord int, kind string, level int, text string, trailer string, page_idx int")


def b(text, kind="text", level=None, trailer="\n\n", page=0):
    return (kind, level, text, trailer, page)


def h(text, level, trailer="\n\n", page=0):
    return b("#" * level + (" " + text if text else ""), "heading", level, trailer, page)


def after(df):
    return {(r.doc_id, r.block_id): (r.operation, r.after_text) for r in df.collect()}


def test_page_numbers(spark):
    df = blocks(spark, [b("Ein Satz.\n12\nweiter."), b("第 7 页"), b("1984"), b("3", "code"), b("<!-- page 3 -->", "unknown"), b(None), b("")])
    assert after(R.page_numbers(df)) == {(0, "b0"): ("replace_text", "Ein Satz.\nweiter."), (0, "b1"): ("delete_block", None)}
    assert R.page_numbers(df.where("false")).count() == 0


def test_running_heads(spark):
    df = blocks(spark, [b("资本论 · 第一章\n正文一。\n正文三。"), b("正文二。\n资本论 · 第一章\n正文四。"), b("资本论 · 第一章"), b("zweimal"), b("zweimal"), b("起来\n起来\n起来")], [b("资本论 · 第一章")])
    assert {(r.doc_id, r["head"], r.n) for r in R.repeated_heads(df).collect()} == {(0, "资本论 · 第一章", 3)}
    assert after(R.running_heads(df)) == {(0, "b0"): ("replace_text", "正文一。\n正文三。"), (0, "b1"): ("replace_text", "正文二。\n正文四。"), (0, "b2"): ("delete_block", None)}


def test_white_space(spark):
    df = blocks(spark, [b("a  \nb   \nc\t", trailer="\n\n\n\n"), b("x   ", "code")])
    assert after(R.trailing_spaces(df)) == {(0, "b0"): ("replace_text", "a  \nb\nc")}
    assert [r.after_trailer for r in R.blank_lines(df).collect()] == ["\n\n"]


def clamp(levels):
    out = []
    for x in levels:
        out.append(min(x, out[-1] + 1) if out else x)
    return out


def test_heading_levels(spark):
    import random

    rng = random.Random(2)
    docs = [[h(f"t{i}", x) for i, x in enumerate(rng.choices(range(1, 7), k=rng.randint(1, 9)))] for _ in range(40)]
    df = blocks(spark, *docs)
    base = {r.doc_id: r.base for r in R.base_level(df).collect()}
    got = {}
    for r in R.heading_levels(df).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append(r.new_level)
    for d, bs in enumerate(docs):
        levels = [x[1] for x in bs]
        assert got[d] == clamp([max(1, x - ((base[d] or 1) - 1)) for x in levels]), (levels, base[d])


def test_base_level(spark):
    df = blocks(spark, [h("第一章 x", 2), h("第二章 y", 2), h("第一节 z", 3)], [h("第一部", 2), h("第二部", 2), h("第一章", 3), h("第二章", 3)], [h("x", 3)], [h("书名", 1), h("第一章", 2), h("第二章", 2)], [h("a", 2), h("b", 3)], [h("a", 2), h("b", 2), h("c", 2), h("d", 3), h("e", 3)])
    assert {r.doc_id: r.base for r in R.base_level(df).collect()} == {0: 2, 1: 2, 2: 3, 3: None, 4: None, 5: 2}


def test_heading_patches(spark):
    df = blocks(spark, [h("第一章", 2), h("第二章", 2), h("", 2), h("小节", 5)])
    assert after(R.heading_patches(df)) == {(0, "b0"): ("replace_text", "# 第一章"), (0, "b1"): ("replace_text", "# 第二章"), (0, "b2"): ("delete_block", None), (0, "b3"): ("replace_text", "## 小节")}


def test_duplicate_headings(spark):
    df = blocks(spark, [h("A", 2), h("A", 2), h("A", 2), h("A", 2)], [h("A", 2), b("x"), h("A", 2)], [h("A", 1), h("A", 2)], [h("A", 2, "\n\n\n"), h("A", 2)])
    assert set(after(R.duplicate_headings(df))) == {(0, "b1"), (0, "b3")}


def test_verse_and_joined_lines(spark):
    full = "一二三四五六七八九十一二三四五六七八九十"
    df = blocks(spark, [b("白日依山尽\n黄河入海流\n欲穷千里目"), b(full + "\n下一半。"), b(full + "。\n下一段。"), b(full + "\n- 列表"), b("Ein langer Satz der am Rand des Blattes\nweitergeht."), b(full + "  \n下一半。")])
    assert after(R.verse_breaks(df)) == {(0, "b0"): ("replace_text", "白日依山尽  \n黄河入海流  \n欲穷千里目")}
    assert after(R.join_lines(df)) == {(0, "b1"): ("replace_text", full + "下一半。"), (0, "b4"): ("replace_text", "Ein langer Satz der am Rand des Blattes weitergeht.")}


def test_joins_across_blocks(spark):
    full = "一二三四五六七八九十一二三四五六七八九十"
    df = blocks(spark, [b(full), b("下一半的句子到这里才算真正结束了。"), b(full, trailer="\n\n\n"), b("隔了两行的句子到这里才算真正结束。")])
    assert [(r.block_id, r.next_id, r.status) for r in R.joins_across_blocks(df).collect()] == [("b0", "b1", "suggested")]
    linked = spark.createDataFrame([(0, 1)], "doc_id int, ord int")
    assert R.joins_across_blocks(df, linked).collect()[0].status == "proposed"


def test_spaces(spark):
    df = blocks(spark, [b("数字 42 之间，这里 用 API 接口。"), b("使用 Py Mu PDF 库，很好。"), b("The API Doc SDK is new"), b("`代 码`")])
    assert after(R.cjk_spaces(df))[(0, "b0")][1] == "数字42之间，这里用 API 接口。"
    assert (0, "b3") not in after(R.cjk_spaces(df))
    assert after(R.ocr_spaces(df)) == {(0, "b1"): ("replace_text", "使用 PyMuPDF 库，很好。")}


def test_front_matter(spark):
    df = blocks(spark, [h("Das Haus", 1), b("Anna Tor"), b("Verlag"), h("第一章", 2, page=1), b("Es war einmal.", page=1)], [h("Das Haus", 1), b("Es war einmal ein Haus、"), h("第一章", 2, page=1), b("Text。", page=1)])
    t = spark.createDataFrame([(0, "das haus"), (1, "Das Haus"), (2, None)], "doc_id int, title string")
    assert set(after(R.front_matter(df, t))) == {(0, "b0"), (0, "b1"), (0, "b2")}


def test_rules_settle(spark):
    df = blocks(spark, [b("Ein Satz.\n12\nweiter."), b("a   \nb")])
    done = {k: v[1] for k, v in (after(R.page_numbers(df)) | after(R.trailing_spaces(df))).items()}
    again = df.select("doc_id", "block_id", "ord", "kind", "level", F.coalesce(*[F.when(F.col("block_id") == k[1], v) for k, v in done.items()], "text").alias("text"), "trailer", "page_idx")
    assert R.page_numbers(again).count() == 0 and R.trailing_spaces(again).count() == 0
    assert R.propose(df, disabled=("page_numbers", "trailing_spaces")).where("rule_id = 'page_numbers'").count() == 0
    assert R.propose(df, disabled=("trailing_spaces",)).where("rule_id = 'trailing_spaces'").count() == 1


def test_every_rule_proposes(spark, monkeypatch):
    full = "一二三四五六七八九十一二三四五六七八九十"
    book = [h("Das Haus", 1, page=0), h("第一章", 2, page=1), h("第一章", 2, page=1), b("Ein Satz.   \n12\nweiter.", page=1, trailer="\n\n\n\n"), b("资本论 · 第一章\n正文一。\n正文三。", page=1), b("正文二。\n资本论 · 第一章\n正文四。", page=1), b("资本论 · 第一章", page=1), h("", 2, page=1), b("这里 用 Py Mu PDF 库，很好。", page=1), b(full + "\n下一半。", page=1)]
    df = blocks(spark, book)
    t = spark.createDataFrame([(0, "Das Haus")], "doc_id int, title string")
    got = R.propose(df, t).collect()
    assert {r.rule_id for r in got} == {r for r, _, _ in R.POLICY}
    assert [(r.block_id, r.step, r.operation, r.after_trailer) for r in got if r.rule_id == "blank_lines"] == [("b3", 4, "replace_text", "\n\n")]
    # the rule of title pages runs without titles too
    fields = blocks(spark, [b("Anna Tor"), b("Verlag"), h("第一章", 2, page=1), b("Es war einmal.", page=1)])
    assert {r.block_id for r in R.propose(fields).where("rule_id = 'front_matter'").collect()} == {r.block_id for r in R.front_matter(fields, t).collect()}
    monkeypatch.setattr(R, "POLICY", (*R.POLICY, ("new_rule", "derived", True)))
    with pytest.raises(ValueError):
        R.propose(df, t)


def test_rules_follow_each_other(spark):
    full = "一二三四五六七八九十一二三四五六七八九十"
    df = blocks(
        spark,
        [b(full + "\n12\n下一半。"), b("7"), b("白日依山尽   \n黄河入海流")],
        [h("卷首", 3), b("3", trailer="\n\n"), h("卷首", 3), b("a\n5\nb", trailer="\n\n\n\n")],
    )
    got = {(r.doc_id, r.block_id, r.rule_id): (r.operation, r.after_text) for r in R.propose(df).collect()}
    # a page number inside a broken paragraph goes first, then its two halves are one line
    assert got[0, "b0", "page_numbers"] == ("replace_text", full + "\n下一半。") and got[0, "b0", "join_lines"] == ("replace_text", full + "下一半。")
    # trailing spaces go before verse gets its breaks
    assert got[0, "b2", "trailing_spaces"] == ("replace_text", "白日依山尽\n黄河入海流") and got[0, "b2", "join_lines"] == ("replace_text", "白日依山尽  \n黄河入海流")
    # a deleted block has no more patches, and its neighbours meet
    assert [k[2] for k in got if k[:2] == (0, "b1")] == ["page_numbers"]
    assert got[1, "b1", "page_numbers"] == ("delete_block", None) and got[1, "b2", "dup_headings"] == ("delete_block", None)
    # a patch of the trailer carries the text that the rules before it left
    assert got[1, "b3", "blank_lines"] == ("replace_text", "a\nb")
    assert {r.rule_id for r in R.propose(df, disabled=tuple(r for r, _, _ in R.POLICY)).collect()} == {"blank_lines", "trailing_spaces"}


def test_missing_images(spark):
    refs = spark.createDataFrame([(1, "images/a.png"), (1, "b.png"), (1, "http://x/c.png"), (1, "/abs.png")], "doc_id int, image string")
    files = spark.createDataFrame([(1, "a.png")], "doc_id int, image string")
    assert [r.image for r in R.missing_images(refs, files).collect()] == ["b.png"] and R.missing_images(refs, None).count() == 0
