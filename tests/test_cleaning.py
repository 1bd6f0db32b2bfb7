"""Whole documents through all rules: small texts with the exact result, each a fixed point."""

import pytest

from quirespark.operators import cleaning, rules

CASES = {
    "page numbers": ("前文在这里。\n\n12\n\n第 7 页\n\n— 9 —\n\n1984\n\n他在第3页停下。\n", "前文在这里。\n\n1984\n\n他在第3页停下。\n"),
    "running heads": ("河流志\n\n第一段话到此为止。\n\n河流志\n\n第二段话到此为止。\n\n河流志\n\n山谷记\n\n第三段话。\n\n山谷记\n", "第一段话到此为止。\n\n第二段话到此为止。\n\n山谷记\n\n第三段话。\n\n山谷记\n"),
    "duplicate headings": ("# 甲\n\n文。\n\n## 乙\n\n## 乙\n\n文。\n\n## 乙\n", "# 甲\n\n文。\n\n## 乙\n\n文。\n\n## 乙\n"),
    "levels": ("## 第一章 河\n\n### 水\n\n##\n\n##### 岸\n\n## 第二章 山\n", "# 第一章 河\n\n## 水\n\n### 岸\n\n# 第二章 山\n"),
    "spaces": ("数字 42 之间有 空格。\n\n中文 English 中文。\n\n见 (图) 与 <b>字</b> 体。\n\n代码 `a 1 字` 与 $x 字$ 留下 。\n", "数字42之间有空格。\n\n中文 English 中文。\n\n见(图)与<b>字</b>体。\n\n代码 `a 1 字` 与 $x 字$ 留下。\n"),
    "pieces": ("使用 Py Mu PDF 库。\n\n使用 API Doc SDK 库。\n\nHe was in a big red box.\n", "使用 PyMuPDF 库。\n\n使用 API Doc SDK 库。\n\nHe was in a big red box.\n"),
    "white space": ("一行字。   \n另一行字。\n\n\n\n\n末行。\t\n", "一行字。\n另一行字。\n\n末行。\n"),
    "broken lines": ("这一行文字排得很满一直写到页面右边才断开然后\n在下一行接着写完。\n", "这一行文字排得很满一直写到页面右边才断开然后在下一行接着写完。\n"),
    "verse": ("春天来了\n河水涨了\n小鸟唱了\n", "春天来了  \n河水涨了  \n小鸟唱了\n"),
    "code stays": ("```\n12\n\n\n\na 字 b   \n```\n", "```\n12\n\n\n\na 字 b   \n```\n"),
    "title page": ("# 河流与山谷\n\n李四 著\n\n某某书局\n\n## 第一章 河\n\n很久以前有一条河。\n\n## 第二章 山\n\n山在河的旁边。\n", "# 第一章 河\n\n很久以前有一条河。\n\n# 第二章 山\n\n山在河的旁边。\n"),
    "blank": ("  \n\n", ""),
    "front blanks": ("\n\n文。\n", "文。\n"),
}
TITLES = [(list(CASES).index("title page"), "河流与山谷")]


@pytest.fixture(scope="module")
def titles(spark):
    return spark.createDataFrame(TITLES, "doc_id long, title string")


def _run(spark, titles, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in cleaning.clean_documents(df, titles).collect()}


def test_cases_and_fixed_points(spark, titles):
    got = _run(spark, titles, [*(a for a, _ in CASES.values()), None])
    assert {n: got[i] for i, n in enumerate(CASES)} == {n: b for n, (_, b) in CASES.items()}
    assert got[len(CASES)] is None
    again = _run(spark, titles, [b for _, b in CASES.values()])
    assert {n: again[i] for i, n in enumerate(CASES)} == {n: b for n, (_, b) in CASES.items()}


def test_joins_across_pages_need_evidence(spark):
    md = "<!-- page 4 -->\n这一段话在页面的末尾被断开前半句写到这里就\n\n<!-- page 5 -->\n后半句在下一页接着写完。\n"
    df = spark.createDataFrame([(1, md)], "doc_id long, text string")
    assert cleaning.clean_documents(df).collect()[0].text == md
    linked = spark.createDataFrame([(1, "book#m3")], "doc_id long, block_id string")
    want = "<!-- page 4 -->\n这一段话在页面的末尾被断开前半句写到这里就后半句在下一页接着写完。\n\n<!-- page 5 -->\n"
    assert cleaning.clean_documents(df, linked=linked).collect()[0].text == want


def test_switched_off(spark):
    df = spark.createDataFrame([(1, "12\n\n数字 4 。\n")], "doc_id long, text string")
    off = tuple(r for r, _, _ in rules.POLICY)
    assert cleaning.clean_documents(df, disabled=off).collect()[0].text == "12\n\n数字 4 。\n"


def test_runs_of_blocks():
    def block(text, gap=0, linked=True, mark=False, atomic=False, trailer="\n\n"):
        return {"text": text, "gap": gap, "linked": linked, "mark": mark, "atomic": atomic, "trailer": trailer}

    long, more, end = "这一行文字排得很满一直写到页面右边才断开然后", "接着写下去这一行也排得很满一直写到右边才", "在这里写完这一句话。"
    # three pieces; the last trailer goes to the first block
    assert rules.join_run([block(long), block(more + more, 1), block(end, 1, trailer="\n")]) == [(long + more + more + end, "\n"), (None, "\n\n"), (None, "\n")]
    # code between them, no evidence, a field on a line of its own, a hard break, two blank lines counted as one
    assert rules.join_run([block(long), block("x", atomic=True), block(end, 1)])[2][0] == end
    assert rules.join_run([block(long), block(end, 1, linked=False)])[1][0] == end
    assert rules.join_run([block(long), block("某某书局", 1)])[1][0] == "某某书局"
    assert rules.join_run([block(long + "  "), block(end, 1)])[1][0] == end
    assert rules.join_run([block(long), block(end, 3)])[1][0] is None
    # through a page comment, which takes over the blank space
    assert rules.join_run([block(long), block("<!-- page 2 -->", mark=True, trailer="\n"), block(end, trailer="\n\n\n\n")]) == [(long + end, "\n\n"), ("<!-- page 2 -->", "\n\n"), (None, "\n\n\n\n")]
    assert rules.join_run([block(None), block("x")]) == [(None, "\n\n"), ("x", "\n\n")]
