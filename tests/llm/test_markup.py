from quirespark.llm import markup as M


def test_marginals_equal_enumeration():
    from itertools import product

    model = M.trained()
    for text in ("<b>a</b> **c** &amp;", "<TABLE><TR><TD>x<TD>3</TABLE>", "a $5, $6 b `c`"):
        nodes = M.parse(text)
        at = {id(n): i for i, n in enumerate(nodes)}
        total, ones = 0.0, [0.0] * len(nodes)
        for ys in product((0, 1), repeat=len(nodes) - 1):
            y = (0, *ys)
            p = 1.0
            for i, n in enumerate(nodes[1:], 1):
                p *= model._step(n, y[at[id(n.parent)]])[y[i]] * model._emit(n)[y[i]]
            total += p
            for i, v in enumerate(y):
                ones[i] += p * v
        for got, want in zip(model.marginals(nodes), (o / total for o in ones), strict=True):
            assert abs(got - want) < 1e-9


def test_notations():
    cases = {
        "<b>das Haus</b> alt": ["html"], "a &amp;quot;b&amp;quot;": ["html"], "**x y** z": ["markdown"], "Haus\n------------\nalt": ["markdown"], "a\n- b\n- c": ["markdown"],
        "== Haus ==\ntext": ["wiki"], "a<ref name=\"n\">b</ref>": ["wiki"], "#eins\n#zwei": ["wiki"], "\\emph{x} y": ["latex"], "a $x_{1}^2 \\le 3$ b": ["latex"], "``a'' b": ["latex"], "a \\% b": ["latex"],
    }
    for text, want in cases.items():
        assert M.notations(text, "text") == want, text


def test_author_signs_are_no_residue():
    for text in ("$15, $30. Haus", "(9 < 12, 18 > 9)", "Haus <Gavath> alt", "C:\\scan\\new35", "* * *", "- 18 -", "= 57 =", "~53 km, ^53", "[48] a {49; 50}", "draft_page_24", "4 * 5 * 6", "ende.* neu", "", None):
        assert M.notations(text, "text") == [], text


def test_own_notation_and_kinds():
    assert M.notations("## Haus", "heading") == [] and M.notations("- Haus", "list_item") == [] and M.notations("[^3]: Haus", "footnote") == []
    assert M.notations("- **Haus**", "list_item") == ["markdown"] and M.notations("$x$", "equation") == [] and M.notations("<b>x</b>", "code") == []


def test_clean_keeps_structure():
    assert M.clean("<h2>Haus</h2>\nalt <b>x</b>", "text").startswith("## Haus")
    assert M.clean("=== Haus ===\nalt", "text") == "### Haus\nalt"
    assert M.clean("a\n#b\n##c", "text") == "a\n- b\n  - c"
    assert M.clean("a `code` and $x_1^2$", "text") == "a `code` and $x_1^2$"
    assert M.clean("[[Haus|alt]] {{note|x|p=3}}", "text") == "alt x"
    assert M.clean("\\emph{x} \\% y", "text") == "x % y"
    assert M.clean(None, "text") is None and M.clean("", "text") == ""
    assert M.clean("# <em>x</em>", "heading") == "# x"


def test_table(spark):
    rows = [(1, "a", "text", "<b>x</b> **y**"), (1, "a", "text", "<b>x</b> **y**"), (1, "c", None, "`x`"), (2, "d", "text", None), (2, "e", "code", "<b>"), (3, "f", "text", "plain. " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, block_id string, kind string, text string")
    assert {tuple(r) for r in M.residue_rows(df).collect()} == {(1, "a", "html"), (1, "a", "markdown"), (1, "c", "markdown")}
    assert M.residue_rows(df.where("false")).count() == 0
    got = {(r.doc_id, r.block_id): r.clean_text for r in M.cleaned(df).collect()}
    assert got[(1, "a")] == "x y" and got[(2, "d")] is None and len(got) == 5


def test_forms_never_seen():
    got = M.held_out()
    assert all(got[k] >= 0.8 for k in M.NOTATIONS) and got[""] >= 0.6, got


def test_long_constructs():
    long = "a very long text " * 60
    assert M.notations(f"x $$ y = {'z + ' * 300} 1 $$", "text") == ["latex"]
    assert M.notations(f"see **{long.strip()}** there", "text") == ["markdown"] and M.notations(f"see [{long.strip()}](w/x.y)", "text") == ["markdown"]
    assert M.notations(f"see {{{{note|{long}}}}}", "text") == ["wiki"] and M.notations(f'<span title="{long}">x</span>', "text") == ["html"]
