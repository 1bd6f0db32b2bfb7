from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm import confusables as C

SAME = [("Hеft", "Heft"), ("ｄｉｅ", "die"), ("caf\u0065\u0301", "café"), ("a\u200bb\ufeff", "ab"), ("a\u2009b", "a b"), ("stratiﬁ", "stratifi"), ("⼩鸟", "小鸟"), ("ﾊﾟﾝ", "パン"), ("力レンダー", "カレンダー"), ("слoво", "слово"), ("lantern‑shelf", "lantern-shelf"), ("，", ","), ("сосо is here", "coco is here")]
OTHER = [("e", "é"), ("a.", "a?"), ("3", "③"), ("x2", "x²"), ("the", "THE"), ("a", "ab"), ("3", "6"), ("-", "–")]


def test_same_and_other():
    for a, b in SAME:
        assert C.consistent_form(a)[0] == C.consistent_form(b)[0], (a, b)
    for a, b in OTHER:
        assert C.consistent_form(a)[0] != C.consistent_form(b)[0], (a, b)


def test_counts_and_edges():
    assert C.consistent_form("Das Hеft ist neu") == ("Das Heft ist neu", 1, 0)
    assert C.consistent_form("Das сосо ist neu") == ("Das coco ist neu", 0, 1)
    assert C.consistent_form(None) == (None, 0, 0) and C.consistent_form("") == ("", 0, 0)
    assert C.consistent_form("熱力学")[0] == "熱力学" and C.consistent_form("слово снег")[0] == "слово снег"


LETTERS = st.text(st.sampled_from("aceopxтдбж家力カkm 1." + "".join(C.SHAPES["Cyrl"][:8])), max_size=30)


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.randoms(use_true_random=False))
def test_spelling_of_look_alikes_does_not_matter(text, rng):
    def respelled(c):
        form = C.ALTERNATIVES.get(c)
        return rng.choice(list(form.values())) if form else c

    other = "".join(map(respelled, text))
    assert C.consistent_form(text)[0] == C.consistent_form(other)[0]
    assert C.consistent_form(C.consistent_form(text)[0])[0] == C.consistent_form(text)[0]


def test_patches(spark):
    b = spark.createDataFrame([(1, "x", "Das Heft"), (1, "x", "Das Heft"), (1, "y", None), (2, "x", "小鸟，")], "doc_id long, block_id string, text string")
    p = spark.createDataFrame(
        [(1, "p1", "x", "Das Hеft"), (1, "p1", "x", "Das Hеft"), (1, "p2", "x", "Das Heft"), (1, "p3", "x", "Das Haft"), (1, "p4", "gone", "Das Hеft"), (1, "p5", "y", "a"), (1, "p6", "x", None), (2, "p1", "x", "⼩鸟,")],
        "doc_id long, patch_id string, target_block_id string, before_text string",
    )
    assert {tuple(r) for r in C.look_alike_patches(p, b).collect()} == {(1, "p1"), (2, "p1")}
    assert C.look_alike_patches(p.where("false"), b).count() == 0


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "ｘ", "old"), (2, None, "old")], "id long, text string, consistent string")
    got = {r.id: (r.consistent, r.consistent_mixed) for r in C.with_consistent_form(df, "text").collect()}
    assert got == {1: ("x", 0), 2: (None, 0)}
