from collections import Counter
from datetime import datetime
from itertools import product

import pytest

from quirespark.llm import boilerplate as B

DAY = datetime(2024, 1, 1)


def test_forms():
    assert B.words("★ Stand: 03.05.2023, ＡＢＣ! ".replace("ＡＢＣ", "abc")) == "stand 0 abc"
    assert B.normal_line("Mehr zu DIE MILCH: hier", ["die milch"]) == "mehr zu § hier"
    assert B.normal_line("请把《小猫与鸟》分享", ["小猫与鸟"]) == "请把 § 分享"
    assert B.normal_line("— 12 —", []) == "" and B.normal_line("", []) == ""


def _books(spark, texts, source="Site.example "):
    blocks = [(d, f"b{i}", "text", t, DAY) for d, ts in texts.items() for i, t in enumerate(ts)]
    b = spark.createDataFrame(blocks, "doc_id long, block_id string, kind string, text string, ingested_at timestamp")
    m = spark.createDataFrame([(d, source if d % 2 else source.strip().upper(), DAY) for d in texts], "doc_id long, source string, ingested_at timestamp")
    return b, m


@pytest.fixture(scope="module")
def found(spark):
    texts = {d: [f"All rights reserved by site.example\nPrepared for the site by Nam{chr(97 + d)} Sur{chr(97 + d)}, reader", " ".join(chr(97 + d) * k for k in range(3, 9)), None] for d in range(10)}
    texts[0].append("Fetched 12 times")
    texts[1].append("* FETCHED 99 times *")
    texts[2].append("Fetched ３ times!")
    b, m = _books(spark, texts)
    b = b.union(b.where("doc_id = 4"))
    lines, blocks = B.repeated(b, m)
    return b, {tuple(r[:3]) for r in lines.collect()}, blocks.collect()


def test_lines(found):
    _, lines, _ = found
    assert {(d, "b0", n) for d in range(10) for n in (1, 2)} == lines  # three books with 'fetched' are too few


def test_multi_line_blocks(found):
    _, _, blocks = found
    assert sorted((len(r["keys"]), r["n_docs"]) for r in blocks) == [(1, 10), (2, 10)]


def test_removed(found, spark):
    b, lines, _ = found
    df = spark.createDataFrame(sorted(lines), "doc_id long, block_id string, line_no int")
    got = {(r.doc_id, r.block_id): (r.clean_text, r.n_removed) for r in B.removed(b, df).collect()}
    assert got[(4, "b0")] == ("", 2) and got[(4, "b1")][1] == 0 and got[(4, "b2")] == (None, 0) and len(got) == 33


RUNS = {d: [(1, 2, 3), (2, 3)] if d < 6 else [(2, 3, 1), (4, 2, 3)] for d in range(12)}


def _prefixes():
    subs = {}
    for d, rs in RUNS.items():
        for r in rs:
            for i, j in product(range(len(r)), range(len(r))):
                if i <= j:
                    subs.setdefault(r[i : j + 1], set()).add(d)
    return subs


def test_suffix_blocks_equal_brute_force(spark):
    rows = [("s", 12, d, list(r[i:])) for d, rs in RUNS.items() for r in rs for i in range(len(r))]
    df = spark.createDataFrame(rows, "source string, n_books long, doc_id long, s array<bigint>")
    got = {tuple(r["keys"]): r["n_docs"] for r in B.suffix_blocks(df.repartition(3)).collect()}
    want = {k: len(v) for k, v in _prefixes().items() if len(v) >= 4}
    # blocks that always go on alike are given by the longer one
    assert got == {k: n for k, n in want.items() if not any(g[:-1] == k and want[g] == n for g in want)}


def test_intervals_of_pieces_add_up():
    """However the array is cut, the sums are those of counting every prefix."""
    array = sorted(Counter(r[i:] for rs in RUNS.values() for r in rs for i in range(len(r))).items())
    want = Counter()
    for s, n in array:
        for k in range(1, len(s) + 1):
            want[s[:k]] += n
    for cuts in ((), (1,), (2, 3), tuple(range(1, len(array)))):
        got = Counter()
        for a, b in zip((0, *cuts), (*cuts, len(array)), strict=True):
            got.update(B.intervals(array[a:b]))
        assert got and all(want[k] == n for k, n in got.items())
        # what is not given has a longer form with as many
        assert all(k in got or any(g[: len(k)] == k and got[g] == n for g in got) for k, n in want.items())
    assert B.intervals([]) == {}


def test_views_share_what_surrounds_a_name():
    names = ("Li", "Kern", "Anna Kern", "Anna Maria von der Kern")
    for before, after in (("edited with great care by", ""), ("", "read every single page"), ("checked for the site by", "in may"), ("by", "who read it all for you")):
        norms = [" ".join(f"{before} {n.lower()} {after}".split()) for n in names]
        got = [set(B.views("s", n)) for n in norms if len(n) <= 2 * len(f"{before}{after}")]
        assert len(got) > 1 and all(a & b for a in got for b in got)
        assert not set(B.views("other", norms[0])) & got[0]


def test_blocks_across_rows_and_no_other_rows(spark):
    """A block of two lines in two table rows is one; without the suffix array nothing would be removed."""
    blocks = [(d, f"b{o}", o, "text", t, DAY) for d in range(8) for o, t in enumerate(["own " + chr(97 + d) * 5, "Shared first line", "Shared second line"])]
    b = spark.createDataFrame(blocks, "doc_id long, block_id string, ord int, kind string, text string, ingested_at timestamp")
    m = spark.createDataFrame([(d, "s", DAY) for d in range(8)], "doc_id long, source string, ingested_at timestamp")
    lines, found = B.repeated(b, m)
    assert sorted(len(r["keys"]) for r in found.collect()) == [1, 2]
    assert {tuple(r[:2]) for r in lines.collect()} == {(d, x) for d in range(8) for x in ("b1", "b2")}


def test_small_sources_and_nulls(spark):
    b, m = _books(spark, {1: ["same line here"], 2: ["same line here"], 3: ["same line here"]})
    assert B.repeated(b, m)[0].count() == 0
    b, m = _books(spark, {d: ["same line here"] for d in range(6)})
    assert B.repeated(b, m.selectExpr("doc_id", "cast(null as string) source", "ingested_at"))[0].count() == 0
    assert B.repeated(b.where("false"), m)[0].count() == 0


def test_names_of_any_length(spark):
    # two books for each number of words of the name; the line as a whole stands in all ten
    texts = {d: ["Edited with great care by " + " ".join(chr(97 + d) * 3 + chr(110 + k) for k in range(d // 2 + 1)), f"Redakteurin {chr(97 + d) * 3}" + (f" {chr(97 + d) * 4}" if d % 2 else ""), " ".join(chr(97 + d) * k for k in range(3, 9))] for d in range(10)}
    b, m = _books(spark, texts)
    lines, _ = B.repeated(b, m)
    assert {tuple(r[:3]) for r in lines.collect()} == {(d, x, 1) for d in range(10) for x in ("b0", "b1")}
