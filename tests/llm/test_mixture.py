import numpy as np
import pytest

from quirespark.llm import mixture as M


def test_tree_is_exact():
    c = np.array([5, 0, 17, 1])
    leaf = M.split_tree(c, 7, 3)
    assert (leaf.sum(axis=0) == c).all() and (leaf >= 0).all()
    assert abs(leaf.sum(axis=1) - c.sum() / 7).max() < 2
    assert (M.split_tree(c, 7, 3) == leaf).all() and M.split_tree(c, 1).tolist() == [c.tolist()]


def test_subtrees_in_tasks_are_the_whole_tree(spark, monkeypatch):
    names, counts = ["a", "b", "c"], [50, 0, 170]
    for subtrees in (1, 4, 1024):
        monkeypatch.setattr(M, "SUBTREES", subtrees)
        leaf = np.zeros((23, 3), dtype=int)
        seen = {n: [] for n in names}
        for r in M.shard_cuts(spark, names, counts, 23, 3).collect():
            leaf[r.shard, names.index(r.source)] = r.hi - r.lo
            seen[r.source] += range(r.lo + 1, r.hi + 1)
        assert (leaf == M.split_tree(np.array(counts), 23, 3)).all()
        assert all(sorted(seen[n]) == list(range(1, c + 1)) for n, c in zip(names, counts, strict=True))


def test_quotas():
    t = {"a": (0.5, 1), "b": (0.25, 2), "c": (0.25, 9)}
    assert M.quotas({"a": 100, "b": 100, "c": 100}, t) == {"a": 100.0, "b": 50.0, "c": 50.0}
    assert M.quotas({"a": 100, "b": 10}, t)["b"] == 20.0 and M.quotas({}, t) == {}
    assert M.quotas({"a": 100, "b": 100, "c": 100}, t, 10_000) == {"a": 100, "b": 200, "c": 900}


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, f"word number {i} " * (3 + i % 5), ["A.example", "a.example ", "b.example", None, "x.example"][i % 5]) for i in range(200)] + [(900, None, "a.example"), (901, "  ", "a.example"), (902, "lone text", "c.example")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a.example", 0.3, 4), ("b.example", 0.6, 3), ("none.example", 0.1, 2)], "source string, target_share double, max_repeats int")
    return d, t


def test_shares_and_caps(tables, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 100)
    monkeypatch.setattr(M, "SHARD_TOKENS", 500)
    mix, shares = M.mixed(*tables)
    rows, s = mix.collect(), {r.source: r for r in shares.collect()}
    assert abs(s["a.example"].reached_share - 1 / 3) < 0.02 and abs(s["b.example"].reached_share - 2 / 3) < 0.02 and s["none.example"].reached_share == 0
    assert s["b.example"].most_uses == 3 and all(r.copy <= {"a.example": 4, "b.example": 3}[r.source] for r in rows)
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and sum(r.n_tokens for r in rows) == sum(x.used_tokens for x in s.values())
    for shard in {r.shard for r in rows}:
        assert sorted(r.pos for r in rows if r.shard == shard) == list(range(1, 1 + sum(r.shard == shard for r in rows)))
    assert len({r.shard for r in rows}) > 3


def test_more_than_there_is(tables):
    mix, shares = M.mixed(*tables, total=10**9)
    s = {r.source: r for r in shares.collect()}
    assert s["a.example"].used_tokens == 4 * s["a.example"].available_tokens and s["b.example"].most_uses == 3


def test_empty(tables):
    mix, shares = M.mixed(tables[0].where("false"), tables[1])
    assert mix.count() == 0 and all(r.used_tokens == 0 for r in shares.collect())


def test_sizes_are_the_tokenizers(tables):
    got = {r.doc_id: r.n_tokens for r in M.sized(*tables).collect()}
    assert got[0] == len(M.encoder().encode_ordinary("word number 0 " * 3))
