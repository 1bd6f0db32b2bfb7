import numpy as np
import pytest

from quirespark.llm import levels as L

EASY = ["the cat sees the dog", "the boy has a red ball", "we go home now", "she likes the warm soup", "the bird is small"]
HARD = ["the epistemological framework presupposes an axiomatic formulation", "institutional equilibria recapitulate administrative contingencies", "phenomenological reductions destabilise jurisprudential commitments", "the thermodynamic hypothesis substantiates longitudinal investigations"]


def text(rng, level):
    pick = {0: lambda: EASY, 1: lambda: EASY if rng.random() < 0.5 else HARD, 2: lambda: HARD}[level]
    return ". ".join(pick()[int(rng.integers(0, 4))] for _ in range(24)) + "."


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 260)
    return [text(rng, int(k)) for k in y], y


def test_held_out_accuracy(sample):
    x, y = sample
    noisy = y[:160].astype(float)
    noisy[::12] = 1.0
    m = L.fit(x[:160], noisy, np.ones(160))
    b = L.Batch(x[160:])
    assert (m.bands(b.scores(m)) == y[160:]).mean() > 0.9
    p, h = m.chances(np.sort(b.scores(m)))
    assert (np.diff(p) >= 0).all() and (np.diff(h) >= 0).all() and (h <= p).all()


def test_isotonic_is_least_squares():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=40), rng.normal(size=40), rng.random(40) + 0.1
    at, upto, v = L.isotonic(x, y, w)
    fit = v[np.searchsorted(at, np.sort(x), side="right") - 1]
    assert (np.diff(v) > 0).all() and len(fit) == 40 and (at <= upto).all() and (upto[:-1] <= at[1:]).all()
    # block means equal the weighted means of what they pool
    order = np.argsort(x)
    for k in np.unique(fit):
        i = order[fit == k]
        assert abs(k - np.average(y[i], weights=w[i])) < 1e-9


def test_scores_are_the_matrix_products(sample):
    x, y = sample
    m = L.fit(x[:40], y[:40].astype(float), np.ones(40))
    b = L.Batch([*x[:5], "", "短い文。", "Тихий двор."])
    assert np.allclose(b.scores(m), b.matrix() @ np.concatenate([m.syntax, m.vocabulary]), atol=1e-3)


def test_tables(spark, sample):
    x, y = sample
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(x)] + [(900, None), (901, ""), (902, "Short."), (903, "山" * 200)], "doc_id long, text string")
    marks = [(i, L.BANDS[k]) for i, k in enumerate(y[:120].tolist()) for _ in range(2)] + [(3, None), (4, "unknown"), (999, "easy")]
    got = {r.doc_id: r for r in L.levels(docs, spark.createDataFrame(marks, "doc_id long, band string")).collect()}
    assert len(got) == len(x) + 4 and not got[900].long_enough and not got[902].long_enough and got[903].long_enough
    assert np.mean([got[i].band == L.BANDS[k] for i, k in enumerate(y.tolist()) if i >= 120]) > 0.85
    assert L.levels(docs.where("false"), spark.createDataFrame(marks, "doc_id long, band string")).count() == 0
    none = L.levels(docs, spark.createDataFrame([], "doc_id long, band string"))
    assert none.count() == len(got)
