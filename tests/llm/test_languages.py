from datetime import datetime

import numpy as np
import pytest

from quirespark.llm import languages as G

TEXTS = {
    "en": "The old house stands near the river. In the morning the children walk to the school.",
    "de": "Das alte Haus steht am Fluss. Am Morgen gehen die Kinder zur Schule.",
    "fr": "La vieille maison se trouve près de la rivière. Le matin les enfants vont à l'école.",
    "es": "La casa vieja está cerca del río. Por la mañana los niños van a la escuela.",
    "pt": "A casa velha fica perto do rio. De manhã as crianças vão para a escola.",
    "ru": "Старый дом стоит у реки. Утром дети идут в школу.",
    "zh": "老房子在河边。早上孩子们去学校。",
    "ja": "古い家は川のそばにある。朝、子どもたちは学校へ行く。",
    "ko": "오래된 집은 강가에 있다. 아침에 아이들은 학교에 간다.",
}


@pytest.fixture(scope="module")
def model():
    return G.fit([t for t in TEXTS.values() for _ in range(30)], [k for k in TEXTS for _ in range(30)])


def test_labels():
    assert G.label(" DEUTSCH ") == "de" and G.label("zh_Hans") == "zh" and G.label("pt-BR") == "pt" and G.label("中文") == "zh"
    assert G.label(None) is None and G.label("und") is None and G.label("") is None and G.label("it") is None


def test_codewords_are_far_apart():
    m = G.codewords()
    assert m.shape == (9, G.BITS)
    assert min((m[i] != m[j]).sum() for i in range(9) for j in range(i)) >= 5


def test_each_language_and_flags(model):
    for k, t in TEXTS.items():
        lang, conf, unsure = model.one(t)
        assert lang == k and conf > 0.8 and not unsure
    assert model.one("12 — !")[0] is None
    assert model.one("")[2]


def test_sentences_are_parted(model):
    letters, full, conf = G.score_blocks(model, [TEXTS["en"] + " " + TEXTS["zh"], "Am 3. Tag gehen die Kinder zur Schule.", ""])
    assert full[0] == ["en", "zh"] and full[1] == ["de"] and full[2] == []
    assert letters[2].sum() == 0 and conf[2] == 0
    assert len(G.Sentences(["Am 3. Tag gehen wir."]).letters) == 1


def test_scores_equal_plain_sums(model):
    s = G.Sentences(["Ab c.", "Дом"])
    got = s.scores(model.weights, chunk=2)
    want = s.scores(model.weights)
    assert np.allclose(got, want)


def _tables(spark, rows, books):
    b = spark.createDataFrame([(d, f"b{i}", "text", t) for i, (d, t) in enumerate(rows)], "doc_id long, block_id string, kind string, text string")
    m = spark.createDataFrame(books, "doc_id long, title string, lang string")
    return b, m


def test_cases(spark):
    rows = [(i * 10 + j, TEXTS[k]) for i, k in enumerate(TEXTS) for j in range(3) for _ in range(4)]
    rows += [(0, TEXTS["ru"]), (1, None), (1, ""), (2, "(Mentioned: " + "Das alte Haus steht. Am Fluss." + ")")]
    books = [(i * 10 + j, "Das alte Haus steht am Fluss" if (i, j) == (0, 1) else None, {0: k, 1: k.upper(), 2: "xx"}[j]) for i, k in enumerate(TEXTS) for j in range(3)]
    b, m = _tables(spark, rows, books)
    got = {tuple(r) for r in G.cases(b.union(b), m).collect()}
    assert {(i * 10 + 2, "", k) for i, k in enumerate(TEXTS)} <= got
    assert (1, "title", "de") in got and not any(d in (0, 1) and x == "" for d, x, _ in got)
    assert sum(x[0] == 0 and x[2] == "ru" for x in got) == 1
    assert len(got) == len(set(got))


def test_recall_by_class(spark):
    """Planted in every language: labels, titles, passages; a block with a passage names every language it holds."""
    langs = list(TEXTS)
    rows, books, want = [], [], set()
    for i, k in enumerate(langs):
        other = langs[(i + 1) % len(langs)]
        third = langs[(i + 4) % len(langs)]
        rows += [(i, TEXTS[k])] * 5
        books.append((i, G.SEEDS[other].split(". ")[0].split("。")[0].split("，")[0], None if i % 2 else langs[i - 1]))
        for j in range(100, 400, 100):
            rows += [(i + j, TEXTS[k])] * 5
            books.append((i + j, None, k))
        want |= {(i, "", k), (i, "title", other)}
        at = len(rows)
        rows += [(i, TEXTS[k] + "\n" + TEXTS[other]), (i, TEXTS[third]), (i, TEXTS[other] + " " + TEXTS[third] + " " + TEXTS[k])]
        want |= {(i, f"b{at}", k), (i, f"b{at}", other), (i, f"b{at + 1}", third)} | {(i, f"b{at + 2}", x) for x in (k, other, third)}
    got = {tuple(r) for r in G.cases(*_tables(spark, rows, books)).collect()}
    assert got == want


def test_broken_lines_are_one_sentence(model):
    assert G.score_blocks(model, ["Das alte Haus steht am\nFluss, und die Kin-\n  der gehen zur Schu¬\nle."])[1] == [["de"]]


def test_empty(spark):
    b, m = _tables(spark, [], [])
    assert G.cases(b, m).count() == 0
