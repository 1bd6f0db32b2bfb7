"""Problem 1: the language of each book, title and foreign passage, with a confidence.

Error-correcting output codes: every language has a codeword of BITS signs; one
binary n-gram classifier predicts each sign of a sentence (log-odds of hashed
1-, 2- and 3-grams of letters, averaged), and loss-weighted decoding picks the
codeword with the least total logistic loss. A small lead over the second
codeword flags the sentence as ambiguous. Sentences are scored in numpy, whole
batches at a time.
"""

from __future__ import annotations

import re
import unicodedata as U
from functools import lru_cache
from itertools import combinations
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, small, written
from .boilerplate import titles_of
from .confusables import FOLD, consistent_form

LANGS = ("en", "zh", "ja", "ko", "de", "fr", "es", "pt", "ru")
BITS = 15
#: Size of the hashed feature table (a power of two).
FEATURES = 1 << 15
#: Bound of the labelled sample that the classifiers are fitted on, in blocks.
MAX_TRAIN = 20_000
#: Steepness of the loss in the averaged log-odds, and of the confidence in the loss.
STEEP, SHARP = 4.0, 1.5
#: Step of the gradient rounds.
RATE = 0.12
#: Confidence from which on a sentence or title counts as being in its language.
SURE, SURE_TITLE = 0.8, 0.6
#: A Han, kana or hangul letter says about as much as so many alphabetic ones.
WIDE_WEIGHT = 3
#: Letters of a full sentence: alphabetic, and Han, kana or hangul.
FULL, FULL_WIDE = 12, 6

# Spellings of the nine languages (lower case, without region).
LABELS = {
    "en": "en eng english englisch anglais inglés ingles inglês английский 英语 英文 英語 영어",
    "zh": "zh zho chi cmn chinese mandarin chinesisch chinois chino chinês китайский 中文 汉语 漢語 中国語 简体中文 繁體中文 華語 중국어",
    "ja": "ja jpn jp japanese japanisch japonais japonés japonês японский 日本語 日语 日文 일본어",
    "ko": "ko kor kr korean koreanisch coréen coreano корейский 한국어 韩语 韓国語 朝鲜语 조선말",
    "de": "de deu ger german deutsch allemand alemán aleman alemão немецкий 德语 德文 ドイツ語 독일어",
    "fr": "fr fra fre french français francais französisch francés frances francês французский 法语 法文 フランス語 프랑스어",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol испанский 西班牙语 西班牙文 スペイン語 스페인어",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués португальский 葡萄牙语 葡萄牙文 ポルトガル語 포르투갈어",
    "ru": "ru rus russian русский russisch russe ruso russo 俄语 俄文 ロシア語 러시아어",
}
_LABEL = {w: k for k, ws in LABELS.items() for w in ws.split()}
# A few sentences of every language, so that one with few labelled books is known too.
SEEDS = {
    "en": "It was a bright day and the children went to the market with their mother. There is nothing that he would have wanted more than this. What do you think of the weather?",
    "zh": "今天天气很好，孩子们和妈妈一起去了市场。他没有什么比这个更想要的了。你觉得这本书怎么样？我们在学校里学习。这是他们的房子。",
    "ja": "今日はとてもいい天気で、子どもたちはお母さんと市場へ行きました。彼はこれよりほしいものがなかった。あなたはこの本をどう思いますか。学校で勉強している。",
    "ko": "오늘은 날씨가 아주 좋아서 아이들은 어머니와 함께 시장에 갔습니다. 그는 이보다 더 원하는 것이 없었다. 이 책을 어떻게 생각합니까? 우리는 학교에서 공부한다.",
    "de": "Es war ein schöner Tag, und die Kinder gingen mit ihrer Mutter auf den Markt. Er hätte sich nichts mehr gewünscht als das. Was denkst du über das Wetter?",
    "fr": "C'était une belle journée et les enfants sont allés au marché avec leur mère. Il n'aurait rien voulu de plus que cela. Que pensez-vous du temps qu'il fait ?",
    "es": "Era un día hermoso y los niños fueron al mercado con su madre. No habría querido nada más que esto. ¿Qué piensas del tiempo que hace hoy?",
    "pt": "Era um dia bonito e as crianças foram ao mercado com a sua mãe. Não teria querido mais nada do que isto. O que você acha do tempo que faz hoje?",
    "ru": "Был прекрасный день, и дети пошли на рынок вместе со своей матерью. Он не хотел бы ничего больше этого. Что ты думаешь о погоде сегодня?",
}


def label(text: str | None) -> str | None:
    """One of the nine codes for any spelling of a language; None for missing, unknown words and other languages."""
    if text is None:
        return None
    t = U.normalize("NFKC", text).strip().lower()
    return _LABEL.get(t) or _LABEL.get(re.split(r"[-_@.\s(（]", t)[0])


def codewords(seed: int = 5, tries: int = 4000) -> np.ndarray:
    """A (languages, BITS) matrix of signs with a large least distance between rows and between columns."""
    rng = np.random.default_rng(seed)
    best, score = None, (-1, -1)
    for _ in range(tries):
        m = rng.choice(np.array([-1, 1], dtype=np.int8), (len(LANGS), BITS))
        rows = min(int((m[a] != m[b]).sum()) for a, b in combinations(range(len(LANGS)), 2))
        if rows < score[0]:
            continue
        cols = min(min(d, len(LANGS) - d) for a, b in combinations(range(BITS), 2) if (d := int((m[:, a] != m[:, b]).sum())) >= 0)
        plain = min(int(abs(m[:, b].sum())) < len(LANGS) for b in range(BITS))
        if plain and (rows, cols) > score:
            best, score = m, (rows, cols)
    return best


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit code point: its folded lower-case letter or 32; its class (0 other, 1 letter, 2 wide letter, 3 ., 4 sure end, 5 !?, 6 digit, 7 line end, 8 sign after which a sentence goes on)."""
    code = np.full(65536, 32, dtype=np.uint32)
    kind = np.zeros(65536, dtype=np.uint8)
    for n in range(65536):
        c = FOLD.get(n, chr(n))
        if len(c) != 1:
            continue
        c = c.lower()
        if len(c) != 1:
            continue
        if c.isalpha():
            code[n] = ord(c)
            kind[n] = 2 if 0x3040 <= ord(c) <= 0x9FFF or 0xAC00 <= ord(c) <= 0xD7A3 else 1
        elif c.isdigit():
            kind[n] = 6
        elif c == ".":
            kind[n] = 3
        elif c in "!?":
            kind[n] = 5
    for c in "。｡！？…":
        kind[ord(c)] = 4
    for c in _SOFT:
        kind[ord(c)] = 8
    kind[10] = 7
    return code, kind


#: Signs at a line's end after which its sentence goes on in the next line: spaces, commas, and the hyphens of broken words.
_SOFT = " \t,;，、；-‐‑–¬\xad="


_CODE, _KIND = _tables()
_SEP = "\x01"


def _hashes(c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of the 1-, 2- and 3-gram at each letter."""
    a, b, d = c[at].astype(np.uint32), c[at + 1].astype(np.uint32), c[at - 1].astype(np.uint32)
    m = np.uint32(FEATURES - 1)
    mix = lambda x: ((x * np.uint32(0x9E3779B1)) >> np.uint32(13)) & m
    return mix(a * np.uint32(31) + np.uint32(7)), mix(a * np.uint32(0x85EBCA6B) + b * np.uint32(0xC2B2AE35) + np.uint32(1)), mix((d * np.uint32(0x27D4EB2F)) ^ (a * np.uint32(0x165667B1)) ^ (b * np.uint32(0x85EBCA77)) + np.uint32(2))


class Sentences:
    """Sentences of a batch of texts: owner, letters, wide letters, whether ended by a sentence sign; features on demand."""

    def __init__(self, texts: list[str]):
        u = np.frombuffer((_SEP + _SEP.join(texts) + _SEP).encode("utf-32-le", "replace"), dtype=np.uint32)
        u = np.minimum(u, 65535)
        self.code, kind = _CODE[u], _KIND[u]
        sep = u == 1
        n = len(u)
        nxt = np.empty(n, dtype=np.uint8)
        nxt[:-1], nxt[-1] = kind[1:], 0
        prev = np.empty(n, dtype=np.uint8)
        prev[1:], prev[0] = kind[:-1], 0
        word_next = (nxt == 1) | (nxt == 2) | (nxt == 6)
        ends = (kind == 4) | ((kind == 5) & ~word_next) | ((kind == 3) & ~word_next & (prev != 6))
        # a line end parts sentences where the line before is closed by a sign or the next one opens with one
        line = np.flatnonzero(kind == 7)
        if len(line):
            closed = (prev[line] == 0) | (prev[line] == 7)
            opens = (nxt[line] == 0) | (nxt[line] == 8)
            part = line[closed | opens]
        else:
            part = line
        cut = ends | sep
        cut[part] = True
        stops = np.flatnonzero(cut)
        letter = (kind == 1) | (kind == 2)
        total = np.concatenate(([0], np.cumsum(letter)))
        wide = np.concatenate(([0], np.cumsum(kind == 2)))
        starts = np.concatenate(([0], stops[:-1] + 1))
        count = total[stops + 1] - total[starts]
        self.keep = np.flatnonzero(count > 0)
        self.starts, self.stops = starts[self.keep], stops[self.keep]
        self.letters = count[self.keep]
        self.wide = (wide[stops + 1] - wide[starts])[self.keep]
        self.owner = np.cumsum(sep)[self.starts] - 1
        self.owner = np.where(sep[self.starts], self.owner, self.owner)
        self.ended = ends[self.stops]
        self.at = np.flatnonzero(letter)

    def scores(self, weights: np.ndarray, chunk: int = 120_000) -> np.ndarray:
        """Averaged log-odds of each sentence and bit."""
        out = np.zeros((len(self.letters), weights.shape[1]), dtype=np.float32)
        if not len(self.letters):
            return out
        bound = np.concatenate(([0], np.cumsum(self.letters)))
        i = 0
        while i < len(self.letters):
            j = max(i + 1, int(np.searchsorted(bound, bound[i] + chunk, side="right")) - 1)
            at = self.at[bound[i] : bound[j]]
            h1, h2, h3 = _hashes(self.code, at)
            x = weights[h1]
            x += weights[h2]
            x += weights[h3]
            out[i:j] = np.add.reduceat(x, bound[i:j] - bound[i], axis=0)
            i = j
        return out / self.letters[:, None]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, sentence of each): 3 per letter."""
        h = np.concatenate(_hashes(self.code, self.at))
        owner = np.repeat(np.arange(len(self.letters)), self.letters)
        return h, np.concatenate([owner] * 3)


class Model:
    """Codewords and the weights of the bits' classifiers."""

    def __init__(self, weights: np.ndarray, words: np.ndarray):
        self.weights, self.words = weights, words

    def decode(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, confidence) by loss-weighted decoding: logistic loss of every bit, added up over a codeword."""
        m = s[:, None, :] * self.words[None, :, :].astype(np.float32) * STEEP
        loss = np.logaddexp(0, -m).sum(axis=2)
        z = -SHARP * (loss - loss.min(axis=1, keepdims=True))
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]

    def whole(self, texts: list[str]) -> list[tuple[str | None, float, bool]]:
        """(language, confidence, ambiguous) of each short text as one piece; a text without letters has no language."""
        s = Sentences(texts)
        x, n = np.zeros((len(texts), BITS)), np.zeros(len(texts))
        if len(s.letters):
            np.add.at(x, s.owner, s.scores(self.weights) * s.letters[:, None])
            np.add.at(n, s.owner, s.letters)
        k, c = self.decode((x / np.maximum(1, n)[:, None]).astype(np.float32))
        return [(LANGS[int(k[i])], float(c[i]), bool(c[i] < SURE_TITLE)) if n[i] else (None, 0.0, True) for i in range(len(texts))]

    def one(self, text: str) -> tuple[str | None, float, bool]:
        return self.whole([text])[0]


def fit(texts: list[str], labels: list[str]) -> Model:
    """Binary classifiers from labelled texts; sentences that the first round decodes otherwise are left out of the second."""
    texts = [*texts, *(t for t in SEEDS.values() for _ in range(2))]
    labels = [*labels, *(k for k in SEEDS for _ in range(2))]
    own = np.array([LANGS.index(x) for x in labels])
    s = Sentences(texts)
    y = own[s.owner]
    feat, of = s.features()
    words = codewords()
    keep = np.ones(len(s.letters), dtype=bool)
    model = None
    for _ in range(3):
        dist = np.zeros((len(LANGS), FEATURES))
        use = keep[of]
        for k in range(len(LANGS)):
            n = np.bincount(feat[use & (y[of] == k)], minlength=FEATURES).astype(np.float64)
            dist[k] = (n + 0.02) / (n.sum() + 0.02 * FEATURES)
        w = np.zeros((FEATURES, BITS + 1), dtype=np.float32)
        for b in range(BITS):
            plus, minus = dist[words[:, b] > 0].mean(axis=0), dist[words[:, b] < 0].mean(axis=0)
            w[:, b] = np.clip(np.log(plus / minus), -6, 6)
        model = Model(w[:, :BITS].copy(), words)
        got, sure = model.decode(s.scores(model.weights))
        keep = ~((got != y) & (sure > 0.5))
    return _refined(model, s, y, keep)


def _refined(model: Model, s: Sentences, y: np.ndarray, keep: np.ndarray, rounds: int = 12, letters: int = 600_000) -> Model:
    """Gradient steps on the bits' logistic loss from the counted weights on; languages weigh alike.

    Uses a prefix of the kept training sentences (they come in random order) of so many letters.
    """
    pick = np.flatnonzero(keep & (s.letters >= 4))
    rng = np.random.default_rng(3)
    rng.shuffle(pick)
    pick = pick[np.cumsum(s.letters[pick]) <= letters]
    bound = np.concatenate(([0], np.cumsum(s.letters)))
    n = s.letters[pick]
    at = np.concatenate([s.at[bound[i] : bound[i + 1]] for i in pick])
    feat = np.stack(_hashes(s.code, at))
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    of = np.repeat(np.arange(len(pick)), n)
    want = model.words[y[pick]].astype(np.float32)
    weight = (1.0 / np.maximum(1, np.bincount(y[pick], minlength=len(LANGS))))[y[pick]]
    weight = (weight / weight.mean()).astype(np.float32)
    w = model.weights.astype(np.float32)
    square = np.zeros_like(w)
    for _ in range(rounds):
        x = w[feat[0]] + w[feat[1]] + w[feat[2]]
        score = np.add.reduceat(x, starts, axis=0) / n[:, None]
        g = -want / (1 + np.exp(np.clip(STEEP * want * score, -30, 30))) * weight[:, None] / n[:, None]
        spread = g[of]
        grad = np.zeros_like(w)
        for b in range(BITS):
            for f in feat:
                grad[:, b] += np.bincount(f, weights=spread[:, b], minlength=FEATURES)
        square += grad * grad
        w -= RATE * grad / (np.sqrt(square) + 1e-3)
    return Model(w, model.words)


_SPANS = T.StructType([
    T.StructField("letters", T.ArrayType(T.LongType())), T.StructField("full", T.ArrayType(T.StringType())), T.StructField("conf", T.DoubleType()),
])


def score_blocks(model: Model, texts: list[str]) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
    """(letters by language of each text, languages with a full sentence, letter-weighted confidence)."""
    s = Sentences(texts)
    n = len(texts)
    letters = np.zeros((n, len(LANGS)), dtype=np.int64)
    conf = np.zeros(n)
    full: list[list[str]] = [[] for _ in range(n)]
    if len(s.letters):
        k, c = model.decode(s.scores(model.weights))
        np.add.at(letters, (s.owner, k), s.letters)
        np.add.at(conf, s.owner, c * s.letters)
        whole = (c >= SURE) & np.where(s.wide * 2 > s.letters, s.letters >= FULL_WIDE, s.letters >= FULL)
        closed = s.ended | (s.letters >= 3 * np.where(s.wide * 2 > s.letters, FULL_WIDE, FULL))
        for i, lang in set(zip(s.owner[whole & closed].tolist(), k[whole & closed].tolist(), strict=True)):
            full[i].append(LANGS[lang])
    return letters, [sorted(x) for x in full], conf / np.maximum(1, letters.sum(axis=1))


def trained(blocks: DataFrame, book_meta: DataFrame) -> Model:
    """The model, fitted on at most MAX_TRAIN labelled blocks spread over the table by a hash of their key."""
    rows = blocks.count()
    share = min(1.0, 0.9 * MAX_TRAIN / max(1, rows))
    pick = blocks.where((F.col("kind") == "text") & F.col("text").isNotNull())
    if share < 1:
        pick = pick.where(F.pmod(F.xxhash64("doc_id", "block_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    got = pick.select("doc_id", "text").join(book_meta.select("doc_id", "lang").where("lang is not null").dropDuplicates(["doc_id"]), "doc_id").select("text", "lang").limit(MAX_TRAIN).toPandas()
    got = got.assign(lang=got["lang"].map(label)).dropna().sort_values(["text", "lang"])
    return fit(got["text"].tolist(), got["lang"].tolist())


def _score_udf(shared):
    def run(texts: pd.Series) -> pd.DataFrame:
        letters, full, conf = score_blocks(shared.value, [t if isinstance(t, str) else "" for t in texts])
        return pd.DataFrame({"letters": list(letters), "full": full, "conf": conf})

    return F.pandas_udf(run, _SPANS)


def block_languages(blocks: DataFrame, model: Model) -> DataFrame:
    """(doc_id, block_id, kind, letters, full, conf) of every block, a written table in the shared folder.

    Repeated deliveries stay as rows (they carry the same values); null texts have no letters.
    """
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(model)  # FEATURES x BITS floats: 2 MB whatever the data
    got = blocks.select("doc_id", "block_id", "kind", _score_udf(shared)("text").alias("s")).select("doc_id", "block_id", "kind", "s.*")
    where = f"{shared_dir(spark)}/languages-{uuid4().hex}"
    got.write.parquet(where)
    return spark.read.parquet(where)


_KINDS = ("code", "equation", "table", "image")


def book_languages(scored: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence): the language of most of the book's text, and its share; a wide letter weighs WIDE_WEIGHT."""
    use = scored.where(~F.coalesce(F.col("kind"), F.lit("")).isin(*_KINDS))
    sums = use.groupBy("doc_id").agg(*[(F.sum(F.col("letters")[i]) * (WIDE_WEIGHT if k in ("zh", "ja", "ko") else 1)).alias(k) for i, k in enumerate(LANGS)])
    best = F.greatest(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("lang")) for k in LANGS])
    total = sum((F.col(k) for k in LANGS[1:]), F.col(LANGS[0]))
    return sums.select("doc_id", best.alias("b"), total.alias("total")).where("total > 0").select("doc_id", F.col("b.lang").alias("lang"), F.round(F.col("b.n") / F.col("total"), 4).alias("confidence"))


@F.pandas_udf(T.StringType())
def _label_udf(labels: pd.Series) -> pd.Series:
    return labels.map(lambda x: label(x) if isinstance(x, str) else None)


def _title_udf(shared):
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(titles: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.whole([consistent_form(t)[0] if isinstance(t, str) else "" for t in titles]), columns=["lang", "confidence", "ambiguous"])

    return F.pandas_udf(run, schema)


def titles(book_meta: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, confidence, ambiguous) of the titles."""
    shared = book_meta.sparkSession.sparkContext.broadcast(model)
    return book_meta.select("doc_id", "title").where("title is not null").dropDuplicates(["doc_id"]).select("doc_id", _title_udf(shared)("title").alias("t")).select("doc_id", "t.*")


def _labels(book_meta: DataFrame) -> DataFrame:
    return book_meta.groupBy("doc_id").agg(F.max("lang").alias("label")).select("doc_id", _label_udf("label").alias("label"))


def cases(blocks: DataFrame, book_meta: DataFrame) -> DataFrame:
    """(doc_id, block_id, lang): wrong or missing labels (block_id ''), titles ('title') and blocks with passages in another language.

    A block with a full sentence in another language than the book's gives one row for each language that has a
    full sentence in it, the book's own among them. Books without any letter in their blocks have no language
    and give no rows.
    """
    model = trained(blocks, book_meta)
    scored = block_languages(blocks, model)
    book = book_languages(scored).select("doc_id", F.col("lang").alias("book"))
    of = _labels(book_meta).join(book, "doc_id")
    wrong = of.where("label is null or label <> book").select("doc_id", F.lit("").alias("block_id"), F.col("book").alias("lang"))
    t = titles(book_meta, model).where("not ambiguous").join(book, "doc_id").where("lang <> book").select("doc_id", F.lit("title").alias("block_id"), "lang")
    inside = scored.where(~F.coalesce(F.col("kind"), F.lit("")).isin("heading", *_KINDS)).select("doc_id", "block_id", F.explode("full").alias("lang"))
    keys = inside.join(book, "doc_id").where("lang <> book").select("doc_id", "block_id").distinct()
    # a title named inside a sentence is no passage: the few blocks found are decoded again without their book's titles
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    again = blocks.select("doc_id", "block_id", "text").join(small(written(keys.join(titles_of(blocks, book_meta), "doc_id", "left"))), ["doc_id", "block_id"])
    still = again.select("doc_id", "block_id", _untitled_udf(shared)("text", "titles").alias("langs")).join(book, "doc_id")
    foreign = still.where(F.exists("langs", lambda x: x != F.col("book"))).select("doc_id", "block_id", F.explode("langs").alias("lang")).distinct()
    return wrong.unionByName(t).unionByName(foreign)


def all_books(blocks: DataFrame, book_meta: DataFrame) -> DataFrame:
    """(doc_id, label, lang, confidence, title_lang, title_confidence, title_ambiguous) of every book with text."""
    model = trained(blocks, book_meta)
    book = book_languages(block_languages(blocks, model))
    t = titles(book_meta, model).select("doc_id", F.col("lang").alias("title_lang"), F.round("confidence", 4).alias("title_confidence"), F.col("ambiguous").alias("title_ambiguous"))
    return _labels(book_meta).join(book, "doc_id").join(t, "doc_id", "left")


def segments(blocks: DataFrame, book_meta: DataFrame) -> DataFrame:
    """(doc_id, block_id, lang, letters, confidence): the languages of each block's sentences and their letters."""
    scored = block_languages(blocks, trained(blocks, book_meta))
    each = scored.select("doc_id", "block_id", F.posexplode("letters").alias("i", "letters"), F.round("conf", 4).alias("confidence")).where("letters > 0")
    return each.select("doc_id", "block_id", _name("i").alias("lang"), "letters", "confidence").distinct()


@lru_cache(maxsize=20_000)
def _title_pattern(title: str) -> re.Pattern | None:
    words = re.findall(r"[^\W_]+", consistent_form(title)[0])
    return re.compile(r"[\W_]*".join(map(re.escape, words)), re.I) if len("".join(words)) > 1 else None


def without_titles(text: str, own: list[str]) -> str:
    """The text with the book's titles taken out, in whatever case, width or spacing they stand."""
    text = consistent_form(text)[0]
    for t in sorted(own, key=len, reverse=True):
        p = _title_pattern(t)
        if p is not None:
            text = p.sub(" ", text)
    return text


def _untitled_udf(shared):
    def run(texts: pd.Series, own: pd.Series) -> pd.Series:
        clean = [without_titles(t, list(o) if o is not None else []) if isinstance(t, str) else "" for t, o in zip(texts, own, strict=True)]
        return pd.Series(score_blocks(shared.value, clean)[1], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))


def _name(i: str) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in LANGS]), F.col(i) + 1)
