"""Problem 8: reading level of each document.

A linear ranker is learned from pairs of rated documents of different bands
(logistic loss on the difference of their scores) over syntax features
(sentence and clause length, word length, share of long words, writing) and
vocabulary features (hashed words, Han and kana pairs). Two isotonic
regressions turn scores into the chances of being at least middle and of being
hard; they are fitted on scores of documents left out of the ranker's fit.
Features and scores are computed in numpy, whole batches at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .languages import _CODE, _KIND, _SEP

BANDS = ("easy", "middle", "hard")
#: Bound of the rated documents that the ranker is fitted on, and their partners in pairs each.
MAX_RATED, PARTNERS = 2_000, 40
#: Hashed vocabulary features (a power of two).
VOCABULARY = 1 << 12
#: Characters from which on a document gets a band: alphabetic, and Chinese, Japanese or Korean.
LONG, LONG_WIDE = 400, 160
#: Scale of word frequencies against the syntax features.
SCALE = 30.0
SEED = 17

_WRITINGS = ("alphabet", "cyrillic", "han", "kana", "hangul")
_SYNTAX = 7
#: A power of an odd number for each place in a word.
_POWERS = np.cumprod(np.full(64, 0x01000193, dtype=np.uint64), dtype=np.uint64)
_COMMA = np.zeros(65536, dtype=bool)
_COMMA[[ord(c) for c in ",，、;；:："]] = True


class Batch:
    """Features of a batch of texts."""

    def __init__(self, texts: list[str]):
        u = np.frombuffer(_SEP.join(["", *texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
        u = np.minimum(u, 65535)
        code, kind = _CODE[u], _KIND[u]
        n = len(texts)
        edge = np.flatnonzero(u == 1)
        starts, stops = edge[:-1], edge[1:]

        def per(x: np.ndarray) -> np.ndarray:
            t = np.concatenate(([0], np.cumsum(x)))
            return (t[stops] - t[starts]).astype(np.float64)

        wide = kind == 2
        alpha = kind == 1
        hangul = wide & (code >= 0xAC00)
        kana = wide & (code < 0x3400)
        han = wide & ~hangul & ~kana
        cyrl = alpha & (code >= 0x400) & (code < 0x530)
        # alphabetic and hangul words
        inside = alpha | hangul
        before = np.empty_like(inside)
        before[1:], before[0] = inside[:-1], False
        first = np.flatnonzero(inside & ~before)
        at = np.flatnonzero(inside)
        if len(first):
            bound = np.searchsorted(at, first)
            length = np.diff(np.concatenate((bound, [len(at)])))
            place = np.arange(len(at)) - np.repeat(bound, length)
            h = np.add.reduceat(code[at].astype(np.uint64) * _POWERS[place & 63], bound)
        else:
            length, h = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        pair = np.flatnonzero(wide[:-1] & wide[1:] & ~(hangul[:-1] | hangul[1:]))
        hp = code[pair].astype(np.uint64) * np.uint64(0x9E3779B1) + code[pair + 1].astype(np.uint64) * np.uint64(0x85EBCA6B)
        m = np.uint64(VOCABULARY - 1)
        spots = np.concatenate((first, pair))
        feature = (((np.concatenate((h, hp)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & m).astype(np.int32)
        order = np.argsort(spots, kind="stable")
        self.feature = feature[order]
        self.owner = np.searchsorted(edge, spots[order], side="right") - 1
        self.tokens = np.bincount(self.owner, minlength=n).astype(np.float64)
        # syntax
        ends = (kind == 4) | (kind == 5) | (kind == 3)
        sentences = np.maximum(1, per(ends))
        letters = np.maximum(1, per(inside | wide))
        word_owner = np.searchsorted(edge, first, side="right") - 1
        words = np.maximum(1, np.bincount(word_owner, minlength=n))
        mean_word = np.bincount(word_owner, weights=length, minlength=n) / words
        long_words = np.bincount(word_owner, weights=length >= 8, minlength=n) / words
        s = np.stack([
            np.log(letters / sentences), per(_COMMA[u]) / sentences, mean_word / 4, long_words * 4, per(han) / letters * 2,
            np.minimum(3.0, self.tokens / sentences / 10), np.ones(n),
        ], axis=1)
        share = np.stack([per(alpha) - per(cyrl), per(cyrl), per(han), per(kana) * 3, per(hangul)], axis=1)
        # a text with some kana is Japanese even where Han letters lead
        share[:, 2] = np.where(per(kana) > 0.1 * per(han), 0, share[:, 2])
        self.writing = share.argmax(axis=1)
        self.syntax = np.zeros((n, len(_WRITINGS) * _SYNTAX))
        for k in range(_SYNTAX):
            self.syntax[np.arange(n), self.writing * _SYNTAX + k] = s[:, k]

    def scores(self, model: "Ranker") -> np.ndarray:
        vocabulary = np.bincount(self.owner, weights=model.vocabulary[self.feature], minlength=len(self.writing))
        return self.syntax @ model.syntax + SCALE * vocabulary / np.maximum(1, self.tokens)

    def matrix(self) -> np.ndarray:
        """Dense features, for the bounded rated sample only."""
        n = len(self.writing)
        v = np.bincount(self.owner * VOCABULARY + self.feature, minlength=n * VOCABULARY).reshape(n, VOCABULARY)
        v = SCALE * v / np.maximum(1, self.tokens)[:, None]
        return np.concatenate([self.syntax, v], axis=1).astype(np.float32)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool adjacent violators: steps (least x, greatest x, value), values rising."""
    order = np.argsort(x, kind="stable")
    at: list[list[float]] = []
    for i in order:
        at.append([float(x[i]), float(y[i]) * float(w[i]), float(w[i]), float(x[i])])
        while len(at) > 1 and at[-2][1] * at[-1][2] >= at[-1][1] * at[-2][2]:
            a = at.pop()
            at[-1][1] += a[1]
            at[-1][2] += a[2]
            at[-1][3] = a[3]
    return np.array([a[0] for a in at]), np.array([a[3] for a in at]), np.array([a[1] / a[2] for a in at])


class Ranker:
    def __init__(self, weights: np.ndarray):
        k = len(_WRITINGS) * _SYNTAX
        self.syntax, self.vocabulary = weights[:k].astype(np.float64), weights[k:].astype(np.float64)
        self.middle = self.hard = (np.zeros(1), np.zeros(1))

    def chances(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(at least middle), P(hard)), linear between the steps of the isotonic fits."""
        return np.interp(s, *self.middle), np.minimum(np.interp(s, *self.middle), np.interp(s, *self.hard))

    def bands(self, s: np.ndarray) -> np.ndarray:
        m, h = self.chances(s)
        return np.where(h >= 0.5, 2, np.where(m >= 0.5, 1, 0))


def _learn(x: np.ndarray, y: np.ndarray, rounds: int = 70, rate: float = 0.15, shrink: float = 2e-4) -> np.ndarray:
    """Weights of the pairwise logistic ranker, by adaptive gradient steps over sampled pairs."""
    n = len(y)
    if n < 2:
        return np.zeros(x.shape[1], dtype=np.float32)
    rng = np.random.default_rng(SEED)
    a = np.repeat(np.arange(n), PARTNERS)
    b = rng.integers(0, n, len(a))
    keep = y[a] > y[b] + 0.25
    a, b = a[keep], b[keep]
    w = np.zeros(x.shape[1], dtype=np.float32)
    square = np.zeros_like(w)
    if not len(a):
        return w
    for _ in range(rounds):
        s = x @ w
        g = -1.0 / (1.0 + np.exp(np.clip(s[a] - s[b], -30, 30)))
        of = np.bincount(a, weights=g, minlength=n) - np.bincount(b, weights=g, minlength=n)
        grad = (of.astype(np.float32) @ x) / len(a) + shrink * w
        square += grad * grad
        w -= rate * grad / (np.sqrt(square) + 1e-6)
    return w


def fit(texts: list[str], level: np.ndarray, weight: np.ndarray, folds: int = 3) -> Ranker:
    """Ranker and calibration. level: 0 easy to 2 hard, as the raters' mean of agreeing marks; weight: their number."""
    x = Batch(texts).matrix()
    model = Ranker(_learn(x, level))
    fold = np.random.default_rng(SEED + 1).integers(0, folds, len(level))
    score = np.zeros(len(level))
    whole = x @ np.concatenate([model.syntax, model.vocabulary]).astype(np.float32)
    for k in range(folds):
        out = fold == k
        if out.all() or not out.any():
            score[out] = whole[out]
            continue
        w = _learn(x[~out], level[~out])
        s = x @ w
        # each fold's scale is brought to the whole fit's
        spread = s[~out].std()
        score[out] = (s[out] - s[~out].mean()) / (spread or 1.0) * (whole[~out].std() or 1.0) + whole[~out].mean() if spread else whole[out]
    model.middle = _steps(score, level >= 0.5, weight)
    model.hard = _steps(score, level >= 1.5, weight)
    return model


def _steps(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(score):
        return np.zeros(1), np.zeros(1)
    start, stop, value = isotonic(score, y.astype(float), w)
    # flat over a step, linear between one step's end and the next one's beginning
    return np.stack([start, stop], axis=1).ravel(), np.repeat(value, 2)


def rated(documents: DataFrame, ratings: DataFrame) -> pd.DataFrame:
    """At most MAX_RATED rated documents, spread by a hash: text, level (majority of the raters' bands), weight.

    Null and unknown bands don't count; a document without any other is left out. Of a tie the mean is taken.
    """
    r = ratings.where(F.col("band").isin(*BANDS)).groupBy("doc_id").agg(*[F.sum((F.col("band") == b).cast("int")).alias(b) for b in BANDS])
    n = r.count()
    if n > MAX_RATED:
        r = r.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(0.95 * MAX_RATED / n * 1_000_000))
    got = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(r.limit(MAX_RATED)), "doc_id").toPandas().sort_values("doc_id")
    marks = got[list(BANDS)].to_numpy(dtype=float)
    top = marks.max(axis=1, keepdims=True) if len(marks) else np.zeros((0, 1))
    best = (marks == top) * np.arange(3)
    return pd.DataFrame({"text": got["text"].to_list(), "level": best.sum(axis=1) / np.maximum(1, (marks == top).sum(axis=1)), "weight": marks.sum(axis=1)})


def trained(documents: DataFrame, ratings: DataFrame) -> Ranker:
    r = rated(documents, ratings)
    return fit(r["text"].tolist(), r["level"].to_numpy(dtype=float), r["weight"].to_numpy(dtype=float))


_LEVEL = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("band", T.StringType()), T.StructField("p_middle", T.DoubleType()),
    T.StructField("p_hard", T.DoubleType()), T.StructField("writing", T.StringType()),
])


def _level_udf(shared):
    def run(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        out = []
        full = [t if isinstance(t, str) else "" for t in texts]
        for i in range(0, len(full), 500):
            b = Batch(full[i : i + 500])
            s = b.scores(model)
            m, h = model.chances(s)
            out.append(pd.DataFrame({"score": s, "band": [BANDS[k] for k in model.bands(s)], "p_middle": m, "p_hard": h, "writing": [_WRITINGS[k] for k in b.writing]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({f.name: [] for f in _LEVEL.fields})

    return F.pandas_udf(run, _LEVEL)


def levels(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """(doc_id, n_chars, score, band, p_middle, p_hard, writing, long_enough) of every document, short ones too.

    Null text counts as empty. long_enough tells where the text has the characters a band needs.
    """
    model = trained(documents, ratings)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # VOCABULARY weights whatever the data
    d = documents.select("doc_id", F.length("text").alias("n_chars"), _level_udf(shared)("text").alias("l")).select("doc_id", "n_chars", "l.*")
    enough = F.col("n_chars") >= F.when(F.col("writing").isin("han", "kana", "hangul"), LONG_WIDE).otherwise(LONG)
    return d.withColumn("long_enough", F.coalesce(enough, F.lit(False)))


def profile(scored: DataFrame) -> DataFrame:
    """(writing, band, n_docs, n_chars, mean_score): the corpus by level."""
    return scored.where("long_enough").groupBy("writing", "band").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.round(F.avg("score"), 4).alias("mean_score"))
