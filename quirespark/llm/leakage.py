"""Problem 6: passages of evaluation items inside documents.

One Aho-Corasick automaton holds stretches of all normalised passages and all
answers; every document is normalised (case, width, markup, punctuation and
spacing gone) and scanned once. Stretches make a document a candidate for the
passages they stand in; a phrase that several passages share does so only for
those that have too few stretches of their own. Candidates are then aligned with
the whole passage in order, allowing changed words and other text between its
parts, and positions are mapped back to the document's own text. Items with the
same passage are one class; a passage too short for stretches is looked for as a
whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from difflib import SequenceMatcher
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .confusables import folded

#: Letters of a stretch and the step between stretches of a passage (Han, kana and hangul carry more each).
STRETCH = {False: (18, 4), True: (7, 2)}
#: Letters of a passage that stretches at one offset must cover together, the offsets taken together, and the letters looked at around them.
SUPPORT = {False: 34, True: 13}
BAND, MARGIN = 16, 90
#: The share of a passage a document must hold.
HALF = 0.5
#: The share of a passage that its stretches must cover before it is aligned.
SEEN = 0.15
#: Letters of a passage below which it is a name or a scrap and no case.
LEAST = {False: 12, True: 6}

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>\n]{0,200}>|&(?:[A-Za-z]{2,10}|#\d{1,6});", re.S)
_WORD = re.compile(r"[^\W_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힣]")
_UNIT = re.compile(r"[぀-ヿ㐀-䶿一-鿿]|[^\W_぀-ヿ㐀-䶿一-鿿]+")


def plain(text: str) -> str:
    """Letters and digits only, in lower case and one width."""
    t = folded(text)
    if "<" in t or "&" in t:
        t = _TAG.sub(" ", t)
    return "".join(_WORD.findall(t.lower()))


def units(text: str) -> list[str]:
    """Words, and single Han or kana characters."""
    t = folded(text)
    if "<" in t or "&" in t:
        t = _TAG.sub(" ", t)
    return _UNIT.findall(t.lower())


def passage(text: str) -> str:
    """The text after its instruction line; all of it where there is one line only."""
    head, cut, rest = text.partition("\n")
    return rest if cut and rest.strip() else head


class Scanner:
    """The automaton (about 100 bytes a letter of the items) and the passages, by classes of items with the same one."""

    def __init__(self, items: list[tuple[int, str, str | None]]):
        import ahocorasick

        self.items: list[list[int]] = []
        self.units: list[list[str]] = []
        self.size: list[int] = []
        self.wide: list[bool] = []
        classes: dict[str, int] = {}
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        answers: dict[str, set[int]] = defaultdict(set)
        passages: list[str] = []
        for item, text, answer in items:
            body = passage(text)
            p = plain(body)
            if answer and plain(answer):
                answers[plain(answer)].add(item)
            if p in classes:
                self.items[classes[p]].append(item)
                continue
            wide = len(_WIDE.findall(p)) * 2 > len(p)
            if len(p) < LEAST[wide]:
                continue
            classes[p] = len(passages)
            passages.append(p)
            self.items.append([item])
            self.units.append(units(body))
            self.size.append(len(p))
            self.wide.append(wide)
        for k, p in enumerate(passages):
            n, step = STRETCH[self.wide[k]]
            # of a short passage, half is no more than a scrap, so it counts as a whole
            for i in range(0, len(p) - n + 1, step) if len(p) >= 2 * SUPPORT[self.wide[k]] else ():
                where[p[i : i + n]].append((k, i))
        own = {s: at for s, at in where.items() if len({k for k, _ in at}) == 1}
        bare = set(range(len(passages))) - {k for k in range(len(passages)) if self._distinct(k, own, where)}
        names: dict[str, tuple[tuple[int, int], ...]] = {s: tuple(x for x in at if s in own or x[0] in bare) for s, at in where.items()}
        whole = {p: k for p, k in classes.items() if len(p) < 2 * SUPPORT[self.wide[k]]}
        self.auto = ahocorasick.Automaton()
        for s in {s for s, at in names.items() if at} | answers.keys() | whole.keys():
            self.auto.add_word(s, (len(s), names.get(s, ()), whole.get(s), answers.get(s)))
        if len(self.auto):
            self.auto.make_automaton()

    def _distinct(self, k: int, own: dict, where: dict) -> bool:
        """Whether any half of the passage holds enough letters of stretches that no other passage has."""
        if not hasattr(self, "_covered"):
            letters: dict[int, set[int]] = defaultdict(set)
            for s, at in own.items():
                for c, i in at:
                    letters[c].update(range(i, i + len(s)))
            self._covered = {c: len(x) for c, x in letters.items()}
        need = max(SUPPORT[self.wide[k]], SEEN * self.size[k])
        return self.size[k] - self._covered.get(k, 0) <= HALF * self.size[k] - need

    def candidates(self, p: str) -> tuple[dict[int, list[tuple[int, int]]], set[int]]:
        """(class -> regions of the normalised text where its stretches lie close, items whose answer stands there).

        Stretches at one offset to the passage support each other; chance matches of common phrases lie scattered.
        """
        if not len(self.auto):
            return {}, set()
        hits: dict[int, list[tuple[int, int, int]]] = {}
        said: set[int] = set()
        short: dict[int, list[tuple[int, int]]] = {}
        for end, (n, at, whole, answers) in self.auto.iter(p):
            for k, i in at:
                if k in hits:
                    hits[k].append((end - n + 1, i, n))
                else:
                    hits[k] = [(end - n + 1, i, n)]
            if whole is not None:
                short.setdefault(whole, []).append((end - n + 1, end + 1))
            if answers:
                said |= answers
        out: dict[int, list[tuple[int, int]]] = {k: _joined(at, len(p)) for k, at in short.items()}
        for item, own in hits.items():
            need = SUPPORT[self.wide[item]]
            n = STRETCH[self.wide[item]][0]
            if len(own) * n < need:
                continue  # so few stretches cannot cover enough
            bands: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            for h in own:
                bands[(h[0] - h[1]) // BAND].append(h)
            regions, seen = [], set()
            for band in list(bands):
                near = bands[band] + bands.get(band + 1, [])
                if len(near) * n < need:
                    continue
                own_letters: set[int] = set()
                for _, at, n in near:
                    own_letters.update(range(at, at + n))
                if len(own_letters) >= need:
                    # stretches of one passage offset that lie near each other in the text
                    for start, _, n in near:
                        regions.append((start - MARGIN, start + n + MARGIN))
                    seen |= own_letters
            if len(seen) >= max(need, SEEN * self.size[item]):
                out[item] = _joined(regions, len(p))
        return out, said

    def found(self, text: str | None) -> list[tuple[int, float, int, int, bool]]:
        """(item, share of its passage held, first and last position in the text, whether its answer stands there)."""
        if not text:
            return []
        got, said = self.candidates(plain(text))
        if not got:
            return []
        spans, doc = _mapped(text)
        ends = list(accumulate(map(len, doc)))
        out = []
        for k, regions in got.items():
            at = [i for a, b in regions for i in range(bisect_right(ends, a), min(len(doc), bisect_left(ends, b) + 1))]
            share, a, b = held(self.units[k], [doc[i] for i in at])
            if share >= (HALF if self.size[k] >= 2 * SUPPORT[self.wide[k]] else 1):
                out += [(item, round(share, 4), spans[at[a]][0], spans[at[b]][1], item in said) for item in self.items[k]]
        return sorted(out)


def _joined(regions: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, a), min(size, b)) for a, b in regions):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _mapped(text: str) -> tuple[list[tuple[int, int]], list[str]]:
    """Units of a text and their spans in it as it stands."""
    spans, doc = [], []
    masked = _TAG.sub(lambda m: " " * len(m.group()), text) if "<" in text or "&" in text else text
    for m in re.finditer(r"\S+", masked):
        w = m.group()
        one = folded(w)
        for u in _UNIT.finditer(one.lower()):
            exact = len(one) == len(w)
            spans.append((m.start() + u.start(), m.start() + u.end()) if exact else m.span())
            doc.append(u.group())
    return spans, doc


def held(item: list[str], doc: list[str]) -> tuple[float, int, int]:
    """(share of the item's letters that the document holds in order, first and last unit there).

    Runs of at least 3 units (8 letters) count; up to 3 units changed in place between two runs count as held.
    """
    total = sum(map(len, item)) or 1
    blocks = [b for b in SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks() if b.size]
    runs = [b for b in blocks if b.size >= 3 and sum(map(len, item[b.a : b.a + b.size])) >= 3 or sum(map(len, item[b.a : b.a + b.size])) >= 8]
    if not runs:
        return 0.0, 0, 0
    n = 0
    for i, b in enumerate(runs):
        n += sum(map(len, item[b.a : b.a + b.size]))
        if i:
            p = runs[i - 1]
            da, db = b.a - p.a - p.size, b.b - p.b - p.size
            if 0 < da <= 3 and db <= 3:
                n += sum(map(len, item[p.a + p.size : b.a]))
    return n / total, runs[0].b, runs[-1].b + runs[-1].size - 1


_FOUND = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("answer", T.BooleanType()),
]))


def leaks(documents: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, share, start, end, answer): documents that hold at least half of an item's passage.

    Items are held-out tests, a bounded table: all reach every worker as one automaton. Every document is scanned
    whole and once, where it lies; nothing is shuffled. Null and empty texts hold nothing; items with null text or a
    passage of less than LEAST letters are skipped; an item listed twice counts once.
    """
    spark = documents.sparkSession
    rows = {r[0]: (r[0], r[1], r[2]) for r in items.where("text is not null").select("item_id", "text", "answer").orderBy("item_id").toLocalIterator()}
    shared = spark.sparkContext.broadcast(list(rows.values()))
    d = documents.select("doc_id", F.col(text).alias("text")).where("text is not null")
    return d.select("doc_id", F.explode(_scan(shared)("text")).alias("f")).select("doc_id", "f.*")


def _scan(shared):
    def run(texts: pd.Series) -> pd.Series:
        scanner = scanner_of(shared.value)
        return pd.Series([[dict(zip(("item_id", "share", "start", "end", "answer"), f, strict=True)) for f in scanner.found(t)] for t in texts], dtype=object)

    return F.pandas_udf(run, _FOUND)


_BUILT: list[tuple[list, Scanner]] = []


def scanner_of(items: list[tuple[int, str, str | None]]) -> Scanner:
    """The scanner of these items, built once a worker."""
    if not _BUILT or _BUILT[0][0] is not items and _BUILT[0][0] != items:
        _BUILT[:] = [(items, Scanner(items))]
    return _BUILT[0][1]


def by_item(found: DataFrame) -> DataFrame:
    """(item_id, n_docs, max_share, n_answers): which test items leaked, and how far."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("share").alias("max_share"), F.sum(F.col("answer").cast("long")).alias("n_answers"))
