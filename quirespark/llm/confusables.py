"""Problem 5: one consistent form for text that looks the same.

Each token's characters have a set of writing systems they can belong to (a
look-alike belongs to all systems that have its shape). The sets are
intersected over the token: an empty intersection of the characters as they
stand marks a mixed-script token, a look-alike-only token marks a whole-script
confusable; the token is respelled in the consistent system, preferring the
one of the text's unambiguous letters. Remaining forms (width, combining
accents, ligatures, radicals, spaces, invisible characters) are normalised.

The choice depends only on the shapes of the characters, never on the spelling
found, so two texts that differ in look-alikes alone get the same form.
"""

from __future__ import annotations

import re
import unicodedata as U
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of Latin, Cyrillic and Greek with one shape ("." where a script has none).
SHAPES = {
    "Latn": "aceopxyijsdhqwvABCEHIJKMOPSTXYGVNZuk",
    "Cyrl": "асеорхуіјѕԁһԛԝѵАВСЕНІЈКМОРЅТХУԌѴ....",
    "Grek": "α..ορ..ι......νΑΒ.ΕΗΙ.ΚΜΟΡ.ΤΧΥ..ΝΖυκ",
}
# Han characters, katakana and hiragana with one shape.
HAN_KANA = ("力カ", "二ニ", "卜ト", "口ロ", "工エ", "夕タ", "八ハ", "才オ", "丿ノ", "乂メ", "匕ヒ", "厶ム", "千チ", "一ー")
KANA_KANA = ("へヘ", "べベ", "ぺペ")
# Hyphens drawn as the ASCII one.
HYPHENS = "‐‑"

ORDER = ("Latn", "Cyrl", "Grek", "Jpan", "Hani", "Kore")
SYSTEMS = {"LATIN": ("Latn",), "CYRILLIC": ("Cyrl",), "GREEK": ("Grek",), "HANGUL": ("Kore",), "HIRAGANA": ("Jpan",), "KATAKANA": ("Jpan",), "CJK": ("Hani", "Jpan", "Kore")}
ALL = frozenset(ORDER)


def _alternatives() -> dict[str, dict[str, str]]:
    """Character -> script -> the character of the same shape in it."""
    out: dict[str, dict[str, str]] = {}
    for i in range(len(SHAPES["Latn"])):
        form = {s: row[i] for s, row in SHAPES.items() if row[i] != "."}
        out.update({c: form for c in form.values()})
    for h, k in HAN_KANA:
        out[h] = out[k] = {"Han": h, "Kana": k}
    for r, k in KANA_KANA:
        out[r] = out[k] = {"Hira": r, "Kana": k}
    return out


ALTERNATIVES = _alternatives()


#: Where the Unicode database has spaces, format characters, compatibility forms; scripts without any are left out.
_RANGES = ((0x80, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x10000), (0x110BD, 0x110CE), (0x13430, 0x13440), (0x1BCA0, 0x1BCA4), (0x1D173, 0x1D17B), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))


def _fold_table() -> dict[int, str]:
    """Single characters with a plain form of the same look, from the Unicode database."""
    out: dict[int, str] = {}
    for n in (n for a, b in _RANGES for n in range(a, b)):
        c = chr(n)
        cat = U.category(c)
        if cat == "Cf" or n in (0x034F, 0x115F, 0x1160, 0x3164) or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF:
            out[n] = ""
        elif cat == "Zs":
            out[n] = " "
        elif c in HYPHENS:
            out[n] = "-"
        else:
            kind = U.decomposition(c).partition(">")[0]
            radical = 0x2E80 <= n <= 0x2FDF
            ligature = 0xFB00 <= n <= 0xFB17 or 0x2160 <= n <= 0x217F or 0x01C7 <= n <= 0x01CC or 0x0132 <= n <= 0x0133
            if kind in ("<wide", "<narrow") or kind == "<compat" and (radical or ligature):
                out[n] = U.normalize("NFKC", c)
    return out


FOLD = str.maketrans(_fold_table())


def _class_of(codes: list[int]) -> str:
    """A regular-expression class of the characters, as ranges."""
    out, codes = [], sorted(codes)
    i = 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[i]:08x}-\\U{codes[j]:08x}")
        i = j + 1
    return "[" + "".join(out) + "]"


#: Finds any character that folding changes, or a combining mark.
_FOLDABLE = re.compile(_class_of([*FOLD, *range(0x300, 0x370), *range(0x1100, 0x1200), *range(0x3099, 0x309B)]))
_TOKEN = re.compile(r"\w+")
_LOOKALIKE = "".join(sorted(ALTERNATIVES))
#: Where none of these stand, every token is spelled in one way only.
_SUSPECT = re.compile("[Ͱ-ϿЀ-ԯ" + "".join(sorted(c for p in (*HAN_KANA, *KANA_KANA) for c in p)) + "]")
_ANY = re.compile(f"[{_LOOKALIKE}]")
#: The same without wide punctuation.
_FOLDABLE_LETTERS = re.compile(_class_of([n for n in (*FOLD, *range(0x300, 0x370), *range(0x1100, 0x1200), *range(0x3099, 0x309B)) if not (0xFF01 <= n <= 0xFF0F or 0xFF1A <= n <= 0xFF20 or 0xFF3B <= n <= 0xFF40 or 0xFF5B <= n <= 0xFF65)]))
#: One character that folding changes.
_FOLDED = re.compile(_class_of([*FOLD]))
#: Han look-alikes of kana change only beside kana.
_DECIDES = re.compile("[Ͱ-ϿЀ-ԯ぀-ヿ]")


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    """Script word of a letter, '' for digits, marks and signs."""
    if not c.isalpha():
        return ""
    word = U.name(c, "").split(" ")[0]
    return {"IDEOGRAPHIC": "CJK", "HALFWIDTH": "KATAKANA"}.get(word, word)


@lru_cache(maxsize=65536)
def _systems(c: str) -> frozenset[str]:
    """Writing systems a character can belong to by its shape."""
    form = ALTERNATIVES.get(c)
    if form is None:
        s = _script(c)
        return frozenset(SYSTEMS.get(s, (s,))) if s else ALL
    if "Han" in form:
        return frozenset(("Hani", "Jpan", "Kore"))
    if "Hira" in form:
        return frozenset(("Jpan",))
    return frozenset(form)


def _respell(run: str, system: str) -> str:
    """The run with every look-alike in its form of the system."""
    if system not in ("Jpan",):
        return "".join(f.get(system) or f.get("Han") or c if (f := ALTERNATIVES.get(c)) else c for c in run)
    plain = [("Kana" if s == "KATAKANA" else "Hira" if s == "HIRAGANA" else "Han" if s == "CJK" else "") if c not in ALTERNATIVES else "" for c, s in ((c, _script(c)) for c in run)]
    out = []
    for i, c in enumerate(run):
        form = ALTERNATIVES.get(c)
        if form is None or "Latn" in form:
            out.append(c)
            continue
        near = ""
        for d in range(1, len(run)):  # the nearest character of one script decides; the left one of two
            for j in (i - d, i + d):
                if 0 <= j < len(run) and plain[j] in form:
                    near = plain[j]
                    break
            if near:
                break
        out.append(form.get(near) or form.get("Han") or form["Hira"])
    return "".join(out)


def _token(token: str, main: str) -> tuple[str, bool]:
    """(consistent spelling, whether the token as it stood mixed scripts)."""
    out, run, possible = [], "", ALL
    mixed = False

    def close() -> None:
        system = main if main in possible else next((s for s in ORDER if s in possible), "")
        out.append(_respell(run, system) if system and _ANY.search(run) else run)

    for c in U.normalize("NFD", token) if not token.isascii() else token:
        s = _systems(c)
        if possible & s:
            run, possible = run + c, possible & s
        else:
            close()
            run, possible = c, s
    close()
    new = U.normalize("NFC", "".join(out))
    stands = {_script(c) for c in token} - {""}
    mixed = len({"LATIN", "CYRILLIC", "GREEK"} & stands) > 1 or (new != token and len(stands) > 1)
    return new, mixed


def _main(text: str) -> str:
    """The system of most letters that have one script only."""
    n: Counter[str] = Counter()
    for c, k in Counter(text).items():
        if c not in ALTERNATIVES:
            s = _systems(c)
            if s is not ALL and s != ALL:
                n["Jpan" if s == {"Jpan"} else next(x for x in (*ORDER, *s) if x in s)] += k
    # Han letters alone count for Jpan where kana stand beside them
    if n["Jpan"]:
        n["Jpan"] += n.pop("Hani", 0)
    return min(n, key=lambda s: (-n[s], s)) if n else ""


_CACHE: dict[tuple[str, str], tuple[str, bool]] = {}


def folded(text: str) -> str:
    """One width and one kind of space, no invisible characters, accents composed; look-alikes stay."""
    if text.isascii() or not _FOLDABLE.search(text):
        return text
    return U.normalize("NFC", text.translate(FOLD))


def folded_letters(text: str) -> str:
    """As folded, but a text in which only punctuation is wide stays as it is."""
    if text.isascii() or not _FOLDABLE_LETTERS.search(text):
        return text
    # as translate(FOLD), which looks every character up
    return U.normalize("NFC", _FOLDED.sub(lambda m: FOLD[ord(m[0])], text))


def consistent_form(text: str | None, letters: bool = False) -> tuple[str | None, int, int]:
    """(form, mixed-script tokens, whole-script look-alike tokens respelled); null stays null, '' stays ''; see folded_letters."""
    if text is None:
        return None, 0, 0
    if text.isascii():
        return text, 0, 0
    t = folded_letters(text) if letters else folded(text)
    if not _DECIDES.search(t) or not _SUSPECT.search(t):
        return t, 0, 0
    main, mixed, whole = _main(t), 0, 0
    out, at = [], 0
    for m in _TOKEN.finditer(t):
        w = m.group()
        if not _ANY.search(w):
            continue
        hit = _CACHE.get((w, main))
        if hit is None:
            hit = _token(w, main)
            if len(_CACHE) < 40_000:
                _CACHE[(w, main)] = hit
        new, was_mixed = hit
        if new != w:
            mixed, whole = mixed + was_mixed, whole + (not was_mixed)
            out += [t[at : m.start()], new]
            at = m.end()
    return ("".join([*out, t[at:]]) if out else t), mixed, whole


@F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("mixed", T.IntegerType()), T.StructField("whole", T.IntegerType())]))
def _consistent(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([consistent_form(None if t is None or t != t else t) for t in texts], columns=["form", "mixed", "whole"])


def consistent(c: Column) -> Column:
    """Struct (form, mixed, whole) of a text column; only texts with a non-ASCII character go to Python."""
    return _consistent(F.when(c.rlike(r"[^\x00-\x7f]"), c))


def with_consistent_form(df: DataFrame, column: str, into: str = "consistent") -> DataFrame:
    """Adds the consistent form, the number of mixed-script tokens and of whole-script respellings.

    Null text gives a null form and zero counts; other columns are kept, a clashing
    result column is replaced.
    """
    got = df.withColumn("_cf", consistent(F.col(f"`{column}`")))
    return got.withColumns({
        into: F.coalesce(F.col("_cf.form"), F.col(f"`{column}`")),
        f"{into}_mixed": F.coalesce(F.col("_cf.mixed"), F.lit(0)),
        f"{into}_whole": F.coalesce(F.col("_cf.whole"), F.lit(0)),
    }).drop("_cf")


def look_alike_patches(patches: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, patch_id) of patches whose before_text differs from its block's text but looks the same.

    Each pair is compared after both sides got their consistent form. Repeated
    deliveries give one row; patches without a block, and null texts on either
    side, are no cases. Joined on (doc_id, block id), so a book with very many
    blocks spreads over all tasks.
    """
    p = patches.select("doc_id", "patch_id", F.col("target_block_id").alias("block_id"), "before_text").where("before_text is not null")
    b = blocks.select("doc_id", "block_id", "text").where("text is not null")
    # shapes keep their number of letters nearly: a cheap bound before the Python step, loose enough for
    # ligatures, combining marks, invisible characters and jamo
    pair = p.join(b, ["doc_id", "block_id"]).where("before_text <> text")
    letters = lambda c: F.length(F.regexp_replace(F.col(c), r"[\p{M}\p{Cf}ᅟᅠㅤ]", ""))
    pair = pair.where((letters("before_text") >= letters("text") * 0.3) & (letters("text") >= letters("before_text") * 0.3))
    pair = pair.select("doc_id", "patch_id", consistent(F.col("before_text")).alias("x"), consistent(F.col("text")).alias("y"), "before_text", "text")
    same = F.coalesce(F.col("x.form"), F.col("before_text")) == F.coalesce(F.col("y.form"), F.col("text"))
    return pair.where(same).select("doc_id", "patch_id").distinct()
