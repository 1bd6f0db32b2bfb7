"""Predicates of one line, as Column expressions.

All patterns avoid lookaround and are written with explicit Unicode classes, so
that they mean the same in the JVM's and in RE2's regular expressions.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character sets of the document format.
END_PUNCT = "。！？；：、，·…—”』」）】》%％\"'"
START_PUNCT = "“‘『「（【《〈\"'"
BLOCK_MARKERS = ("#", ">", "|", "- ", "* ", "```", "<", "![", "+ ")
SENTENCE_PUNCT = "、。！，：；？,;:!?"
# Thresholds of the line rules.
JOIN_MIN, LAYOUT_MAX, VERSE_MAX, HEAD_MAX, HEAD_REPEATS = 20, 20, 18, 40, 3
HARD_BREAK = "  "

#: White space as str.strip() sees it.
WS = r"[ \t\n\r\f\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MARK = r"(#|>|\||- |\* |```|<|!\[|\+ )"
_TAIL = r"(/|\.{2,}|…+|·{2,}|^)" + WS + r"*\p{Nd}{1,4}" + WS + "*$"
_CLASS = lambda chars: "[" + "".join("\\" + c if c in "[]\\^-" else c for c in chars) + "]"

PATTERNS = {
    "block_start": rf"^({_MARK[1:-1]}|\p{{Nd}}{{1,3}}[.)]({WS}|$))",
    "page_mark": rf"^<!--{WS}*page{WS}+[\p{{Nd}}, \-]+({WS}+ocr)?{WS}*-->$",
    "page_number": r"^[ \t]*\p{Nd}{1,3}[ \t]*$",
    "page_number_cjk": rf"^[ \t]*(第{WS}*\p{{Nd}}{{1,4}}{WS}*页|[—–-]{WS}*\p{{Nd}}{{1,4}}{WS}*[—–-])[ \t]*$",
    "catalog_strong": _TAIL,
    "catalog_weak": rf"{WS}\p{{Nd}}{{1,3}}{WS}*$",
    "sentence_punct": _CLASS(SENTENCE_PUNCT),
    "note": "^[①-⑳]",
    "heading": rf"^#{{1,6}}{WS}*.*$",
    "end_punct": _CLASS(END_PUNCT) + "$",
    "start_punct": "^" + _CLASS(START_PUNCT),
    "latin_digit": "[0-9A-Za-z]",
    "word_char": r"[\p{L}\p{N}\x{3000}-\x{303f}\x{ff00}-\x{ffef}“”‘’—…]",
    "all_digits": r"^[\p{Nd}①-⑳²³¹]+$",
    "chapter": rf"^{WS}*(第{WS}*[一二三四五六七八九十百千〇零两\p{{Nd}}]+{WS}*[章回节讲]|(Chapter|CHAPTER){WS}+[\p{{Nd}}IVXLC]+|\p{{Nd}}{{1,3}}{WS}*[.、]{WS}*[^ \t\n]|(序|序言|楔子|引言|导言|前言|后记|跋|结语|尾声|附录|致谢|参考文献|索引){WS}*$)",
    "part": rf"^{WS}*(第{WS}*[一二三四五六七八九十百千〇零两\p{{Nd}}]+{WS}*[部编卷篇]|(Part|PART|Book|BOOK){WS}+[\p{{Nd}}IVXLC]+)",
}


_WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space on either side; a plain trim, many times quicker than a pattern."""
    return F.btrim(c, F.lit(_WS_CHARS))


def visible(c: Column) -> Column:
    """The text without any white space."""
    return F.translate(c, _WS_CHARS, "")


def is_block_start(s: Column) -> Column:
    return s.rlike(PATTERNS["block_start"])


def is_page_mark(line: Column) -> Column:
    return strip(line).rlike(PATTERNS["page_mark"])


def is_page_number(line: Column) -> Column:
    return line.rlike(PATTERNS["page_number"]) | line.rlike(PATTERNS["page_number_cjk"])


def is_catalog_entry(line: Column) -> Column:
    s = strip(line)
    return (s != "") & (s.rlike(PATTERNS["catalog_strong"]) | (s.rlike(PATTERNS["catalog_weak"]) & ~s.rlike(PATTERNS["sentence_punct"])))


def is_note(line: Column) -> Column:
    return strip(line).rlike(PATTERNS["note"])


def is_structure_line(line: Column) -> Column:
    return strip(line).rlike(PATTERNS["heading"]) | is_catalog_entry(line) | is_note(line)


def ends_sentence(s: Column) -> Column:
    return s.rlike(PATTERNS["end_punct"])


def is_layout_line(line: Column) -> Column:
    """A field on a line of its own: no sentence end, and short or with Latin letters or digits."""
    s = strip(line)
    v = visible(s)
    return (s != "") & ~is_block_start(s) & ~ends_sentence(s) & ((F.length(v) < LAYOUT_MAX) | v.rlike(PATTERNS["latin_digit"]))


def unquoted(line: Column) -> Column:
    return strip(F.regexp_replace(strip(line), f"^(>{WS}*)+", ""))


def is_verse_line(line: Column) -> Column:
    s = unquoted(line)
    return (s != "") & ~is_block_start(s) & (F.length(visible(s)) <= VERSE_MAX) & ~ends_sentence(s)


def keeps_break(line: Column) -> Column:
    s = strip(line)
    return is_verse_line(line) | ((s != "") & ~is_block_start(s) & (is_catalog_entry(line) | is_note(line)))


def is_running_head_candidate(s: Column, longest: int = HEAD_MAX) -> Column:
    """Of a stripped line: short, no markup, no catalogue entry or note, no sentence end, not digits only, some letter."""
    return (
        F.length(s).between(1, longest) & ~is_block_start(s) & ~s.rlike(r"[\[\]]") & ~is_catalog_entry(s) & ~is_note(s)
        & ~ends_sentence(s) & ~s.rlike(PATTERNS["all_digits"]) & s.rlike(PATTERNS["word_char"])
    )


def is_front_field(line: Column) -> Column:
    s = strip(line)
    return F.length(s).between(1, 24) & ~ends_sentence(s)


def is_chapter_anchor(text: Column) -> Column:
    return text.rlike(PATTERNS["part"]) | text.rlike(PATTERNS["chapter"])


def strip_trailing(line: Column) -> Column:
    """Trailing blanks go; exactly two spaces are a hard break and stay."""
    return F.when(line.rlike("(^|[^ \t])  $"), line).otherwise(F.regexp_replace(line, "[ \t]+$", ""))


@lru_cache(maxsize=None)
def compiled(name: str) -> regex.Pattern:
    """One of the patterns for functions that run line after line in Python; the same expression as in the JVM."""
    return regex.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", PATTERNS[name]))


class Plain:
    """The predicates of a line for Python strings, from the same patterns."""

    @staticmethod
    def _has(name: str, s: str) -> bool:
        return compiled(name).search(s) is not None

    @classmethod
    def block_start(cls, s: str) -> bool:
        return cls._has("block_start", s)

    @classmethod
    def entry_or_note(cls, line: str) -> bool:
        s = line.strip()
        return bool(s) and (cls._has("catalog_strong", s) or cls._has("note", s) or cls._has("catalog_weak", s) and not cls._has("sentence_punct", s))

    @classmethod
    def ends_sentence(cls, s: str) -> bool:
        return cls._has("end_punct", s)

    @classmethod
    def layout(cls, line: str) -> bool:
        s = line.strip()
        v = "".join(s.split())
        return bool(s) and not cls.block_start(s) and not cls.ends_sentence(s) and (len(v) < LAYOUT_MAX or cls._has("latin_digit", v))

    @classmethod
    def keeps_break(cls, line: str) -> bool:
        s = line.strip()
        bare = s.lstrip("> \t\u3000") if s.startswith(">") else s
        verse = bool(bare) and not cls.block_start(bare) and len("".join(bare.split())) <= VERSE_MAX and not cls.ends_sentence(bare)
        return verse or bool(s) and not cls.block_start(s) and cls.entry_or_note(line)
