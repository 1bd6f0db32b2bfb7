r"""Problem 4: markup residue in block texts.

A block's text is parsed into a tree: the root is the block, every sign that
could be markup is a node below the sign pair that encloses it, and carries its
notation (html, markdown, wiki, latex). Each node is residue or content; the
labels form a tree-structured graphical model with a potential per
parent-child edge and one per observed feature of a node. Sum-product messages
run upward and downward once, which is exact on a tree, and give each node its
marginal. Potentials are estimated by counting on labelled pages that are
generated here (residue in every notation, and signs of the author or the
printed page as content).

A block's own notation (the ``#`` of a heading, the ``- `` of a list item, the
``[^n]:`` of a footnote) is taken off before parsing.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTATIONS = ("html", "markdown", "wiki", "latex")
#: Kinds that are markup by themselves, or have none of their own that could be left over.
NEVER = ("code", "equation", "table", "image")

# HTML element names.
TAGS = frozenset(
    "a abbr address article aside b bdi bdo big blockquote body br caption center cite code col colgroup dd del details dfn div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd label li link main mark meta nav ol p pre q "
    "rp rt ruby s samp script section small span strike strong style sub summary sup table tbody td tfoot th thead title tr tt u ul var video wbr".split()
)
# Wiki elements written as tags.
WIKI_TAGS = frozenset("ref references nowiki gallery noinclude includeonly onlyinclude poem syntaxhighlight math".split())
# Named character entities met in text.
ENTITIES = frozenset(k.rstrip(";") for k in html.entities.html5)
# LaTeX commands of running text and formulas.
COMMANDS = frozenset(
    "begin end item section subsection subsubsection chapter part paragraph label ref eqref pageref cite citep citet footnote footnotemark footnotetext emph "
    "textbf textit texttt textsc textsf textrm textup textsl text underline mathbf mathrm mathit mathcal mathbb frac dfrac tfrac sqrt sum int prod lim "
    "ldots dots cdots cdot times le leq ge geq ne neq approx equiv sim infty partial nabla alpha beta gamma delta epsilon varepsilon zeta eta theta "
    "iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega left right "
    "quad qquad noindent par newline linebreak newpage clearpage hspace vspace hfill vfill centering includegraphics caption title author maketitle "
    "tableofcontents bibliography usepackage documentclass href url large Large small tiny bf it em rm sc tt to rightarrow leftarrow in subset cup cap "
    "forall exists hat bar vec overline tag".split()
)

_NODE = re.compile(
    r"""(?P<md_fence>^[ ]{0,3}(?:```|~~~)[^\n]*$)
    |(?P<html_comment><!--.*?-->)
    |(?P<tag></?[A-Za-z][A-Za-z0-9]*(?:\s[^<>\n]*)?/?>)
    |(?P<html_entity>&(?:[A-Za-z][A-Za-z0-9]{1,30}|\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6});)
    |(?P<latex_quote>``[^`'\n]+'')
    |(?P<latex_display>\\[\[\]()])
    |(?P<latex_command>\\[A-Za-z]+\*?)
    |(?P<md_escape>\\[*_`\[\]>~!|-])
    |(?P<latex_escape>\\[&%$\#{}\\,;])
    |(?P<latex_dollar>\$\$[^$]+\$\$|\$[^$\n]+\$)
    |(?P<wiki_template>\{\{[^{}\n]+\}\})
    |(?P<wiki_link>\[\[[^\[\]\n]+\]\])
    |(?P<md_image>!\[[^\[\]\n]*\]\([^()\n]*\))
    |(?P<md_link>\[[^\[\]\n]+\](?:\([^()\s]+(?:\s"[^"\n]*")?\)|\[[^\[\]\n]*\]))
    |(?P<md_note>\[\^[^\[\]\s]+\](?::(?=\s))?)
    |(?P<md_definition>^[ ]{0,3}\[[^\[\]\n^]+\]:[ ]+\S+[ ]*$)
    |(?P<wiki_quote>'{2,5}(?=[^'\s])[^'\n]*(?:'[^'\n]+)*?'{2,5})
    |(?P<wiki_heading>^=+[ ]*[^=\n]+?[ ]*=+[ ]*$|(?<=\s)=+\s[^=\n]+\s=+(?=\s))
    |(?P<wiki_table>^[ ]*(?:\{\|[^\n]*|\|\}|\|-+[^\n|]*$))
    |(?P<wiki_cell>\|\|)
    |(?P<md_rule>^[ ]{0,3}\|?[ ]*:?-{3,}:?[ ]*(?:\|[ ]*:?-+:?[ ]*)*\|?[ ]*$|^={3,}[ ]*$)
    |(?P<md_row>^[ ]{0,3}\|[^|\n]+\|(?!\|)[^\n]*\|[ ]*$)
    |(?P<md_code>(?<!`)`[^`\n]+`(?!`))
    |(?P<md_strong>\*\*(?=\S)[^*\n]+?(?<=\S)\*\*|(?<!\w)__(?=\S)[^_\n]+?(?<=\S)__(?!\w))
    |(?P<md_strike>~~(?=\S)[^~\n]+?(?<=\S)~~)
    |(?P<md_emphasis>(?<![\w*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?!\*)|(?<!\w)_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?!\w))
    |(?P<md_heading>^[ ]{0,3}\#{1,6}[ \t]+\S[^\n]*$)
    |(?P<wiki_list>^[\#*:;]+(?=[^\s\#*:;])[^\n]*$)
    |(?P<md_quote>^[ ]{0,3}>[ ]?(?=\S)[^\n]*$)
    |(?P<md_item>^[ ]*[-+*][ ]+\S[^\n]*$)
    |(?P<md_number>^[ ]{0,3}\d{1,3}[.)][ ]+\S[^\n]*$)""",
    re.M | re.X | re.S,
)
#: Whole-line constructs hold other nodes; their text is scanned again.
_WRAPS = {"md_heading", "md_quote", "md_item", "md_number", "wiki_list", "wiki_heading", "md_row", "md_strong", "md_emphasis", "md_strike", "wiki_quote", "latex_quote", "md_link", "wiki_link", "wiki_template"}
#: What a text must hold for any node to be found in it (used before Python).
SIGNS = r"[<&\\$\[{*_`~|#>]|''|(?m)^[ ]*[-+=:;]|(?m)^[ ]{0,3}\d{1,3}[.)] |\s=\s"
OWN = {"heading": re.compile(r"^#{1,6}[ \t]+"), "list_item": re.compile(r"^[ ]*(?:[-*+]|\d{1,3}[.)])[ \t]+"), "footnote": re.compile(r"^\[\^[^\]\s]+\]:[ \t]?")}

_ARGUMENT = re.compile(r"\{([^{}\n]*)\}")
_DIGITS = re.compile(r"[\s\d.,;:/–—-]*\Z")
_MATH = re.compile(r"[\\^_{}=<>+]|^\s*[A-Za-z](?:\s*\(\w\))?\s*$")


def notation(construct: str, text: str) -> str:
    head, _, _ = construct.partition("_")
    if construct == "tag":
        name = re.match(r"</?([A-Za-z0-9]+)", text)[1].lower()
        return "wiki" if name in WIKI_TAGS else "html"
    return {"md": "markdown"}.get(head, head)


def _side(c: str) -> str:
    if not c:
        return "edge"
    if c.isspace():
        return "line" if c == "\n" else "space"
    if c.isascii():
        return "word" if c.isalnum() else "path" if c in ":\\/" else "sign"
    return "letter" if c.isalpha() else "sign"


def _inner(construct: str, text: str) -> str:
    body = text
    if construct in ("latex_dollar",):
        body = text.strip("$")
        if _DIGITS.match(body) or re.match(r"\d[\d.,]*\W", body):
            return "number"
        return "math" if _MATH.search(body) else "words"
    if construct in ("md_item", "wiki_list", "md_quote", "md_heading", "md_number"):
        body = re.sub(r"^[\s\-+*#>:;]*(?:\d{1,3}[.)] )?" if construct == "md_number" else r"^[\s\-+*#>:;]*", "", text)
        if re.search(r"^\s*([*-])(?:\s*\1)+\s*$", text) or not body:
            return "break"
        if re.match(r"^\s*-\s[^\n]*\s-\s*$", text) or re.match(r"^\s*\*\s[^\n]*\s\*\s*$", text):
            return "framed"
    elif construct in ("wiki_heading",):
        body = text.strip("= ")
    if _DIGITS.match(body):
        return "number"
    if construct == "md_rule":
        return "table" if "|" in text else "line"
    return "words" if re.search(r"[^\W\d_]", body) else "signs"


def _features(construct: str, text: str, left: str, right: str, paired: bool) -> tuple[str, str, str, str, str]:
    name = "-"
    if construct == "tag":
        tag = re.match(r"</?([A-Za-z0-9]+)", text)[1].lower()
        name = "known" if tag in TAGS or tag in WIKI_TAGS else "unknown"
    elif construct == "latex_command":
        name = "known" if text[1:].rstrip("*") in COMMANDS else "unknown"
    elif construct == "html_entity":
        name = "known" if text[1] == "#" or text[1:-1] in ENTITIES else "unknown"
    return name, _inner(construct, text), _side(left), _side(right), "paired" if paired else "single"


_SERIES = {"md_item": re.compile(r"[ ]*[-+*][ ]+(?=\S)(?![^\n]*\s[-*]\s*$)"), "md_number": re.compile(r"[ ]{0,3}\d{1,3}[.)][ ]+\S")}


def _in_series(text: str, n: "Node") -> bool:
    """Whether the line before or after is an item too."""
    before = text.rfind("\n", 0, max(0, n.start - 1)) + 1
    after = text.find("\n", n.start)
    item = _SERIES[n.construct]
    return bool(n.start > 0 and item.match(text, before) or after >= 0 and item.match(text, after + 1))


class Node:
    __slots__ = ("start", "end", "construct", "notation", "features", "parent", "children", "text")

    def __init__(self, start: int, end: int, construct: str, text: str):
        self.start, self.end, self.construct, self.text = start, end, construct, text
        self.notation = notation(construct, text) if construct != "root" else ""
        self.features: tuple[str, ...] = ()
        self.parent: Node | None = None
        self.children: list[Node] = []


def parse(text: str) -> list[Node]:
    """Nodes in document order, the root first; each has its parent set."""
    found: list[Node] = []

    def scan(lo: int, hi: int) -> None:
        at = lo
        while at < hi:
            m = _NODE.search(text, at, hi)
            if m is None:
                return
            kind = m.lastgroup
            s, e = m.span()
            found.append(Node(s, e, kind, m.group()))
            if kind in _WRAPS and e - s > 2:
                lead = 1 if kind not in ("md_strong", "md_strike", "wiki_quote", "wiki_link", "wiki_template", "latex_quote") else 2
                body = re.match(r"[ ]*(?:[#*:;>+=\-|]+|\d+[.)])[ ]*", text[s:e]) if text[s:e][:1] in " #*:;>+-=|0123456789" and kind not in ("md_strong", "md_emphasis") else None
                inner = s + (body.end() if body and body.end() else lead)
                tail = 2 if kind in ("md_strong", "md_strike", "wiki_quote", "wiki_link", "wiki_template", "latex_quote") else 0 if body else 1
                if inner < e - tail:
                    scan(inner, e - tail)
            at = max(e, at + 1)

    scan(0, len(text))
    found.sort(key=lambda n: (n.start, -n.end))
    root = Node(0, len(text), "root", "")
    root.features = ("-", "-", "-", "-", "-")
    # pairs of signs (elements, environments, fences, displays) enclose what lies between them
    open_at: dict[str, list[int]] = defaultdict(list)
    pair: dict[int, int] = {}
    for i, n in enumerate(found):
        key, closes = "", False
        if n.construct == "tag":
            m = re.match(r"<(/?)([A-Za-z0-9]+)", n.text)
            key, closes = "<" + m[2].lower(), bool(m[1])
        elif n.construct == "latex_display":
            key, closes = "\\" + ("[" if n.text[1] in "[]" else "("), n.text[1] in "])"
        elif n.construct == "latex_command" and n.text in ("\\begin", "\\end"):
            env = _ARGUMENT.match(text, n.end)
            key, closes = "env" + (env[0] if env else ""), n.text == "\\end"
        elif n.construct == "md_fence":
            key = "fence"
            closes = bool(open_at[key])
        elif n.construct == "wiki_table" and n.text.lstrip()[:2] in ("{|", "|}"):
            key, closes = "wt", n.text.lstrip()[:2] == "|}"
        if key:
            if closes and open_at[key]:
                j = open_at[key].pop()
                pair[i], pair[j] = j, i
            elif not closes:
                open_at[key].append(i)
    stack: list[tuple[int, Node]] = [(len(text) + 1, root)]
    for i, n in enumerate(found):
        while stack[-1][0] <= n.start and len(stack) > 1:
            stack.pop()
        n.parent = stack[-1][1]
        n.parent.children.append(n)
        n.features = _features(n.construct, n.text, text[n.start - 1 : n.start], text[n.end : n.end + 1], i in pair or n.construct not in ("tag", "latex_display", "md_fence"))
        if n.construct in _SERIES and n.features[1] == "words" and _in_series(text, n):
            n.features = (n.features[0], "series", *n.features[2:])
        stop = found[pair[i]].start if i in pair and pair[i] > i else n.end
        stack.append((stop, n))
    return [root, *found]


class TreeModel:
    """Directed tree: label given parent's label and edge, features given label and construct."""

    #: pseudo-counts
    ALPHA = 0.5

    def __init__(self) -> None:
        self.edge: dict[tuple, list[float]] = defaultdict(lambda: [self.ALPHA, self.ALPHA])
        self.kind: dict[str, list[float]] = defaultdict(lambda: [self.ALPHA, self.ALPHA])
        self.feature: dict[tuple, list[float]] = defaultdict(lambda: [self.ALPHA / 2, self.ALPHA / 2])
        self.total = [0.0, 0.0]

    @staticmethod
    def _edge(n: Node) -> tuple:
        p = n.parent
        return ("root",) if p.construct == "root" else ("same" if p.notation == n.notation else "other",)

    def count(self, nodes: list[Node], labels: list[int]) -> None:
        of = {id(n): y for n, y in zip(nodes, labels, strict=True)}
        for n, y in zip(nodes[1:], labels[1:], strict=True):
            self.edge[(*self._edge(n), of[id(n.parent)])][y] += 1
            self.kind[n.construct][y] += 1
            self.total[y] += 1
            for k, v in enumerate(n.features):
                self.feature[(n.construct, k, v)][y] += 1

    def _emit(self, n: Node) -> tuple[float, float]:
        kind = self.kind.get(n.construct, (self.ALPHA, self.ALPHA))
        out = []
        for y in (0, 1):
            like = kind[y] / (self.total[y] + 1)
            for k, v in enumerate(n.features):
                like *= self.feature.get((n.construct, k, v), (self.ALPHA / 2, self.ALPHA / 2))[y] / (kind[y] + 2 * self.ALPHA)
            out.append(like)
        s = sum(out) or 1.0
        return out[0] / s, out[1] / s

    def _step(self, n: Node, yp: int) -> tuple[float, float]:
        a, b = self.edge.get((*self._edge(n), yp), (self.ALPHA, self.ALPHA))
        return a / (a + b), b / (a + b)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(residue) of each node; nodes come parents first. The root is content."""
        if len(nodes) == 1:
            return [0.0]
        at = {id(n): i for i, n in enumerate(nodes)}
        own = [(1.0, 0.0), *(self._emit(n) for n in nodes[1:])]
        step = [None, *((self._step(n, 0), self._step(n, 1)) for n in nodes[1:])]
        below = [list(x) for x in own]
        up: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # upward
            m = [sum(step[i][yp][y] * below[i][y] for y in (0, 1)) for yp in (0, 1)]
            s = sum(m) or 1.0
            up[i] = (m[0] / s, m[1] / s)
            p = below[at[id(nodes[i].parent)]]
            p[0] *= up[i][0]
            p[1] *= up[i][1]
            t = p[0] + p[1]
            if 0 < t < 1e-100:
                p[0], p[1] = p[0] / t, p[1] / t
        belief: list[tuple[float, float]] = [(1.0, 0.0)] * len(nodes)
        for i in range(1, len(nodes)):  # downward
            j = at[id(nodes[i].parent)]
            above = [belief[j][yp] / up[i][yp] if up[i][yp] else 0.0 for yp in (0, 1)]
            b = [below[i][y] * sum(above[yp] * step[i][yp][y] for yp in (0, 1)) for y in (0, 1)]
            s = sum(b) or 1.0
            belief[i] = (b[0] / s, b[1] / s)
        return [x[1] for x in belief]


# Labelled pages: T stands for words, N for a number, L for a line break, X for a name, E and B for an inline and a block
# element, A for attributes, Y for an entity, K for a command with an argument, M for a formula, w for a file's or variable's
# name; residue in one notation each. They show every construct where writers put it, drawn from the notations' manuals.
PAGES = {
    "html": [
        "T <E>T</E> T", "<E>T</E>", "T<E A>T</E>, T", "<E>T</E> T", "T <E A>T</E>", "<B>T</B>LT", "<B A>T</B> T", "<B A><E>T</E>LT</B>", "T<B>LT", "TL<B A>T", "<B>LTL</B>", "T<br>T", "T<br/>", "T<br />LT",
        "<hr>LT", "T <img A/> T", "T <img A>", "<ul><li>T</li><li>T<li>T</ul>", "<ol>L<li>T</li>L</ol>", "<TABLE><TR><TD>T<TD>N</TABLE>T", "<table A><tr><th>T</th><td>N</td></tr></table>T", "<dl><dt>T<dd>T</dl>",
        "T<!-- T -->T", "<!-- N T -->LT", "T Y T", "TYT", "T Y", "YTY T", "TY TY", "<B>Y</B>LT", "<B><E>Y T</E></B>LT", "T<E>N</E> T", "T<E>N</E>T", "<E A>N</E>", "<E A>T</E>: T", "<E><E>T</E></E> T", "T (<E>T</E>) T",
    ],
    "markdown": [
        "T **T** T", "**T**", "T __T__ T", "__T__ T", "~~T~~ T", "T ~~T~~", "T `T` T", "T `w_N` T", "`T`", "`T` T", "`T`T", "[T](w/w.N) T", "T [T](w.w)", "T ![T](w/N.w) T", "![T](w.w)", "T [T][w] TL[w]: w/N.w", "[T][N]", "# T", "### TLT", "## TLT", "TL# TLT", "TL## T",
        "TL---LT", "TL-----LT", "TL===LT", "TL=====LT", "```LT = w_NL```LT", "```wLTLTL```", "~~~LTL~~~LT", "> TL> TLT", "> T", "TL> T", "TL> TLT", "- TL- T", "TL- TL- T", "TL- TL  - TL- T", "TL* TL* T", "* TL* TLT", "+ TL+ T", "TL+ TL+ TLT", "TL1. TL2. T", "1. TL2. TLT", "TL  - TL  - TLT",
        "| T | T |L|---|---|L| N | T |", "| T | T |L|:--|--:|L| T | T |LT", "T \\* T \\_T\\_ T", "T \\[T\\] T", "T.\\* T", "*T*", "*T* T", "T *T* T", "T _T_ T", "_T_", "### **T**", "**T**: T", "T[^N] T", "T[^w].", "**T** *T*", "T **`T`** T",
    ],
    "wiki": [
        "== T ==LT", "=== T ===", "==T==LT", "= T =LT", "T == T == T", "== T ==L:TL::T", "T [[T]] T", "[[T]]", "[[T]] T", "T [[T|T]] T", "T[[T]]", "T[[File:w.N|T]]", "[[Image:w.w|N|T]] T", "TL[[Category:T]]", "{{T}}", "{{T|T}} T", "T {{T|w=N}} T", "T{{w|T|N}}", "'''T''' T", "T ''T'' T", "''T''", "''T'' T", "T '''T'''",
        "{| AL|-L| T || TL|}", "{|L! TL|-L| NL|}LT", "TL#TL#T", "TL*TL**TL*T", "*TL*TLT", ":T", ":TL::T", "TL:T", ";TL:T", "TL;TL:T", "T<ref>T</ref> T", "T<ref A>T</ref>", "T<ref A/> T", "T<references/>", "<nowiki>T</nowiki> T", "<gallery>LTL</gallery>",
    ],
    "latex": [
        "K", "T K T", "T.K T", "TK", "K T", "KK T", "T \\textbf{K} T", "T \\ldots{} T", "T \\dots T", "\\begin{w}LTL\\end{w}", "\\begin{w}T\\end{w}LT", "\\begin{itemize}L\\item TL\\item TL\\end{itemize}", "TL\\begin{w}L\\item TL\\end{w}LT", "K LT", "TLK", "KLKLT",
        "T $M$ T", "$M$", "T $M$, T", "T $M$.", "$$M$$", "TL$$M$$LT", "T \\(M\\) T", "\\[ M \\]", "\\[ M \\]LT", "\\[LML\\]", "T \\\\ T", "T \\& T", "T \\% T", "N\\% T", "T \\# N", "T \\$N", "T \\_ T", "``T'' T", "T ``T'' T", "T ``T''", "T~K.", "T --- T~K", "T \\\\ T \\& T \\% T",
    ],
    # signs that the author or the printed page carries
    "": [
        "T. (N < N, N > N) T", "T N < N T", "T <X> T", "<X> T", "T. $N, $N. T", "$N T $N T", "T US$N, US$N", "T N * N * N T", "T.* T", "T * T", "* * *", "* * *LT", "***LT", "T. C:\\w\\wN T", "C:\\wN\\w", "T. = N = T", "= N =", "- N -", "TL- N -LT", "- N -LT",
        "T ~N T, ^N T", "T [N] T", "[N]", "T {N; N} T", "T #N T", "#N", "#N T", "T w_w_N T", "T w_w.w T", "[ T ]", "~ T ~", "-- T --", "— T", "T [T] T", "T & T", "AT&T T", "T & T; T", "T | T", "{T}", "T = T", "T > T", "# N", "· T ·", "T **", "T_N T", "TLN. T", "TLN.LT", "[T.] T",
        "T N/N T", "T ^ T", "T ` T", "TL-- TLT", "T <N> T", "\\wN", "T (T) T", "T #N. T", "T: N * N = N", "T_w_N", "~ T, T ~", "T \\w\\w T", "- T -", "* T *", "_N_", "T*N*N", "T ' T'", "T ''", "N) T", "-N T", "+N T", "T: - N", "* T", "**T",
        "T TLN. T T", "T TLN. T, TLT", "TLTLN. T TLT", "T TLN. TLT",
    ],
}
WORDS = ("the old house", "In the morning, it sings.", "la vieille maison", "ein kleines Kind", "el río", "maçã verde", "тихий двор", "小鸟", "我看见了大树。", "古い家", "ねこは水を見た。", "작은 새", "월요일에 문을 열었다.", "Now it rains", "d'un ami")
NAMES = ("Morvath", "Tasquin", "布塔", "Zanova", "オスカ", "라림")
# What the slots of the pages can be, from the notations' manuals.
INLINE = "b i em strong u s small big sub sup span a q cite code kbd font tt mark".split()
BLOCK = "p div h1 h2 h3 h4 blockquote center pre section article li td caption address".split()
ATTRIBUTES = ('class="w"', "id='wN'", 'style="color:w"', 'href="w/N"', 'src="w.w"', 'name="w"', "align=w", 'width="N" height="N"', 'title="w N"')
SIGNS_OF = "amp lt gt quot nbsp mdash ndash hellip copy eacute laquo raquo ldquo rdquo times".split()
ARGUED = "emph textbf textit texttt textsc underline footnote section subsection chapter paragraph cite ref label caption title author url".split()
FORMULAS = ("x_N", "a^N + b^N", "\\frac{N}{b}", "\\sum_{k=N} k", "y = f(x)", "\\alpha \\le \\beta", "n", "p(x)", "\\sqrt{N}", "z < N")


#: Slots of a page; words in capitals that hold such letters stay.
_SLOT = re.compile(r"TABLE|TR|TD|AT&T|US|Category|Image|File|C:|[TLXNEBAYKM]|\bw\b|w(?=[N_.])")


def _fill(slot: str, rng: random.Random, held: dict[str, str]) -> str:
    """What stands for a slot; elements are the same wherever they stand in a page."""
    if slot in ("E", "B"):
        return held.setdefault(slot, rng.choice(INLINE if slot == "E" else BLOCK))
    again = lambda t: re.sub(r"w|N", lambda m: _fill(m.group(), rng, held), t)
    if slot == "T":
        return rng.choice(WORDS)
    if slot == "N":
        return str(rng.randint(1, 120))
    if slot == "L":
        return "\n"
    if slot == "X":
        return rng.choice(NAMES)
    if slot == "A":
        return again(rng.choice(ATTRIBUTES))
    if slot == "Y":
        return rng.choice(("&%s;" % rng.choice(SIGNS_OF), "&#%d;" % rng.randint(34, 9000), "&#x%x;" % rng.randint(34, 9000)))
    if slot == "K":
        return "\\%s%s{%s}" % (rng.choice(ARGUED), rng.choice(("", "", "*")), rng.choice((rng.choice(WORDS), "fig:%d" % rng.randint(1, 90))))
    if slot == "M":
        return re.sub("N", lambda m: str(rng.randint(1, 9)), rng.choice(FORMULAS))
    return rng.choice(("scan", "draft", "page", "item", "files", "node")) if slot == "w" else slot


def filled(page: str, rng: random.Random) -> str:
    held: dict[str, str] = {}
    return _SLOT.sub(lambda m: _fill(m.group(), rng, held), page)


@lru_cache(maxsize=6)
def trained(pages: int = 6000, seed: int = 11, without: int | None = None) -> TreeModel:
    """Potentials counted on generated labelled pages (their number is the bound); without: the fifth of the pages held out."""
    rng = random.Random(seed)
    model = TreeModel()
    kinds = [(n, p) for i, (n, p) in enumerate((n, p) for n, ps in PAGES.items() for p in ps) if i % 5 != without]
    for k in range(pages):
        name, page = kinds[k % len(kinds)]
        text = filled(page, rng)
        nodes = parse(text)
        if name:
            labels = [0] + [1] * (len(nodes) - 1)
        else:
            labels = [0] * len(nodes)
        model.count(nodes, labels)
    return model


def held_out(seed: int = 2, times: int = 5) -> dict[str, float]:
    """Share of pages judged rightly, by notation ('' for signs of the author), each by a model that never saw its form."""
    rng = random.Random(seed)
    right: dict[str, list[bool]] = defaultdict(list)
    for i, (name, page) in enumerate((n, p) for n, ps in PAGES.items() for p in ps):
        model = trained(without=i % 5)
        for _ in range(times):
            nodes = parse(filled(page, rng))
            got = {n.notation for n, x in zip(nodes, model.marginals(nodes), strict=True) if n.notation and x > 0.5}
            right[name].append(got == ({name} if name else set()))
    return {k: round(sum(v) / len(v), 3) for k, v in right.items()}


def _take_own(text: str, kind: str | None) -> str:
    own = OWN.get(kind or "")
    if own is None:
        return text
    m = own.match(text)
    return text[m.end() :] if m else text


def residue(text: str | None, kind: str | None, threshold: float = 0.5) -> tuple[list[Node], list[float], str]:
    """(nodes, marginals, text without the block's own notation); of null, blank or kinds in NEVER nothing."""
    if not text or kind in NEVER:
        return [], [], text or ""
    body = _take_own(text, kind)
    nodes = parse(body)
    return nodes, trained().marginals(nodes), body


def notations(text: str | None, kind: str | None, threshold: float = 0.5) -> list[str]:
    """The notations left in a block's text, sorted."""
    nodes, p, _ = residue(text, kind)
    return sorted({n.notation for n, x in zip(nodes, p, strict=True) if n.notation and x > threshold})


_HEAD = re.compile(r"h([1-6])")


def clean(text: str | None, kind: str | None, threshold: float = 0.5) -> str | None:
    """The text without residue; headings (#), lists (-), code (`) and formulas ($) stay marked one way.

    Null stays null; kinds in NEVER come back unchanged.
    """
    if not text or kind in NEVER:
        return text
    nodes, p, body = residue(text, kind)
    own = text[: len(text) - len(body)]
    edits: list[tuple[int, int, str]] = []

    def swap(n: Node, lead: int, tail: int, a: str = "", b: str = "") -> None:
        edits.append((n.start, n.start + lead, a))
        edits.append((n.end - tail, n.end, b))

    for n, x in zip(nodes[1:], p[1:], strict=True):
        if x <= threshold:
            continue
        c, t = n.construct, n.text
        if c == "tag":
            m = re.match(r"<(/?)([A-Za-z0-9]+)", t)
            shut, name = bool(m[1]), m[2].lower()
            h = _HEAD.fullmatch(name)
            new = ""
            if h:
                new = "\n" if shut else "#" * int(h[1]) + " "
            elif name == "li" and not shut:
                new = "\n- "
            elif name in ("br", "p", "div", "tr", "ul", "ol", "table"):
                new = "\n"
            elif name in ("td", "th") and not shut:
                new = " | "
            elif name == "code":
                new = "`"
            elif name == "ref":
                new = ")" if shut else " (" if not t.endswith("/>") else ""
            edits.append((n.start, n.end, new))
        elif c == "html_comment":
            edits.append((n.start, n.end, " "))
        elif c == "html_entity":
            edits.append((n.start, n.end, html.unescape(t).replace("\xa0", " ")))
        elif c in ("md_strong", "md_strike"):
            swap(n, 2, 2)
        elif c == "md_emphasis":
            swap(n, 1, 1)
        elif c == "wiki_quote":
            k = len(t) - len(t.lstrip("'"))
            swap(n, k, min(k, len(t) - len(t.rstrip("'"))))
        elif c == "latex_quote":
            swap(n, 2, 2, '"', '"')
        elif c in ("md_image", "md_link"):
            m = re.match(r"!?\[([^\[\]]*)\]", t)
            edits += [(n.start, n.start + t.index("[") + 1, ""), (n.start + m.end() - 1, n.end, "")]
        elif c in ("md_definition", "wiki_table", "md_rule"):
            edits.append((n.start, n.end, ""))
        elif c == "wiki_link":
            inner = t[2:-2]
            last = inner.rfind("|") + 1 or (inner.find(":") + 1 if re.match(r"(?:Category|File|Image):", inner) else 0)
            edits += [(n.start, n.start + 2 + last, ""), (n.end - 2, n.end, "")]
        elif c == "wiki_template":
            part = [q for q in t[2:-2].split("|")[1:] if "=" not in q]
            edits.append((n.start, n.end, part[0] if part else ""))
        elif c == "wiki_heading":
            k = len(t) - len(t.lstrip("="))
            edits += [(n.start, n.start + k, "#" * k), (n.end - (len(t) - len(t.rstrip("= "))), n.end, "")]
        elif c == "wiki_list":
            k = len(t) - len(t.lstrip("#*:;"))
            edits.append((n.start, n.start + k, "" if t[0] in ":;" else "  " * (k - 1) + "- "))
        elif c == "wiki_cell":
            edits.append((n.start, n.end, "|"))
        elif c == "md_quote":
            edits.append((n.start, n.start + t.index(">") + 1 + (t[t.index(">") + 1 : t.index(">") + 2] == " "), ""))
        elif c in ("md_escape", "latex_escape"):
            edits.append((n.start, n.end, "\n" if t == "\\\\" else t[1:]))
        elif c == "latex_display":
            edits.append((n.start, n.end, "$$" if t[1] in "[]" else "$"))
        elif c == "latex_command" and not any(a <= n.start < b for a, b in _formulas(nodes)):
            arg = _ARGUMENT.match(body, n.end)
            size = arg.end() - arg.start() if arg else 0
            name = t[1:].rstrip("*")
            if name in ("begin", "end", "label", "ref", "cite", "footnotemark", "citep", "citet", "eqref", "pageref"):
                edits.append((n.start, n.end + size, ""))
            else:
                edits.append((n.start, n.end, {"item": "- ", "ldots": "…", "section": "# ", "chapter": "# ", "subsection": "## ", "footnote": " ("}.get(name, "")))
                if arg and name not in ("item",):
                    edits += [(n.end, n.end + 1, ""), (n.end + size - 1, n.end + size, ")" if name == "footnote" else "")]
    edits.sort()
    out, at = [], 0
    for a, b, new in edits:
        if a < at:
            continue
        out += [body[at:a], new]
        at = b
    return own + re.sub(r"\n{3,}", "\n\n", "".join([*out, body[at:]])).strip("\n")


def _formulas(nodes: list[Node]) -> list[tuple[int, int]]:
    spans = [(n.start, n.end) for n in nodes if n.construct == "latex_dollar"]
    open_ = None
    for n in nodes:
        if n.construct == "latex_display":
            if n.text[1] in "[(":
                open_ = n.start
            elif open_ is not None:
                spans.append((open_, n.end))
                open_ = None
    return spans


_NOTES = T.ArrayType(T.StringType())


def _notation_udf(model_pages: int = 6000):
    @F.pandas_udf(_NOTES)
    def run(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([notations(t, k) if isinstance(t, str) else None for t, k in zip(texts, kinds, strict=True)])

    return run


@F.pandas_udf(T.StringType())
def _clean_udf(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([clean(t, k) if isinstance(t, str) else None for t, k in zip(texts, kinds, strict=True)])


def _candidate(text: Column, kind: Column) -> Column:
    """Rows whose text, without the block's own notation, holds any sign a node could start with."""
    body = (
        F.when(kind == "heading", F.regexp_replace(text, r"^#{1,6}[ \t]+", ""))
        .when(kind == "list_item", F.regexp_replace(text, r"^ *(?:[-*+]|\d{1,3}[.)])[ \t]+", ""))
        .when(kind == "footnote", F.regexp_replace(text, r"^\[\^[^\]\s]+\]:[ \t]?", ""))
        .otherwise(text)
    )
    return text.isNotNull() & ~F.coalesce(kind, F.lit("")).isin(*NEVER) & body.rlike(SIGNS)


def residue_rows(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, markup): one row for each notation left in a block's text.

    Texts without any sign have a tree of one root and never leave the JVM. Repeated
    deliveries give one row; null texts and kinds in NEVER give none.
    """
    b = blocks.select("doc_id", "block_id", "kind", "text").where(_candidate(F.col("text"), F.col("kind")))
    found = b.select("doc_id", "block_id", F.explode(_notation_udf()(F.col("text"), F.col("kind"))).alias("markup"))
    return found.distinct()


def cleaned(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, kind, clean_text) of every delivered block once."""
    b = blocks.select("doc_id", "block_id", "kind", "text")
    new = _clean_udf(F.when(_candidate(F.col("text"), F.col("kind")), F.col("text")), F.col("kind"))
    return b.select("doc_id", "block_id", "kind", F.coalesce(new, F.col("text")).alias("clean_text")).dropDuplicates(["doc_id", "block_id"])
