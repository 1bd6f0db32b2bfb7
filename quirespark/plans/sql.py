"""DuckDB equivalents of the core queries, on the same tables."""

from __future__ import annotations

from ..functions import scalars as S
from ..functions.text import HEAD_MAX, HEAD_REPEATS, JOIN_MIN, LAYOUT_MAX, PATTERNS, VERSE_MAX, WS
from ..operators.metadata import BLANK_DOC, SCAN_NAME, STRUCT_HEADINGS
from ..operators.rules import ATOMIC, POLICY, TRAILING_SKIP
from ..operators.structure import _TOC


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def sub(x: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$")


def visible(x: str) -> str:
    return sub(x, f"{WS}+")


def block_start(s: str) -> str:
    return has(s, PATTERNS["block_start"])


def catalog(line: str) -> str:
    s = strip(line)
    return f"({s} <> '' AND ({has(s, PATTERNS['catalog_strong'])} OR ({has(s, PATTERNS['catalog_weak'])} AND NOT {has(s, PATTERNS['sentence_punct'])})))"


def note(line: str) -> str:
    return has(strip(line), PATTERNS["note"])


def ends(s: str) -> str:
    return has(s, PATTERNS["end_punct"])


def verse(line: str) -> str:
    s = strip(sub(strip(line), f"^(>{WS}*)+"))
    return f"({s} <> '' AND NOT {block_start(s)} AND length({visible(s)}) <= {VERSE_MAX} AND NOT {ends(s)})"


def keeps(line: str) -> str:
    s = strip(line)
    return f"({verse(line)} OR ({s} <> '' AND NOT {block_start(s)} AND ({catalog(line)} OR {note(line)})))"


def page_mark(line: str) -> str:
    return has(strip(line), PATTERNS["page_mark"])


def page_number(line: str) -> str:
    return f"({has(line, PATTERNS['page_number'])} OR {has(line, PATTERNS['page_number_cjk'])})"


def head(s: str) -> str:
    return (
        f"(length({s}) BETWEEN 1 AND {HEAD_MAX} AND NOT {block_start(s)} AND NOT {has(s, r'[\[\]]')} AND NOT {catalog(s)} AND NOT {note(s)} "
        f"AND NOT {ends(s)} AND NOT {has(s, PATTERNS['all_digits'])} AND {has(s, PATTERNS['word_char'])})"
    )


def quoted(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


B = (
    'b AS (SELECT doc_id, block_id, max(ord) AS ord, max(kind) AS kind, max(heading_level) AS "level", max(text) AS text, max(trailer) AS trailer, '
    "max(page_idx) AS page_idx FROM blocks GROUP BY doc_id, block_id)"
)
DL = "dl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)"
EDITABLE = f"coalesce(kind, '') NOT IN {quoted(ATOMIC)} AND text IS NOT NULL AND NOT {page_mark('text')}"
BL = f"bl AS (SELECT doc_id, block_id, ord, kind, text, string_split(text, chr(10)) AS ls FROM b WHERE {EDITABLE})"
VERSE_BLOCK = f"(len(list_filter(ls, lambda s: {strip('s')} <> '')) >= 2 AND len(list_filter(ls, lambda s: {strip('s')} <> '' AND {verse('s')})) * 2 >= len(list_filter(ls, lambda s: {strip('s')} <> '')))"
KEPT = "CASE WHEN len(k) = 0 THEN 'delete_block' ELSE 'replace_text' END AS operation, CASE WHEN len(k) > 0 THEN array_to_string(k, chr(10)) END AS after_text"
TITLE = strip(sub(strip("text"), "^#+"))
H = f"""h AS (SELECT doc_id, block_id, ord, text, "level", {TITLE} AS title FROM b WHERE kind = 'heading' AND "level" IS NOT NULL AND text IS NOT NULL)"""
M = "m AS (SELECT doc_id, item_no, max(item_type) AS item_type, max(text) AS text, max(page_idx) AS page_idx, max(text_level) AS text_level FROM page_markers GROUP BY doc_id, item_no)"
EV = (
    "ev AS (SELECT doc_id, item_no AS ev_ord, CASE WHEN text_level IS NOT NULL THEN 'heading' ELSE coalesce(CASE item_type WHEN 'text' THEN 'text' WHEN 'header' THEN 'header' WHEN 'footer' THEN 'footer' WHEN 'page_number' THEN 'page_number' END, 'unknown') END AS kind, text, page_idx FROM m)"
)
META = "meta AS (SELECT doc_id, max(source) AS source, max(backend) AS backend, max(total_pages) AS total_pages FROM doc_meta GROUP BY doc_id)"
BOOKS = "bk AS (SELECT doc_id, max(title) AS title, max(author) AS author, max(lang) AS lang FROM book_meta GROUP BY doc_id)"

HEADS = f"heads AS (SELECT doc_id, head, count(*) AS n FROM (SELECT doc_id, {strip('l')} AS head FROM (SELECT doc_id, unnest(ls) AS l FROM bl WHERE NOT {VERSE_BLOCK})) WHERE {head('head')} GROUP BY doc_id, head HAVING count(*) >= {HEAD_REPEATS})"
BASE = f"""base AS (
  SELECT doc_id, CASE WHEN (base > 3 AND n > 1) OR lowest < base THEN NULL ELSE base END AS base FROM (
    SELECT *, CASE WHEN n = 1 THEN lowest WHEN parts >= 2 THEN part_level WHEN chapters >= 2 THEN chapter_level WHEN n < 3 THEN NULL WHEN n <= 4 THEN lowest WHEN at_lowest >= 3 THEN lowest END AS base FROM (
      SELECT doc_id, sum(n) AS n, sum(parts) AS parts, sum(chapters) AS chapters, min("level") AS lowest, arg_min(n, "level") AS at_lowest,
        arg_max("level", parts * 100 - "level") FILTER (parts > 0) AS part_level, arg_max("level", chapters * 100 - "level") FILTER (chapters > 0) AS chapter_level
      FROM (SELECT doc_id, "level", count(*) AS n, count(*) FILTER ({has('title', PATTERNS['part'])}) AS parts, count(*) FILTER ({has('title', PATTERNS['chapter'])} AND NOT {has('title', PATTERNS['part'])}) AS chapters FROM h WHERE title <> '' GROUP BY doc_id, "level") GROUP BY doc_id)))"""
IMG = S.IMAGE
UNF = lambda t: sub(t, S.FENCE)


def counters(t: str) -> str:
    u = UNF(t)
    body = sub(sub(sub(sub(sub(sub(u, "(?s)<!--.*?-->"), IMG), r"(?i)</?br[ \t]*/?>"), r"\[([^\]\n]+)\]\([^)\n]+\)", r"\1"), r"(?m)^#{1,6}[ \t]*"), r"[*_`>|#]")
    return f"""len(list_distinct(list_transform(regexp_extract_all({t}, {q(IMG)}, 1), lambda r: regexp_replace(r, '^.*[/\\\\]', '')))) AS images,
  {count(u, r"(?s)\$\$.+?\$\$")} + {count(sub(u, r"(?s)\$\$.+?\$\$"), r"\$[^$\n]+\$")} AS math, length({visible(body)}) AS chars, {count(t, r"(?m)^#{1,6}[ \t]+[^ \t\n]")} AS headings,
  {count(u, r"(?m)[^ \n] {2,}$")} + {count(u, r"(?i)</?br[ \t]*/?>")} AS breaks, {count(u, r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$")} AS tables,
  {count(t, "(?m)^```")} // 2 AS code, len(list_distinct(regexp_extract_all({u}, {q(r"(?m)^\[\^([^\]\s]+)\]:")}, 1))) AS footnotes, {count(sub(u, IMG), r"\[[^\]\n]+\]\([^)\n]+\)")} AS links"""


PAGES = r"""len(list_distinct(regexp_extract_all(text, '<!--\s*page\s+(\d+)(?:\s+ocr)?\s*-->', 1)))"""
NOTED = """np AS (SELECT doc_id, k - 13 AS line_no, CASE WHEN k % 6 = 1 THEN 'Text' || m || ' goes on' WHEN k % 6 = 4 THEN m || ' note ' || k ELSE 'plain' END AS line, -1 AS page FROM (SELECT doc_id, unnest(range(1, 13)) AS k, (['①', '②', '③'])[doc_id % 3 + 1] AS m FROM documents WHERE text IS NOT NULL)),
nl AS (SELECT doc_id, line_no, line, page FROM np UNION ALL SELECT doc_id, line_no, line, CASE WHEN mark IS NULL AND trim(line) <> '' THEN page END FROM lp),
nr AS (SELECT doc_id, line_no, page, generate_subscripts(regexp_extract_all(line, '[①-⑳]'), 1) - 1 AS "at", unnest(regexp_extract_all(line, '[①-⑳]')) AS marker FROM nl WHERE NOT regexp_matches(trim(line), '^[①-⑳]') AND regexp_matches(line, '[①-⑳]')),
nn AS (SELECT doc_id, line_no, page, substring(trim(line), 1, 1) AS marker FROM nl WHERE regexp_matches(trim(line), '^[①-⑳]'))"""
TARGETS = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, patch_id ORDER BY created_at, ingested_at) AS rn FROM patches) WHERE rn = 1)"
AUTO = quoted([r for r, _, a in POLICY if a])
DECIDED = f"""g AS (
  SELECT p.doc_id, p.patch_id, p.rule_id, p.operation, p.target_block_id AS block_id, p.created_at, p.before_text, p.after_text, CASE
    WHEN patch_status IN ('suggested', 'skipped', 'rejected', 'unknown') THEN patch_status || ':' || coalesce(skip_reason, '')
    WHEN rule_id IS NULL OR operation NOT IN ('replace_text', 'delete_block', 'set_level', 'noop', 'set_prefix', 'merge_blocks') THEN 'unknown:unknown_rule'
    WHEN b.text IS NULL THEN CASE WHEN operation = 'delete_block' THEN 'skipped:already_applied' ELSE 'failed:target_missing' END
    WHEN operation = 'replace_text' AND b.text = after_text THEN 'skipped:already_applied'
    WHEN NOT coalesce(sha256(b.text) = before_sha256, false) THEN 'failed:before_mismatch'
    WHEN confidence = 'heuristic' AND rule_id NOT IN {AUTO} THEN 'suggested:evidence_insufficient'
    WHEN operation IN ('delete_block', 'merge_blocks') AND NOT (operation = 'delete_block' AND coalesce(confidence IN ('explicit', 'derived'), false)) THEN 'suggested:evidence_insufficient'
    WHEN operation = 'replace_text' AND after_text = before_text THEN 'skipped:no_change'
    WHEN operation = 'merge_blocks' THEN 'rejected:merge_not_supported'
    ELSE 'applied:' END AS g
  FROM p LEFT JOIN b ON p.doc_id = b.doc_id AND p.target_block_id = b.block_id),
g2 AS (SELECT *, coalesce(sum((g = 'applied:')::INT) OVER (PARTITION BY doc_id, block_id ORDER BY created_at, patch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_n FROM g),
dec AS (SELECT * REPLACE (CASE WHEN g = 'applied:' AND before_n > 0 THEN 'failed:before_mismatch' ELSE g END AS g) FROM g2),
d AS (SELECT *, split_part(g, ':', 1) AS status, nullif(split_part(g, ':', 2), '') AS reason FROM dec)"""
CLEAN = lambda c: strip(sub(f"coalesce({c}, '')", f"{WS}+", " "))
JUNK = lambda c: f"(length({CLEAN(c)}) < 2 OR NOT {has(CLEAN(c), r'\p{L}')} OR {has(CLEAN(c), SCAN_NAME)} OR {has(CLEAN(c), BLANK_DOC)})"
STRUCT = lambda c: f"({sub(c, rf'({WS}|[\p{{Nd}}.、,，:：])+')} IN {quoted(STRUCT_HEADINGS)} OR {has(c, PATTERNS['part'])} OR {has(c, PATTERNS['chapter'])})"
ANCHOR = lambda enforce: f"""(CASE WHEN kind = 'image' THEN '' WHEN length({visible("a0")}) >= {("CASE WHEN kind = 'heading' THEN %d ELSE %d END" % (S.MIN_HEADING, S.MIN_PREFIX)) if enforce else 1} THEN substring({visible("a0")}, 1, {S.ANCHOR}) ELSE '' END)"""
A0 = f"""CASE WHEN kind = 'heading' THEN {sub('text', f'^#+{WS}*')} WHEN kind = 'footnote' THEN {sub('text', rf'^\[\^[^\]\s]+\]:{WS}*')} ELSE text END"""
CAND = f"""ba AS (SELECT doc_id, ord, {ANCHOR(True)} AS a FROM (SELECT doc_id, ord, kind, {A0} AS a0 FROM b WHERE text IS NOT NULL)),
ea AS (SELECT doc_id, ev_ord, page_idx, {ANCHOR(False)} AS a FROM (SELECT doc_id, ev_ord, page_idx, kind, {A0} AS a0 FROM ev WHERE text IS NOT NULL)),
cand AS (SELECT ba.doc_id, ord, ev_ord, 1 AS tier, page_idx FROM ba JOIN ea ON ba.doc_id = ea.doc_id AND ba.a = ea.a WHERE ba.a <> ''
UNION ALL SELECT ba.doc_id, ord, ev_ord, 2 AS tier, page_idx FROM ba JOIN ea ON ba.doc_id = ea.doc_id AND substring(ba.a, 1, {S.MIN_PREFIX}) = substring(ea.a, 1, {S.MIN_PREFIX}) AND ba.a <> ea.a WHERE length(ba.a) >= {S.MIN_PREFIX} AND length(ea.a) >= {S.MIN_PREFIX})"""
KEY = lambda c: f"lower({sub(c, r'[^\p{L}\p{N}]+')})"
WORK = lambda c: sub(sub(strip(c), f"{WS}+", "_"), r'[\\/:*?"<>|]+', "_")
OUT = lambda c: strip(sub(sub(strip(c), r'[\\/:*?"<>|]+', "_"), "[. ]+$"))
OR_BOOK = lambda x: f"CASE WHEN {x} = '' THEN 'book' ELSE {x} END"
ISSUES = """issues AS (SELECT doc_id, unnest(list_filter([
  CASE WHEN t.images < s.images THEN 'content_images_lost:error' END, CASE WHEN t.images > s.images THEN 'content_images_extra:warning' END,
  CASE WHEN s.math > 0 AND t.math = 0 THEN 'content_math_lost:error' END, CASE WHEN t.math > 0 AND t.math < s.math * 0.5 THEN 'content_math_shrunk:warning' END,
  CASE WHEN s.chars > 0 AND t.chars < s.chars * 0.4 THEN 'content_text_shrunk:error' END, CASE WHEN t.chars >= s.chars * 0.4 AND t.chars < s.chars * 0.9 THEN 'content_text_less:warning' END,
  CASE WHEN s.headings >= 5 AND t.headings < s.headings * 0.8 THEN 'content_headings_lost:warning' END, CASE WHEN s.breaks > 0 AND t.breaks < s.breaks * 0.9 THEN 'content_breaks_lost:warning' END,
  CASE WHEN s.tables > 0 AND t.tables = 0 THEN 'content_tables_lost:error' END, CASE WHEN t.tables > 0 AND t.tables < s.tables THEN 'content_tables_shrunk:warning' END,
  CASE WHEN s.code > 0 AND t.code = 0 THEN 'content_code_lost:error' END, CASE WHEN t.code > 0 AND t.code < s.code THEN 'content_code_shrunk:warning' END,
  CASE WHEN s.footnotes > 0 AND t.footnotes = 0 THEN 'content_footnotes_lost:error' END, CASE WHEN t.footnotes > 0 AND t.footnotes < s.footnotes THEN 'content_footnotes_shrunk:warning' END,
  CASE WHEN s.links > 0 AND t.links = 0 THEN 'content_links_lost:warning' END,
  CASE WHEN s.total_pages > 0 AND s.pages > 0 AND s.pages < s.total_pages * 0.9 THEN 'content_page_coverage:warning' END], lambda x: x IS NOT NULL)) AS x FROM s JOIN t USING (doc_id))"""
HALF = "CASE WHEN doc_id % 3 = 0 THEN array_to_string(string_split(text, chr(10))[1:greatest(1, len(string_split(text, chr(10))) // 2)], chr(10)) ELSE text END"
ST = f"s AS (SELECT doc_id, total_pages, {counters('text')}, {PAGES} AS pages FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, {counters('text')} FROM (SELECT doc_id, {HALF} AS text FROM documents WHERE text IS NOT NULL))"
TYPES = f"""pages AS (SELECT doc_id, page_idx, sum(v) AS valid, sum(bad) AS bad FROM (SELECT doc_id, page_idx, length({visible("coalesce(text, '')")}) - {count(visible("coalesce(text, '')"), S.SUSPICIOUS)} AS v, {count(visible("coalesce(text, '')"), S.SUSPICIOUS)} AS bad FROM m WHERE page_idx IS NOT NULL) GROUP BY doc_id, page_idx),
types AS (SELECT doc_id, CASE WHEN text_pages / total >= 0.9 THEN 'text' WHEN text_pages / total <= 0.1 THEN 'scanned' ELSE 'hybrid' END AS type, total, text_pages, suspicious FROM (
  SELECT doc_id, count(*) AS total, count(*) FILTER (valid >= 50 AND bad <= (valid + bad) * 0.25) AS text_pages, count(*) FILTER (valid + bad > 0 AND bad > (valid + bad) * 0.25) AS suspicious FROM pages GROUP BY doc_id))"""
PLAN = "plan AS (SELECT doc_id, CASE type WHEN 'text' THEN 'pdf-text' WHEN 'scanned' THEN 'pdf-scanned' ELSE 'pdf-hybrid' END AS kind, CASE type WHEN 'text' THEN 'local' WHEN 'scanned' THEN 'cloud' ELSE 'hybrid(cloud)' END AS backend, CASE type WHEN 'text' THEN 0 WHEN 'scanned' THEN total ELSE total - text_pages END AS ocr_pages FROM types), planned AS (SELECT *, CASE WHEN ocr_pages <= 0 THEN 0 ELSE ceil(ocr_pages / 3)::INT END AS shards FROM plan)"
RUNS = "runs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS run, first, last, n FROM (SELECT doc_id, min(page_idx) AS first, max(page_idx) AS last, count(*) AS n FROM (SELECT doc_id, page_idx, page_idx - row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) AS g FROM (SELECT DISTINCT doc_id, page_idx FROM page_markers WHERE page_idx IS NOT NULL)) GROUP BY doc_id, g))"
LPAGE = "lp AS (SELECT doc_id, line_no, line, max(page) OVER (PARTITION BY doc_id, grp) AS page, mark FROM (SELECT doc_id, line_no, line, mark, mark AS page, count(mark) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM (SELECT doc_id, line_no, line, nullif(regexp_extract(line, '^<!-- page (\\d+)(?: ocr)? -->$', 1), '')::INT AS mark FROM dl)))"
KEEPS_SQL = f"list_transform(ls, lambda s: {keeps('s')})"
TRAILING = lambda s: f"CASE WHEN {has(s, '(^|[^ \t])  $')} THEN {s} ELSE {sub(s, '[ \t]+$')} END"

TITLE_LINE = r"(?m)^#[ \t]+([^\n]+?)[ \t]*#*[ \t]*$"
SQL: dict[str, str] = {
    "q01_lines": f"WITH {DL} SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({strip('line')} = '') AS n_blank, count(*) FILTER ({page_mark('line')}) AS n_page_marks, count(*) FILTER ({block_start(strip('line'))}) AS n_starts, count(*) FILTER ({verse('line')}) AS n_verse, count(*) FILTER ({catalog('line')}) AS n_entries FROM dl GROUP BY doc_id",
    "q02_page_numbers": f"WITH {B}, {BL} SELECT doc_id, block_id, {KEPT} FROM (SELECT doc_id, block_id, ls, list_filter(ls, lambda s: NOT {page_number('s')}) AS k FROM bl) WHERE len(k) < len(ls)",
    "q03_running_heads": f"WITH {B}, {BL}, {HEADS} SELECT * FROM heads",
    "q04_running_heads_removed": f"WITH {B}, {BL}, {HEADS}, hs AS (SELECT doc_id, list(head) AS hl FROM heads GROUP BY doc_id) SELECT doc_id, block_id, {KEPT} FROM (SELECT bl.doc_id, block_id, ls, list_filter(ls, lambda s: NOT list_contains(hl, {strip('s')})) AS k FROM bl JOIN hs USING (doc_id) WHERE NOT {VERSE_BLOCK}) WHERE len(k) < len(ls)",
    "q05_trailing_spaces": f"WITH {B} SELECT * FROM (SELECT doc_id, block_id, text AS t0, array_to_string(list_transform(string_split(text, chr(10)), lambda s: {TRAILING('s')}), chr(10)) AS after_text FROM b WHERE coalesce(kind, '') NOT IN {quoted(TRAILING_SKIP)} AND text IS NOT NULL AND NOT {page_mark('text')}) WHERE after_text <> t0".replace("SELECT * FROM (SELECT doc_id, block_id, text AS t0", "SELECT doc_id, block_id, after_text FROM (SELECT doc_id, block_id, text AS t0"),
    "q06_blank_lines": f"WITH {B} SELECT doc_id, block_id, regexp_replace(trailer, '\n{{3,}}', '\n\n', 'g') AS after_trailer FROM b WHERE regexp_matches(trailer, '\n{{3,}}')",
    "q08_text_features": f"SELECT doc_id, {counters('text')}, {PAGES} AS pages FROM documents WHERE text IS NOT NULL",
    "q09_language_guess": f"SELECT doc_id, CASE WHEN kana + hangul + han + latin < 20 THEN NULL WHEN kana >= greatest(10.0, (kana + hangul + han + latin) * 0.02) THEN 'ja' WHEN hangul >= greatest(10.0, (kana + hangul + han + latin) * 0.02) THEN 'ko' WHEN han + latin = 0 THEN NULL WHEN han >= (han + latin) * 0.3 THEN 'zh-CN' WHEN latin >= (han + latin) * 0.6 THEN 'en' END AS guess FROM (SELECT doc_id, {', '.join(f'{count("substring(text, 1, 50000)", p)} AS {n}' for n, p in (('kana', S.KANA), ('hangul', S.HANGUL), ('han', S.HAN), ('latin', S.LATIN)))} FROM documents WHERE text IS NOT NULL)",
    "q10_page_types": f"WITH {M}, {TYPES} SELECT * FROM types",
    "q11_page_runs": f"WITH {RUNS} SELECT * FROM runs",
    "q12_ocr_buckets": f"WITH {RUNS} SELECT doc_id, bucket, count(*) AS runs, sum(n)::BIGINT AS pages FROM (SELECT *, CASE WHEN o <= 2 THEN run ELSE (((run + 1) * 2 - 1) // o) END AS bucket FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS o FROM runs)) GROUP BY doc_id, bucket",
    "q13_plan": f"WITH {M}, {TYPES}, {PLAN} SELECT * FROM planned",
    "q14_plan_totals": f"WITH {M}, {TYPES}, {PLAN} SELECT count(*) AS documents, sum(ocr_pages)::BIGINT AS ocr_pages, sum(shards)::BIGINT AS shards, sum(ocr_pages) > 1000 AS over_quota FROM planned",
    "q15_page_ranges": f"WITH {META} SELECT doc_id, part, part * 20 + 1 AS first_page, least(total_pages, (part + 1) * 20) AS last_page FROM (SELECT doc_id, total_pages, unnest(range(0, (total_pages - 1) // 20 + 1)) AS part FROM meta WHERE total_pages > 0)",
    "q16_page_gaps": f"""WITH {B}, {META}, {M}, {EV}, pg AS (SELECT doc_id, unnest(range(1, total_pages + 1)) AS page FROM meta WHERE total_pages > 0), o AS (SELECT pg.* FROM pg ANTI JOIN (SELECT DISTINCT doc_id, page_idx + 1 AS page FROM b WHERE page_idx IS NOT NULL) c ON pg.doc_id = c.doc_id AND pg.page = c.page),
e AS (SELECT doc_id, page_idx + 1 AS page, count(*) AS items, count(*) FILTER (kind NOT IN ('page_number', 'header', 'footer') AND {strip("coalesce(text, '')")} <> '') AS content FROM ev WHERE page_idx IS NOT NULL GROUP BY doc_id, page_idx)
SELECT o.doc_id, o.page, CASE WHEN content > 0 THEN 'unattributed' WHEN items > 0 THEN 'no_text' WHEN o.doc_id IN (SELECT doc_id FROM ev) THEN 'blank' ELSE 'unavailable' END AS state FROM o LEFT JOIN e ON o.doc_id = e.doc_id AND o.page = e.page""",
    "q17_page_of_lines": f"WITH {DL}, {LPAGE} SELECT doc_id, line_no, page FROM lp WHERE mark IS NULL AND trim(line) <> ''",
    "q18_filled_pages": f"WITH {B} SELECT doc_id, block_id, ord, page_idx, coalesce(page_idx, CASE WHEN pb = pa THEN pb END) AS filled_page FROM (SELECT *, last_value(page_idx IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb, first_value(page_idx IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord, block_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS pa FROM b)",
    "q19_page_regressions": f"WITH {B} SELECT doc_id, block_id, p AS page_idx, reached FROM (SELECT doc_id, block_id, p, max(p) OVER (PARTITION BY doc_id ORDER BY ord, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM (SELECT *, page_idx * 7 % 5 AS p FROM b WHERE page_idx IS NOT NULL)) WHERE p < reached",
    "q20_attribution": f"WITH {B} SELECT kind, count(*) AS required, count(page_idx) AS attributed, round(count(page_idx) / count(*), 6) AS coverage FROM b GROUP BY kind",
    "q21_anchor_candidates": f"WITH {B}, {M}, {EV}, {CAND} SELECT * FROM cand",
    "q24_evidence_kinds": f"WITH {M}, {EV} SELECT kind, count(*) AS n, count(page_idx) AS paged FROM ev GROUP BY kind",
    "q25_base_level": f"WITH {B}, {H}, {BASE} SELECT * FROM base",
    "q26_heading_levels": f"""WITH {B}, {H}, {BASE}, x AS (SELECT h.*, greatest(1, "level" - coalesce(base - 1, 0)) AS sh, row_number() OVER (PARTITION BY h.doc_id ORDER BY ord, block_id) AS rn FROM h LEFT JOIN base USING (doc_id) WHERE title <> '')
SELECT doc_id, block_id, title, "level", (min(sh - rn) OVER (PARTITION BY doc_id ORDER BY ord, block_id) + rn)::INT AS new_level FROM x""",
    "q27_duplicate_headings": f"WITH {B}, {H} SELECT doc_id, block_id || '+' AS block_id FROM h JOIN (SELECT doc_id, block_id, coalesce(trailer, '') AS t FROM b) USING (doc_id, block_id) WHERE title <> '' AND length(t) - length(replace(t, chr(10), '')) <= 2",
    "q28_verse_breaks": f"""WITH {B}, {BL}, x AS (SELECT doc_id, block_id, text, ls, {KEEPS_SQL} AS ks FROM bl WHERE contains(text, chr(10)))
SELECT doc_id, block_id, after_text FROM (SELECT doc_id, block_id, text, array_to_string(list_transform(ls, lambda s, i: CASE WHEN ks[i] AND coalesce(ks[i + 1], false) AND NOT ends_with(s, '  ') THEN {sub('s', '[ ' + chr(9) + ']+$')} || '  ' ELSE s END), chr(10)) AS after_text FROM x) WHERE after_text <> text""",
    "q34_heads_by_page": f"WITH {M}, {EV} SELECT doc_id, key, count(DISTINCT page_idx) AS pages FROM (SELECT doc_id, page_idx, {KEY('text')} AS key FROM ev WHERE text IS NOT NULL AND page_idx IS NOT NULL) WHERE length(key) BETWEEN 2 AND 40 GROUP BY doc_id, key HAVING count(DISTINCT page_idx) >= 3",
    "q36_toc_entries": f"""WITH {DL}, dlx AS (SELECT doc_id, line_no, line FROM dl UNION ALL SELECT doc_id, k - 9, 'Part ' || k || ' of ' || (doc_id % 5) || '……' || k FROM (SELECT doc_id, unnest(range(1, 9)) AS k FROM documents WHERE text IS NOT NULL)), x AS (SELECT doc_id, line_no, {strip("line")} AS s FROM dlx), y AS (SELECT *, ({has('s', _TOC)} AND {catalog('s')})::INT AS hit FROM x WHERE s <> ''),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - sum(hit) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM y), r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS run FROM z WHERE hit = 1),
t AS (SELECT doc_id, line_no, {strip(sub('s', _TOC))} AS title, regexp_extract(s, {q(_TOC)}, 2)::INT AS page FROM r WHERE run >= 3) SELECT doc_id, line_no, title, page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {KEY('title')} ORDER BY line_no) AS n FROM t WHERE title <> '') WHERE n = 1""",
    "q37_last_headings": f"WITH {B}, {H} SELECT doc_id, block_id, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {KEY('title')} ORDER BY ord DESC) AS n FROM h) WHERE n = 1",
    "q38_notes": f"WITH {DL}, {LPAGE} SELECT doc_id, line_no, CASE WHEN mark IS NULL AND trim(line) <> '' THEN page END AS page, substring(trim(line), 1, 1) AS marker, trim(substring(trim(line), 2)) AS body FROM lp WHERE regexp_matches(trim(line), '^[①-⑳]')",
    "q39_references": f'WITH {DL}, {LPAGE}, {NOTED} SELECT doc_id, line_no, "at"::INT AS "at", marker FROM nr',
    "q40_note_links": f"""WITH {DL}, {LPAGE}, {NOTED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, marker ORDER BY line_no, "at") AS k, count(*) OVER (PARTITION BY doc_id, marker) AS c FROM nr), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, marker ORDER BY page NULLS LAST, line_no) AS k, count(*) OVER (PARTITION BY doc_id, marker) AS c FROM nn),
j AS (SELECT r.doc_id, r.marker, r.line_no AS ref_line, n.line_no AS note_line, r.page AS rp, n.page AS np FROM r JOIN n ON r.doc_id = n.doc_id AND r.marker = n.marker AND r.k = n.k AND r.c = n.c)
SELECT doc_id, marker, ref_line, note_line, CASE WHEN np = rp THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT *, min((coalesce(np - rp, -1) BETWEEN 0 AND 1)::INT) OVER (PARTITION BY doc_id, marker) AS ok FROM j) WHERE ok = 1""",
    "q41_definitions": f"WITH {B} SELECT doc_id, block_id, regexp_extract(text, {q(r'^\[\^([^\]\s]+)\]:')}, 1) AS marker, {strip(sub('text', r'^\[\^[^\]\s]+\]:'))} AS body FROM b WHERE kind = 'footnote' AND text IS NOT NULL",
    "q71_verification": f"WITH {B}, {TARGETS}, {DECIDED} SELECT b.doc_id, count(*) AS blocks, count(*) FILTER (WHERE operation IS NULL OR operation <> 'delete_block') AS blocks_left, 0::BIGINT AS problems FROM b LEFT JOIN (SELECT doc_id, block_id, operation FROM d WHERE status = 'applied') a ON a.doc_id = b.doc_id AND a.block_id = b.block_id GROUP BY b.doc_id",
    "q42_patch_status": f"WITH {B}, {TARGETS}, {DECIDED} SELECT doc_id, patch_id, status, reason FROM d",
    "q43_patch_stats": f"WITH {B}, {TARGETS}, {DECIDED} SELECT rule_id, status, count(*) AS n FROM d GROUP BY rule_id, status",
    "q45_patched_blocks": f"WITH {B}, {TARGETS}, {DECIDED} SELECT b.doc_id, b.block_id, b.kind, CASE WHEN operation = 'replace_text' THEN after_text ELSE b.text END AS text FROM b LEFT JOIN (SELECT * FROM d WHERE status = 'applied') a ON a.doc_id = b.doc_id AND a.block_id = b.block_id WHERE operation IS NULL OR operation <> 'delete_block'",
    "q46_reverted": f"WITH {B} SELECT count(*) AS blocks, 0 AS different FROM b",
    "q47_policy": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(r)}, {q(c)}, {str(a).lower()})" for i, (r, c, a) in enumerate(POLICY)) + ") t(step, rule_id, confidence, auto_apply)",
    "q48_roundtrip": "SELECT count(*) AS n_docs, count(*) AS n_same, count(*) AS n_tiled FROM documents WHERE text IS NOT NULL",
    "q50_rendered_books": f"WITH {B} SELECT doc_id, length(t) AS chars, sha256(t) AS sha256 FROM (SELECT doc_id, string_agg(text || trailer, '' ORDER BY ord, text || trailer) AS t FROM b WHERE text IS NOT NULL AND trailer IS NOT NULL GROUP BY doc_id)",
    "q51_resolved_titles": f"""WITH {B}, {H}, {BOOKS}, hd AS (SELECT doc_id, arg_min(title, ord) AS heading FROM h WHERE "level" = 1 GROUP BY doc_id) SELECT doc_id, CASE WHEN NOT {JUNK('bk.title')} THEN {CLEAN('bk.title')} WHEN NOT {JUNK('heading')} AND NOT {STRUCT(CLEAN('heading'))} THEN {CLEAN('heading')} ELSE coalesce(nullif({CLEAN('bk.title')}, ''), '未命名') END AS title, CASE WHEN NOT {JUNK('bk.title')} THEN 'filename' WHEN NOT {JUNK('heading')} AND NOT {STRUCT(CLEAN('heading'))} THEN 'heading' ELSE 'filename' END AS title_source FROM bk LEFT JOIN hd USING (doc_id)""",
    "q52_names": f"""WITH {BOOKS}, x AS (SELECT doc_id, concat_ws(' - ', title, author) AS stem FROM bk WHERE title IS NOT NULL), y AS (SELECT *, {CLEAN("regexp_extract(stem, '^(.*?)[ 	]+-[ 	]+(.+)$', 1)")} AS t, {CLEAN("regexp_extract(stem, '^(.*?)[ 	]+-[ 	]+(.+)$', 2)")} AS a FROM x)
SELECT doc_id, {OR_BOOK(WORK('stem'))} AS work, {OR_BOOK(OUT('stem'))} AS output, CASE WHEN length(t) >= 2 AND a <> '' THEN t ELSE stem END AS title, CASE WHEN length(t) >= 2 AND a <> '' THEN a END AS author FROM y""",
    "q53_name_conflicts": f"WITH {BOOKS} SELECT kind, name, count(DISTINCT doc_id)::INT AS n FROM (SELECT doc_id, 'work' AS kind, lower({OR_BOOK(WORK('title'))}) AS name FROM bk WHERE title IS NOT NULL UNION ALL SELECT doc_id, 'out', lower({OR_BOOK(OUT('title'))}) FROM bk WHERE title IS NOT NULL) GROUP BY kind, name HAVING count(DISTINCT doc_id) > 1",
    "q54_catalogue": "SELECT lower(replace(trim(source), '\\', '/')) AS path_key, max(added_at) AS mtime, min(added_at) AS added_at, arg_max(t, (CASE WHEN starts_with(t, '_') THEN '0' ELSE '1' END) || strftime(added_at, '%Y%m%d%H%M%S%f') || t) AS title FROM (SELECT *, coalesce(substring(text, 1, 20), '') AS t FROM documents WHERE source IS NOT NULL) GROUP BY 1",
    "q55_sources": f"WITH {META} SELECT nullif(lower({strip('source')}), '') AS source, count(*) AS n_books, sum(total_pages)::BIGINT AS pages, count(*) FILTER (backend IS NULL) AS no_backend FROM meta GROUP BY 1",
    "q57_content_issues": f"WITH {ST}, {ISSUES} SELECT doc_id, split_part(x, ':', 1) AS code, split_part(x, ':', 2) AS level FROM issues",
    "q58_fatal": f"WITH {ST}, {ISSUES} SELECT doc_id, count(*) FILTER (x LIKE '%:error') AS errors, count(*) FILTER (x LIKE '%:warning') AS warnings, true AS fatal FROM issues GROUP BY doc_id",
    "q59_image_refs": f"""WITH {B}, r AS (SELECT DISTINCT doc_id, regexp_replace(i, '^.*[/\\\\]', '') AS image FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(IMG)}, 1)) AS i FROM b WHERE text IS NOT NULL) WHERE NOT regexp_matches(i, '^([a-zA-Z][a-zA-Z0-9+.-]*:|/)')), f AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, {q(IMG)}, 1)), '^.*[/\\\\]', '') AS image FROM b WHERE kind = 'image' AND text IS NOT NULL) SELECT r.* FROM r ANTI JOIN f ON r.doc_id = f.doc_id AND r.image = f.image""",
    "q60_broken_links": f"""WITH {B}, l AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {q(r'\[[^\]\n]+\]\(([^)\n]+)\)')}, 1)) AS href FROM b WHERE text IS NOT NULL), f AS (SELECT doc_id, unnest(regexp_extract_all(text, {q(r'\]: (\S+)')}, 1)) AS path FROM b WHERE text IS NOT NULL), x AS (SELECT *, regexp_replace(href, '#.*$', '') AS path FROM l WHERE NOT regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]*:|//|#)'))
SELECT x.doc_id, href FROM x ANTI JOIN f ON x.doc_id = f.doc_id AND (x.path = f.path OR url_decode(x.path) = f.path) WHERE x.path <> ''""",
    "q62_event_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "q63_event_progress": "SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS n FROM events",
    "q65_outline": f"""SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all({UNF('text')}, {q(r'(?m)^(#{1,6})[ \t]')}, 1), lambda m: length(m))), 1) AS depth,
  CASE WHEN regexp_extract(text, {q(TITLE_LINE)}, 1) <> '' THEN regexp_extract(text, {q(TITLE_LINE)}, 1) ELSE regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda s: {strip('s')}), lambda s: s <> '')[1], {q(r'^#+[ \t]*')}, '') END AS title FROM documents WHERE text IS NOT NULL""",
    "q66_bold_lines": f"""WITH {B}, {BOOKS}, r AS (SELECT doc_id, {visible('title')} AS run FROM bk WHERE title IS NOT NULL), l AS (SELECT doc_id, block_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM b WHERE kind = 'text' AND text IS NOT NULL)
SELECT l.doc_id, block_id, line_no, CASE WHEN hit THEN '**' || s || '**' ELSE line END AS line FROM (SELECT l.*, {strip('line')} AS s, coalesce(length(run) >= 4 AND {strip('line')} <> '' AND NOT {has(strip('line'), r'^(#|>|\||```|<|!\[)')} AND contains({visible(sub(strip('line'), '<[^>]+>'))}, run), false) AS hit FROM l LEFT JOIN r USING (doc_id)) l WHERE hit OR starts_with(line, '**')""",
    "q67_missing_parts": """WITH w AS (SELECT backend, unnest(range(0, (total_pages - 1) // 20 + 1)) AS part, doc_id AS source_fp FROM (SELECT doc_id, max(backend) AS backend, max(total_pages) AS total_pages FROM doc_meta GROUP BY doc_id) WHERE total_pages > 0 AND backend IS NOT NULL)
SELECT * FROM w WHERE NOT ((source_fp + part) % 3 = 0 AND ((source_fp + part) % 6 = 0 OR (source_fp + part) % 5 <> 0))""",
    "q68_part_outcomes": """WITH l AS (SELECT user_id AS task, event_id % 3 AS part, arg_max(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END, ts) AS state FROM events GROUP BY 1, 2)
SELECT task, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'pending') AS pending, CASE WHEN count(*) FILTER (state = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (state = 'done') = count(*) THEN 'done' ELSE 'pending' END AS status FROM l GROUP BY task""",
    "q35_heading_proposals": f"""WITH {B}, {M}, {EV}, hp AS (SELECT doc_id, key FROM (SELECT doc_id, page_idx, {KEY('text')} AS key FROM ev WHERE text IS NOT NULL AND page_idx IS NOT NULL) WHERE length(key) BETWEEN 2 AND 40 GROUP BY doc_id, key HAVING count(DISTINCT page_idx) >= 3),
t AS (SELECT DISTINCT doc_id, key FROM (SELECT doc_id, {KEY('text')} AS key FROM ev WHERE kind = 'heading' AND text IS NOT NULL AND page_idx > 0) WHERE length(key) BETWEEN 1 AND 40 AND (doc_id, key) NOT IN (SELECT doc_id, key FROM hp)),
x AS (SELECT doc_id, block_id, kind, title, {KEY('title')} AS key FROM (SELECT doc_id, block_id, kind, {sub('text', r'^#+\s*')} AS title FROM b WHERE kind IN ('text', 'heading') AND text IS NOT NULL AND NOT contains(text, chr(10))))
SELECT doc_id, block_id, title, 'promote' AS action FROM x WHERE kind = 'text' AND (doc_id, key) IN (SELECT doc_id, key FROM t) UNION ALL SELECT doc_id, block_id, title, 'demote' FROM x WHERE kind = 'heading' AND (doc_id, key) IN (SELECT doc_id, key FROM hp)""",
    "q56_labels": f"""WITH {BOOKS}, x AS (SELECT doc_id, coalesce(lang, '') AS o, {strip("coalesce(lang, '')")} AS so, {', '.join(f'{count("coalesce(title, " + q("") + ")", p)} AS {n}' for n, p in (('kana', S.KANA), ('hangul', S.HANGUL), ('han', S.HAN), ('latin', S.LATIN)))} FROM bk)
SELECT doc_id, CASE WHEN length(o) > 0 THEN CASE WHEN so = '' THEN 'zh-CN' ELSE so END ELSE coalesce(CASE WHEN kana + hangul + han + latin < 20 THEN NULL WHEN kana >= greatest(10.0, (kana + hangul + han + latin) * 0.02) THEN 'ja' WHEN hangul >= greatest(10.0, (kana + hangul + han + latin) * 0.02) THEN 'ko' WHEN han + latin = 0 THEN NULL WHEN han >= (han + latin) * 0.3 THEN 'zh-CN' WHEN latin >= (han + latin) * 0.6 THEN 'en' END, 'zh-CN') END AS lang FROM x""",
}
