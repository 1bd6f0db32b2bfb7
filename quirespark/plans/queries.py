"""Registered queries of the core operators; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..operators import align, cache, cleaning, export, footnotes, markdown, metadata, patches, planning, quality, rules, structure
from ..session import cut
from ..streaming import events
from ..tables import latest, source_key, table

Query = Callable[[SparkSession, str], DataFrame]


def blocks(spark: SparkSession, d: str, *more: str) -> DataFrame:
    b = table(spark, d, "blocks", "doc_id", "block_id", "ord", "kind", "heading_level", "text", "trailer", "page_idx", "ingested_at")
    return latest(b, ["doc_id", "block_id"]).withColumnRenamed("heading_level", "level").drop("ingested_at")


def markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_markers", "doc_id", "item_no", "item_type", "text", "page_idx", "text_level", "ingested_at")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def meta(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "doc_meta", "doc_id", "source", "backend", "total_pages", "created_at", "ingested_at"), ["doc_id"])


def books(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "book_meta", "doc_id", "title", "author", "publisher", "translator", "lang", "source_title", "ingested_at"), ["doc_id"])


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("line_no"), "line")


_PATCH = ("doc_id", "block_id", "operation", "after_text")


# lines and rules
def q01_lines(spark, d):
    s = X.strip(F.col("line"))
    return doc_lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(s == "").alias("n_blank"), F.count_if(X.is_page_mark(F.col("line"))).alias("n_page_marks"), F.count_if(X.is_block_start(s)).alias("n_starts"), F.count_if(X.is_verse_line(F.col("line"))).alias("n_verse"), F.count_if(X.is_catalog_entry(F.col("line"))).alias("n_entries"))


def q02_page_numbers(spark, d):
    return rules.page_numbers(blocks(spark, d)).select(*_PATCH)


def q03_running_heads(spark, d):
    return rules.repeated_heads(blocks(spark, d))


def q04_running_heads_removed(spark, d):
    return rules.running_heads(blocks(spark, d)).select(*_PATCH)


def q05_trailing_spaces(spark, d):
    return rules.trailing_spaces(blocks(spark, d)).select("doc_id", "block_id", "after_text")


def q06_blank_lines(spark, d):
    return rules.blank_lines(blocks(spark, d)).select("doc_id", "block_id", "after_trailer")


def q07_rule_stats(spark, d):
    # one written table of the blocks once each for all rules
    return rules.propose(cut(blocks(spark, d)), books(spark, d)).groupBy("step", "rule_id", "operation").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def q08_text_features(spark, d):
    return quality.counters(documents(spark, d))


def q09_language_guess(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", S.language_guess(F.col("text")).alias("guess"))


# pages
def q10_page_types(spark, d):
    return planning.document_types(planning.page_texts(markers(spark, d)))


def q11_page_runs(spark, d):
    return planning.runs(markers(spark, d).where("page_idx is not null"))


def q12_ocr_buckets(spark, d):
    return planning.buckets(q11_page_runs(spark, d), 2)


def q13_plan(spark, d):
    return planning.plan(q10_page_types(spark, d), per_task=3)


def q14_plan_totals(spark, d):
    return planning.plan_totals(q13_plan(spark, d))


def q15_page_ranges(spark, d):
    return planning.page_ranges(meta(spark, d), 20)


def q16_page_gaps(spark, d):
    return align.page_gaps(meta(spark, d), blocks(spark, d), align.evidence(markers(spark, d)))


def q17_page_of_lines(spark, d):
    return align.page_of_lines(documents(spark, d))


def q18_filled_pages(spark, d):
    return align.filled_pages(blocks(spark, d))


def q19_page_regressions(spark, d):
    """Over pages shuffled by fixed arithmetic, as the books' own never step back."""
    return align.page_regressions(blocks(spark, d).withColumn("page_idx", F.col("page_idx") * 7 % 5))


def q20_attribution(spark, d):
    return align.attribution(blocks(spark, d))


def q21_anchor_candidates(spark, d):
    return align.candidates(blocks(spark, d), align.evidence(markers(spark, d)))


def q22_links(spark, d):
    return align.links(q21_anchor_candidates(spark, d))


def q23_short_links(spark, d):
    return align.short_links(blocks(spark, d), align.evidence(markers(spark, d)), q22_links(spark, d))


def q24_evidence_kinds(spark, d):
    return align.evidence(markers(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.count("page_idx").alias("paged"))


# headings and structure
def q25_base_level(spark, d):
    return rules.base_level(blocks(spark, d))


def q26_heading_levels(spark, d):
    return rules.heading_levels(blocks(spark, d)).select("doc_id", "block_id", "title", "level", "new_level")


def q27_duplicate_headings(spark, d):
    """Over all blocks, and after each heading the same one once more, as the books' own differ."""
    b = blocks(spark, d)
    again = rules.headings(b).drop("title").withColumns({"block_id": F.concat("block_id", F.lit("+")), "ord": F.col("ord") * 2 + 1, "trailer": F.lit("\n")})
    return rules.duplicate_headings(b.withColumn("ord", F.col("ord") * 2).unionByName(again)).select("doc_id", "block_id")


def q28_verse_breaks(spark, d):
    return rules.verse_breaks(blocks(spark, d)).select("doc_id", "block_id", "after_text")


def q29_join_lines(spark, d):
    return rules.join_lines(blocks(spark, d)).select("doc_id", "block_id", "after_text")


def q30_joins_across_blocks(spark, d):
    return rules.joins_across_blocks(blocks(spark, d), q22_links(spark, d))


def q31_cjk_spaces(spark, d):
    return rules.cjk_spaces(blocks(spark, d)).select("doc_id", "block_id", "after_text")


def q32_ocr_spaces(spark, d):
    return rules.ocr_spaces(blocks(spark, d)).select("doc_id", "block_id", "after_text")


def q33_front_matter(spark, d):
    return rules.front_matter(blocks(spark, d), books(spark, d)).select("doc_id", "block_id")


def q34_heads_by_page(spark, d):
    return structure.heads_by_page(align.evidence(markers(spark, d)))


def q35_heading_proposals(spark, d):
    return structure.proposed_headings(blocks(spark, d), align.evidence(markers(spark, d)))


def q35b_missing_headings(spark, d):
    return structure.missing_headings(blocks(spark, d), align.evidence(markers(spark, d)), q22_links(spark, d))


def q36_toc_entries(spark, d):
    """Over all lines, and eight entries in front of each document, as the documents have none."""
    k = F.col("k")
    front = documents(spark, d).where("text is not null").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k"))
    entry = F.concat(F.lit("Part "), k.cast("string"), F.lit(" of "), (F.col("doc_id") % 5).cast("string"), F.lit("……"), k.cast("string"))
    return structure.toc_entries(doc_lines(spark, d).unionByName(front.select("doc_id", (k - 9).alias("line_no"), entry.alias("line"))))


def q37_last_headings(spark, d):
    return structure.last_of_title(rules.headings(blocks(spark, d))).select("doc_id", "block_id", "title")


# footnotes
def _paged_lines(spark, d):
    lines = doc_lines(spark, d)
    return lines.join(align.page_of_lines(documents(spark, d)), ["doc_id", "line_no"], "left")


def _noted_lines(spark, d):
    """All lines, and in front of each document a page with two references and their notes, as the documents have notes only."""
    k = F.col("k")
    mark = F.element_at(F.array(F.lit("①"), F.lit("②"), F.lit("③")), (F.col("doc_id") % 3 + 1).cast("int"))
    line = F.when(k % 6 == 1, F.concat(F.lit("Text"), mark, F.lit(" goes on"))).when(k % 6 == 4, F.concat(mark, F.lit(" note "), k.cast("string"))).otherwise(F.lit("plain"))
    front = documents(spark, d).where("text is not null").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k"))
    return _paged_lines(spark, d).select("doc_id", "line_no", "line", "page").unionByName(front.select("doc_id", (k - 13).alias("line_no"), line.alias("line"), F.lit(-1).alias("page")))


def q38_notes(spark, d):
    return footnotes.notes(_paged_lines(spark, d)).select("doc_id", "line_no", "page", "marker", "body")


def q39_references(spark, d):
    return footnotes.references(_noted_lines(spark, d)).select("doc_id", "line_no", "at", "marker")


def q40_note_links(spark, d):
    lines = _noted_lines(spark, d)
    return footnotes.match(footnotes.references(lines), footnotes.notes(lines)).select("doc_id", "marker", "ref_line", "note_line", "confidence")


def q40b_rewritten_notes(spark, d):
    lines = _noted_lines(spark, d)
    r, n = footnotes.references(lines), footnotes.notes(lines)
    return footnotes.rewritten(lines, footnotes.match(r, n).unionByName(footnotes.match_rest(r, n)))


def q41_definitions(spark, d):
    """Footnote definitions of the blocks: marker and body."""
    b = blocks(spark, d).where("kind = 'footnote' and text is not null")
    return b.select("doc_id", "block_id", F.regexp_extract("text", r"^\[\^([^\]\s]+)\]:", 1).alias("marker"), X.strip(F.regexp_replace("text", r"^\[\^[^\]\s]+\]:", "")).alias("body"))


# patches
def _decided(spark, d):
    p = table(spark, d, "patches", "doc_id", "patch_id", "rule_id", "target_block_id", "operation", "before_text", "before_sha256", "after_text", "confidence", "patch_status", "skip_reason", "created_at", "ingested_at")
    return patches.decided(p, blocks(spark, d))


def q42_patch_status(spark, d):
    return _decided(spark, d).select("doc_id", "patch_id", "status", "reason")


def q43_patch_stats(spark, d):
    return patches.stats(_decided(spark, d))


def q44_patch_reports(spark, d):
    return patches.report(_decided(spark, d))


def q45_patched_blocks(spark, d):
    return patches.applied_blocks(blocks(spark, d), _decided(spark, d)).select("doc_id", "block_id", "kind", "text")


def q46_reverted(spark, d):
    """Blocks whose text differs after applying and reverting: none."""
    b, dec = blocks(spark, d), _decided(spark, d)
    back = patches.reverted(patches.applied_blocks(b, dec), dec).select("doc_id", "block_id", F.col("text").alias("back"))
    j = b.select("doc_id", "block_id", "text").join(back, ["doc_id", "block_id"], "full")
    return j.agg(F.count("*").alias("blocks"), F.count_if(~F.col("text").eqNullSafe(F.col("back"))).alias("different"))


def q71_verification(spark, d):
    """Each document's blocks before and after its patches, and those that are not what the patches make of them."""
    b, dec = blocks(spark, d), cut(_decided(spark, d))
    after = patches.applied_blocks(b, dec)
    wrong = patches.verified(b, after, dec).groupBy("doc_id").agg(F.count("*").alias("problems"))
    n = b.groupBy("doc_id").agg(F.count("*").alias("blocks")).join(after.groupBy("doc_id").agg(F.count("*").alias("left")), "doc_id", "left")
    return n.join(wrong, "doc_id", "left").select("doc_id", "blocks", F.coalesce("left", F.lit(0)).alias("blocks_left"), F.coalesce("problems", F.lit(0)).alias("problems"))


def q47_policy(spark, d):
    return patches.policy(spark)


# whole documents
def q69_cleaned_documents(spark, d):
    """Documents after all rules: their sizes before and after, and a hash of the text."""
    docs = documents(spark, d)
    done = cleaning.clean_documents(docs)
    return cleaning.changes(docs, done).join(done.select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id")


def q70_cleaned_blocks(spark, d):
    """Blocks after all rules, joined across blocks where the next one is linked with a page item."""
    b = blocks(spark, d)
    linked = q22_links(spark, d).join(b.select("doc_id", "block_id", "ord"), ["doc_id", "ord"])
    return rules.cleaned(cut(b), books(spark, d), linked=linked).select("doc_id", "block_id", "kind", "level", "text", "trailer")


# representation
def q48_roundtrip(spark, d):
    r = markdown.roundtrip(documents(spark, d).where("text is not null"))
    return r.agg(F.count("*").alias("n_docs"), F.count_if(F.col("same")).alias("n_same"), F.count_if(F.col("tiles")).alias("n_tiled"))


def q49_markdown_blocks(spark, d):
    b = markdown.blocks_of(markdown.parsed(documents(spark, d)))
    return b.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def q50_rendered_books(spark, d):
    r = markdown.render_blocks(blocks(spark, d).where("text is not null and trailer is not null"))
    return r.select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"))


# metadata, names, catalogue
def q51_resolved_titles(spark, d):
    b = books(spark, d).select("doc_id", F.col("title").alias("stem"), F.lit(None).cast("string").alias("pdf_title"), F.lit(None).cast("string").alias("front_title"))
    h = rules.headings(blocks(spark, d)).where("level = 1").groupBy("doc_id").agg(F.min_by("title", "ord").alias("heading"))
    return metadata.resolved(b.join(h, "doc_id", "left")).select("doc_id", "title", "title_source")


def q52_names(spark, d):
    b = books(spark, d).where("title is not null").select("doc_id", F.concat_ws(" - ", "title", "author").alias("stem"))
    t, a = metadata.title_author(F.col("stem"))
    return b.select("doc_id", metadata.work_name(F.col("stem")).alias("work"), metadata.output_name(F.col("stem")).alias("output"), t.alias("title"), a.alias("author"))


def q53_name_conflicts(spark, d):
    b = books(spark, d).where("title is not null").select(F.col("doc_id").alias("id"), F.col("title").alias("stem"))
    return metadata.name_conflicts(b).select("kind", "name", "n")


def q54_catalogue(spark, d):
    e = table(spark, d, "documents", "doc_id", "source", "text", "added_at").where("source is not null")
    return metadata.catalogue(e.select(F.trim("source").alias("path"), F.coalesce(F.substring("text", 1, 20), F.lit("")).alias("title"), F.col("added_at").alias("mtime"), "added_at"))


def q55_sources(spark, d):
    m = meta(spark, d)
    return m.groupBy(source_key("source").alias("source")).agg(F.count("*").alias("n_books"), F.sum("total_pages").alias("pages"), F.count_if(F.col("backend").isNull()).alias("no_backend"))


def q56_labels(spark, d):
    return books(spark, d).select("doc_id", S.resolved_language(F.coalesce("title", F.lit("")), F.coalesce("lang", F.lit(""))).alias("lang"))


# quality
def _cut(spark, d):
    """A result that lost the second half of every third document's lines."""
    half = F.array_join(F.slice(F.split("text", "\n", -1), 1, F.greatest(F.lit(1), F.floor(F.size(F.split("text", "\n", -1)) / 2).cast("int"))), "\n")
    return documents(spark, d).where("text is not null").select("doc_id", F.when(F.col("doc_id") % 3 == 0, half).otherwise(F.col("text")).alias("text"))


def q57_content_issues(spark, d):
    expected = table(spark, d, "documents", "doc_id", "total_pages")
    return quality.content_issues(quality.counters(documents(spark, d)), quality.counters(_cut(spark, d)), expected)


def q58_fatal(spark, d):
    return quality.summary(q57_content_issues(spark, d), strict=True)


def q59_image_refs(spark, d):
    b = blocks(spark, d).where("text is not null")
    refs = b.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(S.IMAGE), F.lit(1))).alias("image"))
    files = b.where("kind = 'image'").select("doc_id", F.explode(S.image_names(F.col("text"))).alias("image"))
    return rules.missing_images(refs, files)


def q60_broken_links(spark, d):
    b = blocks(spark, d).where("text is not null")
    links = b.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\]\n]+\]\(([^)\n]+)\)"), F.lit(1))).alias("href")).distinct()
    files = b.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\]: (\S+)"), F.lit(1))).alias("path"))
    return quality.broken_links(links, files)


# events
def q61_event_fold(spark, d):
    """Events by user as tasks: views start a stage, clicks progress it, purchases end it, errors and sign-ups end the task."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    stage = F.element_at(F.array(*[F.lit(s) for s, _ in events.STAGES]), (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("event_type").isin("view", "purchase"), "stage").when(F.col("event_type") == "click", "progress").when(F.col("event_type") == "error", "warning").otherwise("retry")
    e = e.select(kind.alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.col("user_id").cast("string").alias("task"), stage.alias("name"), stage.alias("stage"), F.when(F.col("event_type") == "view", "start").otherwise("done").alias("state"), F.floor("value").alias("current"), F.lit(100).cast("long").alias("total"), F.lit(None).cast("long").alias("shards"), F.lit(1).cast("long").alias("attempt"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message"))
    return events.fold(e)


def q62_event_windows(spark, d):
    return events.windowed(table(spark, d, "events", "ts", "event_type", "value"), "1 day")


def q63_event_progress(spark, d):
    """The running peak of each user's values, and the events between peaks."""
    from pyspark.sql import Window as W

    e = table(spark, d, "events", "event_id", "ts", "user_id", "value")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", "user_id", F.max("value").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("peak"), F.row_number().over(w).alias("n"))


# conversion and caches
def q64_prepared(spark, d):
    """Blocks made safe for conversion, of those that change."""
    b = blocks(spark, d).where("text is not null")
    return export.prepared(b.select(F.struct("doc_id", "block_id").alias("doc_id"), "text")).where("changed").select("doc_id.doc_id", "doc_id.block_id", "text")


def q65_outline(spark, d):
    t = documents(spark, d).where("text is not null")
    return t.select("doc_id", export.heading_depth(F.col("text")).alias("depth"), export.inferred_title(F.col("text")).alias("title"))


def q66_bold_lines(spark, d):
    """Lines of blocks that name the book's title, as emphasised runs."""
    b = blocks(spark, d).where("kind = 'text' and text is not null").select("doc_id", "block_id", "text")
    lines = rules.lines(b).select(F.struct("doc_id", "block_id").alias("k"), "doc_id", "line_no", "line")
    out = export.bold_lines(lines.select("doc_id", F.struct("k.block_id", "line_no").alias("line_no"), "line"), books(spark, d).where("title is not null").select("doc_id", F.col("title").alias("run")))
    return out.where(F.col("line").startswith("**")).select("doc_id", "line_no.block_id", F.col("line_no.line_no").alias("line_no"), "line")


def _parts(spark, d):
    m = latest(table(spark, d, "doc_meta", "doc_id", "backend", "params_fp", "doc_variant", "total_pages", "ingested_at"), ["doc_id"])
    return m.where("total_pages > 0 and backend is not null").select("backend", F.explode(F.sequence(F.lit(0), F.floor((F.col("total_pages") - 1) / 20).cast("int"))).alias("part"), F.col("doc_id").alias("source_fp"), F.col("doc_variant").alias("variant"), "params_fp")


def q67_missing_parts(spark, d):
    """Parts to submit where every third is stored, every sixth without its parameters, every fifth with others."""
    w = _parts(spark, d)
    k = F.col("source_fp") + F.col("part")
    store = w.where(k % 3 == 0).withColumn("params_fp", F.when(k % 6 == 0, None).when(k % 5 == 0, "other").otherwise(F.col("params_fp")))
    return cache.missing(w, store).select("backend", "part", "source_fp")


def q68_part_outcomes(spark, d):
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return cache.outcome(e.select(F.col("user_id").alias("task"), (F.col("event_id") % 3).alias("part"), state.alias("state"), F.struct("ts", "event_id").alias("ts")))


def queries() -> dict[str, Query]:
    return {k: f for k, f in sorted(globals().items()) if k[0] == "q" and k[1:3].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
