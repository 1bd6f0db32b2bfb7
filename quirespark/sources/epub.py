"""Book containers: entries, and the checks of their structure."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUE = T.StructType([T.StructField("level", T.StringType()), T.StructField("code", T.StringType()), T.StructField("message", T.StringType())])
_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/", "x": "http://www.w3.org/1999/xhtml", "n": "http://www.daisy.org/z3986/2005/ncx/"}
# Media types by suffix.
MIME = {".xhtml": "application/xhtml+xml", ".html": "application/xhtml+xml", ".css": "text/css", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".svg": "image/svg+xml", ".ncx": "application/x-dtbncx+xml"}
_LANG = re.compile(r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$")
_DATE = re.compile(r"^\d{4}(-\d{2}(-\d{2}(T.*)?)?)?$")


def check(data: bytes, math: bool = False, footnotes: bool = False, images: int = 0) -> list[tuple[str, str, str]]:
    """(level, code, message) of every structural problem of one container.

    math, footnotes and images say what the source lets expect: formulas, notes, and so many images.
    """
    out: list[tuple[str, str, str]] = []
    say = lambda level, code, message="": out.append((level, code, message[:200]))
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        bad = z.testzip()
    except (zipfile.BadZipFile, ValueError, EOFError, OSError) as e:
        return [("error", "archive_unreadable", str(e)[:200])]
    names = z.namelist()
    if bad:
        say("error", "archive_unreadable", bad)
    if "mimetype" not in names or z.read("mimetype") != b"application/epub+zip":
        say("error", "mimetype_wrong")
    elif names[0] != "mimetype":
        say("warning", "mimetype_order")
    if "META-INF/container.xml" not in names:
        say("error", "container_missing")
        return out
    try:
        root = ET.fromstring(z.read("META-INF/container.xml")).find(".//c:rootfile", _NS).get("full-path")
    except (ET.ParseError, AttributeError):
        say("error", "container_invalid")
        return out
    if root not in names:
        say("error", "opf_missing", str(root))
        return out
    try:
        opf = ET.fromstring(z.read(root))
    except ET.ParseError as e:
        say("error", "opf_invalid", str(e))
        return out
    base = posixpath.dirname(root)
    at = lambda href, here=base: posixpath.normpath(posixpath.join(here, href))
    there = lambda p: p in names or unquote(p) in names
    for tag, code in (("title", "title_missing"), ("language", "language_missing"), ("identifier", "identifier_missing")):
        if not any((e.text or "").strip() for e in opf.iterfind(f".//d:{tag}", _NS)):
            say("warning", code)
    for e in opf.iterfind(".//d:language", _NS):
        if (e.text or "").strip() and not _LANG.match(e.text.strip()):
            say("warning", "language_invalid", e.text)
    for e in opf.iterfind(".//d:date", _NS):
        if (e.text or "").strip() and not _DATE.match(e.text.strip()):
            say("warning", "date_invalid", e.text)
    items = {e.get("id"): e for e in opf.iterfind(".//o:manifest/o:item", _NS)}
    path = {k: at(e.get("href", "")) for k, e in items.items()}
    for k, p in path.items():
        if not there(p):
            say("error", "manifest_missing", p)
        want = MIME.get(posixpath.splitext(p)[1].lower())
        if want and items[k].get("media-type") not in (want, None) and there(p):
            say("warning", "mime_mismatch", p)
    spine = [e.get("idref") for e in opf.iterfind(".//o:spine/o:itemref", _NS)]
    if not spine:
        say("error", "spine_empty")
    for r in spine:
        if r not in items:
            say("error", "spine_broken", str(r))
    docs, ids, empty = {}, {}, 0
    for r in spine:
        p = path.get(r)
        real = p if p in names else unquote(p) if p and unquote(p) in names else None
        if real is None:
            continue
        try:
            docs[real] = ET.fromstring(z.read(real))
        except ET.ParseError as e:
            say("error", "xhtml_invalid", f"{real}: {e}")
            continue
        ids[real] = {e.get("id") for e in docs[real].iter() if e.get("id")}
        body = docs[real].find(".//x:body", _NS)
        if body is not None and not "".join(body.itertext()).strip() and body.find(".//x:img", _NS) is None:
            empty += 1
    if empty:
        say("warning", "empty_chapters", str(empty))
        if empty >= max(3, -(-len(docs) // 2)):
            say("error", "chapters_empty_mass", str(empty))
    used: set[str] = set()
    styles: set[str] = set()
    toc_type = "{http://www.idpf.org/2007/ops}type"

    def follow(here: str, href: str, code: str, anchor: str | None) -> None:
        if not href or re.match(r"^([A-Za-z][A-Za-z0-9+.-]*:|//)", href):
            return
        file, _, frag = href.partition("#")
        p = at(file, posixpath.dirname(here)) if file else here
        real = p if p in names else unquote(p)
        used.add(real)
        if real not in names:
            say("error", code, f"{here} -> {href}")
        elif anchor and frag and real in ids and unquote(frag) not in ids[real]:
            say("warning", anchor, f"{here} -> {href}")

    for here, doc in docs.items():
        for e in doc.iter():
            tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
            if tag == "img":
                follow(here, e.get("src", ""), "image_missing", None)
            elif tag == "a":
                follow(here, e.get("href", ""), "link_broken", "anchor_missing")
            elif tag == "link" and e.get("rel") == "stylesheet":
                styles.add(posixpath.basename(e.get("href", "")))
    nav = next((path[k] for k, e in items.items() if "nav" in (e.get("properties") or "").split()), None)
    ncx = next((path[k] for k, e in items.items() if e.get("media-type") == MIME[".ncx"]), None)
    if nav is None and ncx is None:
        say("warning", "nav_missing")
    if nav in names:
        try:
            n = ET.fromstring(z.read(nav))
            styles |= {posixpath.basename(e.get("href", "")) for e in n.iterfind(".//x:link[@rel='stylesheet']", _NS)}
            tocs = [e for e in n.iterfind(".//x:nav", _NS) if e.get(toc_type) == "toc"]
            if not tocs:
                say("warning", "nav_not_toc")
            links = [a.get("href", "") for t in tocs for a in t.iterfind(".//x:a", _NS)]
            if not links and any(re.fullmatch("h[1-6]", e.tag.rpartition("}")[2]) for doc in docs.values() for e in doc.iter() if isinstance(e.tag, str)):
                say("warning", "toc_empty")
            for h in links:
                follow(nav, h, "toc_link_broken", None)
        except ET.ParseError as e:
            say("error", "nav_invalid", str(e))
    if ncx in names:
        try:
            for c in ET.fromstring(z.read(ncx)).iterfind(".//n:content", _NS):
                follow(ncx, c.get("src", ""), "ncx_link_broken", None)
        except ET.ParseError as e:
            say("error", "ncx_invalid", str(e))
    sheets = {posixpath.basename(path[k]) for k, e in items.items() if path[k].endswith(".css") and there(path[k])}
    if not sheets:
        say("error", "css_missing")
    elif styles - sheets:
        say("error", "css_link_broken", ", ".join(sorted(styles - sheets)))
    elif not styles & sheets:
        say("error", "css_unlinked", ", ".join(sorted(sheets)))
    tags = [e for doc in docs.values() for e in doc.iter() if isinstance(e.tag, str)]
    if math and not any(e.tag.endswith("}math") for e in tags):
        say("error", "math_expected")
    if footnotes and not any("footnote" in (e.get(toc_type) or "") for e in tags):
        say("error", "footnotes_expected")
    if (n_images := sum(e.tag.endswith("}img") for e in tags)) < images:
        say("error", "images_expected", f"{n_images} of {images}")
    cover = next((path[k] for k, e in items.items() if "cover-image" in (e.get("properties") or "").split()), None)
    if cover and cover in names and cover not in used:
        say("error", "cover_unreferenced", cover)
    elif cover:
        first = next((i for i, (here, doc) in enumerate(docs.items()) if any(e.tag.endswith("}img") and at(e.get("src", ""), posixpath.dirname(here)) == cover for e in doc.iter() if isinstance(e.tag, str))), None)
        if first:
            say("warning", "cover_not_first", cover)
    for k, e in items.items():
        real = path[k] if path[k] in names else unquote(path[k])
        if (e.get("media-type") or "").startswith("image/") and real in names and real not in used and path[k] != cover:
            say("warning", "image_orphan", path[k])
    return out


def stats(data: bytes) -> dict[str, int]:
    """Counters of a container's documents."""
    out = dict.fromkeys(("documents", "chars", "headings", "images", "tables", "math", "links", "breaks", "code", "footnotes"), 0)
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, EOFError, OSError):
        return out
    for name in z.namelist():
        if not name.endswith((".xhtml", ".html")) or "nav" in posixpath.basename(name):
            continue
        try:
            root = ET.fromstring(z.read(name))
        except ET.ParseError:
            continue
        out["documents"] += 1
        body = root.find(".//x:body", _NS)
        out["chars"] += len(re.sub(r"\s+", "", "".join(body.itertext()))) if body is not None else 0
        for e in root.iter():
            tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
            key = {"img": "images", "table": "tables", "math": "math", "a": "links", "br": "breaks", "pre": "code"}.get(tag) or ("headings" if re.fullmatch("h[1-6]", tag) else None)
            if key:
                out[key] += 1
            if tag == "a" and "noteref" in (e.get("{http://www.idpf.org/2007/ops}type") or ""):
                out["footnotes"] += 1
    return out


def read_containers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the containers below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(folder).select("path", "content")


@F.pandas_udf(T.ArrayType(ISSUE))
def _check_udf(data: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("level", "code", "message"), x, strict=True)) for x in (check(d) if d is not None else [("error", "archive_unreadable", "missing")])] for d in data], dtype=object)


def structural_issues(containers: DataFrame) -> DataFrame:
    """(path, level, code, message)."""
    return containers.select("path", F.explode(_check_udf("content")).alias("i")).select("path", "i.*")


@F.pandas_udf(T.MapType(T.StringType(), T.LongType()))
def _stats_udf(data: pd.Series) -> pd.Series:
    return pd.Series([stats(d) if d is not None else {} for d in data], dtype=object)


def container_counters(containers: DataFrame) -> DataFrame:
    """(path, counters map)."""
    return containers.select("path", _stats_udf("content").alias("counters"))


def pack(entries: list[tuple[str, bytes]]) -> bytes:
    """A container of the entries, its mimetype first and uncompressed."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(entries, key=lambda e: e[0] != "mimetype"):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return buffer.getvalue()
