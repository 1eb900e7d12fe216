"""HTML pages to articles and links, with built-in string expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswatch.functions.parsing import TIMESTAMP_FORMATS, try_ts
from corpuswatch.functions.text import computed_once, head, strip
from corpuswatch.operators.identity import with_content_hash

# Named character references that are resolved.
NAMED_ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "hellip": "…", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "copy": "©", "middot": "·", "eacute": "é", "egrave": "è",
    "agrave": "à", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "ccedil": "ç", "euro": "€",
}


def unescape_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal character references to characters, two surrogates to one; ``&amp;`` last.

    Numbers that are no character become U+FFFD.
    """
    for name, char in NAMED_ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return bound(c, lambda text: F.replace(F.when(text.contains("&#"), _numbered(text)).otherwise(text), F.lit("&amp;"), F.lit("&")))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def _numbered(c: Column) -> Column:
    one = r"&#(?:[xX][0-9A-Fa-f]{1,6}|\d{1,7});"
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?:{one})+"), F.lit(0)))

    def number(reference):
        digits = F.regexp_replace(reference, r"[&#;xX]", "")
        return F.when(F.lower(reference).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")

    def character(code):
        bad = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")

    def put(text, run):
        codes = F.transform(F.regexp_extract_all(run, F.lit(one), F.lit(0)), number)

        def spelled(code, i):
            before, after = F.get(codes, i - 1), F.get(codes, i + 1)
            leads = code.between(0xD800, 0xDBFF) & after.between(0xDC00, 0xDFFF)
            follows = code.between(0xDC00, 0xDFFF) & before.between(0xD800, 0xDBFF)
            pair = (code - 0xD800) * 0x400 + after - 0xDC00 + 0x10000
            return F.when(leads, character(pair)).when(follows, F.lit("")).otherwise(character(code))

        return F.replace(text, run, F.array_join(F.transform(codes, spelled), ""))

    # Longer runs first, so that none is cut by a shorter one inside it.
    ordered = F.reverse(F.array_sort(F.transform(found, lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))))
    return F.aggregate(ordered, c, lambda text, r: put(text, r["run"]))


def visible_html(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")


def element_html(html: Column, tag: str | None, css_class: str | None = None) -> Column:
    """Inner markup of the first such element, up to the tag that closes it; null when there is none or it is never closed.

    Elements of the same name inside it are counted. Without ``tag`` the class alone decides.
    """
    attributes = r"[^>]*" if css_class is None else rf"[^>]*class\s*=\s*[\"'](?:[^\"']*\s)?{re.escape(css_class)}(?:\s[^\"']*)?[\"'][^>]*"
    opening = F.regexp_extract(html, rf"(?is)<{tag or '[a-z][a-z0-9]*'}\b{attributes}>", 0)
    if tag:
        # Most elements hold no other of their name: the first closing tag ends them.
        flat = F.regexp_extract(html, rf"(?is)<{tag}\b{attributes}>(.*?)</{tag}\s*>", 1)
        whole = bound(opening, lambda found: _balanced(html, found, F.lit(tag)))
        return bound(flat, lambda inner: F.when(inner.rlike(rf"(?i)<{tag}\b"), whole).otherwise(F.nullif(inner, F.lit(""))))
    return bound(opening, lambda found: _balanced(html, found, F.regexp_extract(found, r"^<(\w+)", 1)))


def _balanced(html: Column, opening: Column, name: Column) -> Column:
    """Markup from the opening tag to the tag that closes it."""
    either = F.concat(F.lit("(?is)<"), name, F.lit(r"\b[^>]*>|</"), name, F.lit(r"\s*>"))
    rest = F.substring(html, F.instr(html, opening) + F.length(opening), F.length(html))
    return F.when(opening != "", bound(rest, lambda text: _until_closed(text, either)))


def _until_closed(rest: Column, either: Column) -> Column:
    steps = F.arrays_zip(F.split(rest, either).alias("text"), F.regexp_extract_all(rest, either, F.lit(0)).alias("mark"))

    def step(s, x):
        depth = s["depth"] + F.when(x["mark"].startswith("</"), -1).otherwise(1)
        at = s["at"] + F.length(x["text"])
        return F.struct(
            depth.alias("depth"), (at + F.coalesce(F.length(x["mark"]), F.lit(0))).alias("at"),
            F.coalesce(s["end"], F.when(depth == 0, at)).alias("end"),
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))
    end = F.aggregate(steps, start, step)["end"]
    return F.nullif(F.left(rest, end), F.lit(""))


def element_text(inner: Column, separator: str) -> Column:
    """Text nodes of the markup, each trimmed, joined by the separator."""
    return unescape_entities(strip(F.regexp_replace(inner, r"\s*(?:<[^>]+>\s*)+", separator)))


def articles_from_pages(
    pages: DataFrame,
    as_of: Column,
    content_tag: str | None = "article",
    content_class: str | None = None,
    title_tag: str = "h1",
    min_chars: int = 100,
    html_chars: int | None = None,
) -> DataFrame:
    """Pages (``page_id``, ``url``, ``html``) to articles; no title or a short text drops the page. ``raw_html`` is the whole page unless ``html_chars`` is given."""
    # Pages and elements are cut out once each; the row filter and the outputs then read finished columns.
    staged = computed_once(pages, _visible=visible_html(F.col("html")))
    staged = computed_once(
        staged,
        title=F.coalesce(element_text(element_html(F.col("_visible"), title_tag), ""), F.lit("")),
        content=F.coalesce(element_text(element_html(F.col("_visible"), content_tag, content_class), " "), F.lit("")),
    ).where((F.col("title") != "") & (F.length("content") >= min_chars))
    meta = F.regexp_extract("html", r"(?is)<meta\b[^>]*property\s*=\s*[\"']article:published_time[\"'][^>]*>", 0)
    published = F.nullif(F.regexp_extract(meta, r"(?is)content\s*=\s*[\"']([^\"']*)", 1), F.lit(""))
    kept = staged.select(
        "page_id",
        "url",
        "title",
        "content",
        F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("unknown")).alias("source"),
        F.lit("web").alias("source_type"),
        F.coalesce(try_ts(published, *TIMESTAMP_FORMATS), as_of).alias("published_at"),
        head(F.col("html"), html_chars).alias("raw_html"),
    )
    return with_content_hash(kept)


def _without_dot_segments(path: Column) -> Column:
    def step(done, segment):
        return (
            F.when(segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    segments = F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step)
    return F.array_join(segments, "/")


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute address of a link found on a page."""
    origin = F.regexp_extract(base, r"^[A-Za-z][\w+.-]*://[^/?#]*", 0)
    scheme = F.regexp_extract(base, r"^[A-Za-z][\w+.-]*:", 0)
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    base_path = F.regexp_replace(page, r"^[A-Za-z][\w+.-]*://[^/]*", "")
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(base_path, r"^/", ""), r"[^/]*$", ""))
    path = F.regexp_extract(href, r"^[^?#]*", 0)
    tail = F.regexp_extract(href, r"[?#].*$", 0)
    return (
        F.when(href.rlike(r"^[A-Za-z][\w+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("/"), F.concat(origin, _without_dot_segments(path), tail))
        .otherwise(F.concat(origin, _without_dot_segments(F.concat(folder, path)), tail))
    )


def page_links(pages: DataFrame, min_path_len: int | None = None, cap: int | None = None) -> DataFrame:
    """Same-host links of each page in document order without repeats.

    The analysed system takes the first 30 links of a page, of rendered index pages the first 50 with
    ``min_path_len=20``; without ``cap`` no link is lost. All work happens inside one row, so the
    only growth is the final explode.
    """
    hrefs = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    host = F.try_parse_url(F.col("url"), F.lit("AUTHORITY"))
    links = F.transform(hrefs, lambda h: resolve_link(F.col("url"), h))

    def wanted(link):
        ok = F.try_parse_url(link, F.lit("AUTHORITY")) == host
        if min_path_len is not None:
            ok = ok & (F.length(F.coalesce(F.try_parse_url(link, F.lit("PATH")), F.lit(""))) > min_path_len)
        return ok

    distinct = F.array_distinct(F.filter(links, wanted))
    if cap is not None:
        distinct = F.slice(distinct, 1, cap)
    return pages.select("page_id", F.posexplode(distinct).alias("pos", "link"))
