"""Main text of web pages: landmarks, and host suffix arrays for the rest.

A page is cut into blocks of text in page order.  Hidden matter (markup,
scripts, styles, forms, comments in the markup) is never text.  Blocks inside
an ``article`` or ``main`` landmark are the main text; menus, headers, footers,
sidebars, notices, adverts and reader comments inside or outside it, told by
element, role or class, are not.  A landmark that opens inside such an element
ends it only if it is never closed later (a menu left open), or if it is a nav
or header, no landmark came before, and none follows its end; teasers and reader
comments marked up as articles go with the sidebar or section that they are in.

What stays is cleaned of what its host repeats, in whole blocks only, never
words out of a sentence.  A substring is repeated if at least ``LEAST`` pages and
the share ``SHARE`` of all pages of the host have it.  Outside landmarks a block
is boilerplate if the whole block is repeated, or if every token of it lies in
repeated substrings of ``RUN`` tokens of the page's stream (the tokens of all
blocks outside landmarks); there it is the method that tells the text of pages
without a landmark.  Inside landmarks a block of fewer than ``RUN`` tokens is
boilerplate if the whole block is repeated (share lines, notices).

A page of which nothing would stay is a copy rather than a frame: without a
landmark it keeps its blocks of ``RUN`` tokens and more, with one all of it.
Paragraphs inside landmarks stay even where pages repeat them, because copies of
an article are articles too.  Pages whose url has no host are compared with none.

Suffixes of the streams are grouped by a hash of host and first ``RUN`` tokens,
whole blocks by one of host and text.  Keys are counted by rows before the
shuffle; only those of enough rows are counted by pages, so a host of any size
is spread over all tasks.

Null html is empty text.  Html is read whole.  Repeated rows give repeated
results and are no reason to call their text boilerplate (they are the same
page); pages without an id are told apart by url.  Other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import longs, map_texts
from basketry.session import materialize

#: Tokens that a repeated substring has at least, if it is not a whole block.
RUN = 20
#: Pages, and share of the host's pages, that have a repeated substring at least.
LEAST, SHARE = 5, 0.5

_SPECIAL = re.compile("[\"'>]")  # what decides where a tag ends
_NAME_END = re.compile(r"[\s/>]")
_RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "audio", "video"}
_CHROME = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "fieldset", "dialog", "head"}
_LANDMARK = {"article", "main"}
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "legend", "li", "main", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | _CHROME
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "comment-list", "cookie", "cookies", "cookie-notice", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "share", "sharing", "sidebar", "site-footer", "site-header", "skip-link", "social", "sponsored", "subscribe", "toolbar", "widget"}
#: Names that make a class or id chrome as one of its parts, too: cookie-banner, user_comments.
_PARTS = {"ad", "ads", "advert", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "menu", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsored", "subscribe"}
#: First parts of names that tell a state of the page: has-sidebar, no-comments.
_STATES = {"has", "is", "no", "with", "without", "not"}
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_TEXT_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}


def _named_chrome(name: str, in_parts: bool) -> bool:
    parts = re.split("[-_]+", name)
    return name in _NAMES or in_parts and parts[0] not in _STATES and not _PARTS.isdisjoint(parts)


def _is_chrome(tag: str, attributes: str) -> bool:
    if tag in _CHROME:
        return True
    if not attributes:
        return False
    if "hidden" in (_ATTRIBUTE.sub(" ", attributes) if "=" in attributes else attributes).lower().split():
        return True
    if "=" not in attributes or tag in ("body", "html"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = " ".join(values).lower()
        words = value.split()
        name = name.lower()
        # a heading or paragraph is not chrome for the anchor it is
        if name == "class" or name == "id" and tag not in _TEXT_TAGS:
            if any(_named_chrome(w, tag not in _LANDMARK) for w in words):
                return True
        elif name == "role" and not _ROLES.isdisjoint(words) or name == "aria-hidden" and words == ["true"] or name == "style" and _UNSEEN.search(value):
            return True
    return False


def tokens(page: str) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, closing, tag, attributes) of the markup, comments and such with
    an empty tag, raw elements up to their end.  One pass: where a tag beginning
    at a place ends is known from the quotes and brackets after it, found from
    the end of the page backwards."""
    special = [(m.start(), m.group()) for m in _SPECIAL.finditer(page)]
    place = [at for at, _ in special]
    ends = [-1] * (len(special) + 1)
    following: dict[str, int] = {}
    for k in range(len(special) - 1, -1, -1):
        at, c = special[k]
        if c == ">":
            ends[k] = at
        else:
            ends[k] = ends[following[c] + 1] if c in following else -1
            following[c] = k
    out, at, name_end = [], 0, 0
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        c = page[at:at + 1]
        if c and c in "!?":
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
            elif (end := page.find(">", at)) >= 0:
                at = end + 1
            else:
                continue
            out.append((start, at, False, "", ""))
            continue
        name = at + (c == "/")
        if not ("a" <= page[name:name + 1].lower() <= "z" and page[name].isascii()):
            continue
        if name + 1 > name_end:
            found = _NAME_END.search(page, name + 1)
            name_end = found.start() if found else len(page)
        end = ends[bisect_left(place, name_end)]
        if end < 0:
            continue
        tag, attributes = page[name:name_end].lower(), page[name_end:end]
        at = end + 1
        if c != "/" and tag in _RAW:
            if not attributes.endswith("/"):
                close = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = len(page) if end < 0 else end + 1
            tag = ""
        out.append((start, at, c == "/", tag, attributes))
    return out


def _ends(found: list[tuple[int, int, bool, str, str]]) -> dict[int, int]:
    """Start tag -> the end tag that closes its element, by number; start tags of
    elements that are never closed, or not before the body's end, have none."""
    out: dict[int, int] = {}
    open_tags: dict[str, list[int]] = {}
    for i, (_, _, closing, tag, _) in enumerate(found):
        if not closing:
            if tag:
                open_tags.setdefault(tag, []).append(i)
        elif open_tags.get(tag):
            out[open_tags[tag].pop()] = i
        elif tag in ("body", "html"):
            open_tags.clear()
    return out


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) in page order; zone is article, open or chrome."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    landmarks = 0  # open landmark elements
    chrome = ""  # the element that everything is chrome in, and how often it is open
    depth = 0
    held_open: bool | None = None  # whether that element holds landmarks rather than being ended by one, once known
    seen = False  # a landmark
    began = 0  # its start tag

    def close() -> None:
        text = " ".join(references.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(("chrome" if chrome else "article" if landmarks else "open", text))

    markup = tokens(page)
    closed_by = _ends(markup)
    last_landmark = max((i for i, t in enumerate(markup) if not t[2] and t[3] in _LANDMARK), default=-1)
    at = 0
    for i, (start, end, closing, tag, attributes) in enumerate(markup):
        held.append(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if tag in _BLOCK or tag == chrome:
                close()
            if tag == chrome:
                depth -= 1
                if not depth:
                    chrome = ""
            elif tag in _LANDMARK and landmarks and not chrome:
                landmarks -= 1
            elif tag in ("body", "html"):
                landmarks, chrome, depth = 0, "", 0
            continue
        if tag == "br":
            held.append(" ")
        empty = tag in _VOID
        enters = not chrome and not empty and _is_chrome(tag, attributes)
        if tag in _BLOCK or enters:
            close()
        if tag in _LANDMARK and not (enters and tag != "main"):
            # a landmark ends a menu that was never closed
            if chrome and not landmarks:
                if held_open is None:
                    over = None if chrome == "p" else closed_by.get(began)
                    held_open = over is not None and (chrome not in ("nav", "header") or seen or last_landmark > over)
                if not held_open:
                    chrome, depth = "", 0
            if not chrome:
                landmarks += 1
                seen = True
        elif enters:
            chrome, depth, held_open, began = tag, 1, None, i
        elif chrome and tag == chrome:
            depth += 1
    held.append(page[at:])
    close()
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(parts)) - (1 << 63)


def page_keys(text: str, host: str) -> dict[int, list[int]]:
    """Keys of a page and their places: token positions of suffixes, -2 - i for
    the whole block i, -1 for the page itself under its host's key."""
    places: dict[int, list[int]] = {_key(host): [-1]}
    tokens = []
    for i, (zone, block) in enumerate(blocks(text)):
        own = block.split(" ")
        if zone != "article":
            tokens += own
        if zone != "article" or len(own) < RUN:
            places.setdefault(_key(host, "block", block), []).append(-2 - i)
    for i in range(len(tokens) - RUN + 1):
        places.setdefault(_key(host, "run", *tokens[i:i + RUN]), []).append(i)
    return places


def streams(pages: DataFrame) -> DataFrame:
    """Keys of the pages that have a host, once per page: ``row, page, host,
    suffix, places``."""

    def rows(part, texts):
        row, page, key, site, places = [], [], [], [], []
        columns = (part.column(c).to_pylist() for c in ("row", "page_id", "url"))
        for r, page_id, url, text in zip(*columns, texts):
            if not (host := host_of(url)):
                continue
            own = page_id if page_id is not None else xxhash.xxh3_64_intdigest(url) - (1 << 63)
            found = page_keys(text, host)
            row += [r] * len(found)
            page += [own] * len(found)
            site += [_key(host)] * len(found)
            key += found
            places += found.values()
        return pa.RecordBatch.from_arrays([longs(row), longs(page), longs(site), longs(key), pa.array(places, pa.list_(pa.int64()))], ["row", "page", "host", "suffix", "places"])

    return map_texts(pages, "html", rows, "row bigint, page bigint, host bigint, suffix bigint, places array<bigint>")


def covered(keys: DataFrame) -> DataFrame:
    """Per row the places of repeated keys: ``row, places array<bigint>``."""
    # rows are at least as many as pages: few keys are left to count exactly
    many = keys.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select("suffix")
    held = materialize(keys.join(many, "suffix"), "html-keys")
    pages = held.select("host", "suffix", "page").distinct().groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("n"))
    hosts = pages.where(F.col("suffix") == F.col("host")).select("host", F.col("n").alias("all"))
    repeated = pages.where((F.col("suffix") != F.col("host")) & (F.col("n") >= LEAST)).join(hosts, "host").where(F.col("n") >= F.col("all") * SHARE).select("suffix")
    return held.join(repeated, "suffix").groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places"))


PARTS = pa.list_(pa.struct([("zone", pa.string()), ("size", pa.int64()), ("text", pa.string())]))


def _parsed(pages: DataFrame) -> DataFrame:
    """All blocks of a page with their tokens' number, and the text of those
    that may be main text."""

    def rows(part, texts):
        parts = []
        for text in texts:
            found = blocks(text)
            main = "article" if any(zone == "article" for zone, _ in found) else "open"
            parts.append([{"zone": zone, "size": b.count(" ") + 1, "text": b if zone == main else None} for zone, b in found])
        return pa.RecordBatch.from_arrays([part.column(c) for c in ("row", "page_id", "url")] + [pa.array(parts, PARTS)], ["row", "page_id", "url", "parts"])

    return map_texts(pages, "html", rows, "row bigint, page_id bigint, url string, parts array<struct<zone: string, size: bigint, text: string>>")


def main_text(parts: list[dict], places: list[int]) -> tuple[str, int]:
    """Text that stays of a page's blocks, and how many tokens are boilerplate."""
    whole = {-2 - p for p in places if p < -1}
    size = sum(b["size"] for b in parts if b["zone"] != "article")
    bare = np.ones(size, dtype=bool)  # tokens of the stream that no repeated run covers
    for p in places:
        if p >= 0:
            bare[p:p + RUN] = False
    gone, at = [], 0
    for i, b in enumerate(parts):
        gone.append(i in whole)
        if b["zone"] != "article":
            gone[i] = gone[i] or not bare[at:at + b["size"]].any()
            at += b["size"]
    kept = [b for b, g in zip(parts, gone) if b["text"] is not None and not g]
    if not kept:
        for i, b in enumerate(parts):
            if b["text"] is not None and (b["zone"] == "article" or b["size"] >= RUN):
                gone[i] = False
                kept.append(b)
    return "\n".join(b["text"] for b in kept), sum(b["size"] for b, g in zip(parts, gone) if g)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id, url, text, n_chars`` and how many tokens are
    boilerplate by repetition (``n_boilerplate``)."""
    numbered = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    both = _parsed(numbered).join(covered(streams(numbered)), "row", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(parts, places or []) for parts, places in zip(batch.column("parts").to_pylist(), batch.column("places").to_pylist())]
            columns = [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), longs([n for _, n in found])]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_boilerplate"])

    told = both.select("page_id", "url", "parts", "places").mapInArrow(rows, "page_id bigint, url string, text string, n_boilerplate bigint")
    return told.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_boilerplate")
