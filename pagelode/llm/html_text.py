"""Main text of web pages: structure first, then a suffix array over each host's token streams.

1. Each page is read once, tag by tag, into blocks of text. Elements that are never main text (menus, headers and footers of
   the page, sidebars, notices, adverts, forms, scripts, styles, reader comments), told by their name, role, class
   or id, are left out: a class or id counts if it names the element (`sidebar`, `cookie-notice`, `ad-box`; not `has-sidebar`,
   `sidebar-wrap` or `related-work`), and never hides a wrapper of the article or main part, nor a part of the article that is long and
   hardly links (a restaurant's menu). A form that holds most of the page's paragraphs is the page. Articles within an article that
   has text of its own are reader comments. If the page marks its main part, or else articles, and these hold `SHARE` of its
   text at least, only blocks inside count; a mere teaser doesn't stand for the page.
2. The token streams of a host's pages are concatenated, equal streams once, and their suffixes are sorted (prefix doubling);
   the common length of neighbours comes from the ranks of the doubling. Suffixes that share `RUN` tokens or more stand
   together, so a substring of RUN tokens or more, and the distinct pages that hold it, is a stretch of the suffix array.
3. Tokens covered by substrings on enough distinct pages of the host are boilerplate and go; unique runs stay. Enough (`bar`)
   is a fifth of the pages, `PLAIN_MIN` at least and `PLAIN_MOST` at most, where a page marks no article or main part; in a marked
   article, whose text is its own unless nearly all articles say so, it is half of the pages, `MARKED_MIN` at least. A
   marked page of which they cover more than half, without a block of RUN tokens or more that they leave alone, or a plain page that
   they cover whole, is a copy of other pages rather than boilerplate, and is kept whole. Pages with equal streams are one page
   where pages are counted; each is judged as it marks its text.
4. Hosts of more than `HOST_PAGES` pages or `HOST_BYTES` bytes aren't brought to one task. Their pages stay in block files as they
   are read (see repeats); each block sorts the suffixes of its streams, sends the names of their beginnings of RUN
   tokens with the number of distinct pages to buckets, and gets the number on the whole host back. Equal streams of
   different blocks count once: which one counts is settled before. The result is the same for any cut into blocks.

Defined results: null html gives an empty text; a null URL is a host of its own; tags that never close end with the page,
but an excluded element that never closes hides only the rest of its own block; repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, alone, mixed, prefix_hashes, span_hashes, text_buffers, word_spans, work_path, written
from .common import blocks as cut_blocks
from .repeats import (
    ANSWER, BLOB_SCHEMA, FILES, FIRST_BLOCK, SENT, answers_of, blob_batch, buckets_for, by_target, dealt, gathered, ipc_bytes, own_files, pack, put,
    rows_of, unpack,
)

RUN = 8
#: Pages and bytes of html that a task may get of one host, bytes of html for each task, and most rows of a table of hosts that is sent out.
HOST_PAGES, HOST_BYTES, TASK_BYTES, BROADCAST_HOSTS = 3000, 16 << 20, 32 << 20, 200_000
#: Bytes of text in a block of pages of large hosts.
PAGE_BLOCK = 2 << 20
#: Bytes of html that are turned into text at a time.
PART_BYTES = 4 << 20
PLAIN_SHARE, PLAIN_MIN, PLAIN_MOST, MARKED_SHARE, MARKED_MIN, COPY = 0.2, 3, 10, 0.5, 5, 0.5
#: Share of a page's text that what it marks must hold to stand for it; characters from which a named part of an article may be its text, and the
#: share of links below which it is.
SHARE, LONG, LINKS = 0.25, 200, 0.3

#: Tags, with quotes in them and, where quotes never close, without.
_QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?=[a-zA-Z/!?])""")
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<(?=[a-zA-Z/!?])""")
_ATTR = re.compile(r"""([^\s=/"'<>][^\s=/"'<>]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?+""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
NEVER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "object", "video", "audio", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "sidebar", "menu", "nav",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "newsletter",
    "subscribe", "share", "sharing", "social", "comment", "comments", "disqus", "footer", "widget", "related", "toolbar", "masthead", "pagination",
    "login", "signup", "banner", "disclaimer",
}
ARTICLE_NAMES = {"comment", "comments", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "related"}
#: First words of compounds that tell how a page is laid out; last words that name a part or place of what stands before.
STATES = {"has", "have", "no", "not", "with", "without", "hide", "show", "col", "cols"}
PARTS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "cards", "center", "container", "content", "feed", "form", "group", "head",
    "heading", "icons", "inner", "item", "items", "label", "left", "link", "links", "list", "message", "outer", "panel", "posts", "primary", "region", "right",
    "row", "secondary", "section", "slot", "text", "thread", "title", "top", "unit", "widgets", "articles", "stories", "icon", "image", "next", "overlay", "previous",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "caption",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SPACED = {"br", "td", "th"}
_RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}


def _marks(attributes: str) -> tuple[list[str], list[str], str, str]:
    """(class tokens, ids, role, itemprop); the role of what isn't shown is `hidden`."""
    own: dict[str, str] = {}
    for key, *values in _ATTR.findall(attributes):
        own.setdefault(key.lower(), "".join(values))
    role = "hidden" if "hidden" in own or _NO_DISPLAY.search(own.get("style", "")) else own.get("role", "").strip().lower()
    return own.get("class", "").split(), own.get("id", "").split(), role, own.get("itemprop", "").strip().lower()


def _heads(tokens: list[str]) -> set[str]:
    """What each token names: itself, or the last word of a compound that isn't a mere part or place of the thing."""
    heads = set()
    for token in tokens:
        words = [x.lower() for x in _NAME.findall(token)]
        if not words or len(words) > 1 and words[0] in STATES:
            continue
        while len(words) > 1 and words[-1] not in NAMES and (words[-1] in PARTS or words[-1].isdigit() or len(words[-1]) == 1):
            words.pop()
        heads.add(words[-1])
    return heads


def _excluded(name: str, attributes: str, inside: bool, wraps: bool = False, holds_page: bool = False, is_text: bool = False) -> bool:
    """Whether an element is never main text. wraps: it holds the page's articles or main part (see _core); holds_page: most of the page's paragraphs; is_text:
    it is long and hardly links."""
    if name in NEVER:
        return name != "form" or not wraps and not holds_page
    if name in ("html", "body", "main"):
        return False
    if name == "header" and not inside:
        return True
    if not attributes or attributes.isspace():
        return False
    classes, ids, role, _ = _marks(attributes)
    heads = _heads(classes if name in HEADINGS else classes + ids)
    if name == "article":
        return bool(heads & ARTICLE_NAMES)
    if role in ROLES or role == "hidden":
        return True
    if wraps:
        return False
    named = heads & (ARTICLE_NAMES if inside and is_text else NAMES)
    return bool(named) or ("header" in heads and not inside and not {x.lower() for t in classes + ids for x in _NAME.findall(t)} & {"article", "entry", "post"})


def _tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(from, to, name, closing, attributes) of the tags of a page; what is no tag, or raw text, has no name. Nothing is looked at twice for want of an end: after the
    last > there is no tag, and if a quote of one tag never closes, quotes don't count in those behind it."""
    out = []
    at, size, pattern = 0, page.rfind(">") + 1, _QUOTED
    while at < size and (m := pattern.search(page, at, size)):
        start, name, closing, attributes = m.start(), "", False, ""
        if m[2] is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                other = page.find("--!>", start + 4, end if end >= 0 else len(page))
                at = other + 4 if other >= 0 else end + 3 if end >= 0 else len(page)
            elif page.startswith("<![CDATA[", start) and page.find("]]>", start) >= 0:
                at = page.find("]]>", start) + 3
            elif page[start + 1] in "!?" or page.startswith("</", start):
                at = page.find(">", start) + 1 if page[start + 1] in "!?" else start + 1
                if page[start + 1] == "/":
                    continue  # text
            else:
                pattern = _PLAIN
                at = start
                continue
        else:
            at = m.end()
            name, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if name in RAW and not closing:
            stop = _RAW_END[name].search(page, at)
            at = stop.start() if stop else len(page)
            name = ""
        out.append((start, at, name, closing, attributes))
    return out


class _Measures:
    """How much text stands before each tag: all that may be shown, what is in paragraphs, what is in links. Menus and the like don't count."""

    def __init__(self, page: str, tags: list[tuple[int, int, str, bool, str]], ends: dict[int, int]):
        self.ends, self.all, self.paragraphs, self.links = ends, [], [], []
        at = never_to = 0
        total = paragraphs = links = 0
        in_p = in_a = False
        for k, (start, end, name, closing, _) in enumerate(tags):
            if start > at and k >= never_to:
                n = len(page[at:start].strip())
                total += n
                paragraphs += n * in_p
                links += n * in_a
            self.all.append(total)
            self.paragraphs.append(paragraphs)
            self.links.append(links)
            at = end
            if k < never_to:
                continue
            if name == "a":
                in_a = not closing
            elif name in BLOCK:
                in_p = name == "p" and not closing
            if name in NEVER and name != "form" and not closing:
                never_to = ends.get(k, k)
        n = len(page[at:].strip())
        for counts, more in ((self.all, total + n), (self.paragraphs, paragraphs + n * in_p), (self.links, links)):
            counts.append(more)

    def of(self, counts: list[int], k: int) -> int:
        """Of an element, by the number of its start tag."""
        return counts[self.ends.get(k, len(counts) - 1)] - counts[k]

    def is_text(self, k: int) -> bool:
        n = self.of(self.all, k)
        return k in self.ends and n >= LONG and self.of(self.links, k) < LINKS * n

    def holds_page(self, k: int) -> bool:
        return 2 * self.of(self.paragraphs, k) > self.all[-1]


def _comments(tags: list[tuple[int, int, str, bool, str]], measures: _Measures) -> set[int]:
    """Numbers of articles within articles that have a good part of their text to themselves."""
    nested: dict[int, list[int]] = {}
    open_: list[int] = []
    for k, (_, _, name, closing, _) in enumerate(tags):
        if name == "article" and not closing and k in measures.ends:
            while open_ and measures.ends[open_[-1]] < k:
                open_.pop()
            if open_:
                nested.setdefault(open_[-1], []).append(k)
            open_.append(k)
    out = set()
    for k, inner in nested.items():
        text = measures.of(measures.all, k)
        if text - sum(measures.of(measures.all, j) for j in inner) >= SHARE * text:
            out.update(inner)
    return out


def _ends(tags: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """Numbers of start tags and of the end tags that close them, by a stack per name; what never closes is absent."""
    ends: dict[int, int] = {}
    open_tags: dict[str, list[int]] = {}
    for k, (_, _, name, closing, attributes) in enumerate(tags):
        if not name or name in VOID:
            continue
        if closing:
            if own := open_tags.get(name):
                ends[own.pop()] = k
        elif not attributes.endswith("/"):
            open_tags.setdefault(name, []).append(k)
    return ends


def _core(tags: list[tuple[int, int, str, bool, str]], ends: dict[int, int]) -> list[int]:
    """Numbers of the start tags whose elements no wrapper may hide, whatever its class or id: the main parts outside menus and
    the like; without any, the articles outside those and comments, adverts or related pages, unless some article stands free."""
    mains, articles, free, never_to, other_to, named_to = [], [], False, -1, -1, -1
    for k, (_, _, name, closing, attributes) in enumerate(tags):
        if k <= never_to or closing or not name or name in VOID:
            continue
        if name in NEVER and name != "form":
            never_to = ends.get(k, k)
            continue
        role = prop = ""
        heads: set[str] = set()
        if attributes and not attributes.isspace():
            classes, ids, role, prop = _marks(attributes)
            heads = _heads(classes if name in HEADINGS else classes + ids)
        if name == "main" or role == "main":
            mains.append(k)
        elif name == "article" or prop == "articlebody" or role == "article":
            if k > other_to and not heads & ARTICLE_NAMES:
                articles.append(k)
                free = free or k > named_to
        if name in ("html", "body", "main"):
            continue
        if heads & ARTICLE_NAMES:
            other_to = max(other_to, ends.get(k, k))
        if name == "form" or name != "article" and heads & NAMES:
            named_to = max(named_to, ends.get(k, k))
    return mains or ([] if free else articles)


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in order; zone 2 in an article, 1 in the main part, else 0."""
    tags = _tags(page)
    ends = _ends(tags)
    core = _core(tags, ends)
    measures = _Measures(page, tags, ends)
    comments = _comments(tags, measures)
    out: list[tuple[int, str]] = []
    held: list[str] = []
    zones: list[list] = []  # [tag, zone, depth of that tag]
    zone, skip_to, rest_of_block, at = 0, -1, False, 0

    def flush():
        if held:
            text = "".join(held)
            if "&" in text:
                text = html_lib.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append((zone, text))
            held.clear()

    for k, (start, end, name, closing, attributes) in enumerate(tags):
        if k <= skip_to:
            at = end
            continue
        if not rest_of_block and start > at:
            held.append(page[at:start])
        at = end
        if not name:
            if not rest_of_block and page.startswith("<![CDATA[", start):
                held.append(page[start + 9 : end - 3].replace("&", "&amp;"))
            continue
        block = name in BLOCK
        if block:
            rest_of_block = False
            flush()
        elif name in SPACED and not rest_of_block:
            held.append(" ")
        if closing:
            if zones and zones[-1][0] == name:
                zones[-1][2] -= 1
                if not zones[-1][2]:
                    zones.pop()
                    zone = zones[-1][1] if zones else 0
            continue
        if name in VOID or rest_of_block:
            continue
        place = bisect_right(core, k)
        wraps = place < len(core) and core[place] < ends.get(k, k)
        if k in comments or _excluded(name, attributes, zone > 0, wraps, name == "form" and measures.holds_page(k), measures.is_text(k)):
            if k in ends:
                skip_to = ends[k]
            elif not attributes.endswith("/"):
                rest_of_block = True
            continue
        own = 2 if name == "article" else 1 if name == "main" else 0
        if not own and attributes and ("role" in attributes or "itemprop" in attributes):
            _, _, role, prop = _marks(attributes)
            own = 2 if prop == "articlebody" or role == "article" else 1 if role == "main" else 0
        if own:
            flush()
            zones.append([name, max(own, zone), 1])
            zone = max(own, zone)
        elif zones and zones[-1][0] == name:
            zones[-1][2] += 1
    if not rest_of_block:
        held.append(page[at:])
    flush()
    return out


def main_blocks(page: str) -> tuple[int, list[str]]:
    """(zone, blocks): what is in the main part, or else in articles, if that is a good part of the page's text; else all, in zone 0."""
    blocks = page_blocks(page)
    zones = {z for z, _ in blocks}
    least = 1 if 1 in zones else 2 if 2 in zones else 0
    own = [t for z, t in blocks if z >= least]
    if sum(map(len, own)) < SHARE * sum(len(t) for _, t in blocks):
        return 0, [t for _, t in blocks]
    return least, own


def bar(zone: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """On how many distinct pages a substring is boilerplate, by the page's zone and the number of distinct pages of its host."""
    plain = np.clip(np.ceil(PLAIN_SHARE * pages), PLAIN_MIN, PLAIN_MOST)
    return np.where(zone > 0, np.maximum(np.ceil(MARKED_SHARE * pages), MARKED_MIN), plain)


def suffix_array(tokens: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the suffixes in order, tokens that each shares with the one before it); a suffix ends with its page."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.searchsorted(page, page, side="right")
    order = np.argsort(tokens, kind="stable")
    new = np.r_[True, tokens[order][1:] != tokens[order][:-1]]
    rank = np.empty(n, np.int64)  # how many suffixes stand before those with the same beginning
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, step, longest = [rank], 1, int((ends - np.arange(n)).max())
    open_ = order[~(new & np.r_[new[1:], True])]  # suffixes that others still equal
    while len(open_) and step < longest:
        after = np.where(open_ + step < ends[open_], rank[np.minimum(open_ + step, n - 1)] + 1, 0)
        by = np.argsort(rank[open_] * (n + 1) + after, kind="stable")
        at, after = open_[by], after[by]
        own, number = rank[at], np.arange(len(at))
        group = np.r_[True, own[1:] != own[:-1]]
        new = group | np.r_[True, after[1:] != after[:-1]]
        rank = rank.copy()
        rank[at] = own + np.maximum.accumulate(np.where(new, number, 0)) - np.maximum.accumulate(np.where(group, number, 0))
        ranks.append(rank)
        open_ = at[~(new & np.r_[new[1:], True])]
        step *= 2
    order = np.argsort(rank, kind="stable")
    a, b, common = order[1:].copy(), order[:-1].copy(), np.zeros(n - 1, np.int64)
    end_a, end_b = ends[a], ends[b]
    for k in range(len(ranks) - 1, -1, -1):
        here = np.flatnonzero((a < end_a) & (b < end_b))
        same = here[ranks[k][a[here]] == ranks[k][b[here]]]
        size = np.minimum(1 << k, end_a[same] - a[same])  # where a page ends within, both end
        common[same] += size
        a[same] += size
        b[same] += size
    return order, np.r_[0, common]


class Streams:
    """The token streams of pages (zone, blocks), one after another, and their repeated beginnings."""

    def __init__(self, pages: list[tuple[int, list[str]]]):
        blocks = [b for _, own in pages for b in own]
        raw, offsets = text_buffers(pa.array(blocks, pa.string()))
        starts, ends, self.block = word_spans(raw, offsets)
        self.tokens = span_hashes(prefix_hashes(raw), starts, ends)
        self.page = np.repeat(np.arange(len(pages)), [len(own) for _, own in pages])[self.block] if blocks else np.zeros(0, np.int64)
        self.zone = np.array([z for z, _ in pages], np.int64)
        self.pages, self.raw, self.spans = pages, raw, (starts, ends)

    def beginnings(self) -> tuple[np.ndarray, np.ndarray]:
        """(places whose suffix has RUN tokens or more, number of the stretch of the suffix array that shares them)"""
        order, common = suffix_array(self.tokens, self.page)
        left = np.searchsorted(self.page, self.page, side="right") - np.arange(len(self.page))
        number = np.cumsum(common < RUN)
        keep = left[order] >= RUN
        return order[keep], number[keep]

    def texts(self, often: np.ndarray, zone: np.ndarray) -> list[str]:
        """What is left of each page without the tokens covered by beginnings at the places given; zone: of each page."""
        n = len(self.page)
        change = np.zeros(n + RUN + 1, np.int64)
        np.add.at(change, often, 1)
        np.add.at(change, often + RUN, -1)
        hit = np.cumsum(change)[:n] > 0
        words, hits = np.bincount(self.page, minlength=len(self.pages)), np.bincount(self.page, hit, minlength=len(self.pages))
        own = (np.bincount(self.block) >= RUN) & (np.bincount(self.block, hit) == 0) if n else np.zeros(0, bool)  # blocks left alone
        has_own = np.bincount(self.page, own[self.block], minlength=len(self.pages)) > 0
        copy = np.where(zone > 0, (hits > COPY * words) & ~has_own, hits >= words)
        hit &= ~copy[self.page]
        out = [b for _, own in self.pages for b in own]
        touched = np.unique(self.block[hit])
        bounds = np.searchsorted(self.block, np.r_[touched, touched + 1]).reshape(2, -1)
        data = self.raw.tobytes()
        for k, s, e in zip(touched.tolist(), *bounds.tolist()):
            out[k] = b" ".join(data[a:b] for a, b, gone in zip(self.spans[0][s:e].tolist(), self.spans[1][s:e].tolist(), hit[s:e].tolist()) if not gone).decode()
        texts, at = [], 0
        for _, own in self.pages:
            texts.append("\n".join(b for b in out[at : at + len(own)] if b))
            at += len(own)
        return texts


def _pages_with(number: np.ndarray, page: np.ndarray, pages: int) -> np.ndarray:
    """By number, how many distinct pages go with it."""
    both = np.sort(number * pages + page)
    return np.bincount(both[np.r_[True, both[1:] != both[:-1]]] // pages) if len(both) else np.zeros(0, np.int64)


def host_texts(pages: list[tuple[int, list[str]]]) -> list[str]:
    """Texts of one host's (zone, blocks) pages without its boilerplate."""
    distinct: dict[tuple[str, ...], int] = {}
    which = [distinct.setdefault(tuple(blocks), len(distinct)) for _, blocks in pages]
    streams = Streams([(0, list(blocks)) for blocks in distinct])
    at, number = streams.beginnings()
    some = np.bincount(number)[number] >= PLAIN_MIN if len(number) else np.zeros(0, bool)  # fewer places than the least bar asks pages
    at, number = at[some], number[some]
    pages_with = _pages_with(number, streams.page[at], len(distinct))
    texts = {}
    for marked in {z > 0 for z, _ in pages}:  # equal streams may be marked on one page and not on another
        zone = np.full(len(distinct), int(marked))
        texts[marked] = streams.texts(at[pages_with[number] >= bar(zone, np.int64(len(distinct)))[streams.page[at]]], zone)
    return [texts[z > 0][k] for (z, _), k in zip(pages, which)]


PAGE_SCHEMA = "page_id long, url string, host string, zone int, blocks array<string>"
TEXT_SCHEMA = "page_id long, url string, text string, n_chars long"


def _extract(batches):
    for batch in (part for whole in batches for part in _parts(whole)):
        zones, blocks = [], []
        for page in batch["html"].to_pylist():
            zone, own = main_blocks(page or "")
            zones.append(zone)
            blocks.append(own)
        yield pa.RecordBatch.from_arrays(
            [*(batch[n] for n in ("page_id", "url", "host")), pa.array(zones, pa.int32()), pa.array(blocks, pa.list_(pa.string()))],
            names=["page_id", "url", "host", "zone", "blocks"],
        )


def _parts(batch: pa.RecordBatch):
    """Some pages of a batch at a time."""
    _, offsets = text_buffers(batch["html"])
    for i, j in cut_blocks(offsets, PART_BYTES):
        yield batch.slice(i, j - i)


def _texts(ids, urls, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
        names=["page_id", "url", "text", "n_chars"],
    )


def _clean(batches):
    """Whole hosts, one after another."""

    def texts(rows):
        return _texts([r[0] for r in rows], [r[1] for r in rows], host_texts([(r[3], r[4]) for r in rows]))

    host, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[2] != host:
                yield texts(held)
                held = []
            host = row[2]
            held.append(row)
    if held:
        yield texts(held)


# -- large hosts -------------------------------------------------------------------------------------------------

STORED_SCHEMA = "target long, path string, at int, host string, stream binary"


def _store(folder: str, block_text: int):
    """Writes extracted pages in block files; one row a page, with a hash of its stream."""

    def run(batches):
        number = FIRST_BLOCK + (TaskContext.get().partitionId() << 32 if TaskContext.get() else 0)
        for batch in _extract(batches):
            offsets = np.r_[0, np.cumsum([sum(map(len, own)) + 1 for own in batch["blocks"].to_pylist()])]
            for i, j in cut_blocks(offsets, block_text):
                number += 1
                own = batch.slice(i, j - i)
                streams = [hashlib.blake2b("\n".join(b).encode(), digest_size=16).digest() for b in own["blocks"].to_pylist()]
                path, n = put(folder, ipc_bytes(own)), j - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n, pa.int64()), pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32()), own["host"], pa.array(streams, pa.binary())],
                    names=["target", "path", "at", "host", "stream"],
                )

    return run


def _pack_counts(batches):
    """One row a block: its file, and for each of its pages whether it counts, and the distinct pages of its host."""
    for batch in batches:
        rows = []
        for target, path, pages in zip(*(batch[n].to_pylist() for n in ("target", "path", "pages"))):
            counts = np.array([p["counts"] for p in pages], "u1"), np.array([p["n"] for p in pages], "<i8")
            rows.append((target, FILES, path.encode() + b"\n" + b"".join(x.tobytes() for x in counts)))
        yield blob_batch(rows)


def _block_streams(files: bytes):
    """(rows, streams, which pages count, distinct pages of each page's host, places, per place a number of (host, beginning), the names of these)"""
    path, _, data = files.partition(b"\n")
    batch = rows_of(path)
    n = len(batch)
    counts, pages = np.frombuffer(data, "u1", n).astype(bool), np.frombuffer(data, "<i8", n, n)
    streams = Streams(list(zip(batch["zone"].to_pylist(), batch["blocks"].to_pylist())))
    at, number = streams.beginnings()
    hosts, host = np.unique(np.array(batch["host"].to_pylist(), object), return_inverse=True)
    pair, which = np.unique(number * len(hosts) + host[streams.page[at]], return_inverse=True)
    some = np.zeros(len(pair), np.int64)
    some[which] = at  # any place of each
    key = np.array([int.from_bytes(hashlib.blake2b(str(h).encode(), digest_size=8).digest(), "little") for h in hosts], np.uint64)
    value = np.zeros(len(pair), np.uint64)
    for k in range(RUN):
        value = (value + streams.tokens[some + k]) * BASE
    return batch, streams, counts, pages, at, which, mixed(value + key[pair % len(hosts)])


def _send_counts(buckets: int):
    def run(batches):
        for block, held in by_target(batches):
            files = own_files(held)
            _, streams, counts, _, at, which, names = _block_streams(files)
            on = counts[streams.page[at]]
            pages_with = np.zeros(len(names), np.int64)
            held_by = _pages_with(which[on], streams.page[at[on]], len(counts))
            pages_with[: len(held_by)] = held_by
            order, ends = dealt(names, buckets)
            packed = (names[order] // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            out = []
            for b, (s, e) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())):
                if e > s:
                    out.append((b, SENT, pack(np.array([block, e - s], "<i8"), packed[s:e], pages_with[order[s:e]].astype("<u4"))))
            yield blob_batch([*out, (block, FILES, files)])

    return run


def _sum_counts(batches):
    """Buckets: on how many distinct pages of its host a beginning is, to each block. What is addressed to a block passes on."""
    for target, held in by_target(batches):
        if target >= FIRST_BLOCK:
            yield blob_batch([(target, kind, x) for kind, x in held])
            continue
        parts = [unpack(x) for _, x in held]
        heads = [np.frombuffer(x, "<i8", 2).tolist() for x in parts]
        values = np.zeros((sum(n for _, n in heads), 8), np.uint8)
        values[:, :5] = np.concatenate([np.frombuffer(x, np.uint8, 5 * n, 16) for x, (_, n) in zip(parts, heads)]).reshape(-1, 5)
        counts = np.concatenate([np.frombuffer(x, "<u4", n, 16 + 5 * n) for x, (_, n) in zip(parts, heads)])
        which = np.unique(values.view("<u8").ravel(), return_inverse=True)[1]
        total = np.bincount(which, counts).astype("<u8")[which]
        ends = np.cumsum([n for _, n in heads])
        yield blob_batch([(block, ANSWER, pack(np.array([target], "<i8"), total[e - n : e])) for (block, n), e in zip(heads, ends.tolist())])


def _clean_blocks(buckets: int):
    def run(batches):
        for _, held in by_target(batches):
            batch, streams, _, pages, at, which, names = _block_streams(own_files(held))
            order, ends = dealt(names, buckets)
            starts, total = np.r_[0, ends[:-1]], np.zeros(len(names), np.int64)
            for x in map(unpack, answers_of(held)):
                b = int(np.frombuffer(x, "<i8", 1)[0])
                total[order[starts[b] : ends[b]]] = np.frombuffer(x, "<u8", offset=8)
            page = streams.page[at]
            often = at[total[which] >= bar(streams.zone, pages)[page]]
            yield _texts(batch["page_id"], batch["url"], streams.texts(often, streams.zone))

    return run


def _large_hosts(rows: DataFrame, total: int, block_text: int) -> DataFrame:
    spark = rows.sparkSession
    folder = work_path(spark, "page-blocks")
    pages = written(rows.mapInArrow(alone(_store(folder, block_text)), STORED_SCHEMA), "pages")
    # equal streams of a host count once
    first = pages.groupBy("host", "stream").agg(F.min(F.struct("target", "at")).alias("x"))
    sizes = written(first.groupBy("host").agg(F.count("*").alias("n")), "host-sizes")
    counts = written(first.select("x.*").withColumn("counts", F.lit(1)), "counting-pages")
    told = pages.join(counts, ["target", "at"], "left").join(sizes, "host")
    told = told.groupBy("target", "path").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("counts", F.lit(0)).alias("counts"), "n"))).alias("pages"))
    files = told.mapInArrow(alone(_pack_counts), BLOB_SCHEMA)
    buckets = buckets_for(spark, total)
    sent = gathered(files, buckets).mapInArrow(alone(_send_counts(buckets)), BLOB_SCHEMA)
    answered = gathered(sent, buckets).mapInArrow(alone(_sum_counts), BLOB_SCHEMA)
    return gathered(answered, buckets).mapInArrow(alone(_clean_blocks(buckets)), TEXT_SCHEMA)


def main_text(pages: DataFrame, host_pages: int = HOST_PAGES, host_bytes: int = HOST_BYTES, block_text: int = PAGE_BLOCK) -> DataFrame:
    """(page_id, url, text, n_chars)"""
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    sizes = written(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes")), "hosts")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    large = written(sizes.where((F.col("n") > host_pages) | (F.col("bytes") > host_bytes)).select("host"), "large-hosts")
    many = large.count()
    sent_out = F.broadcast(large) if many <= BROADCAST_HOSTS else large
    few = rows.join(sent_out, "host", "left_anti") if many else rows
    together = few.select("page_id", "url", "host", "html").mapInArrow(alone(_extract), PAGE_SCHEMA)
    together = together.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES)), "host")
    out = together.sortWithinPartitions("host", "page_id").mapInArrow(alone(_clean), TEXT_SCHEMA)
    if many:
        own = rows.join(sent_out, "host", "left_semi").select("page_id", "url", "host", "html")
        out = out.unionByName(_large_hosts(own, total, block_text))
    return out


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
