"""Main text of web pages by consensus host paths."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoset.llm.common import settle

# Kinds of elements.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp", "noembed", "noframes")
INLINE = frozenset((*RAW, "button", "select", "option", "optgroup", "datalist", "input", "label", "legend", "canvas", "object", "audio", "video", "map"))
DROPPED = INLINE | {"head", "nav", "footer", "aside", "dialog", "menu"}
CONTAINERS = frozenset(("article", "main", "section", "div", "td", "body", "blockquote", "center", "li"))
BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "table", "thead", "tbody", "tr", "td", "th", "figure", "figcaption", "address", "hr", "details", "summary", "caption", "header", "hgroup", "html", "form", "fieldset")) | CONTAINERS
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "caption"} | {"form", "nav", "footer", "aside", "fieldset", "menu", "main"}
#: Elements that a class or id can drop; headings, paragraphs and what stands in them never are.
NAMED = CONTAINERS - {"body", "article", "main", "td", "center"} | {"ul", "ol", "dl", "table", "header", "figure", "span", "details"}
#: Words of class and id tokens that drop an element wherever they stand.
ALWAYS = re.compile(r"^(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|menus?|navbar|navigation|breadcrumbs?|masthead|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|sharing|disqus|pagination|pager)$")
#: Words that drop an element if the token says nothing else but where and how.
ALONE = re.compile(r"^(?:nav|banner|headers?|footers?|notices?|alerts?|overlay|login|share|social|related|recommend\w*|comments?|replies|reply|respond|widgets?|toolbar|skip|hidden|copyright)$")
PLAIN = re.compile(r"^(?:site|page|main|global|top|bottom|left|right|section|area|list|wrapper|wrap|container|box|block|bar|inner|outer|thread|form|posts?|articles?|stories|links?|items?|content|buttons?|icons?|media|tools?|text|link|info|the|in|of|js|m|l|r)$")
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"))
WANTED = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body|text|page)(?:$|[\s_-]|\d)", re.I)

#: Steps of a path that are spelled out.
MOST_STEPS = 50
_open = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_unquoted = re.compile(r"[^>\"']*")
#: Characters outside labels and controls from which on a form is taken for a page's frame, not for a form to fill in.
FRAME_CHARS = 300


class Scanner:
    """Tags of a page from left to right. Each character is looked at a bounded number of times, however broken the page."""

    def __init__(self, html: str):
        self.html, self.size = html, len(html)
        self.last = html.rfind(">")
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.quoted = True

    def _end(self, at: int) -> int:
        """The place of the > that ends the tag whose names end at ``at``; quotes hide it until one turns out to be open."""
        html = self.html
        while self.quoted:
            at_ = _unquoted.match(html, at).end()
            if at_ >= self.size:
                self.quoted = False  # a quote was open: from here on quotes hide nothing
                break
            if html[at_] == ">":
                return at_
            close = html.find(html[at_], at_ + 1) if at_ < self.last_quote[html[at_]] else at_
            at = close + 1
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str, bool]:
        """(start, end, is an end tag, name, attributes, closes itself) of the next tag; the name is empty for comments
        and the like, and for the end of the page, where start is its size. A tag that nothing ends is cut off."""
        html = self.html
        while True:
            start = html.find("<", at)
            if start < 0:
                return self.size, self.size, False, "", "", False
            follows = html[start + 1 : start + 2]
            if follows in ("!", "?"):
                if html.startswith("<!--", start):
                    end = html.find("-->", start + 4)
                    return start, end + 3 if end >= 0 else self.size, False, "", "", False
                return start, html.find(">", start) + 1 if start < self.last else self.size, False, "", "", False
            m = _open.match(html, start)
            if not m:
                at = start + 1
                continue
            if start > self.last:
                return start, self.size, False, "", "", False
            end = self._end(m.end())
            if end < 0:
                end = html.find(">", m.end())
            return start, end + 1, bool(m[1]), m[2].lower(), html[m.end() : end], html[end - 1] == "/"


_attr = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_digits = re.compile(r"\d+")


@dataclass
class Node:
    """A container on the way through a page: its last path step, a number for its whole path, the blocks directly in
    it, and its score so far."""

    tag: str
    step: str
    path: int
    parent: int
    blocks: list[tuple[int, str]] = field(default_factory=list)
    score: float = 0.0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _attr.finditer(raw)} if raw.strip() else {}


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A generalised path step: the tag and its sorted classes, digits as #."""
    classes = sorted({_digits.sub("#", c.lower()) for c in attrs.get("class", "").split()})
    return ".".join([tag, *classes])


def _path(above: int, step: str) -> int:
    """A 63-bit number for a path, from that of the path above it, so that deep pages take no long texts."""
    return xxhash.xxh3_64_intdigest(step.encode("utf-8", "surrogatepass"), above) >> 1


def _unwanted(tag: str, attrs: dict[str, str]) -> bool:
    if tag in DROPPED or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return tag in NAMED and any(_speaks_against(t) for c in ("class", "id") for t in attrs.get(c, "").split())


def _speaks_against(token: str) -> bool:
    """Whether a class or id says that its element is no part of an article."""
    words = [w.lower() for w in _words.findall(token)]
    if any(ALWAYS.match(w) for w in words):
        return True
    return any(ALONE.match(w) for w in words) and all(ALONE.match(w) or PLAIN.match(w) for w in words)


@lru_cache(20_000)
def _facts(tag: str, raw: str) -> tuple[bool, str, float]:
    """Whether a start tag drops its element, its path step, and the score its names give."""
    attrs = _attributes(raw)
    hint = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return _unwanted(tag, attrs), _step(tag, attrs), 25.0 * (tag in ("article", "main")) + 10.0 * bool(WANTED.search(hint))


_telling = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)


class Page:
    """The containers of a page and their blocks of text, without dropped elements."""

    def __init__(self, html: str):
        self.nodes = [Node("html", "html", _path(0, "html"), -1)]
        self.order = 0
        # of each open element: tag, container, dropped from here, place of the paragraph that a block would end, the
        # nearest heading, container, header or paragraph, and the form it lies in
        stack: list[tuple[str, int, bool, int, str, int]] = [("html", 0, False, -1, "html", -1)]
        open_ = Counter()  # of the tags above the first
        found: list[tuple[int, str, int, str, bool, int]] = []
        forms: list[int] = []  # characters in paragraphs and the like of each form
        text: list[str] = []
        links = 0
        in_link = 0

        def flush() -> None:
            nonlocal links
            if text:
                joined = " ".join(unescape("".join(text)).split())
                if joined:
                    _, node, _, _, within, form = stack[-1]
                    found.append((node, joined, links, within, open_["header"] > 0 and not any(open_[h] > 0 for h in HEADINGS), form))
                    if form >= 0:
                        forms[form] += len(joined) - min(links, len(joined))
                text.clear()
            links = 0

        def close(name: str) -> None:
            while (last := stack.pop()[0]) != name:
                open_[last] -= 1
            open_[name] -= 1

        def foreign_header(name: str) -> bool:
            return name == "header" and not open_["article"] and not open_["main"]

        at, size, scanner = 0, len(html), Scanner(html)
        while at < size:
            start, after, is_end, name, raw, alone = scanner.next(at)
            if start > at and not stack[-1][2]:
                piece = html[at:start]
                text.append(piece)
                links += len(piece) if in_link else 0
            at = after
            if not name:
                continue
            if is_end:
                if name == "a":
                    in_link = max(0, in_link - 1)
                if open_[name] > 0:
                    if not stack[-1][2] and name in BLOCKS:
                        flush()
                    close(name)
                elif name in BLOCKS and not stack[-1][2]:
                    flush()
                continue
            if raw and not _telling.search(raw):
                raw = ""
            unwanted, step, bonus = _facts(name, raw)
            if name in VOID:
                if not stack[-1][2]:
                    if name == "br":
                        text.append(" ")
                    elif name in BLOCKS:
                        flush()
                continue
            if name == "a":
                in_link += 1
            dropped = stack[-1][2] or unwanted or foreign_header(name)
            if not stack[-1][2] and (name in BLOCKS or dropped and name not in INLINE):
                flush()
            if name in CLOSES_P and (depth := stack[-1][3]) > 0:
                in_link = 0
                open_.subtract(entry[0] for entry in stack[depth:])
                del stack[depth:]
                dropped = stack[-1][2] or unwanted or foreign_header(name)
            if name in RAW and not alone:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if alone and name not in BLOCKS:
                continue
            _, inside, _, paragraph, within, form = stack[-1]
            if name == "form" and form < 0:
                form = len(forms)
                forms.append(0)
            if not dropped and name in CONTAINERS:
                self.nodes.append(Node(name, step, _path(self.nodes[inside].path, step), inside, score=bonus))
                inside = len(self.nodes) - 1
            paragraph = len(stack) if name == "p" else -1 if name in CONTAINERS else paragraph
            within = name if name in HEADINGS or name in CONTAINERS or name in ("header", "p") else within
            stack.append((name, inside, dropped, paragraph, within, form))
            open_[name] += 1
        if not stack[-1][2]:
            flush()
        for node, joined, in_links, within, in_header, form in found:
            if form < 0 or forms[form] >= FRAME_CHARS:
                self._add(node, joined, in_links, within, in_header)

    def _add(self, node: int, joined: str, links: int, within: str, in_header: bool) -> None:
        if in_header:
            return  # of an article's own header only headings belong to the text
        self.nodes[node].blocks.append((self.order, joined))
        self.order += 1
        # a paragraph speaks for its container, half as much for the one around it, less for further ones
        worth = max(0.0, len(joined) - 2.0 * links) * (0.5 if within in HEADINGS else 1.0)
        share = 1.0
        while node >= 0 and share > 0.05:
            self.nodes[node].score += worth * share
            node, share = self.nodes[node].parent, share * 0.5

    def votes(self) -> dict[int, float]:
        """The score of each path with text, as a share of the page's."""
        found: dict[int, float] = {}
        for n in self.nodes:
            if n.score > 0 and n.tag != "html":
                found[n.path] = found.get(n.path, 0.0) + n.score
        total = sum(found.values())
        return {p: s / total for p, s in found.items()} if total else {}

    def text_of(self, path: int) -> str | None:
        """All blocks below the containers with this path in page order; None if there is no such container."""
        roots = {i for i, n in enumerate(self.nodes) if n.path == path}
        if not roots:
            return None
        inside, blocks = set(roots), []
        for i, n in enumerate(self.nodes):  # parents come first
            if i in inside or n.parent in inside:
                inside.add(i)
                blocks += n.blocks
        return "\n".join(t for _, t in sorted(blocks))

    def spelled(self, path: int) -> str | None:
        """The steps of a path that the page has, the last MOST_STEPS of them."""
        at = next((i for i, n in enumerate(self.nodes) if n.path == path), -1)
        steps = []
        while at >= 0 and len(steps) < MOST_STEPS:
            steps.append(self.nodes[at].step)
            at = self.nodes[at].parent
        return ">".join(reversed(steps)) or None

    def best(self) -> int | None:
        own = [(n.score, -i, n.path) for i, n in enumerate(self.nodes) if n.score > 0 and n.tag != "html"]
        if own:
            return max(own)[2]
        return self.nodes[0].path if any(n.blocks for n in self.nodes) else None


def host_of(url: str | None) -> str:
    """The host of an address in lower case without user, port, and leading www or m; empty if there is none."""
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
    host = m[1].lower() if m else ""
    return re.sub(r"^(?:www\d?|m)\.", "", host)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes): the winning path of each host over all its pages, ties to the smaller
    number; a path is the number of :func:`_path`.

    Each task adds up its pages' votes before they are shuffled, so a host is never gathered.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], float] = {}
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if html:
                    host = host_of(url)
                    for path, share in Page(html).votes().items():
                        sums[host, path] = sums.get((host, path), 0.0) + share
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), pa.array([round(v * 2**32) for v in sums.values()], pa.int64())], ["host", "path", "votes"])

    votes = pages.select("url", "html").mapInArrow(vote, "host string, path long, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    return votes.withColumn("place", F.row_number().over(best)).where("place = 1").select("host", "path", "votes")


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, path.

    A page's containers are scored by the text of their paragraphs less that of links. The generalised tag-class
    paths are voted on for each host, and every page is extracted again with its host's winner; a page without that
    container uses its own best one. Blocks are joined by line feeds; white space inside a block becomes one space.

    Null and empty html, and pages without text, give an empty text; pages without a host vote together; repeated
    rows and null ids give a row each; an empty table gives an empty table; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = settle(host_paths(rows), "host-paths")
    key = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(F.lower(key), r"^(?:www\d?|m)\.", "")
    joined = rows.withColumn("host", host).join(winners.select("host", "path"), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = [], []
            for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True):
                text, used = "", None
                if html:
                    page = Page(html)
                    used = path if path is not None and page.text_of(path) else page.best()
                    text = (page.text_of(used) if used is not None else "") or ""
                texts.append(text)
                paths.append(page.spelled(used) if html and used is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")
