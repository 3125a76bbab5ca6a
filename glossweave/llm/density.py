"""Main text of web pages by composite text density over the DOM.

Every node gets its link-adjusted characters per tag (Sun, Song, Liao: DOM based content extraction via text density, 2011);
a node's density sum is the sum over its children. The node with the largest sum is the core of the page, and the smallest
density on the way from it to the body is the threshold for what else belongs to the text. Elements that are menus, headers,
footers, sidebars, notices, adverts, forms, scripts or comments by their tag, role or class have no density and no text.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from glossweave.llm.rows import map_texts

# Element names of the HTML standard, and the words by which pages name parts that are not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe svg canvas object audio video map dialog menu".split())
BLOCK = frozenset("address article aside blockquote body br-block center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br-block body html legend option optgroup td th tr tbody thead tfoot dd dt li".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist respond consent cookie cookies gdpr"
    " disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup overlay promo"
    " promotion related recommended share sharing sidebar social sponsor sponsored subscribe subscription toolbar topbar widget widgets signup login".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'](?=[^\"'>]*>))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Page:
    """The nodes of a page in page order; node 0 is the root. Built without recursion, so depth has no limit."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs = [-1], ["#"], [{}]
        #: (node, text) of each text, and (node, None) where a block begins or ends
        self.events: list[tuple[int, str | None]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        open_, at, size = [0], 0, len(source)
        count: dict[str, int] = {}

        def close(depth: int) -> None:
            while len(open_) > depth:
                i = open_.pop()
                count[self.tag[i]] -= 1
                if self.tag[i] in BLOCK:
                    self.events.append((open_[-1], None))

        def close_nearest(names, stop=frozenset()) -> None:
            for k in range(len(open_) - 1, 0, -1):
                t = self.tag[open_[k]]
                if t in names:
                    return close(k)
                if t in stop:
                    return

        while at < size:
            m = TOKEN.search(source, at)
            end = m.start() if m else size
            if end > at:
                self.events.append((open_[-1], html.unescape(source[at:end])))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "p" and not count.get("p"):
                    continue
                if count.get(tag):
                    close_nearest({tag})
                continue
            if tag in ("html", "body") and count.get(tag):
                continue
            if tag in CLOSES_P and count.get("p"):
                close_nearest({"p"}, {"table", "td", "th", "button", "object"})
            if tag in SIBLINGS:
                while any(count.get(t) for t in SIBLINGS[tag]):
                    before = len(open_)
                    close_nearest(SIBLINGS[tag], HOLDS[tag])
                    if len(open_) == before:
                        break
            if tag == "body" and count.get("head"):
                close_nearest({"head"})
            node = len(self.tag)
            self.parent.append(open_[-1])
            self.tag.append(tag)
            self.attrs.append({k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3])} if m[3] and not m[3].isspace() else {})
            if tag in BLOCK:
                self.events.append((open_[-1], None))
            elif tag == "br":
                self.events.append((open_[-1], " "))
            if tag in VOID:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                end = stop.start() if stop else size
                if tag in ("textarea", "title"):
                    self.events.append((node, html.unescape(source[at:end])))
                at = stop.end() if stop else size
                continue
            open_.append(node)
            count[tag] = count.get(tag, 0) + 1

    def main_text(self) -> str:
        n = len(self.tag)
        parent, tag = self.parent, self.tag
        holds_main = [t in ("article", "main") or a.get("role", "").lower() in ("main", "article") for t, a in zip(tag, self.attrs)]
        is_main = list(holds_main)
        for i in range(n - 1, 0, -1):
            holds_main[parent[i]] |= holds_main[i]
        gone, inside = [False] * n, [False] * n
        for i in range(1, n):
            p = parent[i]
            inside[i] = inside[p] or is_main[i]
            gone[i] = gone[p] or self._apart(i, holds_main[i], is_main[i], inside[p])
        # characters, tags, characters in links, links
        chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
        link = [False] * n
        for i in range(1, n):
            link[i] = link[parent[i]] or tag[i] == "a"
        for i, text in self.events:
            if text and not gone[i]:
                k = len("".join(text.split()))
                chars[i] += k
                if link[i]:
                    linked[i] += k
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                p = parent[i]
                chars[p] += chars[i]
                linked[p] += linked[i]
                tags[p] += tags[i] + 1
                links[p] += links[i] + (tag[i] == "a")
        body = next((i for i in range(1, n) if tag[i] == "body" and not gone[i]), 0)
        density = [0.0] * n
        share = linked[body] / chars[body] if chars[body] else 0.0
        for i in range(n):
            if not gone[i] and chars[i]:
                c, t, lc, lt = chars[i], max(tags[i], 1), linked[i], links[i]
                base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
                density[i] = c / t * max(math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / base, 1e-9)
        sums = [0.0] * n
        for i in range(1, n):
            sums[parent[i]] += density[i]
        if not chars[body]:
            return ""
        best = max(range(body, n), key=lambda i: (sums[i] or density[i] * 1e-6) if not gone[i] else -1.0)
        path, i = [best], best
        while i != body and i > 0:
            i = parent[i]
            path.append(i)
        threshold = min(density[i] for i in path if density[i] > 0) if any(density[i] > 0 for i in path) else 0.0
        # the article element around the core, where there is one; else the core and what else is dense enough
        root = next((i for i in path if is_main[i]), None)
        kept = [False] * n
        kept[best if root is None else root] = True
        for i in range(1, n):
            if not gone[i] and not kept[i]:
                kept[i] = kept[parent[i]] or root is None and i not in path and density[i] >= threshold
        if root is None:
            self._headings(kept, gone)
            kept[best] = True
        blocks, now = [], []
        for i, text in self.events:
            if text is None:
                blocks.append("".join(now))
                now = []
            elif kept[i] and not gone[i]:
                now.append(text)
        blocks.append("".join(now))
        return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)

    def _apart(self, i: int, holds_main: bool, is_main: bool, in_main: bool) -> bool:
        """Is this element something other than the article, by its tag, role, class or id?"""
        t, a = self.tag[i], self.attrs[i]
        if t in ("html", "body"):
            return False
        if t in NEVER:
            return True
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
            return True
        if t == "header" and not in_main and not holds_main:
            return True
        named = a.get("role", "").lower() in ROLES or any(w in NAMES for k in ("class", "id") if k in a for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", a[k]).lower()))
        return named and (not holds_main or is_main and in_main)

    def _headings(self, kept: list[bool], gone: list[bool]) -> None:
        """A heading right before a kept element belongs to it."""
        last: dict[int, int] = {}
        for i in range(1, len(kept)):
            p = self.parent[i]
            before = last.get(p)
            if kept[i] and before is not None and self.tag[before] in HEADINGS and not gone[before]:
                kept[before] = True
            if not gone[i]:
                last[p] = i


def main_text(source: str | None) -> str:
    """The main text of one page; empty for null, empty or text-free pages."""
    return Page(source).main_text() if source else ""


def extract_text(pages: DataFrame, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` + text, n_chars: the main text of every whole page and its number of code points.

    Null, empty and text-free pages: empty text, 0. Rows are treated one by one, so repeated rows give repeated results and
    null keys stay; an empty table gives an empty result; other columns are not read, a kept column named like a result is
    replaced.
    """

    def make():
        def work(sources: pa.Array) -> dict:
            texts = [main_text(s) for s in sources.to_pylist()]
            return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

        return work

    return map_texts(pages, list(keep), source, "text string, n_chars long", make)
