"""Main text of raw pages by composite text density over the DOM."""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import keep_small, whole_text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object noframes xmp".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption thead tbody "
    "tfoot tr td th ul head".split())
#: Elements that an opening tag of the kind ends, up to the nearest of its borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Parts of a page that are never its main text.
SIDE = frozenset("head nav footer aside form button select dialog menu input label fieldset canvas audio video".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars side "
    "menu menus nav navbar navigation breadcrumb breadcrumbs header footer masthead topbar toolbar pagination pager comment "
    "comments commentlist disqus respond reply replies share sharing social related recommended recommendations widget "
    "widgets hidden".split())
#: Class names with one of these parts tell how the page is laid out, as in has-sidebar or menu-open.
LAYOUT_WORDS = frozenset("has with without no js layout open opened closed enabled disabled".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
                  r"|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def beside(tag: str, attributes: str, inside: bool = False, named: bool = True) -> bool:
    """True for menus, notices, adverts, forms, comments and what else stands beside the article.

    ``inside`` an article a header is part of it; without ``named`` class names and ids don't count.
    """
    if tag in SIDE or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.lower() in SIDE_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        for word in value.split() if named and name in ("class", "id") else ():
            parts = {p.lower() for p in _PARTS.findall(word)}
            if inside or tag in HEADINGS:
                parts.discard("header")
            if parts & SIDE_WORDS and not parts & LAYOUT_WORDS:
                return True
    return False


class Page:
    """Nodes in page order, with their parents, and the pieces of text between the tags."""

    def __init__(self, html: str, named: bool = True):
        self.named = named
        self.tag, self.up, self.out = ["html"], [-1], [False]
        self.pieces: list[tuple[int, str, int]] = []
        self.blocks = 0
        stack, pos, size = [0], 0, len(html)
        for m in iter(lambda: _TAG.search(html, pos), None):
            if m.start() > pos:
                self._piece(stack[-1], html[pos:m.start()])
            pos = m.end()
            shut, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if shut:
                self._close(stack, tag)
            elif tag in ("html", "body") and tag in [self.tag[i] for i in stack]:
                pass
            elif tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos) if not attributes.endswith("/") else None
                pos = end.end() if end else pos if attributes.endswith("/") else size
            elif tag == "br":
                self._piece(stack[-1], " ")
            else:
                self._open(stack, tag, attributes)
        if pos < size:
            self._piece(stack[-1], html[pos:])

    def _piece(self, node: int, text: str) -> None:
        if not self.out[node]:
            self.pieces.append((node, text, self.blocks))

    def _pop_to(self, stack: list[int], at: int) -> None:
        if any(self.tag[i] in BLOCK for i in stack[at:]):
            self.blocks += 1
        del stack[at:]

    def _close(self, stack: list[int], tag: str) -> None:
        for at in range(len(stack) - 1, 0, -1):
            here = self.tag[stack[at]]
            if here == tag:
                self._pop_to(stack, at)
                return
            if tag not in BLOCK and here in BLOCK:
                return

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        ended, border = ENDS.get(tag, (set(), set()))
        for at in range(len(stack) - 1, 0, -1):
            here = self.tag[stack[at]]
            if here in border:
                break
            if here in ended:
                self._pop_to(stack, at)
            elif here == "p" and tag in BLOCK:
                self._pop_to(stack, at)
            elif here == "head" and tag in BLOCK:
                self._pop_to(stack, at)
        if tag in BLOCK:
            self.blocks += 1
        if tag in VOID:
            return
        up = stack[-1]
        inside = any(self.tag[i] in ("article", "main") for i in stack)
        self.tag.append(tag)
        self.up.append(up)
        self.out.append(self.out[up] or beside(tag, attributes, inside, self.named))
        stack.append(len(self.tag) - 1)

    def main_text(self) -> str:
        """Blocks of the maximum-sum subtree and of what is as dense as the path from it to the body."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        pieces = [(i, unescape(t), b) for i, t, b in self.pieces]
        for i, t, _ in pieces:
            chars[i] += len(t) - t.count(" ") - t.count("\n")
        for i in range(n - 1, 0, -1):
            if self.out[i]:
                continue
            if self.tag[i] == "a":
                link_chars[i], link_tags[i] = chars[i], tags[i]
            up = self.up[i]
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        share = link_chars[0] / max(1, chars[0])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            if chars[i] and not self.out[i]:
                plain = max(1, chars[i] - link_chars[i])
                base = log(chars[i] / plain * link_chars[i] + share * chars[i] + e)
                ratio = chars[i] * max(1, tags[i]) / (max(1, link_chars[i]) * max(1, link_tags[i]))
                density[i] = chars[i] / max(1, tags[i]) * max(0.0, log(max(ratio, 1e-9)) / base)
                if i:
                    total[self.up[i]] += density[i]
        if not any(total):
            chosen = {0}
        else:
            top = max(range(n), key=lambda i: (total[i], -i))
            path = [top]
            while self.up[path[-1]] > 0 and self.tag[path[-1]] != "body":
                path.append(self.up[path[-1]])
            # An article is taken whole; else all that is as dense as the thinnest part of the path.
            whole = [i for i in path if self.tag[i] == "article"] or [i for i in path if self.tag[i] == "main"]
            least = min(density[i] for i in path)
            chosen = {whole[-1]} if whole else {top} | {
                i for i in range(n) if density[i] >= least > 0 and self.tag[i] not in ("html", "body")}
        inside = [False] * n
        for i in range(n):
            inside[i] = i in chosen or i > 0 and inside[self.up[i]]
        rows: list[list[str]] = []
        last = None
        for i, t, b in pieces:
            if inside[i]:
                if b != last:
                    rows.append([])
                    last = b
                rows[-1].append(t)
        return "\n".join(filter(None, (" ".join("".join(r).split()) for r in rows)))


def main_text(html: str | None) -> str:
    """The main text; where class names and ids would leave none, they don't count."""
    if not html:
        return ""
    return Page(html).main_text() or Page(html, named=False).main_text()


def page_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages (page_id, url, html)``.

    ``text`` is the page's main text: decoded, white space inside a block as one space, blocks joined
    by a line feed, nothing else dropped or cut. Null, empty and text-free html gives the empty text;
    text without any tag is a page of one block. Rows are independent: repeated rows, null ids and null
    addresses pass through; other columns are ignored; an empty table gives an empty one.
    """
    keep_small(pages.sparkSession)

    def run(batches):
        for batch in batches:
            found = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", whole_text("html").alias("html")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
