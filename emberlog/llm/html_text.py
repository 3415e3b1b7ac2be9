"""HTML extraction by composite text density.

A page becomes a tree of elements. Every element has characters, tags, link characters and link
tags of its subtree, and from them the composite density: characters per tag, on a logarithmic
scale whose base grows with the share of links (against the page's own share). The element whose
children's densities have the largest sum is the core of the article; the least density on its
path to the body is the threshold, by which neighbours of the core belong to the article too.
Menus, footers, forms, scripts and the like, by tag, role, class or id, are pruned first, and
stay out of the text of the chosen subtrees. A class or id tells so only as a whole name (or its
first part, or a last part like -sidebar), and never of an element that holds the page's main
heading or <main> with most of the text, or nearly all of the text.

Text: character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one line feed. Nothing else is dropped or cut.

Edge cases: null pages count as empty; pages without tags are one block; unclosed and crossed
tags are repaired as browsers do in the common cases; an element that is pruned and never closed
ends where its parent does or an article begins, and has no content if a script-like one; markup cut off at the end
is ignored. Reading a page takes time in proportion to its length. Repeated rows stay; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import map_rows

#: A tag: quotes count after "=" only. The second form, for pages whose quotes never close, ends at the first ">".
_QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:"[^"]*"|'[^']*')|=)*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe xmp noembed".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_CLOSES_P = _BLOCK - frozenset("body html td th tr tbody thead tfoot caption".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
_FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "option": ("select",)}
#: Elements in which no paragraph can stand: a block that begins inside ends them.
_INLINE_OUT = frozenset("button select option label".split())
#: Pruned by their tag alone; the second set only if no main heading with most of the text stands in them.
_NEVER = _RAW | frozenset("head template svg math object select option button noscript".split())
_ASIDE = frozenset("nav footer aside form menu dialog".split())
_ROLES = re.compile(r"""role\s*=\s*["']?(navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu)\b""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_FIRST = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices notification pagination pager popup promo promoted recommended related replies respond reply share sharing sidebar sidenav signup skip social "
    "sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_LAST = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comments footer menu nav navbar navigation newsletter pagination popup sidebar sidenav".split())
_NOT = frozenset("has no not with without is hide hides show js wide full left-of right-of".split())
_CLIMB = 256  # levels that are looked through for an element to end


class Node:
    __slots__ = ("tag", "parent", "children", "out", "guarded", "chars", "tags", "link_chars", "link_tags", "density", "total", "heads")

    def __init__(self, tag: str, parent: Node | None, out: bool, guarded: bool = False):
        self.tag, self.parent, self.out, self.guarded = tag, parent, out, guarded
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.heads = 0
        self.density = self.total = 0.0


def _named_out(names: str) -> bool:
    """Whether one of the class or id names tells of a part beside the article."""
    for name in names.lower().split():
        parts = re.split(r"[_-]+", name.strip("_-"))
        first, last = parts[0].rstrip("0123456789"), parts[-1].rstrip("0123456789")
        if first in _FIRST or len(parts) > 1 and last in _LAST and first not in _NOT:
            return True
    return False


def _outside(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """(whether an element is no part of an article, by its own tag and attributes; whether that may turn out wrong)."""
    if tag in _NEVER:
        return True, False
    if tag in _ASIDE or tag == "header" and not inside_article:
        return True, True
    if tag in ("body", "html", "article", "main") or not attributes:
        return False, False
    if _ROLES.search(attributes) or _HIDDEN.search(attributes):
        return True, True
    return any(_named_out(n.strip("\"'")) for n in _NAMES.findall(attributes)), True


class _Tree:
    """The open elements while a page is read."""

    def __init__(self):
        self.root = self.node = Node("html", None, False)
        self.open: Counter[str] = Counter()

    def pop_to(self, above: Node) -> None:
        while self.node is not above:
            self.open[self.node.tag] -= 1
            self.node = self.node.parent

    def push(self, made: Node) -> None:
        self.node = made
        self.open[made.tag] += 1

    def inside_article(self) -> bool:
        return bool(self.open["article"] or self.open["main"])

    def end(self, tag: str) -> None:
        """An end tag: up to its element, unless a fence stands between."""
        if not self.open[tag]:
            return
        seek, fenced = self.node, tag not in ("body", "html", "article", "main", "table", "tr", "td", "section", "div")
        for _ in range(_CLIMB):
            if seek is None or seek.tag == tag or fenced and seek.tag in ("article", "main", "table", "td"):
                break
            seek = seek.parent
        if seek is not None and seek.tag == tag and seek.parent is not None:
            self.pop_to(seek.parent)

    def make_room(self, tag: str) -> None:
        """End what a start tag ends without an end tag of its own."""
        if tag in ("article", "main"):
            for out in ("nav", "header", "footer", "aside", "menu", "dialog", "noscript"):
                if self.open[out]:
                    self._end_nearest((out,), ("article", "main"))
        if tag in _BLOCK:
            for out in _INLINE_OUT:
                if self.open[out]:
                    self._end_nearest((out,), ())
        ends = (("p",) if tag in _CLOSES_P else ()) + _SAME.get(tag, ())
        if tag == "body":
            ends = ("head",)
        while any(self.open[t] for t in ends):
            seek, fences = self.node, _FENCE.get(tag, ())
            for _ in range(_CLIMB):
                if seek is None or seek.tag in ends or seek.tag in fences or seek.tag in _BLOCK and tag not in _SAME or seek.tag == "table":
                    break
                seek = seek.parent
            if seek is None or seek.tag not in ends or seek.parent is None:
                return
            self.pop_to(seek.parent)

    def _end_nearest(self, tags: tuple[str, ...], fences: tuple[str, ...]) -> None:
        seek = self.node
        for _ in range(_CLIMB):
            if seek is None or seek.parent is None or seek.tag in fences:
                return
            if seek.tag in tags:
                self.pop_to(seek.parent)
                return
            seek = seek.parent


class _Ends:
    """Where end tags of raw elements stand; what was once not found is not looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()

    def after(self, tag: str, at: int):
        if tag in self.missing:
            return None
        found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if not found:
            self.missing.add(tag)
        return found


def parse(page: str) -> Node:
    tree, at, size = _Tree(), 0, len(page)
    ends, last, form = _Ends(page), page.rfind(">"), _QUOTED
    while at < size:
        start = page.find("<", at)
        if start < 0:
            tree.node.children.append(page[at:])
            break
        after = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            if start > at:
                tree.node.children.append(page[at:start])
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        if start > last:
            # No tag ends here any more: text, but for markup that the page's end cut off.
            cut = after.isalpha() or after in ("/", "!", "?")
            tree.node.children.append(page[at:start] if cut else page[at:])
            break
        if after in ("!", "?") and after:
            if start > at:
                tree.node.children.append(page[at:start])
            at = page.find(">", start) + 1
            continue
        m = form.match(page, start)
        if not m and form is _QUOTED and (after.isalpha() and after.isascii() or after == "/"):
            m = _PLAIN.match(page, start)
            form = _PLAIN if m else form
        if not m:
            tree.node.children.append(page[at : start + 1])  # a bare "<"
            at = start + 1
            continue
        if start > at:
            tree.node.children.append(page[at:start])
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag == "br":
            tree.node.children.append(" ")
            tree.node.tags += 1
            continue
        if closing:
            tree.end(tag)
            continue
        if tag == "html" and tree.root.children:
            continue
        tree.make_room(tag)
        out, guarded = _outside(tag, attributes, tree.inside_article())
        made = Node(tag, tree.node, out, guarded)
        tree.node.children.append(made)
        if tag in _RAW:
            if end := ends.after(tag, at):
                at = end.end()
        elif tag in _NEVER and tag != "head" and not ends.after(tag, at):
            continue  # never closed: it holds nothing
        elif tag not in _VOID and not (attributes.rstrip().endswith("/") and tag not in _BLOCK):
            tree.push(made)
    return tree.root


def _rescue(root: Node) -> None:
    """Take back what was pruned on a hint, where it holds the article: the main heading with half of the text, or nearly all of it."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(c for c in n.children if isinstance(c, Node) and not (c.out and not c.guarded))
    for n in reversed(order):
        n.chars += sum(len(c.strip()) for c in n.children if isinstance(c, str))
        n.heads += n.tag in ("h1", "main", "article")
        if n.parent is not None and n is not root:
            n.parent.chars += n.chars
            n.parent.heads += n.heads
    whole = root.chars
    for n in order:
        if n.out and n.chars and (n.heads and 2 * n.chars >= whole or 10 * n.chars >= 9 * whole):
            n.out = False
    for n in order:
        n.chars = 0


def _walk(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.out)
    return order


def _measure(order: list[Node], body: Node) -> None:
    for n in order:
        linked = n.tag == "a"
        n.link_tags = int(linked)
        n.chars = sum(len(c.strip()) for c in n.children if isinstance(c, str))
        n.link_chars = n.chars if linked else 0
    for n in reversed(order):
        if n.tag == "a":
            n.link_chars = n.chars
        if (p := n.parent) is not None:
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in order:
        if n.chars:
            c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, max(1, n.link_tags)
            plain = max(1, c - lc)
            base = log(c / plain * lc + share * c + e)
            n.density = c / t * log(c * t / (max(1, lc) * lt) + 1) / max(1.0, base)
    for n in order:
        n.total = sum(c.density for c in n.children if isinstance(c, Node) and not c.out)


_SHARE = 0.25  # of the threshold that a neighbour's density reaches


def _roots(body: Node, order: list[Node]) -> list[Node]:
    """The subtrees that make up the article, in page order."""
    inside = [n for n in order if n.chars]
    if not inside:
        return []
    best = max(inside, key=lambda n: n.total)
    if best.total == 0:
        return [body]
    threshold, n = best.density, best
    while n is not body and n.parent is not None:
        n = n.parent
        threshold = min(threshold, n.density)
    framed = best
    while framed is not body and framed.parent is not None and framed.tag not in ("article", "main"):
        framed = framed.parent
    if framed.tag in ("article", "main"):
        # The page says where its article is; others beside it belong to it if they read like it.
        beside = framed.parent.children if framed.parent is not None else [framed]
        return [c for c in beside if c is framed or isinstance(c, Node) and not c.out and c.tag == framed.tag and _reads(c, threshold)]
    chosen, root = {id(best)}, best
    while root is not body and root.parent is not None:
        above = root.parent
        if any(isinstance(c, str) and c.strip() for c in above.children):
            chosen = {id(above)}  # text of its own: the element as a whole
        else:
            chosen |= {id(c) for c in above.children if isinstance(c, Node) and not c.out and c is not root and c.chars and (_reads(c, threshold) or re.fullmatch("h[1-6]", c.tag))}
        root = above
    return [n for n in order if id(n) in chosen]


def _reads(n: Node, threshold: float) -> bool:
    """Whether an element beside the core is text rather than links or scraps."""
    return n.chars > 0 and n.density >= _SHARE * threshold and 2 * n.link_chars < n.chars


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line feeds; empty if there is none."""
    if not page:
        return ""
    tree = parse(page)
    body = tree
    for c in tree.children:
        if isinstance(c, Node) and c.tag == "body":
            body = c
        elif isinstance(c, Node) and c.tag == "html":
            body = next((b for b in c.children if isinstance(b, Node) and b.tag == "body"), c)
    _rescue(body)
    order = _walk(body)
    _measure(order, body)
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            if block := " ".join("".join(held).split()):
                blocks.append(block)
            held.clear()

    for root in _roots(body, order):
        todo: list[Node | str | None] = [root]
        while todo:
            n = todo.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                held.append(unescape(n))
            elif not n.out:
                if n.tag in _BLOCK:
                    flush()
                    todo.append(None)
                todo.extend(reversed(n.children))
        flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text and n_chars (code points)."""

    def rows(batches):
        for batch in batches:
            texts = [main_text(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), "url", F.col(f"`{html_col}`").alias("html"))
    return map_rows(source, rows, f"page_id {kind}, url string, text string, n_chars long")
