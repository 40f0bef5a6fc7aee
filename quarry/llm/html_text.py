"""Main text of web pages by composite text density.

A tolerant tree is built from the whole page (implied ends of p, li, table and list parts; unclosed inline tags end
with their block; a cut-off page is as good as a closed one). Elements that never hold article text go first:
scripts, styles, navigation, site headers and footers, sidebars, and blocks whose role says so. Forms and blocks
whose class or id says menu, advert, notice or reader comments go too, unless they hold an article or main element or
most of the body's text: these are wrappers ("has-sidebar"), and density decides inside them. Comments, adverts and
related pages beside an article that stays are no wrappers. On what is left

    CTD(i) = C/T * log(C/LC * T/LT) / log(log(C/(C - LC) * LC + LCb/Cb * C + e))

with C characters, T tags, LC and LT the same inside links, and b the body: characters per tag, adjusted for
links. The sum of the children's densities is largest at the node that holds the article's paragraphs; the
smallest density on its path to the body is the threshold. Every node at or above the threshold gives its
subtree of largest sum; if the best node lies in an article or main element, that element is the article, together
with the elements of its kind beside it that reach the threshold (an article in several parts). Of the chosen subtrees all text is kept.

Null and empty pages, and pages without text, give an empty text. Character references are decoded; white space
inside a block becomes one space (so does br); blocks are joined by a line feed in page order. Repeated rows
are extracted row by row; a page's row depends on no other row.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import blocks, in_arrow

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag on the left ends open elements on the right, up to the nearest boundary.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
BOUNDARY = frozenset("html body article main section div aside nav header footer form ul ol dl table blockquote figure details fieldset".split())

#: Elements without article text, and the ones that are so outside an article.
NO_TEXT = frozenset("script style noscript template head title nav footer aside button select textarea input svg math iframe object embed applet audio video canvas dialog menu map".split())
SITE = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscri\w*|signup|login|paywall"
    r"|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|widget\w*|related|recommend\w*|share|sharing|social|footer|site-?header|masthead|topbar|toolbar"
    r"|comments?|comment-?list|commentlist|disqus\w*|respond|replies|reply|pagination|pager|skip-?link|banner)(?:$|[\s_-]|\d)", re.I)  # fmt: skip
ARTICLE = frozenset(["article", "main"])
#: Text that stands beside an article, also when it is long or made of article elements; not a layout's name such as has-comments.
_NAMED = r"(?:^|[\s_-])(?<!has[_-])(?<!no[_-])(?<!with[_-])"
BESIDE = re.compile(_NAMED + r"(?:ads?|advert\w*|sponsor\w*|promo\w*|related|recommend\w*|comments?|comment-?list|commentlist|disqus\w*|respond|replies|reply)(?!-(?:open|closed)\b)(?:$|[\s_-]|\d)", re.I)
COMMENT = re.compile(_NAMED + r"(?:comment|reply)(?!s?-(?:open|closed)\b)", re.I)
#: What an element may be dropped for: surely, unless it wraps the article, and so beside an article.
DROP, DOUBT, ASIDE = 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "children", "inline", "dropped", "doubt")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, doubt: int = 0):
        self.tag, self.parent, self.children, self.dropped = tag, parent, [], dropped
        self.inline, self.doubt = tag in INLINE, doubt


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None, False)
        self.depth: dict[str, int] = {}  # open elements by tag

    def push(self, tag: str, why: int) -> None:
        node = Node(tag, self.at, why == DROP or self.at.dropped, why)
        self.at.children.append(node)
        self.at = node
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def pop_to(self, node: Node) -> None:
        """Ends all open elements down to and with this one."""
        while True:
            at = self.at
            self.depth[at.tag] -= 1
            self.at = at.parent
            if at is node:
                return

    def open_one(self, tags, boundary) -> Node | None:
        if not any(self.depth.get(t) for t in tags):
            return None
        at = self.at
        while at.parent is not None:
            if at.tag in tags:
                return at
            if at.tag in boundary:
                return None
            at = at.parent
        return None

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.depth.get(tag):
            return
        if tag not in INLINE and (p := self.open_one(("p",), BOUNDARY)):
            self.pop_to(p)
        if tag in ENDS:
            while old := self.open_one(ENDS[tag], BOUNDARY):
                self.pop_to(old)
        self.push(tag, self.drops(tag, attrs))
        if tag in VOID:
            self.pop_to(self.at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        old = self.open_one((tag,), BOUNDARY if tag in INLINE or tag == "p" else ())
        if old is not None:
            self.pop_to(old)

    def handle_data(self, data):
        if not self.at.dropped:
            self.at.children.append(data)

    def drops(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in NO_TEXT or (tag in SITE and not any(self.depth.get(t) for t in ARTICLE)):
            return DROP
        names = [v for k, v in attrs if k in ("class", "id") and v]
        if tag in ARTICLE or tag in ("html", "body"):
            # a comment thread may be built of articles
            return ASIDE if tag == "article" and any(COMMENT.search(v) for v in names) else 0
        doubt = DOUBT if tag == "form" else 0
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true"):
                return DROP
            if k == "role" and (v or "").lower() in ROLES:
                return DROP
            if k == "role" and (v or "").lower() == "form":
                doubt = DOUBT
            if k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
                return DROP
        if any(BESIDE.search(v) for v in names):
            return ASIDE
        return DOUBT if any(BOILERPLATE.search(v) for v in names) else doubt


def settle(root: Node) -> None:
    """Drops the elements in doubt that are no wrapper of the article.

    A wrapper holds an article or main element or most of the body's text. What stands beside an article is one
    only if it holds most of the text and nearly all of the article's.
    """
    nodes = in_order(root)
    if not any(n.doubt for n in nodes):
        return
    own = {n: sum(len(" ".join(x.split())) for x in n.children if type(x) is str) for n in nodes}
    aside: dict[Node, bool] = {}
    article: dict[Node, bool] = {}
    for n in nodes:
        aside[n] = n.doubt == ASIDE or aside.get(n.parent, False)
        article[n] = n.tag in ARTICLE or article.get(n.parent, False)
    clear = sum(own[n] for n in nodes if article[n] and not aside[n])
    size, holds = dict(own), dict.fromkeys(nodes, False)
    for n in reversed(nodes):
        if n.tag in ARTICLE and n.doubt != ASIDE and size[n] and not (clear and aside[n]):
            holds[n] = True
        if n.parent is not None:
            size[n.parent] += size[n]
            holds[n.parent] |= holds[n]
    most = size[next((n for n in nodes if n.tag == "body"), root)] / 2
    for n in nodes:
        if n.parent is not None and n.parent.dropped:
            n.dropped = True
        elif n.doubt == ASIDE and clear:
            n.dropped = not (size[n] > most and 10 * clear < size[n])
        elif n.doubt:
            n.dropped = not (holds[n] or size[n] > most)


def parse(html: str) -> Node:
    t = Tree()
    t.feed(html)
    t.close()
    settle(t.root)
    return t.root


def in_order(root: Node) -> list[Node]:
    """Nodes that are not dropped, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if type(c) is Node and not c.dropped]
    return out


def densities(nodes: list[Node]) -> tuple[dict[Node, float], dict[Node, float], dict[Node, float]]:
    """Composite text density of each node, the sum over its children, and the share of its text in links."""
    count = {n: [0, 0, 0, 0] for n in nodes}  # characters, tags, characters and tags inside links
    link = {}
    for n in nodes:
        link[n] = n.tag == "a" or (n.parent is not None and link.get(n.parent, False))
    for n in reversed(nodes):
        c = count[n]
        own = sum(len(" ".join(x.split())) for x in n.children if type(x) is str)
        c[0] += own
        if link[n]:
            c[2] += own
        if n.parent in count:
            p = count[n.parent]
            p[0] += c[0]
            p[1] += c[1] + 1
            p[2] += c[2]
            p[3] += c[3] + link[n]
    body = count[nodes[0]]
    share = body[2] / max(body[0], 1)
    density, total = {}, dict.fromkeys(nodes, 0.0)
    for n in nodes:
        chars, tags, link_chars, link_tags = count[n]
        tags, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
        d = 0.0
        if chars:
            base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
            d = chars / tags
            if base > 1.05:  # without links in the page, characters per tag stand as they are
                d *= max(math.log(chars / lc * tags / lt), 0.0) / math.log(base)
        density[n] = d
        if n.parent in total:
            total[n.parent] += d
    return density, total, {n: c[2] / max(c[0], 1) for n, c in count.items()}


def chosen(root: Node) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    nodes = in_order(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    if body is not root:
        nodes = in_order(body)
    inside = set(nodes)
    density, total, share = densities(nodes)
    if not density[body]:
        return []
    best = max(nodes, key=lambda n: total[n] or (density[n] if n is body else 0.0))
    path = []
    at = best
    while at in inside:
        path.append(at)
        at = at.parent
    threshold = min(density[n] for n in path)
    for n in reversed(path):
        if n.tag in ARTICLE:
            parts = n.parent.children if n.parent in inside else [n]
            return [m for m in parts if m is n or (type(m) is Node and m.tag == n.tag and not m.dropped and density[m] >= threshold and 3 * share[m] < 1)]
    # the subtree of largest sum of every node at the threshold or above
    top = {}
    for n in reversed(nodes):
        own = (total[n], n)
        under = max((top[c] for c in n.children if c in top), key=lambda x: x[0], default=own)
        top[n] = own if own[0] >= under[0] else under
    marked = {top[n][1] for n in nodes if density[n] >= threshold and density[n] > 0 and total[top[n][1]] > 0}
    marked.add(best)
    # an article in several parts: sparser parts beside a chosen one, of its kind, that are not lists of links
    for n in [n for n in marked if n.parent in inside]:
        marked |= {m for m in n.parent.children if type(m) is Node and not m.dropped and m.tag == n.tag and 3 * share[m] < 1}
    return [n for n in nodes if n in marked and not _under(n, marked)]


def _under(n: Node, marked: set[Node]) -> bool:
    p = n.parent
    while p is not None:
        if p in marked:
            return True
        p = p.parent
    return False


def text_of(subtrees: list[Node]) -> str:
    """Blocks of the subtrees, white space squeezed, joined by line feeds."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        line = " ".join("".join(now).split())
        if line:
            out.append(line)
        now.clear()

    for root in subtrees:
        todo: list = [root]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif type(x) is str:
                now.append(x)
            elif not x.dropped:
                if x.inline:
                    now.append(" " if x.tag == "br" else "")
                else:
                    end()
                    todo.append(None)
                todo += reversed(x.children)
        end()
    return "\n".join(out)


def main_text(html: str | None) -> str:
    return text_of(chosen(parse(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)."""

    def run(batches):
        for b in blocks(batches, "html"):
            text = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return in_arrow(rows, run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
