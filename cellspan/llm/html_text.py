"""Main text of web pages by composite text density over the DOM."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellspan.llm.common import pieces

#: Fixed values of HTML: elements without content, elements whose content is not markup, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
#: Fixed values of HTML: what an opening tag closes, and what stops the search for it.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: Elements that are never part of an article; words in class, id or role that mark such parts; words that
#: turn such a word round.
ASIDE_TAGS = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas button select textarea input dialog head title menu".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus"
    " footer gdpr masthead menu modal nav navbar navigation newsletter notice notices outbrain pagination pager popup promo promoted related"
    " replies reply respond share sharing sidebar social sponsor sponsored subscribe taboola toolbar topbar widget widgets contentinfo"
    " complementary alert alertdialog".split()
)
PLAIN_WORDS = frozenset("area bar block body box button buttons container content inner item items link links list panel post posts section site page top wrap wrapper".split())
TURNS = frozenset("no not non without has with".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)?))?)")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """kids holds texts (str) and Nodes in page order; mark is 2 where the element says that it is no part of an article,
    1 where one of its names has a part that says so."""

    __slots__ = ("tag", "mark", "parent", "kids", "chars", "tags", "link_chars", "link_tags", "in_links", "marked", "density", "total")

    def __init__(self, tag: str, mark: int = 0, parent: Node | None = None):
        self.tag, self.mark, self.parent, self.kids = tag, mark, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = self.in_links = self.marked = 0
        self.density = self.total = 0.0

    def nodes(self) -> list[Node]:
        """This and all nodes below, parents before their children, in page order."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            out.append(node)
            todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
        return out


def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """An opening tag's attributes by HTML's rules (the first of a name counts), and where the tag ends: -1 if the page
    ends before, and so the tag counts for nothing."""
    out: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        if not m:
            return out, -1
        if m[1]:
            return out, m.end()
        at = m.end()
        out.setdefault(m[2].lower(), m[3] or m[4] or m[5] or "")


def marks(attrs: dict[str, str]) -> int:
    """2 for an element of whose names all words that say something mark an aside, 1 for one that has such a word among
    others, 0 else. Hidden elements are judged like any other: what a page shows on request is still its text."""
    most = 0
    for name in " ".join(attrs[k] for k in ("class", "id", "role") if k in attrs).split():
        parts = [w.lower() for w in WORDS.findall(name)]
        if parts and not TURNS.intersection(parts) and ASIDE_WORDS.intersection(parts):
            most = max(most, 2 if all(w in ASIDE_WORDS or w in PLAIN_WORDS for w in parts) else 1)
    return most


def parse(page: str) -> Node:
    """The page's tree without the elements that are never part of an article, with the end tags that HTML lets out put in.

    Broken markup never fails, and time is linear in the page: stray end tags are left out, what is open at the end is
    closed, a < without any > after it is text, a tag whose quotes never end swallows the rest. The open elements' places are kept by tag, so no
    search climbs the tree."""
    root = Node("html")
    stack, at_tag, at_block = [root], {"html": [0]}, [0]
    gone = 0  # how many of the open elements are left out
    at, n = 0, len(page)

    def close(to: int) -> None:
        nonlocal gone
        while len(stack) > to:
            node = stack.pop()
            at_tag[node.tag].pop()
            if node.tag in BLOCK:
                at_block.pop()
            gone -= node.mark == 3

    def last(tags: tuple[str, ...]) -> int:
        return max((at_tag[t][-1] for t in tags if at_tag.get(t)), default=-1)

    def add(text: str, raw: bool = False) -> None:
        if text and not gone:
            stack[-1].kids.append(html.unescape(text) if "&" in text and not raw else text)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        m = TAG.match(page, start)
        if not m:
            add(page[at:start])
            if start >= n:
                break
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else n
            elif page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                add(page[start + 9 : end if end >= 0 else n], raw=True)
                at = end + 3 if end >= 0 else n
            elif page.startswith(("<!", "<?"), start) or page.startswith("</", start) and start + 2 < n:
                end = page.find(">", start)
                at = end + 1 if end >= 0 else n
            else:
                add("<")
                at = start + 1
            continue
        add(page[at:start])
        tag = m[2].lower()
        attrs, at = attributes(page, m.end())
        if at < 0:
            if page.find(">", start) < 0:
                add(page[start:])
            break
        if m[1]:
            own = at_tag.get(tag)
            # an end tag of an inline element does not reach over an open block; the root stays
            if own and own[-1] > 0 and (tag in BLOCK or at_block[-1] < own[-1]):
                close(own[-1])
            continue
        if tag == "html" or tag == "body" and at_tag.get("body"):
            continue
        if tag in ENDS_P and stack[at_block[-1]].tag == "p":
            close(at_block[-1])
        if tag in CLOSES:
            tags, stops = CLOSES[tag]
            stop = last(stops)
            to = min((at_tag[t][-1] for t in tags if at_tag.get(t) and at_tag[t][-1] > stop), default=-1)
            if to > 0:
                close(to)
        mark = 3 if tag in ASIDE_TAGS else marks(attrs) if attrs and tag not in ("body", "article", "main") else 0
        node = Node(tag, mark, stack[-1])
        if mark < 3 and not gone:
            stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not (page[at - 2] == "/" and tag not in BLOCK):
            at_tag.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                at_block.append(len(stack))
            stack.append(node)
            gone += mark == 3
    return root


def measure(root: Node) -> Node:
    """Fills in each node's density (characters per tag, less where links prevail) and total, the sum of its children's
    densities. Returns the body. Text of marked elements weighs as link text does, unless they hold most of the page's
    text; `marked` is how much of a node's text that is."""
    order = root.nodes()
    for node in reversed(order):
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len(k.strip())
            else:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_tags += k.link_tags + (k.tag == "a")
                node.in_links += k.in_links
        node.in_links += node.chars * (node.tag == "a")
    for node in reversed(order):
        if node.mark and node.chars > (0.5 if node.mark == 1 else 0.9) * root.chars:
            node.mark = 0
        for k in node.kids:
            if not isinstance(k, str):
                node.link_chars += k.link_chars
                node.marked += k.marked
        if node.mark or node.tag == "header":
            node.marked = node.chars
        if node.tag == "a" or node.marked == node.chars:
            node.link_chars = node.chars
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            node.density = c / t * math.log(c / max(lc, 1) * t / max(lt, 1) + 1e-12) / math.log(base) if base > 1 + 1e-9 else c / t
            node.density = max(node.density, 0.0)
    for node in order:
        node.total = sum(k.density for k in node.kids if not isinstance(k, str))
    return body


def densest(body: Node) -> Node | None:
    """The subtree with the largest sum of densities. The threshold is the least density on the path from the body to the
    node with the largest sum: a subtree below it is no candidate."""
    nodes = body.nodes()
    if not body.chars:
        return None
    best = max(nodes, key=lambda n: n.total)
    if best.total <= 0:
        best = max(nodes, key=lambda n: n.density)
    path, up = [], best
    while up and up is not body:
        path.append(up.density)
        up = up.parent
    threshold = min([*path, body.density])
    best = max((n for n in nodes if n.density >= threshold), key=lambda n: n.total, default=best)
    while best.tag not in BLOCK and best.parent:
        best = best.parent
    # one paragraph, item or cell is never the article of a page whose other paragraphs are its siblings
    while best is not body and best.tag in ("p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "tr", "tbody", "dd", "dt") and best.parent:
        best = best.parent
    return best


def main_nodes(body: Node) -> list[Node]:
    """The densest subtree and, where that leaves out a part, what belongs with it: the article (else main) element around
    it if the subtree has half of that element's unmarked text at least, or the only article within if that has half of
    the subtree's; else its headings, as long as nothing but headings and marked parts lie beside it."""
    best = densest(body)
    if best is None:
        return []
    own = lambda n: n.chars - n.marked
    for tag in ("article", "main"):
        up = best
        while up and up.tag != tag:
            up = up.parent
        if up and 2 * own(best) >= own(up):
            return [up]
        inside = [n for n in best.nodes() if n.tag == tag]
        if len(inside) == 1 and 2 * own(inside[0]) >= own(best):
            return inside
    beside = lambda n, k: k is not n and (k.strip() if isinstance(k, str) else own(k) and k.tag not in HEADINGS)
    while best is not body and best.parent and best.parent is not body and not any(beside(best, k) for k in best.parent.kids):
        best = best.parent
    if best is not body and best.parent:
        before = best.parent.kids[: best.parent.kids.index(best)]
        return [*(k for k in before if not isinstance(k, str) and k.tag == "h1"), best]
    return [best]


def is_part(node: Node, kept: Node) -> bool:
    """Whether a node below the kept one belongs to the article: all but headers of the page and marked ones for which
    density agrees. Where a name says nothing else, it is believed if anything else is there; otherwise the node has to
    be a small part of the unmarked text or mostly links."""
    own = kept.chars - kept.marked
    if node.tag == "header" and kept.tag in ("body", "html"):
        return node.parent is not None and node.parent is not kept
    if node.mark == 2:
        return own < 1
    return not (node.mark == 1 and (3 * node.chars <= own or 2 * node.in_links > node.chars))


def blocks(node: Node) -> list[str]:
    """The node's text by blocks in page order, without what is no part of the article, white space within each made one
    space."""
    out, now = [], []

    def end() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        k = todo.pop()
        if k is None:
            end()
        elif isinstance(k, str):
            now.append(k)
        elif k.tag == "br":
            now.append(" ")
        elif k is not node and (k.mark or k.tag == "header") and not is_part(k, node):
            if k.tag in BLOCK:
                end()
        elif k.tag in BLOCK:
            end()
            todo += [None, *reversed(k.kids)]
        else:
            todo += reversed(k.kids)
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page; empty for a null or empty page, or one without text outside of menus and the like."""
    return "\n".join(b for node in main_nodes(measure(parse(page or ""))) for b in blocks(node))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id_col, carry, text, n_chars) for every row of pages. A null or empty page has an empty text; repeated rows give
    repeated results; broken markup never fails; other columns are not read. Each page is one row and stays in its
    partition: nothing is shuffled."""
    names = [id_col, *carry]
    schema = T.StructType([*(pages.schema[c] for c in names), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [main_text(p.as_py()) for p in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*names, html_col).mapInArrow(run, schema)
