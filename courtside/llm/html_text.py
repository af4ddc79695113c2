"""Main text of web pages by composite text density.

Each node of a page's tree has a density: its characters for each tag, scaled down as links make up more of them
relative to the page. The subtree with the largest sum of its children's densities is the main one; a node beside the
path from it to the body counts as well if it is as dense as the least dense node of that path, and headings there do.
If the main subtree lies in an ``article`` or ``main`` element, that element is taken whole. Elements that are never
content (navigation, asides, forms, scripts, and containers that class, id or role name so: menus, notices, adverts,
comments, ...) are left out before densities are computed; one that holds the page's article is kept. Headings and
inline elements are never left out by name, and inside an article only whole names count (``comments``, not
``comments-on-method``), as they do for ids everywhere.

Pages only stream through: no shuffle, one page's tree at a time; tags are read in one pass, with the usual implied ends
(a ``p`` ends at the next block, an ``li`` at the next ``li``, and so on), with counts of open elements instead of walks up.
Of equal sums of densities the deepest and last node is taken.

Defined results: null, empty and text-less pages give an empty text. White space is what ``str.split`` takes for it. An
unclosed comment, script or style runs to the end. Rows that repeat an id are each extracted. Other columns of the
input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by their role in HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
NEVER = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "button", "select", "textarea", "input", "option", "dialog", "menu", "audio", "video", "title", "embed"}
FRAME = {"nav", "header", "footer", "aside", "form"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
PARTS = BLOCK - {"br", "hr"}
#: An open element of the first set ends when one of the second starts, unless one of the third is open in between.
IMPLIED = [
    ({"p"}, BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}, {"table", "td", "th", "button", "object"}),
    ({"li"}, {"li"}, {"ul", "ol", "menu", "dir"}),
    ({"dd", "dt"}, {"dd", "dt"}, {"dl"}),
    ({"option"}, {"option", "optgroup"}, {"select"}),
    ({"td", "th"}, {"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}),
    ({"tr"}, {"tr", "tbody", "thead", "tfoot"}, {"table"}),
    ({"tbody", "thead", "tfoot"}, {"tbody", "thead", "tfoot"}, {"table"}),
    ({"head"}, {"body"}, set()),
]
#: Words of class, id and role that mark what is not the article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|menu\w*|nav|navbar|navigation|sidebar\w*|side|breadcrumbs?|footer|masthead|header|site-?header|page-?header|topbar|toolbar|cookies?|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|trending|popular|comments?|comment-?list|disqus|respond|replies|reply|pagination|pager|paging|widget|search|searchform|form|complementary|contentinfo|dialog|copyright|legal|skip-?link|tags|tagcloud)(?=$|[\s_-])",
    re.I,
)
#: Whole names that mark the same inside an article, and wherever they are an id.
NAMES = set(
    "ad ads advert advertisement adsense adsbygoogle banner ad-slot ad-banner sponsored promo menu nav navbar navigation sidebar breadcrumb breadcrumbs toolbar cookie-notice cookie-banner cookie-consent consent notice notices notification alert popup modal overlay"
    " newsletter newsletter-signup subscribe signup share sharing share-buttons social social-share social-links related related-posts related-articles recommended trending comment comments comment-list comment-form comments-section reader-comments disqus disqus_thread respond reply replies pagination"
    " pager search searchform widget footer site-footer page-footer site-header page-header masthead topbar copyright skip-link tagcloud".split()
)
#: Elements that names can mark.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "p", "details", "figure", "center", "main", "article", "aside", "header", "footer", "nav", "form", "menu", "iframe"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What ends a tag, or begins a quoted value if an equals sign comes before it.
STOP = re.compile(r">|(?<==)\s*[\"']")
ATTRIBUTE = re.compile(r"(?<![^\s\"'])(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "boiler", "kids", "parent", "chars", "tags", "link_chars", "link_tags", "density", "sum", "blocks")

    def __init__(self, tag: str, parent: Node | None, boiler: int = 0):
        self.tag, self.parent, self.boiler, self.kids = tag, parent, boiler, []


#: Names of readers' comments, which are never the article, however long.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|disqus\w*|respond|replies|reply)(?=$|[\s_-])", re.I)
#: What a mark says: no mark, a name that text can outweigh, never the article.
UNMARKED, NAMED, CERTAIN = 0, 1, 2


def _boiler(tag: str, attributes: str, within: bool) -> int:
    """within: whether the element is in an article."""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            return CERTAIN
        if name not in ("class", "id", "role") or tag not in CONTAINERS or tag == "main":
            continue
        if tag == "article":
            if name != "role" and re.search(r"(?:^|[\s_-])(?:comments?|reply|replies|ads?|promo|related|teaser)(?=$|[\s_-])", value, re.I):
                return CERTAIN if COMMENTS.search(value) else NAMED
        elif within or name == "id":
            if not NAMES.isdisjoint(value.lower().split()):
                return CERTAIN if COMMENTS.search(value) else NAMED
        elif BOILERPLATE.search(value):
            return CERTAIN if COMMENTS.search(value) else NAMED
    return UNMARKED


def _tokens(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag or None, closing, attributes) of each mark-up token; the reader sends where to go on after raw text."""
    at, no_cdata = 0, False
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield at, end, None, False, ""
        elif html[at + 1 : at + 2] in ("!", "?"):
            end = -1
            if not no_cdata and html.startswith("<![CDATA[", at):
                end = html.find("]]>", at)
                no_cdata, end = end < 0, end + 2 if end >= 0 else -1
            end = html.find(">", at) if end < 0 else end
            if end < 0:
                return
            end += 1
            yield at, end, None, False, ""
        elif m := TAG.match(html, at):
            end = m.end()
            while end and (stop := STOP.search(html, end)) and stop[0] != ">":
                end = html.find(stop[0][-1], stop.end()) + 1  # quoted values are as long as they are
            end = stop.end() if end and stop else html.find(">", m.end()) + 1
            if not end:  # no tag ends from here on
                return
            moved = yield at, end, m[2].lower(), bool(m[1]), html[m.end() : end - 1]
            if moved is not None:
                end = moved
                yield -1, end, None, False, ""
        else:
            end = at + 1
        at = end


def parse(html: str) -> Node:
    root = node = Node("#root", None)
    opened: Counter[str] = Counter()  # of the node and those around it
    at, end = 0, len(html)

    def closed(node: Node, last: Node) -> Node:
        """The parent of ``last``, which ends with all in it that are open."""
        while node is not last:
            opened[node.tag] -= 1
            node = node.parent
        opened[last.tag] -= 1
        return last.parent

    tokens = _tokens(html)
    for begin, after, tag, closing, attributes in tokens:
        if begin > at:
            node.kids.append(unescape(html[at:begin]))
        at = after
        if tag is None:
            continue
        if closing:
            if opened[tag]:
                open_ = node
                while open_.tag != tag:
                    open_ = open_.parent
                node = closed(node, open_)
            continue
        for ends, starts, walls in IMPLIED:
            if tag in starts and any(opened[x] for x in ends):
                open_ = node
                while open_ is not None and open_.tag not in ends and open_.tag not in walls:
                    open_ = open_.parent
                if open_ is not None and open_.tag in ends:
                    node = closed(node, open_)
        attributes = attributes.rstrip()
        new = Node(tag, node, attributes and _boiler(tag, attributes, bool(opened["article"] or opened["main"])) or UNMARKED)
        node.kids.append(new)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            new.kids.append(html[at : close.start() if close else end])
            at = close.end() if close else end
            tokens.send(at)
        elif tag not in VOID and not attributes.endswith("/"):
            node = new
            opened[tag] += 1
    if at < end:
        node.kids.append(unescape(html[at:]))
    return root


def _order(root: Node) -> list[Node]:
    """The nodes below, each before its descendants."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [k for k in node.kids if isinstance(k, Node)]
    return out


def prune(root: Node) -> None:
    nodes = _order(root)
    holds: set[int] = set()  # nodes with an article or main element of their own right below
    for n in nodes:
        if n.tag in ("article", "main") and not n.boiler:
            up = n.parent
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    size: dict[int, int] = {}
    plain: dict[int, int] = {}  # without what is in links
    for n in reversed(nodes):
        size[id(n)] = sum(len(k.strip()) if isinstance(k, str) else 0 if k.tag in NEVER else size[id(k)] for k in n.kids)
        plain[id(n)] = 0 if n.tag == "a" else sum(len(k.strip()) if isinstance(k, str) else 0 if k.tag in NEVER or k.boiler == CERTAIN else plain[id(k)] for k in n.kids)
    inside: set[int] = set()
    for n in nodes:
        within = n.tag in ("article", "main") or id(n.parent) in inside
        if within:
            inside.add(id(n))
        kids = []
        for k in n.kids:
            if isinstance(k, Node):
                frame = k.tag in FRAME and not (k.tag == "header" and within)
                whole = k.tag == "form" and size[id(k)] > 0.6 * size[id(root)]
                # a name does not outweigh most of the page's text: density decides on it then
                most = k.boiler == NAMED and not frame and 2 * plain[id(k)] > plain[id(root)]
                if k.tag in NEVER or (k.boiler and not most) or frame:
                    if not (id(k) in holds and k.tag not in NEVER) and not whole:
                        continue
            kids.append(k)
        n.kids = kids


def measure(root: Node) -> None:
    nodes = _order(root)
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len(" ".join(k.split()))
            else:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    body_links, body_chars = root.link_chars, max(1, root.chars)

    def density(chars: int, tags: int, link_chars: int, link_tags: int) -> float:
        if not chars:
            return 0.0
        tags, link_tags, links, plain = max(1, tags), max(1, link_tags), max(1, link_chars), max(1, chars - link_chars)
        base = log(chars / plain * links + body_links / body_chars * chars + e)
        return chars / tags * log(chars / links * tags / link_tags) / log(base)

    for n in reversed(nodes):
        n.density = n.sum = density(n.chars, n.tags, n.link_chars, n.link_tags)
        n.blocks = any(isinstance(k, Node) and (k.blocks or k.tag in PARTS) for k in n.kids)
        if n.blocks:  # else it is one block of text, and its sum is its own density
            n.sum = sum(k.density if isinstance(k, Node) else density(len(" ".join(k.split())), 1, 0, 0) for k in n.kids)


def _write(node: Node, out: list[str]) -> None:
    stack: list[Node | str] = [node]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag in BLOCK:
            out.append(" ")
            stack.append(" ")
            stack += reversed(k.kids)
        else:
            stack += reversed(k.kids)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    prune(root)
    body = next((n for n in _order(root) if n.tag == "body"), root)
    measure(body)
    if not body.chars:
        body = root
        measure(body)
    best = max((n for n in reversed(_order(body)) if n is body or n.tag in PARTS), key=lambda n: n.sum)
    path, outer = [best], None
    while path[-1] is not body:
        path.append(path[-1].parent)
    for n in path:
        if n.tag in ("article", "main"):
            outer = n  # the outermost of them
    out: list[str] = []
    if outer is not None:
        _write(outer, out)
        return " ".join("".join(out).split())
    least = min(n.density for n in path)
    on_path = {id(n) for n in path}

    stack: list[Node | str] = [body]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k is best or id(k) not in on_path:
            _write(k, out)
        else:
            out.append(" ")
            stack.append(" ")
            stack += [x for x in reversed(k.kids) if (len(" ".join(x.split())) >= least if isinstance(x, str) else id(x) in on_path or x.density >= least or x.tag in HEADINGS)]
    return " ".join("".join(out).split())


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x.as_py()) for x in b.column(2)], pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
