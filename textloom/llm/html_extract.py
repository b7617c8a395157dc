"""Main text of web pages by composite text density.

A page is parsed into a tree of elements.  Elements that are never part of an article (scripts, styles,
navigation, forms, adverts, notices, comments by readers and the like, by tag, role, class or id) are taken
out first.  Each remaining node gets its composite density: characters per tag, adjusted by the share of
linked characters and tags.  A node's density sum adds up its children's densities.  The node with the
largest sum is the core; the smallest density on the path from the body to the core is the threshold.  A composite
density grows with the size of an element, so for the threshold all are scaled to what they would be without links:
siblings along the path belong to the text if they reach the threshold and a share of the core's density.  Text in the
line of the core's own does too, however short: siblings of a paragraph, list or table, or of any element below the body,
that are such elements or bare text and hardly linked, and headings right before what belongs to the text.  A page that marks its article
(`article`, `main`, role=main, itemprop=articleBody) is searched inside the outermost of these elements that hold
characters: the core and the threshold are found in the same way, all siblings that are hardly linked are kept,
and further marked elements that reach the threshold add their own cores, in page order.  Classes and ids that mark
comments or notices elsewhere, but also name sections of articles (_MAYBE_NAME), count outside `article` only.

Inside the text, character references are decoded, runs of white space become one space, blocks are trimmed
and joined by a newline in page order; empty blocks are left out.  A line break inside a block is white space.
A null or empty page gives an empty text; a page without a body element is taken as a body.  Broken markup
never fails: unclosed elements end with their parent, stray end tags are ignored.  A page whose classes and
ids leave no text is read again without looking at them.  Of equal density sums the first in page order is the core.
Rows come back one for one, with repeated and null ids as they are; other columns are ignored; an empty table gives an
empty result.  One page, however long, is one unit of work and memory.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, read

#: Comments, and elements whose content is no text; one that is closed by its own tag ends there.
_RAW = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|noscript|template|iframe|svg|textarea|title|object|math|canvas)(?=[\s/>])(?:/>|(?:[^"'>]++|"[^"]*+"|'[^']*+')*+(?:(?<=[\s"']/)>|>.*?(?:</\1\s*>|\Z))|[^>]*>.*?(?:</\1\s*>|\Z))""", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>")
#: One attribute: its whole name, and its value.
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
_SPACE = frozenset("br td th img".split())
#: Elements that hold no article text.
_DROP = frozenset("nav footer aside form button select menu dialog head".split())
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
#: Words in class or id that mark what is not the article.
_DROP_NAME = re.compile(r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?:ads?|advert\w*|adsense|alert|announcement|banner|breadcrumbs?|comment\w*|cookies?|consent|disqus|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notification|pager|pagination|popup|promo\w*|respond|sharing|side-?bar|signup|social|sponsor\w*|subscribe|toolbar|topbar|widget)(?:$|[\s_-])", re.I)
#: The same outside `article`: sections of articles may have these names.
_MAYBE_NAME = re.compile(r"(?:^|[\s_-])(?:discussion|feedback|notices?|related|replies|responses|share)(?:$|[\s_-])", re.I)
#: The same outside a marked article: heads of pages.
_DROP_HEAD = re.compile(r"(?:^|\s)(?:(?:site|page|top|global|main)[_-]?)?header(?:$|\s)", re.I)
#: Elements that hold running text, and marks inside it.
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FLOW = _HEADS | frozenset("p pre blockquote ul ol dl table figure hr br b i em strong a span u s q code sub sup small abbr cite mark time del ins font tt kbd var samp img".split())
#: A sibling's density as a share of the core's, if it has LARGE of its characters or more and if not; the share of linked characters of what is hardly linked.
CORE_SHARE, SMALL_SHARE, LARGE, LINKED = 0.5, 0.8, 0.25, 0.3
#: Start tags that end an open element of the second set, up to a border.
_P_ENDS = _BLOCK - {"body", "html", "caption", "legend", "option", "summary", "tbody", "thead", "tfoot", "tr", "dd", "dt", "li"}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "thead": ({"tr", "td", "th", "tbody"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"})}


class Node:
    __slots__ = ("tag", "parent", "kids", "marked", "drop", "chars", "tags", "lchars", "ltags", "density", "even", "total")

    def __init__(self, tag, parent, drop=False, marked=False):
        self.tag, self.parent, self.drop, self.marked = tag, parent, drop, marked
        self.kids: list = []


def _attributes(tag: str, text: str, in_marked: bool, in_article: bool = False, names: bool = True) -> tuple[bool, bool]:
    """Whether the element is taken out, and whether it marks the article; names=False looks at no class and id."""
    drop, marked = tag in _DROP or (tag == "header" and not in_marked), tag in ("article", "main")
    if text and not text.isspace():
        for name, value in _ATTR.findall(text):
            name, value = name.lower(), value.strip("\"' ").lower()
            if name in ("class", "id"):
                if names and tag not in ("body", "html") and (_DROP_NAME.search(value) or not in_article and _MAYBE_NAME.search(value) or not in_marked
                    and _DROP_HEAD.search(value)):
                    drop = True
            elif name == "role":
                drop = drop or value in _DROP_ROLE
                marked = marked or value in ("main", "article")
            elif name == "itemprop":
                marked = marked or value == "articlebody"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                drop = drop or tag not in ("body", "html")
    return drop, marked


def parse(html: str, names: bool = True) -> Node:
    root = node = Node("html", None)
    html = _RAW.sub(" ", html)
    at = depth = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            node.kids.append(html[at : m.start()])
        at = m.end()
        end, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if tag in ("html", "body"):  # one of each; a later one adds nothing
            if not end and tag == "body" and depth == 0:
                drop, marked = _attributes(tag, rest, False)
                body = Node(tag, root, drop, marked)
                root.kids.append(body)
                node, depth = body, 1
            continue
        if end:
            x = node
            while x is not None and x.tag != tag:
                x = x.parent if x.tag not in ("td", "th", "table") or tag in _BLOCK or tag in ("td", "th") else None
            if x is not None and x.parent is not None and x.tag != "body":
                node = x.parent
            continue
        if tag in _P_ENDS:
            x = node
            while x is not None and x.tag != "p":
                x = None if x.tag in _BLOCK or x.tag in ("td", "th") else x.parent
            if x is not None:
                node = x.parent
        if tag in _CLOSES:
            closed, border = _CLOSES[tag]
            x, last = node, None
            while x is not None and x.tag not in border and x.tag != "body":
                if x.tag in closed:
                    last = x
                x = x.parent
            if last is not None:
                node = last.parent
        x, in_marked, in_article = node, False, False
        if tag == "header" or "class" in (lowered := rest.lower()) or "id" in lowered:
            while x is not None and not in_article:
                in_marked, in_article, x = in_marked or x.marked, x.tag == "article", x.parent
        drop, marked = _attributes(tag, rest, in_marked, in_article, names)
        new = Node(tag, node, drop, marked)
        node.kids.append(new)
        if tag not in _VOID and not rest.rstrip().endswith("/"):
            node = new
    if at < len(html):
        node.kids.append(html[at:])
    return root


def _ordered(top: Node) -> list[Node]:
    """The nodes below and including top that are not taken out, parents first."""
    out, stack = [], [top]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [k for k in reversed(x.kids) if isinstance(k, Node) and not k.drop]
    return out


def _measure(nodes: list[Node]) -> None:
    linked = set()
    for x in nodes:
        if x.tag == "a" or x.parent is not None and id(x.parent) in linked:
            linked.add(id(x))
        own = sum(len(k) - k.count(" ") for k in x.kids if isinstance(k, str) and not k.isspace())
        x.chars, x.tags, x.lchars, x.ltags = own, 0, own if id(x) in linked else 0, 0
    inside = {id(x) for x in nodes}
    for x in reversed(nodes):
        p = x.parent
        if p is not None and id(p) in inside:
            p.chars += x.chars
            p.tags += x.tags + 1
            p.lchars += x.lchars
            p.ltags += x.ltags + (x.tag == "a")
    body = nodes[0]
    share = body.lchars / max(body.chars, 1)
    for x in nodes:
        c, t = x.chars, max(x.tags, 1)
        lc, lt = max(x.lchars, 1), max(x.ltags, 1)
        base = math.log(c / max(c - x.lchars, 1) * x.lchars + share * c + math.e)
        x.density = c / t * math.log1p(c / lc * t / lt) / math.log1p(base) if c else 0.0
        x.even = c / t * math.log1p(c / lc * t / lt) / math.log1p(c * t) if c else 0.0
    for x in nodes:
        kids = [k.density for k in x.kids if isinstance(k, Node) and not k.drop]
        x.total = sum(kids) if kids else x.density


def _above(x: Node, top: Node) -> list[Node]:
    """x and its ancestors up to top."""
    out = [x]
    while x is not top and x.parent is not None:
        x = x.parent
        out.append(x)
    return out


def _core(nodes: list[Node]) -> list[Node]:
    """The subtrees that are the text, in page order; parts of them that are not are taken out."""
    body, inside, best = nodes[0], {}, {}  # the outermost marked element of each node that has one, and its core
    for x in nodes:
        top = inside.get(id(x.parent)) or (x if x.marked and x.chars else None)
        if top is not None:
            inside[id(x)] = top
            if id(top) not in best or x.total > best[id(top)][1].total:
                best[id(top)] = (top, x)
    core = max([x for _, x in best.values()] or nodes, key=lambda x: x.total)
    least = min(p.even for p in _above(core, body))
    tops = [(top, x) for top, x in best.values() if x is core or top.even >= least] or [(body, core)]
    for top, x in tops:
        path = _above(x, top)
        for parent, child in zip(path[1:], path):
            _prune(parent, child, core, least, top is not body)
    return [top for top, _ in tops]


def _prune(parent: Node, child: Node, core: Node, least: float, marked: bool) -> None:
    """Takes out what does not belong to the text around child, a node on the path to the core."""

    def dense(size: int, even: float) -> bool:
        return even >= least and (marked or even >= core.even * (CORE_SHARE if size >= LARGE * core.chars else SMALL_SHARE))

    inline = marked or parent.tag not in ("body", "html") or child.tag in _FLOW
    kids, after = [], False  # from the last to the first; whether the element after this one stays
    for k in reversed(parent.kids):
        if isinstance(k, str):
            size = len(k) - k.count(" ")
            if k.isspace() or inline or dense(size, size):
                kids.append(k)
            continue
        if k is child:
            after = True
        elif not k.drop:
            flow = inline and (marked or k.tag in _FLOW) and k.lchars <= LINKED * k.chars
            k.drop = not (dense(k.chars, k.even) or flow or after and k.tag in _HEADS and not k.lchars)
            after = not k.drop if k.chars else after
        kids.append(k)
    parent.kids = kids[::-1]


def _blocks(tops: list[Node]) -> list[str]:
    lines: list[str] = []
    now: list[str] = []

    def flush():
        if now:
            line = " ".join(unescape("".join(now)).split())
            if line:
                lines.append(line)
            now.clear()

    for top in tops:
        stack: list = [(top, False)]
        while stack:
            x, done = stack.pop()
            if isinstance(x, str):
                now.append(x)
            elif done or x.tag in _BLOCK:
                flush()
                if not done:
                    stack.append((x, True))
                    stack += [(k, False) for k in reversed(x.kids) if isinstance(k, str) or not k.drop]
            elif x.tag in _SPACE:
                now.append(" ")
                stack.append((" ", False))
                stack += [(k, False) for k in reversed(x.kids) if isinstance(k, str) or not k.drop]
            else:
                stack += [(k, False) for k in reversed(x.kids) if isinstance(k, str) or not k.drop]
        flush()
    return lines


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return _main_text(html, True) or _main_text(html, False)


def _main_text(html: str, names: bool) -> str:
    root = parse(html, names)
    body = next((k for k in root.kids if isinstance(k, Node) and k.tag == "body"), root)
    nodes = _ordered(body)
    _measure(nodes)
    if not nodes[0].chars:
        return ""
    return "\n".join(_blocks(_core(nodes)))


def _extract(batches):
    for batch in batches:
        text = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return arrow_map(pages, _extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
