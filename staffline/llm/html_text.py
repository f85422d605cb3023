"""Main text of web pages, by scoring the tree of a page.

A page is read into a tree much as browsers do it, in one pass: scripts and styles are passed over, paragraphs, list items and table
cells close those before them, an end tag closes what is open inside it. Menus, headers, footers, sidebars, notices, adverts, forms
and reader comments are taken out by their element, role or name. Every paragraph (block of text) then passes points for its length
and commas to the containers around it: in full to the nearest, in part to those further up. A container's points are discounted by its
share of link text. The best one holds the article; its siblings that read like text are kept with it.

Pages are independent of each other: one map over all pages, no shuffle. The work on a page grows with its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm.common import ship_package

# Fixed values of HTML: which elements there are and how they nest.
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
#: A start tag closes the last open element of the first kind, unless one of the second kind is between.
CLOSES = {
    "a": ("a", "p li td th div section article"),
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist"),
    "td": ("td th", "tr"),
    "th": ("td th", "tr"),
    "tr": ("tr", "table"),
    "tbody": ("thead tbody tfoot caption", "table"),
    "thead": ("thead tbody tfoot caption", "table"),
    "tfoot": ("thead tbody tfoot caption", "table"),
}
CLOSES = {tag: (set(first.split()), set(second.split())) for tag, (first, second) in CLOSES.items()}
CLOSES |= {tag: ({"p"}, {"button"}) for tag in BLOCK - {"body", "caption", "html", "legend", "optgroup"} - CLOSES.keys()}
#: Neither an end tag nor a closing start tag reaches over these.
SCOPE = set("caption html object table td template th".split())
#: Deeper elements are taken as empty, as browsers do.
DEEPEST = 512

# What is not part of an article, by element, role and name (class or id).
NO_ARTICLE = set(
    "aside audio button canvas datalist dialog fieldset footer form frame frameset head iframe input label math menu nav noembed noframes noscript object "
    "optgroup option output script search select style svg template textarea title video xmp".split()
)
NO_ARTICLE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
NO_ARTICLE_NAMES = set(
    "ad ads adsbygoogle adsense advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored "
    "sponsors subscribe subscription toolbar widget".split()
)
#: Of them, those that an element may have that holds an article element: other articles, or readers' own.
OTHER_ARTICLES = set("comment comments disqus footer recommended related replies reply respond sidebar sidebars".split())
#: Names that begin so tell what an element goes with.
BESIDE = set("has hide is no show with without".split())
#: Names that end so tell how something is set, not what an element is.
SETTINGS = set("active closed disabled enabled loaded off on open visible".split())
#: What paragraphs pass their points to.
CONTAINERS = set("article blockquote body center details div dd figure html main section td".split())
MENUS = set("dir div dl menu ol section table ul".split())
COMMAS = re.compile("[,،、，﹐]")

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_COMMENT_END = re.compile(r"--!?>")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

KEPT, HEADINGS_ONLY, OUT = range(3)


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "state", "holds", "points", "chars", "link_chars", "links")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.state, self.holds = KEPT, 0
        self.points, self.chars, self.link_chars, self.links = 0.0, 0, 0, 0


# ---------------------------------------------------------------- the tree


def tree(page: str) -> list[Node]:
    """All elements of a page, parents before their children; the first one is the page. A tag or comment that is not closed by the end of the
    page is left out with all that follows it."""
    top = Node("#page", "", None)
    nodes, stack, opened = [top], [top], Counter()
    at, size = 0, len(page)

    def close(tags: set[str], stops: set[str]) -> bool:
        """Close the last open element of ``tags`` and what is open in it, unless a stop is between."""
        if not any(opened[t] for t in tags):
            return False
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag in tags:
                for node in stack[i:]:
                    opened[node.tag] -= 1
                del stack[i:]
                return True
            if tag in stops or tag in SCOPE:
                return False
        return False

    while at < size:
        start = page.find("<", at)
        text = page[at : start if start >= 0 else size]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                close({"head"}, set())
            stack[-1].children.append(text)
        if start < 0:
            break
        found = _TAG.match(page, start)
        if not found:
            after = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                short = re.compile(r"-?>").match(page, start + 4)
                end = short or _COMMENT_END.search(page, start + 4)
                at = end.end() if end else size
            elif after in ("!", "?") or (after == "/" and not page[start + 2 : start + 3].isalpha() and start + 2 < size):
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
            elif after.isalpha() and after.isascii() or after == "/":
                at = size
            else:
                stack[-1].children.append("<")
                at = start + 1
            continue
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            if tag not in ("html", "body", "#page"):
                close({tag}, set() if tag in BLOCK or tag in SCOPE else BLOCK)
            if tag == "br":
                stack[-1].children.append(" ")
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close({"head"}, set())
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
            if tag not in ("a", "p"):
                close({"p"}, {"button", "li", "dd", "dt"} if tag in ("li", "dd", "dt") else {"button"})
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            close({stack[-1].tag}, set())
        node = Node(tag, found[3], stack[-1])
        nodes.append(node)
        stack[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = page.find(">", end.end()) + 1 or size if end else size
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)
            opened[tag] += 1
    return nodes


def judge(nodes: list[Node]) -> None:
    """Set the state of every element that is not part of an article, and of what it holds."""
    told = []
    for node in nodes:
        told.append({k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(node.attributes)} if node.attributes.strip(" /") else {})
    for node, attributes in zip(reversed(nodes), reversed(told), strict=True):
        kinds = {node.tag, attributes.get("role"), attributes.get("itemprop")}
        node.holds = max(node.holds, 2 if kinds & {"body", "main"} else 1 if kinds & {"article", "articleBody"} else 0)
        if node.parent:
            node.parent.holds = max(node.parent.holds, node.holds)
    inside = {}  # whether an element is in an article
    for node, attributes in zip(nodes, told, strict=True):
        above = node.parent
        inside[node] = bool(above) and (inside[above] or above.tag in ("article", "main"))
        if above:
            node.state = above.state
        role = attributes.get("role", "").lower()
        header = node.tag == "header" or role == "banner"
        if node.tag in NO_ARTICLE or (role in NO_ARTICLE_ROLES and not header):
            node.state = OUT
        elif "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "")):
            node.state = OUT
        elif node.holds < 2 and (node.tag in BLOCK or node.tag in ("a", "ins") or (node.tag == "span" and above.tag not in ("pre", "code"))):
            for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
                parts = [p.lower() for p in _PARTS.findall(name)]
                said = NO_ARTICLE_NAMES & {parts[0], parts[-1]} if parts and parts[0] not in BESIDE and parts[-1] not in SETTINGS else set()
                if said == {"header"}:
                    header = True
                elif said and (not node.holds or said & OTHER_ARTICLES):
                    node.state = OUT
        if header and node.state != OUT and not node.holds:
            node.state = HEADINGS_ONLY if inside[node] else OUT


# ---------------------------------------------------------------- blocks and scores


def blocks(top: Node) -> Iterator[tuple[Node, str, int, int]]:
    """(element, text, link characters, links) of each block of text below ``top`` that is not out, in page order. A block ends where an element
    of BLOCK begins or ends; its white space is made single spaces."""
    parts: list[tuple[str, bool]] = []
    owner, links = top, 0

    def block() -> Iterator[tuple[Node, str, int, int]]:
        nonlocal links
        text = " ".join(_joined(parts).split())
        if text:
            linked = len(" ".join(_joined([p for p in parts if p[1]]).split()))
            yield owner, text, min(len(text), linked), links
        parts.clear()
        links = 0

    waiting: list = [(top, False, top.tag in HEADINGS, False)]
    while waiting:
        node, linked, heading, leaving = waiting.pop()
        if isinstance(node, str):
            parts.append((node, linked))
            continue
        if leaving:
            yield from block()
            owner = node.parent or top
            while owner.tag not in BLOCK and owner.parent:
                owner = owner.parent
            continue
        if node.state == OUT:
            if node.tag in BLOCK:
                yield from block()
            continue
        if node.tag in ("br", "hr"):
            parts.append((" ", linked))
        if node.tag in BLOCK:
            yield from block()
            owner = node
            waiting.append((node, linked, heading, True))
        heading = heading or node.tag in HEADINGS
        if node.tag == "a":
            linked, links = True, links + 1
        for child in reversed(node.children):
            if not isinstance(child, str) or node.state == KEPT or heading:
                waiting.append((child, linked, heading, False))
    yield from block()


def _joined(parts: list[tuple[str, bool]]) -> str:
    return "".join(html.unescape(p) if "&" in p else p for p, _ in parts)


def _container(node: Node) -> Node | None:
    while node and node.tag not in CONTAINERS and node.parent:
        node = node.parent
    return node


def score(nodes: list[Node], found: list[tuple[Node, str, int, int]]) -> None:
    """Pass the points of all blocks to the containers around them, and count text and link text of every element."""
    for owner, text, link_chars, links in found:
        points = (len(text) >= 25) + len(COMMAS.findall(text)) + min(len(text) / 100, 3)
        share, to = 1.0, _container(owner)
        for level in range(5):
            if not to:
                break
            to.points += points * share
            share = 1 / 2 if level == 0 else 1 / (3 * (level + 1))
            to = _container(to.parent) if to.parent else None
        owner.chars += len(text)
        owner.link_chars += link_chars
        owner.links += links
    for node in reversed(nodes):
        if node.parent:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            node.parent.links += node.links


def density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def worth(node: Node) -> float:
    """A page whose text is all in one link still has a best container."""
    return node.points * max(1 - density(node), 0.01)


def is_article(node: Node) -> bool:
    return node.tag == "article" or re.search(r"(?i)\brole\s*=\s*[\"']?article\b|\bitemprop\s*=\s*[\"']?articleBody\b", node.attributes) is not None


def chosen(nodes: list[Node]) -> list[Node]:
    """The best container, or the article it lies in, and the siblings that belong to it, in page order."""
    best = max(nodes, key=worth)
    article = best
    while article and not is_article(article):
        article = article.parent
    if article:
        best = article
    if not best.parent or best.tag in ("body", "html"):
        return [best]
    least = 0.2 * worth(best)

    def belongs(node: Node | str) -> bool:
        if node is best:
            return True
        if isinstance(node, str) or node.state == OUT or not node.chars:
            return False
        if article:
            return is_article(node) and worth(node) >= least
        if node.tag in HEADINGS:
            return density(node) < 0.5
        if node.tag in CONTAINERS:
            return worth(node) >= least
        return density(node) < 0.25

    return [node for node in best.parent.children if belongs(node)]


def main_text(page: str) -> str:
    """The blocks of the article of ``page``, joined by line ends; empty if there is none.

    Character references are decoded, a run of white space (as Unicode has it) is one space. In what is kept, only lists and sections
    that are nothing but links are left out besides what is no article by its element, role or name. A header inside
    an article or main element keeps its headings. A page without elements is its text.
    """
    nodes = tree(page)
    judge(nodes)
    found = list(blocks(nodes[0]))
    if not found:
        return ""
    score(nodes, found)
    for node in nodes:
        if node.tag in MENUS and node.links > 1 and density(node) >= 0.8 and not node.holds:
            node.state = OUT
    return "\n".join(text for node in chosen(nodes) for _, text, _, _ in blocks(node))


# ---------------------------------------------------------------- Spark job


def extract(spark: SparkSession, pages: DataFrame, keep: list[str], column: str = "html") -> DataFrame:
    """The columns ``keep`` of ``pages``, text (the main text of ``column``) and n_chars (its code points), one row for each row.

    A null or empty page has an empty text; repeated rows are each put out; any length is read whole. Nesting beyond 512 elements is
    flattened. An empty table gives an empty result. ``text`` and ``n_chars`` take the place of columns of these names.
    """
    ship_package(spark)
    fields = [f for f in pages.select(*keep).schema.fields if f.name not in ("text", "n_chars")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                texts = [main_text(p.as_py() or "") for p in part.column("__page")]
                columns = {f.name: part.column(f.name) for f in fields}
                yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*(F.col(f"`{f.name}`") for f in fields), F.col(column).alias("__page")).mapInArrow(read, schema)
