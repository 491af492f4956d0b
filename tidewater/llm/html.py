"""Main text of web pages by scoring the tree's containers."""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import portions

#: Elements without an end tag; those whose content is no text of the page; those that never hold the article; block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
APART = frozenset("nav footer aside button select menu dialog svg canvas object audio video map figcaption head datalist".split()) | RAW
BLOCK = frozenset("address article blockquote body center dd details div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside fieldset".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h2 h3".split())
CONTAINER = frozenset("div section article main body".split())
#: Parts of lists and tables, which are no containers of their own.
PARTS = frozenset("tr thead tbody tfoot table ul ol dl li dt dd p".split())
#: Words within a class, id or role that mark what is not the article; words that may mark it, or a part of an article that is called so; and names of layouts that
#: only mention such a part. Names in camel case count by their words.
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|paywall|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|widget|footer|masthead|topbar|toolbar|social|share|sharing|related|recommend\w*|"
    r"comments?|disqus|login|signup|pager|pagination|copyright|complementary|contentinfo|skip)(?:$|[\s_-])",
    re.I,
)
UNSURE = re.compile(r"(?:^|[\s_-])(?:notice|alert|side|foot|header|replies|reply|discussion|responses?|search|tags)(?:$|[\s_-])", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: What the lines of a reader's post say beside its text: when it was written, or how to answer it.
STAMP = re.compile(
    r"\b\d+\s*(?:s|m|h|d|w|sec|min|hr|second|minute|hour|day|week|month|year)s?\.?\s+ago\b|\b\d{1,2}:\d{2}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|"
    r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b|\byesterday\b|\bjust now\b",
    re.I,
)
ANSWER = re.compile(r"\b(?:reply|replies|answer|report|flag|upvote|like|likes|says|said|wrote)\b", re.I)
LAYOUT = re.compile(r"(?:with|without|has|no|show|hide)[_-]", re.I)
#: Classes that name the article or what holds it.
CONTENT = frozenset("content article main post entry story body text page wrapper container".split())
#: What points are worth that pass out of an element that is marked as no article, or that are compared within it. An element with a main heading
#: and so much text is not apart, whatever it is called.
MARKED, MIXED, TITLED_CHARS = 0.05, 0.5, 250
#: An unsure mark counts on what is short, or mostly links, or a form; a post of a thread has no more than so many characters, and its own lines no more than so many.
SHORT_CHARS, LINKED, POST_CHARS, LINE_CHARS = 160, 0.5, 3000, 60
_TEXT = re.compile(r"[^<]+")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BLANK = re.compile(r"\s+")

#: Where an open element of a kind ends by itself when one of these begins.
_CLOSES = {
    "p": BLOCK,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}
#: Elements that keep what is open around them open.
_BARRIER = (BLOCK - frozenset(_CLOSES)) | frozenset(["ul", "ol", "dl", "table"])


class Node:
    """An element: its name, parent, children (text among them) and weight: 1, 0 for what never holds the article, between for what seems not to.

    chars and links count the text within it, and within its links; run and commas that of its own run of text, not in further blocks. titled: it
    holds a main heading or an article. score: its points; trust: the product of the weights from the root down to it.
    """

    __slots__ = ("chars", "children", "commas", "depth", "links", "name", "parent", "run", "score", "titled", "trust", "unsure", "weight")

    def __init__(self, name: str, parent: Node | None, weight: float, unsure: bool = False):
        self.name, self.parent, self.weight, self.unsure, self.children = name, parent, weight, unsure, []
        self.chars = self.links = self.run = self.commas = 0
        self.score, self.trust, self.titled = 0.0, 1.0, name in ("h1", "article", "main")
        # blocks up to the root, where nothing else lies between
        if name not in BLOCK or name in ("article", "main", "section"):
            self.depth = 99
        else:
            self.depth = 1 if parent is None else min(99, parent.depth + 1)


def _weight(name: str, attributes: str, depth: int) -> tuple[float, bool]:
    """An element's weight, and whether its name may but need not mark it."""
    unsure = False
    if name in APART:
        return 0.0, unsure
    if name in ("html", "body", "main"):
        return 1.0, unsure
    weight = MARKED if name in ("form", "fieldset") or name == "header" and depth <= 2 else 1.0
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            weight = min(weight, MARKED)
        elif key in ("class", "id", "role"):
            words = [_CAMEL.sub("-", x) for x in value.split()]
            if any(ASIDE.search(x) and not LAYOUT.match(x) for x in words):
                weight = min(weight, MIXED if CONTENT.intersection(x.lower() for x in words) else MARKED)
            unsure = unsure or any(UNSURE.search(x) and not LAYOUT.match(x) for x in words)
    return weight, unsure


def _tag_end(text: str, pos: int) -> int:
    """Where a tag ends, past its >, which does not count in quotes; a quote that nothing closes is a character like others."""
    while True:
        pos = _UNQUOTED.match(text, pos).end()
        if pos >= len(text):
            return pos
        if text[pos] == ">":
            return pos + 1
        close = text.find(text[pos], pos + 1)
        if close < 0:  # nor will another one be closed: look for the end only
            close = text.find(">", pos)
            return len(text) if close < 0 else close + 1
        pos = close + 1


class Tree:
    """A page's elements in page order. Unclosed ones end with their parent, or where the kind of the next one asks for it; stray end tags are
    passed over. One pass, whatever the nesting: for each name it is known where in the stack of open elements it is open."""

    def __init__(self, text: str):
        self.root = Node("html", None, 1.0)
        self.nodes = [self.root]
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.barriers, self.blocks = [0], [0]
        self._read(text)
        self._measure()

    def _push(self, node: Node) -> None:
        at = len(self.open)
        self.open.append(node)
        self.places.setdefault(node.name, []).append(at)
        if node.name in _BARRIER:
            self.barriers.append(at)
        if node.name in BLOCK:
            self.blocks.append(at)

    def _close(self, at: int) -> None:
        """Ends the open element at a place of the stack, and all within it; the root stays open."""
        while len(self.open) > max(1, at):
            name = self.open.pop().name
            self.places[name].pop()
            if name in _BARRIER:
                self.barriers.pop()
            if name in BLOCK:
                self.blocks.pop()

    def _end(self, name: str) -> None:
        places = self.places.get(name)
        # the end of an inline element does not end a block
        if places and (name in BLOCK or places[-1] > self.blocks[-1]):
            self._close(places[-1])
        elif name == "p":
            self._add("p", "")

    def _add(self, name: str, attributes: str) -> Node:
        barrier = self.barriers[-1]
        ends = [p[k] for c in _CLOSED_BY.get(name, ()) if (p := self.places.get(c)) and (k := bisect.bisect_right(p, barrier)) < len(p)]
        if ends:
            self._close(min(ends))
        up = self.open[-1]
        node = Node(name, up, *_weight(name, attributes, up.depth))
        up.children.append(node)
        self.nodes.append(node)
        return node

    def _read(self, text: str) -> None:
        pos, end = 0, len(text)
        while pos < end:
            if m := _TEXT.match(text, pos):
                self.open[-1].children.append(m[0])
                pos = m.end()
                continue
            if text.startswith(("<!", "<?"), pos):
                opens, closes = next(x for x in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")) if text.startswith(x[0], pos))
                pos = text.find(closes, pos + len(opens))
                pos = end if pos < 0 else pos + len(closes)
                continue
            m = _NAME.match(text, pos)
            if not m:
                self.open[-1].children.append("<")
                pos += 1
                continue
            name = m[2].lower()
            pos = _tag_end(text, m.end())
            if m[1]:
                self._end(name)
                continue
            if name == "html":
                continue
            attributes = text[m.end() : pos].removesuffix(">")
            node = self._add(name, attributes)
            if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK and name not in RAW:
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*(?:>|$)", re.I).search(text, pos)
                pos = close.end() if close else end
                continue
            self._push(node)

    def _measure(self) -> None:
        """Counts from the leaves up and trust from the root down."""
        within = {}
        for node in self.nodes:
            within[id(node)] = node.name == "a" or node.parent is not None and within[id(node.parent)]
        for node in reversed(self.nodes):
            if node.weight == 0:
                continue
            for c in node.children:
                if isinstance(c, str):
                    n = len(" ".join(c.split()))
                    node.chars += n
                    node.run += n
                    node.commas += c.count(",")
                    if within[id(node)]:
                        node.links += n
            if node.unsure and node.weight == 1 and (node.chars < SHORT_CHARS or link_density(node) > LINKED or any(isinstance(c, Node) and c.name == "form" for c in node.children)):
                node.weight = MARKED
            if node.weight == 1 and is_thread(node):
                node.weight = MARKED
            if node.titled and node.weight < 1 and node.chars >= TITLED_CHARS:
                node.weight = 1.0
            up = node.parent
            if up is not None:
                if node.weight == 1:
                    up.titled = up.titled or node.titled
                    up.chars += node.chars
                    up.links += node.links
                if node.name not in BLOCK:
                    up.run += node.run
                    up.commas += node.commas
        for node in self.nodes[1:]:
            node.trust = node.parent.trust * node.weight


_CLOSED_BY = {name: tuple(c for c, begins in _CLOSES.items() if name in begins) for name in frozenset().union(*_CLOSES.values())}


def own_lines(node: Node) -> list[str]:
    """The short lines of a node, whatever they are marked as."""
    return [x for x in _lines(node) if len(x) <= LINE_CHARS]


def is_thread(node: Node) -> bool:
    """Whether a node holds readers' posts: most of its elements are of one kind, two or more, and each of these has a short line that says when it was written and one
    by which it is answered, or three or more that say when. A post has no main heading and is no longer than POST_CHARS."""
    if node.name in ("html", "body", "main", "table", "tbody", "tr") or node.titled:
        return False
    kinds: dict[str, list[Node]] = {}
    for c in node.children:
        if isinstance(c, Node) and c.name in ("div", "li", "article", "section", "dd", "blockquote") and 0 < c.chars <= POST_CHARS:
            kinds.setdefault(c.name, []).append(c)
    posts = max(kinds.values(), key=len, default=[])
    if len(posts) < 2 or sum(c.chars for c in posts) < 0.6 * node.chars:
        return False
    stamped = answered = 0
    for c in posts:
        lines = own_lines(c)
        when = any(STAMP.search(x) for x in lines)
        stamped += when
        answered += when and any(ANSWER.search(x) and not x.endswith((".", "!", "?")) for x in lines)
    return answered >= max(2, 0.6 * len(posts)) or len(posts) >= 3 and stamped >= 0.8 * len(posts) and answered > 0


def parse(text: str) -> Tree:
    return Tree(text)


def link_density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def score_tree(tree: Tree) -> list[Node]:
    """Gives every container its points, and returns those with any: a paragraph has 1, one for each comma, one for each 100 characters up to 3;
    its parent gets all of them, the grandparent half, further ones a third by their distance. Points that pass out of an element are worth its
    weight. Then all points fall by the link density."""
    scored: dict[int, Node] = {}
    for node in tree.nodes:
        if node.trust == 0 or node.run < 2:
            continue
        holds = node.name in CONTAINER
        if not (node.name in PARAGRAPH or holds and any(isinstance(c, str) and not c.isspace() for c in node.children)):
            continue
        points = 1 + node.commas + min(3, node.run / 100)
        up, far = node if holds else node.parent, 0
        if up is not node:
            points *= node.weight
        while up is not None and far < 5:
            up.score += points / (1 if far == 0 else 2 if far == 1 else 3 * far)
            scored[id(up)] = up
            points *= up.weight
            up, far = up.parent, far + 1
    for node in scored.values():
        node.score *= 1 - link_density(node)
    return list(scored.values())


def _up(node: Node | None) -> Iterator[Node]:
    """A node and what holds it, from within."""
    while node is not None:
        yield node
        node = node.parent


def best_nodes(tree: Tree) -> tuple[list[Node], frozenset[int]]:
    """The article or main element that holds the best container; where there is none, that container with its headings and those of its siblings
    that have few links. With the ids of the best container and of all that hold it, which stay whatever they are called."""
    scored = score_tree(tree)
    if not scored:
        return [tree.root], frozenset([id(tree.root)])
    best = max(scored, key=lambda n: n.score * n.trust)
    while best.parent is not None and best.name in PARTS:
        best = best.parent
    holders = [x for x in _up(best) if x.name in ("article", "main")]
    if holders:
        best = next((x for x in reversed(holders) if x.name == "article"), holders[-1])
    # an article in one of several sections: a parent that scores three quarters of it holds them all
    while best.parent is not None and best.name not in ("article", "main") and best.parent.score >= 0.75 * best.score and best.parent.name not in ("html",):
        best = best.parent
    line = frozenset(id(x) for x in _up(best))
    if best.parent is None:
        return [best], line
    least, out = max(10.0, 0.2 * best.score), []
    for x in best.parent.children:
        if x is best:
            out.append(x)
        elif isinstance(x, Node) and x.weight == 1 and x.name in BLOCK and x.chars:
            density = link_density(x)
            if x.score >= least and density < 0.5 or x.name in HEADING:
                out.append(x)
            elif best.name in ("article", "main"):
                continue
            elif x.name != "p" and density < 0.25 or x.name == "p" and (x.chars > 80 and density < 0.25 or density == 0):
                out.append(x)
    return out, line


def blocks(node: Node, held: frozenset[int]) -> list[str]:
    """The texts of a node's blocks in page order, white space run together, character references decoded; empty ones left out, as is what stands
    apart and is not in held."""
    return list(_lines(node, held))


def _lines(node: Node, held: frozenset[int] | None = None) -> Iterator[str]:
    """blocks(), or, without held, those of all that is within."""
    line: list[str] = []

    def end() -> Iterator[str]:
        text = _BLANK.sub(" ", entities.unescape("".join(line))).strip()
        line.clear()
        if text:
            yield text

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            yield from end()
        elif isinstance(x, str):
            line.append(x)
        elif x.name == "br":
            line.append(" ")
        elif x.weight == 1 or held is None and x.weight > 0 or held is not None and id(x) in held:
            if x.name in BLOCK:
                yield from end()
                stack.append(None)
            stack.extend(reversed(x.children))
    yield from end()


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by an empty line; empty where there is none."""
    if not page:
        return ""
    nodes, line = best_nodes(parse(page))
    return "\n\n".join(b for node in nodes for b in blocks(node, line))


def extract_main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each whole page and n_chars, its code points. Other columns pass through; html itself is left out.

    Nulls: a null page is empty and has an empty text, as has a page without text. Columns named text or n_chars are replaced. Empty table: no
    rows. Very deep or broken pages are read without recursion, in time that grows with their length. Repeated rows give repeated rows.
    """
    others = [c for c in pages.columns if c not in (html, text, "n_chars")]
    slim = pages.select(*others, html)
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches):
        for batch, raw in (x for whole in batches for x in portions(whole, html)):
            texts = [main_text(x.decode("utf-8", "replace")) for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*others, text, "n_chars"])

    return slim.mapInArrow(extract, schema)


def op3_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.col("n_chars"))
