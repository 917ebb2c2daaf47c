"""HTML extraction by tree scoring.

Each paragraph gets points for its length and its commas, and passes them to its parent in full, to its
grandparent by half and to ancestors beyond by 1 / (3 * level). A container's score is discounted by the share of its text
that is in links. The best container is kept, and those of its siblings that score well or are paragraphs that
read like text. Paragraphs come in the order of the page, a blank line apart.

The parser scans for tags and keeps a stack of open elements that closes what browsers close by themselves, so
unclosed, stray and broken tags never fail. Its time is in proportion to the page: regular expressions don't backtrack, each
name's open elements are known by their places in the stack, and elements below 512 levels become siblings, as in browsers.

Navigation, footers and containers with unlikely names are left out, as is what is hidden. If nothing that reads like text is
left, the page is scored again with all but the hidden parts and the navigation.

Defined cases: null and empty pages give an empty text and no title. Pages without any paragraph that scores give the text of
all their blocks. Equal scores go to the container that opens first. A comment or script that isn't closed takes the rest of the page, as in
browsers; a tag that isn't closed is text, as is all that follows it. Rows that repeat give the same text each. Pages of any
length are parsed whole. An empty table gives an empty table. Further columns pass through; columns of the same
names as the results are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import fresh, map_texts

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?")
_USED = re.compile("class|id|style", re.I)  # hidden has id in it
_RAW = {n: re.compile(f"</{n}(?![a-z0-9])[^>]*+>?", re.I) for n in ("script", "style", "noscript", "template", "svg", "textarea", "iframe")}
_NO_DISPLAY = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
#: Levels of nesting; elements below become siblings.
DEPTH = 512
_UNLIKELY = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|footer|header|menu|nav\w*|popup|promo|related|share|sidebar|social|sponsor\w*|widget)(?:$|[\s_-])", re.I)
_LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|text|story)(?:$|[\s_-])", re.I)
_DROPPED = {"nav", "footer", "aside", "header"}
_NEVER = {"button", "select", "title", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_PARAGRAPHS = {"p", "pre", "td", "th", "blockquote", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "figcaption"}
_BLOCKS = _PARAGRAPHS | {"div", "article", "section", "main", "body", "ul", "ol", "dl", "table", "tr", "tbody", "thead", "header", "footer", "nav", "aside", "form", "figure", "html"}
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "block", "children", "score", "dropped", "gone", "weight", "length", "linked")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "", strip: bool = True, block: Node | None = None):
        self.tag, self.parent, self.block, self.children = tag, parent, block, []  # children: nodes and strings
        self.score, self.length, self.linked, self.weight = 0.0, 0, 0, 0
        self.dropped = tag in _NEVER or (strip and tag in _DROPPED) or tag == "nav"
        for name, value in _ATTRIBUTE.findall(attributes) if attributes and _USED.search(attributes) else ():
            value, name = value.strip("\"'"), name.lower()
            if name in ("class", "id"):
                if strip and _UNLIKELY.search(value) and not _LIKELY.search(value) and tag not in ("html", "body"):
                    self.dropped = True
                self.weight += 25 if _LIKELY.search(value) else 0
            elif name == "hidden" or (name == "style" and _NO_DISPLAY.search(value)) or (name == "aria-hidden" and value.lower() == "true"):
                self.dropped = True
        self.gone = self.dropped or (parent is not None and parent.gone)


class _Open:
    """The stack of open elements, with the places of each name's."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {"html": [0]}, [0]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in _BLOCKS:
            self.blocks.append(at)

    def close(self, at: int) -> None:
        """Take the element at this place and all within it off; each is taken off once, so all closing takes linear time."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in _BLOCKS:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)


#: What a new element of a name closes, if none of the second lies between.
_CLOSES = {"li": (("li",), ("ul", "ol")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table", "tbody", "thead")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",))}


def parse(page: str, strip: bool = True) -> tuple[Node, str]:
    """The tree, and the title. strip: whether footers, headers, asides and containers with unlikely names are dropped."""
    root = Node("html", None)
    open_ = _Open(root)
    title, at, n = "", 0, len(page)

    def text(a: int, z: int) -> None:
        if z > a:
            here = open_.stack[-1]
            here.children.append(page[a:z])
            if open_.places.get("a") and not here.gone:  # a link's text counts for the block around it
                open_.stack[open_.blocks[-1]].linked += len(_SPACE.sub(" ", entities.unescape(page[a:z])).strip())

    while at < n:
        i = page.find("<", at)
        if i < 0:
            break
        text(at, i)
        at = i
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), i):
            end = page.find(">", i)
            if end < 0:
                break
            at = end + 1
            continue
        if not page[i + 1 : i + 2].isalpha() and page[i + 1 : i + 2] != "/":
            text(i, i + 1)
            at = i + 1
            continue
        m = _TAG.match(page, i)
        if not m:
            end = page.find(">", i) if page[i + 1] == "/" else -1
            if end < 0:
                break  # no tag is closed from here on
            at = end + 1  # </> and the like
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            place = open_.last(tag)
            if place > 0:
                if tag == "title" and not title:
                    title = _SPACE.sub(" ", entities.unescape("".join(c for c in open_.stack[place].children if isinstance(c, str)))).strip()
                open_.close(place)
            continue
        if tag == "html":
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in _BLOCKS and open_.stack[open_.blocks[-1]].tag == "p":  # a block ends an open paragraph
            open_.close(open_.blocks[-1])
        if tag in _CLOSES:
            own, stop = _CLOSES[tag]
            place = open_.last(*own)
            if place > open_.last(*stop):
                open_.close(place)
        if len(open_.stack) >= DEPTH:
            open_.close(DEPTH - 1)
        here = open_.stack[-1]
        node = Node(tag, here, m[3], strip, open_.stack[open_.blocks[-1]])
        here.children.append(node)
        if tag not in _VOID:  # a slash at the end of another tag means nothing
            open_.push(node)
    text(at, n)
    return root, title


def walk(node: Node) -> Iterator[Node]:
    """All kept nodes in the order of the page."""
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, Node) and not c.dropped]


def text_of(node: Node) -> str:
    """The text of a node without its inner blocks' texts, white space squeezed."""
    out: list[str] = []
    todo: list[Node | str] = [*reversed(node.children)]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "br":
            out.append(" ")
        elif not n.dropped and n.tag not in _BLOCKS:
            todo += reversed(n.children)
    return _SPACE.sub(" ", entities.unescape("".join(out))).strip()


def score(root: Node) -> tuple[list[tuple[Node, str]], list[Node]]:
    """The paragraphs with their texts, and the containers that got points."""
    nodes = list(walk(root))
    paragraphs = [(n, t) for n in nodes if n.tag in _BLOCKS and (t := text_of(n))]
    for n, t in paragraphs:
        n.length = len(t)
    for n in reversed(nodes):  # from the leaves up
        if n.parent is not None:
            n.parent.length += n.length
            n.parent.linked += n.linked
    for n, t in paragraphs:
        level, up = 0, n
        points = 1 + t.count(",") + min(len(t) // 100, 3) if len(t) >= 25 else 0
        while points and up is not None:
            if level:
                up.score += points / (1 if level == 1 else 2 if level == 2 else 3 * level)
            elif n.tag not in _PARAGRAPHS:  # text right in a container is its own
                up.score += points
            up, level = up.parent, level + 1
    return paragraphs, [n for n in nodes if n.score > 0]


def value(n: Node) -> float:
    return (n.score + n.weight) * (1 - n.linked / n.length) if n.length else 0.0


def extract(page: str | None) -> tuple[str, str]:
    """Title and main text."""
    for strip in (True, False):
        root, title = parse(page or "", strip)
        paragraphs, containers = score(root)
        if containers:
            return title, chosen(paragraphs, containers)
        if strip:
            short = paragraphs
    # nothing scores: all that there is, without footers and the like if that leaves any
    return title, "\n\n".join(t for _, t in short or paragraphs)


def chosen(paragraphs: list[tuple[Node, str]], containers: list[Node]) -> str:
    """The text of the best container and of its siblings that are kept."""
    best = max(containers, key=value)
    kept = {id(best)}
    if best.parent is not None:
        least = max(10.0, value(best) * 0.2)
        for s in best.parent.children:
            if isinstance(s, Node) and not s.dropped and s is not best:
                share = s.linked / s.length if s.length else 1.0
                if value(s) >= least or (s.tag in _PARAGRAPHS and ((s.length > 80 and share < 0.25) or (0 < s.length <= 80 and not share and s.tag[0] == "h"))):
                    kept.add(id(s))
    out = []
    for n, t in paragraphs:
        up = n
        while up is not None and id(up) not in kept:
            up = up.parent
        if up is not None:
            out.append(t)
    return "\n\n".join(out)


def extracted(pages: DataFrame, *, html_col: str = "html", keep_html: bool = False) -> DataFrame:
    """pages with the columns title and text, without the raw page unless it is to be kept."""
    names = [c for c in pages.columns if c.lower() not in ("title", "text") and (keep_html or c.lower() != html_col.lower())]
    (page,) = fresh(pages, "page_to_extract")
    schema = pages.select(*names).schema.add("title", "string").add("text", "string")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = [extract(x.as_py()) for x in part.column(len(names))]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array([o[0] for o in own], pa.string()), pa.array([o[1] for o in own], pa.string())], names=schema.names)

    return map_texts(pages.select(*names, F.col(html_col).alias(page)), run, schema)
