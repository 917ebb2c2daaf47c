"""HTML pages to clean text, blocks and question-answer pairs, with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.chunking import FAQ_SIZES, WEB_SIZES, Block, chunk_blocks, rows, squeeze
from moraine.session import map_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_CONTENT = frozenset("aside button canvas footer form header iframe input meta nav noscript option script select style svg template video".split())
NOT_TEXT = frozenset("iframe noscript script style svg template".split())
TEXT_TAGS = ("blockquote", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre", "td", "th")
INLINE = frozenset("a abbr b br code em i kbd mark q s small span strong sub sup u".split())
UNWANTED = re.compile(r"ads|advert|banner|breadcrumb|comment|cookie|footer|header|menu|nav|popup|related|share|sidebar|social|widget", re.I)
CONTENT_CLASS = re.compile(r"\b(article|content|entry-content|main-content|page-content|post|post-content)\b", re.I)

FAQ_CLASS = re.compile(r"faq|accordion|qa|tanya.?jawab|question|jawaban|pertanyaan", re.I)


#: Levels of nesting; elements below become siblings, as in browsers. Bounds what walking up and down costs.
DEPTH = 256


class Element:
    __slots__ = ("tag", "attrs", "children", "parent", "depth")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth: int = parent.depth + 1 if parent is not None else 0
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        todo: list[Element | str] = [self]
        while todo:
            e = todo.pop()
            if isinstance(e, Element):
                yield e
                todo += reversed(e.children)

    def text(self, skip: frozenset[str] = NOT_TEXT) -> str:
        out, todo = [], [*reversed(self.children)]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e)
            elif e.tag not in skip:
                todo += reversed(e.children)
        return squeeze(" ".join(out))

    def markup_length(self) -> int:
        """Characters of the element as it would be written out."""
        out, todo = 0, [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out += len(e)
            else:
                out += len(e.tag) + 2 + sum(len(k) + len(v) + 4 for k, v in e.attrs.items()) + (0 if e.tag in VOID else len(e.tag) + 3)
                todo += e.children
        return out

    def label(self) -> str:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("html", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "p" and self.here.tag == "p":
            self.here = self.here.parent or self.root
        while self.here.depth >= DEPTH:
            self.here = self.here.parent or self.root
        e = Element(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(e)
        if tag not in VOID:
            self.here = e

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.here.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag: str) -> None:
        up: Element | None = self.here
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.here = up.parent

    def handle_data(self, data: str) -> None:
        self.here.children.append(data)


def tree(page: str | None) -> Element:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def first(root: Element, *tags: str) -> Element | None:
    return next((e for e in root.walk() if e.tag in tags), None)


def pruned(e: Element) -> Element:
    """Without elements that aren't content, by tag or by class and id."""
    out = Element(e.tag, e.attrs, e.parent)
    out.children = [c if isinstance(c, str) else pruned(c) for c in e.children if isinstance(c, str) or not (c.tag in NOT_CONTENT or (c.tag not in ("body", "html") and UNWANTED.search(c.label())))]
    return out


def main_text(page: str | None) -> str:
    """The texts of the main part's blocks of more than ten characters, a blank line apart.

    The main part is the first article, the first main or the first div of a content class with over 200 characters that aren't white space; else the div of over
    150 with the greatest share of text in its markup, if that is over a quarter; else the body.
    """
    root = pruned(tree(page))
    size = lambda e: len(e.text().replace(" ", ""))
    part = next((e for name in ("article", "main") if (e := first(root, name)) is not None and size(e) > 200), None)
    part = part or next((e for e in root.walk() if e.tag == "div" and CONTENT_CLASS.search(e.label()) and size(e) > 200), None)
    if part is None:
        divs = [(n / m, e) for e in root.walk() if e.tag == "div" and (n := size(e)) > 150 and (m := e.markup_length()) > 200 and n > 0.25 * m]
        part = max(divs, key=lambda d: d[0])[1] if divs else first(root, "body") or root
    blocks = [t for e in part.walk() if e.tag in TEXT_TAGS and len(t := e.text()) > 10]
    return "\n\n".join(blocks) if blocks else part.text()


def matching(root: Element, selector: str) -> list[Element]:
    """What a simple selector names (tag, .class, #id, tag.class, tag#id)."""
    m = re.fullmatch(r"(\w*)([.#]?)([\w-]*)", selector.strip())
    if not m:
        return []
    return [e for e in root.walk() if (not m[1] or e.tag == m[1].lower()) and (not m[2] or (m[3] in e.attrs.get("class", "").split() if m[2] == "." else e.attrs.get("id") == m[3]))]


def selected(page: str | None, selector: str) -> str:
    """Texts of what a simple selector names; too little falls back to main_text()."""
    text = "\n\n".join(filter(None, (e.text() for e in matching(tree(page), selector))))
    return text if len(text) >= 100 else main_text(page)


def title(page: str | None) -> str:
    root = tree(page)
    if (e := first(root, "title")) is not None and (t := e.text(frozenset())):
        return t
    meta = next((e.attrs.get("content", "") for e in root.walk() if e.tag == "meta" and e.attrs.get("property") == "og:title"), "")
    return squeeze(meta) or (h.text() if (h := first(root, "h1")) is not None else "")


def _answered(elements: list[Element], asks, answers) -> list[tuple[str, str]]:
    """Each element that asks, with the texts of those right after it that answer."""
    pairs, i = [], 0
    while i < len(elements):
        q, i = elements[i], i + 1
        if asks(q):
            parts = []
            while i < len(elements) and answers(elements[i]):
                parts.append(elements[i].text())
                i += 1
            pairs.append((q.text(), "\n".join(filter(None, parts))))
    return pairs


def faq_pairs(page: str | None, question: str | None = None, answer: str | None = None) -> list[tuple[str, str]]:
    """Questions of 10 characters and answers of 20 at least: from the first that gives any of the selectors for both (if given), dl, details, FAQ containers, and headings with paragraphs."""
    root = tree(page)
    good = lambda pairs: [(q, a) for q, a in pairs if len(q) >= 10 and len(a) >= 20]
    parts = lambda e: [c for c in e.children if isinstance(c, Element)]
    if question and answer and (got := good((q.text(), a.text()) for q, a in zip(matching(root, question), matching(root, answer)))):
        return got
    names: list[tuple[str, str]] = []
    for dl in (e for e in root.walk() if e.tag == "dl"):
        names += _answered([c for c in parts(dl) if c.tag in ("dt", "dd")], lambda e: e.tag == "dt", lambda e: e.tag == "dd")
    if got := good(names):
        return got
    details = []
    for d in (e for e in root.walk() if e.tag == "details"):
        s = first(d, "summary")
        if s is not None:
            details.append((s.text(), squeeze(d.text().removeprefix(s.text()))))
    if got := good(details):
        return got
    named = [e for e in root.walk() if FAQ_CLASS.search(e.attrs.get("class", "")) or FAQ_CLASS.search(e.attrs.get("id", ""))]
    outer = set()
    for e in named:
        up = e.parent
        while up is not None and id(up) not in outer:
            outer.add(id(up))
            up = up.parent
    heads = ("h3", "h4", "h5", "h6", "strong", "b")
    held: list[tuple[str, str]] = []
    for e in named:
        if id(e) not in outer:
            held += _answered(parts(e), lambda c: c.tag in heads and len(c.text()) >= 10, lambda c: c.tag not in heads)
    if got := good(held):
        return got
    part = first(root, "article") or first(root, "main") or next((e for e in root.walk() if e.tag == "div" and re.search("content|article|post", e.attrs.get("class", ""), re.I)), None) or first(root, "body") or root
    near = [e for e in parts(part) if e.tag in ("h3", "h4", "p")] or [e for e in part.walk() if e.tag in ("h3", "h4", "p")]
    if got := good(_answered(near, lambda e: e.tag in ("h3", "h4") and len(e.text()) >= 10, lambda e: e.tag == "p")):
        return got
    # beyond the reference: headings of other levels that ask
    levels = ("h2", "h3", "h4", "h5")
    return good(_answered([e for e in root.walk() if e.tag in (*levels, "p")], lambda e: e.tag in levels and e.text().endswith("?"), lambda e: e.tag == "p"))


def accordion(root: Element) -> list[tuple[str, str]]:
    """Questions and answers of the items of Bootstrap accordions."""
    having = lambda e, *names: [x for x in e.walk() if x is not e and not {*names}.isdisjoint(x.attrs.get("class", "").split())]
    out = []
    for item in having(root, "accordion-item"):
        q, a = having(item, "accordion-button", "accordion-header"), having(item, "accordion-body")
        if q and a and q[0].text() and a[0].text():
            out.append((q[0].text(), a[0].text()))
    return out


def page_blocks(page: str | None) -> list[Block]:
    """Headings with their path, table headers and rows under their header, and text blocks; of a page with an accordion, its items alone."""
    root = tree(page)
    if items := accordion(root):
        return [Block(f"Pertanyaan: {q}\nJawaban: {a}", 1, "faq_item", None, "FAQ", ["FAQ"], "faq", None, i) for i, (q, a) in enumerate(items)]
    out: list[Block] = []
    path: list[str] = []

    def add(text: str, kind: str, level: int | None = None) -> None:
        if text:
            out.append(Block(text, 1, kind, level, path[-1] if path else "", list(path), "table" if kind in ("table_row", "sheet_header") else "narrative", None, len(out)))

    def visit(e: Element) -> None:
        nonlocal path
        if e.tag in NOT_TEXT or e.tag in ("footer", "nav", "head"):
            return
        if re.fullmatch("h[1-6]", e.tag):
            if t := e.text():
                path = [*path[: int(e.tag[1]) - 1], t]
                add(t, "heading", int(e.tag[1]))
        elif e.tag == "table":
            lines = [[c.text() for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for r in e.walk() if r.tag == "tr"]
            lines = [" | ".join(x) for x in lines if any(x)]
            add(lines[0] if lines else "", "sheet_header")
            for x in lines[1:]:
                add(f"{lines[0]}\n{x}", "table_row")
        elif e.tag == "details":
            loose: list[str] = []
            for c in [*e.children, None]:
                if isinstance(c, str) or (c is not None and c.tag in INLINE):
                    loose.append(c if isinstance(c, str) else c.text())
                    continue
                add(squeeze(" ".join(loose)), "paragraph")
                loose = []
                if c is not None:
                    visit(c)
        elif e.tag == "summary" and not any(re.fullmatch("h[1-6]", x.tag) for x in e.walk()):
            add(e.text(), "paragraph")
        elif e.tag in TEXT_TAGS:
            add(e.text(), "list_item" if e.tag == "li" else "paragraph")
        elif e.tag == "div" and not any(isinstance(c, Element) and (c.tag in TEXT_TAGS or c.tag in ("div", "table", "ul", "ol", "section", "article")) for c in e.children):
            if len(t := e.text()) > 20:
                add(t, "paragraph")
        else:
            for c in e.children:
                if isinstance(c, Element):
                    visit(c)

    visit(root)
    return out


BLOCK_SCHEMA = "source_id long, block_order int, text string, page_number int, block_type string, heading_level int, heading_text string, heading_path array<string>, source_kind string, sheet_name string"


def block_rows(source: object, blocks: list[Block]) -> Iterator[tuple]:
    for i, b in enumerate(blocks):
        yield (source, i, b.text, b.page, b.kind, b.level, b.heading, b.path, b.source, b.sheet)


def _table(pages: DataFrame, schema: str, make, id_col: str, html_col: str) -> DataFrame:
    return map_rows(pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")), make, schema)


def read_blocks(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return _table(pages, BLOCK_SCHEMA, lambda i, h: block_rows(i, page_blocks(h)), id_col, html_col)


def read_clean(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return _table(pages, "page_id long, title string, content string", lambda i, h: [(i, title(h), main_text(h))], id_col, html_col)


def faq_chunks(source: object, page: str | None) -> list[tuple]:
    """Rows of parent and child chunks of a page's pairs: each pair is a block of its own, without overlap and merging."""
    pairs = [Block(f"Pertanyaan: {q}\nJawaban: {a}", 1, "faq_item", None, q, ["FAQ", q], "faq", None, i) for i, (q, a) in enumerate(faq_pairs(page))]
    return list(rows(source, chunk_blocks(source, pairs, FAQ_SIZES, merge=False)))


def read_faq_chunks(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    from moraine.operators.chunking import CHUNK_SCHEMA

    return _table(pages, CHUNK_SCHEMA, faq_chunks, id_col, html_col)


def read_faq(pages: DataFrame, question: str | None = None, answer: str | None = None, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return _table(pages, "page_id long, ordinal int, question string, answer string", lambda i, h: [(i, n, q, a) for n, (q, a) in enumerate(faq_pairs(h, question, answer))], id_col, html_col)


def read_chunks(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    from moraine.operators.chunking import CHUNK_SCHEMA

    return _table(pages, CHUNK_SCHEMA, lambda i, h: rows(i, chunk_blocks(i, page_blocks(h), WEB_SIZES)), id_col, html_col)


def read_selected(pages: DataFrame, selector: str, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return _table(pages, "page_id long, content string", lambda i, h: [(i, selected(h, selector))], id_col, html_col)
