"""Layout-aware rendering of HTML to text.

A small tree builder reads tags, closes elements that HTML lets authors leave open, and drops what is not shown; the
renderer walks the tree without recursion and writes blocks with their spacing, list items with their markers, and
tables with aligned columns. Every visible character reference and text run is kept, blanks collapsed outside <pre>.

Time and output grow in proportion to a page's length, whatever its tags. For that some layout, but no text, is given up: lists
are indented for ``INDENTED`` levels, and deeper items say by how many levels they lie deeper; tables in more than eight tables
are plain blocks; cells that span several columns widen only the last of these; cells reach down only from the first ``SPANNED`` columns; a table whose padding would
be more than ``PADDING`` times its text has its cells side by side. Style sheets are not read: what only a rule of
<style> hides is shown.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe object audio video canvas datalist noembed noframes defs desc metadata annotation annotation-xml".split())
FOREIGN = frozenset(("svg", "math"))
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote article section aside header footer nav main figure form fieldset address details".split())
BLOCK = PARAGRAPH | frozenset("html body div li dt dd figcaption legend summary caption hr center option optgroup select tr td th thead tbody tfoot".split())
#: A new element of the key closes open ones of the values, unless one of the limits lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th", "caption"), "td": ("td", "th", "caption"), "th": ("td", "th", "caption"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "thead": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "body": ("head",)}
LIMITS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select", "datalist"), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "body": ("html",)}
#: End tags of other elements than these don't close a cell or a table.
CROSSES = frozenset("table tr tbody thead tfoot body html".split())
SCOPES = frozenset("td th table caption".split())
#: Columns that a cell may span, or keep in the rows below; and how much more blanks than text aligning may make.
SPANNED, PADDING = 1000, 8
#: Kinds of input whose value is shown.
SHOWN = frozenset(("", "text", "search", "email", "url", "tel", "number", "submit", "button", "reset"))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_BLANKS = re.compile(r"[ \t\n\r\f\v]+")
_HIDES = re.compile(r"display\s*:\s*none(?![\w-])", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)(?![\w-])", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PLACE = re.compile(r"hidden|style|start|reversed|value|alt|type|span", re.I)


class Node:
    __slots__ = ("attributes", "children", "hidden", "tag", "visible")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []
        style = self.attributes.get("style", "")
        self.hidden = tag in HIDDEN or "hidden" in self.attributes or bool(style and _HIDES.search(style))
        said = _VISIBILITY.findall(style) if style else None
        #: What the element says of itself: shown, not shown, or as its parent.
        self.visible = said[-1].lower() == "visible" if said else None


def attributes_of(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    return out


class Scanner:
    """Cuts a page into texts and tags in one walk: what was looked for in vain is not looked for again."""

    def __init__(self, html: str):
        self.html, self.absent = html, set()

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: at the first ``>`` outside quoted values; a quote that is never
        closed is none."""
        html, look = self.html, at
        while True:
            stop = _STOP.search(html, look)
            if not stop:
                return -1
            if stop[0] == ">":
                return stop.start()
            close = -1
            if html[at : stop.start()].rstrip()[-1:] == "=" if stop.start() - at < 64 else html[stop.start() - 64 : stop.start()].rstrip()[-1:] == "=":
                close = self.find(stop[0], stop.end())
            look = stop.end() if close < 0 else close + 1

    def next(self, at: int, foreign: bool) -> tuple[int, int, str, str]:
        """(start, end, tag, rest) of the next tag from ``at`` on; the tag of an end tag begins with ``/``; what is no
        element has none, and a section of characters is ``!`` with its text as rest. Without one, start is the end."""
        html, size = self.html, len(self.html)
        start = at
        while True:
            start = html.find("<", start)
            if start < 0 or start + 1 >= size:
                return size, size, "", ""
            after = html[start + 1]
            name = _NAME.match(html, start + 1 + (after == "/"))
            if name:
                end = self.tag_end(name.end())
                if end < 0:  # the page ends within the tag
                    return start, size, "", ""
                return start, end + 1, ("/" if after == "/" else "") + name[0].lower(), html[name.end() : end]
            if after not in "!?/":
                start += 1
                continue
            if html.startswith("<!--", start):
                end = self.find("-->", start + 2)
                return start, size if end < 0 else end + 3, "", ""
            if foreign and html.startswith("<![CDATA[", start):
                end = self.find("]]>", start)
                return start, size if end < 0 else end + 3, "!", html[start + 9 : size if end < 0 else end]
            end = self.find(">", start)
            return start, size if end < 0 else end + 1, "", ""


class Builder:
    """The tree of a page, and where on the path from its root to the open element each tag stands."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []  # but p

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in SCOPES:
            self.scopes.append(at)
        if node.tag in BLOCK and node.tag != "p":
            self.blocks.append(at)

    def cut(self, at: int) -> None:
        """Closes the element at a place, and all in it."""
        for node in reversed(self.stack[at:]):
            self.places[node.tag].pop()
        del self.stack[at:]
        for places in (self.scopes, self.blocks):
            while places and places[-1] >= at:
                places.pop()

    def close(self, tag: str) -> None:
        """An end tag; a stray one does nothing."""
        at = self.last(tag)
        if at and (tag in CROSSES or tag in SCOPES or not self.scopes or at > self.scopes[-1]):
            if tag in SCOPES and tag != "table" and at < self.last("table"):
                return
            self.cut(at)

    def room(self, tag: str) -> None:
        """What a new element of a tag closes, or implies, before it."""
        if tag in CLOSES:
            limit = self.last(*LIMITS[tag])
            inside = [p[i] for p in (self.places.get(t, ()) for t in CLOSES[tag]) if (i := bisect_right(p, limit)) < len(p)]
            if inside:
                self.cut(min(inside))
        elif tag in BLOCK:
            at = self.last("p")
            if at and (not self.blocks or at > self.blocks[-1]):
                self.cut(at)
        if tag in ("td", "th") and self.last("table") > self.last("tr"):
            self.push(Node("tr"))  # a cell outside a row begins one
        if self.stack[-1].tag == "head" and tag not in ("meta", "link", "base") and tag not in RAW and tag not in HIDDEN:
            self.cut(len(self.stack) - 1)


def tree(html: str) -> Node:
    """The tree of a page; unclosed elements end with their parents, and stray end tags are dropped."""
    builder, scanner, at = Builder(), Scanner(html), 0
    while at < len(html):
        start, end, tag, rest = scanner.next(at, builder.last(*FOREIGN) > 0)
        if start > at:
            builder.stack[-1].children.append(unescape(html[at:start]))
        at = end
        if tag[:1] == "/":
            builder.close(tag[1:])
        elif tag == "!":
            builder.stack[-1].children.append(rest)
        elif tag:
            builder.room(tag)
            node = Node(tag, attributes_of(rest) if rest and _PLACE.search(rest) else None)
            if tag in RAW:
                # the first end tag of that name ends it; what a tag without its end swallows is no text
                close = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(html, at)
                node.children.append(html[at : close.start()] if tag not in ("textarea", "title") else unescape(html[at : close.start()]))
                at = html.find(">", close.end()) + 1 or len(html)
            if tag in RAW or tag in VOID or (rest.endswith("/") and tag not in BLOCK):
                builder.stack[-1].children.append(node)
            else:
                builder.push(node)
    return builder.root


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining marks none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


#: Levels of lists that are indented; what lies deeper says by how many levels.
INDENTED = 16


class Page:
    """Lines written so far, and the line being written."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a blank is due before more text
        self.indent: list[str] = []
        self.marker = ""
        self.kept: set[int] = set()  # lines of preformatted text, of which blank ones stay

    def text(self, text: str, keep: bool) -> None:
        if keep:
            parts = text.replace("\r\n", "\n").split("\n")
            for i, part in enumerate(parts):
                if i:
                    self.newline(force=True)
                    self.kept.add(len(self.lines) - 1)
                if part:
                    self.line.append(part)
            return
        text = text.replace("\xa0", " ")
        body = _BLANKS.sub(" ", text)
        if not body:
            return
        if body[0] == " ":
            self.gap = bool(self.line) or self.gap
            body = body[1:]
        if not body:
            return
        if self.gap and self.line:
            self.line.append(" ")
        self.gap = body[-1] == " "
        self.line.append(body.rstrip(" "))

    def newline(self, force: bool = False) -> None:
        self.gap = False
        line = "".join(self.line)
        self.line = []
        if line.strip() or force:
            deeper = len(self.indent) - INDENTED
            self.lines.append("".join(self.indent[:INDENTED]) + (f"+{deeper} " if deeper > 0 else "") + self.marker + line.rstrip())
            if self.marker:
                self.marker = ""

    def paragraph(self) -> None:
        self.newline()
        if self.lines and self.lines[-1] != "":
            self.lines.append("")

    def done(self) -> str:
        self.newline()
        out: list[str] = []
        for i, line in enumerate(map(str.rstrip, self.lines)):
            if line or not out or out[-1] or i in self.kept:
                out.append(line)
        return "\n".join(out).strip("\n")


def _holders(table: Node) -> set[int]:
    """Ids of elements below a table, such as a form, that hold rows or cells of it."""
    parent: dict[int, Node] = {}
    found: set[int] = set()
    stack = [table]
    while stack:
        node = stack.pop()
        for child in node.children:
            if isinstance(child, Node) and child.tag != "table" and not child.hidden:
                parent[id(child)] = node
                if child.tag in ("tr", "td", "th"):
                    over = node
                    while over is not table and id(over) not in found:
                        found.add(id(over))
                        over = parent[id(over)]
                if child.tag not in ("td", "th"):
                    stack.append(child)
    return found


def _parts(table: Node) -> tuple[list[Node | str], list[list[Node]]]:
    """What stands in a table outside its cells, and its rows of cells, each in order."""
    holders, loose, rows = _holders(table), [], []
    stack: list[tuple[Iterator, list[Node] | None]] = [(iter(table.children), None)]
    while stack:
        children, row = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            loose.append(child)
        elif child.hidden:
            continue
        elif child.tag == "tr":
            rows.append([])
            stack.append((iter(child.children), rows[-1]))
        elif child.tag in ("td", "th"):
            if row is None:
                rows.append([child])
            else:
                row.append(child)
        elif child.tag in ("thead", "tbody", "tfoot", "colgroup") or id(child) in holders:
            stack.append((iter(child.children), row))
        else:
            loose.append(child)
    return loose, rows


def _span(cell: Node, name: str, most: int) -> int:
    said = cell.attributes.get(name, "").strip()
    return max(1, min(int(said), most)) if re.fullmatch(r"\d{1,5}", said) else 1


def grid(rows: list[list[Node]]) -> list[list[tuple[int, int, Node]]]:
    """(column, columns, cell) of each row's cells; cells of rows above that reach down keep their columns, if these are
    among the first ``SPANNED``."""
    out: list[list[tuple[int, int, Node]]] = []
    kept: dict[int, tuple[int, int]] = {}  # column -> the one behind the cell, the row below it
    for r, row in enumerate(rows):
        column, line, run = 0, [], -1
        for cell in row:
            while column in kept and kept[column][1] > r:
                column = kept[column][0]
            wide, deep = _span(cell, "colspan", SPANNED), _span(cell, "rowspan", 65534)
            line.append((column, wide, cell))
            if deep > 1 and column < SPANNED:
                # neighbours that reach equally far are one
                run = run if run in kept and kept[run] == (column, r + deep) else column
                kept[run] = (column + wide, r + deep)
            column += wide
        out.append(line)
    return out


def _aligned(cells: list[list[tuple[int, int, str]]]) -> list[str]:
    """Rows of (column, columns, text) as lines. A column is as wide as its widest cell of one column; where that would
    make more of blanks than ``PADDING`` times the text, cells follow each other as they are."""
    widths = [0] * (max((c for row in cells for c, n, _ in row if n == 1), default=0) + 1)
    for row in cells:
        for c, n, text in row:
            if n == 1:
                widths[c] = max(widths[c], width(text))
    reach = len(widths)
    # wider columns move all that begin right of them: sums by powers of two, so that a change and a look-up are short
    moved = [0] * (reach + 1)
    for i, w in enumerate(widths, 1):
        moved[i] += w + 3
        if i + (i & -i) <= reach:
            moved[i + (i & -i)] += moved[i]

    def begin(column: int) -> int:
        at = 0
        while column:
            at += moved[column]
            column &= column - 1
        return at

    for row in cells:
        for c, n, text in row:
            if n > 1 and c < reach:
                last = min(c + n, reach)
                more = width(text) - (begin(last) - begin(c) - 3)
                if more > 0:
                    widths[last - 1] += more
                    while last <= reach:
                        moved[last] += more
                        last += last & -last
    span = lambda c, n: max(0, from_[min(c + n, reach)] - from_[min(c, reach)] - 3)
    from_ = [0, *accumulate(w + 3 for w in widths)]
    text_size = sum(len(text) + 3 for row in cells for _, _, text in row)
    if sum(from_[min(row[-1][0], reach)] for row in cells if row) > PADDING * text_size + 4096:
        return [" | ".join(text for _, _, text in row) for row in cells]
    out = []
    for row in cells:
        parts, at = [], 0
        for c, n, text in row:
            parts.extend(" " * widths[k] for k in range(at, min(c, reach)))  # cells of the rows above
            parts.append(text + " " * (span(c, n) - width(text)) if (c, n, text) != row[-1] else text)
            at = c + n
        out.append(" | ".join(parts))
    return out


def _table(table: Node, page: Page, depth: int, visible: bool) -> None:
    """Rows with their cells in columns; a cell of several lines is written on one. What stands outside the cells is
    written before the rows, as browsers show it."""
    loose, rows = _parts(table)
    before = Node("#before")
    for part in [*loose, None]:
        caption = isinstance(part, Node) and part.tag == "caption"
        if (part is None or caption) and before.children:
            for line in filter(str.strip, render(before, depth + 1, visible).split("\n")):
                page.line.append(line)
                page.newline()
            before = Node("#before")
        if caption:
            page.line.append(_BLANKS.sub(" ", render(part, depth + 1, visible)))
            page.newline()
        elif part is not None:
            before.children.append(part)
    cells = [[(c, n, _BLANKS.sub(" ", render(x, depth + 1, visible)).strip()) for c, n, x in row] for row in grid(rows)]
    cells = [row for row in cells if any(text for _, _, text in row)]
    for line in _aligned(cells):
        page.line.append(line)
        page.newline()


def numbered(n: int, kind: str) -> str:
    """A list item's number in the style of ``type``: letters, Roman numerals, or digits (also for what these can't say)."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(ord(kind) + k) + out
        return out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "M CM D CD C XC L XL X IX V IV I".split()):
            out, n = out + sign * (n // value), n % value
        return out.lower() if kind == "i" else out
    return str(n)


def _list(node: Node) -> list:
    """[tag, next number, step, style] of a list."""
    said = node.attributes.get("start", "").strip()
    down = node.tag == "ol" and "reversed" in node.attributes
    first = int(said) if re.fullmatch(r"-?\d{1,9}", said) else sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if down else 1
    return [node.tag, first, -1 if down else 1, node.attributes.get("type", "").strip()]


def render(root: Node, depth: int = 0, visible: bool = True) -> str:
    """The visible text below a node, which itself is ``visible`` or not. Tables inside tables beyond eight levels are
    written as plain blocks."""
    page, keep = Page(), 0
    lists: list[list] = []
    visible = visible if root.visible is None else root.visible
    # (node, visible, None) enters, (node, _, f) leaves and calls f
    stack: list[tuple] = [(c, visible, None) for c in reversed(root.children)]
    while stack:
        node, visible, leave = stack.pop()
        if leave:
            leave()
            continue
        if isinstance(node, str):
            if visible:
                page.text(node, keep > 0)
            continue
        if node.hidden:
            continue
        tag = node.tag
        visible = visible if node.visible is None else node.visible
        if tag == "br":
            page.newline(force=True)
            continue
        if tag in ("img", "input"):
            shown = node.attributes.get("alt", "") if tag == "img" else node.attributes.get("value", "") if node.attributes.get("type", "").lower() in SHOWN else ""
            if visible:
                page.text(shown, False)
            continue
        if tag == "hr":
            page.paragraph()
            continue
        if tag == "table" and depth < 8:
            page.paragraph()
            _table(node, page, depth, visible)
            page.paragraph()
            continue
        after = []
        if tag in ("ul", "ol"):
            page.newline() if lists else page.paragraph()
            lists.append(_list(node))
            page.indent.append("  " if len(lists) > 1 else "")

            def leave_list() -> None:
                page.newline()
                lists.pop()
                page.indent.pop()
                if not lists:
                    page.paragraph()

            after.append(leave_list)
        elif tag == "li":
            page.newline()
            kind = lists[-1] if lists else ["ul", 1, 1, ""]
            said = node.attributes.get("value", "").strip()
            if re.fullmatch(r"-?\d{1,9}", said):
                kind[1] = int(said)
            page.marker = f"{numbered(kind[1], node.attributes.get('type', kind[3]).strip())}. " if kind[0] == "ol" else "- "
            kind[1] += kind[2]

            def leave_item() -> None:
                page.newline()
                page.marker = ""

            after.append(leave_item)
        elif tag in PARAGRAPH:
            # inside a list item, blocks follow each other without blank lines
            space = page.newline if lists else page.paragraph
            space()
            after.append(space)
            if tag == "pre":
                keep += 1

                def leave_pre() -> None:
                    nonlocal keep
                    keep -= 1

                after.append(leave_pre)
        elif tag in ("td", "th"):
            page.text(" ", False)
            after.append(lambda: page.text(" ", False))
        elif tag == "dd":
            page.newline()
            page.indent.append("  ")

            def leave_dd() -> None:
                page.newline()
                page.indent.pop()

            after.append(leave_dd)
        elif tag in BLOCK:
            page.newline()
            after.append(page.newline)
        stack.extend((node, visible, f) for f in after)
        stack.extend((c, visible, None) for c in reversed(node.children))
    return page.done()


def page_text(html: str | None) -> tuple[str | None, str, int]:
    """(title, visible text, lines that aren't blank) of a page."""
    if not html:
        return None, "", 0
    root = tree(html)
    text = render(root)
    title, stack = None, list(reversed(root.children))
    while stack:
        node = stack.pop()
        if isinstance(node, Node):
            if node.tag == "title":
                title = _BLANKS.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
                break
            if node.tag in ("#root", "html", "head"):
                stack.extend(reversed(node.children))
    return title, text, sum(1 for x in text.split("\n") if x)


@F.pandas_udf(StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """The visible text of each page; a null page has none."""
    return html.map(lambda x: page_text(x)[1])


#: Pages rendered together: a batch may hold many more.
PAGES_TOGETHER = 128


def with_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the column ``html`` replaced by ``text``, the visible text. A worker holds a few pages as objects at a time,
    and gives back what a batch took."""
    others = [f for f in pages.schema.fields if f.name != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), PAGES_TOGETHER):
                part = batch.slice(low, PAGES_TOGETHER)
                text = pa.array([page_text(x.as_py())[1] for x in part.column(html)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), text], names=[*(f.name for f in others), "text"])
            pa.default_memory_pool().release_unused()

    return pages.mapInArrow(run, StructType([*others, StructField("text", StringType())]))


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, html) to page_id, title, text, n_lines.

    Defined cases: a null or empty page has title null, text empty and no lines; a page without markup is its text; a page
    that ends within a tag ends before it; repeated rows are rendered one by one, other columns are passed over; time grows
    in proportion to a page's length, whatever its nesting or stray tags; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [page_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "title": [r[0] for r in rows], "text": [r[1] for r in rows], "n_lines": [r[2] for r in rows]})

    pages = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("html").cast("string").alias("html"))
    return pages.mapInPandas(run, "page_id string, title string, text string, n_lines long").withColumn("page_id", F.col("page_id").cast("long"))
