"""HTML extraction by layout: a tree builder with implied tags and visibility rules, and a renderer that emits all
visible text with block spacing, lists and aligned table cells.

Scale: no shuffle; each page is worked on alone and iteratively, so that deep nesting costs no recursion.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.llm.shared import bounded, pieces, text_or_empty

# Fixed sets of element names, from the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title"}
HIDDEN = {"head", "title", "script", "style", "template", "noscript", "iframe", "noembed", "noframes", "datalist", "object", "audio", "video", "canvas", "rp"}
#: Drawings and formulas, and the elements inside them that are not shown.
FOREIGN = ("svg", "math")
HIDDEN_FOREIGN = {"desc", "defs", "metadata", "symbol", "clippath", "mask", "marker", "pattern", "annotation", "annotation-xml"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hgroup", "hr", "li", "dd", "dt", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}
#: Blocks with a blank line before and after.
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "pre", "blockquote", "figure", "hr", "menu", "dir"}
BLOCK = CLOSES_P | {"body", "html", "caption", "legend", "optgroup", "option", "tr", "td", "th", "thead", "tbody", "tfoot"}
HEAD_ONLY = {"title", "meta", "link", "base", "style", "script", "template", "noscript"}
CELL, SECTION, LIST = {"td", "th"}, {"thead", "tbody", "tfoot"}, {"ul", "ol", "menu", "dir"}
#: Elements whose end tags inside do not reach out.
SCOPE = {"table", "td", "th", "caption", "template", "object", "button"}

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]+|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)>?)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(raw: str) -> dict[str, str] | None:
    if not raw or raw.isspace() or raw == "/":
        return None
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        value = a or b or c
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


class TreeBuilder:
    """Open elements as a stack; `open` counts their names per scope, so that a stray end tag costs nothing."""

    def __init__(self):
        self.root = Node("html")
        self.stack = [self.root]
        self.scopes: list[tuple[int, dict[str, int]]] = [(0, {})]
        self.tables: list[int] = []
        self.in_head = False

    def push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.stack.append(node)
        if node.tag in SCOPE:
            self.scopes.append((len(self.stack) - 1, {}))
            if node.tag == "table":
                self.tables.append(len(self.stack) - 1)
        counts = self.scopes[-1][1]
        counts[node.tag] = counts.get(node.tag, 0) + 1

    def cut(self, to: int) -> None:
        """Closes all elements from position `to` of the stack on."""
        while len(self.stack) > to:
            at = len(self.stack) - 1
            node = self.stack.pop()
            if self.scopes[-1][0] == at and at:
                self.scopes.pop()
                if node.tag == "table":
                    self.tables.pop()
            else:
                counts = self.scopes[-1][1]
                counts[node.tag] = counts.get(node.tag, 1) - 1

    def close(self, tag: str) -> None:
        """Closes the nearest open element of the name in the current scope."""
        base, counts = self.scopes[-1]
        if not counts.get(tag):
            return
        at = len(self.stack) - 1
        while at > base and self.stack[at].tag != tag:
            at -= 1
        if self.stack[at].tag == tag and at:
            self.cut(at)

    def close_item(self, tags: tuple[str, ...], until: set[str]) -> None:
        base, counts = self.scopes[-1]
        if not any(counts.get(t) for t in tags):
            return
        at = len(self.stack) - 1
        while at > base and self.stack[at].tag not in until:
            if self.stack[at].tag in tags:
                self.cut(at)
                return
            at -= 1

    def to_table(self, parts: tuple[str, ...]) -> bool:
        """Closes what is open inside the innermost table below the named parts; false outside tables."""
        if not self.tables:
            return False
        at = self.tables[-1] + 1
        while at < len(self.stack) and self.stack[at].tag in parts:
            at += 1
        self.cut(at)
        return True

    def foreign(self, tags: tuple[str, ...] = FOREIGN) -> bool:
        return any(self.scopes[-1][1].get(t) for t in tags)

    def start(self, tag: str, attributes: dict[str, str] | None, closed: bool = False) -> None:
        """closed: the tag ends in a slash, which closes drawings, formulas and elements inside them."""
        if self.foreign():
            if tag in HIDDEN_FOREIGN:
                attributes = {**(attributes or {}), "hidden": ""}
            elif tag == "text":
                self.stack[-1].children.append(" ")
        if tag in ("html", "body", "head"):
            if tag == "head" and len(self.stack) == 1:
                self.push(Node("head"))
            else:
                self.leave_head()
                if attributes and tag == "body" and not self.root.attributes:
                    self.root.attributes = attributes
            return
        if tag not in HEAD_ONLY:
            self.leave_head()
        if tag in CLOSES_P:
            self.close("p")
        if tag == "li":
            self.close_item(("li",), LIST)
        elif tag in ("dt", "dd"):
            self.close_item(("dt", "dd"), {"dl"})
        elif tag in ("option", "optgroup"):
            self.close_item(("option",) if tag == "option" else ("option", "optgroup"), {"select"})
        elif tag in CELL:
            if self.to_table(("thead", "tbody", "tfoot", "tr")):
                self.implied_row()
        elif tag == "tr":
            if self.to_table(("thead", "tbody", "tfoot")) and self.stack[-1].tag == "table":
                self.push(Node("tbody"))
        elif tag in SECTION or tag in ("caption", "colgroup"):
            self.to_table(())
        if tag in VOID or closed:
            self.stack[-1].children.append(Node(tag, attributes))
        else:
            self.push(Node(tag, attributes))

    def implied_row(self) -> None:
        if self.stack[-1].tag == "table":
            self.push(Node("tbody"))
        if self.stack[-1].tag in SECTION:
            self.push(Node("tr"))

    def leave_head(self) -> None:
        if len(self.stack) > 1 and self.stack[1].tag == "head":
            self.cut(1)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.stack[-1].children.append(Node("br"))
        elif tag == "head":
            self.leave_head()
        elif tag in CELL or tag == "tr" or tag in SECTION or tag == "table":
            self.end_in_table(tag)
        else:
            self.close(tag)
            if tag == "text" and self.foreign(("svg",)):
                self.stack[-1].children.append(" ")

    def end_in_table(self, tag: str) -> None:
        if not self.tables:
            self.close(tag)
            return
        at = self.tables[-1]
        if tag != "table":
            at += 1
            while at < len(self.stack) and self.stack[at].tag != tag and self.stack[at].tag in ("thead", "tbody", "tfoot", "tr"):
                at += 1
            if at >= len(self.stack) or self.stack[at].tag != tag:
                return
        self.cut(at)

    def text(self, data: str) -> None:
        if len(self.stack) == 2 and self.stack[1].tag == "head":
            if not data.strip(" \t\n\r\f"):
                return
            self.leave_head()
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    """The tree of a page. Broken mark-up never raises."""
    builder, at, lower = TreeBuilder(), 0, ""
    while True:
        m = _TAG.search(html, at)
        data = html[at:m.start()] if m else html[at:]
        if data:
            builder.text(unescape(data) if "&" in data else data)
        if not m:
            return builder.root
        at = m.end()
        name = m[2]
        if not name:
            continue
        tag = name.lower()
        if m[1]:
            builder.end(tag)
            continue
        closed = m[3].endswith("/") and m[3][-2:-1] in ("", " ", "\t", "\n", '"', "'") and (tag in FOREIGN or builder.foreign())
        builder.start(tag, _attributes(m[3]), closed)
        if tag in RAW and not closed:
            lower = lower or html.lower()
            stop = lower.find("</" + tag, at) if len(lower) == len(html) else html.find("</" + name, at)
            stop = len(html) if stop < 0 else stop
            raw = html[at:stop]
            if raw:
                builder.text(unescape(raw) if tag in ("textarea", "title") and "&" in raw else raw)
            at = stop


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    a = node.attributes
    if not a:
        return True
    if "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _UNSEEN.search(a["style"]))


#: Lines are indented no further than this, so that deep nesting costs a line no more; markers and text stay.
DEEPEST_INDENT = 40


class Flow:
    """Lines of one flow of blocks: a page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # blank lines owed before the next text
        self.space = False
        self.indent = 0
        self.marker = ""

    def begin(self) -> None:
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        prefix = " " * min(self.indent, DEEPEST_INDENT)
        if self.marker:
            prefix = prefix[: max(0, len(prefix) - len(self.marker))] + self.marker
            self.marker = ""
        self.line.append(prefix)

    def text(self, data: str) -> None:
        if data[0] in " \t\n\r\f":
            self.space = True
        words = _SPACE.sub(" ", data).strip(" ")
        if words:
            if not self.line:
                self.begin()
            elif self.space:
                self.line.append(" ")
            self.line.append(words)
            self.space = data[-1] in " \t\n\r\f"

    def literal(self, data: str) -> None:
        for k, part in enumerate(data.replace("\r\n", "\n").split("\n")):
            if k:
                self.end_line(True)
            if part:
                if not self.line:
                    self.begin()
                self.line.append(part)

    def end_line(self, blank: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif blank and self.lines:
            self.gap += 1
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        if spaced and self.lines:
            self.gap = max(self.gap, 1)

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


def _number(a: dict[str, str] | None, name: str, otherwise: int, most: int | None = None) -> int:
    value = (a or {}).get(name, "").strip()
    if not re.fullmatch(r"[-+]?[0-9]+", value):
        return otherwise
    if most is not None:
        return min(int(value), most) if len(value) < 20 else most if value[0] != "-" else otherwise
    return int(value) if len(value) < 20 and abs(int(value)) < 1 << 31 else otherwise


#: A column is no wider than this for alignment, and no cell is moved further right than the end of alignment: longer
#: cells stay whole and push what follows two spaces on. Where a table would still be padded by more than PADDING
#: characters for each of its own, a cell counting for four, and the end of alignment once, that end is halved until it
#: isn't. So padding stays in proportion to the page, and no text is lost.
WIDEST_COLUMN, ALIGNED_TO, PADDING = 80, 2000, 6
#: Rows that a cell reaches down over, at most; browsers take no more.
MOST_ROWS = 65_534


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, list[str], int]]]:
    """The column of each cell (lines, colspan, rowspan): the first that neither the cells before it in its row nor cells
    that reach down from above take."""
    out: list[list[tuple[int, list[str], int]]] = []
    reaching: list[tuple[int, int, int]] = []  # (first column, end, rows left below), by column
    for row in rows:
        placed, at, k = [], 0, 0
        for lines, span, _ in row:
            while k < len(reaching) and reaching[k][0] < at + span:  # it would run into one from above: go past it
                at = max(at, reaching[k][1])
                k += 1
            placed.append((at, lines, span))
            at += span
        left = [(a, b, n - 1) for a, b, n in reaching if n > 1]
        new = [(a, a + span, min(down, MOST_ROWS) - 1) for (a, _, span), (_, _, down) in zip(placed, row, strict=True) if down > 1]
        reaching = sorted(left + new)
        out.append(placed)
    return out


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table of cells (lines, colspan, rowspan): each column as wide as its widest one-column cell, two spaces
    apart. A cell of several lines makes a row of several lines; its text stands in the first row that it covers."""
    placed = _placed(rows)
    widths: dict[int, int] = {}
    for row in placed:
        for k, lines, span in row:
            if span == 1:
                widths[k] = min(max([widths.get(k, 0), *map(len, lines)]), WIDEST_COLUMN)
    # columns that no single cell fills are two spaces wide
    known = sorted(widths)
    filled = [0, *accumulate(widths[k] for k in known)]
    start = lambda k: 2 * k + filled[bisect_left(known, k)]
    height = lambda row: max((len(lines) for _, lines, _ in row), default=0)
    cells = [[(start(k), lines[n]) for k, lines, _ in row if n < len(lines)] for row in placed for n in range(height(row))]
    chars = sum(len(t) + 4 for line in cells for _, t in line)
    limit = ALIGNED_TO
    while True:
        out, padding = [], 0
        for line in cells:
            parts, size = [], 0
            for k, text in line:
                if text:
                    gap = max(min(k, limit) - size, 2 * (size > 0))
                    padding += gap
                    parts.append(" " * gap + text)
                    size += gap + len(text)
            out.append("".join(parts).rstrip(" "))
        if padding <= ALIGNED_TO + PADDING * chars or not limit:
            return out
        limit //= 2


def render(root: Node) -> str:
    """All visible text, by blocks. Tables are laid out when they end, so nested ones come first."""
    flows = [Flow()]
    tables: list[list] = []
    counters: list[int | None] = []
    indents: list[int] = []
    pre = 0
    stack: list[tuple[Node, int]] = [(root, 0)] if visible(root) else []
    while stack:
        node, k = stack.pop()
        flow = flows[-1]
        if k == len(node.children):
            tag = node.tag
            if tag in CELL and tables and len(flows) == len(tables) + 1:
                lines = flows.pop().finish()
                if not tables[-1]:
                    tables[-1].append([])
                down = _number(node.attributes, "rowspan", 1, MOST_ROWS)
                tables[-1][-1].append((lines, max(1, _number(node.attributes, "colspan", 1, 1000)), max(1, down) if down else MOST_ROWS))
            elif tag == "table" and tables:
                lines = _aligned(tables.pop())
                flow.block(True)
                for line in lines:
                    if line:
                        flow.literal(line)
                        flow.end_line()
                    else:
                        flow.gap += 1
                flow.block(True)
            elif tag in BLOCK and tag != "tr":
                if tag == "pre":
                    pre -= 1
                if tag in LIST:
                    counters.pop()
                if tag in ("li", "dd", "blockquote"):
                    flow.end_line()
                    flow.marker = ""
                    flow.indent -= indents.pop()
                flow.block(tag in SPACED and not (tag in LIST and counters))
            continue
        stack.append((node, k + 1))
        child = node.children[k]
        if isinstance(child, str):
            if tables and len(flows) == len(tables) and not child.strip(" \t\n\r\f"):
                continue
            if pre:
                flow.literal(child)
            else:
                flow.text(child)
            continue
        if not visible(child):
            continue
        tag = child.tag
        if tag == "br":
            if not flow.line:
                flow.gap += 1 if flow.lines else 0
            flow.end_line()
        elif tag == "hr":
            flow.block(True)
        elif tag == "table":
            flow.block(True)
            tables.append([])
            stack.append((child, 0))
        elif tag == "tr" and tables and len(flows) == len(tables):
            tables[-1].append([])
            stack.append((child, 0))
        elif tag in CELL and tables and len(flows) == len(tables):
            flows.append(Flow())
            stack.append((child, 0))
        else:
            if tag in BLOCK and tag != "tr":
                flow.block(tag in SPACED and not (tag in LIST and counters))
                if tag == "pre":
                    pre += 1
                if tag in LIST:
                    counters.append(_number(child.attributes, "start", 1) if tag == "ol" else None)
                if tag == "li":
                    marker = "- "
                    if counters and counters[-1] is not None:
                        value = _number(child.attributes, "value", counters[-1])
                        counters[-1] = value + 1
                        marker = f"{value}. "
                    flow.marker = marker
                    indents.append(len(marker))
                    flow.indent += len(marker)
                elif tag in ("dd", "blockquote"):
                    flow.marker = ""
                    indents.append(2)
                    flow.indent += 2
            stack.append((child, 0))
    return "\n".join(flows[0].finish()).strip("\n")


def extract_text(html: str) -> str:
    return render(parse(html))


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `text`, the visible text of `html`; html goes. Null or empty html: an empty text. Repeated rows and
    other columns pass; an empty table gives no rows; a column of pages named text is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, html, 1 << 20):
            texts = pa.array([extract_text(x) for x in batch.column(html).to_pylist()], pa.string())
            rest = [c for c in batch.schema.names if c != html]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), texts], names=[*rest, "text"])

    source = bounded(pages.drop("text") if html != "text" else pages).withColumn(html, text_or_empty(html))
    fields = [f for f in source.schema.fields if f.name != html]
    return source.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))


def op7_html_layout(spark, sf_dir: str) -> DataFrame:
    read = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return read.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
