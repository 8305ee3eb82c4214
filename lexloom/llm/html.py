"""Operator 3, HTML extraction: layout-aware rendering of all visible text.

A tree builder with implied tags (a paragraph ends where a block begins, a
list item at the next, cells and rows at theirs) and visibility rules (head,
scripts and the like, `hidden`, `display:none`, `visibility:hidden`, hidden
inputs, comments) feeds a renderer. Blocks stand on lines of their own, paragraphs,
headings, lists and tables with an empty line around; list items carry their
bullet or number, indented by depth; table cells are padded to their column, which is as wide as
its widest cell that another follows, WIDTH at most; longer ones go on in further lines of that width, and behind a word that is longer still the
row goes on in the next line, in its columns. Cells that span rows or columns keep the others in their columns; preformatted text
keeps its blanks. Nothing visible is left out, and all tables are laid out by this one rule, whatever the page's size.

Both parts take time and space in proportion to the page: no stray tag is looked for below the open ones,
nesting of any depth is walked with a stack of its own, and a cell costs WIDTH blanks at most, and as many for each of the ROWS rows that it may span. Indents end at INDENT; of tables inside tables more than TABLES deep the cells are blocks, as each level would copy all lines below it.

Pages are rendered where they are read, with no exchange; a task holds one slice.

Defined cases: null and empty html gives empty text; unclosed or stray tags
never fail; an attribute that should be a number and is none counts as absent (ASCII digits, nine at most); a character
reference of eight digits or more is the replacement character; unknown tags are inline; repeated rows render alike; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp"}
INVISIBLE = {"head", "script", "style", "template", "noscript", "title", "object", "datalist", "iframe", "audio", "video", "canvas"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", "fieldset"}
BLOCKS = SPACED | {"html", "body", "div", "section", "article", "header", "footer", "nav", "main", "aside", "address", "li", "dt", "dd", "tr", "caption", "thead", "tbody", "tfoot", "form", "figcaption", "details", "summary", "hgroup", "center", "legend", "option", "hr"}
#: An opening tag of the first set closes the nearest open one of the second, unless one of the barriers is nearer.
IMPLIED = (
    ({"li"}, {"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dt", "dd"}, {"dl"}), ({"option"}, {"option"}, {"select"}),
    ({"td", "th"}, {"td", "th"}, {"tr", "table"}), ({"tr"}, {"tr"}, {"table"}),
    ({"thead", "tbody", "tfoot"}, {"thead", "tbody", "tfoot"}, {"table"}), ({"body"}, {"head"}, set()),
    (BLOCKS - {"html", "body"}, {"p"}, (BLOCKS | {"td", "th"}) - {"p"}),
)
#: By tag: the rules that it sets off, those that it opens, and those that it bars. The last rule, of paragraphs, comes first.
_SETS_OFF, _OPENS, _BARS = ({t: [k for k in (7, *range(7)) if t in IMPLIED[k][n]] for t in set().union(*(r[n] for r in IMPLIED))} for n in range(3))
INDENT, TABLES, WIDTH = 40, 8, 48
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])", re.ASCII)
#: Columns that a cell may span, as in the standard, and beyond which cells of a table span nothing; and rows that a cell may span.
COLUMNS, ROWS = 1000, 100


def unescape(text: str) -> str:
    return entities.unescape(_LONG_REFERENCE.sub("\ufffd", text)) if "&" in text else text


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def attribute(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return (m[2] or "").strip("\"'")
        return None

    def number(self, name: str) -> int | None:
        m = _NUMBER.match(self.attribute(name) or "") if self.attributes else None
        return int(m[1]) if m else None

    def hidden(self) -> bool:
        if self.tag in INVISIBLE:
            return True
        if not self.attributes:
            return False
        low = self.attributes.lower()
        if "hidden" in low and (self.attribute("hidden") is not None or (self.tag == "input" and (self.attribute("type") or "").lower() == "hidden")):
            return True
        return "style" in low and bool(_HIDDEN_STYLE.search(self.attribute("style") or ""))


class _Open:
    """The open nodes, with what is needed to close one without a search in vain."""

    def __init__(self, root: Node):
        self.nodes, self.near = [root], [(-1,) * len(IMPLIED)]
        self.counts: list[Counter] = [Counter()]  # by tag, one for each open table and what is outside

    def push(self, node: Node) -> None:
        """near: for each implied rule the place of the node that it would close."""
        near, tag = self.near[-1], node.tag
        if tag in _OPENS or tag in _BARS:
            changed = list(near)
            for k in _BARS.get(tag, ()):
                changed[k] = -1
            for k in _OPENS.get(tag, ()):
                changed[k] = len(self.nodes)
            near = tuple(changed)
        self.counts[-1][tag] += 1
        if tag == "table":
            self.counts.append(Counter())
        self.nodes.append(node)
        self.near.append(near)

    def pop(self, place: int) -> None:
        """Close the node at the place and all above it."""
        while len(self.nodes) > place:
            self.near.pop()
            tag = self.nodes.pop().tag
            if tag == "table":
                self.counts.pop()
            self.counts[-1][tag] -= 1

    def close(self, tag: str) -> None:
        """A closing tag: the nearest open node of its name, inside the innermost table unless it is a table, body or html."""
        if tag in ("table", "body", "html") if not self.counts[-1][tag] else True:
            if self.counts[-1][tag] or any(c[tag] for c in self.counts):
                k = len(self.nodes) - 1
                while self.nodes[k].tag != tag:
                    k -= 1
                self.pop(k)


def parse(text: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    opened, at = _Open(root), 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if text[m.start()] != "<" or at - m.start() == 1:
                opened.nodes[-1].children.append(unescape(m[0]))
            continue
        tag = tag.lower()
        if m[1]:
            opened.close(tag)
            continue
        for k in _SETS_OFF.get(tag, ()):
            if opened.near[-1][k] >= 0:
                opened.pop(opened.near[-1][k])
        node = Node(tag, m[3])
        opened.nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I | re.ASCII).search(text, at)
            end = end.start() if end else len(text)
            node.children.append(text[at:end] if tag in ("script", "style", "xmp") else unescape(text[at:end]))
            close = text.find(">", end)
            at = len(text) if close < 0 else close + 1
        elif tag not in VOID:
            opened.push(node)
    return root


class Page:
    """Lines of visible text; a line begins when a block does. tables: how many it is inside of."""

    def __init__(self, tables: int = 0):
        self.lines: list[str] = []
        self.tables = tables
        self.parts, self.gap, self.indent, self.mark = [], False, "", ""

    def text(self, s: str) -> None:
        s = _BLANKS.sub(" ", s)
        if not self.parts:
            s = s.lstrip(" ")
        elif self.parts[-1].endswith(" ") and s.startswith(" "):
            s = s[1:]
        if s:
            self.parts.append(s)

    def end(self, gap: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        if line:
            self._push(self.indent + self.mark + line)
            if self.mark:
                self.deeper(len(self.mark))
                self.mark = ""
        self.parts = []
        self.gap |= gap and bool(self.lines)

    def deeper(self, n: int) -> None:
        if len(self.indent) + n <= INDENT:
            self.indent += " " * n

    def _push(self, line: str) -> None:
        if self.gap:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def verbatim(self, lines: list[str]) -> None:
        self.end()
        for x in lines:
            self._push(self.indent + x.rstrip())


def _all_text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif not x.hidden():
            todo += reversed(x.children)
    return "".join(out)


_PARTS = {"thead", "tbody", "tfoot", "colgroup"}


def _rows(table: Node) -> tuple[list[list[Node]], list]:
    """The cells of a table by rows, and what stands outside cells; cells without a row form one."""
    rows, loose, todo, bare = [], [], list(reversed(table.children)), None
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                loose.append(x)
        elif x.hidden():
            continue
        elif x.tag in ("td", "th"):
            if bare is None:
                rows.append(bare := [])
            bare.append(x)
        elif x.tag == "tr":
            bare = None
            cells = [c for c in x.children if not isinstance(c, str) and c.tag in ("td", "th")]
            rows.append([c for c in cells if not c.hidden()])
            loose += [c for c in x.children if (c.strip() if isinstance(c, str) else c not in cells)]
        elif x.tag in _PARTS:
            bare = None
            todo += reversed(x.children)
        else:
            loose.append(x)
    return rows, loose


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[dict[int, list[str]]]:
    """Rows of cells (lines, columns, rows that it spans) as rows of lines by column, where only columns count in which a cell begins."""
    grid, until = [], {}  # until: for columns taken from above, the first row that is free
    for r, row in enumerate(rows):
        until = {c: u for c, u in until.items() if u > r}
        at, line = 0, {}
        for lines, wide, high in row:
            while at in until:
                at += 1
            line[at] = lines
            if at + wide > COLUMNS:
                wide = high = 1
            if high > 1:
                until |= {c: r + high for c in range(at, at + wide)}
            at += wide
        grid.append(line)
    rank = {c: k for k, c in enumerate(sorted({c for line in grid for c in line}))}
    return [{rank[c]: lines for c, lines in line.items()} for line in grid]


def _folded(line: str) -> list[str]:
    """A line as lines of WIDTH at most, but for words that are longer."""
    if len(line) <= WIDTH:
        return [line]
    out, rest = [], line.rstrip(" ")
    while len(rest) > WIDTH:
        cut = rest.rfind(" ", 1, WIDTH + 1)
        if cut <= 0 or not rest[:cut].strip(" "):
            cut = rest.find(" ", len(rest) - len(rest.lstrip(" ")))
        if cut < 0:
            break
        out.append(rest[:cut].rstrip(" "))
        rest = rest[cut:].lstrip(" ")
    return [*out, rest]


def _aligned(grid: list[dict[int, list[str]]]) -> list[str]:
    """The rows' lines, with each cell that another follows folded and padded to its column."""
    widths: dict[int, int] = {}
    for row in grid:
        last = max(row, default=0)
        for c in row:
            if c != last:
                row[c] = [x for line in row[c] for x in _folded(line)]
            width = max((len(x) for x in row[c] if c != last and len(x) <= WIDTH), default=0)
            widths[c] = max(widths.get(c, 0), width)
    before = [0]
    for c in range(len(widths)):
        before.append(before[-1] + widths[c] + 2)
    out = []
    for row in grid:
        for i in range(max(map(len, row.values()), default=0)):
            parts, at = [], 0
            for c, own in row.items():
                if i >= len(own):
                    continue
                if at and before[c] < at + 2:  # a word beyond its column
                    out.append("".join(parts))
                    parts, at = [], 0
                parts += [" " * (before[c] - at), own[i]]
                at = before[c] + len(own[i])
            out.append("".join(parts))
    return out


def _table(page: Page, table: Node):
    rows, loose = _rows(table)
    for x in loose:  # a caption, and what has no cell, is shown before the rows
        yield from _child(page, x)
        page.end()
    cells = []
    for r, row in enumerate(rows):
        cells.append([])
        for c in row:
            inner = Page(page.tables + 1)
            for x in c.children:
                yield from _child(inner, x)
            inner.end()
            wide, high = c.number("colspan"), c.number("rowspan")
            high = len(rows) if high == 0 else min(max(1, high or 1), ROWS)
            cells[-1].append(([x for x in inner.lines if x], min(max(1, wide or 1), COLUMNS), min(high, len(rows) - r)))
    page.verbatim(_aligned(_placed(cells)))


def _child(page: Page, node):
    """What shows a child: text at once, a node as a walk of its own."""
    if isinstance(node, str):
        page.text(node)
    elif not node.hidden():
        yield _show(page, node)


def _show(page: Page, node: Node):
    """A walk that yields the walks of children to be made in its place."""
    tag = node.tag
    if tag == "br":
        page.end()
        return
    if tag == "img":
        page.text(unescape(node.attribute("alt") or ""))
        return
    if tag == "input":
        if (node.attribute("type") or "").lower() in ("submit", "button", "reset"):
            page.text(unescape(node.attribute("value") or ""))
        return
    block, spaced = tag in BLOCKS, tag in SPACED
    nested = tag in ("ul", "ol") and bool(page.indent or page.mark)
    if block:
        page.end(spaced and not nested)
    if tag == "table" and page.tables < TABLES:
        yield from _table(page, node)
    elif tag == "pre":
        page.verbatim(_all_text(node).removeprefix("\n").split("\n"))
    elif tag in ("ul", "ol", "menu"):
        start = node.number("start") if tag == "ol" else None
        number = 1 if start is None else start
        for c in node.children:
            if not isinstance(c, str) and c.tag == "li" and not c.hidden():
                page.end()
                indent, mark = page.indent, page.mark
                if mark:
                    page.deeper(len(mark))
                outer, page.mark = page.indent, f"{number}. " if tag == "ol" else "- "
                number += 1
                for x in c.children:
                    yield from _child(page, x)
                page.end()
                page.indent, page.mark = (outer if mark else indent), ""
            else:
                yield from _child(page, c)
    elif tag in ("blockquote", "dd"):
        indent = page.indent
        page.deeper(2)
        for x in node.children:
            yield from _child(page, x)
        page.end()
        page.indent = indent
    else:
        for x in node.children:
            yield from _child(page, x)
        if tag in ("td", "th"):
            page.end()
    if block:
        page.end(spaced and not nested)


def render(text: str | None) -> str:
    """All visible text of a page, laid out in lines."""
    page = Page()
    for x in parse(text or "").children:
        walks = [_child(page, x)]
        while walks:
            inner = next(walks[-1], None)
            if inner is None:
                walks.pop()
            else:
                walks.append(inner)
    page.end()
    return "\n".join(page.lines)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in slices(b, "html")):
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([render(h) for h in batch.column("html").to_pylist()], pa.string())], ["page_id", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id and text for each row of pages."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(_render, f"page_id {kind}, text string")
