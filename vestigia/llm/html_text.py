"""Text of web pages as it would be laid out.

A tokenizer and a tree builder with implied tags (``li``, ``p``, ``td``, ``tr``,
``option`` and the like end each other) feed a renderer: what is not visible (head,
scripts, styles, ``hidden``, ``display:none``, ``visibility:hidden``) is left out, all
visible text is kept, blocks stand on lines of their own with blank lines around
paragraphs and headings, list items carry bullets or numbers by depth, and the cells of
a table are padded to the widest of their column.

Defined cases: null and empty pages give an empty text; unclosed and stray tags, broken
attributes and unknown entities never fail; nesting of any depth is handled without
recursion (tables within tables recurse, and those nested deeper than Python allows are
rendered as plain blocks); ``visibility:visible`` shows what a hidden ancestor hides,
nothing shows what ``display:none`` or ``hidden`` takes away; cells that span columns or
rows keep the others in their columns; repeated rows are rendered each for itself.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables within tables, beyond which they are blocks; what a cell may span by the standard.
NESTED, MOST_COLUMNS, MOST_ROWS = 60, 1000, 65534
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noframes", "xmp"}
UNSEEN = {"head", "script", "style", "template", "noscript", "title", "iframe", "object", "svg", "datalist", "noframes"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
APART = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "hr"}
#: What a start tag closes, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCK - {"li", "dd", "dt", "tr", "tbody", "tfoot", "thead", "html", "body", "caption", "legend", "summary"}
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "children", "hidden", "attributes", "shown")

    def __init__(self, tag: str, hidden: bool = False, attributes: dict[str, str] | None = None, shown: bool = True):
        self.tag, self.children, self.hidden, self.attributes, self.shown = tag, [], hidden, attributes or {}, shown


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _hidden(tag: str, attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").lower().replace(" ", "")
    return tag in UNSEEN or "hidden" in attributes or "display:none" in style or tag == "input" and attributes.get("type", "").lower() == "hidden"


def _shown(parent: Node, attributes: dict[str, str]) -> bool:
    """Visibility, which is inherited until an element sets it anew."""
    found = re.findall(r"visibility:(hidden|collapse|visible)", attributes.get("style", "").lower().replace(" ", ""))
    return found[-1] == "visible" if found else parent.shown


def tree(page: str) -> Node:
    root = Node("#root")
    open_ = [root]
    counts: Counter = Counter()  # of open tags, so that looking for one that isn't there costs nothing
    at = 0

    def close(i: int) -> None:
        counts.subtract(n.tag for n in open_[i:])
        del open_[i:]

    def text(raw: str) -> None:
        if raw and open_[-1].shown:
            open_[-1].children.append(entities.unescape(raw))

    last = page.rfind(">") + 1  # beyond it nothing can be a tag
    while m := TOKEN.search(page, at, last):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(open_) - 1, 0, -1) if counts[tag] else ():
                if open_[i].tag == tag:
                    close(i)
                    break
                if open_[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag in CLOSES:
            closed, limit = CLOSES[tag]
            for i in range(len(open_) - 1, 0, -1) if any(counts[t] for t in closed) else ():
                if open_[i].tag in limit:
                    break
                if open_[i].tag in closed:
                    close(i)
                    if not any(counts[t] for t in closed):
                        break
        if tag in ENDS_P and counts["p"]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == "p":
                    close(i)
                    break
                if open_[i].tag in ("table", "td", "th", "button"):
                    break
        attributes = _attributes(m[3])
        node = Node(tag, _hidden(tag, attributes), attributes, _shown(open_[-1], attributes))
        open_[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if node.shown:
                node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            open_.append(node)
            counts[tag] += 1
    text(page[at:])
    return root


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Layout:
    """Lines as they come, with the blank lines still owed."""

    def __init__(self):
        self.lines, self.line, self.owed, self.mark = [], "", 0, ""

    def write(self, text: str, kept: bool = False) -> None:
        if kept:
            first, *rest = text.split("\n")
            self.line += first
            for x in rest:
                self.end(force=True)
                self.line = x
            return
        text = SPACE.sub(" ", text)
        if not self.line or self.line.endswith(" "):
            text = text.lstrip(" ")
        self.line += text

    def end(self, force: bool = False) -> None:
        line = self.line.rstrip(" ")
        self.line = ""
        if line or force:
            if self.lines and self.owed:
                self.lines += [""] * self.owed
            self.owed = 0
            self.lines.append(line)

    def item(self, mark: str) -> None:
        """Begins a list item; its first block stays on the line of the mark."""
        self.end()
        self.line = self.mark = mark

    def block(self, apart: bool) -> None:
        if self.mark and self.line == self.mark:
            return
        self.mark = ""
        self.end()
        if apart:
            self.owed = 1

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines)


def _holds_cells(node: Node) -> bool:
    todo = [node]
    while todo:
        for x in todo.pop().children:
            if isinstance(x, Node) and not x.hidden and x.tag != "table":
                if x.tag in ("td", "th", "tr"):
                    return True
                todo.append(x)
    return False


def _rows(table: Node) -> tuple[list[list[Node]], list[object]]:
    """The cells by row, cells outside a row in an implied one, and whatever else is visible in the table."""
    rows: list[list[Node]] = []
    stray: list[object] = []
    # Entries: children to come, the row that cells go to, whether a tr made it.
    todo = [(iter(table.children), None, False)]
    while todo:
        children, row, given = todo[-1]
        x = next(children, None)
        if x is None:
            todo.pop()
        elif isinstance(x, str):
            if x.strip():
                stray.append(x)
        elif x.hidden:
            continue
        elif x.tag in ("td", "th"):
            if row is None:
                row = []
                rows.append(row)
                todo[-1] = (children, row, given)
            row.append(x)
        elif x.tag == "tr":
            rows.append([])
            todo[-1] = (children, row if given else None, given)
            todo.append((iter(x.children), rows[-1], True))
        elif x.tag in ("tbody", "thead", "tfoot", "colgroup"):
            todo[-1] = (children, row if given else None, given)
            todo.append((iter(x.children), None, False))
        elif x.tag != "table" and _holds_cells(x):
            todo.append((iter(x.children), row, given))
        else:
            stray.append(x)
    return rows, stray


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attributes.get(name, "")
    return min(int(value), most) if re.fullmatch("[0-9]{1,9}", value) and int(value) else 1


def _aligned(rows: list[list[Node]], depth: int) -> list[str]:
    """Lines of a table: every cell begins at its column, cells that reach down leave their column empty."""
    grid, widths, taken = [], Counter(), {}  # taken: rows that a column is still held for
    for row in rows:
        placed, column, after = [], 0, {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row:
            while taken.get(column, 0):
                column += 1
            columns, down = _span(cell, "colspan", MOST_COLUMNS), _span(cell, "rowspan", MOST_ROWS)
            text = render_cell(cell, depth).split("\n")
            placed.append((column, columns, text))
            if down > 1:
                after |= {c: max(after.get(c, 0), down - 1) for c in range(column, column + columns)}
            if columns == 1:
                widths[column] = max(widths[column], *(_width(x) for x in text))
            column += columns
        grid.append(placed)
        taken = after
    for placed in grid:
        for column, columns, text in placed:
            lacking = max(_width(x) for x in text) - sum(widths[c] for c in range(column, column + columns)) - 2 * (columns - 1)
            if columns > 1 and lacking > 0:
                widths[column + columns - 1] += lacking
    starts, at = {}, 0
    for c in range(max((column + columns for placed in grid for column, columns, _ in placed), default=0)):
        starts[c] = at
        at += widths[c] + 2
    lines = []
    for placed in grid:
        for k in range(max((len(text) for *_, text in placed), default=0)):
            line, reached = [], 0
            for column, _, text in placed:
                piece = text[k] if k < len(text) else ""
                if piece:
                    line.append(" " * (starts[column] - reached) + piece)
                    reached = starts[column] + _width(piece)
            lines.append("".join(line))
    return lines


def render(root: Node, depth: int = 0) -> str:
    """All visible text below a node, laid out; ``depth`` counts the tables around it."""
    out = Layout()
    lists: list[list] = []
    pre = 0
    # Entries: (node, False) to enter, (node, True) to leave.
    todo: list[tuple[object, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            out.write(node, kept=pre > 0)
            continue
        tag = node.tag
        if leaving:
            if tag == "pre":
                pre -= 1
            if tag in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            if tag == "q":
                out.write('"')
            if tag in BLOCK:
                out.block(tag in APART and not (tag in ("ul", "ol") and lists))
            continue
        if node.hidden:
            continue
        if tag == "br":
            out.end(force=True)
        elif tag == "hr":
            out.block(True)
        elif tag == "img" and node.shown:
            out.write(node.attributes.get("alt", ""))
        elif tag == "input" and node.shown:
            out.write(node.attributes.get("value", "") + " ")
        elif tag == "table" and depth < NESTED and (parts := _rows(node))[0]:
            rows, stray = parts
            out.block(True)
            # What is outside cells comes first, as browsers put it.
            for x in stray:
                if text := (x if isinstance(x, str) else render(x, depth + 1)).strip():
                    out.write(text + "\n", kept=True)
                    out.end()
            for line in _aligned(rows, depth + 1):
                out.line = line
                out.end(force=True)
            out.block(True)
        else:
            if tag in BLOCK:
                out.block(tag in APART and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attributes.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif tag == "li":
                numbered = lists[-1] if lists else [False, 1]
                if node.shown:
                    out.item("  " * max(0, len(lists) - 1) + (f"{numbered[1]}. " if numbered[0] else "- "))
                numbered[1] += 1
            elif tag == "q":
                out.write('"')
            elif tag == "pre":
                pre += 1
            todo.append((node, True))
            todo += [(c, False) for c in reversed(node.children)]
    return out.text()


def render_cell(cell: Node, depth: int = 0) -> str:
    inner = Node("#cell")
    inner.children = cell.children
    return render(inner, depth).strip()


def extract(page: str | None) -> str:
    return render(tree(page)) if page else ""


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: the id and ``text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([extract(h.as_py()) for h in batch.column(1)], pa.string())], [id_col, "text"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), html_col).mapInArrow(work, f"{id_col} long, text string")
