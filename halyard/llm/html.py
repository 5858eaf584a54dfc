"""HTML extraction: a tree with implied tags, rendered to plain text with its layout.

All visible text is kept, in order: blocks on lines of their own with blank lines where margins are, list items
behind bullets or numbers, table cells in aligned columns (of rows and columns spanned too), preformatted text as it
stands, text of drawings and formulas.  What a browser doesn't show (head, scripts, styles, templates, ``hidden``,
``display:none``, ``visibility:hidden`` but for its visible descendants, comments) is left out.  Nothing recurses, so nesting may
be of any depth, and reading a page takes time in proportion to its length, whatever is left open in it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What can end a start tag, or open a value that hides its end.
_EDGE = re.compile(r""">|=[ \t\n\r\f]*(["'])""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes object audio video canvas datalist annotation annotation-xml desc defs metadata symbol marker clippath".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table text ul xmp".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu xmp".split())
CLOSES_P = (BLOCK - {"body", "html", "optgroup", "option", "legend"}) | {"tr", "td", "th"}
#: Start tag -> (elements it ends, elements beyond which it doesn't look).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"body"}),
}
#: An end tag doesn't reach beyond these, unless it is their own.
SCOPE = frozenset({"table", "td", "th", "caption", "template"})


class Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Scanner:
    """Finds the ends of start tags.

    A tag ends at the first ``>`` outside of its quoted values.  Scans that came to the end of the page without one are
    remembered by the values they passed over: a later tag that begins outside of these would go the same way.  Two such
    scans never agree about a place, so there are no more of them than states (outside, and either quote).
    """

    def __init__(self, html: str):
        self.html, self.last, self.failed = html, html.rfind(">"), []

    def end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends, or -1."""
        if at > self.last:
            return -1
        for begins, ends in self.failed:
            k = bisect_right(begins, at) - 1
            if k < 0 or ends[k] <= at:
                return -1
        begins, ends, here = [], [], at
        while m := _EDGE.search(self.html, here):
            if not m[1]:
                return m.start()
            close = self.html.find(m[1], m.end())
            begins.append(m.end())
            ends.append(len(self.html) if close < 0 else close + 1)
            if close < 0:
                break
            here = close + 1
        self.failed.append((begins, ends))
        return -1


def parse(html: str) -> Element:
    """The tree of a page: elements and strings below a root.  What looks like a tag but never ends is text."""
    root = Element("#root", {})
    stack = [root]
    where: dict[str, list[int]] = {}  # depths of the open elements of a tag, ascending
    scanner = Scanner(html)
    last = scanner.last

    def push(e: Element) -> None:
        where.setdefault(e.tag, []).append(len(stack))
        stack.append(e)

    def close(depth: int) -> None:
        while len(stack) > depth:
            where[stack.pop().tag].pop()

    def innermost(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def imply(ends, limits) -> None:
        """End the outermost element of ``ends`` that lies within the innermost of ``limits``."""
        limit = innermost(limits)
        found = [d[k] for t in ends if (d := where.get(t)) and (k := bisect_right(d, limit)) < len(d)]
        if found:
            close(min(found))

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(unescape(s) if "&" in s else s)

    at = begin = 0  # text from begin on waits to be written
    while (at := html.find("<", at)) >= 0:
        after = html[at + 1 : at + 2]
        closing = after == "/"
        name = _NAME.match(html, at + 1 + closing)
        if html.startswith("<!--", at):
            text(html[begin:at])
            empty = re.compile(r"<!--(-?>)").match(html, at)
            end = -1 if empty else html.find("-->", at + 4)
            at = begin = empty.end() if empty else len(html) if end < 0 else end + 3
            continue
        if after in ("!", "?") or (closing and not name):
            if at > last or (closing and html[at + 2 : at + 3] in ("", " ")):
                at += 1
                continue
            text(html[begin:at])
            at = begin = html.index(">", at) + 1
            continue
        end = -1 if not name or at > last else html.index(">", name.end()) if closing and name.end() <= last else -1 if closing else scanner.end(name.end())
        if end < 0:
            at += 1
            continue
        text(html[begin:at])
        at = begin = end + 1
        tag = name[0].lower()
        if closing:
            if tag == "br":
                stack[-1].children.append(Element("br", {}))
            elif where.get(tag):
                depth = where[tag][-1]
                if tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot") or depth > innermost(SCOPE):
                    close(depth)
            elif tag == "p":
                stack[-1].children.append(Element("p", {}))
            continue
        attrs: dict[str, str] = {}
        for key, a, b, c in _ATTR.findall(html, name.end(), end):
            attrs.setdefault(key.lower(), unescape(a or b or c))
        if tag in CLOSES_P and where.get("p"):
            imply({"p"}, SCOPE | {"button"})
        if tag in IMPLIED:
            imply(*IMPLIED[tag])
        elif where.get("head") and tag not in UNSEEN and tag not in ("meta", "link", "base", "noscript", "html"):
            imply({"head"}, {"body"})
        if tag in ("td", "th") and stack[-1].tag != "tr" and where.get("table"):
            row = Element("tr", {})
            stack[-1].children.append(row)
            push(row)
        element = Element(tag, attrs)
        stack[-1].children.append(element)
        if tag in RAW:
            ended = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at, max(at, last + 1))
            body = html[at : ended.start() if ended else len(html)]
            if body:
                element.children.append(unescape(body) if tag in ("title", "textarea") else body)
            at = begin = html.index(">", ended.end()) + 1 if ended else len(html)
        elif tag not in VOID:
            push(element)
    text(html[begin:])
    return root


def shown(e: Element) -> bool:
    """Whether an element is laid out at all."""
    if e.tag in UNSEEN or "hidden" in e.attrs or (e.tag == "dialog" and "open" not in e.attrs):
        return False
    return not ("style" in e.attrs and _NO_DISPLAY.search(e.attrs["style"]))


def visibility(e: Element, inherited: bool) -> bool:
    """Whether what an element holds is seen: by its own style, or as around it."""
    found = _VISIBILITY.findall(e.attrs["style"]) if "style" in e.attrs else None
    return found[-1].lower() == "visible" if found else inherited


class Page:
    """Lines of one flow: the page's, or a table cell's."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.margin = False
        self.indent, self.bullet = "", None

    def write(self, s: str, pre: bool) -> None:
        if pre:
            head, *rest = s.replace("\r\n", "\n").split("\n")
            if head:
                self.put(head)
            for line in rest:
                self.line(True)
                if line:
                    self.put(line)
            return
        flat = _SPACE.sub(" ", s)
        if flat == " ":
            self.space = bool(self.now)
            return
        if flat.startswith(" "):
            self.space = bool(self.now)
            flat = flat[1:]
        tail = flat.endswith(" ")
        if flat := flat[:-1] if tail else flat:
            self.put(flat)
        self.space = tail

    def put(self, s: str) -> None:
        if self.space and self.now:
            self.now.append(" ")
        self.space = False
        self.now.append(s)

    def line(self, even_empty: bool = False) -> None:
        if not self.now and not even_empty:
            return
        if self.margin and self.lines:
            self.lines.append("")
        head = self.indent if self.bullet is None else self.bullet
        self.lines.append((head + "".join(self.now)).rstrip())
        self.now, self.space, self.margin, self.bullet = [], False, False, None

    def text(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[list[str], int, int]]]:
    """Cells (lines, columns spanned, rows spanned) as (lines, column, columns spanned), below those that span their row.

    Columns in which no cell begins are left out.
    """
    taken: dict[int, int] = {}  # column -> rows for which a cell from above is still there
    placed, starts = [], set()
    for row in rows:
        c, out, below = 0, [], {}
        for lines, span, down in row:
            while taken.get(c):
                c += 1
            out.append((lines, c, span))
            starts.add(c)
            if down != 1:
                below.update(dict.fromkeys(range(c, c + span), down - 1 if down else len(rows)))
            c += span
        taken = {k: n - 1 for k, n in taken.items() if n > 1} | below
        placed.append(out)
    order = sorted(starts)
    return [[(lines, bisect_left(order, c), bisect_left(order, c + span) - bisect_left(order, c)) for lines, c, span in row] for row in placed]


def columns(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells as lines with aligned columns, two blanks apart."""
    if len(rows) == 1 and len(rows[0]) == 1:
        return rows[0][0][0] or [""]
    placed = grid(rows)
    widths = [0] * max((c + span for row in placed for _, c, span in row), default=0)
    for row in placed:
        for lines, c, span in row:
            if span == 1:
                widths[c] = max([widths[c], *map(len, lines)])
    for row in placed:  # what spans columns widens the last of them
        for lines, c, span in row:
            if span > 1:
                room = sum(widths[c : c + span]) + 2 * (span - 1)
                widths[c + span - 1] += max(0, max(map(len, lines), default=0) - room)
    before = [0]
    for w in widths:
        before.append(before[-1] + w + 2)
    out = []
    for row in placed:
        for k in range(max([1, *(len(lines) for lines, _, _ in row)]) if row else 0):
            line = []
            size = 0
            for lines, c, _ in row:
                if k < len(lines) and lines[k]:
                    line += [" " * (before[c] - size), lines[k]]
                    size = before[c] + len(lines[k])
            out.append("".join(line).rstrip())
    return out


def spanned(e: Element, name: str, most: int) -> int:
    value = e.attrs.get(name, "1").strip()
    return min(most, int(value)) if value.isascii() and value.isdecimal() and len(value) < 10 else 1


def render(html: str | None) -> str:
    """The visible text of a page; empty for null."""
    if not html:
        return ""
    page = Page()
    outer: list[tuple] = []  # what stands outside of the table or cell at hand
    rows: list[list] | None = None
    lists: list[list] = []  # [next number or None, indent before]
    pre = 0
    todo: list = [(parse(html), False, True)]
    while todo:
        node, leaving, seen = todo.pop()
        if isinstance(node, str):
            if seen and (rows is None or node.strip()):
                page.write(node, pre > 0)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th") and outer and outer[-1][0] == "cell":
                lines = page.text()
                _, page, rows, lists, pre = outer.pop()
                rows[-1].append((lines, max(1, spanned(node, "colspan", 1000)), spanned(node, "rowspan", 65534)))
            elif tag == "table" and outer and outer[-1][0] == "table":
                made = columns(rows)
                _, rows = outer.pop()
                page.line()
                for x in made:
                    page.now = [x] if x else []
                    page.line(True)
            elif tag in ("ul", "ol", "menu", "dir") and lists:
                page.line()
                page.indent = lists.pop()[1]
            elif tag in ("li", "dd", "blockquote"):
                page.line()
                page.bullet, page.indent = None, node.attrs["#indent"]
            elif tag in ("pre", "xmp", "textarea"):
                pre -= 1
            if tag in BLOCK:
                page.line()
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                page.margin = True
            continue
        if not shown(node):
            continue
        seen = visibility(node, seen)
        if tag == "br":
            page.line(True)
            continue
        if tag == "input":
            if seen and node.attrs.get("type", "").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
                page.write(node.attrs["value"], False)
            continue
        if tag in BLOCK:
            page.line()
        if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
            page.margin = True
        if tag in ("td", "th") and rows is not None:
            if not rows:
                rows.append([])
            outer.append(("cell", page, rows, lists, pre))
            page, rows, lists, pre = Page(), None, [], 0
        elif tag == "table":
            outer.append(("table", rows))
            rows = []
        elif tag == "tr" and rows is not None:
            rows.append([])
        elif tag in ("ul", "ol", "menu", "dir"):
            start = node.attrs.get("start", "1")
            lists.append([(int(start) if start.isdecimal() else 1) if tag == "ol" else None, page.indent])
        elif tag == "li":
            node.attrs["#indent"] = page.indent
            number = lists[-1][0] if lists else None
            mark = "- " if number is None else f"{number}. "
            if number is not None:
                lists[-1][0] += 1
            page.bullet, page.indent = page.indent + mark if seen else None, page.indent + " " * len(mark)
        elif tag in ("dd", "blockquote"):
            node.attrs["#indent"] = page.indent
            page.indent += "    "
        elif tag in ("pre", "xmp", "textarea"):
            pre += 1
        todo.append((node, True, seen))
        todo.extend((c, False, seen) for c in reversed(node.children))
    return "\n".join(page.text())


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "html", 8 << 20):
        texts = [render(h) for h in rows.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [rows.column("page_id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())],
            names=["page_id", "text", "n_chars", "text_sha256"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and text_sha256 of every row; null html gives empty text, and ids may be null or repeat."""
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "html").mapInArrow(extract_batches, f"page_id {kind}, text string, n_chars long, text_sha256 string")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages, with its layout."""
    return extract(table(spark, sf_dir, "pages"))
