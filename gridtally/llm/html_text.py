"""Visible text of HTML pages, laid out as a browser would place it.

A tree builder reads the tags, closes elements that a following tag implies to be closed
and opens none that are missing. A renderer walks the tree: it leaves out what is not
displayed, collapses white space except in ``pre``, starts blocks on lines of their own
with a blank line where they have margins, numbers or marks and indents list items, and
aligns the cells of tables in columns. Boilerplate is visible text, so it stays.

Not displayed: ``head``, scripts, styles, templates, fallback content of embedded media,
``noscript``, hidden inputs, a closed ``dialog``, the content of closed ``details`` but
its summary, options that are not chosen, elements with the attribute ``hidden`` unless
their style displays them, elements with ``display:none`` in their style or by the page's
style sheets, as these count on a wide screen (``style_sheets``). ``visibility:hidden`` is
undone by ``visibility:visible`` inside. Form fields and buttons show their ``value``, but
for hidden, password, checkbox, radio, file, image, range and color fields.

Cases: a NULL page has a NULL text, an empty one an empty text. Broken markup never
fails: a tag that does not end is text, end tags without a start are left out, and elements
may be nested to any depth. The pages are treated one by one, so ids
and repeated rows need nothing special. All input columns come back; a column ``text`` of
the input is replaced.
"""

from __future__ import annotations

import bisect
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from unicodedata import east_asian_width

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gridtally.llm import style_sheets

#: A cell wider than this does not widen its column; it runs over.
COLUMN_WIDTH = 60
INDENT = "    "

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"""|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^"'>=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")

# Fixed values of the HTML standard: element groups of the parser.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search "
    "section summary table ul li dd dt".split()
)
_HEAD_ONLY = set("base link meta title style script noscript template".split())

#: What an opening tag closes, and where the search for it ends.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
    "body": ({"head"}, set()),
}
_P_ENDS = {"td", "th", "caption", "table", "button", "object", "body"}
_END_STOPS = {"td", "th", "table", "body"}
_ENDS_ANYWHERE = {"table", "tr", "tbody", "body"}

# Fixed values of the HTML standard: how elements are displayed by default.
_NOT_SHOWN = set(
    "head script style template noscript title iframe object embed video audio canvas "
    "noembed noframes datalist param rp area base link meta".split()
)
_MARGINS = set(
    "p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre xmp table figure hr fieldset".split()
)
_BLOCKS = _MARGINS | set(
    "address article aside body center details dialog dd div dt figcaption footer form header "
    "hgroup html legend li main nav option optgroup search section summary tr caption".split()
)

_LISTS = {"ul", "ol", "menu", "dir"}

#: Kinds of input that show no text of theirs.
_NO_VALUE = set("hidden password checkbox radio file image range color".split())


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Element | None = None
    #: Whether styles display the element, and whether text right in it is visible.
    display: bool | None = None
    seen: bool | None = None
    places: tuple | None = None


def _attrs(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(source):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


class _Open:
    """The open elements, innermost last, with the places of each tag among them.

    Looking for a tag costs the same however deep the page is nested.
    """

    def __init__(self, root: Element):
        self.elements, self.places = [root], {root.tag: [0]}
        self.depth = 1

    @property
    def last(self) -> Element:
        return self.elements[-1]

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.elements))
        self.elements.append(element)
        self.depth = max(self.depth, len(self.elements))

    def end_from(self, place: int) -> None:
        while len(self.elements) > place:
            self.places[self.elements.pop().tag].pop()

    def innermost(self, tags: Iterable[str]) -> int:
        """The place of the innermost element of these tags but the root; 0 if there is none."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=0)

    def close(self, tags: set[str], stops: set[str]) -> None:
        """Ends the outermost open element of ``tags`` above the innermost of ``stops``."""
        above = self.innermost(stops)
        found = []
        for tag in tags:
            places = self.places.get(tag, [])
            at = bisect.bisect_right(places, above)
            found += places[at : at + 1]
        if found:
            self.end_from(min(found))

    def end_tag(self, tag: str) -> None:
        """Ends the innermost element of a tag, unless a cell, table or body stands between."""
        place = self.innermost([tag])
        if place and (tag in _ENDS_ANYWHERE or place >= self.innermost(_END_STOPS)):
            self.end_from(place)


def parse(html: str) -> tuple[Element, list[str], int]:
    """The tree of a page, its style sheets and how deep it is nested."""
    root = Element("html")
    stack, styles, at, end = _Open(root), [], 0, len(html)

    def leave_head() -> None:
        if stack.last.tag == "head":
            stack.end_from(len(stack.elements) - 1)

    def text(part: str) -> None:
        if part:
            if part.strip(" \t\n\r\f"):
                leave_head()
            stack.last.children.append(unescape(part) if "&" in part else part)

    while at < end:
        token = _TOKEN.search(html, at)
        if token is None:
            text(html[at:])
            break
        text(html[at : token.start()])
        at = token.end()
        if closing := token["end"]:
            tag = closing.lower()
            stack.end_tag(tag)
            if tag == "br":
                stack.last.children.append(Element("br"))
            continue
        if not token["start"]:
            continue
        tag = token["start"].lower()
        if tag in ("html", "head") and len(stack.elements) > 1 or tag == "html":
            if tag == "html" and token["attrs"]:
                root.attrs = _attrs(token["attrs"]) | root.attrs
            continue
        if tag not in _HEAD_ONLY:
            leave_head()
        if tag in _CLOSES_P:
            stack.close({"p"}, _P_ENDS)
        if tag in _IMPLIED:
            stack.close(*_IMPLIED[tag])
        element = Element(tag, _attrs(token["attrs"]) if token["attrs"] else {})
        stack.last.children.append(element)
        if tag in _RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            content = html[at : stop.start() if stop else end]
            if tag == "style":
                if _applies(element) and not stack.innermost(("noscript", "template")):
                    styles.append(content)
            elif tag in ("textarea", "title"):
                element.children.append(unescape(content))
            elif tag == "xmp":
                element.children.append(content)
            at = html.find(">", stop.start()) + 1 or end if stop else end
        elif tag not in _VOID:
            stack.push(element)
    return root, styles, stack.depth


def _applies(style: Element) -> bool:
    media = style.attrs.get("media", "").strip()
    kind = style.attrs.get("type", "").strip().lower()
    return kind in ("", "text/css") and (not media or style_sheets.media(media))


def _styled(root: Element, styles: list[str]) -> None:
    """Sets what the styles make of each element; below hidden ones nothing is set."""
    sheet = style_sheets.Sheet(styles)
    # The body that a page leaves out.
    body = Element("body", parent=root, children=root.children)
    below = [(root, True)]
    while below:
        element, seen = below.pop()
        element.display, visible = sheet.of(element)
        element.seen = seen if visible is None else visible
        if element.display is False:
            continue
        inner = element
        if element is root and all(isinstance(c, str) or c.tag != "body" for c in root.children):
            body.display, visible = sheet.of(body)
            if body.display is False:
                root.children = [c for c in root.children if isinstance(c, Element) and c.tag == "head"]
            element.seen = element.seen if visible is None else visible
            inner = body
        rows = Element("tbody", parent=element, children=element.children)
        for child in element.children:
            if isinstance(child, Element):
                child.parent = rows if child.tag == "tr" and element.tag == "table" else inner
                below.append((child, element.seen))


def _width(line: str) -> int:
    return len(line) if line.isascii() else sum(1 + (east_asian_width(c) in "WF") for c in line)


class _Page:
    """Lines of text as they are written from top to bottom."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        #: Whether the next word is set off by a blank, and the next line by a blank line.
        self.space = self.margin = False

    def word_run(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words and self.line)
            return
        if self.line and (self.space or words[0] == " "):
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def kept(self, text: str) -> None:
        first, *more = text.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for line in more:
            self.end_line(True)
            self.line.append(line)

    def end_line(self, always: bool = False) -> None:
        line = "".join(self.line)
        self.line, self.space = [], False
        if line or always:
            if self.margin and self.lines:
                self.lines.append("")
            self.margin = False
            self.lines.append(line.rstrip(" "))

    def block(self, margin: bool) -> None:
        self.end_line()
        self.margin = self.margin or margin

    def put(self, lines: list[str], first: str = "", others: str = "") -> None:
        """Lines of a block rendered apart."""
        self.end_line()
        for at, line in enumerate(lines):
            self.line.append((first if at == 0 else others) + line if line or at == 0 else "")
            self.end_line(True)


def _integer(text: str | None, default: int) -> int:
    match = re.match(r"\s*([+-]?[0-9]{1,9})", text or "")
    return int(match[1]) if match else default


class _Renderer:
    def __init__(self):
        #: How many lists the current element is in; inner lists have no margins.
        self.lists = 0

    def lines(self, element: Element, seen: bool, pre: bool) -> list[str]:
        """The content of an element on a page of its own."""
        page = _Page()
        self.content(element, page, seen, pre)
        page.end_line()
        while page.lines and not page.lines[-1]:
            page.lines.pop()
        return page.lines

    def shown(self, element: Element) -> bool:
        tag, attrs = element.tag, element.attrs
        if tag in _NOT_SHOWN:
            return False
        if tag == "input" and attrs.get("type", "").strip().lower() in _NO_VALUE:
            return False
        if element.display is not None:
            return element.display
        return not ("hidden" in attrs or tag == "dialog" and "open" not in attrs)

    def content(self, element: Element, page: _Page, seen: bool, pre: bool) -> None:
        seen = seen if element.seen is None else element.seen
        for child in element.children:
            if isinstance(child, str):
                if seen:
                    page.kept(child) if pre else page.word_run(child)
            else:
                self.element(child, page, seen, pre)

    def element(self, element: Element, page: _Page, seen: bool, pre: bool) -> None:
        if not self.shown(element):
            return
        tag = element.tag
        seen = seen if element.seen is None else element.seen
        if tag == "br":
            page.end_line(True)
            return
        if tag == "wbr":
            return
        if tag == "input":
            if seen and (value := element.attrs.get("value")):
                page.word_run(f" {value} ")
            return
        block, margin = tag in _BLOCKS, tag in _MARGINS and not (tag in _LISTS and self.lists)
        if block:
            page.block(margin)
        if tag in ("pre", "xmp", "textarea"):
            # A line break right behind the start tag does not count.
            if element.children and isinstance(element.children[0], str):
                head = element.children[0].removeprefix("\r").removeprefix("\n")
                element.children[0] = head
            self.content(element, page, seen, True)
        elif tag == "table":
            page.put(self.table(element, seen, pre))
        elif tag in _LISTS:
            self.lists += 1
            self.items(element, page, seen, pre)
            self.lists -= 1
        elif tag == "li":
            page.put(self.lines(element, seen, pre), "- ", "  ")
        elif tag in ("blockquote", "dd"):
            page.put(self.lines(element, seen, pre), INDENT, INDENT)
        elif tag == "select":
            self.chosen(element, page, seen)
        elif tag == "details" and "open" not in element.attrs:
            summary = [c for c in element.children if isinstance(c, Element) and c.tag == "summary"]
            self.content(Element(tag, {}, summary[:1]), page, seen, pre)
        elif tag in ("td", "th"):
            # A cell outside a table is inline text.
            page.word_run(" ")
            self.content(element, page, seen, pre)
            page.word_run(" ")
        else:
            self.content(element, page, seen, pre)
        if block:
            page.block(margin)

    def items(self, element: Element, page: _Page, seen: bool, pre: bool) -> None:
        number = _integer(element.attrs.get("start"), 1)
        for child in element.children:
            if isinstance(child, str) or child.tag != "li":
                self.content(Element("div", {}, [child]), page, seen, pre)
                continue
            if not self.shown(child):
                continue
            mark = "- "
            if element.tag == "ol":
                number = _integer(child.attrs.get("value"), number)
                mark, number = f"{number}. ", number + 1
            lines = self.lines(child, seen, pre)
            if lines:
                page.put(lines, mark, " " * len(mark))

    def chosen(self, element: Element, page: _Page, seen: bool) -> None:
        options, below = [], list(reversed(element.children))
        while below:
            child = below.pop()
            if isinstance(child, Element):
                if child.tag == "option":
                    options.append(child)
                else:
                    below += reversed(child.children)
        picked = [o for o in options if "selected" in o.attrs] or options[:1]
        for option in picked:
            page.word_run(" ")
            self.content(option, page, seen, False)
            page.word_run(" ")

    def rows(self, table: Element) -> Iterator[Element]:
        """The rows of a table; cells, and other content, without a row make one."""
        loose: list = []
        for child in table.children:
            if isinstance(child, str):
                if child.strip(" \t\n\r\f"):
                    loose.append(child)
                continue
            if child.tag in ("tr", "thead", "tbody", "tfoot", "caption", "colgroup", "col"):
                if loose:
                    yield Element("tr", {}, loose)
                    loose = []
                if not self.shown(child) or child.tag in ("colgroup", "col"):
                    continue
                if child.tag in ("tr", "caption"):
                    yield child
                else:
                    yield from self.rows(child)
            else:
                loose.append(child)
        if loose:
            yield Element("tr", {}, loose)

    def table(self, table: Element, seen: bool, pre: bool) -> list[str]:
        caption, grid, taken = [], [], {}
        for row in self.rows(table):
            if row.tag == "caption":
                caption += self.lines(row, seen, pre)
                continue
            cells, column = [], 0
            row_seen = seen if row.seen is None else row.seen
            for cell in row.children:
                if isinstance(cell, str):
                    if not cell.strip(" \t\n\r\f"):
                        continue
                    cell = Element("td", {}, [cell])
                elif not self.shown(cell):
                    continue
                elif cell.tag not in ("td", "th"):
                    cell = Element("td", {}, [cell])
                while taken.get(column, 0) > 0:
                    column += 1
                # The limits of the standard.
                across = min(max(_integer(cell.attrs.get("colspan"), 1), 1), 1000)
                down = min(max(_integer(cell.attrs.get("rowspan"), 1), 1), 65534)
                cells.append((column, across, self.lines(cell, row_seen, pre)))
                for at in range(column, column + across):
                    taken[at] = max(taken.get(at, 0), down)
                column += across
            taken = {at: rows - 1 for at, rows in taken.items() if rows > 1}
            grid.append(cells)
        widths: dict[int, int] = {}
        for column, across, lines in (cell for cells in grid for cell in cells):
            if across == 1:
                wide = max((w for w in map(_width, lines) if w <= COLUMN_WIDTH), default=0)
                widths[column] = max(widths.get(column, 0), wide)
        starts, place = {}, 0
        for column in range(max(widths, default=-1) + 1):
            starts[column] = place
            place += widths[column] + 2 if widths.get(column) else 0
        out = list(caption)
        for cells in grid:
            for at in range(max((len(lines) for _, _, lines in cells), default=0)):
                line, used = "", 0
                for column, _, lines in cells:
                    if at < len(lines) and lines[at]:
                        gap = max(starts.get(column, place) - used, 2 if line else 0)
                        line += " " * gap + lines[at]
                        used += gap + _width(lines[at])
                out.append(line)
        return out


def visible_text(html: str) -> str:
    """The visible text of a page, without blank lines at its ends."""
    root, styles, depth = parse(html)
    _styled(root, styles)
    # Rendering an element takes a few calls inside those of its parent.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * depth + 1_000))
    lines = _Renderer().lines(root, True, False) if root.display is not False else []
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """The pages with their visible ``text``."""

    @F.pandas_udf(StringType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(visible_text, na_action="ignore")

    return pages.withColumn("text", of(F.col("html")))
