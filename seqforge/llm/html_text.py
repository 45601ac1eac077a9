"""HTML extraction by layout: a tree builder with implied tags feeds a renderer
that knows visibility, blocks, lists and tables.

The builder turns any input into balanced open and close events (it never
fails on broken markup); the renderer keeps one text buffer per table cell, so
cells can be aligned when their table closes.  Neither recurses, so nesting is
limited by memory only.  Each page is a row of its own: no shuffle.

Time and text stay in proportion to the page, whatever it nests: open elements
are found by name, not by a walk up the stack; a column is only as wide as its
cells up to WIDE characters (wider ones are set without padding); a row that
would be mostly blanks has its cells one below another; tables nested deeper
than NESTED are set as blocks, lists are indented up to INDENT levels.  None of
these bounds drops any text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seqforge.llm import common as C

MARKUP = r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"""
QUOTED = r"""|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
LOOSE = r"""|<(?P<loose>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)(?:>|\Z)"""
TAG, LOOSE_TAG = re.compile(MARKUP + QUOTED + LOOSE, re.S), re.compile(MARKUP + LOOSE + r"|(?P<start>(?!))(?P<attrs>)", re.S)
#: Tags whose quotes never close, each read to the end of the page in vain, after which tags end at the first ``>``.
UNCLOSED = 64
#: Characters up to which a cell counts for the width of its column; padded
#: characters of a row for each of its own characters and cells; tables inside
#: one another that are aligned; levels of list indent.
WIDE, FILL, NESTED, INDENT = 80, 100, 16, 16
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLANK = re.compile(r"[ \t\n\f\r]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*([a-z]+)", re.I)
VISIBLE = {"hidden": False, "collapse": False, "visible": True, "initial": True}

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style iframe noembed noframes noscript xmp title textarea".split())
UNSEEN = set("head script style template noscript noembed noframes iframe datalist title object audio video canvas".split())
PARAGRAPH = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset form hr".split())
BLOCK = PARAGRAPH | set("address article aside body center details dialog dd div dt figcaption footer header html li main menu nav section summary tr td th caption legend option".split())
#: What svg and math do not draw, what holds html inside them, and the tags that end them.
UNDRAWN = set("defs symbol clippath mask marker pattern lineargradient radialgradient filter metadata desc annotation annotation-xml".split())
HOLDS_HTML = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
                 "ruby s small span strong strike sub sup table tt u ul var".split())
IN_HEAD = set("base basefont bgsound link meta title style script noscript noframes template head".split())
CLOSES_P = (BLOCK - {"body", "html", "tr", "td", "th", "caption", "legend", "option"})
#: What an opening tag ends, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}), "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
SCOPE = {"table", "td", "th", "caption", "html", "body"}


class Buffer:
    """Text under construction with collapsed blanks and pending breaks."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks, self.space, self.prefix = 0, False, ""

    def block(self, lines: int) -> None:
        self.space = False
        if self.out:
            self.breaks = max(self.breaks, lines)

    def line(self) -> None:
        self.space = False
        if self.out:
            self.breaks = self.breaks + 1 if self.breaks < 2 else 2

    def put(self, text: str) -> None:
        if self.breaks:
            self.out.append("\n" * self.breaks)
        elif self.space and self.out:
            self.out.append(" ")
        self.out.append(self.prefix + text if self.prefix else text)
        self.breaks, self.space, self.prefix = 0, False, ""

    def words(self, text: str) -> None:
        inner = BLANK.sub(" ", text)
        if inner.startswith(" "):
            self.space = True
            inner = inner[1:]
        tail = inner.endswith(" ")
        inner = inner[:-1] if tail else inner
        if inner:
            self.put(inner)
        self.space = self.space or tail

    def text(self) -> str:
        return "".join(self.out).strip("\n")


class Table:
    def __init__(self, flat: bool):
        self.flat = flat
        self.rows: list[list[tuple[str, int]]] = []

    def lines(self) -> list[str]:
        """Cells of one line each are padded to the width of their column;
        cells of several lines are set line by line beside one another, or
        one below another where that takes over FILL times their text."""
        cells = [[(t.split("\n"), span) for t, span in r] for r in self.rows if any(t for t, _ in r)]
        width: dict[int, int] = {}
        for r in cells:
            at = 0
            for lines, span in r:
                if span == 1:
                    width[at] = max(width.get(at, 0), max((len(x) for x in lines if len(x) <= WIDE), default=0))
                at += span
        columns = sorted(width)
        sums = [0, *accumulate(width[c] for c in columns)]
        out = []
        for r in cells:
            at, rooms = 0, []
            for _, span in r:
                first, last = bisect_left(columns, at), bisect_left(columns, at + span)
                rooms.append(sums[last] - sums[first] + 3 * max(last - first - 1, 0))
                at += span
            high = max(len(lines) for lines, _ in r)
            if high * (sum(rooms) + 3 * len(r)) > FILL * sum(sum(map(len, lines)) + 1 for lines, _ in r):
                out.extend(x for lines, _ in r for x in lines if x)
                continue
            for k in range(high):
                out.append(" | ".join((lines[k] if k < len(lines) else "").ljust(room) for (lines, _), room in zip(r, rooms)).rstrip())
        return out


class Element:
    __slots__ = ("name", "shown", "closed", "pre", "count", "buffer", "table", "span", "visible", "foreign", "muted", "options", "chosen")

    def __init__(self, name, shown, closed, pre):
        self.name, self.shown, self.closed, self.pre = name, shown, closed, pre
        self.count, self.buffer, self.table, self.span = None, None, None, 1
        #: Visibility, whether children are svg or math, svg outside its texts, and what a select chooses.
        self.visible, self.foreign, self.muted, self.options, self.chosen = True, False, False, None, None


class Page:
    def __init__(self):
        self.stack = [Element("", True, False, False)]
        self.buffers = [Buffer()]
        self.tables: list[Table] = []
        self.cells = 0
        #: Open elements by name (places in the stack), open lists, and shown selects.
        self.places: dict[str, list[int]] = {}
        self.lists: list[Element] = []
        self.selects: list[Element] = []

    # -- tree builder

    def find(self, names, stops) -> int:
        """Place of the innermost open element of ``names``, 0 if one of ``stops`` is inside it."""
        at = self.innermost(names)
        return at if at and at >= self.innermost(stops) else 0

    def innermost(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def leave_head(self) -> None:
        """The implied end of a head that is the innermost element."""
        if self.stack[-1].name == "head":
            self.pop()

    def open(self, name: str, attrs: dict, ended: bool = False) -> None:
        """``ended``: the tag has a trailing slash, which counts in svg and math only."""
        if self.stack[-1].foreign and name in BREAKS_OUT:
            while self.stack[-1].foreign:
                self.pop()
        if self.stack[-1].foreign or name in ("svg", "math"):
            self.leave_head()
            self.push(name, attrs)
            if ended:
                self.pop()
            return
        if name in ("html", "body") and self.find({name}, ()):
            return
        if name == "select" and (at := self.find({name}, ())):
            return self.close_to(at)
        if name not in IN_HEAD:
            self.leave_head()
        if name in CLOSES_P and (at := self.find({"p"}, SCOPE | {"li", "dd", "dt"} - {"p"})):
            self.close_to(at)
        if name in ENDS:
            names, stops = ENDS[name]
            while at := self.find(names, stops):
                self.close_to(at)
        if name in ("td", "th") and self.find({"table"}, ()) and not self.find({"tr"}, {"table"}):
            self.push("tr", {})
        self.push(name, attrs)
        if name in VOID:
            self.close_to(len(self.stack) - 1)

    def end(self, name: str) -> None:
        if name == "p" and not self.find({"p"}, SCOPE):
            self.push("p", {})
        if name == "br":
            return self.open("br", {})
        inside = set() if name in SCOPE or name in ("tr", "tbody", "thead", "tfoot") else {"td", "th", "caption"}
        if at := self.find({name}, inside | ({"table"} if name != "table" else set())):
            self.close_to(at)

    def close_to(self, at: int) -> None:
        while len(self.stack) > at:
            self.pop()

    # -- renderer

    def push(self, name: str, attrs: dict) -> None:
        up = self.stack[-1]
        shown = up.shown and name not in UNSEEN and "hidden" not in attrs and not (up.closed and name != "summary")
        style = attrs.get("style") or ""
        shown = shown and not NOT_SHOWN.search(style) and not (name == "dialog" and "open" not in attrs)
        shown = shown and not (up.foreign and name in UNDRAWN)
        e = Element(name, shown, name == "details" and "open" not in attrs, up.pre or name == "pre")
        # an invisible element keeps its place, and what it has inside may be visible
        said = [VISIBLE[v] for v in map(str.lower, VISIBILITY.findall(style)) if v in VISIBLE] if "visibility" in style.lower() else ()
        e.visible = said[-1] if said else up.visible
        e.foreign = name in ("svg", "math") or up.foreign and name not in HOLDS_HTML
        e.muted = name == "svg" or up.muted and name not in ("text", "foreignobject")
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(e)
        if not shown:
            return
        b = self.buffers[-1]
        if up.foreign:
            b.space = b.space or name == "text"
            return
        if name == "select":
            size = attrs.get("size") or "1"
            many = "multiple" in attrs or re.fullmatch(r"0*[1-9][0-9]+|0*[2-9]", size) is not None
            e.options, e.chosen = [], (None if many else -1)
            self.selects.append(e)
            self.buffers.append(Buffer())
            return
        if name == "option" and self.selects:
            owner = self.selects[-1]
            owner.options.append([attrs.get("label") or "", e.visible, "selected" in attrs, "disabled" in attrs])
            e.options = owner.options[-1]
            self.buffers.append(Buffer())
            return
        if name == "br":
            b.line()
        elif name in BLOCK and name not in ("td", "th"):
            b.block(2 if name in PARAGRAPH and not (name in ("ul", "ol") and self.lists) else 1)
        if name in ("ul", "ol", "menu"):
            self.lists.append(e)
            start = attrs.get("start") or "1"
            e.count = (int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1) if name == "ol" else None
        elif name == "li":
            owner = self.lists[-1] if self.lists else None
            mark = "- "
            if owner is not None and owner.count is not None:
                mark, owner.count = f"{owner.count}. ", owner.count + 1
            if e.visible:
                b.prefix = "  " * min(max(len(self.lists) - 1, 0), INDENT) + mark
        elif name == "table":
            e.table = Table(len(self.tables) >= NESTED)
            self.tables.append(e.table)
        elif name in ("tr", "td", "th") and self.tables and self.tables[-1].flat:
            b.block(1)
            self.cells += e.visible and name != "tr"
        elif name == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif name in ("td", "th") and self.tables:
            e.buffer = Buffer()
            span = attrs.get("colspan") or "1"
            e.span = min(max(int(span), 1), 1000) if re.fullmatch(r"[0-9]{1,4}", span) else 1
            self.buffers.append(e.buffer)
            self.cells += e.visible

    def pop_choice(self, e: Element) -> None:
        """A list shows all options, any other select the last one chosen or
        else the first that can be."""
        own = self.buffers.pop()
        if e.name == "select":
            self.selects.pop()
        b = self.buffers[-1]
        if e.name == "option":
            e.options[0] = e.options[0] or own.text()
            return
        if e.chosen is None:
            for text, visible, *_ in e.options:
                if text and visible:
                    b.block(1)
                    b.put(text)
            b.block(1)
            return
        chosen = [x for x in e.options if x[2]][-1:] or [x for x in e.options if not x[3]][:1]
        b.space = True
        for text, visible, *_ in chosen:
            if text and visible:
                b.put(text)
        b.space = True

    def pop(self) -> None:
        e = self.stack.pop()
        self.places[e.name].pop()
        if not e.shown:
            return
        if self.stack[-1].foreign:
            self.buffers[-1].space = self.buffers[-1].space or e.name == "text"
            return
        if e.options is not None:
            return self.pop_choice(e)
        if e.name in ("ul", "ol", "menu"):
            self.lists.pop()
        if e.buffer is not None:
            self.buffers.pop()
            rows = self.tables[-1].rows
            if not rows:
                rows.append([])
            rows[-1].append((e.buffer.text(), e.span))
        elif e.table is not None:
            self.tables.pop()
            b = self.buffers[-1]
            for line in e.table.lines():
                b.block(1)
                b.put(line)
        b = self.buffers[-1]
        if e.name == "li":
            b.prefix = ""
        if e.name in BLOCK and e.name not in ("td", "th"):
            b.block(2 if e.name in PARAGRAPH and not (e.name in ("ul", "ol") and self.lists) else 1)

    def text(self, raw: str, plain: bool = False) -> None:
        if raw.strip(" \t\n\f\r"):
            self.leave_head()
        e = self.stack[-1]
        if not e.shown or e.closed or e.muted or not e.visible:
            return
        text = raw if plain else unescape(raw)
        b = self.buffers[-1]
        if e.pre:
            lines = text.replace("\r\n", "\n").split("\n")
            for k, line in enumerate(lines):
                if k:
                    b.breaks += 1 if b.out else 0
                if line:
                    b.put(line)
        else:
            b.words(text)


def attributes(raw: str) -> dict:
    found: dict = {}
    for k, a, b, c in ATTR.findall(raw):
        found.setdefault(k.lower(), unescape(a or b or c))
    return found


def extract(html: str | None) -> tuple[str, int]:
    """(visible text, table cells) of a page."""
    page, at, html = Page(), 0, html or ""
    size, unclosed = len(html), 0
    while at < size:
        m = (TAG if unclosed < UNCLOSED else LOOSE_TAG).search(html, at)
        if m is None:
            page.text(html[at:])
            break
        if m.start() > at:
            page.text(html[at:m.start()])
        at = m.end()
        if (name := m["start"] or m["loose"]) is not None:
            name, raw = name.lower(), m["attrs"] if m["start"] else m["rest"]
            unclosed += m["loose"] is not None
            if name == "plaintext":
                page.open("pre", {})
                page.text(html[at:], plain=True)
                break
            page.open(name, attributes(raw) if raw.strip(" /\n") else {}, raw.endswith("/"))
            if name in RAW and page.stack[-1].name == name and not page.stack[-2].foreign:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
                to = stop.start() if stop else size
                page.text(html[at:to], plain=name not in ("title", "textarea"))
                at = to
        elif m["end"] is not None:
            page.end(m["end"].lower())
        elif m["cdata"] is not None:
            page.text(m["cdata"], plain=True)
    page.close_to(1)
    return page.buffers[0].text(), page.cells


def _extract(html_col: str):
    def run(batches):
        for b in C.batch_blocks(batches, html_col):
            done = [extract(x) for x in b.column(html_col).to_pylist()]
            cols = [c for n, c in zip(b.schema.names, b.columns) if n != html_col]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                names=[*[n for n in b.schema.names if n != html_col], "text", "n_cells"])
    return run


def extract_html(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text (all visible text: paragraphs and
    headings apart by a blank line, other blocks by a line, list items marked
    and indented, table cells aligned by column) and n_cells.

    A null page has an empty text; broken markup is repaired, never refused;
    input columns named text or n_cells are replaced; repeated rows give
    repeated results; an empty table gives an empty result.
    """
    pages = C.without(pages, ["text", "n_cells"] if html_col != "text" else ["n_cells"])
    out = T.StructType([*[f for f in pages.schema.fields if f.name != html_col], T.StructField("text", T.StringType()), T.StructField("n_cells", T.LongType())])
    return pages.mapInArrow(_extract(html_col), out)


def digest(pages: DataFrame) -> DataFrame:
    """The columns of query op8."""
    return extract_html(pages.select("page_id", "html"))
