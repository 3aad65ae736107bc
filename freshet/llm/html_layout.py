"""HTML extraction by layout-aware rendering.

A tree builder closes what a new tag implies to be closed, then a renderer walks the tree
with an explicit stack and emits all visible text the way a page lays it out: paragraphs
and headings apart, other blocks on lines of their own, lists marked and indented, table
cells aligned in columns, white space collapsed except in ``pre``.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import LOWER, UPPER, extras

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist annotation annotation-xml progress meter rp".split())
PREFORMATTED = frozenset("pre textarea xmp listing plaintext".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre xmp listing plaintext blockquote figure hr".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main menu nav search section summary tbody tfoot thead tr".split()
)
#: A start tag of the left closes an open element of the right, up to the nearest of the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ("html",)),
}
#: End tags that reach out of a cell.
IN_TABLE = frozenset("td th tr tbody thead tfoot table".split())
#: An open paragraph ends where one of these starts.
ENDS_P = BLOCK - {"body", "html", "caption", "legend", "li", "dd", "dt", "tbody", "thead", "tfoot", "tr", "summary", "figcaption"}
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
#: Where SVG or MathML begins, where HTML begins again inside, and what SVG never shows.
FOREIGN, HTML_AGAIN = frozenset(("svg", "math")), frozenset(("foreignobject", "annotation-xml"))
SVG_UNSEEN = frozenset("title desc metadata defs symbol clippath mask pattern marker style script".split())
#: A start tag of these ends SVG and MathML.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Fields whose value is shown as text.
VALUED = frozenset("text search email url tel number submit reset button".split())
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Where markup begins; where a comment, a tag, an element without markup ends; an attribute. Each is looked for from one
#: place on, and what isn't found takes the rest of the page.
_MARKUP = re.compile(r"<(?:([!?])|(/)(?:([A-Za-z][^\t\n\f />]*))?|([A-Za-z][^\t\n\f />]*))")
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
_ATTRIBUTE = re.compile(r"""[\t\n\f /]*([^\t\n\f />][^\t\n\f />=]*+)(?:[\t\n\f ]*+=[\t\n\f ]*+(?:"([^"]*+)|'([^']*+)|([^\t\n\f >"'][^\t\n\f >]*+)|(?=>)))?""")
_TAG_END = re.compile(r"[\t\n\f /]*>")
_IN_SCRIPT = re.compile(r"<!---*>|<!--|-->|</?script(?=[\t\n\f />])", re.I)
#: Elements whose contents hold no markup.
UNPARSED = {t: re.compile(rf"</{t}(?=[\t\n\f />])", re.I) for t in "script style xmp iframe noembed noframes plaintext title textarea".split()}
_LONG_NUMBER = re.compile(r"&#(?:[xX]([0-9a-fA-F]{8,});?|([0-9]{8,});?)")
_REFERENCE = re.compile(r"&#?[A-Za-z0-9]+(?:;|(?![=A-Za-z0-9;]))")
_FOLD = str.maketrans(UPPER, LOWER)
#: Limits of layout, not of text: columns of a table that are aligned, the widest cell that
#: others are aligned with (and half the widest gap), tables within tables that are laid out as
#: tables, and the deepest indent. They keep the space that pads a page in proportion to its text.
COLUMNS, WIDEST, NESTED, INDENT = 1000, 200, 20, 80


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


def decoded(text: str) -> str:
    """Text with its character references resolved. Numbers of any length are read."""
    return unescape(_LONG_NUMBER.sub(_shortened, text)) if "&" in text else text


def _shortened(m: re.Match) -> str:
    """A numeric reference without leading zeros; one beyond all characters as the first that is."""
    digits = (m[1] or m[2]).lstrip("0") or "0"
    return f"&#{'x' if m[1] else ''}{digits};" if len(digits) < 8 else "&#x110000;"


def _attribute(value: str) -> str:
    """The same for the value of an attribute, where a name without a semicolon that goes on isn't one."""
    return _REFERENCE.sub(lambda m: decoded(m[0]), value) if "&" in value else value


def _lower(name: str) -> str:
    return name.lower() if name.isascii() else name.translate(_FOLD)


class TreeBuilder:
    """Builds a tree from any string, in one pass from left to right.

    The tokenizer follows the states of the HTML standard: ``<`` begins markup before a letter, ``/``,
    ``!`` or ``?`` only; a declaration that is none of comment, document type and (in SVG and MathML) CDATA
    section is a comment up to ``>``; a comment that isn't closed ends with the page; a tag that isn't
    closed is none. Of attributes of one name the first counts. Whatever it looks for it finds once: markup that lacks its end takes
    the rest of the page.
    """

    def __init__(self):
        self.root = Node("html", {})
        #: Open elements, and by tag the places of its open elements in that list, ascending.
        self.stack, self.open = [self.root], defaultdict(list, html=[0])

    def feed(self, html: str) -> None:
        html = html.replace("\r\n", "\n").replace("\r", "\n")
        at, text = 0, []

        def flush() -> None:
            if text:
                self.handle_data(decoded("".join(text)))
                text.clear()

        while at < len(html):
            m = _MARKUP.search(html, at)
            if not m:
                text.append(html[at:])
                break
            text.append(html[at : m.start()])
            kind, at = m[1] or m[2], m.end()
            if kind == "!" and html.startswith("--", at):
                m = _COMMENT_END.search(html, at + 2)
                at = m.end() if m else len(html)
            elif kind == "!" and html.startswith("[CDATA[", at) and self._foreign():
                flush()
                end = html.find("]]>", at)
                self.handle_data(html[at + 7 : end if end >= 0 else len(html)])
                at = end + 3 if end >= 0 else len(html)
            elif kind == "/" and at == len(html) and not m[3]:
                text.append("</")
            elif kind and not m[3]:
                end = html.find(">", at)
                at = end + 1 if end >= 0 else len(html)
            else:
                at, attrs, closed = self._attributes(html, at)
                if at < 0:
                    break
                flush()
                tag = _lower(m[3] or m[4])
                if kind:
                    self.handle_endtag(tag)
                    continue
                foreign = self.handle_starttag(tag, attrs)
                if closed and tag not in VOID and (tag in FOREIGN or self._foreign()):
                    self._pop(len(self.stack) - 1)
                elif not foreign and tag in UNPARSED:
                    to, after = self._unparsed_end(html, at, tag)
                    body = html[at:to]
                    if body:
                        self.handle_data(decoded(body) if tag in ("title", "textarea") else body)
                    at = after
        flush()

    @staticmethod
    def _attributes(html: str, at: int) -> tuple[int, dict[str, str | None], bool]:
        """(place after the tag, attributes, whether it closes itself) from the end of a tag's name on; -1 where the page ends first."""
        attrs: dict[str, str | None] = {}
        while m := _ATTRIBUTE.match(html, at):
            at = m.end()
            double, single, bare = m[2], m[3], m[4]
            if (double is not None and not html.startswith('"', at)) or (single is not None and not html.startswith("'", at)):
                return -1, {}, False
            value = double if double is not None else single if single is not None else bare
            at += double is not None or single is not None
            attrs.setdefault(_lower(m[1]), None if value is None else _attribute(value))
        end = _TAG_END.match(html, at)
        return (end.end(), attrs, end[0].endswith("/>")) if end else (-1, {}, False)

    @staticmethod
    def _unparsed_end(html: str, at: int, tag: str) -> tuple[int, int]:
        """(end of the text of an element without markup, place of what follows: its end tag)."""
        if tag == "plaintext":
            return len(html), len(html)
        if tag == "script":  # a script within a comment within the script has an end tag of its own
            comment = inner = False
            for m in _IN_SCRIPT.finditer(html, at):
                if m[0] == "<!--":
                    comment = True
                elif m[0][-1] == ">":
                    comment = inner = False
                elif m[0][1] != "/":
                    inner = comment
                elif inner:
                    inner = False
                else:
                    return m.start(), m.start()
            return len(html), len(html)
        m = UNPARSED[tag].search(html, at)
        return (m.start(), m.start()) if m else (len(html), len(html))

    def _pop(self, down_to: int) -> None:
        while len(self.stack) > max(down_to, 1):
            self.open[self.stack.pop().tag].pop()

    def _nearest(self, tags) -> int:
        """Place of the innermost open element of ``tags``, -1 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _close_nearest(self, tags: tuple[str, ...], fence: tuple[str, ...]) -> None:
        """Close the outermost open element of ``tags`` above the nearest fence."""
        near = max(self._nearest(fence), 0)
        places = [at[k] for t in tags if (at := self.open.get(t)) and (k := bisect_right(at, near)) < len(at)]
        if places:
            self._pop(min(places))

    def _foreign(self) -> str | None:
        """svg or math, if the open element belongs to it."""
        svg, math = self._nearest(("svg",)), self._nearest(("math",))
        if max(svg, math) <= self._nearest(HTML_AGAIN):
            return None
        return "svg" if svg > math else "math"

    def handle_starttag(self, tag: str, attrs: dict[str, str | None]) -> str | None:
        """Opens an element; gives the foreign language (svg or math) that it belongs to."""
        foreign = self._foreign()
        if foreign and tag in BREAKS_OUT:
            while self._foreign():
                self._pop(len(self.stack) - 1)
            foreign = None
        if tag == "html":
            self.root.attrs = {**attrs, **self.root.attrs}
            return foreign
        if self.open.get("head") and tag not in IN_HEAD:
            self._close_nearest(("head",), ())
        if tag in CLOSES:
            self._close_nearest(*CLOSES[tag])
        if tag in ENDS_P and self.open.get("p"):
            self._close_nearest(("p",), ("td", "th", "button", "table", "caption"))
        node = Node(tag, attrs)
        if foreign == "svg" and tag in SVG_UNSEEN:
            node.attrs["hidden"] = None
        if foreign == "svg" and tag == "text":
            self.stack[-1].children.append(" ")
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.open[tag].append(len(self.stack))
            self.stack.append(node)
        return foreign

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body") or not self.open.get(tag):
            return
        at = self.open[tag][-1]
        if tag in IN_TABLE or at > self._nearest(("td", "th", "table")):
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if self.open.get("head") and self.stack[-1].tag == "head" and data.strip():
            self._close_nearest(("head",), ())
        if self._foreign() == "svg" and not self.open.get("text"):
            return  # SVG shows the characters of its text elements alone
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    """The tree of any string; malformed markup is read as the HTML standard's tokenizer reads it."""
    builder = TreeBuilder()
    builder.feed(html)
    return builder.root


def visible(node: Node, inherited: bool = True) -> tuple[bool, bool]:
    """Whether an element is laid out at all, and whether its own text shows: a child can be
    visible in an element of hidden visibility, but not in one that isn't displayed."""
    style = dict((k.lower(), v.lower()) for k, v in _STYLE.findall(node.attrs.get("style") or ""))
    gone = style["display"] == "none" if "display" in style else "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs)
    shown = {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(style.get("visibility"), inherited)
    return node.tag not in INVISIBLE and not gone, shown


def _shown_options(select: Node) -> list:
    """What a list of options shows: all of a list box, else the chosen one or the first."""
    options, work = [], list(reversed(select.children))
    while work:
        node = work.pop()
        if isinstance(node, Node) and all(visible(node)):
            if node.tag == "option":
                options.append(node)
            else:
                work.extend(reversed(node.children))
    said = lambda o: [o.attrs["label"]] if o.attrs.get("label") else o.children
    size = select.attrs.get("size") or "1"
    if "multiple" in select.attrs or re.fullmatch(r"0*[1-9]\d+|0*[2-9]", size):
        out = []
        for o in options:
            line = Node("div", {})
            line.children = said(o)
            out.append(line)
        return out
    chosen = [o for o in options if "selected" in o.attrs][-1:] or [o for o in options if "disabled" not in o.attrs][:1]
    return [" ", *said(chosen[0]), " "] if chosen else []


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Text laid out in lines, with collapsed white space and pending breaks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.space, self.blank, self.prefix = [], False, False, ""

    def write(self, text: str, pre: bool, indent: str) -> None:
        if pre:
            for k, part in enumerate(text.split("\n")):
                if k:
                    self.end_line(keep=True)
                if part:
                    self._put(part, indent)
            return
        text = _SPACE.sub(" ", text)
        words = text.strip(" ")
        if words:
            if self.line and (self.space or text[0] == " "):
                self.line.append(" ")
            self._put(words, indent)
            self.space = text[-1] == " "
        elif text:
            self.space = True

    def _put(self, text: str, indent: str) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            mark, self.prefix = self.prefix, ""
            self.line.append(indent[: len(indent) - len(mark)] + mark if mark else indent)
        self.line.append(text)

    def end_line(self, keep: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        elif keep and self.lines:
            self.lines.append("")
        self.line, self.space = [], False

    def apart(self) -> None:
        self.end_line()
        self.blank = True

    def result(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


Cell = tuple[list[str], int, int]


def _places(rows: list[list[Cell]]) -> list[list[tuple[int, int, list[str]]]]:
    """(column, columns, lines) of the cells of each row: a cell lies in the first column that
    neither this row nor a cell from above, which spans rows, has taken."""
    until: dict[int, int] = {}
    out = []
    for r, row in enumerate(rows):
        at, placed = 0, []
        for lines, columns, deep in row:
            while at < COLUMNS and until.get(at, 0) > r:
                at += 1
            if deep > 1:
                until.update(dict.fromkeys(range(at, min(at + columns, COLUMNS)), r + deep))
            placed.append((at, columns, lines))
            at += columns
        out.append(placed)
    return out


def _table(rows: list[list[Cell]]) -> list[str]:
    """Cells in aligned columns, two spaces apart; a cell of several lines takes as many. A
    cell over several columns widens the last of them where it needs to."""
    placed = _places(rows)
    widths: dict[int, int] = defaultdict(int)
    spread = []
    for row in placed:
        for at, columns, lines in row:
            need = max((w for w in map(_width, lines) if w <= WIDEST), default=0)
            if columns == 1:
                widths[at] = max(widths[at], need)
            else:
                spread.append((at + columns - 1, at, need))
    for last, at, need in sorted(spread):
        inside = [c for c in range(at, min(last, at + COLUMNS)) if widths.get(c)]
        widths[last] = max(widths[last], min(WIDEST, need - sum(widths[c] + 2 for c in inside)))
    used = sorted(c for c, w in widths.items() if w > 0)
    starts, at = [], 0
    for c in used:
        starts.append(at)
        at += widths[c] + 2
    out = []
    for row in placed:
        for k in range(max([len(lines) for _, _, lines in row], default=0)):
            line, width = [], 0
            for c, _, lines in row:
                text = lines[k] if k < len(lines) else ""
                if not text:
                    continue
                i = bisect_right(used, c - 1)
                gap = min(max(starts[i] - width if i < len(used) else 0, 2 if line else 0), 2 * WIDEST)
                line += [" " * gap, text]
                width += gap + _width(text)
            out.append("".join(line))
    return out


def _number(node: Node, name: str, most: int) -> int:
    value = (node.attrs.get(name) or "").strip()
    return min(max(int(value), 1), most) if re.fullmatch(r"\d{1,6}", value) else 1


def render(root: Node) -> str:
    """All visible text under a node, laid out."""
    flow = Flow()
    flows, tables, lists, indents = [], [], [], [""]
    pre = 0
    deeper = lambda n: indents.append(indents[-1] + " " * n if len(indents[-1]) < INDENT else indents[-1])
    work: list = [(root, False, True)]
    while work:
        node, leaving, shown = work.pop()
        if isinstance(node, str):
            if shown:
                flow.write(node, pre > 0, indents[-1])
            continue
        tag = node.tag
        in_grid = bool(tables) and tables[-1] is not None
        if not leaving:
            laid_out, shown = visible(node, shown)
            if not laid_out:
                continue
            if tag == "br":
                flow.end_line(keep=not flow.line and not flow.blank)
                continue
            if tag == "input":
                if shown and (node.attrs.get("type") or "text").lower() in VALUED:
                    flow.write(f" {node.attrs.get('value') or ''} ", False, indents[-1])
                continue
            if tag == "img":
                continue
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                flow.apart()
            elif tag in BLOCK or (tag in ("td", "th") and not in_grid):
                flow.end_line()
            if tag == "hr":
                continue
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start") or "1"
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                deeper(len(mark))
                flow.prefix = mark if shown else ""
            elif tag in ("dd", "blockquote"):
                deeper(2)
            elif tag in PREFORMATTED:
                if flow.line and flow.space:
                    flow.line.append(" ")
                pre += 1
            elif tag == "table":
                nested = len(tables) >= NESTED
                tables.append(None if nested else (flow, indents, lists, []))
                if not nested:
                    flow, indents, lists = Flow(), [""], []
            elif tag == "tr" and in_grid:
                tables[-1][3].append([])
            elif tag in ("td", "th") and in_grid:
                flows.append((flow, indents, lists))
                flow, indents, lists = Flow(), [""], []
            work.append((node, True, shown))
            work.extend((c, False, shown) for c in reversed(_shown_options(node) if tag == "select" else node.children))
            continue
        if tag in ("td", "th") and in_grid:
            lines = flow.result()
            flow, indents, lists = flows.pop()
            deep = 65534 if (node.attrs.get("rowspan") or "").strip() == "0" else _number(node, "rowspan", 65534)
            if not tables[-1][3]:
                tables[-1][3].append([])
            tables[-1][3][-1].append((lines, _number(node, "colspan", 1000), deep))
        elif tag == "table":
            held = tables.pop()
            if held is not None:
                loose = flow.result()  # a caption, or text outside of cells
                flow, indents, lists, rows = held
                for line in [*loose, *_table(rows)]:
                    flow.write(line, True, indents[-1])
                    flow.end_line()
        elif tag in ("ul", "ol", "menu"):
            lists.pop() if lists else None
        elif tag in ("li", "dd", "blockquote") and len(indents) > 1:
            indents.pop()
            flow.prefix = "" if tag == "li" else flow.prefix
        elif tag in PREFORMATTED:
            pre -= 1
        if tag in SPACED and not (tag in ("ul", "ol") and lists):
            flow.apart()
        elif tag in BLOCK or (tag in ("td", "th") and not in_grid):
            flow.end_line()
    return "\n".join(flow.result())


def declared_language(root: Node) -> str | None:
    """The primary subtag that the html element, or else a meta element, declares."""
    found = root.attrs.get("lang") or root.attrs.get("xml:lang")
    work = list(root.children) if not found else []
    while work and not found:
        node = work.pop()
        if isinstance(node, Node):
            if node.tag == "meta" and (node.attrs.get("http-equiv") or "").lower() == "content-language":
                found = node.attrs.get("content")
            if node.tag in ("head", "body", "html"):
                work.extend(reversed(node.children))
    m = re.match(r"\s*([A-Za-z]{2,3})\b", found or "")
    return m[1].lower() if m else None


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of ``pages`` but the markup, with ``text``: all visible text, laid out.

    A null or empty page has an empty text. Malformed markup is read as far as it goes.
    A column named ``text`` is replaced. An empty table gives an empty table. Every row
    is rendered by itself in Arrow batches: nothing is shuffled.
    """
    keep = extras(pages, ["text", html_col, "_html"])
    slim = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("_html"))
    schema = T.StructType([*[f for f in slim.schema.fields if f.name != "_html"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 256):
                batch = whole.slice(at, 256)
                columns = {c: batch.column(c) for c in keep}
                columns["text"] = pa.array([render(parse(h or "")) for h in batch.column("_html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return slim.mapInArrow(run, schema)
