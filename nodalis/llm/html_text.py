"""Layout-aware text of web pages.

A tree builder supplies implied tags (paragraphs, list items, rows and cells
that end themselves; end tags without a start), visibility rules drop what a
browser does not show, and a renderer writes all visible text: blocks on lines
of their own, a blank line around paragraphs, headings, lists and tables, nested
lists with bullets or numbers, preformatted text as it is, and table cells in
aligned columns.

Building and rendering keep their own stacks, so depth is bounded by memory
only.  Null html gives null text, an empty page empty text; broken markup is
text or skipped, never an error; repeated rows give repeated results, an empty
table an empty one.  Only the named columns are read, so others may clash.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import mapped, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never shown.
HIDDEN = frozenset("head script style template title noembed noframes iframe object audio video canvas datalist".split())
#: Elements whose content is not shown inside svg or math.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker annotation annotation-xml".split())
#: Elements that an open head may hold; anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: Elements that stand on lines of their own, and those with a blank line around.
BLOCK = frozenset("address article aside body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary ul blockquote h1 h2 h3 h4 h5 h6 table caption tr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre table figure hr".split())
LISTS = frozenset("ul ol menu dir".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
#: What a start tag ends, if open above the elements named second.
ENDS = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for t in ("thead", "tbody", "tfoot", "colgroup", "caption")},
}
SCOPE = frozenset(["table", "td", "th", "caption", "html", "button", "object", "template"])
SPACE = re.compile(r"[ \t\n\r\f\v]+")
GONE = re.compile(r"(?:^|;)(?:\s|/\*.*?\*/)*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I | re.S)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class TreeBuilder(HTMLParser):
    """Nodes and strings from markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.count: Counter = Counter()  # open elements by tag: most searches of the stack need not begin

    def _close(self, tags, stop) -> None:
        """Ends the innermost of ``tags`` unless one of ``stop`` is further in."""
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                for n in self.open[k:]:
                    self.count[n.tag] -= 1
                del self.open[k:]
                return
            if self.open[k].tag in stop:
                return

    def _leave_head(self) -> None:
        """Ends an open head if what comes next would be its child."""
        if self.count["head"] and (self.open[-1].tag == "head" or self.open[-1].tag == "noscript" and self.open[-2].tag == "head"):
            self._close({"head"}, ())

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._leave_head()
        if tag in ENDS_P:
            self._close({"p"}, SCOPE)
        if tag[:1] == "h" and tag[1:].isdigit() and self.open[-1].tag[:1] == "h" and self.open[-1].tag[1:].isdigit():
            self.count[self.open.pop().tag] -= 1
        if tag == "body" or tag in BLOCK and tag not in ("html",):
            self._close({"head"}, {"body"})
        if tag in ENDS:
            ends, stop = ENDS[tag]
            while True:
                before = len(self.open)
                self._close(ends, stop)
                if len(self.open) == before:
                    break
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr"))
        node = Node(tag, {k: v or "" for k, v in attrs})
        if self.count["svg"] or self.count["math"]:
            if tag in UNDRAWN:
                node.attrs["hidden"] = ""
            elif tag == "text":
                self.open[-1].children.append(" ")  # drawn at a place of its own
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.count[node.tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash ends an element that is not void in svg and math only
        if (self.count["svg"] or self.count["math"]) and self.open[-1].tag == tag:
            self.count[self.open.pop().tag] -= 1

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].children.append(Node("br"))
        elif tag == "p" and not self.count["p"]:
            self.open[-1].children.append(Node("p"))
        elif tag not in VOID:
            self._close({tag}, {"td", "th", "caption"} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption", "html", "body") else {"table"} - {tag})
            if tag == "text" and self.count["svg"]:
                self.open[-1].children.append(" ")

    def parse_html_declaration(self, i):
        # a marked section is a comment up to the next >, but for character data in svg and math
        if self.rawdata[i : i + 3] != "<![":
            return super().parse_html_declaration(i)
        end = self.rawdata.find("]]>", i + 9)
        if self.rawdata[i : i + 9] == "<![CDATA[" and (self.count["svg"] or self.count["math"]) and end >= 0:
            self.handle_data(self.rawdata[i + 9 : end])
            return end + 3
        return self.parse_bogus_comment(i)

    def handle_data(self, data):
        if self.count["head"] and SPACE.sub("", data):
            self._leave_head()
        self.open[-1].children.append(data)


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    a = node.attrs
    if not a:
        return True
    if "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not (a.get("style") and GONE.search(a["style"]))


def width(s: str) -> int:
    """Columns of a string: none for marks, two for wide characters."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Canvas:
    """Lines of text as they are laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # a collapsed space waits for more text
        self.blank = False  # a blank line is due before the next text
        self.indent = 0
        self.mark = ""  # bullet or number for the next line

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if s == " " or not s:
            self.space |= bool(s) and bool(self.now)
            return
        if s[0] == " ":
            self.space |= bool(self.now)
            s = s[1:]
        tail = s[-1] == " "
        if tail:
            s = s[:-1]
        self._start()
        if self.space:
            self.now.append(" ")
        self.now.append(s)
        self.space = tail

    def _start(self) -> None:
        if not self.now:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = self.space = False
            self.now.append(" " * (self.indent - len(self.mark)) + self.mark)
            self.mark = ""

    def raw(self, s: str) -> None:
        """Preformatted text."""
        for k, line in enumerate(s.split("\n")):
            if k:
                self.end(True)
            if line:
                self._start()
                self.now.append(line)

    def end(self, always: bool = False) -> None:
        """Ends the line; an empty one counts only if ``always``."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
        elif always and self.lines:
            self.lines.append("")
        self.now, self.space = [], False

    def gap(self) -> None:
        self.end()
        self.blank = True

    def result(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(s: str | None, default: int) -> int:
    return int(s) if s and re.fullmatch(r"[+-]?\d{1,9}", s.strip()) else default


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table from rows of (lines, column span, row span)."""
    placed, taken = [], {}
    for y, row in enumerate(rows):
        x = 0
        for lines, across, down in row:
            while (y, x) in taken:
                x += 1
            across = min(max(1, across), 1000)
            down = min(max(1, down), len(rows) - y)
            for dy in range(down):
                for dx in range(across):
                    taken[y + dy, x + dx] = True
            placed.append((y, x, lines, across))
            x += across
    columns = max((x + a for _, x, _, a in placed), default=0)
    size = [0] * columns
    for _, x, lines, a in sorted(placed, key=lambda p: p[3]):
        need = max(map(width, lines), default=0) - sum(size[x : x + a]) - 2 * (a - 1)
        if need > 0:
            size[x + a - 1] += need
    at = [0] * columns
    for x in range(1, columns):
        at[x] = at[x - 1] + size[x - 1] + (2 if size[x - 1] else 0)
    out = []
    by: dict[int, list] = {}
    for y, x, lines, _ in placed:
        by.setdefault(y, []).append((x, lines))
    for y in range(len(rows)):
        for k in range(max((len(lines) for _, lines in by.get(y, [])), default=0)):
            line = ""
            for x, lines in by[y]:
                if k < len(lines) and lines[k]:
                    line += " " * (at[x] - width(line)) + lines[k]
            out.append(line.rstrip(" "))
    return out


def render(root: Node) -> str:
    """All visible text of a tree."""
    canvas = Canvas()
    frames: list = []  # canvases of the tables around, with their rows
    lists: list = []  # [ordered, next number, indent before]
    pre = 0
    todo: list = [(False, root)]
    while todo:
        done, node = todo.pop()
        if isinstance(node, str):
            canvas.raw(node) if pre else canvas.text(node)
            continue
        tag = node.tag
        if done:
            if tag == "pre" or tag == "textarea":
                pre -= 1
            if tag in LISTS:
                canvas.indent = lists.pop()[2]
            elif tag == "dd" or tag == "blockquote":
                canvas.indent -= 2
            elif tag in ("td", "th", "caption") and frames and frames[-1][2] is node:
                outer, rows = frames[-1][:2]
                lines = canvas.result()
                canvas = outer
                frames[-1][2] = None
                if tag == "caption":
                    frames[-1][3].append(lines)
                else:
                    rows[-1].append((lines, _number(node.attrs.get("colspan"), 1), _number(node.attrs.get("rowspan"), 1)))
            elif tag == "table":
                outer, rows, _, captions = frames.pop()[:4]
                for line in [x for c in captions for x in c] + grid(rows):
                    canvas.raw(line)
                    canvas.end(True)
            if tag == "li":
                canvas.mark = ""
            if tag in SPACED and not (tag in LISTS and lists):
                canvas.gap()
            elif tag in BLOCK:
                canvas.end()
            continue
        if tag == "br":
            canvas.end(True)
            continue
        if not visible(node):
            continue
        if tag in SPACED and not (tag in LISTS and lists):
            canvas.gap()
        elif tag in BLOCK:
            canvas.end()
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag == "input":
            if node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text") and node.attrs.get("value"):
                canvas.text(node.attrs["value"])
            continue
        if tag in LISTS:
            lists.append([tag == "ol", _number(node.attrs.get("start"), 1), canvas.indent])
            canvas.indent += 2
        elif tag == "li":
            kind = lists[-1] if lists else [False, 1, 0]
            if kind[0]:
                n = _number(node.attrs.get("value"), kind[1])
                kind[1] = n + 1
                canvas.mark = f"{n}. "
                canvas.indent = max(canvas.indent, kind[2] + len(canvas.mark))
            else:
                canvas.mark = "* "
        elif tag == "dd" or tag == "blockquote":
            canvas.indent += 2
        elif tag == "pre" or tag == "textarea":
            pre += 1
            if children and isinstance(children[0], str) and children[0][:1] == "\n":
                children = [children[0][1:], *children[1:]]
        elif tag == "table":
            frames.append([canvas, [], None, []])
        elif tag == "tr" and frames and frames[-1][2] is None:
            frames[-1][1].append([])
        elif tag in ("td", "th", "caption") and frames and frames[-1][2] is None and (frames[-1][1] or tag == "caption"):
            frames[-1][0], frames[-1][2] = canvas, node
            canvas = Canvas()
        elif tag in ("td", "th"):
            canvas.text(" ")
        todo.append((True, node))
        todo += [(False, c) for c in reversed(children)]
    while frames:  # cells whose table never ended its work
        lines = canvas.result()
        canvas = frames.pop()[0]
        for line in lines:
            canvas.raw(line)
            canvas.end(True)
    return "\n".join(canvas.result())


def text_of(html: str | None) -> str | None:
    if html is None:
        return None
    b = TreeBuilder()
    try:
        b.feed(html)
        b.close()
    except AssertionError:  # no markup known makes the tokenizer give up; if one did, what came before stays
        pass
    return render(b.root)


def extract(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text) for each row of ``df``: whole pages, no shuffle."""
    src = df.select(F.col(key), F.col(html).cast("string").alias("_html"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of(h) for h in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return mapped(src, run, f"`{key}` {src.schema[key].dataType.simpleString()}, text string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
