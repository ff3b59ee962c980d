"""Layout-aware HTML rendering: a tree builder with implied tags, visibility rules, and a text layout.

All visible text comes out: paragraphs, headings, lists and tables stand apart by an empty line, other blocks by
a line break, list entries carry their marker and indent, and the cells of a table line up in columns, rows and
columns that a cell spans included, at every size. A cell is laid out like a page of its own, so paragraphs, lists and
tables in it keep their form, and long paragraphs go on in further lines of the cell. Cells of a table of one column
are written one after another.

The scanner reads a page once, from left to right. Columns that cells of earlier rows hold are kept as runs and not
one by one, widths as sums over a tree, so a page takes time in proportion to its size, but for a logarithm, whatever
it holds; and its text grows by a bounded factor (`Layout.most_padding`).

Defined results. Null or empty HTML: empty text. Text without tags: that text, its blanks collapsed. Broken or
cut-off markup: rendered as far as it goes; a tag that never closes is text, and after one that only ends inside
quotes, quotes no longer shield a `>`. Repeated rows: one result a row. Empty table: no rows. Deep nesting is walked
without recursion; lists deeper than `Layout.most_indent` are not indented further, tables deeper than `most_nested`
are written as blocks. Where cells overlap the earlier one holds the columns. Other columns of the input are not touched.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INVISIBLE = frozenset(
    "head script style title template noscript iframe noembed noframes datalist audio video canvas object meta link base".split()
)
#: Inside svg and math: texts that stand apart, and parts whose text is not drawn.
DRAWN_APART = frozenset(["text"])
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu".split())
BLOCK = SPACED | frozenset(
    "address article aside body center caption dd details dialog div dt fieldset figcaption footer form header "
    "hgroup html legend li main nav optgroup option search section summary tbody tfoot thead tr".split()
)
CLOSES_P = (BLOCK | {"hr"}) - {"li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "body", "html"}
#: A start tag closes an open element of these names, if it is not beyond one of those.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
WALLS = frozenset("table td th caption".split())
SECTIONS = frozenset("tbody thead tfoot".split())

#: The most columns and rows that HTML lets a cell span.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534


@dataclass(frozen=True)
class Layout:
    """How text is laid out. None of these loses text."""

    #: Characters beyond which running text in the cells of a table of several columns goes on in a new line.
    wrap: int = 100
    #: Depths of lists that are still indented, and of tables within tables that are still laid out as such.
    most_indent: int = 20
    most_nested: int = 12
    #: Blanks that alignment may add to a table, as a multiple of its text and of `wrap` a line; a table that would need
    #: more has its cells set apart by two blanks, so that a page never grows beyond a multiple of itself.
    most_padding: int = 8


_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: A tag from behind its name to its end. A quote counts only where a value begins, and only if it is closed.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_ATTRIBUTE = re.compile(r"([^\s=/>][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
#: Only tags with one of these are looked at closely.
_MAY_HIDE = re.compile(r"hidden|display|visibility|&", re.I)


def _unescaped(text: str) -> str:
    if "&" not in text:
        return text
    try:
        return html.unescape(text)
    except ValueError:  # a character number of thousands of digits
        return text


def _attributes(attrs: str) -> dict[str, str]:
    """Names and values of a tag's attributes; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attrs):
        found.setdefault(name.lower(), _unescaped("".join(values)))
    return found


def _number(attrs: str, name: str) -> int | None:
    found = re.match(r"\s*(-?\d{1,9})", _attributes(attrs).get(name, "")) if name in attrs.lower() else None
    return int(found[1]) if found else None


def _is_open(attrs: str) -> bool:
    return "open" in _attributes(attrs)


class Scanner:
    """Texts and tags of a page: (text, name, attributes, closes) for each tag with the text before it."""

    def __init__(self, source: str) -> None:
        self.source, self.at = source, 0
        self.quotes = True

    def __iter__(self) -> Iterator[tuple[str, str, str, bool]]:
        source = self.source
        look = self.at
        while (look := source.find("<", look)) >= 0:
            after = source[look + 1 : look + 2]
            if after in ("!", "?"):
                comment = source.startswith("<!--", look)
                end = source.find("-->", look + 4) if comment else source.find(">", look)
                if end < 0 and not comment:
                    break  # nothing closes any more: text
                text, self.at = source[self.at : look], (len(source) if end < 0 else end + (3 if comment else 1))
                yield text, "", "", False
            else:
                closes = after == "/"
                name = _NAME.match(source, look + 1 + closes)
                if not name:
                    look += 1
                    continue
                end = source.find(">", name.end())
                if end < 0:
                    break
                if self.quotes and "=" in source[name.end() : end]:
                    rest = _REST.match(source, name.end())
                    self.quotes = rest is not None
                    end = rest.end() - 1 if rest else end
                text, attrs, self.at = source[self.at : look], source[name.end() : end], end + 1
                yield text, name[0].lower(), attrs, closes
            look = self.at
        yield source[self.at :], "", "", False

    def raw(self, name: str) -> str:
        """What stands between here and the end tag of a raw element, which is skipped."""
        end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.source, self.at)
        body = self.source[self.at : end.start() if end else len(self.source)]
        close = self.source.find(">", end.end()) if end else -1
        self.at = close + 1 if close >= 0 else len(self.source)
        return body


def build(source: str) -> list:
    """The tree of a page: nodes are [name, attributes, children], text is str."""
    stack: list[list] = [["#root", "", []]]
    #: Depths of open elements, by name.
    depths: dict[str, list[int]] = defaultdict(list)

    def push(node: list) -> None:
        depths[node[0]].append(len(stack))
        stack.append(node)

    def close(names, walls) -> None:
        """Close the nearest open element of these names, with all that is open inside it, unless a wall is nearer."""
        depth = max((d[-1] for x in names if (d := depths.get(x))), default=0)
        if depth and depth >= max((d[-1] for x in walls if (d := depths.get(x))), default=0):
            while len(stack) > depth:
                depths[stack.pop()[0]].pop()

    scanner = Scanner(source)
    for text, name, attrs, closes in scanner:
        if text:
            stack[-1][2].append(_unescaped(text))
        if not name:
            continue
        if closes:
            if name == "br":
                stack[-1][2].append(["br", "", []])
            else:
                close({name}, () if name in WALLS or name in SECTIONS or name in ("tr", "body", "html") else WALLS)
            continue
        if name in ("html", "body") and depths[name]:
            continue
        if name in CLOSES_P:
            close({"p"}, WALLS | {"button"})
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in ("td", "th") and (stack[-1][0] == "table" or stack[-1][0] in SECTIONS):
            row: list = ["tr", "", []]
            stack[-1][2].append(row)
            push(row)
        if depths["svg"] or depths["math"]:
            if name in DRAWN_APART:
                stack[-1][2].append(" ")
            elif name in UNDRAWN:
                attrs = "hidden/" if attrs.endswith("/") else "hidden"
        node = [name, attrs, []]
        stack[-1][2].append(node)
        if name in RAW:
            body = scanner.raw(name)
            node[2].append(_unescaped(body) if name in ("textarea", "title") else body)
        elif name not in VOID and (not attrs.endswith("/") or name in BLOCK):
            push(node)
    return stack[0]


def _declared(style: str) -> dict[str, str]:
    """What a style attribute says of display and visibility; the last counts, the important before others."""
    found: dict[str, tuple[bool, str]] = {}
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        name, (value, mark, _) = name.strip(), value.partition("!")
        if name in ("display", "visibility") and (mark or not found.get(name, (False,))[0]):
            found[name] = (bool(mark), value.strip())
    return {name: value for name, (_, value) in found.items()}


def _shown(node: list, visible: bool) -> tuple[bool, bool]:
    """Whether a node takes part in the layout, and whether text in it is visible."""
    name, attrs, _ = node
    if name in INVISIBLE:
        return False, visible
    if name == "dialog" and not _is_open(attrs):
        return False, visible
    if attrs and _MAY_HIDE.search(attrs):
        has = _attributes(attrs)
        said = _declared(has.get("style", ""))
        if said.get("display", "none" if "hidden" in has else "") == "none":
            return False, visible
        if "visibility" in said and said["visibility"] != "inherit":
            visible = said["visibility"] not in ("hidden", "collapse")
    return True, visible


class _Page:
    """Lines of text under way: collapses blanks and keeps the largest spacing asked for between blocks."""

    def __init__(self, most_indent: int) -> None:
        self.most_indent = most_indent
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = False
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""

    def write(self, text: str) -> None:
        words = text.split()
        if not words:
            self.blank = self.blank or bool(text)
            return
        if self.parts and (self.blank or text[0].isspace()):
            self.parts.append(" ")
        self.parts.append(" ".join(words))
        self.blank = text[-1].isspace()

    def flush(self) -> None:
        self.blank = False
        if self.parts:
            self.put("".join(self.parts))
            self.parts = []

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * (self.gap - 1))
        self.gap = 0
        lead = "".join(self.indent[: self.most_indent])
        if self.marker:
            lead = lead[: max(0, len(lead) - len(self.marker))] + self.marker
            self.marker = ""
        self.lines.append((lead + line).rstrip())

    def put_all(self, lines: list[str]) -> None:
        """Lines that belong together, empty ones among them kept."""
        for line in lines:
            self.put(line)
            self.gap = 1

    def apart(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)


def _cells(table: list, visible: bool) -> tuple[list[list[tuple]], list[tuple]]:
    """Rows of (cell, visible) of a table, and what stands outside them (captions, stray content)."""
    rows: list[list[tuple]] = []
    outside, todo = [], [(x, visible, None) for x in reversed(table[2])]
    while todo:
        x, seen, row = todo.pop()
        if isinstance(x, str):
            if x.strip():
                outside.append((x, seen))
            continue
        shown, seen = _shown(x, seen)
        if not shown:
            continue
        if x[0] in SECTIONS or x[0] == "colgroup":
            todo.extend((y, seen, None) for y in reversed(x[2]))
        elif x[0] == "tr":
            rows.append(row := [])
            todo.extend((y, seen, row) for y in reversed(x[2]))
        elif x[0] in ("td", "th") and row is not None:
            row.append((x, seen))
        else:
            outside.append((x, seen))
    return rows, outside


class _Taken:
    """Columns that cells of earlier rows still hold, as runs that neither touch nor overlap."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # heap: (row from which a stretch is free again, its start and end)

    def free_at(self, column: int) -> int:
        """The first column from this one on that is free."""
        i = bisect_right(self.starts, column) - 1
        return self.ends[i] if i >= 0 and column < self.ends[i] else column

    def hold(self, start: int, end: int, until: int) -> None:
        """Take the columns from a free one up to `end`, or to the next that is taken, until a row."""
        i = bisect_right(self.starts, start)
        if i < len(self.starts):
            end = min(end, self.starts[i])
        heappush(self.until, (until, start, end))
        if i < len(self.starts) and self.starts[i] == end:
            end = self.ends[i]
            del self.starts[i], self.ends[i]
        if i and self.ends[i - 1] == start:
            self.ends[i - 1] = end
        else:
            self.starts.insert(i, start)
            self.ends.insert(i, end)

    def begin(self, row: int) -> None:
        """Let go of what ends before a row."""
        while self.until and self.until[0][0] <= row:
            _, start, end = heappop(self.until)
            i = bisect_right(self.starts, start) - 1
            first, last = self.starts[i], self.ends[i]
            del self.starts[i], self.ends[i]
            for x, y in ((end, last), (first, start)):
                if x < y:
                    self.starts.insert(i, x)
                    self.ends.insert(i, y)


class _Widths:
    """Widths of the columns at which some cell ends, with sums over stretches of them (a Fenwick tree)."""

    def __init__(self, columns: list[int]) -> None:
        self.columns = columns
        self.own = [0] * len(columns)
        self.tree = [0] * (len(columns) + 1)

    def _before(self, i: int) -> int:
        total = 0
        while i:
            total += self.tree[i]
            i &= i - 1
        return total

    def room(self, first: int, last: int) -> int:
        """Characters from column `first` to `last`, each with the two blanks behind it."""
        return self._before(bisect_right(self.columns, last)) - self._before(bisect_left(self.columns, first))

    def widen(self, column: int, by: int) -> None:
        """Make a column wider; one that had no width gets its two blanks as well."""
        i = bisect_left(self.columns, column)
        more = by if self.own[i] else by + 2
        self.own[i] += by
        i += 1
        while i < len(self.tree):
            self.tree[i] += more
            i += i & -i


def _aligned(rows: list[list[tuple[list[str], int, int]]], layout: Layout) -> list[str]:
    """Lines of a table from rows of (lines of a cell, columns and rows it spans), in time about that of its text."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken = _Taken()
    for n, row in enumerate(rows):
        taken.begin(n)
        at, out = 0, []
        for lines, across, down in row:
            at = taken.free_at(at)
            out.append((at, across, lines))
            if down > 1:
                taken.hold(at, at + across, n + down)
            at += across
        placed.append(out)
    widths = _Widths(sorted({at + across - 1 for row in placed for at, across, _ in row}))
    for spanning in (False, True):  # a cell over several columns widens the last of them
        for row in placed:
            for at, across, lines in row:
                if (across > 1) is spanning:
                    wide, last = max(map(len, lines), default=0), at + across - 1
                    room = widths.room(at, last)
                    if wide > room - 2 and wide:
                        widths.widen(last, max(1, wide - room if not widths.own[bisect_left(widths.columns, last)] else wide - room + 2))
    begin = {at: widths.room(0, at - 1) for row in placed for at, _, _ in row}
    text = sum(len(x) for row in placed for _, _, lines in row for x in lines)
    n_lines, padded = 0, 0
    for row in placed:
        for i in range(max((len(lines) for _, _, lines in row), default=0)):
            n_lines += 1
            padded += max((begin[at] for at, _, lines in row if i < len(lines) and lines[i]), default=0)
    apart = padded > layout.most_padding * (text + layout.wrap * n_lines)
    out = []
    for row in placed:
        for i in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for at, _, lines in row:
                if i < len(lines) and lines[i]:
                    behind = line and (apart or len(line) + 2 > begin[at])
                    line = (line + "  " if behind else line if apart else line.ljust(begin[at])) + lines[i]
            out.append(line)
    return out


def _wrapped(lines: list[str], most: int) -> list[str]:
    """Running text in lines of at most `most` characters; what is aligned already, by several blanks, stays as it is."""
    out = []
    for line in lines:
        if len(line) <= most or "  " in line.lstrip():
            out.append(line)
            continue
        lead = line[: len(line) - len(line.lstrip())]
        own, size = [], 0
        for word in line.split():
            if own and size + 1 + len(word) > most:
                out.append(lead + " ".join(own))
                own, size = [], 0
            size += len(word) + bool(own) if own else len(lead) + len(word)
            own.append(word)
        out.append(lead + " ".join(own))
    return out


def _list_of(page: _Page, todo: list, lists: list, name: str, attrs: str) -> None:
    """Begin a list: its end goes on `todo` for later."""
    gap = 1 if lists else 2
    page.apart(gap)
    start = _number(attrs, "start")
    lists.append([name, 1 if start is None else start])

    def leave() -> None:
        lists.pop()
        page.apart(gap)

    todo.append((leave, True))


def _entry(page: _Page, todo: list, lists: list, attrs: str) -> None:
    """Begin a list entry with its marker."""
    page.apart(1)
    marker = "- "
    if lists and lists[-1][0] == "ol":
        number = _number(attrs, "value")
        number = lists[-1][1] if number is None else number
        lists[-1][1] = number + 1
        marker = f"{number}. "
    page.indent.append(" " * len(marker))
    page.marker = marker

    def end() -> None:
        page.flush()
        page.marker = ""
        page.indent.pop()
        page.apart(1)

    todo.append((end, True))


def _write_table(page: _Page, todo: list, node: list, visible: bool, depth: int, how: Layout) -> None:
    """Lay out a table: what stands outside its rows first, as captions do, then the rows."""
    rows, outside = _cells(node, visible)
    page.apart(2)
    laid = [
        [(layout(x[2], seen, depth + 1, how), max(1, min(_number(x[1], "colspan") or 1, MOST_COLUMNS)), max(1, min(_number(x[1], "rowspan") or 1, MOST_ROWS))) for x, seen in row]
        for row in rows
    ]
    in_columns = max(map(len, laid), default=0) > 1

    def write() -> None:
        page.apart(1 if outside else 2)
        if in_columns:
            page.put_all(_aligned([[(_wrapped(lines, how.wrap), a, d) for lines, a, d in row] for row in laid], how))
        else:
            for row in laid:
                for lines, _, _ in row:
                    page.apart(1)
                    page.put_all(lines)
        page.apart(2)

    todo.append((write, True))
    todo.extend(reversed(outside))


def layout(nodes: list, visible: bool = True, depth: int = 0, how: Layout | None = None) -> list[str]:
    """Lines of the visible text of some nodes."""
    how = how or Layout()
    page = _Page(how.most_indent)
    #: What to do next, last first: (a node, a text, or a function to call; whether text is visible).
    todo: list[tuple] = [(x, visible) for x in reversed(nodes)]
    lists: list[list] = []
    while todo:
        x, seen = todo.pop()
        if isinstance(x, str):
            if seen:
                page.write(x)
            continue
        if callable(x):
            x()
            continue
        name, attrs, inside = x
        shown, seen = _shown(x, seen)
        if not shown:
            continue
        if name == "br":
            if page.parts:
                page.flush()
            else:
                page.gap = max(page.gap, 1) + 1 if page.lines else 0
            page.gap = max(page.gap, 1)
            continue
        if name == "table" and depth < how.most_nested:
            _write_table(page, todo, x, seen, depth, how)
            continue
        if name == "pre":
            page.apart(2)
            text, walk = [], [(x, seen)]
            while walk:
                y, s = walk.pop()
                if isinstance(y, str):
                    text.append(y if s else "")
                elif (there := _shown(y, s))[0]:
                    walk.extend([("\n", s)] if y[0] == "br" else ((z, there[1]) for z in reversed(y[2])))
            page.put_all("".join(text).strip("\n").split("\n"))
            page.gap = 2
            continue
        if name in ("ul", "ol", "menu"):
            _list_of(page, todo, lists, name, attrs)
        elif name == "li":
            _entry(page, todo, lists, attrs)
        elif name == "details" and not _is_open(attrs):
            page.apart(1)
            todo.append((lambda: page.apart(1), True))
            inside = [y for y in inside if not isinstance(y, str) and y[0] == "summary"][:1]
        elif name == "q":
            todo.append(("”", seen))
            todo.extend((y, seen) for y in reversed(inside))
            todo.append(("“", seen))
            continue
        elif name in ("blockquote", "dd"):
            gap = 2 if name in SPACED else 1
            page.apart(gap)
            page.indent.append("  ")

            def out(gap=gap) -> None:
                page.flush()
                page.indent.pop()
                page.apart(gap)

            todo.append((out, True))
        elif name in BLOCK or name in ("td", "th"):
            gap = 2 if name in SPACED else 1
            page.apart(gap)
            todo.append((lambda gap=gap: page.apart(gap), True))
        todo.extend((y, seen) for y in reversed(inside))
    page.flush()
    return page.lines


def render(source: str | None, how: Layout | None = None) -> str:
    """All visible text of a page."""
    return "\n".join(layout(build(source or "")[2], how=how))


def extract_text(pages: DataFrame, how: Layout | None = None) -> DataFrame:
    """Visible text of each page (page_id, url, html). One pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                texts = [render(x, how) for x in some["html"]]
                yield pd.DataFrame({
                    "page_id": some["page_id"].astype("Int64").to_numpy(), "url": some["url"].to_numpy(), "text": texts,
                    "n_chars": [len(x) for x in texts], "n_lines": [x.count("\n") + bool(x) for x in texts],
                })

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long, n_lines long")
