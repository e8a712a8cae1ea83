"""Visible text of HTML pages, by layout-aware rendering.

A tree builder closes what HTML leaves open (paragraphs before blocks, items, cells, rows, options, head before body) and
ignores end tags that match nothing. Rules of visibility then leave out scripts, styles, templates, hidden elements,
closed details and dialogs, and what inline or simple stylesheet rules (by tag, class or id) don't display; rules inside
at-rules count where these hold for a screen of ``SCREEN`` pixels, and not where that can't be told; an element
with ``visibility: visible`` inside a hidden one shows again. The rest is rendered: blocks on lines of their own with one
empty line around paragraphs, headings, lists and tables; items with bullets or numbers and indented; preformatted text as
it is; table cells in aligned columns, with spans; of drawings the texts, each on a line; of formulas the characters; of
text fields what they hold; of selects the options marked as selected, or all where the select is a list box. A drop-down
without a marked option gives nothing.

Results for odd input: null or empty markup gives empty text; plain text gives itself with white space collapsed; markup
nested deeper than ``DEEP`` levels is flattened, its text kept; repeated rows are rendered row by row; very long pages are
rendered whole; of rules of equal weight the last holds; an empty table gives no rows; a null id is kept; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import css
from cohortlens.llm.common import in_arrow, slices

DEEP = 150
SCREEN = {"width": 1280, "height": 720}
# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption tbody thead tfoot tr td th".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
ENDS_P = BLOCK - frozenset("body html dd dt li option optgroup caption tbody thead tfoot tr td th legend summary".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist title meta link base param source track".split())
# Parts of drawings and formulas that aren't shown, and those that hold the texts of a drawing.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker annotation annotation-xml mphantom".split())
DRAWN_TEXT, DRAWN = frozenset("text foreignobject".split()), frozenset("svg g switch text tspan textpath foreignobject".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
ROWS, CELLS = frozenset("thead tbody tfoot".split()), frozenset("td th".split())
# What a start tag closes if it is open, and the elements at which looking for it stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), **{k: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for k in ("thead", "tbody", "tfoot", "caption", "colgroup")}}
SCOPE = frozenset("table td th caption html body".split())
_WHITE = re.compile(r"[ \t\n\r\f]+")
_MARK = re.compile(r"[{};]")
_LENGTH = re.compile(r"(\d*\.?\d+)(px|em|rem)?")
_RANGE = re.compile(r"(?:([^<>=]+?)\s*([<>]=?|=)\s*)?(width|height)(?:\s*([<>]=?|=)\s*([^<>=]+))?")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class TreeBuilder(HTMLParser):
    """Builds a tree of nodes and texts from any markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.styles: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag in ("html", "body"):  # there is one of each; attributes that come late count
            home = self.root if tag == "html" else self._body()
            home.attrs.update({k: v for k, v in given.items() if k not in home.attrs})
            return
        if self.open[-1].tag == "head" and tag not in HEAD_ONLY:
            self._pop("head")
        if tag in ENDS_P:
            self._close({"p"}, SCOPE | {"button"})
        if tag in CLOSES:
            close, stop = CLOSES[tag]
            while self._close(close, stop):
                pass
        if re.fullmatch(r"h[1-6]", tag) and re.fullmatch(r"h[1-6]", self.open[-1].tag):
            self.open.pop()
        if tag == "a":
            self._close({"a"}, SCOPE)
        at = self.open[-1].tag
        if tag in CELLS and at in {"table", *ROWS}:
            self._push(Node("tr", {}))
        if tag == "head" and len(self.open) > 1:
            return
        if tag in UNDRAWN and self._foreign():
            given["hidden"] = ""
        node = Node(tag, given)
        if tag == "textarea":
            self.set_cdata_mode(tag)  # what looks like tags in it is text
        if tag in VOID:
            node.parent = self.open[-1]
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        held = len(self.open)
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML, but it does in drawings and formulas
        if len(self.open) > held and self.open[-1].tag == tag and (tag in ("svg", "math") or self._foreign()):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].children.append(Node("p", {}, self.open[-1]))
        elif tag not in ("html", "body"):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    del self.open[i:]
                    return
                if self.open[i].tag in SCOPE and tag not in {"table", "tr", *ROWS, *CELLS} and tag not in BLOCK:
                    return

    def handle_data(self, data: str) -> None:
        at = self.open[-1]
        if at.tag == "style":
            self.styles.append(data)
        elif at.tag == "head" and data.strip():
            self._pop("head")
            at = self.open[-1]
        at.children.append(unescape(data) if at.tag == "textarea" else data)

    def _push(self, node: Node) -> None:
        node.parent = self.open[-1]
        self.open[-1].children.append(node)
        if len(self.open) < DEEP:
            self.open.append(node)
        elif node.tag in UNSEEN or node.tag in ("textarea", "select"):  # its text must not show, or not all of it
            self.open.append(node)
        elif node.tag in DRAWN_TEXT and self.open[-1].tag not in DRAWN_TEXT:
            self.open.append(node)

    def _foreign(self) -> bool:
        """Whether the open element is part of a drawing or formula."""
        for node in reversed(self.open):
            if node.tag in ("svg", "math"):
                return True
            if node.tag == "foreignobject":
                return False
        return False

    def _body(self) -> Node:
        self._pop("head")
        return self.root

    def _pop(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def _close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> bool:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return True
            if self.open[i].tag in stop:
                return False
        return False


def _pixels(value: str) -> float | None:
    found = _LENGTH.fullmatch(value.strip())
    return float(found[1]) * (1 if found[2] in (None, "px") else 16) if found else None


def _feature(text: str) -> bool | None:
    """Whether a media feature holds for the screen; None if that can't be told."""
    name, colon, value = (x.strip() for x in text.partition(":"))
    # What a desktop browser without preferences answers.
    usual = {"orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference", "forced-colors": "none", "scripting": "enabled"}
    if colon and name in usual:
        return usual[name] == value
    bound = re.fullmatch(r"(min-|max-)?(?:device-)?(width|height)", name)
    if colon:
        limit = _pixels(value) if bound else None
        if limit is None:
            return None
        has = SCREEN[bound[2]]
        return has >= limit if bound[1] == "min-" else has <= limit if bound[1] == "max-" else has == limit
    found = _RANGE.fullmatch(text.strip())
    if not found or not (found[2] or found[4]):
        return None
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}
    has, out = SCREEN[found[3]], True
    for low, sign, high in ((_pixels(found[1]) if found[2] else None, found[2], has), (has, found[4], _pixels(found[5]) if found[4] else None)):
        if sign:
            if low is None or high is None:
                return None
            out = out and compare[sign](low, high)
    return out


def holds(query: str) -> bool:
    """Whether a list of media queries holds for the screen; what can't be told doesn't."""
    for one in query.lower().split(","):
        words = re.fullmatch(r"\s*(?:(not|only)\s+)?(?:([a-z-]+)(?:\s+and\s+|\s*$))?((?:\([^()]*\)(?:\s*and\s*)?)*)\s*", one)
        if not words:
            continue
        known = [words[2] in (None, "all", "screen"), *(_feature(x) for x in re.findall(r"\(([^()]*)\)", words[3]))]
        state = False if False in known else None if None in known else True
        if state is not None and state != (words[1] == "not"):
            return True
    return False


def plain_rules(sheet: str) -> Iterator[tuple[bool, str, str]]:
    """(whether in a layer, selectors, declarations) of the rules that apply on the screen."""
    rules: list[tuple[bool, str, str]] = []
    blocks: list[tuple[str, bool, bool, list[str]]] = []  # prelude, whether rules in it apply, in a layer, own declarations
    at = 0
    for mark in _MARK.finditer(sheet):
        text, at = sheet[at : mark.start()].strip(), mark.end()
        if mark[0] == "{":
            apply, layer = (blocks[-1][1], blocks[-1][2]) if blocks else (True, False)
            if blocks and not blocks[-1][0].startswith("@"):
                apply = False  # a rule inside a rule is no rule by tag, class or id
            if text.startswith("@"):
                name, _, rest = text.partition(" ") if " " in text else text.partition("(")
                name, rest = name.lower(), text[len(name) :]
                apply = apply and (name == "@layer" or (name == "@media" and holds(rest)) or (name == "@supports" and not rest.lower().lstrip().startswith("not")))
                layer = layer or name == "@layer"
            blocks.append((text, apply, layer, []))
        elif blocks:
            blocks[-1][3].append(text)
            if mark[0] == "}":
                selectors, apply, layer, body = blocks.pop()
                if apply and not selectors.startswith("@"):
                    rules.append((layer, selectors, ";".join(body)))
    if blocks and blocks[-1][1] and not blocks[-1][0].startswith("@"):  # the end of a sheet closes what it left open
        rules.append((blocks[-1][2], blocks[-1][0], ";".join([*blocks[-1][3], sheet[at:]])))
    yield from rules


class Visibility:
    """Rules of display and visibility; ``state`` is whether the surroundings are visible."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, list[tuple[tuple, css.Selector, dict[str, tuple[str, bool]]]]] = {}
        for order, (layered, selectors, body) in enumerate(plain_rules(re.sub(r"/\*.*?\*/", "", " ".join(sheets), flags=re.DOTALL))):
            found = {k: v for k, v in css.declared(body).items() if k in ("display", "visibility")}
            for one in css.separated(selectors) if found else []:
                if rule := css.parsed(one):
                    self.rules.setdefault(rule.key(), []).append(((not layered, rule.weight(), order), rule, found))

    def of(self, node: Node, state: bool) -> bool | None:
        """Whether the node's own text shows; None if nothing inside it does. Of several declarations an important one counts
        before others, then the node's own before those of rules, then the more specific rule, then the later one."""
        attrs = node.attrs
        if node.tag in UNSEEN or "hidden" in attrs or (node.tag == "dialog" and "open" not in attrs):
            return None
        best: dict[str, tuple[tuple, str]] = {k: ((), attrs[k].strip().lower()) for k in ("display", "visibility") if k in attrs} if node.tag in DRAWN else {}

        def told(found: dict[str, tuple[str, bool]], own: bool, place: tuple) -> None:
            for name, (value, important) in found.items():
                rank = (important, own, *place)
                if name not in best or rank >= best[name][0]:
                    best[name] = rank, value

        if self.rules:
            tags = [node.tag] if node.parent is not None else [node.tag, "body"]
            for key in ["*", *tags, *("." + c for c in dict.fromkeys(attrs.get("class", "").split())), *(["#" + attrs["id"]] if attrs.get("id") else [])]:
                for place, rule, found in self.rules.get(key, ()):
                    if rule.fits(node):
                        told(found, False, place)
        if "style" in attrs:
            told(css.declared(attrs["style"]), True, ())
        if best.get("display", ((), ""))[1] == "none":
            return None
        seen = best.get("visibility")
        return state if seen is None else seen[1] not in ("hidden", "collapse")


def _text(node: Node) -> str:
    """All text inside a node."""
    out, waiting = [], deque([node])
    while waiting:
        at = waiting.popleft()
        if isinstance(at, str):
            out.append(at)
        elif at.tag not in UNSEEN:
            waiting.extendleft(reversed(at.children))
    return "".join(out)


class Lines:
    """Finished lines, and the one being written."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.space = True  # white space would be at the start of a line or after other white space

    def text(self, data: str, kept: bool) -> None:
        if kept:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for line in rest:
                self.end(always=True)
                self.now.append(line)
            self.space = False
            return
        data = _WHITE.sub(" ", data)
        if self.space and data[:1] == " ":
            data = data[1:]
        if data:
            self.now.append(data)
            self.space = data[-1] == " "

    def end(self, always: bool = False) -> None:
        line = "".join(self.now).replace("\xa0", " ").rstrip()
        self.now, self.space = [], True
        if line or always:
            self.put([line])

    def put(self, lines: list[str]) -> None:
        if lines:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines += lines

    def apart(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.end()
        a, b = 0, len(self.lines)
        while a < b and not self.lines[a]:
            a += 1
        while b > a and not self.lines[b - 1]:
            b -= 1
        return self.lines[a:b]


class Renderer:
    def __init__(self, sheets: list[str]):
        self.visibility = Visibility(sheets)

    def inside(self, node: Node, seen: bool, kept: bool) -> list[str]:
        out = Lines()
        self.children(node, out, seen, kept)
        return out.done()

    def children(self, node: Node, out: Lines, seen: bool, kept: bool) -> None:
        number = int(node.attrs["start"]) if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
        summary_only = node.tag == "details" and "open" not in node.attrs
        for child in node.children:
            if isinstance(child, str):
                if seen and not summary_only:
                    out.text(child, kept)
                continue
            if summary_only and child.tag != "summary":
                continue
            shown = self.visibility.of(child, seen)
            if shown is None:
                continue
            tag = child.tag
            if tag == "br":
                out.end(always=True)
            elif tag == "input":
                if shown and child.attrs.get("type", "text").lower() in ("submit", "reset", "button"):
                    out.text(child.attrs.get("value", ""), kept)
            elif tag == "svg":
                self.drawing(child, out, shown, kept)
            elif tag == "textarea":
                held = "".join(x for x in child.children if isinstance(x, str)).replace("\r\n", "\n").removeprefix("\n")
                if shown and held:
                    out.text(held, True)
            elif tag == "select":
                self.options(child, out, shown)
            elif tag == "li":
                if re.fullmatch(r"-?\d{1,9}", child.attrs.get("value", "")):
                    number = int(child.attrs["value"])
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                out.end()
                lines = self.inside(child, shown, kept)
                if lines:
                    out.put([mark + lines[0], *(" " * len(mark) + x if x else x for x in lines[1:])])
            elif tag == "table":
                out.apart(1)
                out.put(self.table(child, shown, kept))
                out.gap = 1
            elif tag in ("blockquote", "dd"):
                out.apart(int(tag in SPACED))
                out.put(["  " + x if x else x for x in self.inside(child, shown, kept)])
                out.gap = max(out.gap, int(tag in SPACED))
            elif tag in BLOCK:
                gap = int(tag in SPACED and not (tag in ("ul", "ol", "menu") and node.tag == "li"))
                out.apart(gap)
                self.children(child, out, shown, kept or tag == "pre")
                out.apart(gap)
            else:
                self.children(child, out, shown, kept)

    def drawing(self, node: Node, out: Lines, seen: bool, kept: bool) -> None:
        """The texts of a drawing. Of a switch the first part without conditions shows."""
        for child in node.children:
            if isinstance(child, str):
                continue  # only what stands in a text is drawn
            if node.tag == "switch" and "systemlanguage" in child.attrs:
                continue
            shown = self.visibility.of(child, seen)
            if shown is not None and child.tag in DRAWN_TEXT:
                out.apart(0)
                self.children(child, out, shown, kept)
                out.apart(0)
            elif shown is not None:
                self.drawing(child, out, shown, kept)
            if node.tag == "switch":
                break

    def options(self, node: Node, out: Lines, seen: bool) -> None:
        """All options of a list box, with the labels of their groups; of a drop-down the last one marked as selected."""
        listed = "multiple" in node.attrs or bool(re.fullmatch(r"\s*0*(?:[2-9]|[1-9][0-9]+)\s*", node.attrs.get("size", "")))
        lines: list[str] = []
        waiting = deque([(node, seen)])
        while waiting:
            at, state = waiting.popleft()
            if at.tag == "option":
                text = at.attrs.get("label") or _text(at)
                if state and (listed or "selected" in at.attrs):
                    lines.append(_WHITE.sub(" ", text).strip())
                continue
            if at.tag == "optgroup" and listed and state:
                lines.append(_WHITE.sub(" ", at.attrs.get("label", "")).strip())
            inner = [(c, self.visibility.of(c, state)) for c in at.children if not isinstance(c, str)]
            waiting.extendleft(reversed([(c, s) for c, s in inner if s is not None]))
        if listed:
            out.apart(0)
            out.put([x for x in lines if x])
        elif lines:
            out.text(lines[-1], False)

    def table(self, node: Node, seen: bool, kept: bool) -> list[str]:
        """Caption, then rows of cells in columns as wide as their widest line; columns are two spaces apart."""
        above: list[str] = []
        grid: list[dict[int, tuple[list[str], int]]] = []
        busy: dict[tuple[int, int], bool] = {}

        def row(tr: Node, shown: bool) -> None:
            y, x, cells = len(grid), 0, {}
            for cell in tr.children:
                if isinstance(cell, str):
                    if shown and cell.strip():
                        above.append(_WHITE.sub(" ", cell).strip())
                    continue
                state = self.visibility.of(cell, shown)
                if cell.tag not in CELLS:  # stands before the table, as in browsers
                    above.extend([] if state is None else self.inside(cell, state, kept))
                    continue
                while (y, x) in busy:
                    x += 1
                wide, high = (min(int(v), 1000) if (v := cell.attrs.get(k, "")).isascii() and v.isdigit() and int(v) else 1 for k in ("colspan", "rowspan"))
                if state is not None:
                    cells[x] = (self.inside(cell, state, kept), wide)
                for i in range(1, high) if high > 1 else ():
                    for j in range(wide):
                        busy[y + i, x + j] = True
                x += wide
            grid.append(cells)

        def walk(part: Node, shown: bool) -> None:
            for child in part.children:
                if isinstance(child, str):
                    if shown and child.strip():
                        above.append(_WHITE.sub(" ", child).strip())
                    continue
                state = self.visibility.of(child, shown)
                if state is None:
                    continue
                if child.tag in ROWS:
                    walk(child, state)
                elif child.tag == "tr":
                    row(child, state)
                else:
                    above.extend(self.inside(child, state, kept))

        walk(node, seen)
        widths: dict[int, int] = {}
        for cells in grid:
            for x, (lines, wide) in cells.items():
                if wide == 1:
                    widths[x] = max(widths.get(x, 0), *map(len, lines), 0)
        for cells in grid:  # what a spanning cell needs beyond its columns goes to the last of them
            for x, (lines, wide) in cells.items():
                if wide > 1:
                    held = sum(widths.get(x + j, 0) for j in range(wide)) + 2 * (wide - 1)
                    need = max([0, *map(len, lines)])
                    if need > held:
                        widths[x + wide - 1] = widths.get(x + wide - 1, 0) + need - held
        place, at = {}, 0
        for x in range(max(widths, default=-1) + 1):
            place[x] = at
            at += widths.get(x, 0) + 2 if widths.get(x, 0) else 0
        out = list(above)
        for cells in grid:
            for i in range(max([len(lines) for lines, _ in cells.values()], default=0)):
                line = ""
                for x, (lines, _) in sorted(cells.items()):
                    if i < len(lines) and lines[i]:
                        line = line.ljust(place.get(x, len(line))) + lines[i]
                out.append(line.rstrip())
        return out


def visible_text(markup: str | None) -> str:
    """The visible text of a page."""
    if not markup:
        return ""
    builder = TreeBuilder()
    builder.feed(markup)
    builder.close()
    renderer = Renderer(builder.styles)
    seen = renderer.visibility.of(builder.root, True)
    return "" if seen is None else "\n".join(renderer.inside(builder.root, seen, False))


def extracted(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: the id column and ``text``. No shuffle; each page is rendered where it is read."""
    given = df.select(F.col(id_col), F.col(html_col).cast("string").alias("__html"))
    out = T.StructType([given.schema[0], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__html"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(visible_text, batch.column(1).to_pylist()), pa.string())], [f.name for f in out.fields])

    return in_arrow(given, run, out)
