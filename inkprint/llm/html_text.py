"""Visible text of HTML pages, laid out in lines: blocks, lists and aligned table cells."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkprint.session import spread

DEPTH = 150  # deeper elements become siblings, as in browsers; their text stays
ALIGN = 60  # cells wider than this do not widen their column

# Fixed names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title template noscript noframes iframe object video audio canvas datalist meta link "
                   "base area param source track".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset menu".split())
BLOCKS = SPACED | frozenset("address article aside body center dd details dialog div dt figcaption footer form header "
                            "hgroup html legend li main nav optgroup option search section summary tr caption".split())
CLOSE_P = (BLOCKS - frozenset("body html optgroup option tr caption legend".split()))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("thead tbody tfoot".split())
TABLE_PARTS = SECTIONS | frozenset("table tr".split())
CELLS = frozenset("td th caption".split())
WALLS = CELLS | frozenset("table html template".split())  # end tags inside do not reach elements outside
_SPACE = re.compile(r"[ \t\n\f\r]+")

# The screen that style sheets are read for: a desktop browser with a mouse, light, without preferences.
SCREEN = {"width": 1280, "height": 720, "device-width": 1280, "device-height": 720, "aspect-ratio": 16 / 9,
          "device-aspect-ratio": 16 / 9, "resolution": 1, "-webkit-device-pixel-ratio": 1, "color": 8, "color-index": 0,
          "monochrome": 0, "grid": 0, "orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine",
          "any-pointer": "fine", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference",
          "prefers-reduced-data": "no-preference", "prefers-reduced-transparency": "no-preference",
          "prefers-contrast": "no-preference", "forced-colors": "none", "inverted-colors": "none", "scripting": "enabled",
          "display-mode": "browser", "update": "fast", "color-gamut": "srgb", "overflow-block": "scroll"}
_UNITS = {"": 1, "px": 1, "em": 16, "rem": 16, "pt": 4 / 3, "in": 96, "cm": 96 / 2.54, "mm": 96 / 25.4, "dppx": 1, "x": 1,
          "dpi": 1 / 96, "dpcm": 2.54 / 96}
_IGNORED = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|url\([^)]*\)|<!--|-->", re.S)
_GROUP = re.compile(r"\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)|[^\s()]+")
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_DISPLAY = re.compile(r"-webkit-[a-z-]+|(?:(?:block|inline|flow|flow-root|flex|grid|table|list-item|contents|ruby|math|"
                      r"run-in|initial|inherit|unset|inline-block|inline-flex|inline-grid|inline-table|table-[a-z-]+|ruby-[a-z-]+)(?: |\Z))+")


class Node:
    __slots__ = ("tag", "attrs", "children", "under")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, under: Node | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.under = under  # the open element below `DEPTH` that it became a sibling of


class Builder(HTMLParser):
    """A tree with implied tags: paragraphs, list items, rows and cells end where the next begins, rows and sections
    are added around stray cells, and content between cells moves in front of its table."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.stack, self.styles = [self.root], []
        self.places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack

    def _open(self, tags: frozenset[str] | set[str], walls: frozenset[str] | set[str]) -> int:
        """Place of the innermost open element with one of the tags, or 0 if a wall comes first."""
        at = wall = 0
        for tag, places in self.places.items():
            if tag in tags:
                at = max(at, places[-1])
            elif tag in walls:
                wall = max(wall, places[-1])
        return at if at > wall else 0

    def _cut(self, at: int) -> None:
        """End the elements from a place on."""
        for node in self.stack[at:]:
            self.places[node.tag].pop()
            if not self.places[node.tag]:
                del self.places[node.tag]
        del self.stack[at:]

    def _close(self, tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> bool:
        at = self._open(tags, walls)
        if at:
            self._cut(at)
        return bool(at)

    def _push(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        node = Node(tag, attrs, self.stack[-1] if len(self.stack) > DEPTH else None)
        self._home(tag).append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)
            if tag == "style" and not self.places.keys() & {"template", "noscript"} and applies(node.attrs.get("media", "")):
                self.styles.append([node])

    def _home(self, tag: str) -> list:
        """Where a new child goes: into the open element, or in front of the table if that may not hold it."""
        top = self.stack[min(len(self.stack), DEPTH) - 1]
        if top.tag not in TABLE_PARTS or tag in TABLE_PARTS | CELLS | {"colgroup", "col", "script", "style", "template"}:
            return top.children
        at = next((i for i in range(min(len(self.stack), DEPTH) - 1, 0, -1) if self.stack[i].tag == "table"), 0)
        if not at:
            return top.children
        front = self.stack[at - 1].children
        table = self.stack[at]
        new: list = _Before(front, table)
        return new

    def handle_starttag(self, tag: str, attrs: list) -> None:
        got = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "body"):
            self._close({"head"}, set())
            self.root.attrs = got | self.root.attrs
            return
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self._cut(len(self.stack) - 1)
        if tag in CLOSE_P:
            self._close({"p"}, WALLS | {"button"})
        if tag == "li":
            self._close({"li"}, WALLS | {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, WALLS | {"dl"})
        elif tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._cut(len(self.stack) - 1)
        elif tag in ("option", "optgroup"):
            self._close({"option"} if tag == "option" else {"option", "optgroup"}, WALLS | {"select"})
        elif tag in SECTIONS or tag in ("caption", "colgroup", "tr", "td", "th"):
            if not self._enter(tag):
                return
        self._push(tag, got)

    def _enter(self, tag: str) -> bool:
        """Go up to where a table part belongs, adding a section or row if it is missing."""
        at = self._open({"table"}, {"html", "template"})
        if not at:
            return False
        keep = at + 1
        if tag in ("tr", "td", "th"):
            if len(self.stack) > keep and self.stack[keep].tag in SECTIONS:
                keep += 1
            if tag != "tr" and len(self.stack) > keep and self.stack[keep].tag == "tr":
                keep += 1
        self._cut(keep)
        if tag in ("tr", "td", "th") and self.stack[-1].tag == "table":
            self._push("tbody")
        if tag in ("td", "th") and self.stack[-1].tag != "tr":
            self._push("tr")
        return True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and not self._open({"p"}, WALLS | {"button"}):
            self._push("p")
            self._close({"p"}, WALLS)
        elif tag in HEADINGS:
            self._close(HEADINGS, WALLS)
        elif tag in CELLS or tag in TABLE_PARTS:
            self._close({tag}, {"table", "html"} - {tag})
        elif tag not in ("html", "body"):
            inline = tag not in BLOCKS
            at = self._open({tag}, WALLS | (BLOCKS if inline else set()))
            if at:
                self._cut(at)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if self.styles and self.styles[-1][0] is top:
            self.styles[-1].append(data)
        blank = not _SPACE.sub("", data)
        if top.tag == "head" and not blank:
            self._cut(len(self.stack) - 1)
        if not blank or self.stack[-1].tag not in TABLE_PARTS:
            home = self._home("#text")
            if len(self.stack) <= DEPTH:
                home.append(data)
            else:
                text = Node("#text", under=top)
                text.children.append(data)
                home.append(text)


class _Before(list):
    """Appending puts the child in front of the table."""

    def __init__(self, front: list, table: Node) -> None:
        super().__init__()
        self.front, self.table = front, table

    def append(self, child: object) -> None:
        at = next((i for i in range(len(self.front) - 1, -1, -1) if self.front[i] is self.table), len(self.front))
        self.front.insert(at, child)


def _not(value: bool | None) -> bool | None:
    return None if value is None else not value


def _holds(condition: str, feature: Callable[[str], bool | None]) -> bool | None:
    """A condition of features in brackets with not, and, or; None if unknown."""
    words = _GROUP.findall(condition)
    values = [_holds(w[1:-1], feature) if re.match(r"\s*(\(|not\b)", w[1:-1]) else feature(w[1:-1].strip())
              for w in words if w[0] == "("]
    if not values:
        return None
    if words[0] == "not":
        return _not(values[0]) if len(values) == 1 else None
    sure = "or" in words  # the value that decides alone
    return sure if sure in values else None if None in values else not sure


def _number(text: str) -> float | None:
    found = re.fullmatch(r"([+-]?(?:\d+\.?\d*|\.\d+))([a-z]*)(?:\s*/\s*(\d+))?", text.strip())
    if not found or found[2] not in _UNITS or found[3] and not int(found[3]):
        return None
    return float(found[1]) * _UNITS[found[2]] / int(found[3] or 1)


def _feature(text: str) -> bool | None:
    """Whether the screen has a media feature: name, name: value, or a range."""
    name, colon, value = (x.strip() for x in text.partition(":"))
    if colon:
        side = re.match(r"(-webkit-)?(min|max)-", name)
        has = SCREEN.get(name.replace(side[0], side[1] or "", 1) if side else name)
        if has is None or isinstance(has, str):
            return None if has is None or side else has == value
        asked = _number(value)
        return None if asked is None else has >= asked if side and side[2] == "min" else has <= asked if side else has == asked
    parts = re.split(r"\s*(<=|>=|<|>|=)\s*", text)
    if len(parts) == 1:
        has = SCREEN.get(name)
        return None if has is None else has not in (0, "none", "no-preference")
    values = [SCREEN.get(p, _number(p)) for p in parts[::2]]
    if any(v is None or isinstance(v, str) for v in values):
        return None
    compare = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__, "=": float.__eq__}
    return all(compare[c](float(x), float(y)) for x, c, y in zip(values, parts[1::2], values[1:], strict=False))


def applies(media: str) -> bool:
    """Whether one of a list of media queries holds for the screen; an unknown one does not."""
    return not media.strip() or any(map(_query, media.lower().split(",")))


def _query(query: str) -> bool:
    found = re.fullmatch(r"\s*(?:(not|only)\s+)?([a-z-]+)(?:\s+and\b(.*))?\s*", query, re.S)
    if not found:
        return _holds(query, _feature) is True
    holds = found[2] in ("all", "screen") and (found[3] is None or _holds(found[3], _feature))
    return (_not(holds) if found[1] == "not" else holds) is True


def _block(head: str) -> bool:
    """Whether the rules of an at-rule's block apply."""
    name, rest = re.match(r"@([\w-]*)(.*)", head, re.S).groups()
    if name.lower() == "supports":
        return _holds(rest.lower(), lambda x: not re.match(r"-(ms|moz|o)-", x)) is True
    return name.lower() == "layer" or name.lower() == "media" and applies(rest)


def _declarations(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and one declaration each, of the rules that apply; rules inside rules do not count."""
    css = _IGNORED.sub(" ", css)
    open_, at = [("", True)], 0
    for found in re.finditer(r"[{};]|\Z", css):
        head, at = css[at:found.start()].strip(), found.end()
        names, on = open_[-1]
        if found[0] == "{":
            open_.append((names, on and _block(head)) if head.startswith("@") else (head, on and not names))
            continue
        if on and names and head:
            yield names, head
        if found[0] == "}" and len(open_) > 1:
            open_.pop()


def hiding_rules(styles: list[str]) -> dict[str, list[tuple]]:
    """Display and visibility that style sheets give to compound selectors (tag, .class, #id, or several of them), by one
    of the names: (tag, other names, property, weight, value)."""
    found: dict[str, list[tuple]] = {}
    for order, (selectors, text) in enumerate(x for css in styles if re.search("display|visibility", css, re.I)
                                              for x in _declarations(css)):
        for name, important, value in _declared(text):
            for selector in map(str.strip, selectors.split(",")):
                got = _COMPOUND.fullmatch(selector)
                if got and selector:
                    tag, marks = (got[1] or "*").lower(), re.findall(r"[.#][\w-]+", got[2])
                    ids = sum(m[0] == "#" for m in marks)
                    weight = (important, 0, ids, len(marks) - ids, tag != "*", order)
                    found.setdefault(marks[0] if marks else tag, []).append((tag, frozenset(marks), name, weight, value))
    return found


def _declared(style: str) -> Iterator[tuple[str, bool, str]]:
    """Valid display and visibility declarations: property, whether important, and what it does."""
    for text in style.lower().split(";"):
        name, _, value = (x.strip() for x in text.partition(":"))
        short = re.sub(r"\s*!\s*important$", "", value)
        value, important = " ".join(short.split()), short != value
        if name == "display":
            kind = {"none": "none", "revert": "", "revert-layer": ""}.get(value, "shown" if _DISPLAY.fullmatch(value) else None)
        elif name == "visibility":
            kind = {"hidden": "visibility", "collapse": "visibility", "visible": "shown", "initial": "shown", "inherit": "",
                    "unset": "", "revert": "", "revert-layer": ""}.get(value)
        else:
            continue
        if kind is not None:
            yield name, important, kind


def width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of a box: inline text with collapsed white space, and blocks with at most one empty line between."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space, self.gap = False, False

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self._add(first)
            for line in rest:
                self.line(True)
                self._add(line)
            return
        words = _SPACE.split(data)
        for i, word in enumerate(words):
            if i:
                self.space = True
            if word:
                self._add((" " if self.space and self.parts else "") + word)
                self.space = False

    def _add(self, text: str) -> None:
        if text:
            self.parts.append(text)

    def line(self, even_empty: bool = False) -> None:
        """End the line; an empty one only counts when it was asked for."""
        if self.parts or even_empty:
            self.put(["".join(self.parts).rstrip(" \t")])
        self.parts, self.space = [], False

    def put(self, lines: list[str]) -> None:
        if lines:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            self.lines += lines

    def block(self, lines: list[str], gap: bool) -> None:
        self.edge(gap)
        self.put(lines)
        self.gap = gap

    def edge(self, gap: bool) -> None:
        self.line()
        self.gap = self.gap or gap

    def done(self) -> list[str]:
        self.line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


class Renderer:
    def __init__(self, rules: dict[str, list[tuple]]) -> None:
        self.rules, self.below = rules, {}

    def hiding(self, node: Node) -> str:
        """Whether an element is hidden or shown again, by itself or by the elements that it became a sibling of."""
        if node.under is None:
            return self._own(node)
        chain, at = [], node
        while at is not None and at not in self.below:
            chain.append(at)
            at = at.under
        for at in reversed(chain):
            outer = self.below[at.under] if at.under else ""
            closed = at.under and at.under.tag == "details" and "open" not in at.under.attrs and at.tag != "summary"
            self.below[at] = "display" if outer == "display" or closed else self._own(at) or outer
        return self.below[node]

    def _own(self, node: Node) -> str:
        """By the cascade: importance, inline before rules, ids, classes, tags, order."""
        if node.tag in HIDDEN or node.attrs.get("hidden", "").lower() == "until-found":
            return "display"
        best: dict[str, tuple] = {}
        if self.rules and node.tag != "#text":
            marks = {"." + c for c in node.attrs.get("class", "").split()} | {"#" + node.attrs.get("id", "")}
            for key in (node.tag, "*", *marks):
                for tag, need, name, weight, value in self.rules.get(key, ()):
                    if tag in ("*", node.tag) and need <= marks:
                        best[name] = max(best.get(name, ()), (weight, value))
        if "style" in node.attrs:
            for order, (name, important, value) in enumerate(_declared(_IGNORED.sub(" ", node.attrs["style"]))):
                best[name] = max(best.get(name, ()), ((important, 1, 0, 0, 0, order), value))
        display = best["display"][1] if "display" in best else ""
        if display == "none" or not display and (
                "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs):
            return "display"
        return best["visibility"][1] if "visibility" in best else ""

    def inside(self, node: Node, flow: Flow, pre: bool, shown: bool, listed: bool = False) -> None:
        closed = node.tag == "details" and "open" not in node.attrs
        chosen = self._chosen(node) if node.tag == "select" else None
        for child in node.children:
            if isinstance(child, str):
                if shown and not closed and chosen is None:
                    flow.text(child, pre)
            elif chosen is not None:
                if child is chosen or child.tag == "optgroup":
                    for option in [child] if child is chosen else [o for o in child.children if o is chosen]:
                        self.inside(option, flow, pre, shown)
            elif not closed or child.tag == "summary":
                self.element(child, flow, pre, shown, listed)

    @staticmethod
    def _chosen(node: Node) -> Node:
        options = [o for c in node.children if isinstance(c, Node)
                   for o in (c.children if c.tag == "optgroup" else [c]) if isinstance(o, Node) and o.tag == "option"]
        return next((o for o in options if "selected" in o.attrs), options[0] if options else node)

    def box(self, node: Node, pre: bool, shown: bool, listed: bool = False) -> list[str]:
        flow = Flow()
        self.inside(node, flow, pre, shown, listed)
        return flow.done()

    def element(self, node: Node, flow: Flow, pre: bool, shown: bool, listed: bool) -> None:
        tag, hiding = node.tag, self.hiding(node)
        if hiding == "display":
            return
        shown = hiding == "shown" or shown and hiding != "visibility"
        if tag == "br":
            flow.line(True)
        elif tag in ("ul", "ol", "menu"):
            flow.block(self.items(node, pre, shown), not listed)
        elif tag == "li":
            flow.block(self.item(node, "- ", pre, shown), False)
        elif tag == "table":
            flow.block(self.table(node, pre, shown), True)
        elif tag in ("dd", "blockquote"):
            flow.block(["  " + x if x else "" for x in self.box(node, pre, shown)], tag == "blockquote")
        elif tag in ("pre", "textarea"):
            lines = self.box(node, True, shown)
            flow.block(lines[1:] if lines and not lines[0] else lines, tag == "pre")
        elif tag in BLOCKS:
            flow.edge(tag in SPACED)
            self.inside(node, flow, pre, shown, listed)
            flow.edge(tag in SPACED)
        elif tag != "wbr":
            self.inside(node, flow, pre, shown, listed)

    def item(self, node: Node, mark: str, pre: bool, shown: bool) -> list[str]:
        lines = self.box(node, pre, shown, True) or [""]
        if not shown and lines == [""]:
            return []
        return [(mark + lines[0]).rstrip(), *[" " * len(mark) + x if x else "" for x in lines[1:]]]

    def items(self, node: Node, pre: bool, shown: bool) -> list[str]:
        """Bullets or numbers; start, reversed and value are respected."""
        flow = Flow()
        count = sum(isinstance(c, Node) and c.tag == "li" and self.hiding(c) != "display" for c in node.children)
        step = -1 if "reversed" in node.attrs else 1
        number = _whole(node.attrs.get("start"), count if step < 0 else 1)
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                hiding = self.hiding(child)
                if hiding == "display":
                    continue
                number = _whole(child.attrs.get("value"), number)
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += step
                flow.block(self.item(child, mark, pre, hiding == "shown" or shown and hiding != "visibility"), False)
            elif isinstance(child, Node):
                lines = Flow()
                self.element(child, lines, pre, shown, True)
                flow.block(["  " + x if x else "" for x in lines.done()], False)
            elif shown:
                flow.text(child, pre)
        return flow.done()

    def table(self, node: Node, pre: bool, shown: bool) -> list[str]:
        """Caption, then rows: header sections first, footer sections last. Cells start where their column starts;
        cells over several rows or columns keep their places free."""
        out, rows = [], {"thead": [], "tbody": [], "tfoot": []}
        for part in node.children:
            if not isinstance(part, Node) or self.hiding(part) == "display":
                continue
            if part.tag == "caption":
                out += self.box(part, pre, shown)
            elif part.tag in SECTIONS:
                rows[part.tag] += [r for r in part.children
                                   if isinstance(r, Node) and r.tag == "tr" and self.hiding(r) != "display"]
        grid, busy = [], {}
        for row in [*rows["thead"], *rows["tbody"], *rows["tfoot"]]:
            shown_row = shown and self.hiding(row) != "visibility"
            column, placed = 0, []
            for cell in row.children:
                if not isinstance(cell, Node) or cell.tag not in ("td", "th") or self.hiding(cell) == "display":
                    continue
                while busy.get(column):
                    column += 1
                across = min(1000, max(1, _whole(cell.attrs.get("colspan"), 1)))
                down = max(1, _whole(cell.attrs.get("rowspan"), 1))
                lines = self.box(cell, pre, shown_row and self.hiding(cell) != "visibility")
                placed.append((column, across, lines))
                for c in range(column, column + across):
                    busy[c] = max(busy.get(c, 0), down)
                column += across
            busy = {c: n - 1 for c, n in busy.items() if n > 1}
            grid.append(placed)
        widest: dict[int, int] = {}
        for column, across, lines in (x for placed in grid for x in placed):
            fits = [w for w in map(width, lines) if w <= ALIGN]
            if across == 1 and fits:
                widest[column] = max(widest.get(column, 0), *fits)
        for placed in grid:
            for i in range(max((len(lines) for *_, lines in placed), default=0)):
                text, at = "", 0
                for column, _, lines in placed:
                    start = sum(widest.get(c, 0) + 2 for c in range(column) if c in widest)
                    if i < len(lines) and lines[i]:
                        text += " " * max(start - at, 2 if text else 0) + lines[i]
                        at = max(at + 2 if at else 0, start) + width(lines[i])
                out.append(text)
        while out and not out[-1]:
            out.pop()
        return out


def _whole(value: str | None, otherwise: int) -> int:
    found = re.match(r"\s*(-?\d{1,9})", value or "")
    return int(found[1]) if found else otherwise


def render(html: str) -> str:
    """All visible text of a page, in lines."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    renderer = Renderer(hiding_rules(["".join(parts) for _, *parts in builder.styles]))
    if renderer.hiding(builder.root) == "display":
        return ""
    lines = renderer.box(builder.root, False, renderer.hiding(builder.root) != "visibility")
    first = next((i for i, x in enumerate(lines) if x), len(lines))
    return "\n".join(lines[first:])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if h is None else render(h) for h in (x.as_py() for x in batch.column(0))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())],
                                         names=[*batch.schema.names[1:], "text"])


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", text_name: str = "text") -> DataFrame:
    """The columns `keep` of every page with its visible text.

    Blocks begin on a line of their own; paragraphs, headings, lists, quotations and tables have an empty line around
    them. List items have bullets or their numbers, nested lists are indented. Table cells start at the same place in
    all rows, unless they are wider than `ALIGN`. White space is collapsed outside preformatted text. Hidden are
    scripts and other elements without text, `hidden`, closed dialogs and details, and what inline styles and the rules of
    style sheets for tags, classes and ids give `display: none` or `visibility: hidden` in the end: by importance, then
    inline, specificity and order. Media queries are read for a desktop screen (`SCREEN`); selectors with combinators,
    attributes or pseudo-classes and rules inside rules are ignored, layers count in their order.

    Defined cases: a null page has a null text; an empty page or one without visible text an empty one; broken markup is
    repaired by implied tags; pages nested deeper than `DEPTH` keep their text, and what
    is hidden there stays hidden; repeated rows and nulls elsewhere pass through; other columns are ignored.
    """
    place = [f"_k{i}" for i in range(len(keep))]
    rows = pages.select(F.col(html_col).alias("_html"), *[F.col(c).alias(p) for c, p in zip(keep, place, strict=True)])
    kinds = "".join(f"{p} {pages.schema[c].dataType.simpleString()}, " for c, p in zip(keep, place, strict=True))
    made = spread(rows, *place[:1]).mapInArrow(_texts, f"{kinds}text string")
    return made.select(*[F.col(p).alias(c) for c, p in zip(keep, place, strict=True)], F.col("text").alias(text_name))
