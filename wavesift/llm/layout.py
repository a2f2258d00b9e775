"""HTML extraction by layout: a tree builder, visibility rules and a renderer.

``parse`` builds the tree with the tags that HTML implies (an open paragraph ends at the
next block, an item at the next item, a cell outside a row gets one). ``render``
walks it without recursion and writes all text a reader would see:

* blocks on their own lines, paragraphs and headings apart by an empty line;
* white space folded, except in preformatted text;
* list items with ``-`` or their number (``start``, ``reversed`` and ``value`` count), nested ones indented;
* table cells padded to their column's width on a screen, where a wide character takes two places, with their row and
  column spans. Cells with others to the right are folded at ``CELL`` characters, between words; a longer word
  sticks out of its column in its own line.

Not shown: heads, scripts, styles, templates, embedded media; what is ``hidden``, or not
displayed by its style attribute or a rule of a style sheet whose selector is a tag, an id,
classes, or some of these together (``p.a#b``), also below others (``div p``, ``ul > li``); rules that look at
siblings, attributes or states don't count; closed details beyond their summary. ``visibility`` is inherited and can be turned on again.
Rules for other media than a screen ``WIDTH`` pixels wide don't count; where a condition isn't
known, rules can show but not hide. ``display`` of any value counts: the style attribute
wins over ids, they over more and fewer classes, they over tags, later rules over earlier
ones, and ``!important`` over all others.

Nulls: a null page has an empty text. A tag that never ends drops the rest. Repeated
rows are rendered alike. Work grows with the length of a page (with its logarithm for cells that span rows), whatever its
tags are; an element looks at the rules whose rarest part it has.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from html import unescape
from itertools import accumulate
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wavesift.llm.rows import with_columns

#: Characters of a line of a cell that has others to its right.
CELL = 80
#: Values of display and visibility that hide.
HIDING = frozenset("none hidden collapse".split())
#: Width of the reader's screen in pixels, and pixels of the units of a media query.
WIDTH = 1280
UNITS = {"px": 1, "em": 16, "rem": 16}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title datalist audio video canvas object param".split())
IN_HEAD = frozenset("base link meta script style template title noscript".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol menu dl table figure fieldset hr".split())
LINES = frozenset("html body address article aside details div dd dt fieldset figcaption footer form header hgroup legend li main nav section summary caption option optgroup center dialog search tr td th thead tbody tfoot".split())
BLOCKS = PARAGRAPHS | LINES
TABLE_PARTS = frozenset("caption thead tbody tfoot tr td th".split())
#: What a start tag ends: (open tags that end, tags that keep them open beyond).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
_P_ENDS = ({"p"}, {"td", "th", "caption", "button", "table", "object", "template"})

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
# a string that doesn't end goes to the end of its line
_STRING = r""""(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?"""
_COMMENT = re.compile(rf"({_STRING})|/\*.*?(?:\*/|\Z)|<!--|-->", re.DOTALL)
_PIECE = re.compile(rf"((?:{_STRING}|[^{{}};])*+)([{{}};]|\Z)", re.DOTALL)
_SIMPLE = re.compile(r"(?=.)(?:[a-z][a-z0-9]*|\*)?(?:[.#][a-z_][\w-]*)*$")
_PART = re.compile(r"[.#]?[\w-]+")
_DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?")
_FEATURE = re.compile(r"\(\s*(min|max)-(?:device-)?width\s*:\s*([0-9]+(?:\.[0-9]+)?)(px|em|rem)\s*\)")


class Node:
    __slots__ = ("tag", "attributes", "children", "ended")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.ended = tag, attributes, [], False


def _tag_end(text: str, at: int, last: dict[str, int]) -> int:
    """Place of the ``>`` that ends the tag at ``at``, outside quoted values; -1 if none."""
    equals = False
    i, n = at, len(text)
    while i < n:
        c = text[i]
        if c == ">":
            return i
        if equals and c in "\"'" and last[c] > i:
            i = text.index(c, i + 1)
        equals = c == "=" or (equals and c.isspace())
        i += 1
    return -1


def tokens(text: str):
    """(kind, name, attributes or text) of a page: text, raw, start or end."""
    last = {q: text.rfind(q) for q in "\"'"}
    at, n = 0, len(text)
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            yield "text", "", text[at:]
            return
        if lt > at:
            yield "text", "", text[at:lt]
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif text[lt + 1 : lt + 2] in ("!", "?"):
            end = text.find(">", lt)
            at = n if end < 0 else end + 1
        elif (m := _NAME.match(text, lt)) is None:
            yield "text", "", "<"
            at = lt + 1
        else:
            end = _tag_end(text, m.end(), last)
            if end < 0:
                return
            name = m[1].lower()
            at = end + 1
            if text[lt + 1] == "/":
                yield "end", name, None
                continue
            inner = text[m.end() : end]
            yield "start", name, {a.lower(): unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(inner)} if inner else {}
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(text, at)
                stop = close.start() if close else n
                yield "raw", name, text[at:stop]
                at = stop


class Builder:
    """The open elements and the tree made of them.

    Places of the open elements are known by tag, so that no end tag looks through all
    of them. An inline element that ends before a block inside it stays in its place,
    marked, until the block ends.
    """

    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list, html=[0])
        self.blocks = [0]
        self.sheet: list[str] = []

    def last(self, tags) -> int:
        """Place of the innermost open element with one of the tags, 0 if none."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def push(self, tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        self.places[tag].append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(node)

    def pop(self) -> None:
        tag = self.open.pop().tag
        self.places[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
        while self.open[-1].ended:
            self.open.pop()

    def cut(self, place: int) -> None:
        """End the element at a place and all inside it."""
        while len(self.open) > place:
            self.pop()

    def end_open(self, ending, kept) -> None:
        """Close the outermost of ``ending`` (a single tag: the innermost) inside the innermost of ``kept``."""
        border = self.last(kept)
        found = []
        for tag in ending:
            places = self.places[tag]
            if places and places[-1] > border:
                found.append(places[-1] if len(ending) == 1 else places[bisect_right(places, border)])
        if found:
            self.cut(min(found))

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if self.places["head"]:
                self.end_open({"head"}, ())
            self.open[0].attributes |= attributes
            return
        if self.places["head"] and tag not in IN_HEAD and self.open[-1].tag == "head":
            self.pop()
        if tag in BLOCKS and self.places["p"] and tag not in TABLE_PARTS:
            self.end_open(*_P_ENDS)
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        elif tag[0] == "h" and tag[1:].isdigit() and self.open[-1].tag[0] == "h" and self.open[-1].tag[1:].isdigit():
            self.pop()
        if tag in ("td", "th") and self.places["table"] and self.open[-1].tag != "tr":
            self.push("tr", {})
        if tag in VOID:
            self.open[-1].children.append(Node(tag, attributes))
        else:
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        if tag in ("html", "body", "br") or (not self.places[tag] and tag != "p"):
            return
        if not self.places[tag]:
            self.open[-1].children.append(Node("p", {}))
            return
        place = self.places[tag][-1]
        cell = {"td", "th", "caption"} if tag not in TABLE_PARTS and tag != "table" else {"table"} if tag != "table" else ()
        if self.last(cell) > place:
            return
        if tag not in BLOCKS and self.blocks[-1] > place:
            # an inline element that a block outlives
            self.open[place].ended = True
            self.places[tag].pop()
        else:
            self.cut(place)

    def text(self, value: str) -> None:
        if self.open[-1].tag == "head":
            if value.isspace():
                return
            self.pop()
        self.open[-1].children.append(value)


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page and the texts of its style sheets."""
    tree = Builder()
    for kind, name, value in tokens(page):
        if kind == "text":
            tree.text(unescape(value))
        elif kind == "start":
            tree.start(name, value)
        elif kind == "end":
            tree.end(name)
        elif name == "style":
            tree.sheet.append(value)
        elif name not in UNSEEN:
            tree.text(unescape(value) if name == "textarea" else value)
    return tree.root, tree.sheet


def _on_screen(query: str) -> bool | None:
    """Whether a list of media queries fits the screen; None if not known."""
    fits: list[bool | None] = []
    for one in query.lower().split(","):
        parts = [p.strip() for p in re.split(r"\band\b", one)]
        kind = parts[0].removeprefix("only ")
        if kind in ("", "all", "screen", "not print"):
            parts = parts[1:]
        elif re.fullmatch(r"[a-z-]+|not (?:all|screen)", kind) and (len(parts) == 1 or not kind.startswith("not")):
            fits.append(False)
            continue
        found = [_FEATURE.fullmatch(p) for p in parts]
        known = [WIDTH >= float(m[2]) * UNITS[m[3]] if m[1] == "min" else WIDTH <= float(m[2]) * UNITS[m[3]] for m in found if m]
        fits.append(False if False in known else True if len(known) == len(parts) else None)
    return True if True in fits else None if None in fits else False


def _applies(prelude: str) -> bool | None:
    """Whether the rules in the block of an at-rule apply; None if not known."""
    name = re.match(r"@([\w-]*)", prelude)[1].lower()
    rest = prelude[len(name) + 1 :].strip()
    if name == "media":
        return _on_screen(rest)
    if name == "supports":
        return None if re.search(r"\bnot\b", rest.lower()) else True
    return True if name == "layer" else None if name in ("container", "scope") else False


class Rule:
    """A selector: its steps (whether the one before must be the parent, and its parts), rank, and what it declares."""

    __slots__ = ("steps", "rank", "declared")

    def __init__(self, steps: list[tuple[bool, frozenset[str]]]):
        every = [p for _, parts in steps for p in parts]
        self.steps, self.declared = steps, {}
        self.rank = sum(p[0] == "#" for p in every), sum(p[0] == "." for p in every), sum(p != "*" for p in every)


def _steps(selector: str) -> list[tuple[bool, frozenset[str]]] | None:
    """The steps of a selector from the outermost on; None if it looks at more than elements around."""
    out, child = [], False
    for piece in selector.lower().replace(">", " > ").split():
        if piece == ">":
            if child or not out:
                return None
            child = True
        elif not _SIMPLE.match(piece):
            return None
        else:
            out.append((child, frozenset(_PART.findall(piece)) or frozenset("*")))
            child = False
    return None if child else out


class Cascade:
    """Rules by the rarest part of each of their steps, and the steps that the open elements fulfil."""

    def __init__(self, rules: list[Rule]):
        often = Counter(p for r in rules for _, parts in r.steps for p in parts)
        self.steps: dict[str, list[tuple[Rule, int]]] = defaultdict(list)
        for r in rules:
            for i, (_, parts) in enumerate(r.steps):
                self.steps[min(parts, key=lambda p: (often[p], p))].append((r, i))
        self.around: Counter[tuple[int, int]] = Counter()
        self.path: list[set[tuple[int, int]]] = [set()]

    def met(self, node: Node) -> tuple[set[tuple[int, int]], list[Rule]]:
        """Steps that an element fulfils inside the open ones, and the rules whose last step is one."""
        if not self.steps:
            return set(), []
        a = node.attributes
        names = {"*", node.tag, *("." + c for c in a.get("class", "").lower().split()), "#" + a.get("id", "").lower()}
        found, whole = set(), []
        for name in names & self.steps.keys():
            for rule, i in self.steps[name]:
                child, parts = rule.steps[i]
                before = (id(rule), i - 1)
                if parts <= names and (i == 0 or (before in self.path[-1] if child else self.around[before] > 0)):
                    found.add((id(rule), i))
                    if i + 1 == len(rule.steps):
                        whole.append(rule)
        return found, whole

    def enter(self, steps: set[tuple[int, int]]) -> None:
        self.path.append(steps)
        self.around.update(steps)

    def leave(self) -> None:
        self.around.subtract(self.path.pop())


def _rules(sheets: list[str]) -> list[Rule]:
    """Rules with value, whether important, and place of each property that counts."""
    out: dict[tuple, Rule] = {}
    place = 0
    for sheet in sheets:
        # for each open block its rules, whether it applies with all around it, and whether it is in a rule
        blocks: list[tuple[list[Rule], bool | None, bool]] = []
        for m in _PIECE.finditer(_COMMENT.sub(lambda c: c[1] or " ", sheet)):
            text, end = _SPACES.sub(" ", m[1]).strip(), m[2]
            rules, applies, inside = blocks[-1] if blocks else ([], True, False)
            if end != "{" and text and rules and applies is not False:
                for name, (value, important) in _style(text).items():
                    if applies is None and value in HIDING:
                        continue
                    for r in rules:
                        if name not in r.declared or important >= r.declared[name][1]:
                            r.declared[name] = (value, important, place)
                place += 1
            if end == "{" and text.startswith("@"):
                fits = _applies(text)
                blocks.append(([], False if False in (fits, applies) else None if None in (fits, applies) else True, inside))
            elif end == "{":
                # a rule inside another one looks at more than elements around
                found = [] if inside else [steps for x in text.split(",") if (steps := _steps(x))]
                blocks.append(([out.setdefault(tuple(steps), Rule(steps)) for steps in found], applies, True))
            elif end == "}" and blocks:
                blocks.pop()
    return [r for r in out.values() if r.declared]


def _style(text: str) -> dict[str, tuple[str, bool]]:
    """Last value of display and visibility, and whether it is important."""
    out: dict[str, tuple[str, bool]] = {}
    for name, value, important in _DECLARED.findall(text.lower()):
        if name not in out or bool(important) >= out[name][1]:
            out[name] = (value, bool(important))
    return out


class Writer:
    """Lines of text with folded white space and breaks that don't add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = 0
        self.marker = ""

    def _ready(self) -> None:
        if not self.parts:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            # a marker stands in the last two columns of the indent
            self.parts.append(" " * (self.indent - 2) + self.marker if self.marker else " " * self.indent)
            self.marker = ""
            self.space = False

    def text(self, value: str) -> None:
        pieces = _SPACES.split(value)
        for k, piece in enumerate(pieces):
            if k:
                self.space = True
            if piece:
                new = not self.parts
                self._ready()
                if self.space and not new:
                    self.parts.append(" ")
                self.space = False
                self.parts.append(piece)

    def verbatim(self, value: str) -> None:
        for k, line in enumerate(value.replace("\r\n", "\n").split("\n")):
            if k:
                self.line(always=True)
            if line:
                self._ready()
                self.parts.append(line)

    def line(self, always: bool = False) -> None:
        """End the line; ``always`` also where it is empty."""
        if self.parts or (always and self.lines):
            self.lines.append("".join(self.parts).rstrip(" "))
            self.parts = []
        self.space = False

    def row(self, line: str) -> None:
        self.line()
        self._ready()
        self.parts.append(line)

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def result(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n").replace("\xa0", " ")


def _folded(line: str) -> list[str]:
    """A line cut between words where it is longer than CELL."""
    out, at = [], 0
    while len(line) - at > CELL:
        cut = line.rfind(" ", at, at + CELL + 1)
        if cut <= at:
            cut = line.find(" ", at + CELL)
            if cut < 0:
                break
        out.append(line[at:cut])
        at = cut + 1
    return [*out, line[at:]]


def _wide(line: str) -> int:
    """Places of a line on a screen."""
    return len(line) if line.isascii() else sum(2 if east_asian_width(c) in "WF" else not combining(c) for c in line)


class Taken:
    """Last row, by column, that cells from above take; halves of halves of the columns, made where they are needed."""

    SIZE = 1 << 40

    def __init__(self):
        self.least: dict[int, int] = {}
        self.whole: set[int] = set()

    def take(self, first: int, end: int, row: int) -> None:
        """Columns are taken up to a row, those that are taken for longer as long as they are."""
        stack, above = [(1, 0, self.SIZE)], []
        while stack:
            node, lo, hi = stack.pop()
            if end <= lo or hi <= first:
                continue
            plain = node in self.whole or node not in self.least
            if plain and first <= lo and hi <= end:
                self.least[node] = max(self.least.get(node, -1), row)
                self.whole.add(node)
                continue
            if node in self.whole:
                self.whole.discard(node)
                for half in (2 * node, 2 * node + 1):
                    self.least[half] = self.least[node]
                    self.whole.add(half)
            above.append(node)
            middle = (lo + hi) // 2
            stack += [(2 * node, lo, middle), (2 * node + 1, middle, hi)]
        for node in reversed(above):
            self.least[node] = min(self.least.get(2 * node, -1), self.least.get(2 * node + 1, -1))

    def free(self, first: int, row: int) -> int:
        """The first column from ``first`` on that no cell from above takes in a row."""
        stack = [(1, 0, self.SIZE)]
        while stack:
            node, lo, hi = stack.pop()
            if hi <= first or self.least.get(node, -1) >= row:
                continue
            if node in self.whole or node not in self.least:
                return max(lo, first)
            middle = (lo + hi) // 2
            stack += [(2 * node + 1, middle, hi), (2 * node, lo, middle)]
        raise ValueError("no column is free")


class Table:
    def __init__(self):
        self.rows: list[list[tuple[str, int, int]]] = []
        self.caption = ""

    def cell(self, text: str, span: int, down: int) -> None:
        """A cell that spans so many columns and rows; 0 rows for all that follow."""
        if not self.rows:
            self.rows.append([])
        self.rows[-1].append((text, span, down))

    def _placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """Column, span and lines of the cells of each row; a cell from above keeps its columns."""
        out, taken = [], Taken()
        for nth, row in enumerate(self.rows):
            cells, at = [], 0
            for k, (text, span, down) in enumerate(row):
                at = taken.free(at, nth) if taken.least else at
                lines = text.split("\n")
                if k + 1 < len(row):
                    lines = [x for line in lines for x in _folded(line)]
                cells.append((at, span, lines))
                if down != 1:
                    taken.take(at, at + span, nth + down - 1 if down else len(self.rows))
                at += span
            out.append(cells)
        return out

    def lines(self) -> list[str]:
        """Rows with aligned columns; a row is as high as its highest cell."""
        placed = self._placed()
        width: dict[int, int] = defaultdict(int)
        fitting = lambda lines: max((w for x in lines if (w := _wide(x)) <= CELL), default=0)
        for cells in placed:
            for at, span, lines in cells:
                if span == 1:
                    width[at] = max(width[at], fitting(lines))
        # only columns with a width move those behind them
        some = sorted(c for c, w in width.items() if w)
        upto = [0, *accumulate(width[c] + 2 for c in some)]
        begin = lambda column: upto[bisect_left(some, column)]
        # a cell over several columns widens the last of them where they are too narrow
        more: dict[int, int] = defaultdict(int)
        for cells in placed:
            for at, span, lines in cells[:-1]:
                if span > 1:
                    more[at + span] = max(more[at + span], fitting(lines) + 2 - (begin(at + span) - begin(at)))
        wider = sorted(c for c, n in more.items() if n)
        moved = [0, *accumulate(more[c] for c in wider)]
        start = lambda column: begin(column) + moved[bisect_right(wider, column)]
        out = self.caption.split("\n") if self.caption else []
        for cells in placed:
            begins = [start(at) for at, _, _ in cells]
            for k in range(max((len(lines) for _, _, lines in cells), default=0)):
                line, size = [], 0
                for left, (_, _, lines) in zip(begins, cells):
                    if k < len(lines) and lines[k]:
                        gap = left - size if size <= left - 2 or not left else 2
                        line += [" " * gap, lines[k]]
                        size += gap + _wide(lines[k])
                out.append("".join(line).rstrip(" "))
        return out


def _number(text: str | None, default: int, most: int) -> int:
    """A whole number as attributes have it, between -most and most."""
    m = re.match(r"[ \t\n\f\r]*([+-]?[0-9]+)", text or "")
    if m is None:
        return default
    return max(-most, min(int(m[1][:20]), most))


def _shown(node: Node, visible: bool, rules: list[Rule]) -> tuple[bool, bool]:
    """Whether a node is displayed at all, and whether its text is visible."""
    a = node.attributes
    # the last in this order wins: important, kind of selector, place
    none = (False, (-1, 0, 0), -1, "")
    found: dict[str, tuple[bool, tuple[int, int, int], int, str]] = {}
    for rule in rules:
        for what, (value, important, place) in rule.declared.items():
            found[what] = max(found.get(what, none), (important, rule.rank, place, value))
    if "style" in a:
        for what, (value, important) in _style(a["style"]).items():
            found[what] = max(found.get(what, none), (important, (1 << 30, 0, 0), 0, value))
    if "display" in found and found["display"][3] == "none":
        return False, visible
    if "visibility" in found and found["visibility"][3] in ("visible", "hidden", "collapse"):
        visible = found["visibility"][3] == "visible"
    return True, visible


def render(root: Node, sheets: list[str]) -> str:
    """The visible text of a tree."""
    cascade = Cascade(_rules(sheets))
    writers: list[Writer] = [Writer()]
    tables: list[Table] = []
    lists: list[list] = []  # ordered, next number, step
    pre = 0
    stack: list = [(root, True, False)]  # node, visible, leaving
    while stack:
        node, visible, leaving = stack.pop()
        w = writers[-1]
        if isinstance(node, str):
            if visible and pre:
                w.verbatim(node)
            elif visible:
                w.text(node)
            continue
        tag = node.tag
        gap = 2 if tag in PARAGRAPHS and not (tag in ("ul", "ol", "menu") and lists) else 1
        if leaving:
            cascade.leave()
            if tag in ("td", "th", "caption") and tables:
                text = writers.pop().result()
                if tag == "caption":
                    tables[-1].caption = text
                else:
                    a = node.attributes
                    span, down = _number(a.get("colspan"), 1, 1000), _number(a.get("rowspan"), 1, 65_534)
                    tables[-1].cell(text, span if span > 0 else 1, down if down >= 0 else 1)
                continue
            if tag == "table":
                for line in tables.pop().lines():
                    w.row(line)
            elif tag == "li":
                w.block(1)
                w.indent -= 2
                w.marker = ""
            elif tag in ("ul", "ol", "menu"):
                lists.pop()
                gap = 1 if lists else 2
            elif tag == "pre":
                pre -= 1
            if tag in BLOCKS:
                w.block(gap)
            continue

        if tag in UNSEEN or "hidden" in node.attributes or (tag == "dialog" and "open" not in node.attributes):
            continue
        steps, fitting = cascade.met(node)
        displayed, visible = _shown(node, visible, fitting)
        if not displayed:
            continue
        if tag == "br":
            w.line(always=True)
            continue
        if tag in ("td", "th", "caption") and tables:
            writers.append(Writer())
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in BLOCKS:
            w.block(gap)
        if tag == "table":
            tables.append(Table())
        elif tag == "li":
            w.marker = "- "
            if lists and lists[-1][0]:
                number = _number(node.attributes.get("value"), lists[-1][1], 10**18)
                w.marker = f"{number}. "
                lists[-1][1] = number + lists[-1][2]
            w.indent += 2
        elif tag in ("ul", "ol", "menu"):
            back = "reversed" in node.attributes
            first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if back else 1
            lists.append([tag == "ol", _number(node.attributes.get("start"), first, 10**18), -1 if back else 1])
        elif tag == "pre":
            pre += 1
        cascade.enter(steps)
        stack.append((node, visible, True))
        children = node.children
        if tag == "pre" and children and isinstance(children[0], str) and children[0][:1] == "\n":
            children = [children[0][1:], *children[1:]]
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        stack.extend((c, visible, False) for c in reversed(children))
    return writers[0].result()


def text_of(page: str) -> str:
    return render(*parse(page))


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add text (what a reader of the page sees), its n_chars and n_lines to every row."""

    def make():
        def compute(part):
            texts = [text_of(page or "") for page in part.column(html).to_pylist()]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(lines, pa.int64())]

        return compute

    return with_columns(pages, html, [("text", T.StringType()), ("n_chars", T.LongType()), ("n_lines", T.LongType())], make, keep)
