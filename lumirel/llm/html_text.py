"""Layout-aware rendering of HTML to text.

A tree builder closes the elements that HTML lets authors leave open; visibility rules drop what a
browser wouldn't show (head matter, scripts, hidden elements, by attribute, by inline style and by
simple rules of style sheets); a renderer folds the tree from its leaves up. Inline content runs
together with white space collapsed, blocks get lines of their own with blank lines where margins
are, list items get markers and indents, and table cells are aligned in columns. All visible text
is emitted, of navigation and footers too.

Defined cases: a null or empty html renders to an empty text; rows are rendered one by one, so repeated rows
and ids give equal texts, and an empty table no rows; other columns are left alone; markup without an end is text; if a quote in a tag never
ends, tags end at their first ">" from there on; unknown elements are inline; nesting of any
depth is folded without recursion, and time is in proportion to a page's length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Generator, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, text_batches

# Element names by what they do, fixed lists.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = set("head script style template noscript iframe noembed noframes object canvas defs symbol desc metadata audio video datalist title link base option".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul tr td th thead tbody tfoot caption".split()
)
MARGINS = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu dir".split())
CLOSES_P = BLOCKS - set("body html td th tr thead tbody tfoot caption dd dt li summary legend".split()) | set("dd dt li".split())
#: What an element's start closes, and the elements beyond which it doesn't look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
BARRIER = {"table", "td", "th", "caption", "html", "body", "template", "object"}
#: Blocks that render rows within them themselves, so that no table around them takes those.
HOLDS_ROWS = {"td", "th", "tr", "caption", "ul", "ol", "menu", "dir"}
#: Characters of the renderer's own, which texts can't have: a line break and a space to keep.
BREAK, KEPT = "\x00", "\x01"

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: What a tag holds after its name; nothing is tried twice.
_INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
#: A string that doesn't end goes to the end of what holds it, or in a sheet to the end of its line.
_STRING = re.compile(r"\"(?:[^\"\\]|\\.)*+(?:\"|\\?\Z)|'(?:[^'\\]|\\.)*+(?:'|\\?\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_BOX = re.compile(r"(?:^|[;{\s])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;{\s])visibility\s*:\s*(hidden|collapse|visible)", re.I)
_CSS = re.compile(r"\"(?:[^\"\\\n]|\\.)*+(?:\"|(?=\n)|\\?\Z)|'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\\?\Z)|[{};]", re.S)
_AT_RULE = re.compile(r"\s*+@")
_SCREEN = re.compile(r"(?:(?:only\s+)?(?:all|screen))?", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "items", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.items = name, attrs, []


def _on_screen(media: str) -> bool:
    """Whether a list of media holds on any screen, whatever its size."""
    return any(_SCREEN.fullmatch(x.strip()) for x in media.split(","))


def _uncommented(sheet: str) -> str:
    """A style sheet without its comments; one that doesn't end goes to the sheet's end."""
    parts, at = [], 0
    while (start := sheet.find("/*", at)) >= 0:
        parts.append(sheet[at:start])
        end = sheet.find("*/", start + 2)
        at = end + 2 if end >= 0 else len(sheet)
    return "".join([*parts, sheet[at:]])


def _hidden_by(sheet: str) -> tuple[set[str], set[str]]:
    """The simple selectors that a style sheet gives no box on any screen, and those that it makes invisible.

    Of nested bodies only those of layers and of media for all screens count; a rule within
    another rule says nothing of its selector elsewhere.
    """
    sheet = _uncommented(sheet)
    found: tuple[set[str], set[str]] = (set(), set())
    # Open blocks: whether they hold, the selectors of a rule (None of an at-rule), and declarations before nested blocks.
    blocks: list[tuple[bool, str | None, list[str]]] = []
    at, rule = 0, None
    for m in _CSS.finditer(sheet):
        if m[0] not in "{}":
            # A string, or the end of a declaration: part of what follows it, unless an at-rule ends.
            if rule is None:
                rule = _AT_RULE.match(sheet, at) is not None
            if m[0] == ";" and rule:
                at, rule = m.end(), None
            continue
        text = sheet[at : m.start()]
        if m[0] == "{":
            holds = not blocks or (blocks[-1][0] and blocks[-1][1] is None)
            if blocks:
                blocks[-1][2].append(text[: text.rfind(";") + 1])
                text = text if blocks[-1][1] is None else text[text.rfind(";") + 1 :]
            text = text.strip()
            if text.startswith("@"):
                media = re.fullmatch(r"@media\b(.*)", text, re.I | re.S)
                holds = holds and (_on_screen(media[1]) if media else re.match(r"@layer\b", text, re.I) is not None)
                blocks.append((holds, None, []))
            else:
                blocks.append((holds, text, []))
        else:
            if blocks:
                holds, selectors, parts = blocks.pop()
                if holds and selectors is not None:
                    declared = _STRING.sub("''", "".join(parts) + text)
                    seen = _VISIBILITY.findall(declared)
                    for own, hides in zip(found, (_NO_BOX.search(declared), seen and seen[-1].lower() != "visible"), strict=True):
                        if hides:
                            own.update(x for x in (y.strip() for y in selectors.split(",")) if re.fullmatch(r"[.#]?[\w-]+", x))
        at, rule = m.end(), None
    return found


def _tags(source: str) -> Generator[tuple[str, re.Match | None, str, int], int | None, None]:
    """(text, name match, inside, end) of a page: text before a tag, and the tag; the caller may send where to go on."""
    at, start, end, quotes = 0, 0, len(source), True
    last = source.rfind(">")
    while at < end:
        at = source.find("<", at)
        if at < 0 or at > last:
            break
        if source.startswith("<!--", at):
            stop = source.find("-->", at + 4)
            name, inside, after = None, "", stop + 3 if stop >= 0 else end
        elif source.startswith(("<!", "<?"), at):
            name, inside, after = None, "", source.find(">", at) + 1
        else:
            name = _NAME.match(source, at + 1)
            if not name:
                at += 1
                continue
            inside = _INSIDE.match(source, name.end())[0] if quotes else ""
            after = name.end() + len(inside)
            if not quotes or not source.startswith(">", after):
                quotes = False
                after = source.find(">", name.end())
                inside = source[name.end() : after]
            after += 1
        moved = yield source[start:at], name, inside, after
        at = start = after if moved is None else moved
    if start < end and not (source.startswith("<!--", start) and start > last):
        yield source[start:], None, "", end


def tree(source: str) -> tuple[Node, tuple[set[str], set[str]]]:
    """The tree of a page, and the selectors (name, .class, #id) that its style sheets give no box, or make invisible."""
    source = source.replace(BREAK, "").replace(KEPT, "")
    root = Node("#root", {})
    stack = [root]
    hidden: tuple[set[str], set[str]] = (set(), set())
    # Where on the stack the open elements of each name are.
    places: dict[str, list[int]] = {}

    def cut(i: int) -> None:
        for node in stack[i:]:
            places[node.name].pop()
        del stack[i:]

    def close(names: set[str], stop: set[str]) -> None:
        """Closes the outermost element of these names within the innermost of stop."""
        within = max((own[-1] for x in stop if (own := places.get(x))), default=0)
        first = min((own[k] for x in names if (own := places.get(x)) and (k := bisect_right(own, within)) < len(own)), default=0)
        if first:
            cut(first)

    tags = _tags(source)
    moved = None
    while True:
        try:
            text, m, inside, after = tags.send(moved)
        except StopIteration:
            break
        moved = None
        if text:
            stack[-1].items.append(text)
        if m is None:
            continue
        name = m[2].lower()
        if m[1]:
            own = places.get(name)
            if name == "br":
                stack[-1].items.append(Node("br", {}))
            elif own:
                stop = BARRIER - {name} if name in ("p", "li", "dd", "dt") else set()
                if own[-1] > max((places[x][-1] for x in stop if places.get(x)), default=0):
                    cut(own[-1])
            continue
        attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(inside)} if inside else {}
        if name in CLOSES_P:
            close({"p"}, BARRIER)
        if name in IMPLIED:
            close(*IMPLIED[name])
        elif name in BLOCKS and len(stack) > 1 and stack[-1].name == "head":
            cut(len(stack) - 1)
        node = Node(name, attrs)
        stack[-1].items.append(node)
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, after)
            # Behind an end tag without its bracket there is no other one.
            shut = source.find(">", stop.end()) if stop else -1
            body = source[after : stop.start() if shut >= 0 else len(source)]
            moved = shut + 1 if shut >= 0 else len(source)
            node.items.append(body)
            if name == "style" and _on_screen(attrs.get("media", "")):
                for known, more in zip(hidden, _hidden_by(body), strict=True):
                    known |= more
        elif name not in VOID:
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
    return root, hidden


def _selected(node: Node, selectors: set[str]) -> bool:
    a = node.attrs
    return bool(selectors) and (node.name in selectors or "#" + a.get("id", "") in selectors or any("." + c in selectors for c in a.get("class", "").split()))


def boxed(node: Node, hidden: tuple[set[str], set[str]]) -> bool:
    """Whether an element is rendered at all, its descendants included."""
    a = node.attrs
    if node.name in UNSEEN or "hidden" in a or (node.name == "dialog" and "open" not in a):
        return False
    return not ("style" in a and _NO_BOX.search(_STRING.sub("''", a["style"]))) and not _selected(node, hidden[0])


def invisible(node: Node, hidden: tuple[set[str], set[str]], inherited: bool) -> bool:
    """Whether an element's own text leaves its place empty; a descendant may be visible again."""
    own = _VISIBILITY.findall(_STRING.sub("''", node.attrs["style"])) if "style" in node.attrs else []
    return own[-1].lower() != "visible" if own else inherited or _selected(node, hidden[1])


class Block:
    """Lines of a finished block, or cells of a row; margin: whether blank lines set it apart."""

    __slots__ = ("cells", "lines", "margin", "node")

    def __init__(self, lines: list[str], margin: bool, node: Node | None = None, cells: list | None = None):
        self.lines, self.margin, self.node, self.cells = lines, margin, node, cells


def _flow(items: list) -> list[str]:
    """Lines of a sequence of inline strings and blocks; rows that follow each other share their columns."""
    lines: list[str] = []
    inline: list[str] = []
    rows: list[list] = []
    gap = False

    def put(new: list[str], margin: bool) -> None:
        nonlocal gap
        if new:
            if lines and (gap or margin):
                lines.append("")
            lines.extend(new)
            gap = margin

    def flush() -> None:
        if inline:
            text = _SPACES.sub(" ", "".join(inline))
            inline.clear()
            if text and text != " ":
                own = [x.strip(" ").replace(KEPT, " ").rstrip(" ") for x in text.split(BREAK)]
                while own and not own[-1]:
                    own.pop()
                while own and not own[0]:
                    own.pop(0)
                put(own, False)

    def end_rows() -> None:
        if rows:
            put(_table(rows), False)
            rows.clear()

    for item in items:
        if isinstance(item, str):
            if item.strip(" \t\n\r\f"):
                end_rows()
            inline.append(item)
        elif item.cells is not None:
            flush()
            rows.append(item.cells)
        else:
            end_rows()
            flush()
            put(item.lines, item.margin)
    end_rows()
    flush()
    return lines


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table of (lines, columns spanned, rows spanned) cells, its columns padded to one width."""
    # Columns that cells from rows above still fill, and for how many rows.
    filled: dict[int, int] = {}
    placed = []
    for row in rows:
        at, own = 0, []
        for lines, columns, height in row:
            while at in filled:
                at += 1
            own.append((at, columns, lines))
            for k in range(at, at + columns):
                filled[k] = max(height, 1)
            at += columns
        filled = {k: n - 1 for k, n in filled.items() if n > 1}
        placed.append(own)
    width: dict[int, int] = {}
    for own in placed:
        for at, columns, lines in own:
            if columns == 1:
                width[at] = max(width.get(at, 0), *map(len, lines), 0)
    for own in placed:
        for at, columns, lines in own:
            if columns > 1 and lines:
                lack = max(map(len, lines)) - sum(width.get(k, 0) for k in range(at, at + columns)) - 2 * (columns - 1)
                width[at + columns - 1] = width.get(at + columns - 1, 0) + max(0, lack)
    left, x = {}, 0
    for k in range(max(width, default=-1) + 1):
        left[k] = x
        x += width.get(k, 0) + 2
    out = []
    for own in placed:
        for i in range(max((len(lines) for _, _, lines in own), default=0)):
            line = ""
            for at, _, lines in own:
                if i < len(lines) and lines[i]:
                    line = line.ljust(left.get(at, x)) + lines[i]
            out.append(line.rstrip(" "))
    return out


def _number(value: str, least: int, most: int) -> int:
    return min(most, max(least, int(value))) if re.fullmatch(r"\d{1,4}", value or "") else least


def _fold(node: Node, items: list, in_table: bool) -> list:
    """What a node gives to its parent: strings and blocks; in_table: whether a table around it takes its rows."""
    name = node.name
    if name in ("td", "th"):
        return [Block(_flow(items), False, node)]
    if name == "tr":
        cells = [(b.lines, _number(b.node.attrs.get("colspan", ""), 1, 100), _number(b.node.attrs.get("rowspan", ""), 1, 1000)) for b in items if isinstance(b, Block) and b.node and b.node.name in ("td", "th")]
        rest = [x for x in items if not (isinstance(x, Block) and x.node and x.node.name in ("td", "th"))]
        return [*rest, Block([], False, node, cells)]
    if name in ("thead", "tbody", "tfoot"):
        return items
    if name == "table":
        rows = [b.cells for b in items if isinstance(b, Block) and b.cells is not None]
        rest = _flow([x for x in items if not (isinstance(x, Block) and x.cells is not None)])
        return [Block(rest + _table(rows), True, node)]
    if name in ("ul", "ol", "menu", "dir"):
        lines, n = [], _number(node.attrs.get("start", ""), 1, 9999)
        for item in items:
            if isinstance(item, Block) and item.node and item.node.name == "li":
                mark = f"{n}. " if name == "ol" else "- "
                n += 1
                lines += [(mark if i == 0 else " " * len(mark) if x else "") + x for i, x in enumerate(item.lines)]
            elif isinstance(item, Block) or item.strip():
                lines += _flow([item])
        return [Block(lines, True, node)]
    if in_table and any(isinstance(x, Block) and x.cells is not None for x in items):
        # A wrapper around rows of a table: what is between them becomes blocks.
        out: list = []
        for is_row, own in groupby(items, lambda x: isinstance(x, Block) and x.cells is not None):
            out += own if is_row else [Block(_flow(list(own)), False)]
        return out
    lines = _flow(items)
    if name == "blockquote" or name == "dd":
        lines = ["  " + x if x else x for x in lines]
    return [Block(lines, name in MARGINS, node)]


def render(source: str | None) -> str:
    """The visible text of a page."""
    root, hidden = tree(source or "")
    # Folded from the leaves up: a node's frame collects what its children give.
    frames: list[tuple[Node, Iterator, list, bool, bool, bool]] = [(root, iter(root.items), [], False, False, False)]
    while True:
        node, rest, items, pre, in_table, unseen = frames[-1]
        for x in rest:
            if isinstance(x, str):
                if unseen:
                    continue
                text = html.unescape(x) if "&" in x else x
                text = text.replace(BREAK, "").replace(KEPT, "")
                items.append(text.replace("\r\n", "\n").replace("\n", BREAK).replace(" ", KEPT).replace("\t", KEPT * 4) if pre else text)
            elif x.name == "br":
                items.append(BREAK)
            elif x.name == "input":
                if boxed(x, hidden) and not invisible(x, hidden, unseen) and x.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel"):
                    items.append(x.attrs.get("value", ""))
            elif boxed(x, hidden) and not (node.name == "details" and "open" not in node.attrs and x.name != "summary"):
                within = node.name == "table" or (in_table and node.name not in HOLDS_ROWS)
                # What an inline element holds belongs to its parent's items at once.
                own = [] if x.name in BLOCKS else items
                frames.append((x, iter(x.items), own, pre or x.name in ("pre", "textarea", "xmp"), within, invisible(x, hidden, unseen)))
                break
        else:
            frames.pop()
            if not frames:
                return "\n".join(_flow(items))
            if node.name in BLOCKS:
                frames[-1][2].extend(_fold(node, items, in_table))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, n_html_chars, n_chars, text): the visible text of each row of pages(page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("n_html_chars"), pa.array(map(len, out), pa.int64()), pa.array(out, pa.string())], ["page_id", "n_html_chars", "n_chars", "text"])

    text_batches(pages.sparkSession)
    rows = pages.select("page_id", "html", F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("n_html_chars"))
    return rows.mapInArrow(run, f"page_id {kind(pages, 'page_id')}, n_html_chars long, n_chars long, text string")
