"""HTML to text as it is laid out: a tree builder, visibility rules, and a block renderer."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame

from .common import map_text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: What is never shown, or only where what it stands for can't be (pictures, sound, frames, scripts).
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist meter progress rp desc metadata annotation annotation-xml".split())
#: Kinds of input whose value isn't text on the page.
SILENT = frozenset("hidden password checkbox radio file image color range".split())
#: Blocks with a blank line around them, and those that only start and end a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr address".split())
PLAIN = frozenset("html body div section article main nav aside header footer form xmp figcaption details summary li dt dd center hgroup search legend caption tr td th thead tbody tfoot menu dir optgroup option".split())
BLOCK = SPACED | PLAIN
#: A start tag closes an open element of the second kind, if no element of the third lies between.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ()),
}
#: In these a p that is open ends, as browsers do it.
ENDS_P = (SPACED | PLAIN) - frozenset("html body tr td th thead tbody tfoot caption option optgroup legend".split())
SCOPE = frozenset("table td th caption button object template body html".split())
#: Deeper elements are laid out on this level, as browsers do with runaway nesting; and most open elements that end tags can close.
DEEPEST, MOST_OPEN = 256, 512
#: A column wider than this isn't padded; a page can't grow by the square of a cell.
WIDEST = 60

#: Possessive all through, so a tag is scanned once: quotes count only after an equals sign, as in HTML.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>\x00]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)*+)>""")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>\x00]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)
BLANK = re.compile(r"[ \t\n\r\f]+")
#: A rule of a style sheet, and a selector of one element by its name, classes and id.
RULE = re.compile(r"([^{}]*+)\{([^{}]*+)\}")
SIMPLE = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+)*)")


class Node:
    __slots__ = ("attrs", "children", "found", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.found = tag, attrs, [], None

    def get(self) -> dict[str, str]:
        """Attributes by lower-case name; of repeated ones the first."""
        if self.found is None:
            self.found = {}
            for m in ATTRIBUTE.finditer(self.attrs) if self.attrs and not self.attrs.isspace() else ():
                self.found.setdefault(m[1].lower(), unescape(next((v for v in m.groups()[1:] if v is not None), "")))
        return self.found


class Sheet:
    """What the style sheets of a page hide, by rules whose selector is one element's name, classes and id (no combinators, no media)."""

    def __init__(self):
        self.rules: dict[str, list[tuple[str, frozenset, str]]] = {}

    def read(self, css: str) -> None:
        css = re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S)
        depth_free, depth = [], 0
        for part in re.split(r"(@[^{};]*\{)", css) if "@" in css else [css]:  # what stands in an at-block is left out
            if part.startswith("@"):
                depth = 1
                continue
            if depth:
                at = 0
                while depth and at < len(part):
                    nxt = min((k for k in (part.find("{", at), part.find("}", at)) if k >= 0), default=len(part))
                    depth += {"{": 1, "}": -1}.get(part[nxt : nxt + 1], 0)
                    at = nxt + 1
                part = part[at:]
            depth_free.append(part)
        for selectors, style in RULE.findall("".join(depth_free)):
            if NOT_SHOWN.search(style) or VISIBILITY.search(style):
                for one in selectors.split(","):
                    m = SIMPLE.fullmatch(one.strip())
                    if m and m[0]:
                        names = frozenset(re.findall(r"[.#][\w-]+", m[2]))
                        tag = (m[1] or "*").lower()
                        self.rules.setdefault(min(names, default=tag), []).append((tag, names, style))

    def style(self, node: Node) -> str:
        if not self.rules:
            return ""
        found = node.get()
        names = {"." + c for c in found.get("class", "").split()} | ({"#" + found["id"]} if "id" in found else set())
        out = [style for key in (*sorted(names), node.tag, "*") for tag, need, style in self.rules.get(key, ()) if tag in ("*", node.tag) and need <= names]
        return ";".join(reversed(out))


def parse(html: str) -> tuple[Node, Sheet]:
    """A tree of elements and texts with HTML's implied end tags, and the page's style sheets; unknown and stray end tags are ignored.

    One pass over the characters. A tag that ends only inside of a quote ends there, and from then on quotes aren't looked at; what comes after the last
    end of a tag is text.
    """
    root, sheet = Node("html"), Sheet()
    stack, opened = [root], Counter(["html"])
    size, start, at, tags, bodies = len(html), 0, 0, TAG, 0

    def cut(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    def close(which, until) -> None:
        while any(opened[t] > 0 for t in which):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in until:
                    return
                if stack[k].tag in which:
                    cut(k)
                    break
            else:
                return

    def text(end: int) -> None:
        if end > start:
            stack[-1].children.append(html[start:end])

    while (lt := html.find("<", at)) >= 0:
        nxt = html[lt + 1 : lt + 3]
        name = nxt[1:] if nxt[:1] == "/" else nxt[:1]
        if nxt[:1] in ("!", "?"):
            text(lt)
            if html.startswith("<!--", lt):
                end = lt + 3 if html.startswith(("<!-->", "<!--->"), lt) else html.find("-->", lt + 4)
                end = html.find(">", end) if end >= 0 else -1
            else:
                end = html.find(">", lt)
            start = at = size if end < 0 else end + 1
            continue
        if not (name.isascii() and name.isalpha()):
            at = lt + 1
            continue
        if not (m := tags.match(html, lt)):
            tags = LOOSE
            if not (m := tags.match(html, lt)):
                break
        text(lt)
        start = at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))
            elif opened[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if stack[k].tag in SCOPE and tag not in BLOCK:
                        break
            continue
        if tag in ("html", "body"):
            if tag == "body":
                close(*CLOSED_BY["body"])
            if bodies < 2:
                bodies += 1
                root.attrs += " " + m[3]
            continue
        if tag in CLOSED_BY:
            close(*CLOSED_BY[tag])
        elif len(stack) > 1 and stack[-1].tag == "head" and tag not in ("meta", "link", "title", "style", "script", "base", "noscript", "template"):
            cut(len(stack) - 1)
        if tag in ENDS_P:
            close(("p",), SCOPE)
            if tag[0] == "h" and len(tag) == 2 and tag != "hr" and re.fullmatch("h[1-6]", stack[-1].tag):
                cut(len(stack) - 1)
        node = Node(tag, m[3])
        flat = len(stack) >= DEEPEST
        if not flat or tag in RAW or tag in VOID or shown(node, sheet) != (True, None):
            stack[-1].children.append(node)
        else:
            node.children = stack[-1].children  # laid out where it stands, but its end tag finds it
        if tag in RAW:
            last = re.compile(f"</{tag}", re.I).search(html, at)
            end = last.start() if last else size
            if tag in ("textarea", "xmp"):
                node.children.append(html[at:end])
            elif tag == "style":
                sheet.read(html[at:end])
            at = html.find(">", end) + 1 or size
            start = at
        elif tag not in VOID and (len(stack) < MOST_OPEN or node.children is not stack[-1].children and stack[-1].tag not in HIDDEN):
            if len(stack) < 2 * MOST_OPEN:
                stack.append(node)
                opened[tag] += 1
    text(size)
    return root, sheet


def shown(node: Node, sheet: Sheet) -> tuple[bool, bool | None]:
    """(is laid out, is visible; None: as its parent is), by its kind, by its hidden, style and (of dialog) open attributes, and by style sheets."""
    if node.tag in HIDDEN:
        return False, None
    if not sheet.rules and (not node.attrs or node.attrs.isspace()):
        return node.tag != "dialog", None
    found = node.get()
    style = found.get("style", "") + ";" + sheet.style(node)
    laid = not ("hidden" in found and found["hidden"].lower() != "until-found" or NOT_SHOWN.search(style) or node.tag == "dialog" and "open" not in found)
    how = VISIBILITY.search(style)
    return laid, None if how is None or how[1].lower() in ("inherit", "unset") else how[1].lower() not in ("hidden", "collapse")


class Page:
    """Lines of text; inline text gathers in a line until a block begins or ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0
        self.mark = ""
        self.visible = True

    def text(self, text: str, pre: bool) -> None:
        if not self.visible:
            return
        if not pre:
            text = BLANK.sub(" ", text)
            if text and (text != " " or self.inline):
                self.inline.append(text)
            return
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.inline.append(first)
        for line in rest:
            self.flush(True, keep=True)
            self.inline.append(line)

    def flush(self, pre: bool = False, keep: bool = False) -> None:
        line = "".join(self.inline)
        self.inline.clear()
        line = line.rstrip() if pre else re.sub(" +", " ", line).strip(" ")
        if line or keep:
            self.put([line])

    def put(self, lines: list[str]) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        if self.mark:
            lines = [self.mark + lines[0], *lines[1:]]
            self.mark = ""
        self.lines += lines

    def block(self, spaced: bool) -> None:
        self.flush()
        if spaced and not self.mark:
            self.gap = max(self.gap, 1)


def render(node: Node, page: Page, sheet: Sheet, pre: bool = False, depth: int = 0) -> None:
    """Lay out a node's children on a page."""
    for child in node.children:
        if isinstance(child, str):
            page.text(unescape(child) if "&" in child else child, pre)
            continue
        laid, visible = shown(child, sheet)
        if laid:
            before = page.visible
            page.visible = before if visible is None else visible
            element(child, page, sheet, pre, depth)
            page.visible = before


def element(node: Node, page: Page, sheet: Sheet, pre: bool, depth: int) -> None:
    tag = node.tag
    if tag == "br":
        if page.visible:
            page.flush(pre, keep=not page.inline and bool(page.lines) and page.gap == 0 and not page.mark)
    elif tag in ("ul", "ol", "menu", "dir"):
        page.block(depth == 0)
        listing(node, page, sheet, pre, depth)
        page.block(depth == 0)
    elif tag == "table":
        page.block(True)
        if lines := grid(node, sheet, pre, page.visible):
            page.put(lines)
        page.block(True)
    elif tag in BLOCK:
        page.block(tag in SPACED)
        if tag in ("dd", "blockquote"):
            nested(node, page, sheet, "    ", "", pre, depth)
        else:
            render(node, page, sheet, pre or tag in ("pre", "xmp"), depth)
            if tag in ("pre", "xmp"):
                page.flush(True)
        page.block(tag in SPACED)
    elif tag == "q":
        page.text('"', pre)
        render(node, page, sheet, pre, depth)
        page.text('"', pre)
    elif tag == "textarea":
        for line in unescape("".join(c for c in node.children if isinstance(c, str))).replace("\r\n", "\n").removeprefix("\n").split("\n"):
            page.text(line, False)
            page.flush()
    elif tag == "input":
        if node.get().get("type", "text").strip().lower() not in SILENT and (value := node.get().get("value")):
            page.text(f" {value} ", False)
    elif tag == "select":
        for text in choices(node, sheet):
            page.text(f" {text} ", False)
    elif tag != "wbr":
        render(node, page, sheet, pre, depth)


def choices(node: Node, sheet: Sheet) -> list[str]:
    """What a closed list shows: its selected option, else the first; an open one (multiple, or of some size) shows all."""
    found: list[tuple[bool, str]] = []

    def go(node: Node) -> None:
        for child in node.children:
            if isinstance(child, Node) and shown(child, sheet)[0]:
                if child.tag == "option":
                    inner = Page()
                    render(child, inner, sheet)
                    inner.flush()
                    found.append(("selected" in child.get(), " ".join(inner.lines)))
                else:
                    go(child)

    go(node)
    if "multiple" in node.get() or re.fullmatch(r"0*([2-9]|[1-9]\d+)", node.get().get("size", "").strip()):
        return [text for _, text in found]
    return [next((text for on, text in reversed(found) if on), found[0][1])] if found else []


def nested(node: Node, page: Page, sheet: Sheet, indent: str, mark: str, pre: bool, depth: int) -> None:
    """Lay a node out on a page of its own and put it, indented, on the outer one."""
    inner = Page()
    inner.visible = page.visible
    render(node, inner, sheet, pre, depth)
    inner.flush(pre)
    if inner.lines:
        page.put([(mark or indent) + inner.lines[0], *[indent + x if x else x for x in inner.lines[1:]]])
    elif mark and page.visible:
        page.put([mark.rstrip()])


def listing(node: Node, page: Page, sheet: Sheet, pre: bool, depth: int) -> None:
    """Items with a bullet or their number; nested lists are indented under their item."""
    number = 1
    if node.tag == "ol":
        number = int(n) if re.fullmatch(r"-?\d{1,9}", n := node.get().get("start", "1").strip()) else 1
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            laid, visible = shown(child, sheet)
            if not laid:
                continue
            before = page.visible
            page.visible = before if visible is None else visible
            if node.tag == "ol":
                value = child.get().get("value", "").strip()
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                mark, number = f"{number}. ", number + 1
            else:
                mark = "- "
            page.flush(pre)
            nested(child, page, sheet, " " * len(mark), mark, pre, depth + 1)
            page.visible = before
        else:
            holder = Node("div")
            holder.children = [child]
            render(holder, page, sheet, pre, depth + 1)


def rows(node: Node, out: list[tuple[list[Node], int]], captions: list[Node], sheet: Sheet) -> None:
    """The rows of a table that are laid out, head first and foot last, each with the number of rows from it to the end of its group; what stands
    outside of cells comes before, as in browsers."""
    parts: dict[str, list] = {"thead": [], "tbody": [], "tfoot": []}
    loose: list[list[Node]] = []

    def stray(child) -> None:
        holder = Node("div")
        holder.children = [child]
        captions.append(holder)

    def end_group() -> None:
        parts["tbody"] += [(cells, len(loose) - k) for k, cells in enumerate(loose)]
        loose.clear()

    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                stray(child)
        elif not shown(child, sheet)[0]:
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            end_group()
            rows(child, parts[child.tag], captions, sheet)
        elif child.tag == "tr":
            cells = []
            for cell in child.children:
                if isinstance(cell, Node) and cell.tag in ("td", "th"):
                    if shown(cell, sheet)[0]:
                        cells.append(cell)
                elif isinstance(cell, Node) and shown(cell, sheet)[0] or isinstance(cell, str) and cell.strip():
                    stray(cell)
            loose.append(cells)
        elif child.tag in ("td", "th"):
            loose.append([child])
        elif child.tag not in ("colgroup", "col"):
            stray(child)
    end_group()
    out += parts["thead"] + parts["tbody"] + parts["tfoot"]


def grid(table: Node, sheet: Sheet, pre: bool, visible: bool = True) -> list[str]:
    """A table's lines: cells of a column begin at the same place, two spaces apart; rows with tall cells take several lines."""
    found: list[tuple[list[Node], int]] = []
    captions: list[Node] = []
    rows(table, found, captions, sheet)
    page = Page()
    page.visible = visible
    for node in captions:
        render(node, page, sheet, pre)
        page.flush(pre)
    laid: list[list[tuple[int, list[str]]]] = []
    spans: dict[int, tuple[int, int]] = {}  # where a cell of an earlier row reaches down: column -> (columns, rows left)
    for cells, rest in found:
        row, column = [], 0
        taken, spans = spans, {k: (w, n - 1) for k, (w, n) in spans.items() if n > 1}
        for cell in cells:
            while column in taken:
                column += taken[column][0]
            how = shown(cell, sheet)[1]
            inner = Page()
            inner.visible = visible if how is None else how
            render(cell, inner, sheet, pre)
            inner.flush(pre)
            row.append((column, inner.lines))
            span = cell.get()
            wide = min(int(n), 1000) if re.fullmatch(r"\d{1,9}", n := span.get("colspan", "1").strip()) else 1
            tall = min(int(n) or rest, rest) if re.fullmatch(r"\d{1,9}", n := span.get("rowspan", "1").strip()) else 1
            if tall > 1:
                spans[column] = (max(wide, 1), tall - 1)
            column += max(wide, 1)
        laid.append(row)
    starts = {c for row in laid for c, lines in row if lines}
    widths = {c: 0 for c in starts}
    for row in laid:
        for k, (c, lines) in enumerate(row):
            width = max(map(len, lines), default=0)
            if c in widths and width <= WIDEST and (k + 1 == len(row) or row[k + 1][0] == c + 1 or width > 0):
                widths[c] = max(widths[c], width)
    place, at = {}, 0
    for c in sorted(starts):
        place[c] = at
        at += widths[c] + 2
    for row in laid:
        for k in range(max((len(lines) for _, lines in row), default=0)):
            line = ""
            for c, lines in row:
                if k < len(lines) and lines[k]:
                    line = (line if len(line) + 2 <= place[c] or not line else line + "  ").ljust(place[c]) + lines[k]
            page.lines.append(line.rstrip())
    return page.lines


def extract(html: str | None) -> str:
    """All visible text of a page. Null and empty pages give an empty text."""
    if not html:
        return ""
    page = Page()
    tree, sheet = parse(html.replace("\x00", ""))
    laid, visible = shown(tree, sheet)
    if not laid:
        return ""
    page.visible = visible is not False
    render(tree, page, sheet)
    page.flush()
    lines = page.lines
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(line.replace("\xa0", " ").rstrip() for line in lines)


def extract_text(pages: DataFrame, carry: list[str], html: str = "html") -> DataFrame:
    """Append ``text`` (the visible text of ``html``) and ``n_lines`` to every row.

    Blocks start on new lines, with a blank line around paragraphs, headings, lists and tables; list items have bullets or
    numbers and indent what they hold; cells of a table column begin at one place (a cell over 60 characters isn't padded to); pre keeps its white space. Form
    fields show their value, selected option or label, formulas and drawings their text. Left out: what HIDDEN lists, alternative texts of pictures,
    elements hidden by attribute, by their own style, or by a style rule for one element's name, classes and id (an element in them that sets visibility is shown again).
    Broken markup never fails: tags that HTML implies are added, stray ones ignored, below 256 levels nesting is flattened. The time follows a page's length. A null or
    empty page gives an empty text and 0 lines. Repeated rows stay; input columns of the two names are replaced. One pass, no shuffle.
    """

    def work(texts: list[bytes | None]) -> dict[str, list]:
        made = [extract(x.decode("utf-8", "replace") if x else None) for x in texts]
        return {"text": made, "n_lines": [x.count("\n") + 1 if x else 0 for x in made]}

    return map_text(pages, lambda: work, "text string, n_lines int", carry, html)
