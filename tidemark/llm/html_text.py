"""Visible text of HTML pages, laid out as a reader would see it.

A tokeniser and a tree builder with implied tags (paragraphs, list items, table cells
and rows, options, terms) make a tree; rendering it walks without recursion. Blocks are
separated by line breaks, paragraphs, headings, lists and tables by an empty line; list items get a
bullet or their number, indented by depth; table rows become lines whose cells are
padded to their column's width. Text in ``pre`` keeps its blanks, elsewhere runs of
blanks are one space.

Nothing is shown of: script, style, template, head, noscript, iframes, form values and
media; elements with ``hidden`` or
with an own style, or a rule of the page's style sheets for their tag, id or class, that
says display:none; and text with visibility:hidden. Closed ``details`` show their summary
and, since their text is part of the page, the rest.

A null page is the empty string. Any text is a page: unclosed, stray and nested tags
never fail, and depth is bounded by memory alone. Repeated rows come back once each;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset(
    "script style template head noscript iframe noembed noframes datalist object audio video canvas svg math "
    "textarea select".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form "
    "header hgroup hr html legend li main menu nav optgroup option search section summary tbody td tfoot th thead tr".split()
)
# A start tag closes open elements of its second set, looking up no further than the third.
SCOPE = frozenset("table td th caption html body button template".split())
IMPLIED = {
    "li": ({"li"}, SCOPE | {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, SCOPE | {"dl"}),
    "dd": ({"dt", "dd"}, SCOPE | {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "template"}),
    "td": ({"td", "th"}, {"tr", "table", "template"}),
    "th": ({"td", "th"}, {"tr", "table", "template"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "template"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SIMPLE = re.compile(r"[A-Za-z][\w-]*|[.#][\w-]+")
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def parse(source: str) -> tuple[Node, list[str]]:
    """The tree under a root, and the text of its style sheets."""
    root = Node("#root")
    stack, styles, at = [root], [], 0
    lower = None

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(value)

    # Open elements by tag, so that looking for one that is not open costs nothing.
    opened: Counter = Counter()

    def close_to(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    for m in iter(lambda: TOKEN.search(source, at), None):
        text(html.unescape(source[at : m.start()]) if m.start() > at else "")
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[depth].tag == tag:
                    close_to(depth)
                    break
                if stack[depth].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break  # a stray end tag does not reach out of a cell
            else:
                if tag == "br":
                    stack[-1].children.append(Node("br"))
            continue
        closes, stop = IMPLIED.get(tag, ((), ()))
        if closes:
            for depth in range(len(stack) - 1, 0, -1) if any(opened[c] for c in closes) else ():
                if stack[depth].tag in stop:
                    break
                if stack[depth].tag in closes:
                    close_to(depth)
        elif tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[depth].tag in SCOPE:
                    break
                if stack[depth].tag == "p":
                    close_to(depth)
                    break
        if tag in BLOCK and tag not in ("html", "body") and stack[-1].tag == "head":
            close_to(len(stack) - 1)
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in VOID or (m[3].endswith("/") and tag in ("svg", "math")):
            continue
        if tag in RAW:
            if lower is None:
                lower = source.lower() if len(source.lower()) == len(source) else re.sub("[A-Z]", lambda c: c[0].lower(), source)
            end = lower.find(f"</{tag}", at)
            end = len(source) if end < 0 else end
            body = source[at:end]
            if tag == "style":
                styles.append(body)
            node.children.append(html.unescape(body) if tag in ("title", "textarea") else body)
            close = source.find(">", end)
            at = len(source) if close < 0 else close + 1
            continue
        stack.append(node)
        opened[tag] += 1
    text(html.unescape(source[at:]))
    return root, styles


def hidden_names(styles: list[str]) -> set[str]:
    """Tags, .classes and #ids that a style sheet does not display."""
    out: set[str] = set()
    for sheet in styles:
        for selectors, body in RULE.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.DOTALL)):
            if re.search(r"display\s*:\s*none", body, re.IGNORECASE):
                out.update(s.strip() for s in selectors.split(",") if SIMPLE.fullmatch(s.strip()))
    return out


def unseen(node: Node, names: set[str]) -> bool:
    if node.tag in UNSEEN or node.tag in names:
        return True
    if not node.attributes:
        return False
    given = attributes(node.attributes)
    if "hidden" in given or re.search(r"display\s*:\s*none", given.get("style", ""), re.IGNORECASE):
        return True
    if node.tag == "input":
        return True
    return bool(names) and (
        "#" + given.get("id", "") in names or any("." + c in names for c in given.get("class", "").split())
    )


class Page:
    """Lines under way: text of the current one, and how many breaks come before the next."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0  # empty lines wanted
        self.prefix = ""
        self.indent = ""

    def blank(self) -> None:
        """One space, if text goes on after it."""
        if self.line and not self.line.endswith((" ", "\n")):
            self.line += " "

    def put(self, text: str) -> None:
        if not self.line:
            self.line = self.indent + self.prefix
            if self.prefix:
                self.prefix = ""
        self.line += text

    def end_line(self, empty: int = 0) -> None:
        line = self.line.rstrip(" ")
        self.line = ""
        if line.strip():
            if self.lines and self.gap:
                self.lines.append("")
            self.lines.append(line)
            self.gap = 0
        if empty:
            self.gap = 1

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def _rows(table: Node, names: set[str]) -> list[list[Node]]:
    """Cells of a table's own rows, in order; tables inside cells keep theirs."""
    rows, todo = [], [table]
    while todo:
        node = todo.pop()
        if isinstance(node, str) or (node is not table and unseen(node, names)):
            continue
        if node.tag == "tr":
            rows.append([c for c in node.children if not isinstance(c, str) and c.tag in ("td", "th") and not unseen(c, names)])
        elif node is table or node.tag in ("tbody", "thead", "tfoot"):
            todo += reversed(node.children)
    return [r for r in rows if r]


def _aligned(rows: list[list[str]]) -> list[str]:
    """Lines of a table: cells padded to their column's width, two spaces between."""
    widths: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            if i == len(widths):
                widths.append(0)
            widths[i] = max(widths[i], len(cell))
    return ["  ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip() for row in rows]


def render(root: Node, names: set[str]) -> str:
    """Walks with an explicit stack; a cell is rendered into a page of its own."""
    page = Page()
    # Entries: (what, page) to open or write, or a function to call when a node ends.
    todo: list = [("open", root, page, False, True)]
    lists: list[list] = []
    while todo:
        entry = todo.pop()
        if callable(entry):
            entry()
            continue
        _, node, out, pre, shown = entry
        if isinstance(node, str):
            if not shown:
                continue
            if pre:
                for i, part in enumerate(node.split("\n")):
                    if i:
                        out.end_line()
                    if part:
                        out.put(part)
                continue
            words = BLANKS.split(node)
            if len(words) > 1 and not words[0]:
                out.blank()
            body = " ".join(w for w in words if w)
            if body:
                out.put(body)
                if not words[-1]:
                    out.blank()
            continue
        if node.tag != "#root" and unseen(node, names):
            continue
        tag = node.tag
        if node.attributes and "visibility" in node.attributes.lower():
            style = attributes(node.attributes).get("style", "")
            if found := re.search(r"visibility\s*:\s*(hidden|collapse|visible)", style, re.IGNORECASE):
                shown = found[1].lower() == "visible"
        if tag == "br":
            out.end_line()
            continue
        if tag == "table":
            rows = _rows(node, names)
            out.end_line(1)
            cells = [[Page() for _ in r] for r in rows]

            def finish(o=out, cells=cells) -> None:
                o.end_line()
                for line in _aligned([[" ".join(c.text().split("\n")).strip() for c in r] for r in cells]):
                    if line.strip():
                        o.put(line)
                        o.end_line()
                o.end_line(1)

            todo.append(finish)
            for row, pages in zip(reversed(rows), reversed(cells)):
                for cell, own in zip(reversed(row), reversed(pages)):
                    todo += [("open", c, own, pre, shown) for c in reversed(cell.children)]
            # A caption, and whatever strayed between the rows, comes before them.
            parts = ("tr", "tbody", "thead", "tfoot", "colgroup", "col")
            others = [c for c in node.children if isinstance(c, str) or c.tag not in parts]
            todo += [("open", c, out, pre, shown) for c in reversed(others)]
            continue
        block = tag in BLOCK
        if block:
            spaced = tag in SPACED and not (tag in ("ul", "ol") and lists)
            out.end_line(int(spaced))
            todo.append(lambda o=out, s=spaced: o.end_line(int(s)))
        if tag in ("ul", "ol", "menu", "dir"):
            start = attributes(node.attributes).get("start", "1") if tag == "ol" and node.attributes else "1"
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            before = out.indent
            out.indent = "  " * (len(lists) - 1)

            def leave(o=out, before=before) -> None:
                lists.pop()
                o.indent = before

            todo.append(leave)
        elif tag == "li" and lists:
            ordered, number = lists[-1]
            out.prefix = f"{number}. " if ordered else "- "
            lists[-1][1] += 1

            def drop(o=out) -> None:
                o.prefix = ""

            todo.append(drop)
        elif tag == "hr":
            continue
        todo += [("open", c, out, pre or tag == "pre", shown) for c in reversed(node.children)]
    return page.text()


def extract(source: str | None) -> str:
    root, styles = parse(source or "")
    return render(root, hidden_names(styles))


def visible_text(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """key, n_chars and text of each row."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(x) for x in batch], dtype=object)

    # The result is read twice; a generator keeps it from being worked out twice.
    return pages.select(F.col(f"`{key}`").alias("_key"), run(F.col(f"`{body}`")).alias("_text")).select(
        F.col("_key").alias(key), F.inline(F.array(F.struct(F.col("_text").alias("text"))))
    ).select(key, F.length("text").cast("long").alias("n_chars"), "text")
