"""HTML fragments: one scanner for the box divisions of a response and for Markdown.

Nested lists, tables and divisions need a stack, which no built-in expression keeps in linear time,
so both walks are Arrow functions over the tags of a fragment, read once from left to right. All
cleaning around them is Column code.

Contract of the conversion (the tag set the layout prompt allows): headings, paragraphs, divisions,
line breaks, bold, italic, strike-through, superscript, code, preformatted text, links, images,
rules, nested lists, check boxes, tables with spans and captions. Comments, doctype, scripts and
styles go with their content; pure containers are unwrapped; ``math`` stays as it is written; every
other tag passes through. A tag without its end runs to the end of what holds it, an inline mark
without its end is left out, an end without its tag too.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.entities import html5
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.columns import trimmed
from foliospark.functions.text import collapse_punct, collapse_tags, line_dedupe, math_to_latex

#: A comment, a declaration, a script or style with its content, or a tag whose quoted values may hold ``>``.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![a-z][^>]*>|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
                  r"""|<(/?)([a-z][a-z0-9-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.I | re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_LINE = re.compile(r"[ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*")
_LINE_END = re.compile(r"[ \t]*\n[ \t]*")
_MORE_LINES = re.compile(r"\n{3,}")
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")

# Fixed sets of the conversion contract.
_MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~", "sup": "^"}
_UNWRAPPED = {"html", "head", "body", "span", "small", "big", "thead", "tbody", "tfoot"}
_HEADING = {f"h{n}": "#" * n + " " for n in range(1, 7)}
_BLOCK = {"p", "div", "ul", "ol", "li", "table", "caption", "tr", "td", "th", "pre", "hr", *_HEADING}
_INLINE = {*_MARK, "a", "code"}
#: What an opening tag ends if it is open, up to the nearest holder.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}),
         "th": ({"td", "th", "caption"}, {"tr", "table"})}


class Tag(NamedTuple):
    start: int
    end: int
    closing: bool
    name: str  # lower case; empty for what is dropped with its content
    rest: str


def tags(text: str) -> Iterator[Tag]:
    for m in _TAG.finditer(text):
        yield Tag(m.start(), m.end(), m[2] == "/", (m[3] or "").lower(), m[4] or "")


def decoded(text: str) -> str:
    """Entities that end in ``;`` as characters; one cut off before its ``;`` or unknown stays as it is written."""
    if "&" not in text:
        return text
    return _ENTITY.sub(lambda m: entities.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag, names in lower case, the first of a repeated one."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), decoded(m[2] or m[3] or m[4] or ""))
    return found


# ---------------------------------------------------------------------------
# Box divisions
# ---------------------------------------------------------------------------
def boxed_divisions(text: str) -> list[tuple[str, str | None, str]]:
    """(box, label, inner text) of every ``div`` with ``data-bbox``, outer ones before inner ones."""
    found, open_ = [], []
    for tag in tags(text):
        if tag.name != "div":
            continue
        if not tag.closing:
            values = attributes(tag.rest) if "data-bbox" in tag.rest.lower() else {}
            if "data-bbox" in values:
                found.append([values["data-bbox"], values.get("data-label"), tag.end, len(text)])
            open_.append(len(found) - 1 if "data-bbox" in values else None)
        elif open_:
            at = open_.pop()
            if at is not None:
                found[at][3] = tag.start
    return [(box, label, text[a:b]) for box, label, a, b in found]


#: Responses whose divisions are Python objects at one time; the rest of a batch is Arrow memory.
_AT_ONCE = 64

_DIVISION = T.StructType([T.StructField(n, T.StringType()) for n in ("box", "label", "inner")])


# The two kinds of functions differ on purpose: Spark 4.1 merges the projections of functions of one kind
# that feed each other and then fails to evaluate the outer one.
@F.arrow_udf(T.ArrayType(_DIVISION))
def divisions(text: pa.Array) -> pa.Array:
    """Struct(box, label, inner) of the box divisions of each response; null for null."""
    names = _DIVISION.names
    kind = pa.list_(pa.struct([(n, pa.string()) for n in names]))
    parts = [pa.array([None if t is None else [dict(zip(names, d)) for d in boxed_divisions(t)]
                       for t in text.slice(a, _AT_ONCE).to_pylist()], kind) for a in range(0, len(text), _AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


# ---------------------------------------------------------------------------
# Markdown
# ---------------------------------------------------------------------------
class _Open:
    """An open element: its tag and what it holds so far, inline pieces and whole blocks."""

    def __init__(self, name: str, rest: str = ""):
        self.name, self.rest = name, rest
        self.pieces: list[tuple[bool, object]] = []  # (is it a block, text or cells)

    def blocks(self) -> list[str]:
        """Whole blocks in order, the inline pieces between them as paragraphs."""
        out, line = [], []
        for whole, piece in [*self.pieces, (True, "")]:
            if not whole:
                line.append(piece)
                continue
            text = "".join(line).strip()
            line = []
            if "\n" in text:
                text = _MORE_LINES.sub("\n\n", _LINE_END.sub("\n", text))
            out += [t for t in (text, piece) if t]
        return out

    def inline(self) -> str:
        return "".join(p if isinstance(p, str) else "" for _, p in self.pieces)


def _one_line(blocks: list[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(blocks)).strip()


def _number(value: str | None) -> int:
    return max(1, min(int(value), 1000)) if (value or "").strip().isdecimal() else 1


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells at their columns: a spanning cell shows its text once and leaves the rest of its area empty."""
    grid: list[dict[int, str]] = [{} for _ in rows]
    for y, row in enumerate(rows):
        x = 0
        for text, across, down in row:
            while x in grid[y]:
                x += 1
            for dy in range(min(down, len(rows) - y)):
                for dx in range(across):
                    grid[y + dy].setdefault(x + dx, text if not dx and not dy else "")
            x += across
    width = max((max(r, default=-1) + 1 for r in grid), default=0)
    return [[r.get(x, "") for x in range(width)] for r in grid]


def _table(node: _Open) -> list[str]:
    captions = [p for _, p in node.pieces if isinstance(p, str) and p.strip()]
    grid = _grid([p for _, p in node.pieces if isinstance(p, list)])
    lines = ["| " + " | ".join(row) + " |" for row in grid]
    if lines:
        lines.insert(1, "| " + " | ".join(["---"] * len(grid[0])) + " |")
    return [_one_line([c]) for c in captions] + (["\n".join(lines)] if lines else [])


def _list(node: _Open) -> str:
    """Items with their marks; what an item holds below its first line is indented."""
    lines, k = [], 0
    for whole, piece in node.pieces:
        if isinstance(piece, list):  # an item: its blocks
            k += 1
            first, *more = piece or [""]
            mark = f"{k}. " if node.name == "ol" else "- "
            if first.startswith(("- ", "1. ", "|", "```")) and piece:
                first, more = "", piece
            lines.append(mark + first)
            lines += ["    " + line if line else line for block in more for line in block.split("\n")]
        elif piece.strip():
            lines += [piece.strip()]
    return "\n".join(lines)


def _link(text: str, target: str) -> str:
    """A link, or its text alone where target and text say the same."""
    if text and text == target:
        return text
    for scheme in ("http://", "https://"):
        if text and target == scheme + text:
            return target
    for scheme in ("mailto:", "tel:"):
        if text and target == scheme + text:
            return text
    return f"[{text}]({target})"


def _closed(node: _Open, stack: list[_Open]) -> None:
    """Give what an element holds to the element around it."""
    holder, name = stack[-1], node.name
    if name in ("p", "div"):  # these part what stands around them even when they are empty
        holder.pieces += [(True, b) for b in node.blocks()] or [(True, "")]
        return
    names = {n.name for n in stack}
    if name in _MARK or name == "a" and "href" not in attributes(node.rest):
        text = node.inline().strip() if name != "sup" else node.inline()
        mark = _MARK.get(name, "")
        if mark and (not text or any(_MARK.get(n) == mark for n in names) or "pre" in names):
            mark = ""
        holder.pieces.append((False, mark + text + mark))
    elif name == "a":
        holder.pieces.append((False, _link(_one_line([node.inline()]), attributes(node.rest)["href"])))
    elif name == "code":
        text = node.inline()
        holder.pieces.append((False, text if "pre" in names else f"`{text}`"))
    elif name == "pre":
        text = node.inline().strip("\n").rstrip()
        fence = "```"
        while fence in text:
            fence += "`"
        holder.pieces.append((True, f"{fence}\n{text}\n{fence}"))
    elif name in _HEADING:
        text = _one_line(node.blocks())
        holder.pieces.append((True, _HEADING[name] + text if text else ""))
    elif name in ("td", "th"):
        cell = _one_line(node.blocks()).replace("|", "\\|")
        values = attributes(node.rest)
        holder.pieces.append((False, [(cell, _number(values.get("colspan")), _number(values.get("rowspan")))])
                             if holder.name == "tr" else (False, cell + " "))
    elif name == "tr":
        cells = [c for _, p in node.pieces if isinstance(p, list) for c in p]
        holder.pieces.append((False, cells) if holder.name == "table" else (False, " ".join(c[0] for c in cells) + " "))
    elif name == "table":
        if names & {"td", "th"}:  # a table inside a cell: its cells in reading order
            texts = [c[0] for _, p in node.pieces if isinstance(p, list) for c in p]
            holder.pieces.append((False, " " + " ".join(texts) + " "))
        else:
            holder.pieces += [(True, b) for b in _table(node)]
    elif name == "caption":
        holder.pieces.append((False, _one_line(node.blocks()) + "\n"))
    elif name == "li":
        holder.pieces.append((False, node.blocks()) if holder.name in ("ul", "ol") else (True, "- " + "\n".join(node.blocks())))
    else:
        holder.pieces.append((True, _list(node)))


def to_markdown(source: str) -> str:
    """Convert one HTML fragment."""
    stack = [_Open("")]
    at, until = 0, 0

    def text(a: int, b: int) -> None:
        if a < b:
            piece = source[a:b]
            if "&" in piece:
                piece = decoded(piece.replace("&nbsp;", " "))
            if "\n" in piece and not any(n.name == "pre" for n in stack):
                piece = _LINE.sub(" ", piece)
            stack[-1].pieces.append((False, piece))

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if node.name in _INLINE and len(stack) > depth:  # an inline mark that is cut off marks nothing
                stack[-1].pieces += node.pieces
            else:
                _closed(node, stack)

    def find(names: set, stop: set) -> int | None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                return k
            if stack[k].name in stop:
                return None
        return None

    def unmark() -> None:
        while stack[-1].name in _INLINE:
            node = stack.pop()
            stack[-1].pieces += node.pieces

    for tag in tags(source):
        if tag.start < until:
            continue
        text(at, tag.start)
        at, name = tag.end, tag.name
        if not name or name in _UNWRAPPED:
            continue
        if name == "math" and not tag.closing:
            end = re.compile(r"</math\s*>", re.I).search(source, tag.end)
            at = until = end.end() if end else len(source)
            stack[-1].pieces.append((False, source[tag.start:at]))
        elif name == "br":
            stack[-1].pieces.append((False, "\n"))
        elif name == "img":
            values = attributes(tag.rest)
            stack[-1].pieces.append((False, f"![{values.get('alt', '')}]({values.get('src', '')})"))
        elif name == "input" and attributes(tag.rest).get("type", "").lower() in ("checkbox", "radio"):
            stack[-1].pieces.append((False, "[x] " if "checked" in attributes(tag.rest) else "[ ] "))
        elif name == "hr":
            unmark()
            stack[-1].pieces.append((True, "* * *"))
        elif name not in _BLOCK and name not in _INLINE:
            stack[-1].pieces.append((False, source[tag.start:tag.end]))
        elif tag.closing:
            # an inline end stays within its block; a block end closes what it holds
            k = find({name}, _BLOCK - {name} if name in _INLINE else {"table"} - {name})
            if k is not None:
                close(k)
        else:
            if name in _BLOCK and not any(n.name == "pre" for n in stack):
                unmark()
                ends, stop = _ENDS.get(name, ({"p", *_HEADING}, {"li", "td", "th", "div"}))
                k = find(ends, stop)
                if k is not None:
                    close(k)
            stack.append(_Open(name, tag.rest))
    text(at, len(source))
    unmark()
    close(1)
    return "\n\n".join(stack[0].blocks())


@F.udf(T.StringType(), useArrow=True)
def html_to_markdown(html):
    """Convert one HTML fragment a row."""
    return None if html is None else to_markdown(html)


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def each_to_markdown(html):
    """Convert each fragment of a row's array; null ones stay null."""
    return None if html is None else [None if t is None else to_markdown(t) for t in html]


def clean_markdown(c: Column) -> Column:
    """Math tags, repeated lines, broken tag runs, punctuation runs, in this order."""
    return trimmed(collapse_punct(collapse_tags(line_dedupe(math_to_latex(c)))))


def chandra_markdown(html: Column) -> Column:
    """An HTML block to cleaned Markdown."""
    return clean_markdown(html_to_markdown(html))
