"""Code blocks with their context out of Markdown, reStructuredText and HTML, as plain generators.

Each parser yields ``Block``s in order. Lines count from 1; HTML blocks have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

from .noise import filter_noise, worth_keeping


class Block(NamedTuple):
    code: str
    language: str | None
    title: str | None
    description: str | None
    line_start: int | None = None
    line_end: int | None = None


class _Span(NamedTuple):
    first: int
    last: int
    language: str | None
    code: str


_FRONT = re.compile(r"---\n(?:.*?)\n---\n|\+\+\+\n(?:.*?)\n\+\+\+\n", re.DOTALL)
_BULLET = re.compile(r"^[*\-+]\s+")
_NUMBER = re.compile(r"^\d+\.\s+")
_ATX = re.compile(r"#+\s+(.+)$")
_RULE = re.compile(r"(?:=+|-+)$")


def _with_context(spans: list[_Span], headings: list[tuple[int, str | None, int]], main: str | None, after_heading, prose) -> Iterator[Block]:
    """Common driver of the line formats. ``headings``: per line the nearest heading above it."""
    last_under: dict[tuple, int] = {}
    for s in spans:
        if not worth_keeping(s.code):
            continue
        heading, at = headings[s.first]
        begin = last_under[heading, at] + 1 if (heading, at) in last_under else after_heading(at) if at >= 0 else 0
        last_under[heading, at] = s.last
        description = " ".join(prose(begin, s.first)) or None
        title = f"{heading} | {main}" if heading and main and main != heading else heading or main
        yield Block(s.code, s.language, title, description, s.first + 1, s.last + 1)


def markdown_blocks(text: str) -> Iterator[Block]:
    if m := _FRONT.match(text):
        text = text[m.end() :]
    lines = text.split("\n")
    bare = [x.strip() for x in lines]

    main = None
    for i, s in enumerate(bare):
        if s.startswith("# "):
            main = s[2:].strip()
        elif s and i + 1 < len(bare) and re.fullmatch("=+", bare[i + 1]):
            main = s
        if main:
            break

    headings: list[tuple[str | None, int]] = []
    now: tuple[str | None, int] = (None, -1)
    for i, s in enumerate(bare):
        headings.append(now)
        if m := _ATX.match(s):
            now = (m[1].strip(), i)
        elif i and _RULE.match(s) and bare[i - 1] and not bare[i - 1].startswith("#"):
            now = (bare[i - 1], i - 1)

    def after_heading(at: int) -> int:
        begin = at + 1
        return begin + 1 if begin < len(bare) and _RULE.match(bare[begin]) else begin

    def prose(begin: int, end: int) -> list[str]:
        kept, fence = [], ""
        for line, s in zip(lines[begin:end], bare[begin:end], strict=True):
            if fence:
                if s.startswith(fence):
                    fence = ""
            elif s[:3] in ("```", "~~~"):
                fence = s[:3]
            elif s and not line.startswith(("    ", "\t")):
                s = re.sub(r"^>\s*", "", _NUMBER.sub("", _BULLET.sub("", s)))
                if s:
                    kept.append(s)
        return [filter_noise(" ".join(kept), "markdown")] if kept else []

    yield from _with_context(list(_markdown_spans(lines, bare)), headings, main, after_heading, prose)


def _markdown_spans(lines: list[str], bare: list[str]) -> Iterator[_Span]:
    i = 0
    while i < len(lines):
        mark = bare[i][:3]
        if mark in ("```", "~~~"):
            lang = re.match(r"```\s*(\w+)", bare[i])
            end = next((j for j in range(i + 1, len(lines)) if bare[j].startswith(mark)), None)
            body = lines[i + 1 : len(lines) if end is None else end]
            last = len(lines) - 1 if end is None else end
            yield _Span(i, last, lang[1] if lang else None, "\n".join(body))
            i = last + 1
        elif lines[i].startswith(("    ", "\t")):
            j = i
            while j < len(lines) and lines[j].startswith(("    ", "\t")):
                j += 1
            yield _Span(i, j - 1, None, "\n".join(x[4:] if x.startswith("    ") else x[1:] for x in lines[i:j]))
            i = j
        else:
            i += 1


_UNDERLINES = "=-~^_*+#"
_CODE_DIRECTIVES = {"code", "code-block", "sourcecode", "literalinclude"}
_BODY_DIRECTIVES = {"note", "warning", "tip", "important", "caution", "function", "method", "class", "attribute", "module"}
_ROLE = re.compile(r":\w+:`([^`]+)`")


def _rst_heading(bare: list[str], i: int) -> bool:
    """Line i is a title: the next line underlines it (an overline adds nothing to that)."""
    text = bare[i]
    under = bare[i + 1] if i + 1 < len(bare) else ""
    return bool(text and under and under[0] in _UNDERLINES and set(under) == {under[0]} and len(under) >= len(text))


def rst_blocks(text: str) -> Iterator[Block]:
    lines = text.split("\n")
    bare = [x.strip() for x in lines]
    titled = [_rst_heading(bare, i) for i in range(len(lines))]
    main = next((bare[i] for i, t in enumerate(titled) if t), None)
    headings: list[tuple[str | None, int]] = []
    now: tuple[str | None, int] = (None, -1)
    for i in range(len(lines)):
        headings.append(now)
        if titled[i]:
            now = (bare[i], i)

    def skip_indented(i: int, end: int) -> int:
        while i < end and (not lines[i] or lines[i].startswith(" ")):
            i += 1
        return i

    def prose(begin: int, end: int) -> list[str]:
        kept, i = [], begin
        while i < end:
            s = bare[i]
            if not s:
                i += 1
                continue
            name = s.split("::")[0].replace(".. ", "") if s.startswith(".. ") and "::" in s else None
            if name in _BODY_DIRECTIVES:
                stop = skip_indented(i + 1, end)
                for x in bare[i + 1 : stop]:
                    x = _ROLE.sub(r"\1", x).lstrip("|").strip()
                    if x:
                        kept.append(x)
                i = stop
                continue
            if name in _CODE_DIRECTIVES or s.endswith("::"):
                i = skip_indented(i + 1, end)
                continue
            s = _NUMBER.sub("", _BULLET.sub("", s))
            if i + 1 < len(bare) and bare[i + 1].startswith(":"):
                kept.append(s)
                i += 1
                if definition := bare[i][1:].strip():
                    kept.append(definition)
            elif s:
                kept.append(s)
            i += 1
        return [filter_noise(" ".join(kept), "rst")] if kept else []

    yield from _with_context(list(_rst_spans(lines, bare)), headings, main, lambda at: at + 2, prose)


def _rst_spans(lines: list[str], bare: list[str]) -> Iterator[_Span]:
    i = 0
    while i < len(lines):
        directive = bare[i].startswith((".. code", ".. sourcecode"))
        if not directive and not (bare[i].endswith("::") and not bare[i].startswith("..")):
            i += 1
            continue
        first, language = i, None
        i += 1
        if directive:
            parts = bare[first].split("::")
            language = parts[1].strip() or None if len(parts) > 1 else None
            while i < len(lines) and bare[i].startswith(":"):
                i += 1
        while i < len(lines) and not bare[i]:
            i += 1
        body = []
        while i < len(lines) and (not bare[i] or lines[i][0] in " \t"):
            body.append(lines[i])
            i += 1
        margin = next((len(x) - len(x.lstrip()) for x in body if x.strip()), 0)
        code = "\n".join("" if not x.strip() else x[margin:] if len(x) >= margin else x.strip() for x in body).rstrip()
        if code:
            yield _Span(first, i - 1, language, code)


# ---- HTML -------------------------------------------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_TEXT_TAGS = frozenset("p div span li dt dd td th".split())
_NEVER = frozenset("button nav svg script style noscript pre".split())
_UI_CLASSES = ("copy", "clipboard", "tab", "sr-only")
_UI_TEXT = re.compile(r"Copy\s+code|Copy\s+to\s+clipboard|Copied!|Click\s+to\s+copy", re.IGNORECASE)


class Node:
    __slots__ = ("attrs", "children", "order", "parent", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, order: int, text: str = "", attrs: dict | None = None):
        self.tag, self.parent, self.order, self.text, self.attrs = tag, parent, order, text, attrs or {}
        self.children: list[Node] = []

    def walk(self) -> Iterator[Node]:
        """All below, in document order."""
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += n.children[::-1]

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag]

    def above(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def strings(self, skip: str = "") -> list[str]:
        return [n.text for n in self.walk() if not n.tag and not (skip and any(a.tag == skip for a in n.above()))]

    def joined(self, skip: str = "") -> str:
        return " ".join(s for x in self.strings(skip) if (s := x.strip()))


class _Tree(HTMLParser):
    """Elements close only at their own end tag, unknown end tags are ignored; scripts are raw text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None, 0)
        self.count = 0

    def _add(self, tag: str, text: str = "", attrs=None) -> Node:
        self.count += 1
        n = Node(tag, self.at, self.count, text, attrs)
        self.at.children.append(n)
        return n

    def handle_starttag(self, tag, attrs):
        n = self._add(tag, attrs=dict(attrs))
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs=dict(attrs))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self._add("", data)


def parse_html(text: str) -> Node:
    t = _Tree()
    t.feed(text)
    t.close()
    return t.root


def _is_ui(n: Node) -> bool:
    cls = (n.attrs.get("class") or "").lower()
    return n.tag in ("button", "svg") or n.tag == "div" and n.attrs.get("role") in ("tablist", "tab") or any(c in cls for c in _UI_CLASSES)


def html_code_text(element: Node) -> str:
    """Text of a code element without controls; breaks and top-level divisions begin lines."""
    out: list[str] = []
    stack = [(c, True) for c in element.children[::-1]]
    while stack:
        c, top = stack.pop()
        if not c.tag:
            out.append(c.text)
        elif not _is_ui(c):
            if c.tag == "br":
                out.append("\n")
            elif top and c.tag in ("div", "p") and out and not out[-1].endswith("\n") and out[-1] != "":
                out.append("\n")
            # a link is transparent: what it holds stands where it stood
            stack += [(x, top and c.tag == "a") for x in c.children[::-1]]
    text = "\n".join(x.rstrip() for x in "".join(out).split("\n")).strip()
    return "\n".join(re.sub(r"^\s*\d+:\s*", "", x) for x in text.split("\n")).strip()


def _between(start: Node | None, end: Node) -> list[Node]:
    """Elements from which the context of a block may come, nearest structure first."""
    if start is None:
        own = [c for c in end.parent.children if c.tag or c.text]
        return [c for c in own[: own.index(end)][-5:] if c.tag]
    siblings = start.parent.children
    after = siblings[siblings.index(start) + 1 :]
    got: list[Node] = []
    if start.parent is end.parent:
        for s in after:
            if s is end:
                break
            if s.tag:
                got.append(s)
                got += [c for c in s.elements() if c.tag not in ("pre", "code")][: max(0, 51 - len(got))]
        return got
    for s in after[:20]:
        if s is end:
            break
        if s.tag:
            got.append(s)
    if len(got) < 10:
        root = next(a for a in start.above() if a.parent is None)
        following = [n for n in root.walk() if n.tag and n.order > start.order and start not in n.above()]
        for n in following[:30]:
            if n is end:
                break
            if n not in got:
                got.append(n)
    return got[:31]


def _html_description(start: Node | None, code: Node) -> str | None:
    texts: list[str] = []
    for n in _between(start, code):
        inside = [*n.above()]
        if n.tag not in _TEXT_TAGS or any(a.tag == "pre" for a in inside) or any(c.tag == "pre" for c in n.walk()):
            continue
        if n.order >= code.order or start is not None and n.order <= start.order:
            continue
        if any(c.tag in ("p", "li", "dt", "dd") for c in n.children):
            continue
        has_button = any(c.tag == "button" for c in n.walk())
        text = n.joined("button" if has_button else "")
        if len(text) > 10 and not (texts and text in texts[-1]):
            texts.append(text)
    return re.sub(r"\s+", " ", _UI_TEXT.sub("", " ".join(texts))).strip() or None if texts else None


def html_blocks(text: str) -> Iterator[Block]:
    root = parse_html(text)
    nodes = [n for n in root.walk() if n.tag]
    main = next((n.joined() for n in nodes if n.tag == "h1" and n.joined()), None)
    found = [n for n in nodes if n.tag == "pre" and worth_keeping("".join(n.strings()).strip())]
    found += [n for n in nodes if n.tag == "code" and n.parent.tag != "pre" and not any(a.tag == "button" for a in n.above()) and worth_keeping("".join(n.strings()).strip())]
    headings = [n for n in nodes if n.tag in _HEADINGS]
    done: set[int] = set()
    last_under: dict[int, Node] = {}
    for n in found:
        if n.order in done:
            continue
        inner = next((c for c in n.walk() if c.tag == "code"), None) if n.tag == "pre" else None
        done |= {n.order, *([inner.order] if inner else [])}
        code = html_code_text(inner or n)
        if not worth_keeping(code):
            continue
        around = {a.order for a in n.above()}
        heading = next((h for h in reversed(headings) if h.order < n.order and h.order not in around), None)
        title = heading.joined() if heading else None
        start = last_under.get(heading.order if heading else -1, heading)
        last_under[heading.order if heading else -1] = n
        description = _html_description(start, n)
        yield Block(code, None, f"{title} | {main}" if title and main and main != title else title or main, description)


PARSERS = {"markdown": markdown_blocks, "restructuredtext": rst_blocks, "html": html_blocks}


def parser_for(content_type: str | None, path: str | None = None) -> str:
    """Which parser reads a document: by type, else by ending, else Markdown."""
    t = (content_type or "").lower()
    if t in ("rst", "restructuredtext"):
        return "restructuredtext"
    if t in ("html", "text/html"):
        return "html"
    if not t and path:
        if re.search(r"\.(?:rst|rest)$", path.lower()):
            return "restructuredtext"
        if re.search(r"\.html?$", path.lower()):
            return "html"
    return "markdown"


def rst_title(text: str, most: int = 20) -> str | None:
    """Title among the first lines: a '# ' line, else an over- and underlined or an underlined one."""
    bare = [x.strip() for x in text.split("\n")[:most]]
    marker = lambda s: bool(s) and all(c in "=-~`#*+^" for c in s)
    for s in bare:
        if s.startswith("# "):
            return s[2:].strip()
    for a, b, c in zip(bare, bare[1:], bare[2:], strict=False):
        if b and marker(a) and marker(c) and a[0] == c[0] and min(len(a), len(c)) >= len(b):
            return b
        if a and marker(b) and not a.startswith("#") and len(b) >= len(a):
            return a
    return None
