"""HTML pages to Markdown, by the parsers' own tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsers import Node, parse_html

# Elements that show nothing, and elements that begin a block.
SILENT = frozenset(("head", "script", "style", "noscript", "template", "svg", "button", "form", "iframe"))
BLOCKS = frozenset(("address", "article", "aside", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "header", "html", "main", "nav", "p", "section", "summary"))
_SPACES = re.compile(r"\s+")
_LANGUAGE = re.compile(r"(?:language|lang|highlight-source|brush)[-:]\s?([\w+#-]+)")


def _language(n: Node) -> str:
    for x in (n, *n.elements(), *n.above()):
        if m := _LANGUAGE.search(x.attrs.get("class") or ""):
            return m[1]
        if x is not n and x.tag in ("body", "main", "article"):
            break
    return ""


class _Writer:
    """Collects lines; text goes to the open line, blocks begin and end lines under their prefixes."""

    def __init__(self):
        self.lines: list[str] = []
        self.text: list[str] = []
        self.prefix: list[str] = []
        self.lead, self.depth = "", 0  # a mark before the next line, and the prefixes that stand before it

    def begin(self, lead: str) -> None:
        if self.lead:
            self.end()
        self.lead, self.depth = lead, len(self.prefix)

    def end(self, blank: bool = False) -> None:
        s = _SPACES.sub(" ", "".join(self.text)).strip().replace(" ", "  \n" + "".join(self.prefix))
        self.text = []
        if s or self.lead.strip():
            self.lines.append("".join(self.prefix[: self.depth] if self.lead else self.prefix) + self.lead + s)
            self.lead = ""
        if blank and self.lines and self.lines[-1].strip("> "):
            self.lines.append("".join(self.prefix).rstrip())

    def verbatim(self, s: str, language: str) -> None:
        self.end(True)
        fence = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", s)), default=0))
        head = "".join(self.prefix)
        self.lines += [head + fence + language, *(head + x for x in s.strip("\n").split("\n")), head + fence, head.rstrip()]


def html_to_markdown(html: str | None, links: bool = False) -> str | None:
    """The page as Markdown; a null stays null. Without ``links`` only their texts stay.

    Elements are walked with a stack of open and close steps, so depth has no limit.
    """
    if html is None:
        return None
    out = _Writer()
    stack: list[tuple[str, Node]] = [("open", c) for c in parse_html(html).children[::-1]]
    while stack:
        step, n = stack.pop()
        if step == "open":
            below = _open(out, n, links)
            if below is not None:
                stack.append(("close", n))
                stack += [("open", c) for c in below[::-1]]
        else:
            _close(out, n, links)
    out.end()
    text = "\n".join(x.rstrip() for x in out.lines)
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n") + ("\n" if text.strip() else "")


# Markdown marks of inline elements.
_INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}


def _open(out: _Writer, n: Node, links: bool) -> list[Node] | None:
    """Write what stands before an element's content; gives the children to go on with, or None if it is done."""
    t = n.tag
    if not t:
        out.text.append(n.text)
        return None
    if t in SILENT:
        return None
    if t == "pre":
        out.verbatim("".join("\n" if x.tag == "br" else x.text for x in n.walk() if not x.tag or x.tag == "br"), _language(n))
        return None
    if t in ("code", "kbd", "samp", "tt"):
        s = _SPACES.sub(" ", "".join(n.strings())).strip()
        mark = "`" * (1 + max((len(x) for x in re.findall("`+", s)), default=0))
        out.text.append(f"{mark}{s}{mark}" if s else "")
        return None
    if t == "table":
        _table(out, n)
        return None
    if t == "br":
        out.text.append(" ")
    elif t == "hr":
        out.end(True)
        out.lines += ["".join(out.prefix) + "---", "".join(out.prefix).rstrip()]
    elif t == "img":
        alt = n.attrs.get("alt") or ""
        out.text.append(f"![{alt}]({n.attrs.get('src') or ''})" if alt or n.attrs.get("src") else "")
    elif t in _INLINE:
        out.text.append(_INLINE[t])
    elif t == "a" and links and n.attrs.get("href"):
        out.text.append("[")
    elif len(t) == 2 and t[0] == "h" and t[1] in "123456":
        out.end(True)
        out.begin("#" * int(t[1]) + " ")
    elif t == "blockquote":
        out.end(True)
        out.prefix.append("> ")
    elif t in ("ul", "ol"):
        out.end(not any(x.tag == "li" for x in n.above()))
    elif t == "li":
        out.end()
        parent = n.parent
        mark = "- "
        if parent.tag == "ol":
            mark = f"{1 + [x for x in parent.elements() if x.tag == 'li'].index(n)}. "
        out.begin(mark)
        out.prefix.append(" " * len(mark))
    elif t in BLOCKS and not (out.lead and not "".join(out.text).strip()):  # else the block is the first of an item
        out.end(t != "body")
    return n.children


def _close(out: _Writer, n: Node, links: bool) -> None:
    t = n.tag
    if t in _INLINE:
        out.text.append(_INLINE[t])
    elif t == "a" and links and n.attrs.get("href"):
        out.text.append(f"]({n.attrs['href']})")
    elif len(t) == 2 and t[0] == "h" and t[1] in "123456":
        out.end(True)
    elif t == "blockquote":
        out.end()
        while out.lines and out.lines[-1] == "".join(out.prefix).rstrip():
            out.lines.pop()
        out.prefix.pop()
        out.lines.append("".join(out.prefix).rstrip())
    elif t == "li":
        out.end()
        out.prefix.pop()
        out.lead = ""
    elif t in ("ul", "ol"):
        out.end(not any(x.tag == "li" for x in n.above()))
    elif t in BLOCKS:
        out.end(n.parent.tag != "li")


def _table(out: _Writer, n: Node) -> None:
    rows = [[_SPACES.sub(" ", "".join(c.strings())).strip().replace("|", "\\|") for c in r.elements() if c.tag in ("td", "th")] for r in n.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    out.end(True)
    head = "".join(out.prefix)
    shown = ["| " + " | ".join(r) + " |" for r in rows]
    out.lines += [head + x for x in (shown[0], "|" + "---|" * width, *shown[1:])] + [head.rstrip()]


def to_markdown(html: Column, links: bool = False) -> Column:
    """Markdown of a column of HTML pages, in Arrow batches."""

    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: html_to_markdown(x, links))

    return convert(html)
