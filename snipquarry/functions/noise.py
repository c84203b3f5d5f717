"""Python twins of the text cleaners, for use inside table functions that already run in Python."""

from __future__ import annotations

import re

from .text import BADGE_HOSTS, NAVIGATION

_MD = [
    (re.compile(r"\[([^\]]+)\]\([^)]+\)"), r"\1"),
    (re.compile(r"\[([^\]]+)\]\[[^\]]+\]"), r"\1"),
    (re.compile(r"^\[[^\]]+\]:\s+.+$", re.MULTILINE), ""),
    (re.compile(r"!\[([^\]]*)\]\([^)]+\)"), ""),
    (re.compile(r"!\[([^\]]*)\]\[[^\]]+\]"), ""),
    (re.compile(r"<!--.*?-->", re.DOTALL), ""),
    *((re.compile(r"https?://[^/]*" + h + r"[^\s\)]+"), "") for h in BADGE_HOSTS),
]
_RST = [(re.compile(r"`([^<]+)\s+<[^>]+>`_"), r"\1"), (re.compile(r"\[[#\d]+\]_"), "")]
_NAV = re.compile(NAVIGATION)
_DIRECTIVE = re.compile(r"\.\.\s+(\w+)::\s*(.*)")
_DROPPED, _UNWRAPPED = {"toctree", "contents", "include"}, {"note", "warning", "tip", "important", "caution"}


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def clean_directives(text: str) -> str:
    """Drop navigation directives with their bodies; keep the bodies of admonitions."""
    out: list[str] = []
    mode, depth, lead = "", 0, ""
    for line in text.split("\n"):
        blank = not line.strip()
        if mode and not blank and _indent(line) <= depth:
            mode = ""
        if mode == "drop":
            continue
        if mode == "unwrap":
            out.append("" if blank else lead + line.strip())
            continue
        m = _DIRECTIVE.match(line.strip())
        if m and m[1] in _DROPPED | _UNWRAPPED:
            mode, depth = ("drop" if m[1] in _DROPPED else "unwrap"), _indent(line)
            lead = line[:depth]
            if mode == "unwrap" and m[2]:
                out.append(lead + m[2])
            continue
        out.append(line)
    return "\n".join(out)


def tidy(text: str) -> str:
    text = re.sub(r"\n{3,}", "\n\n", re.sub(" +", " ", text))
    lines = (line.strip() for line in text.split("\n"))
    text = "\n".join(lines).strip()
    return "\n".join(line for line in text.split("\n") if not _NAV.match(line.lower().strip())).strip()


def filter_noise(text: str, kind: str) -> str:
    for pattern, to in _MD if kind == "markdown" else _RST:
        text = pattern.sub(to, text)
    return tidy(clean_directives(text) if kind == "rst" else text)


def worth_keeping(code: str) -> bool:
    return bool(code.strip()) and ("\n" in code or sum(len(w) >= 3 for w in re.findall(r"\w+", code)) >= 3)
