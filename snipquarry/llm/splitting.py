"""Splitting of oversized items at natural boundaries with an overlap.

Method: balanced targets. The least number of pieces is computed, equal-length targets are placed,
each target snaps to the strongest boundary near it, and one more piece is tried whenever a piece
would break the limit. Lengths are Unicode characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch

#: kind → (limit, overlap)
LIMITS = {"document": (8000, 200), "snippet": (2000, 100)}

_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:\s|$)")
_SENTENCE = re.compile(r"[.!?…][\"')\]»”’]*[^\S\n]+(?=\S)|[。!?!?]")
_CLAUSE = re.compile(r"[;,{})\]>](?=\s*\S)|\s+(?=\S)")
_WORD_GAP = re.compile(r"\s+(?=\S)")


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part a character from what belongs to it."""
    a, b = text[at - 1], text[at]
    return (a == "\r" and b == "\n") or unicodedata.combining(b) != 0 or b in "‍︎️" or a == "‍" or 0x1F3FB <= ord(b) <= 0x1F3FF


def boundaries(text: str, kind: str) -> tuple[list[int], list[int]]:
    """Line-level cut positions in order and their strengths (the higher the better)."""
    at, strength = [], []
    fence, blank, start = "", False, 0
    for m in _LINE.finditer(text):
        line, start = m.group(), m.start()
        empty = not line.strip()
        if kind == "document":
            mark = _FENCE.match(line)
            opens = bool(mark) and not fence
            if start:
                s = 2 if fence else 7 if _HEADING.match(line) and not empty else 6 if (blank and not empty) or opens else 4
                if fence and blank and not empty:
                    s = 3
                at.append(start)
                strength.append(s)
            if mark:
                if opens:
                    fence = mark.group(1)
                elif fence and mark.group(1)[0] == fence[0] and len(mark.group(1)) >= len(fence) and not line[mark.end() :].strip():
                    fence = ""
        elif start:
            top = not empty and not line[0].isspace() and line[0] not in "})]"
            at.append(start)
            strength.append(7 if blank and top else 6 if blank and not empty else 5 if top else 4)
        blank = empty
    return at, strength


def _snap(text: str, target: int, low: int, high: int, at: list[int], strength: list[int], kind: str) -> int:
    """The strongest boundary in [low, high], the nearest to the target among equals."""
    a, b = bisect_left(at, low), bisect_right(at, high)
    if a < b:
        i = max(range(a, b), key=lambda i: (strength[i], -abs(at[i] - target), -at[i]))
        if strength[i] >= 3:
            return at[i]
    inner = [m.end() for m in (_SENTENCE if kind == "document" else _CLAUSE).finditer(text, low, high) if low <= m.end() < len(text)]
    if inner and kind == "document":
        return min(inner, key=lambda p: (abs(p - target), p))
    if a < b:
        return at[i]
    inner = inner or [m.end() for m in _WORD_GAP.finditer(text, low, high)]
    if inner:
        return min(inner, key=lambda p: (abs(p - target), p))
    p = target
    while p > low and _joined(text, p):
        p -= 1
    return p


def _overlap_from(text: str, cut: int, least: int, at: list[int]) -> int:
    """Where the repeated tail before ``cut`` begins: at a line, else a word, else any whole character."""
    i = bisect_left(at, least)
    if i < len(at) and at[i] < cut and text[at[i] : cut].strip():
        return at[i]
    for m in _WORD_GAP.finditer(text, max(0, least - 1), cut):
        if least <= m.end() < cut:
            return m.end()
    while least < cut and least and _joined(text, least):
        least += 1
    return least


def split(text: str, limit: int, overlap: int, kind: str = "document") -> list[tuple[int, int, int]]:
    """(begin, fresh, end) of every piece: ``text[begin:end]``, of which ``text[begin:fresh]`` repeats
    the end of the piece before. All fresh parts together are the text."""
    n_chars = len(text)
    if n_chars <= limit:
        return [(0, 0, n_chars)]
    at, strength = boundaries(text, kind)
    count = max(2, -(-(n_chars - overlap) // (limit - overlap)))
    reach = (limit - overlap) // 5
    while True:
        cuts, pieces, ok = [0], [], True
        for j in range(1, count):
            target = n_chars * j // count
            low, high = max(cuts[-1] + 1, target - reach), min(n_chars - 1, target + reach, cuts[-1] + limit - (overlap if j > 1 else 0))
            if low > high:
                ok = False
                break
            cuts.append(_snap(text, min(max(target, low), high), low, high, at, strength, kind))
        if ok:
            cuts.append(n_chars)
            for j in range(len(cuts) - 1):
                a, b = cuts[j], cuts[j + 1]
                begin = a if j == 0 else _overlap_from(text, a, max(cuts[j - 1], a - overlap), at)
                if b - begin > limit or b <= a:
                    ok = False
                    break
                pieces.append((begin, a, b))
        if ok:
            return pieces
        count += 1
        if count > 4 * (n_chars // (limit - overlap) + 2):  # no balanced cut fits: cut as late as the limit allows
            return _late(text, limit, overlap)


def _late(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces cut one after the other at the last word gap in the second half of what fits, else between whole characters."""
    pieces, at = [], 0
    while at < len(text):
        begin = max(0, at - overlap)
        while begin and begin < at and _joined(text, begin):
            begin += 1
        end = min(len(text), begin + limit)
        if end < len(text):
            gaps = [m.end() for m in _WORD_GAP.finditer(text, at + (end - at) // 2, end + 1) if m.end() <= end]
            cut = gaps[-1] if gaps else end
            while cut > at + 1 and _joined(text, cut):
                cut -= 1
            # more joined characters than a piece holds can't be kept together
            end = cut if cut > at + 1 or end == at + 1 else end
        pieces.append((begin, at, end))
        at = end
    return pieces


def split_items(df: DataFrame, kind: str, id_col: str, text: str, limit: int | None = None, overlap: int | None = None) -> DataFrame:
    """(item_kind, item_id, piece_no, n_pieces, char_start, overlap_chars, piece) of items over the limit.

    Items up to the limit, null and empty ones give no rows. Pieces are numbered from 0 and at most
    ``limit`` characters long, overlap included; dropping each piece's first ``overlap_chars``
    characters and joining the rest gives the item back. Repeated rows give repeated pieces; columns
    beyond id and text are left aside.
    """
    limit, overlap = limit or LIMITS[kind][0], LIMITS[kind][1] if overlap is None else overlap
    # the length test runs in the JVM: only oversized items reach Python
    big = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where(F.length("text") > limit)

    def pieces(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("item_kind", "item_id", "piece_no", "n_pieces", "char_start", "overlap_chars", "piece")}
        for i, t in zip(cols["id"], cols["text"], strict=True):
            got = split(t, limit, overlap, kind)
            for no, (begin, fresh, end) in enumerate(got):
                for k, v in zip(out, (kind, i, no, len(got), begin, fresh - begin, t[begin:end]), strict=True):
                    out[k].append(v)
        return out

    return each_batch(big, "item_kind string, item_id long, piece_no int, n_pieces int, char_start long, overlap_chars int, piece string", pieces)


def split_all(documents: DataFrame, snippets: DataFrame) -> DataFrame:
    return split_items(documents, "document", "doc_id", "markdown_content").unionByName(split_items(snippets, "snippet", "id", "code_content"))
