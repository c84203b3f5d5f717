"""Main content of pages: which lines are the body, which are the site's own matter.

Method: tag-path ratios. A page's lines are the leaves of a tree of blocks; a leaf's path is its zone, block
kind, links or text, and the shape of its wording (numbers and names masked). For every path of a site the
text is aggregated over the pages it stands on, a text that comes back counting once, so a path's ratio is the
part of its text that is new: near 1 for prose, a few percent for what the site repeats. Link text counts
for nothing. Ratios are smoothed within lists and tables, fused with punctuation, and lines below the
threshold are outside the body, as is what stands before the title. Where a site has too few pages for a
ratio, and for lines that don't come back, fixed lists of site wording decide. Headings go with their section.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import each_batch

#: A path has a ratio of its own from this many pages, by title, and this share of its site's pages on.
MIN_NODES, MIN_SHARE = 3, 0.02
#: Lines whose smoothed and fused ratio is lower are outside the body.
THRESHOLD = 0.75
#: From this share of a site's pages on, a path is the site's even on a page that has nothing else; its ratio is at most this.
SURE_SHARE, SURE_RATIO = 0.1, 0.1
#: Paths of all sites together that are broadcast (16 bytes each); beyond that pages and paths are joined by a shuffle.
BROADCAST_PATHS = 1_000_000

# Customary wording of site matter, by kind, for lines without a ratio. Matched against a line's plain, lower-case text.
_DAY = r"(?:\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2},? \d{4}|\d{1,2}\.? (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{4})"
CUES = {
    "cookie": r"\bcookies?\b(?!\s*\()|^(?:(?:accept|decline|reject|ok|all|got it|learn more|preferences)\b\W*)+$",
    "legal": r"^(?:©|\(c\)\s|copyright\b)|(?:all|some) rights reserved|privacy policy",
    "menu": r"^(?:skip to (?:main )?content|back to top|home\W*$|home\s*[/>›»])",
    "contents": r"^(?:on this page|table of contents)\W*$",
    "share": r"share this (?:page|article|post)|\bshare it\b",
    "feedback": r"was this (?:page|article) helpful|[★☆]{3}|👍|👎",
    "edit": r"^edit this page",
    "signup": r"newsletter|in your inbox",
    "byline": r"^(?:by|author:?|written by|posted by) \w[\w.'’ -]{0,60}(?:\s*[|—–,·-]\s*.{0,60})?(?:min(?:ute)?s? read\b|" + _DAY + ")|^posted (?:on )?" + _DAY,
    "date": r"^(?:last (?:updated|modified|changed|reviewed)|page generated|published)\b.{0,30}" + _DAY,
    "related": r"^(?:related (?:articles|pages|posts)|see also|you (?:might|may) also like)\W*$|^(?:←|«|‹)|(?:→|»|›)\W*$",
}
_CUE = {k: re.compile(p) for k, p in CUES.items()}
# Every line a pattern matches holds one of its signs; a line is tried only against those it has.
SIGNS = {
    "cookie": "cookie, accept, decline, reject, ok",
    "legal": "©, (c), copyright, reserved, privacy",
    "menu": "skip to, back to, home",
    "contents": "on this page, contents",
    "share": "share",
    "feedback": "helpful, ★, ☆, 👍, 👎",
    "edit": "edit",
    "signup": "newsletter, inbox",
    "byline": "by , author, posted",
    "date": "last , page , published",
    "related": "related, see also, also like, ←, «, ‹, →, », ›",
}
_signs = ahocorasick.Automaton()
for _word in sorted({w for v in SIGNS.values() for w in v.split(", ")}):
    _signs.add_word(_word, tuple(k for k, v in SIGNS.items() if _word in v.split(", ")))
_signs.make_automaton()
_cue_memo: dict[str, bool] = {}


def _cued(plain: str) -> bool:
    """Whether most of the line is in sentences with site wording; a cue in one of many sentences is the page talking about it."""
    s = plain.lower()
    got = _cue_memo.get(s)
    if got is None:
        got = _has_cue(s)
        if got and len(parts := _SENTENCES.split(s)) > 2:
            got = 2 * sum(len(p) for p in parts if _has_cue(p)) > len(s)
        if len(_cue_memo) > 50_000:
            _cue_memo.clear()
        _cue_memo[s] = got
    return got


_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")


def _has_cue(s: str) -> bool:
    kinds = {k for _, ks in _signs.iter(s) for k in ks}
    return any(_CUE[k].search(s) for k in kinds)


_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})(.*)")
_ATX = re.compile(r"\s{0,3}(#{1,6})\s+(.*)")
_ITEM = re.compile(r"(\s*)(?:[-*+•]|\d{1,3}[.)])\s+(.*)")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)")
_MARKS = re.compile(r"[*_`~]{1,3}|<[^>\n]{1,80}>")
_PUNCT = re.compile(r"[.,;:!?。、,;:!?]")


@dataclass(slots=True)
class Line:
    no: int
    kind: str  # blank, code, h, p, li, row, quote, rule, setext
    level: int
    plain: str  # text without marks, links as their texts, single spaces
    link_chars: int  # characters of it inside links
    n_links: int
    out: bool = False


def _plain(s: str) -> tuple[str, int, int]:
    chars = n = 0
    if "](" in s:
        found = _LINK.findall(s)
        chars, n = sum(map(len, found)), len(found)
        s = _LINK.sub(r"\1", s)
    s = _MARKS.sub("", s) if any(c in s for c in "*_`~<") else s
    return " ".join(s.split()), chars, n


def parse(text: str) -> list[Line]:
    out: list[Line] = []
    fence = ""
    for no, raw in enumerate(text.split("\n")):
        s = raw.rstrip("\r")
        m = _FENCE.match(s) if "```" in s or "~~~" in s else None
        if fence:
            out.append(Line(no, "code" if s.strip() else "blank", 0, "", 0, 0))
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        if m:
            fence = m[1]
            out.append(Line(no, "code", 0, "", 0, 0))
            continue
        stripped = s.strip()
        if not stripped:
            out.append(Line(no, "blank", 0, "", 0, 0))
            continue
        if m := _ATX.match(s):
            plain, chars, n = _plain(m[2].rstrip("# "))
            out.append(Line(no, "h", len(m[1]), plain, chars, n))
            continue
        if len(stripped) >= 3 and set(stripped) in ({"="}, {"-"}) and out and out[-1].kind in ("p", "h") and out[-1].no == no - 1:
            out[-1].kind, out[-1].level = "h", 1 if stripped[0] == "=" else 2
            out.append(Line(no, "setext", out[-1].level, "", 0, 0))
            continue
        if len(stripped) >= 3 and set(stripped.replace(" ", "")) <= set("-*_"):
            out.append(Line(no, "rule", 0, "", 0, 0))
            continue
        if m := _ITEM.match(s):
            plain, chars, n = _plain(m[2])
            out.append(Line(no, "li", 1 + len(m[1].expandtabs(4)) // 2, plain, chars, n))
            continue
        kind = "row" if stripped[0] == "|" else "quote" if stripped[0] == ">" else "p"
        plain, chars, n = _plain(stripped.lstrip("> ") if kind == "quote" else stripped)
        out.append(Line(no, kind, 0, plain, chars, n))
    return out


def _only_links(x: Line) -> bool:
    """A node whose text is links, with at most separators between them."""
    if not x.n_links:
        return False
    rest = len(x.plain) - x.link_chars
    return rest <= 3 * (x.n_links + 1)


# The words of a line, and its numbers with whatever parts their digits.
_TOKENS = re.compile(r"[^\W\d_]+|\d[\W\d_]*")
#: Names are masked in lines that have no more other words than this.
FEW_WORDS = 4


def shapes(plain: str) -> list[str]:
    """The line's words in lower case with numbers masked and, for lines of few other words, also with capitalised words after the first masked."""
    tokens = ["0" if t[0].isdigit() else t for t in _TOKENS.findall(plain)]
    out = [" ".join(tokens).lower()]
    masked, others = tokens[:1], 0
    for t in tokens[1:]:
        if not t.istitle():
            masked.append(t)
            others += t != "0"
            if others >= FEW_WORDS:
                return out
        elif masked[-1] != "◻":
            masked.append("◻")
    if "◻" in masked:
        out.append(" ".join(masked).lower())
    return out


def _paths(x: Line) -> list[int]:
    """The leaf paths that are counted over a site, as signed 64-bit numbers."""
    kind = x.kind if x.kind in ("h", "li", "row") else "p"
    kind += "/a/" if x.n_links and _only_links(x) else "/t/"
    return [xxhash.xxh3_64_intdigest(kind + s) - (1 << 63) for s in shapes(x.plain)]


def page_paths(text: str) -> tuple[int, set[int]]:
    """(title, paths) of a page: the hash of its title, or of the page if it has none, and the leaf paths after it."""
    lines = [x for x in parse(text) if x.kind not in ("blank", "code", "setext", "rule", "quote")]
    title = next((x for x in lines if x.kind == "h" and x.level == 1), None)
    name = xxhash.xxh3_64_intdigest(title.plain.lower() if title else text) - (1 << 63)
    return name, {p for x in lines if x is not title and (title is None or x.no > title.no) for p in _paths(x)}


def path_ratios(lines: list[Line], known: dict[int, float]) -> list[float]:
    """Of every line, the part of its text that is new to the site and outside links, smoothed within its list or table and fused with punctuation."""
    own = []
    for x in lines:
        if x.kind in ("code", "quote", "setext", "rule"):
            own.append(1.0)
        elif _only_links(x):
            own.append(0.0)
        else:
            own.append(min(known.get(p, 1.0) for p in _paths(x)) if known else 1.0)
    out = list(own)
    i = 0
    while i < len(lines):
        j = i + 1
        while j < len(lines) and lines[j].no == lines[j - 1].no + 1 and lines[j].kind == lines[i].kind:
            j += 1
        if lines[i].kind == "row" or lines[i].kind == "li" and j - i > 2:
            weights = [len(x.plain) if any(map(str.isalnum, x.plain)) else 0.01 for x in lines[i:j]]
            mean = sum(r * w for r, w in zip(own[i:j], weights, strict=True)) / sum(weights)
            for k in range(i, j):
                out[k] = max(own[k], mean) if lines[k].kind == "row" else own[k] and 0.5 * (own[k] + mean)
        i = j
    # running text is punctuated: for lines near the threshold each mark counts a little
    return [r if r in (0.0, 1.0) else r * (1 + 0.02 * min(5, len(_PUNCT.findall(x.plain)))) for r, x in zip(out, lines, strict=True)]


def classify(text: str, known: dict[int, float] | None = None) -> list[Line]:
    """The page's lines, with ``out`` set on non-blank lines outside the main body.

    ``known`` has the ratios of the site's paths that come back; without it wording decides alone.
    """
    lines = parse(text)
    solid = [x for x in lines if x.kind != "blank"]
    if not solid:
        return lines
    title = next((x.no for x in solid if x.kind == "h" and x.level == 1), None)
    ratios = path_ratios(solid, known or {})
    for x, r in zip(solid, ratios, strict=True):
        if title is not None and x.no < title:
            x.out = True
        elif x.no == title or x.kind in ("code", "setext", "quote", "rule"):
            x.out = False
        elif x.kind == "h":
            x.out = r >= 1 and _cued(x.plain)
        elif r < THRESHOLD:
            x.out = True
        else:
            x.out = x.kind != "row" and bool(x.plain) and _cued(x.plain)
    # a page without a body: what stands on few pages of the site, such as an error message, is in the body's place
    if known and all(x.out or x.no == title or x.kind in ("h", "setext", "rule") for x in solid):
        for x, r in zip(solid, ratios, strict=True):
            if x.out and SURE_RATIO < r < THRESHOLD and (title is None or x.no > title) and not _cued(x.plain):
                x.out = False
    # a site's name alone on a line, next to site matter before any prose
    raw = text.split("\n")
    for i, x in enumerate(solid):
        if x.out or x.no == title or x.kind == "setext":
            continue
        if x.kind != "p" or len(x.plain) > 40 or not raw[x.no].strip().strip("*").isalpha():
            break
        if i + 1 < len(solid) and solid[i + 1].out or i and solid[i - 1].out:
            x.out = True
    # headings, and labels of lists, go with what they head
    for i, x in enumerate(solid):
        head = x.kind == "h" and x.no != title
        lead = x.kind == "p" and not x.out and len(x.plain.split()) <= 6 and not _PUNCT.search(x.plain[-1:])
        if not (head or lead) or x.out and not head:
            continue
        j = i + 1
        while j < len(solid) and solid[j].kind == "setext":
            j += 1
        if j < len(solid) and solid[j].kind == "li" and _only_links(solid[j]):
            x.out = True
        elif head and ratios[i] < THRESHOLD:
            below = next((k for k in range(j, len(solid)) if solid[k].kind == "h"), len(solid))
            x.out = j < below and all(solid[k].out for k in range(j, below))
    for i, x in enumerate(solid):
        if x.kind == "setext":
            x.out = solid[i - 1].out
    return lines


def site_of(df: DataFrame, *ids: str) -> Column:
    """The site a page belongs to: the first of the given ids that is set, null if none is or the table has none of them."""
    ids = [F.col(c).cast("string") for c in ids if c in df.columns]
    first = F.coalesce(*ids, F.lit(None).cast("string"))
    return F.when(first.isNotNull(), F.xxhash64(first))


def site_paths(df: DataFrame, site: Column, text: str = "markdown_content") -> DataFrame:
    """(s, path, ratio): the paths of every site that come back on its pages, with the part of their text that is new.

    Pages of one title count once, so copies of a page don't make its prose a template. A site has at most
    1 / MIN_SHARE times the mean number of lines of its pages here.
    """
    schema = pa.schema([("s", pa.int64()), ("path", pa.int64()), ("title", pa.int64())])

    def run(batches):
        for b in batches:
            out = ([], [], [])
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                title, paths = page_paths(t)
                paths.add(0)  # stands for the page
                out[0].extend([s] * len(paths))
                out[1].extend(paths)
                out[2].extend([title] * len(paths))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    rows = df.select(site.alias("s"), F.col(text)).where(F.col("s").isNotNull() & (F.length(text) > 0))
    # all three columns spread the rows, and sums are taken before the second shuffle: no site and no path is hot
    seen = rows.mapInArrow(run, "s long, path long, title long").distinct()
    nodes = seen.groupBy("s", "path").agg(F.count("*").alias("n")).where((F.col("n") >= MIN_NODES) | (F.col("path") == 0))
    nodes = materialize(nodes, "site-paths")
    pages = nodes.where("path = 0").select("s", F.col("n").alias("pages"))
    least = F.greatest(F.lit(MIN_NODES - 1.0), F.col("pages") * MIN_SHARE)
    ratio = F.when(F.col("n") >= F.col("pages") * SURE_SHARE, F.least(least / F.col("n"), F.lit(SURE_RATIO))).otherwise(least / F.col("n"))
    return nodes.where("path <> 0").join(pages, "s").where(F.col("n") > least).select("s", "path", ratio.alias("ratio"))


def by_page(df: DataFrame, site: Column, doc: str = "doc_id", text: str = "markdown_content") -> DataFrame:
    """(doc_id, body, s, paths, ratios): every row with what is known of its site; both lists are null for a site with nothing to tell."""
    found = materialize(site_paths(df, site, text), "site-ratios")
    small = found.count() <= BROADCAST_PATHS
    sites = found.groupBy("s").agg(F.collect_list("path").alias("paths"), F.collect_list(F.col("ratio").cast("float")).alias("ratios"))  # bounded, see site_paths
    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("body"), site.alias("s"))
    return rows.join(F.broadcast(sites) if small else sites, "s", "left")


class Known:
    """The paths of the site of the page at hand, kept while rows of one site follow each other."""

    def __init__(self):
        self.cache: dict[int | None, dict[int, float]] = {}

    def of(self, s: int | None, paths: list[int] | None, ratios: list[float] | None) -> dict[int, float]:
        if not paths:
            return {}
        got = self.cache.get(s)
        if got is None:
            if len(self.cache) > 200:
                self.cache.clear()
            got = self.cache[s] = dict(zip(paths, ratios, strict=True))
        return got


def outside_lines(df: DataFrame, doc: str = "doc_id", text: str = "markdown_content", site: tuple[str, ...] = ("crawl_job_id", "upload_job_id")) -> DataFrame:
    """(doc_id, line_no) of the non-blank lines outside the main body, numbered from 0 at line feeds.

    ``site`` names the columns of which the first that is set tells the page's site; pages without one are
    judged by wording. Null and empty texts give nothing; repeated rows give repeated lines; an empty table
    gives an empty result; other columns are left aside.
    """
    known = Known()

    def run(cols: dict[str, list]) -> dict[str, list]:
        ids, nos = [], []
        for i, t, *about in zip(cols["doc_id"], cols["body"], cols["s"], cols["paths"], cols["ratios"], strict=True):
            got = [x.no for x in classify(t, known.of(*about)) if x.out]
            ids += [i] * len(got)
            nos += got
        return {"doc_id": ids, "line_no": nos}

    rows = by_page(df, site_of(df, *site), doc, text).where(F.length("body") > 0).select("doc_id", "body", "s", "paths", "ratios")
    return each_batch(rows, "doc_id long, line_no int", run)


def main_body(text: str, known: dict[int, float] | None = None) -> str:
    """The page without its site matter."""
    gone = {x.no for x in classify(text, known) if x.out}
    return "\n".join(s for no, s in enumerate(text.split("\n")) if no not in gone).strip("\n")


def main_bodies(df: DataFrame, doc: str = "doc_id", text: str = "markdown_content", site: tuple[str, ...] = ("crawl_job_id", "upload_job_id")) -> DataFrame:
    """(doc_id, body): one row per row; a null text gives a null body."""
    known = Known()

    def run(cols: dict[str, list]) -> dict[str, list]:
        pages = zip(cols["body"], cols["s"], cols["paths"], cols["ratios"], strict=True)
        return {"doc_id": cols["doc_id"], "body": [None if t is None else main_body(t, known.of(*about)) for t, *about in pages]}

    return each_batch(by_page(df, site_of(df, *site), doc, text).select("doc_id", "body", "s", "paths", "ratios"), "doc_id long, body string", run)
