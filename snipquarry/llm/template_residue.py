"""Template residue and error-page text.

Method: records of one template are aligned and slots induced. A span in template marks, or a blank, is a slot
only where other records of the corpus have the same surroundings and something else in that place: marks
are aligned by the span with its words masked, weaker marks and blanks by the whole line, whose siblings must
hold ordinary values there. Slots that keep a variable name, a default or nothing make a page residue.
Whole-page error templates: a brief page is an error page if every line of its body is a line template
(numbers, names and addresses masked) that other bodies fill differently, and its templates stand mostly on
pages with error wording. Filler copy has no slots; it is told by wording. Where nothing can be aligned, only
unmistakable error lines decide. Bodies come from the tag-path operator, so notices in the frame don't count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_side
from .common import each_batch
from .main_content import Known, by_page, classify, site_of

#: A body of more words than this, or with code, is an error page only if most of its words are error text.
MAX_NOTICE_WORDS = 60
#: In a longer body, lines of up to this many words are error text by their wording.
BRIEF = 25
#: A line is of a template if at least this many different bodies have it.
REPEATED = 2
#: Part of a template's bodies that have error wording for it to be one of error pages.
ERROR_SHARE = 0.5

_CODE_SPAN = re.compile(r"(`+)(?:(?!\1).|\n)+?\1", re.DOTALL)
_QUOTED = re.compile(r"[\"“„«‘][^\"“”„«»‘’\n]{1,120}[\"”»’]")
_NAME = r"[A-Za-z_][\w.\- ]{0,60}"

# The forms an unfilled slot takes.
GAPS = (
    r"\{\{\{?[^{}\n]{0,120}\}?\}\}",
    r"\{%[^%\n]{0,160}%\}",
    r"<%[^%\n]{0,160}%>",
    r"[$#]\{[^{}\n]{1,80}\}",
    r"(?<![\w/$#{%(=])\{" + _NAME + r"\}(?![\w}(])",
    r"(?<![\w%])%[A-Z][A-Z0-9_]{2,60}%(?![\w%])",
    r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",
    r"\[\[\s*[A-Z][A-Z0-9_ ]{1,60}\s*\]\]",
    r"(?<!\w)@@" + _NAME + r"@@",
    r"<(?:your|insert|enter|add|the|my)[ _-][^<>\n]{1,60}>",
    r"<[A-Z]+(?:_[A-Z]+)+>",
    r"\[(?:insert|your|enter|add|placeholder|describe|name of|todo|tbd|fixme|tk)\b[^\]\n]{0,80}\](?!\()",
    r"\[[^\]\n]{1,60}\b(?:goes|go) here\](?!\()",
    r"(?:^|[\s>])(?:TBD|TODO|FIXME|TKTK|XXXX+)(?:\s*\(\w[\w ]*\)|:[^\n]{0,80}|\s*$|(?= or\b| see\b))",
)
# Defaults that nothing filled.
_DEFAULT = frozenset(("undefined", "NaN", "[object Object]"))
_GAP = re.compile("|".join(f"(?:{g})" for g in GAPS), re.MULTILINE)

# Wording of filler copy.
FILLER = (
    r"\byour [\w ]{1,40} (?:text|copy|content|description|title|headline) (?:goes|go|comes) here\b",
    r"\b(?:this|here) is (?:some |only )?(?:sample|dummy|placeholder|example|filler) (?:text|copy|content)\b",
    r"^(?:placeholder|dummy|sample|filler) (?:copy|text|paragraph|content)\b",
    r"\b(?:add|write|put) (?:two or three|a few|some|one or two) sentences about\b",
    r"\basdf\b[\s\S]{0,40}\b(?:asdf|test test|blah|qwer)|\bblah blah\b|\bqwerty qwerty\b|\bfoo bar baz qux\b",
    r"^(?:texte d['’]exemple|texte de remplissage|beispieltext|blindtext|platzhalter(?:text)?|texto de (?:ejemplo|relleno|muestra)|testo di esempio)\b",
    r"^(?:此处(?:填写|插入|输入)|这里(?:是|填写)(?:示例|占位)|示例文(?:本|字)|占位(?:文本|符|文字)|ここに.{0,20}(?:入力|記入|入れ|書い)|サンプルテキスト|ダミーテキスト|これはダミー)",
    r"\b(?:hier steht|hier kommt|ici vient|aquí va)\b.{0,40}\b(?:text|texte|texto)\b",
    r"\breplace (?:this|it) with your own\b",
)
_FILLER = re.compile("|".join(f"(?:{f})" for f in FILLER), re.IGNORECASE | re.MULTILINE)
# The vocabulary of the customary Latin filler.
LATIN = frozenset(
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui quis reprehenderit sed sint sit sunt tempor ullamco ut velit veniam voluptate".split()
)

# Lines that are an error message or a script notice by themselves.
_SURE = re.compile(r"^\W*(?:error\s*)?(?:40[0-9]|41[0-8]|42[2-9]|451|50[0-9])\b(?!\s*(?:ms|s|seconds|minutes|pages|rows|bytes|entries|megabytes|requests|retries))|\b(?:page|site|file) not found\b|\benable java\s?script\b", re.IGNORECASE)
# Customary wording of error pages, by which repeated templates are told to be such.
_ERROR = re.compile(
    r"\berror\b|\w(?:error|exception)\b|not found|java\s?script|\bscripts?\b|denied|forbidden|unavailable|exceeded|rate limit|too many requests|(?:can(?:no|['’])t|could not) be (?:found|reached|displayed)|too long|timed? ?-?out|expired|went wrong|try again|reload|request id|return home|go back|fehler|nicht gefunden|erreur|introuvable|no encontrada|エラー|見つかりません|错误|找不到|不存在", re.IGNORECASE
)
# Lines of stack traces.
_TRACE = re.compile(r"^\s*(?:Traceback \(most recent call last\)|File\b.*, line \d+|at [\w$.<>/]+\s?\(|at \S+:\d+|Caused by: |\.\.\. \d+ more|#\d+ +\S+.*(?:\(\d+\)|:\d+)|(?:[\w.]+\.)?\w+(?:Error|Exception)\b)|\bon line \d+$")
_MASK = re.compile(r"https?://\S+|\(?(?<!\w)/[\w./-]+\)?|\b[\w-]+(?:\.[\w-]+)+\b|\b\w+\(\)|\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+")
_PROPER = re.compile(r"(?<=[ ¿¡])(?:[A-Z][\w'’-]* ?)+")


def line_template(s: str) -> str:
    """The line with numbers, addresses, file names and capitalised words masked; lines of stack traces are all alike.

    The first word is masked in lines of four words or more, where it may be a site's name; shorter lines keep it.
    """
    if _TRACE.search(s):
        return "stack trace"
    if s[:1].isupper() and len(ws := s.split(None, 1)) > 1 and len(s.split()) >= 4:
        s = "◻ " + ws[1]
    return _PROPER.sub("◻ ", _MASK.sub("◻", s)).lower().strip(" .")


# What a slot may look like before its template is known: a name between any marks, or nothing.
_LABEL = re.compile(r"\W{0,4}\w[\w ]{0,40}:")
_NAMED = re.compile(r"(?<![\w\]`])([%\[\]{}<>@#$~|^:!?=+(*]{1,3})[A-Za-z][\w.-]{0,40}([%\[\]{}<>@#$~|^:!?=+)*]{1,3})(?![\w(`])")
_HOLLOW = re.compile(r"(?<=\w) (?=[,.](?:\s|$))")
_PAIRED = {"[": "]", "{": "}", "<": ">", "(": ")"}
#: An ordinary value of a slot, of any length, as sibling lines have it.
_VALUE = r"(?U)^\w[\w .,'’&/+-]*$"
#: Values that aligned lines must have for a slot to be induced.
VALUES = 2


def _norm(s: str) -> str:
    return re.sub(r"[0-9]+", "0", " ".join(s.lower().split()))


def slots(prose: str, blank: list[str]) -> list[tuple[str, str, str]]:
    """(key, before, after) of what may be unfilled slots; the key is what sibling lines are found by."""
    found = [(s + " ", "") for s in blank]
    for s in prose.split("\n"):
        for m in _NAMED.finditer(s):
            if m[2] == "".join(_PAIRED.get(c, c) for c in reversed(m[1])) and m[1] not in ("*", "**", "***", "("):
                found.append((s[: m.start()], s[m.end() :]))
        found += [(s[: m.end()], s[m.end() :]) for m in _HOLLOW.finditer(s)]
    out = []
    for pre, post in found:
        a, b = _norm(pre), _norm(post)
        first, last = re.findall(r"\w+", a), re.findall(r"\w+", b)
        if m := _LABEL.match(a):
            key = "c:" + re.sub(r"^\W+", "", m[0])
        elif len(first) >= 2:
            key = "f:" + " ".join(first[:2])
        elif len(last) >= 2:
            key = "l:" + " ".join(last[-2:])
        else:
            continue
        out.append((key, a, b))
    return sorted(set(out))


def _body(text: str, known: dict[int, float] | None = None) -> tuple[str, str, list[str], list[str], bool]:
    """(title, prose of the body without code and quotations, code lines, labels that nothing follows before the next label, heading or end, whether it has sections)."""
    raw = text.split("\n")
    title, prose, code, blank = "", [], [], []
    label, sections = None, False
    for x in classify(text, known):
        if label is not None and x.kind != "blank" and not x.out:
            if x.kind == "h" or x.kind in ("p", "li") and _LABEL.match(x.plain):
                blank.append(label)
            label = None
        if x.out or x.kind in ("blank", "setext", "rule"):
            continue
        if x.kind == "code":
            code.append(raw[x.no].strip())
        elif x.kind == "quote":
            continue
        elif x.kind == "h" and x.level == 1 and not title:
            title = raw[x.no].strip().lstrip("# ").strip()
        else:
            sections = sections or x.kind == "h" and x.level == 2
            prose.append(raw[x.no].strip())
            if x.kind in ("p", "li") and x.plain.endswith(":") and _LABEL.match(x.plain):
                label = prose[-1]
    if label is not None:
        blank.append(label)
    strip = lambda s: _QUOTED.sub(" ", _CODE_SPAN.sub(" ", s))
    return strip(title), strip("\n".join(prose)), code, blank, sections


# Every gap, filler wording or Latin passage has one of these; most lines have none.
_GAP_SIGNS = ("{", "%", "__", "[", "@@", "<", "TBD", "TODO", "FIXME", "TKTK", "XXXX", "undefined", "NaN")
_FILLER_SIGNS = ("text", "copy", "content", "sentences", "goes here", "go here", "comes here", "asdf", "blah", "qwerty", "foo bar", "platzhalter", "dummy", "sample", "filler", "placeholder", "esempio", "示例", "占位", "此处", "这里", "ここに", "サンプル", "ダミー", "replace")
_LATIN_SIGNS = ("dolor", "ipsum", "elit", "nostrud", "aliqua", "consectetur", "adipiscing", "proident", "cillum", "ullamco", "deserunt", "laborum", "excepteur", "cupidatat", "reprehenderit", "incididunt", "voluptate", "fugiat", "pariatur", "mollit")


def gaps(whole: str) -> list[tuple[str, str]]:
    """(form, names) of the spans in template marks: the span with its words masked, and the words."""
    found = []
    for line in whole.split("\n"):
        if any(sign in line for sign in _GAP_SIGNS):
            for m in _GAP.finditer(line):
                found.append((_SPAN_WORD.sub("◻", m[0].strip()), " ".join(_SPAN_WORD.findall(m[0]))))
    return sorted(set(found))


_SPAN_WORD = re.compile(r"\w+")


def _has_filler(whole: str) -> bool:
    low = whole.lower()
    return any(any(s in line for s in _FILLER_SIGNS) and _FILLER.search(line) for line in low.split("\n")) or sum(s in low for s in _LATIN_SIGNS) >= 2 and _latin(low)


def _latin(prose: str) -> bool:
    """A passage that is mostly filler Latin."""
    for line in prose.split("\n"):
        for s in re.split(r"(?<=[.!?])\s+", line):
            ws = re.findall(r"[^\W\d_]+", s.lower())
            if len(ws) >= 5 and sum(w in LATIN for w in ws) >= 0.7 * len(ws):
                return True
    return False


@dataclass(slots=True)
class Finding:
    """What one page shows by itself; the corpus decides about gaps, slots and templates."""

    residue: bool = False  # filler copy or a bare default
    error: bool = False  # an unmistakable error page
    worded: bool = False  # a brief page with error wording
    body: int = 0  # hash of a brief body
    gaps: list[tuple[str, str]] = field(default_factory=list)
    templates: list[str] = field(default_factory=list)  # of all lines of a brief body
    heading: str = ""  # the template of its title, which isn't asked for but is evidence for others
    slots: list[tuple[str, str, str]] = field(default_factory=list)


def examine(text: str, known: dict[int, float] | None = None) -> Finding:
    title, prose, code, blank, sections = _body(text, known)
    whole = f"{title}\n{prose}"
    out = Finding(residue=not _DEFAULT.isdisjoint(prose.split("\n")) or _has_filler(whole), gaps=gaps(whole), slots=slots(prose, blank))
    if out.residue or sections or not prose.strip() and not title:
        return out
    lines = [x for x in whole.split("\n") if x.strip()]
    if code or len(whole.split()) > MAX_NOTICE_WORDS:
        # no mere notice: most of it has to be error text
        told, every = _error_words(lines, code)
        out.error = 2 * told > every and any(_ERROR.search(x) or _TRACE.search(x) for x in lines + code)
    else:
        out.error = any(_SURE.search(x) for x in lines)
        out.worded = out.error or any(_ERROR.search(x) for x in lines)
        own = lines[1:] if title.strip() and prose.strip() else lines
        out.templates = sorted({line_template(x) for x in own})
        out.heading = line_template(title)
        out.body = xxhash.xxh3_64_intdigest(whole) - (1 << 63)
    return out


def _error_words(lines: list[str], code: list[str]) -> tuple[int, int]:
    """(words in brief error lines and in stack traces, words of all lines)."""
    told = every = 0
    trace = False
    for s in lines + [c for c in code if not c.startswith(("```", "~~~"))]:
        n = len(s.split())
        every += n
        # the source line below a frame belongs to it
        trace, below = bool(_TRACE.search(s)), trace and s.lstrip()[:1] != "#"
        told += n if trace or below and n <= 12 or n <= BRIEF and (_ERROR.search(s) or _SURE.search(s)) else 0
    return told, every


_FOUND = "doc_id long, residue boolean, error boolean, worded boolean, body long, gaps array<struct<form string, names string>>, templates array<string>, heading string, slots array<struct<key string, before string, after string>>"


def judged(df: DataFrame, doc: str = "doc_id", text: str = "markdown_content", site: tuple[str, ...] = ("crawl_job_id", "upload_job_id")) -> DataFrame:
    """One ``Finding`` for every row with text."""
    known = Known()

    def run(cols: dict[str, list]) -> dict[str, list]:
        got = [examine(t, known.of(*about)) for t, *about in zip(cols["body"], cols["s"], cols["paths"], cols["ratios"], strict=True)]
        out = {"doc_id": cols["doc_id"]} | {k: [getattr(g, k) for g in got] for k in ("residue", "error", "worded", "body", "templates", "heading")}
        out["gaps"] = [[dict(zip(("form", "names"), x, strict=True)) for x in g.gaps] for g in got]
        return out | {"slots": [[dict(zip(("key", "before", "after"), x, strict=True)) for x in g.slots] for g in got]}

    rows = by_page(df, site_of(df, *site), doc, text).where(F.length("body") > 0).select("doc_id", "body", "s", "paths", "ratios")
    return each_batch(rows, _FOUND, run)


def unfilled(df: DataFrame, open_slots: DataFrame, text: str = "markdown_content") -> DataFrame:
    """(doc_id) of the rows of (doc_id, key, before, after) whose slot aligned lines of other pages fill with different values."""
    templates = open_slots.select("key", "before", "after").distinct()
    lines = df.where(F.length(F.col(text)) > 0).select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    lines = lines.select(F.regexp_replace(F.trim(F.regexp_replace(F.lower("line"), r"(?U)\s+", " ")), "[0-9]+", "0").alias("line"))
    # only the ends of a line are looked at, as a line may be of any length
    two = lambda s: F.regexp_replace(F.regexp_extract(s, r"(?U)^\W*+(\w++\W++\w++)", 1), r"(?U)\W+", " ")
    keys = F.array(
        F.concat(F.lit("c:"), F.regexp_extract("line", r"(?U)^\W{0,4}(\w[\w ]{0,40}:)", 1)),
        F.concat(F.lit("f:"), two(F.col("line"))),
        F.concat(F.lit("l:"), F.reverse(two(F.reverse("line")))),
    )
    at = lines.select("line", F.explode(keys).alias("key")).join(small_side(templates, 50_000), "key")
    value = F.trim(F.expr("substring(line, length(before) + 1, length(line) - length(before) - length(after))"))
    fits = at.where("startswith(line, before) and endswith(line, after) and length(line) > length(before) + length(after)").withColumn("value", value).where(F.col("value").rlike(_VALUE))
    filled = fits.groupBy("before", "after").agg(F.countDistinct("value").alias("n")).where(F.col("n") >= VALUES)
    return open_slots.join(filled, ["before", "after"], "left_semi").select("doc_id").distinct()


def residue_pages(df: DataFrame, doc: str = "doc_id", text: str = "markdown_content", site: tuple[str, ...] = ("crawl_job_id", "upload_job_id")) -> DataFrame:
    """(doc_id, kind): pages with template residue, or with an error or script notice in place of a body.

    A gap or notice that nothing in the table can be aligned with is no slot and no template. Null, empty
    and blank texts are never named; repeated rows are judged alike; an empty table gives an empty result;
    other columns are left aside.
    """
    # only pages with a finding or an open question go on
    got = materialize(judged(df, doc, text, site).where("residue or error or size(gaps) > 0 or size(templates) > 0 or size(slots) > 0"), "residue")
    named = got.where("residue or error").select("doc_id", F.when(F.col("residue"), "residue").otherwise("error").alias("kind"))
    named = named.unionByName(_gap_pages(got).select("doc_id", F.lit("residue").alias("kind"))).unionByName(_template_pages(got).select("doc_id", F.lit("error").alias("kind")))
    named = materialize(named, "named")
    open_slots = materialize(got.select("doc_id", F.inline("slots")).join(named.select("doc_id").distinct(), "doc_id", "left_anti"), "slots")
    if not open_slots.isEmpty():  # else there is nothing to align
        named = named.unionByName(unfilled(df, open_slots, text).select("doc_id", F.lit("residue").alias("kind")))
    return named.distinct()


def _gap_pages(got: DataFrame) -> DataFrame:
    """(doc_id) of the pages with a span whose form is a slot: the corpus has other names in it."""
    spans = got.select("doc_id", F.inline("gaps"))
    # equal spans are dropped before they are counted, so no form is hot
    induced = spans.select("form", "names").distinct().groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") >= VALUES)
    return spans.join(induced, "form", "left_semi").select("doc_id").distinct()


def _template_pages(got: DataFrame) -> DataFrame:
    """(doc_id) of the brief pages all of whose lines are templates of other bodies, some of them mostly of error pages."""
    brief = got.where("not residue and size(templates) > 0")
    lines = brief.select("doc_id", "body", F.explode("templates").alias("template"))
    bodies = brief.select(F.explode(F.array_union("templates", F.array("heading"))).alias("template"), "body", "worded").distinct()
    known = bodies.groupBy("template").agg(F.count("*").alias("n"), F.avg(F.col("worded").cast("int")).alias("errors"))
    # a line of masks only, such as an address, has no wording of its own
    known = known.where(F.col("n") >= REPEATED).withColumn("tells", (F.col("errors") >= ERROR_SHARE) & F.col("template").rlike(r"[\p{L}]{2}"))
    pages = lines.join(known, "template", "left").groupBy("doc_id", "body").agg(F.min(F.col("n").isNotNull()).alias("all"), F.max(F.coalesce("tells", F.lit(False))).alias("tells"))
    return pages.where("all and tells").select("doc_id")
