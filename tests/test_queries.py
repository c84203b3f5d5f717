"""Every registered query of the engine on the smallest tables, against its SQL, or else against plain Python over the same rows."""

import json

import pytest
from conftest import SMALL, agree

from snipquarry.functions import english, parsers
from snipquarry.functions.html_markdown import html_to_markdown
from snipquarry.operators.chunking import headline
from snipquarry.operators.search import PAGE_WEIGHTS
from snipquarry.plans import queries  # noqa: F401
from snipquarry.plans.registry import ORACLE, QUERIES


def pages(duck, *columns):
    return duck.sql(f"select doc_id, {', '.join(columns)} from documents").fetchall()


def blocks(kind):
    def want(duck):
        found = ((i, list(parsers.PARSERS[kind](text))) for i, text in pages(duck, "markdown_content") if text)
        return [(i, no, b.code, b.language, b.title, b.description, b.line_start, b.line_end) for i, bs in found for no, b in enumerate(bs, 1)]

    return want


def stemmed(duck):
    wanted = english.analyse("caching buffers")
    return {i for i, *fields in pages(duck, *PAGE_WEIGHTS) if set(wanted) <= set(english.analyse(" ".join(f for f in fields if f)))}


def excerpts(duck):
    import regex

    terms = ["socket", "pager"]
    holding = ((i, t) for i, t in pages(duck, "markdown_content") if t and set(terms) <= set(regex.findall(r"[\p{L}\p{N}]+", t.lower())))
    return [(i, headline(t, terms)) for i, t in holding]


#: What queries without SQL give, by plain Python.
PLAIN = {
    "extract_pages": blocks("markdown"),
    "extract_pages_as_html": blocks("html"),
    "extract_pages_as_rst": blocks("restructuredtext"),
    "html_to_markdown": lambda duck: [(i, html_to_markdown(t)) for i, t in pages(duck, "markdown_content")],
    "rst_titles": lambda duck: [(i, parsers.rst_title(t) if t else None) for i, t in pages(duck, "markdown_content")],
    "page_headlines": excerpts,
}


def holds(name, df, duck):
    got = [tuple(r) for r in df.collect()]
    if name == "search_pages_by_stem":
        return 0 < len(got) <= 10 and {r[0] for r in got} <= stemmed(duck)
    if name == "chunk_paragraphs":
        # the chunks of a page are runs of its paragraphs; each begins at the end of those before it, or repeats some of them
        text = {}
        for i, no, n, chunk in sorted(got):
            assert no < n
            text.setdefault(i, []).append(chunk.split("\n\n"))
        for i, t in pages(duck, "markdown_content"):
            whole, at = (t or "").split("\n\n"), 0
            for c in text.get(i, []):
                at = next(k + len(c) for k in range(at, -1, -1) if whole[k : k + len(c)] == c and k + len(c) > at)
            assert not t or at == len(whole)
        return True
    if name == "site_names":
        named = {i: json.loads(m).get("og:site_name") for i, m in pages(duck, "meta_data") if m and m.startswith("{") and m.endswith("}")}
        return len(got) == len(pages(duck, "title")) and all(s == named[i].strip() for i, s in got if named.get(i) and named[i].strip())
    if name == "auto_named_jobs":
        return len(got) == duck.sql("select count(*) from crawl_jobs").fetchall()[0][0] and all(n for _, n in got)
    if name == "ingest_composed":
        # later batches: pages by address, each once, and unchanged ones only where an old page has the address
        old = {u for _, u, b in pages(duck, "url", "batch_no") if not b}
        new = {u for _, u, b in pages(duck, "url", "batch_no") if b}
        return {r[1] for r in got} <= new and len({r[0] for r in got}) == len(got) and all((r[2] == "new") == (r[1] not in old) for r in got)
    raise AssertionError(f"{name} has neither SQL nor a check")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE:
        agree(df, duck, ORACLE[name])
    elif name in PLAIN:
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, PLAIN[name](duck)))
    else:
        assert holds(name, df, duck)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ORACLE) <= set(e.queries())
