import json

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from snipquarry.engine import Engine, tables
from snipquarry.functions import text
from snipquarry.functions.html_markdown import html_to_markdown
from snipquarry.operators import frontier, ingest, jobs, search
from snipquarry.session import materialize


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        (None, None),
        ("", ""),
        ("<h1>A  b</h1><p>One <b>two</b> <a href='/x'>three</a></p>", "# A b\n\nOne **two** three\n"),
        ("<ul><li>a<ul><li>b</li></ul></li><li><p>c</p></li></ul><p>d</p>", "- a\n  - b\n- c\n\nd\n"),
        ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b\n"),
        ("<pre><code class='language-py'>x = 1\n\n  y</code></pre>", "```py\nx = 1\n\n  y\n```\n"),
        ("<pre>```</pre>", "````\n```\n````\n"),
        ("<p>use <code>a`b</code></p>", "use ``a`b``\n"),
        ("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table>", "| a | b\\|c |\n|---|---|\n| 1 |  |\n"),
        ("<blockquote><p>q</p></blockquote><p>r</p>", "> q\n\nr\n"),
        ("<script>x</script><noscript>n</noscript><p>y</p><hr>", "y\n\n---\n"),
    ],
)
def test_html_to_markdown(html, markdown):
    assert html_to_markdown(html) == markdown


def test_html_of_any_depth_and_links():
    deep = "<div>" * 5000 + "<pre>x</pre>" + "</div>" * 5000
    assert "x" in html_to_markdown(deep)
    assert html_to_markdown("<a href='/x'>t</a>", links=True) == "[t](/x)\n"


def test_deep_html_keeps_its_blocks(spark):
    from snipquarry.operators.extract import extract

    deep = "<pre><code>" + "<span>" * 4000 + "value = 1\nother = 2" + "</span>" * 4000 + "</code></pre><pre>second = 2\nthird = 3</pre>"
    d = spark.createDataFrame([(1, deep)], "doc_id long, content string")
    assert [r.code_content for r in extract(d, kind="html").orderBy("block_no").collect()] == ["value = 1\nother = 2", "second = 2\nthird = 3"]


PAGE = "# {t}\n\nIntro of the page.\n\n```python\ndef {f}():\n    return {n}\n```\n\n```python\nshared_call(1, 2, 3)\nmore(4)\n```\n"


def test_ingest_is_composed_and_idempotent(spark):
    page = lambda i, url, f, n, job="a": (i, url, f"T{i}", PAGE.format(t=f"T{i}", f=f, n=n), "markdown", job, None)
    schema = "doc_id long, url string, title string, markdown_content string, content_type string, crawl_job_id string, upload_job_id string"
    none_d = spark.createDataFrame([], schema + ", content_hash string")
    none_s = spark.createDataFrame([], "id long, document_id long, code_content string, code_hash string, language string")
    first = spark.createDataFrame([page(1, "u1", "one", 1), page(2, "u2", "two", 2), page(3, "u3", "one", 1, "b")], schema)
    a = ingest.ingest_pages(none_d, none_s, first)
    assert rows(a.pages.select("doc_id", "change")) == [(1, "new"), (2, "new"), (3, "new")]
    # the shared call stands once in each source
    assert rows(a.blocks.groupBy("document_id").count()) == [(1, 2), (2, 1), (3, 2)]
    again = ingest.ingest_pages(materialize(a.documents, "d"), materialize(a.snippets, "s"), first)
    assert rows(again.pages.select("doc_id", "change", "kept_snippets")) == [(1, "unchanged", 2), (2, "unchanged", 1), (3, "unchanged", 2)]
    assert again.blocks.count() == 0 and again.snippets.exceptAll(a.snippets).count() == 0 and again.documents.count() == 3
    # a changed page under its old address, with another id: its old snippets go, moved links alone change nothing
    second = spark.createDataFrame([page(9, "u1", "newer", 7), (8, "u2", "T2", PAGE.format(t="T2", f="two", n=2), "markdown", "a", None)], schema)
    b = ingest.ingest_pages(materialize(a.documents, "d"), materialize(a.snippets, "s"), second)
    assert rows(b.pages.select("doc_id", "change")) == [(1, "changed"), (2, "unchanged")]
    assert [r.code_content for r in b.snippets.where("document_id = 1 and code_content like 'def%'").collect()] == ["def newer():\n    return 7"]
    assert ingest.ingest_pages(none_d, none_s, first.limit(0)).pages.count() == 0


def test_upsert_ties_are_defined(spark):
    old = spark.createDataFrame([("u", "old", 1), ("v", "kept", 1)], "url string, title string, at int")
    new = spark.createDataFrame([("u", "b", 5), ("u", "a", 5), ("u", "c", 4), (None, "n", 1)], "url string, title string, at int")
    one, two = rows(ingest.upsert(old, new.repartition(3), newest="at").where("url is not null")), rows(ingest.upsert(old, new.orderBy("title").coalesce(1), newest="at").where("url is not null"))
    assert one == two and len(one) == 2 and one[0][1] in ("a", "b")
    assert ingest.upsert(old, new).where("url is null").count() == 1
    stored = spark.createDataFrame([("u", "X"), ("u", "y"), ("w", None)], "url string, content_hash string")
    came = spark.createDataFrame([(1, "u", "x"), (2, "u", "z"), (3, "w", None), (4, "q", "x")], "doc_id long, url string, content_hash string")
    assert rows(ingest.classify(came, stored).select("doc_id", "change")) == [(1, "unchanged"), (2, "changed"), (3, "unchanged"), (4, "new")]


def test_chosen_markdown(spark):
    d = spark.createDataFrame([("f", "r"), (" ", "r"), (None, "r"), (None, None)], "fit string, raw string")
    assert [r[0] for r in d.select(ingest.chosen_markdown(F.col("fit"), F.col("raw"))).collect()] == ["f", "r", "r", None]


def test_content_of_a_library_is_its_own(spark):
    e = Engine(spark, SMALL)
    job = e.t.documents.where("crawl_job_id is not null").groupBy("crawl_job_id").count().orderBy(F.desc("count"), "crawl_job_id").first()[0]
    own = {r.id for r in e.t.snippets.join(e.t.documents.where(F.col("crawl_job_id") == job).select(F.col("doc_id").alias("document_id")), "document_id").select("id").collect()}
    for query in ("cache", "socket pager", "the"):
        assert {r.id for r in search.search(e.t, query, [job], enhanced=True, limit=50).collect()} <= own
    got = e.get_content(job, "cache")
    assert got["status"] == "ok" and got["total"] >= 0
    blank = search.with_code(e.t, search.search(e.t, "cache", limit=2), context=False)
    assert {r.description for r in blank.collect()} <= {""}


def test_annotations(spark):
    t = tables(spark, SMALL)
    got = search.search_annotated(t, "cache buffer", limit=20, enhanced=True).collect()
    assert {r.method for r in got} <= {"direct", "related", "markdown"} and all((r.page_rank is not None) == (r.method == "markdown") for r in got)
    assert all(json.loads(r.contexts) for r in got if r.method == "related")
    assert search.search_annotated(t, "cache", limit=0).count() == 0


def test_job_checks():
    assert jobs.whole_number(" 12 ", "n") == 12 and jobs.whole_number(3.0, "n", 3) == 3
    for bad in (None, True, 1.5, "x", -1, "-1", 11, []):
        with pytest.raises(ValueError, match="n must"):
            jobs.whole_number(bad, "n", 10)


def test_metadata_of_retries(spark):
    t = tables(spark, SMALL)
    got = jobs.retry_jobs(t).first()
    meta = json.loads(got.metadata)
    assert meta["retry_of_job"] == got.retry_of and "failed_pages_count" in meta
    assert jobs.retry_jobs(t, {got.retry_of: ["u"]}).where(F.col("retry_of") == got.retry_of).first().max_pages == 1
    changes = json.loads(jobs.update_crawls(t, ["p"], max_depth=9).first().changes)
    assert changes["new_url_patterns"] == ["p"] and changes["depth"]["new"] == 9


def test_crawl_stops_at_its_pages(spark):
    links = spark.range(1, 200).selectExpr("concat('u', id div 3) as source", "concat('u', id) as target")
    starts = spark.createDataFrame([("u0",)], "url string")
    got = frontier.crawl(links, starts, 9, max_pages=5)
    assert rows(got) == [("u0", 0), ("u1", 1), ("u2", 1), ("u3", 2), ("u4", 2)]
    fetched = []

    def fetch(f):
        fetched.append(f.count())
        return f.select("url", F.lit("x").alias("content"))

    found, pages = frontier.crawl_fetch(starts, fetch, lambda p: p.join(links, p.url == links.source).select("source", "target"), 2)
    assert rows(found.select("url")) == rows(pages.select("url")) and sum(fetched) == found.count() == 9


def test_truncation_and_domains(spark):
    d = spark.createDataFrame([("abcdefgh", "HTTPS://A.example/x", "http://a.example"), (None, None, "x")], "c string, a string, b string")
    got = d.select(text.hard_truncate(F.col("c"), 1).alias("t"), text.same_domain(F.col("a"), F.col("b")).alias("s")).collect()
    assert (got[0].t.text, got[0].t.truncated, got[0].s) == ("abcd", True, True) and got[1].t.truncated is False and got[1].s is False
