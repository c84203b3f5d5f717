import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from snipquarry.engine import Engine, tables
from snipquarry.operators import catalog, chunking, frontier, ingest, mutate, resolve, search


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark, SMALL)


def test_dedupe_scopes(spark):
    b = spark.createDataFrame([("c:1", "h", 1, 1, "x"), ("c:1", "h", 2, 1, "x"), ("u:1", "h", 3, 1, "x"), ("-", "h", 4, 1, "x"), ("-", "h", 5, 1, "x"), ("c:1", "e", 6, 1, "")], "scope string, code_hash string, document_id int, block_no int, code_content string")
    first = ingest.first_per_scope(b)
    assert [r.document_id for r in first.orderBy("document_id").collect()] == [1, 3, 4]
    assert ingest.first_per_scope(b, existing=first).count() == 0


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "url string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), ("c", 3)], "url string, v int")
    assert rows(ingest.upsert(old, new, newest="v")) == [("a", 1), ("b", 2), ("c", 3)]
    s = spark.createDataFrame([(1, 10), (2, 11)], "document_id int, id int")
    assert rows(ingest.replace_snippets(s, spark.createDataFrame([(2, 12)], "document_id int, id int"))) == [(1, 10), (2, 12)]


def test_classify(spark):
    old = spark.createDataFrame([("a", "H"), ("b", None)], "url string, content_hash string")
    new = spark.createDataFrame([("a", "h"), ("b", "x"), ("c", "x")], "url string, content_hash string")
    assert rows(ingest.classify(new, old).select("url", "change")) == [("a", "unchanged"), ("b", "changed"), ("c", "new")]
    assert ingest.classify(new, old, ignore_hash=True).where("change = 'unchanged'").count() == 0


def test_failed_pages(spark):
    f = spark.createDataFrame([(1, "j", "u", 1), (2, "j", "u", 2), (3, "j", "v", 1)], "id int, crawl_job_id string, url string, failed_at int")
    assert sorted(r.id for r in ingest.distinct_failed(f).collect()) == [1, 3]
    assert [r.id for r in ingest.clear_failed(f, f.where("url = 'u'")).collect()] == [3]


def test_search_pages_join_up(t):
    whole = [r.id for r in search.search(t, "cache", limit=12).collect()]
    parts = [r.id for o in (0, 4, 8) for r in search.search(t, "cache", limit=4, offset=o, expand=False, fallback=False).collect()]
    assert len(set(parts)) == len(parts) and parts[:4] == whole[:4]
    assert search.search_direct(t, "cache", limit=0).count() == 0
    assert search.search(t, "nosuchword").count() == 0
    assert search.search_direct(t, "cache", limit=10, offset=10_000).count() == 0


def test_empty_tables(spark, t):
    from dataclasses import fields

    e = catalog.Tables(**{f.name: getattr(t, f.name).limit(0) for f in fields(catalog.Tables)})
    for df in (catalog.source_statistics(e), catalog.languages(e), catalog.recent_jobs(e), search.search(e, "cache"), resolve.search_libraries(e, "x"), catalog.job_list(e, "2025-01-01 00:00:00")):
        assert df.count() == 0


def test_delete_cascades(spark, t):
    ids = t.crawl_jobs.orderBy("id").select("id").limit(1)
    after = mutate.delete_sources(t, ids)
    gone = ids.first()["id"]
    assert after.documents.where(F.col("crawl_job_id") == gone).count() == 0
    assert after.documents.count() + t.documents.where(F.col("crawl_job_id") == gone).count() == t.documents.count()
    left = after.snippets.join(after.documents.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti")
    assert left.count() == t.snippets.join(t.documents.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti").count()


def test_rename_conflict(t):
    j = t.crawl_jobs.orderBy("id").select("id", "name", "version").limit(2).collect()
    out = {r.id: r for r in mutate.rename(t.crawl_jobs, j[0].id, j[1].name, j[1].version).collect()}
    assert out[j[0].id].conflict and out[j[0].id].name == j[0].name


def test_resolution(t):
    name = t.crawl_jobs.orderBy("id").first()["name"]
    assert resolve.resolve(t, name)["reason"] == "exact"
    assert resolve.resolve(t, "24512bb4-93a1-4c1c-ab0d-13110f42b205")["reason"] == "id"
    assert resolve.did_you_mean(["React", "Vue"], "reakt")[0][0] == "React"
    assert resolve.resolve(t, "zzzzqqqq")["status"] == "not_found"


def test_chunks(spark):
    assert chunking.pack_paragraphs("") == [] and chunking.pack_paragraphs("x" * 99, 10) == ["x" * 99]
    paras = ["p%02d" % i + "x" * 37 for i in range(20)]
    got = chunking.pack_paragraphs("\n\n".join(paras), 40)
    assert [p for c in got for p in c.split("\n\n")][:4] == paras[:4] and all(len(c) // 4 <= 60 for c in got)
    assert chunking.within_budget(["a" * 400, "b" * 800], 250).endswith("[Content truncated...]")
    d = spark.createDataFrame([(1, "abcd" * 5), (2, ""), (3, None)], "id int, c string")
    assert rows(d.select("id", F.size(chunking.fixed_chunks(F.col("c"), 2)))) == [(1, 3), (2, 0), (3, 0)]
    assert d.where("id = 1").select(chunking.chunk_at(F.col("c"), 2, 5)["error"].alias("e")).first()["e"] == "Chunk index 5 out of range (0-2)"


def test_headline():
    assert chunking.headline("one two three", ["two"], most=1) == "****two****"
    assert chunking.headline("x", ["two"]) is None


def test_frontier(spark):
    links = spark.createDataFrame([("https://a/1", "https://a/2"), ("https://a/2", "https://a/1"), ("https://a/2", "https://b/3"), ("https://a/2", "https://a/x/4")], "source string, target string")
    start = spark.createDataFrame([("https://a/1",)], "url string")
    assert rows(frontier.crawl(links, start, 5, domains=["a"])) == [("https://a/1", 0), ("https://a/2", 1), ("https://a/x/4", 2)]
    assert frontier.crawl(links, start, 5, max_pages=2).count() == 2 and frontier.crawl(links, start, 0).count() == 1


def test_engine(spark, t):
    e = Engine(spark, SMALL)
    name = t.crawl_jobs.orderBy("id").first()["name"]
    assert e.get_content(name)["text"].startswith("Found ")
    sid = t.snippets.orderBy("id").first()["id"]
    assert e.get_snippet(sid)["text"].startswith("TITLE: ") and e.get_snippet(-1)["status"] == "not_found"
    assert e.get_page_markdown(snippet_id=sid)["status"] == "ok" and e.get_page_markdown()["status"] == "error"
    assert e.init_crawl(None, ["https://x"]).first()["created"]
