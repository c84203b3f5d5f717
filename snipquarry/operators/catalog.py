"""Sources, documents and snippets: joined views, statistics and listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, text


@dataclass(frozen=True)
class Tables:
    """The model's tables. ``jobs`` of both kinds are small next to pages and snippets, but grow with
    them, so Spark chooses how to join them by their size."""

    documents: DataFrame
    snippets: DataFrame
    crawl_jobs: DataFrame
    upload_jobs: DataFrame
    failed_pages: DataFrame
    relationships: DataFrame
    heartbeats: DataFrame


def job_of(d: DataFrame | None = None) -> Column:
    """The id of the source a document belongs to."""
    return F.coalesce("crawl_job_id", "upload_job_id")


def in_source(*ids: str) -> Column:
    """Documents of the given sources, as a predicate that reaches the Parquet scan."""
    return F.col("crawl_job_id").isin(*ids) | F.col("upload_job_id").isin(*ids)


def sources(t: Tables) -> DataFrame:
    """One row per crawl or upload source."""
    crawl = t.crawl_jobs.select("id", "name", "version", "domain", "status", "start_urls", "config", "created_at", "updated_at", F.lit("crawl").alias("kind"), F.lit(None).cast("int").alias("file_count"))
    upload = t.upload_jobs.select(
        "id", "name", "version", F.lit(None).cast("string").alias("domain"), "status", F.array().cast("array<string>").alias("start_urls"), F.lit(None).cast("string").alias("config"), "created_at", "updated_at", F.lit("upload").alias("kind"), "file_count"
    )
    return crawl.unionByName(upload)


def snippet_view(t: Tables) -> DataFrame:
    """Snippets with their document and owning source; uploads included."""
    d = t.documents.select(F.col("doc_id").alias("document_id"), F.col("url").alias("document_url"), F.col("title").alias("document_title"), job_of().alias("source_id"))
    s = sources(t).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind"))
    return t.snippets.join(d, "document_id").join(s, "source_id", "left")


def _per_document(t: Tables) -> DataFrame:
    """Snippet counts per document, aggregated before any join so that nothing fans out."""
    return t.snippets.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("code_content")).alias("chars"), F.max("created_at").alias("last"))


def source_statistics(t: Tables) -> DataFrame:
    """Documents, snippets, characters and last update per source, empty sources included."""
    per = t.documents.select("doc_id", job_of().alias("job_id")).join(_per_document(t).withColumnRenamed("document_id", "doc_id"), "doc_id", "left")
    per = per.groupBy("job_id").agg(F.count("*").alias("document_count"), F.sum(F.coalesce("n", F.lit(0))).alias("snippet_count"), F.sum("chars").alias("total_characters"), F.max("last").alias("last_updated"))
    s = sources(t).withColumnRenamed("id", "job_id")
    meta = lambda k: F.get_json_object("config", f"$.metadata.{k}")
    return s.join(per, "job_id", "left").select(
        "name", "version", "domain", meta("repository").alias("repository"), meta("description").alias("description"), "status", F.coalesce("document_count", F.lit(0)).alias("document_count"), F.coalesce("snippet_count", F.lit(0)).alias("snippet_count"), "total_characters", "last_updated", "job_id", F.col("kind").alias("job_type")
    )


def crawl_source_overview(t: Tables, now: str) -> DataFrame:
    """Crawl sources with capitalised status, estimated tokens (0 if none) and a relative date label."""
    s = source_statistics(t).where("job_type = 'crawl'")
    return s.select("job_id", "name", F.concat(F.upper(F.substring("status", 1, 1)), F.substring("status", 2, 100)).alias("status"), "snippet_count", F.coalesce("total_characters", F.lit(0)).alias("tokens"), clock.relative_label(F.col("last_updated"), clock.at(now)).alias("updated"))


def languages(t: Tables) -> DataFrame:
    """Snippets per language over crawl sources; uploads and missing languages are left out."""
    d = t.documents.join(t.crawl_jobs.select(F.col("id").alias("crawl_job_id")), "crawl_job_id", "left_semi").select(F.col("doc_id").alias("document_id"))
    return t.snippets.where("language is not null and language <> ''").join(d, "document_id", "left_semi").groupBy("language").agg(F.count("*").alias("n"))


def source_languages(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("document_id"), job_of().alias("source_id"))
    return t.snippets.where("language is not null").join(d, "document_id").groupBy("source_id", "language").agg(F.count("*").alias("n"))


def snippet_counts(t: Tables) -> DataFrame:
    """Snippets per source that has any."""
    d = t.documents.select(F.col("doc_id").alias("document_id"), job_of().alias("source_id"))
    return _per_document(t).join(d, "document_id").groupBy("source_id").agg(F.sum("n").alias("snippet_count"))


def recent_jobs(t: Tables, n: int = 5) -> DataFrame:
    """The newest jobs of both kinds: the top of each kind, merged, and its top again."""
    crawl = t.crawl_jobs.select("id", "name", "status", "created_at", F.lit("crawl").alias("kind")).orderBy(F.desc("created_at"), "id").limit(n)
    upload = t.upload_jobs.select("id", "name", "status", "created_at", F.lit("upload").alias("kind")).orderBy(F.desc("created_at"), "id").limit(n)
    return crawl.unionByName(upload).orderBy(F.desc("created_at"), "id").limit(n)


def dashboard(t: Tables) -> DataFrame:
    """metric, value: completed sources, documents, snippets, and snippets per canonical language."""
    done = sources(t).where("status = 'completed'").agg(F.count("*").alias("value")).select(F.lit("sources").alias("metric"), "value")
    docs = t.documents.agg(F.count("*").alias("value")).select(F.lit("documents").alias("metric"), "value")
    langs = t.snippets.where("language is not null").groupBy(F.concat(F.lit("language:"), F.col("language")).alias("metric")).agg(F.count("*").alias("value"))
    total = t.snippets.agg(F.count("*").alias("value")).select(F.lit("snippets").alias("metric"), "value")
    return done.unionByName(docs).unionByName(total).unionByName(langs)


def list_sources(t: Tables, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of sources, newest update first; base address, domain and counts as shown in lists."""
    per = source_statistics(t).select("job_id", "document_count", "snippet_count")
    s = sources(t).join(per.withColumnRenamed("job_id", "id"), "id")
    base = F.when(F.col("kind") == "upload", F.concat(F.lit("Uploaded: "), F.date_format("created_at", "yyyy-MM-dd"))).otherwise(F.get("start_urls", 0))
    page = s.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)
    return page.select("id", "name", "version", F.coalesce("domain", F.lit("upload")).alias("domain"), base.alias("base_url"), "document_count", "snippet_count", "file_count")


def filtered_sources(t: Tables, query: str | None = None, least: int | None = None, most: int | None = None, kind: str | None = None) -> DataFrame:
    """Completed sources by substring of name or a start address and by snippet count; one definition for
    counting, listing ids and deleting. Predicates are built only for the given options."""
    s = source_statistics(t).join(sources(t).select(F.col("id").alias("job_id"), "start_urls"), "job_id").where("status = 'completed'")
    if query:
        q = F.lit(query.lower())
        s = s.where(F.contains(F.lower("name"), q) | F.exists("start_urls", lambda u: F.contains(F.lower(u), q)))
    if least is not None:
        s = s.where(F.col("snippet_count") >= least)
    if most is not None:
        s = s.where(F.col("snippet_count") <= most)
    if kind:
        s = s.where(F.col("job_type") == kind)
    return s.select(F.col("job_id").alias("id"), "name", "job_type", "snippet_count")


def source_documents(t: Tables, source_id: str, limit: int = 10, offset: int = 0) -> DataFrame:
    d = t.documents.where(in_source(source_id)).select("doc_id", "url", "title", "created_at").orderBy(F.desc("created_at"), "doc_id").offset(offset).limit(limit)
    # only the page's documents are counted
    n = t.snippets.join(d.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("snippet_count"))
    return d.join(n, "doc_id", "left").select("doc_id", "url", "title", F.coalesce("snippet_count", F.lit(0)).alias("snippet_count"))


def source_snippets(t: Tables, source_id: str, language: str | None = None, query: str | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of a source's snippets, newest first. The language is compared as it is; the query is a
    substring of title, description or code in any case."""
    d = t.documents.where(in_source(source_id)).select(F.col("doc_id").alias("document_id"))
    s = t.snippets.join(d, "document_id", "left_semi")
    if language:
        s = s.where(F.col("language") == language)
    if query:
        q = F.lit(query.lower())
        s = s.where(F.contains(F.lower("title"), q) | F.contains(F.lower("description"), q) | F.contains(F.lower("code_content"), q))
    return s.orderBy(F.desc_nulls_first("created_at"), "id").offset(offset).limit(limit).select("id", "title", "language", "created_at")


def documents_by_title(t: Tables, query: str, limit: int = 10, offset: int = 0) -> DataFrame:
    d = t.documents.where(F.contains(F.lower("title"), F.lit(query.lower())))
    return d.orderBy(F.desc_nulls_first("created_at"), "doc_id").offset(offset).limit(limit).select("doc_id", "title", "url")


def documents_by_priority(t: Tables, query: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """Substring search over title, address and text; whole title, part of title, last part of the
    address, then text, and by title within each."""
    low, q = query.lower(), F.lit(query.lower())
    hit = F.contains(F.lower("title"), q) | F.contains(F.lower("url"), q) | F.contains(F.lower("markdown_content"), q)
    priority = F.when(F.lower("title") == q, 0).when(F.contains(F.lower("title"), q), 1).when(F.contains(F.lower("url"), F.lit("/" + low)), 2).otherwise(3)
    return t.documents.where(hit).select("doc_id", "title", priority.alias("priority")).orderBy("priority", F.asc_nulls_last("title"), "doc_id").offset(offset).limit(limit)


def recent_snippets(t: Tables, now: str, hours: int, limit: int = 10) -> DataFrame:
    """Newest snippets of crawl sources within some hours before ``now``."""
    since = clock.at(now) - F.make_dt_interval(F.lit(0), F.lit(hours))
    d = t.documents.join(t.crawl_jobs.select(F.col("id").alias("crawl_job_id"), F.col("name").alias("source_name")), "crawl_job_id").select(F.col("doc_id").alias("document_id"), "source_name")
    s = t.snippets.where(F.col("created_at") >= since).join(d, "document_id")
    return s.orderBy(F.desc("created_at"), "id").limit(limit).select("id", "title", "source_name", "created_at")


def by_member(t: Tables, column: str, member: str) -> DataFrame:
    """Snippets whose array column (functions, imports) has the member."""
    return t.snippets.where(F.array_contains(column, member)).select("id", "title", column)


def page_total(df: DataFrame, limit: int, page: int) -> DataFrame:
    """total, total_pages, has_next, has_previous of a result cut into pages."""
    p = clock.pages(F.col("total"), limit)
    return df.agg(F.count("*").alias("total")).select("total", p.alias("total_pages"), (F.lit(page) < p).alias("has_next"), F.lit(page > 1).alias("has_previous"))


def job_list(t: Tables, now: str) -> DataFrame:
    """Crawl jobs with progress, health and failed-page counts."""
    failed = t.failed_pages.groupBy(F.col("crawl_job_id").alias("id")).agg(F.count("*").alias("failed_pages"))
    j = t.crawl_jobs.join(failed, "id", "left")
    return j.select(
        "id", "name", "status", clock.percent(F.col("processed_pages"), F.col("total_pages")).alias("progress"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), clock.health(F.col("last_heartbeat"), clock.at(now)).alias("health"), F.coalesce("failed_pages", F.lit(0)).alias("failed_pages")
    )


def failed_pages_of(t: Tables, job_id: str) -> DataFrame:
    return t.failed_pages.where(F.col("crawl_job_id") == job_id).select("id", "url", "error_message", "failed_at").orderBy("id")


def document_markdown(t: Tables, doc_ids: list[int] | None = None) -> DataFrame:
    """Text of documents, of all or by id, with a status; a missing or empty text is no_content."""
    d = t.documents if doc_ids is None else t.documents.where(F.col("doc_id").isin(doc_ids))
    has = F.coalesce(F.col("markdown_content") != "", F.lit(False))
    return d.select("doc_id", F.when(has, "success").otherwise("no_content").alias("status"), F.when(has, F.col("markdown_content")).alias("content"), F.when(has, F.length("markdown_content")).otherwise(0).alias("content_length"))


def resume_decisions(t: Tables, now: str) -> DataFrame:
    """What to do with each job: running and stale ones are retried page by page or restarted."""
    failed = t.failed_pages.select(F.col("crawl_job_id").alias("id")).distinct().withColumn("has_failed", F.lit(True))
    stale = (F.col("status") == "running") & (F.col("last_heartbeat").isNull() | (clock.seconds_since(F.col("last_heartbeat"), clock.at(now)) > clock.STALLED_S))
    j = t.crawl_jobs.join(failed, "id", "left")
    return j.select("id", F.when(~stale, "none").when(F.col("has_failed"), "retry_failed").otherwise("restart").alias("decision"), F.when(stale & F.col("has_failed").isNull(), F.coalesce("retry_count", F.lit(0)) + 1).otherwise(F.coalesce("retry_count", F.lit(0))).alias("retry_count"))


def quality_violations(t: Tables) -> DataFrame:
    """rule, n: rows that break the model's constraints."""
    d = t.documents.select(F.count_if(F.col("crawl_job_id").isNull() == F.col("upload_job_id").isNull()).alias("n")).withColumn("rule", F.lit("document_has_one_job"))
    s = t.snippets.select(F.count_if(~F.col("snippet_type").isin("function", "class", "example", "config", "code")).alias("n")).withColumn("rule", F.lit("snippet_type"))
    r = t.relationships.select(F.count_if(~F.col("relationship_type").isin("imports", "extends", "implements", "uses", "example_of", "configuration_for", "related")).alias("n")).withColumn("rule", F.lit("relationship_type"))
    j = t.crawl_jobs.select(F.count_if(~F.col("max_depth").between(0, 5)).alias("n")).withColumn("rule", F.lit("max_depth"))
    u = t.documents.groupBy("url").count().where("count > 1").agg(F.count("*").alias("n")).withColumn("rule", F.lit("url_unique"))
    return d.unionByName(s).unionByName(r).unionByName(j).unionByName(u).select("rule", "n")


def language_facet(page: DataFrame) -> DataFrame:
    """Language counts of one result page."""
    return page.where("language is not null").groupBy("language").agg(F.count("*").alias("n"))


def canonical_languages(t: Tables) -> DataFrame:
    return t.snippets.groupBy(text.language_name(F.col("language")).alias("language")).agg(F.count("*").alias("n"))
