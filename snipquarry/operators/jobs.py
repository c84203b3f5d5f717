"""Jobs made from jobs: retries, crawls again with changed options, and checks of what callers give."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Tables, sources

_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Crawls that run at once if a job's options don't say.
CONCURRENT = 5


def snippet_id(value: Column) -> Column:
    """The id in a text of digits, blanks around it aside; else null."""
    s = F.trim(value)
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint"))


def is_source_id(value: Column) -> Column:
    return F.coalesce(value.rlike(_UUID), F.lit(False))


def whole_number(value: object, name: str, most: int | None = None, least: int = 0) -> int:
    """An option as a whole number from ``least`` to ``most``; anything else is a ValueError."""
    if isinstance(value, bool) or value is None or isinstance(value, float) and not value.is_integer():
        raise ValueError(f"{name} must be a whole number, not {value!r}")
    if isinstance(value, str):
        if not re.fullmatch(r"\s*[+-]?\d+\s*", value):
            raise ValueError(f"{name} must be a whole number, not {value!r}")
    elif not isinstance(value, int | float):
        raise ValueError(f"{name} must be a whole number, not {value!r}")
    n = int(value)
    if n < least or most is not None and n > most:
        raise ValueError(f"{name} must lie between {least} and {most if most is not None else 'any number'}, not be {n}")
    return n


def source(t: Tables, source_id: str) -> DataFrame:
    """One source, a crawl before an upload of the same id, with the numbers of its documents and snippets."""
    one = sources(t).where(F.col("id") == source_id).orderBy("kind").limit(1)
    docs = t.documents.where((F.col("crawl_job_id") == source_id) | F.col("crawl_job_id").isNull() & (F.col("upload_job_id") == source_id)).select("doc_id")
    n_docs = docs.agg(F.count("*").alias("document_count"))
    n = t.snippets.join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").agg(F.count("*").alias("snippet_count"))
    counts = n_docs.crossJoin(F.broadcast(n))  # one row each
    return one.crossJoin(F.broadcast(counts)).select("id", "name", "version", "status", "kind", "document_count", "snippet_count")


def upload_status(t: Tables) -> DataFrame:
    """Progress of uploads in percent of their files."""
    done = F.when(F.col("file_count") > 0, F.bround(F.col("processed_files") * 100.0 / F.col("file_count"), 1)).otherwise(0.0)
    return t.upload_jobs.select("id", "name", "status", "file_count", "processed_files", done.alias("percent"), "error_message")


def _option(name: str) -> Column:
    return F.get_json_object("config", f"$.{name}")


def _metadata(**marks: Column) -> Column:
    """The job's metadata as JSON with marks set; equal names are overwritten."""
    old = F.coalesce(F.from_json(_option("metadata"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~k.isin(list(marks)))
    added = F.create_map(*[x for k, v in marks.items() for x in (F.lit(k), v.cast("string"))])
    return F.to_json(F.map_concat(kept, added))


def retry_jobs(t: Tables, urls: dict[str, list[str]] | None = None) -> DataFrame:
    """(retry_of, name, version, start_urls, max_depth, max_pages, domain_restrictions, metadata): the job that does a
    crawl once more, for every crawl job.

    With addresses for a job only these are fetched, at depth 0; else its own starts and depth hold. The
    metadata keep what the job had, and name it and the number of its failed pages.
    """
    failed = t.failed_pages.groupBy(F.col("crawl_job_id").alias("id")).agg(F.count("*").alias("failed"))
    j = t.crawl_jobs.join(failed, "id", "left").withColumn("failed", F.coalesce("failed", F.lit(0)))
    only = F.lit(None).cast("array<string>")
    for job, given in (urls or {}).items():
        if given:
            only = F.when(F.col("id") == job, F.array(*map(F.lit, given))).otherwise(only)
    j = j.withColumn("only", only)
    return j.select(
        F.col("id").alias("retry_of"), "name", "version", F.coalesce("only", "start_urls").alias("start_urls"), F.when(F.col("only").isNotNull(), 0).otherwise(F.col("max_depth")).alias("max_depth"),
        F.when(F.col("only").isNotNull(), F.size("only")).otherwise(_option("max_pages").try_cast("int")).alias("max_pages"), "domain_restrictions",
        _metadata(retry_of_job=F.col("id"), original_job_name=F.col("name"), failed_pages_count=F.col("failed")).alias("metadata"),
    )


def failed_to_retry(t: Tables) -> DataFrame:
    """(crawl_job_id, url, max_depth): each failed address once with the job whose options it is fetched by."""
    f = t.failed_pages.select("crawl_job_id", "url").distinct()
    return f.join(t.crawl_jobs.select(F.col("id").alias("crawl_job_id")), "crawl_job_id", "left_semi").withColumn("max_depth", F.lit(0))


def update_crawls(t: Tables, add_patterns: list[str] | None = None, exclude: list[str] | None = None, max_depth: int | None = None, max_pages: int | None = None, concurrent: int | None = None, version: str | None = None) -> DataFrame:
    """(id, name, version, url_patterns, exclude_patterns, max_depth, max_pages, concurrent, changes): the options by
    which each completed crawl is brought up to date.

    Patterns are the job's own and then the added ones, each once; options not given stay as they are. ``changes``
    is JSON with old and new values.
    """
    old_patterns = F.coalesce(F.from_json(_option("url_patterns"), "array<string>"), F.from_json(_option("include_patterns"), "array<string>"), F.array().cast("array<string>"))
    added = F.array(*map(F.lit, add_patterns or [])).cast("array<string>")
    old_pages, old_concurrent = _option("max_pages").try_cast("int"), F.coalesce(_option("max_concurrent_crawls").try_cast("int"), F.lit(CONCURRENT))
    new = lambda given, old: F.lit(given).cast("int") if given is not None else old
    depth, pages, many = new(max_depth, F.col("max_depth")), new(max_pages, old_pages), new(concurrent, old_concurrent)
    pair = lambda a, b: F.struct(a.alias("old"), b.alias("new"))
    changes = F.to_json(F.struct(added.alias("new_url_patterns"), F.array(*map(F.lit, exclude or [])).cast("array<string>").alias("excluded_patterns"), pair(F.col("max_depth"), depth).alias("depth"), pair(old_pages, pages).alias("pages"), pair(old_concurrent, many).alias("concurrent")))
    return t.crawl_jobs.where("status = 'completed'").select(
        "id", "name", (F.lit(version) if version is not None else F.col("version")).alias("version"), F.array_distinct(F.concat(old_patterns, added)).alias("url_patterns"), F.array(*map(F.lit, exclude or [])).cast("array<string>").alias("exclude_patterns"),
        depth.alias("max_depth"), pages.alias("max_pages"), many.alias("concurrent"), changes.alias("changes"),
    )


def recrawls(t: Tables, ignore_hash: bool = False) -> DataFrame:
    """The options by which each completed crawl is done again."""
    return t.crawl_jobs.where("status = 'completed'").select(
        "id", "name", "start_urls", "max_depth", _option("max_pages").try_cast("int").alias("max_pages"), _metadata(is_recrawl=F.lit("true"), original_source_id=F.col("id"), original_name=F.col("name"), ignore_hash=F.lit(str(ignore_hash).lower())).alias("metadata")
    )


def reset_counters(jobs: DataFrame, documents: DataFrame, snippets: DataFrame, resume: bool) -> DataFrame:
    """(id, processed_pages, snippets_extracted, base_snippets) at a job's start: a new run begins at nothing, a resumed
    one at what its documents hold."""
    if not resume:
        return jobs.select("id", F.lit(0).cast("bigint").alias("processed_pages"), F.lit(0).cast("bigint").alias("snippets_extracted"), F.lit(0).cast("bigint").alias("base_snippets"))
    d = documents.where("crawl_job_id is not null").select(F.col("crawl_job_id").alias("id"), F.col("doc_id").alias("document_id"))
    per = snippets.groupBy("document_id").agg(F.count("*").alias("n"))
    held = d.join(per, "document_id", "left").groupBy("id").agg(F.count("*").alias("processed_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("snippets_extracted"))
    out = jobs.select("id").join(held, "id", "left")
    return out.select("id", F.coalesce("processed_pages", F.lit(0)).alias("processed_pages"), F.coalesce("snippets_extracted", F.lit(0)).alias("snippets_extracted"), F.coalesce("snippets_extracted", F.lit(0)).alias("base_snippets"))


def filter_names(s: DataFrame, needle: str, columns: list[str], limit: int | None = None, offset: int = 0, order: str = "name") -> DataFrame:
    """Rows one of whose columns holds the needle, letter case aside, as listings filter what they show."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    out = s.where(hit).orderBy(order, "id").offset(offset)
    return out if limit is None else out.limit(limit)


def by_match(matches: DataFrame, score: str = "confidence", limit: int = 10, offset: int = 0, key: str = "job_id") -> DataFrame:
    """A page of matches, best score first."""
    return matches.orderBy(F.desc(score), key).offset(offset).limit(limit)


def request_metrics(requests: DataFrame, seconds: str = "seconds", failed: str = "failed", concurrency: str = "concurrency") -> DataFrame:
    """Per level of concurrency: requests, mean, 95th and 99th percentile, and the share of failed ones in percent."""
    return requests.groupBy(concurrency).agg(
        F.count("*").alias("requests"), F.avg(seconds).alias("mean_s"), F.percentile(seconds, 0.95).alias("p95_s"), F.percentile(seconds, 0.99).alias("p99_s"), (F.avg(F.col(failed).cast("int")) * 100).alias("error_percent")
    )
