"""Incremental ingest: change detection, source-scoped deduplication, versioned upserts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialize

ORPHAN = "-"


def scope(kind: str = "crawl_job_id", other: str = "upload_job_id") -> Column:
    """The source within which code counts as the same; documents without a source share one scope."""
    return F.coalesce(F.concat(F.lit("c:"), F.col(kind)), F.concat(F.lit("u:"), F.col(other)), F.lit(ORPHAN))


def classify(incoming: DataFrame, stored: DataFrame, ignore_hash: bool = False) -> DataFrame:
    """Incoming pages (url, content_hash, ...) with change: new, changed or unchanged against the stored ones.

    Of repeated stored addresses any equal hash makes a page unchanged, so no page comes out twice.
    """
    old = stored.groupBy("url").agg(F.collect_set(F.coalesce(F.lower("content_hash"), F.lit(""))).alias("_old")).withColumn("_held", F.lit(True))
    same = F.lit(False) if ignore_hash else F.array_contains("_old", F.coalesce(F.lower("content_hash"), F.lit("")))
    kind = F.when(F.col("_held").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return incoming.join(old, "url", "left").withColumn("change", kind).drop("_old", "_held")


def first_per_scope(blocks: DataFrame, existing: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """First block of each (scope, code_hash), without those ``existing`` holds; blocks without code are left out.

    A minimum over the order is aggregated before the shuffle, so a block that recurs everywhere moves
    once per task.
    """
    order = order or ["document_id", "block_no"]
    b = blocks.where(F.coalesce(F.col("code_content") != "", F.lit(False)))
    key = F.struct(*order)
    firsts = b.groupBy("scope", "code_hash").agg(F.min(key).alias("_first"))
    if existing is not None:
        firsts = firsts.join(existing.select("scope", "code_hash"), ["scope", "code_hash"], "left_anti")
    return b.withColumn("_first", key).join(firsts, ["scope", "code_hash", "_first"], "left_semi").drop("_first")


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "url", newest: str | None = None) -> DataFrame:
    """The next version of a table: incoming rows replace stored ones with an equal key.

    Of incoming rows with one key the newest counts; ties, and all rows without ``newest``, go by the rows'
    values, so the result is defined. Rows without a key are all kept.
    """
    every = [F.col(c) for c in incoming.columns]
    order = F.struct(*([F.col(newest)] if newest else []), F.xxhash64(*every), F.to_json(F.struct(*every)))
    best = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*every), order).alias("_row"))
    incoming = best.select(*[F.col("_row")[c].alias(c) for c in incoming.columns]).unionByName(incoming.where(F.col(key).isNull()))
    kept = stored.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def replace_snippets(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Snippets after an ingest: a document's old ones go only if new ones came."""
    kept = stored.join(fresh.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def clear_failed(failed: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Failed pages that haven't succeeded since, by job and address."""
    return failed.join(succeeded.select("crawl_job_id", "url").distinct(), ["crawl_job_id", "url"], "left_anti")


def record_failed(failed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Failed pages with new ones, each job and address once, the first report staying."""
    first = F.row_number().over(Window.partitionBy("crawl_job_id", "url").orderBy("failed_at", "id"))
    new = fresh.join(failed.select("crawl_job_id", "url"), ["crawl_job_id", "url"], "left_anti").withColumn("_rn", first).where("_rn = 1").drop("_rn")
    return failed.unionByName(new, allowMissingColumns=True)


def distinct_failed(failed: DataFrame) -> DataFrame:
    return record_failed(failed.limit(0), failed)


def get_or_create_jobs(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, version, id, created): the job of each wanted name and version; a null version equals null."""
    j = jobs.groupBy(F.col("name").alias("n"), F.col("version").alias("v")).agg(F.min("id").alias("old"))
    w = wanted.select("name", "version").distinct()
    got = w.join(j, (F.col("name") == F.col("n")) & F.col("version").eqNullSafe(F.col("v")), "left")
    made = F.md5(F.concat_ws("\u0001", "name", F.coalesce("version", F.lit("\u0002"))))
    return got.select("name", "version", F.coalesce("old", made).alias("id"), F.col("old").isNull().alias("created"))


def apply_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Metadata after regeneration: null new values keep the old; ``changed`` tells whether anything differs."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    merged = old.join(n, key, "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.coalesce(f"_{c}", c).eqNullSafe(F.col(c))
    return merged.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], differs.alias("changed"))


def store_defaults(blocks: DataFrame, page_title: str = "page_title") -> DataFrame:
    """Blocks as stored: hash, language, title and description with their fallbacks."""
    p = F.col(page_title)
    return blocks.where(text.strip(F.col("code_content")) != "").withColumns(
        {"code_hash": text.content_hash(F.col("code_content")), "language": text.language_name(F.col("language")), "title": text.fallback_title(F.col("title"), p, F.col("block_no")), "description": text.fallback_description(F.col("description"), p)}
    )


def skip_rate(classified: DataFrame) -> DataFrame:
    """pages, skipped, percent of a crawl that had nothing to do."""
    return classified.agg(F.count("*").alias("pages"), F.count_if(F.col("change") == "unchanged").alias("skipped")).withColumn("percent", F.when(F.col("pages") > 0, F.round(F.col("skipped") * 100.0 / F.col("pages"), 4)).otherwise(0.0))


def regeneration_summary(changes: DataFrame, key: str, preview: int = 10) -> DataFrame:
    """total, changed, and the keys of changed rows among the first ``preview`` rows by key."""
    first = changes.orderBy(key).limit(preview).where("changed").agg(F.sort_array(F.collect_list(key)).alias("preview"))
    return changes.agg(F.count("*").alias("total"), F.count_if("changed").alias("changed")).crossJoin(F.broadcast(first))


def page_hash(markdown: Column) -> Column:
    """The change hash of a page: of its Markdown without link targets, so that moved links change nothing."""
    return F.md5(text.unlink_markdown(F.coalesce(markdown, F.lit(""))))


def chosen_markdown(fit: Column, raw: Column) -> Column:
    """What is stored of a page: the fitted Markdown unless it is blank, else the raw one. Hashes go by the raw one."""
    return F.when(text.strip(F.coalesce(fit, F.lit(""))) != "", fit).otherwise(raw)


@dataclass(frozen=True)
class Ingested:
    """The next versions of the tables after a batch of pages, and the batch's own rows."""

    documents: DataFrame
    snippets: DataFrame
    pages: DataFrame  # incoming pages with their change
    blocks: DataFrame  # snippets that came in


def ingest_pages(documents: DataFrame, snippets: DataFrame, incoming: DataFrame, ignore_hash: bool = False) -> Ingested:
    """One batch of pages (doc_id, url, title, markdown_content, content_type, crawl_job_id, upload_job_id) through the
    whole path: change detection by hash, extraction of new and changed pages only, defaults, the first block
    of each code within its source, and replacement.

    A page that comes back under its address keeps the stored doc_id, so its old snippets go if new ones came; the
    counts of snippets that unchanged pages keep come with them. Running the same batch again changes nothing.
    Snippet ids follow from document and code.
    """
    from .extract import extract

    ids = documents.where("url is not null").groupBy("url").agg(F.min("doc_id").alias("_known"))
    page = incoming.withColumn("content_hash", page_hash(F.col("markdown_content"))).join(ids, "url", "left").withColumn("doc_id", F.coalesce("_known", "doc_id")).drop("_known")
    page = materialize(page.groupBy("doc_id").agg(F.min_by(F.struct(*page.columns), F.struct(F.col("content_hash"), F.col("title"))).alias("_p")).select("_p.*"), "ingest-pages")
    kept = snippets.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("kept_snippets"))
    change = classify(page, documents, ignore_hash).join(kept, "doc_id", "left").withColumn("kept_snippets", F.when(F.col("change") == "unchanged", F.coalesce("kept_snippets", F.lit(0))).otherwise(0))
    change = materialize(change, "ingest-changes")
    todo = change.where("change <> 'unchanged'")
    blocks = extract(todo, "doc_id", "markdown_content", "content_type" if "content_type" in todo.columns else None, None if "content_type" in todo.columns else "markdown")
    about = todo.select(F.col("doc_id").alias("id"), F.col("title").alias("page_title"), F.col("url").alias("source_url"), scope().alias("scope"))
    fresh = store_defaults(blocks.join(about, "id")).withColumnRenamed("id", "document_id")
    # code that the source holds on other pages isn't taken again
    held = snippets.join(documents.select(F.col("doc_id").alias("document_id"), scope().alias("scope")), "document_id").join(todo.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti")
    fresh = first_per_scope(fresh, held.select("scope", F.lower("code_hash").alias("code_hash")).distinct())
    fresh = materialize(fresh.withColumn("id", F.xxhash64("document_id", "code_hash")).drop("scope", "page_title", "block_no"), "ingest-blocks")
    stored = change.where("change <> 'unchanged'").drop("change", "kept_snippets")
    return Ingested(upsert(documents, stored, "doc_id"), replace_snippets(snippets, fresh), change.select("doc_id", "url", "change", "kept_snippets"), fresh)


AUTO = "[Auto-detecting"


def auto_names(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, name): jobs that still bear the placeholder take the site name of their first page, by depth and id."""
    first = documents.where("crawl_job_id is not null").groupBy(F.col("crawl_job_id").alias("id")).agg(F.min_by(F.struct("title", "meta_data"), F.struct(F.coalesce("crawl_depth", F.lit(0)), "doc_id")).alias("page"))
    name = text.site_name(F.col("page.title"), F.col("page.meta_data"))
    return jobs.join(first, "id", "left").select("id", F.when(F.col("name").startswith(AUTO), F.coalesce(name, F.col("name"))).otherwise(F.col("name")).alias("name"))
