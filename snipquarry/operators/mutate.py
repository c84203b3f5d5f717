"""Deletes, renames and status changes as new table versions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from .catalog import Tables, in_source, job_of


def delete_sources(t: Tables, ids: DataFrame) -> Tables:
    """All tables without the sources in ``ids`` (column id) and what hangs on them: documents, snippets,
    relationships and failed pages."""
    gone = ids.select("id").distinct()
    by_job = gone.withColumnRenamed("id", "source_id")
    docs = t.documents.withColumn("source_id", job_of())
    kept = docs.join(by_job, "source_id", "left_anti").drop("source_id")
    lost_docs = docs.join(by_job, "source_id", "left_semi").select(F.col("doc_id").alias("document_id"))
    lost = t.snippets.join(lost_docs, "document_id", "left_semi").select("id")
    return replace(
        t,
        documents=kept,
        crawl_jobs=t.crawl_jobs.join(gone, "id", "left_anti"),
        upload_jobs=t.upload_jobs.join(gone, "id", "left_anti"),
        failed_pages=t.failed_pages.join(gone.withColumnRenamed("id", "crawl_job_id"), "crawl_job_id", "left_anti"),
        **_without_snippets(t, lost),
    )


def _without_snippets(t: Tables, ids: DataFrame) -> dict[str, DataFrame]:
    edges = t.relationships.join(ids.withColumnRenamed("id", "source_snippet_id"), "source_snippet_id", "left_anti").join(ids.withColumnRenamed("id", "target_snippet_id"), "target_snippet_id", "left_anti")
    return {"snippets": t.snippets.join(ids, "id", "left_anti"), "relationships": edges}


def matching_snippets(t: Tables, source_id: str, query: str | None = None, language: str | None = None) -> DataFrame:
    """Snippets of a source by query (all lexemes in one field) and language."""
    s = t.snippets.join(t.documents.where(in_source(source_id)).select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    if language:
        s = s.where(F.col("language") == language)
    if query:
        hit = F.lit(False)
        for c in ("code_content", "title", "description"):
            hit = hit | sim.matches([F.col(c)], query)
        s = s.where(hit)
    return s.select("id")


def delete_matching(t: Tables, source_id: str, query: str | None = None, language: str | None = None) -> Tables:
    return replace(t, **_without_snippets(t, matching_snippets(t, source_id, query, language)))


def remaining(t: Tables) -> DataFrame:
    """(name, n): rows left in each table."""
    out = None
    for name in ("crawl_jobs", "documents", "failed_pages", "relationships", "snippets", "upload_jobs"):
        part = getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def rename(jobs: DataFrame, job_id: str, name: str, version: str | None) -> DataFrame:
    """Jobs with one renamed; ``conflict`` marks that another job has the name and version already."""
    taken = jobs.where((F.col("id") != job_id) & (F.col("name") == name) & F.col("version").eqNullSafe(F.lit(version))).agg((F.count("*") > 0).alias("conflict"))
    me = F.col("id") == job_id
    return jobs.crossJoin(F.broadcast(taken)).select("id", F.when(me & ~F.col("conflict"), name).otherwise(F.col("name")).alias("name"), F.when(me & ~F.col("conflict"), F.lit(version)).otherwise(F.col("version")).alias("version"), (me & F.col("conflict")).alias("conflict"))


def simplify_status(jobs: DataFrame) -> DataFrame:
    """Old states to running and completed, what was failed or cancelled keeping a message."""
    s = F.col("status")
    message = F.when(s == "cancelled", F.coalesce("error_message", F.lit("Cancelled by user"))).otherwise(F.col("error_message"))
    return jobs.withColumn("error_message", message).withColumn("status", F.when(s.isin("pending", "running", "paused"), "running").otherwise("completed"))


def cancel(jobs: DataFrame, ids: list[str], now: str) -> DataFrame:
    hit = F.col("id").isin(ids) & (F.col("status") == "running")
    return jobs.withColumn("error_message", F.when(hit, "Cancelled by user").otherwise(F.col("error_message"))).withColumn("completed_at", F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("completed_at"))).withColumn("status", F.when(hit, "completed").otherwise(F.col("status")))


def deletable(jobs: DataFrame) -> DataFrame:
    return jobs.where("status <> 'running'").select("id")


def merge_patterns(old: list[str], new: list[str]) -> list[str]:
    """Ordered union, first wins."""
    return list(dict.fromkeys([*old, *new]))
