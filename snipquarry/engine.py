"""The engine's front: tables of one folder and the tools over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.similarity import query_tokens
from .functions.text import format_snippet
from .operators import catalog, chunking, ingest, resolve, search
from .operators.catalog import Tables
from .session import read_table

NAMES = {"documents": "documents", "snippets": "code_snippets", "crawl_jobs": "crawl_jobs", "upload_jobs": "upload_jobs", "failed_pages": "failed_pages", "relationships": "snippet_relationships", "heartbeats": "crawl_heartbeats"}


def tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(**{k: read_table(spark, folder, v) for k, v in NAMES.items()})


class Engine:
    """The five tools: search_libraries, get_content, get_snippet, get_page_markdown, init_crawl."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.t = spark, tables(spark, folder)

    def search_libraries(self, query: str = "", limit: int = 10, page: int = 1) -> DataFrame:
        return resolve.search_libraries(self.t, query, limit, (page - 1) * limit)

    def get_content(self, library: str, query: str = "", limit: int = 10, page: int = 1) -> dict:
        """One page of formatted results of a library; suggestions if the name isn't clear."""
        got = resolve.resolve(self.t, library)
        if got["status"] != "selected":
            return got
        ids = [got["id"]]
        offset = (page - 1) * limit
        hits = search.search(self.t, query, ids, limit=limit, offset=offset, stems=True) if query_tokens(query) else search.search_direct(self.t, "", limit, offset, source_ids=ids).select("id", F.lit(0).alias("phase"), "rank")
        shown = search.with_code(self.t, chunking.result_cap(hits))
        text = F.when(F.col("cap") == 2000, format_snippet(*map(F.col, ("title", "description", "source_url", "language", "code_content")), tokens=2000)).otherwise(format_snippet(*map(F.col, ("title", "description", "source_url", "language", "code_content")), tokens=500))
        rows = shown.orderBy("phase", F.desc("rank"), "id").select(text.alias("text")).collect()  # one page
        total = search.search_total(self.t, query, ids, limit=limit, stems=True).first()["total"] if query_tokens(query) else search.scoped(self.t, ids).count()
        header = f"Found {total} results (showing page {page}: {len(rows)})"
        return {"status": "ok", "total": total, "text": "\n".join([header, *[r["text"] for r in rows]])}

    def get_snippet(self, snippet_id: int, max_tokens: int | None = None, chunk_index: int | None = None, chunk_size: int = 2000) -> dict:
        s = self.t.snippets.where(F.col("id") == int(snippet_id))
        if chunk_index is not None:
            row = s.select(chunking.chunk_at(F.col("code_content"), chunk_size, chunk_index).alias("c")).first()
            return {"status": "not_found"} if row is None else {"status": "error" if row["c"]["error"] else "ok", **row["c"].asDict()}
        row = s.select(format_snippet(*map(F.col, ("title", "description", "source_url", "language", "code_content")), tokens=max_tokens).alias("text")).first()
        return {"status": "not_found"} if row is None else {"status": "ok", "text": row["text"]}

    def get_page_markdown(self, url: str | None = None, snippet_id: int | None = None, query: str | None = None, max_tokens: int | None = None, chunk_index: int | None = None, chunk_size: int = 4000) -> dict:
        if (url is None) == (snippet_id is None):
            return {"status": "error", "error": "give a url or a snippet_id"}
        d = self.t.documents
        d = d.where(F.col("url") == url) if url is not None else d.join(self.t.snippets.where(F.col("id") == int(snippet_id)).select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi")
        row = d.orderBy("doc_id").select("url", "title", "markdown_content").first()
        if row is None:
            return {"status": "not_found"}
        body = row["markdown_content"] or ""
        if query:
            excerpt = chunking.headline(body, query_tokens(query))
            return {"status": "ok", "url": row["url"], "content": excerpt or f"No matches for '{query}' on this page."}
        chunks = chunking.pack_paragraphs(body, chunk_size)
        if max_tokens:
            return {"status": "ok", "url": row["url"], "content": chunking.within_budget(chunks, max_tokens), "total_chunks": len(chunks)}
        if chunk_index is not None:
            if not 0 <= chunk_index < len(chunks):
                return {"status": "error", "error": f"Chunk index {chunk_index} out of range (0-{len(chunks) - 1})"}
            return {"status": "ok", "url": row["url"], "content": chunks[chunk_index], "total_chunks": len(chunks), "has_more": chunk_index < len(chunks) - 1}
        return {"status": "ok", "url": row["url"], "content": body, "total_chunks": len(chunks)}

    def init_crawl(self, name: str | None, start_urls: list[str], version: str | None = None) -> DataFrame:
        """The job a crawl would run as, existing or new."""
        auto = F.lit(name or f"[Auto-detecting from {start_urls[0]}]")
        wanted = self.spark.range(1).select(auto.alias("name"), F.lit(version).cast("string").alias("version"))
        return ingest.get_or_create_jobs(self.t.crawl_jobs, wanted)

    def statistics(self) -> DataFrame:
        return catalog.dashboard(self.t)
