"""Weighted full-text search over snippets and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import english
from ..functions import similarity as sim
from ..session import materialize
from .catalog import Tables, in_source
from .relations import neighbours, related_contexts

FALLBACK_BELOW = 5
MARKDOWN_DOCS = 10
#: Page fields: the title weighs as A, the text as B.
PAGE_WEIGHTS = {"title": 10, "markdown_content": 4}


def postings(snippets: DataFrame) -> DataFrame:
    """The inverted index (term, id, field, tf), to be written bucketed or sorted by term."""
    rows = None
    for name, c in sim.field_texts().items():
        part = snippets.select("id", F.lit(name).alias("field"), F.explode(sim.tokens(c)).alias("term"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("term", "id", "field").agg(F.count("*").alias("tf"))


def search_postings(index: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, rank) from the inverted index: only the query's terms are read, all must be there."""
    wanted = sim.query_tokens(query)
    if not wanted:
        return index.select("id", F.lit(0).cast("long").alias("rank")).limit(0)
    weight = F.coalesce(*[F.when(F.col("field") == k, v) for k, v in sim.WEIGHTS.items()])
    score = F.floor(F.col("tf") * weight * 1000 / (F.col("tf") + 1)).cast("long")
    hits = index.where(F.col("term").isin(wanted)).groupBy("id").agg(F.sum(score).alias("rank"), F.countDistinct("term").alias("terms"))
    return hits.where(F.col("terms") == len(wanted)).orderBy(F.desc("rank"), "id").limit(limit).select("id", "rank")


def _in_sources(t: Tables, source_ids: list[str] | None) -> DataFrame | None:
    if not source_ids:
        return None
    return t.documents.where(in_source(*source_ids)).select(F.col("doc_id").alias("document_id"))


def scoped(t: Tables, source_ids: list[str] | None = None, language: str | None = None, snippet_type: str | None = None) -> DataFrame:
    """The snippets a search may return, in each of its phases; every predicate reaches the scan."""
    s = t.snippets
    if language:
        s = s.where(F.col("language") == language.lower())
    if snippet_type:
        s = s.where(F.col("snippet_type") == snippet_type)
    if (d := _in_sources(t, source_ids)) is not None:
        s = s.join(d, "document_id", "left_semi")
    return s


def direct(t: Tables, query: str, source_ids: list[str] | None = None, language: str | None = None, snippet_type: str | None = None) -> DataFrame:
    """All matching snippets with their rank. Without a query all snippets match with rank 0.

    Fields are tokenised for rows that survive the scope only."""
    s = scoped(t, source_ids, language, snippet_type)
    fields = sim.field_texts()
    if query:
        s = s.where(sim.matches(list(fields.values()), query))
    return s.select("id", "document_id", "title", "language", "created_at", (sim.rank(fields, query) if query else F.lit(0).cast("long")).alias("rank"))


def search_direct(t: Tables, query: str, limit: int = 10, offset: int = 0, **filters) -> DataFrame:
    """A page of direct hits, best first; without a query the newest."""
    hits = direct(t, query, **filters)
    order = [F.desc("rank"), "id"] if query else [F.desc("created_at"), "id"]
    return hits.orderBy(*order).offset(offset).limit(limit).select("id", "title", "language", "rank")


def search_function(t: Tables, query: str | None = None, source: str | None = None, language: str | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """Ranked snippets with a preview; all filters optional, the source is part of the address."""
    s = t.snippets
    if source:
        s = s.where(F.contains(F.lower("source_url"), F.lit(source.lower())))
    if language:
        s = s.where(F.col("language") == language)
    fields = sim.field_texts()
    if query is not None:
        s = s.where(sim.matches(list(fields.values()), query))
    s = s.select("id", "title", "source_url", "language", (sim.rank(fields, query) if query is not None else F.lit(0).cast("long")).alias("rank"), F.substring("code_content", 1, 200).alias("snippet_preview"), "created_at")
    order = [F.desc("rank"), "id"] if query is not None else [F.desc_nulls_first("created_at"), "id"]
    return s.orderBy(*order).offset(offset).limit(limit).drop("created_at")


def search_pages(t: Tables, query: str, source_ids: list[str] | str | None = None, limit: int = MARKDOWN_DOCS, stems: bool = False) -> DataFrame:
    """(doc_id, title, rank): best pages by title and text; with ``stems`` words match by their English stem."""
    ids = [source_ids] if isinstance(source_ids, str) else source_ids
    d = t.documents.where(in_source(*ids)) if ids else t.documents
    fields = {k: F.col(k) for k in PAGE_WEIGHTS}
    d = d.where((english if stems else sim).matches(list(fields.values()), query))
    return d.select("doc_id", "title", sim.rank(fields, query, PAGE_WEIGHTS).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(limit)


def _phases(t: Tables, query: str, source_ids: list[str] | None, language: str | None, snippet_type: str | None, limit: int, offset: int, enhanced: bool, expand: bool, fallback: bool, stems: bool) -> DataFrame:
    """(id, phase, rank, created_at, page_rank) of up to offset + limit snippets of each phase, before the page is cut.

    The scope holds in every phase. The first phases have at most offset + limit rows each and are written once.
    """
    need = offset + limit
    none = F.lit(None).cast("long").alias("page_rank")
    out = materialize(direct(t, query, source_ids, language, snippet_type).orderBy(F.desc("rank"), "id").limit(need).select("id", F.lit(0).alias("phase"), "rank", "created_at", none), "hits")
    fields = list(sim.field_texts().values())
    if expand:
        near = neighbours(t, out.select("id")).select(F.col("related_snippet_id").alias("id")).distinct()
        # what matches by itself is a direct hit, on this page or a later one
        near = scoped(t, source_ids, language, snippet_type).join(near, "id", "left_semi").where(~F.coalesce(sim.matches(fields, query), F.lit(False)))
        near = near.orderBy("id").limit(limit).select("id", F.lit(1).alias("phase"), F.lit(0).cast("long").alias("rank"), "created_at", none)
        out = materialize(out.unionByName(near), "hits")
    # at most 2 x need rows, so their number says whether pages are to be searched
    if fallback and (enhanced or out.count() < FALLBACK_BELOW):
        pages = search_pages(t, query, source_ids, stems=stems).select(F.col("doc_id").alias("document_id"), F.col("rank").alias("page_rank"))
        found = scoped(t, source_ids, language, snippet_type).join(F.broadcast(pages), "document_id").join(F.broadcast(out.select("id")), "id", "left_anti")  # both sides are limited above
        found = found.orderBy(F.desc_nulls_first("created_at"), "id").limit(need)
        out = out.unionByName(found.select("id", F.lit(2).alias("phase"), F.lit(0).cast("long").alias("rank"), "created_at", "page_rank"))
    return out


def _page(out: DataFrame, limit: int, offset: int) -> DataFrame:
    return out.orderBy("phase", F.desc("rank"), F.desc_nulls_first(F.when(F.col("phase") == 2, F.col("created_at"))), "id").offset(offset).limit(limit)


def search(t: Tables, query: str, source_ids: list[str] | None = None, language: str | None = None, limit: int = 10, offset: int = 0, enhanced: bool = False, expand: bool = True, fallback: bool = True, snippet_type: str | None = None, stems: bool = False) -> DataFrame:
    """The search pipeline: (id, phase, rank), one page.

    Phase 0 holds direct hits by rank, phase 1 snippets related to them where room is left on the page,
    phase 2 the snippets of matching pages, newest first, if ``enhanced`` or if the first phases give
    fewer than FALLBACK_BELOW. Later phases leave out what earlier ones hold. Sources, language and type
    bind all three.
    """
    return _page(_phases(t, query, source_ids, language, snippet_type, limit, offset, enhanced, expand, fallback, stems), limit, offset).select("id", "phase", "rank")


def search_annotated(t: Tables, query: str, limit: int = 10, offset: int = 0, **options) -> DataFrame:
    """(id, phase, rank, method, page_rank, contexts): a page of ``search`` with how each row was found.

    method is direct, related or markdown; page_rank is the rank of the page that led to a snippet; contexts
    are the edges to hits of the page, as sorted JSON.
    """
    o = {"source_ids": None, "language": None, "snippet_type": None, "enhanced": False, "expand": True, "fallback": True, "stems": False} | options
    page = materialize(_page(_phases(t, query, o["source_ids"], o["language"], o["snippet_type"], limit, offset, o["enhanced"], o["expand"], o["fallback"], o["stems"]), limit, offset), "page")
    edges = related_contexts(t, page.where("phase = 0").select("id"))
    method = F.when(F.col("phase") == 0, "direct").when(F.col("phase") == 1, "related").otherwise("markdown")
    return page.join(edges, "id", "left").select("id", "phase", "rank", method.alias("method"), "page_rank", F.when(F.col("phase") == 1, F.col("contexts")).alias("contexts"))


def search_total(t: Tables, query: str, source_ids: list[str] | None = None, language: str | None = None, limit: int = 10, snippet_type: str | None = None, stems: bool = False) -> DataFrame:
    """(direct, related, from_pages, total): what a first page of ``search`` stands for: all direct hits, the
    related ones shown, and all snippets of the pages if those were searched."""
    out = materialize(_phases(t, query, source_ids, language, snippet_type, limit, 0, False, True, False, stems), "hits")
    n = direct(t, query, source_ids, language, snippet_type).agg(F.count("*").alias("direct"))
    related = out.agg(F.count_if(F.col("phase") == 1).alias("related"), F.count("*").alias("shown"))
    pages = search_pages(t, query, source_ids, stems=stems).select(F.col("doc_id").alias("document_id"))
    more = scoped(t, source_ids, language, snippet_type).join(F.broadcast(pages), "document_id", "left_semi").join(F.broadcast(out.select("id")), "id", "left_anti").agg(F.count("*").alias("more"))
    one = n.crossJoin(F.broadcast(related)).crossJoin(F.broadcast(more))  # three one-row aggregates
    return one.select("direct", "related", F.when(F.col("shown") < FALLBACK_BELOW, F.col("more")).otherwise(0).alias("from_pages")).withColumn("total", F.col("direct") + F.col("related") + F.col("from_pages"))


def with_code(t: Tables, hits: DataFrame, context: bool = True) -> DataFrame:
    """The snippets of hits with their columns; without ``context`` the text around the code is blank."""
    s = t.snippets.drop("rank")
    blank = {} if context else {c: F.lit("") for c in ("context_before", "context_after", "description") if c in s.columns}
    return hits.join(s.withColumns(blank) if blank else s, "id")


def similar_code(t: Tables, code: str, least: float = 0.1, limit: int = 10) -> DataFrame:
    """Snippets by trigram similarity of their code to a given one."""
    s = t.snippets.select("id", sim.similarity(F.col("code_content"), F.lit(code)).alias("score"))
    # the threshold follows the cut: the same rows, and the score is computed once a row
    return s.orderBy(F.desc("score"), "id").limit(limit).where(F.col("score") > least)


def sections(t: Tables, query: str, budget: int = 500) -> DataFrame:
    """(doc_id, section_no, section): sections that hold the query, packed per page to a token budget.

    Sections begin at headings; they are packed in order while the running sum of estimated tokens fits.
    """
    from pyspark.sql import Window

    from ..functions.text import count_tokens

    parts = t.documents.where(F.contains(F.lower("markdown_content"), F.lit(query.lower()))).select("doc_id", F.posexplode(F.split("markdown_content", r"\n(?=#+ )")).alias("section_no", "section"))
    hits = parts.where(F.contains(F.lower("section"), F.lit(query.lower())))
    run = F.sum(count_tokens(F.col("section"))).over(Window.partitionBy("doc_id").orderBy("section_no"))
    return hits.withColumn("used", run).where(F.col("used") <= budget).select("doc_id", "section_no", "section", "used")


def section_digests(t: Tables, query: str, budget: int = 2048) -> DataFrame:
    """(doc_id, text): per page its sections that hold the query, up to a token budget, with a notice of what is left out.

    A first section over the budget is cut. Pages that hold the query's words, but in no section as it stands,
    give excerpts around them.
    """
    from pyspark.sql import Window

    from ..functions.text import count_tokens
    from .chunking import headlines

    q = F.lit(query.lower())
    pages = t.documents.where(F.contains(F.lower("markdown_content"), q)).select("doc_id", F.posexplode(F.split("markdown_content", r"\n(?=#+ )")).alias("no", "section"))
    run = F.sum(count_tokens(F.col("section"))).over(Window.partitionBy("doc_id").orderBy("no"))  # a page's sections
    hits = pages.where(F.contains(F.lower("section"), q)).withColumn("used", run)
    fits = F.col("used") <= budget
    per = hits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(fits, F.struct("no", "section")))).alias("kept"), F.min(F.when(~fits, F.struct("no", "section"))).alias("over"))
    kept = F.array_join(F.col("kept.section"), "\n\n")
    cut = F.concat(F.substring("over.section", 1, 4 * budget), F.lit("\n\n[Section truncated to fit token limit...]"))
    text = F.when(F.col("over").isNull(), kept).when(F.size("kept") == 0, cut).otherwise(F.concat(kept, F.lit("\n\n[1 more matching sections omitted due to token limit]")))
    out = per.select("doc_id", text.alias("text"))
    rest = t.documents.join(out.select("doc_id"), "doc_id", "left_anti")
    return out.unionByName(headlines(rest, "doc_id", "markdown_content", query, before="", after="", most=max(1, budget // 2)).select(F.col("id").alias("doc_id"), F.col("excerpt").alias("text")))


def ranked_excerpts(t: Tables, query: str, limit: int = 5, length: int = 200) -> DataFrame:
    """(doc_id, rank, excerpt, headline): the best pages with an excerpt around the query's words and short marked fragments."""
    from .chunking import headlines

    best = materialize(search_pages(t, query, limit=limit).select("doc_id", "rank"), "pages")
    d = t.documents.join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi")  # at most limit rows
    long = headlines(d, "doc_id", "markdown_content", query, fragments=1, most=length, before="<<<", after=">>>").withColumnRenamed("id", "doc_id")
    short = headlines(d, "doc_id", "markdown_content", query, fragments=3, most=50).select(F.col("id").alias("doc_id"), F.col("excerpt").alias("headline"))
    return best.join(long, "doc_id", "left").join(short, "doc_id", "left")


def with_relationships(t: Tables, query: str, limit: int = 20, **scope) -> DataFrame:
    """(id, rank, is_primary, contexts): direct hits, and where they leave room the snippets related to them."""
    primary = materialize(direct(t, query, **scope).orderBy(F.desc("rank"), "id").limit(limit).select("id", "rank"), "hits")
    room = limit - primary.count()  # at most limit rows
    near = related_contexts(t, primary.select("id")).join(scoped(t, **scope).select("id"), "id", "left_semi").orderBy("id").limit(room)
    out = primary.select("id", "rank", F.lit(True).alias("is_primary"), F.lit(None).cast("string").alias("contexts"))
    return out.unionByName(near.select("id", F.lit(0).cast("long").alias("rank"), F.lit(False).alias("is_primary"), "contexts"))


def trigram_postings(snippets: DataFrame) -> DataFrame:
    """(gram, id, n): the distinct trigrams of every snippet's code and their number, to be stored sorted by gram."""
    grams = F.coalesce(sim.trigrams(F.col("code_content")), F.array().cast("array<string>"))
    return snippets.select("id", grams.alias("g")).select("id", F.size("g").alias("n"), F.explode("g").alias("gram")).select("gram", "id", "n")


def similar_by_postings(index: DataFrame, code: str, least: float = 0.1, limit: int = 10) -> DataFrame:
    """(id, score): the snippets of ``similar_code``, from the trigram postings of the given code's trigrams only."""
    wanted = index.sparkSession.range(1).select(sim.trigrams(F.lit(code)).alias("g")).first()["g"] or []
    both = F.count("*")
    hits = index.where(F.col("gram").isin(wanted)).groupBy("id").agg((both / (F.max("n") + len(wanted) - both)).alias("score"))
    return hits.orderBy(F.desc("score"), "id").limit(limit).where(F.col("score") > least)


def store_postings(index: DataFrame, path: str, by: str) -> DataFrame:
    """Write an index sorted by its term, so that a query reads few row groups, and read it back."""
    index.repartitionByRange(by).sortWithinPartitions(by).write.option("parquet.block.size", 16 << 20).parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)
