"""Queries over whole tables with their SQL; limits are those of page queries and top-k reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, html_markdown, similarity, text
from ..operators import catalog, chunking, extract, frontier, ingest, jobs, mutate, relations, resolve, search
from ..streaming import progress as live
from .registry import query

NOW = "2025-06-20 00:00:00"
LIVE = "2025-07-14 05:10:00"
JOB = "24512bb4-93a1-4c1c-ab0d-13110f42b205"

# ---- SQL fragments ----------------------------------------------------------------------------------

SOURCES = """src as (
  select id, name, version, domain, status, start_urls, config, created_at, updated_at, 'crawl' as kind, cast(null as int) as file_count from crawl_jobs
  union all
  select id, name, version, null, status, [], null, created_at, updated_at, 'upload', file_count from upload_jobs)"""
DOCS = "d as (select *, coalesce(crawl_job_id, upload_job_id) as job_id from documents)"
STATS = f"""{SOURCES}, {DOCS},
stats as (
  select s.name, s.version, s.domain, json_extract_string(s.config, '$.metadata.repository') as repository, json_extract_string(s.config, '$.metadata.description') as description, s.status,
         count(distinct d.doc_id) as document_count, count(distinct cs.id) as snippet_count, sum(length(cs.code_content)) as total_characters, max(cs.created_at) as last_updated, s.id as job_id, s.kind as job_type
  from src s left join d on d.job_id = s.id left join code_snippets cs on cs.document_id = d.doc_id
  group by s.id, s.name, s.version, s.domain, s.status, s.config, s.kind)"""


def _tok(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"


FIELDS = {"title": "title", "description": "description", "code_content": "code_content", "functions": "array_to_string(functions, ' ')", "imports": "array_to_string(imports, ' ')"}


def _match(fields: list[str], q: str) -> str:
    every = " || ".join(_tok(f) for f in fields)
    return "(" + " and ".join(f"list_contains({every}, '{w}')" for w in similarity.query_tokens(q)) + ")"


def _rank(fields: dict[str, str], q: str, weights: dict[str, int]) -> str:
    parts = []
    for name, f in fields.items():
        for w in similarity.query_tokens(q):
            tf = f"len(list_filter({_tok(f)}, lambda x: x = '{w}'))"
            parts.append(f"(({tf} * {1000 * weights[name]}) // ({tf} + 1))")
    return "cast(" + " + ".join(parts) + " as bigint)"


def _trgm(c: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _sim(a: str, b: str) -> str:
    x, y = f"coalesce({_trgm(a)}, [])", f"coalesce({_trgm(b)}, [])"
    return f"(case when len(list_distinct({x} || {y})) = 0 then 0.0::double else len(list_intersect({x}, {y}))::double / len(list_distinct({x} || {y})) end)"


DIRECT = f"select id, document_id, title, language, created_at, {_rank(FIELDS, 'cache buffer', similarity.WEIGHTS)} as rank from code_snippets where {_match(list(FIELDS.values()), 'cache buffer')}"
PAGE_FIELDS = {k: k for k in search.PAGE_WEIGHTS}


def _pages(q: str, n: int = 10, where: str = "true") -> str:
    return f"select doc_id, title, {_rank(PAGE_FIELDS, q, search.PAGE_WEIGHTS)} as rank from documents where {where} and {_match(list(PAGE_FIELDS), q)} order by rank desc, doc_id limit {n}"


NEIGHBOURS = """nb as (
  select distinct * from (
    select source_snippet_id as snippet_id, target_snippet_id as related_snippet_id, relationship_type, description from snippet_relationships
    union all
    select target_snippet_id, source_snippet_id, case relationship_type when 'imports' then 'imported_by' when 'extends' then 'extended_by' when 'implements' then 'implemented_by' when 'uses' then 'used_by' when 'example_of' then 'has_example' when 'configuration_for' then 'configured_by' else 'related' end, description from snippet_relationships))"""


def _phases(q: str, limit: int, offset: int, enhanced: bool, scope: str = "true", pages: str = "true") -> str:
    few = "" if enhanced else "and (select count(*) from ph1) < 5"
    return f"""with {NEIGHBOURS}, hits as (select id, {_rank(FIELDS, q, similarity.WEIGHTS)} as rank, created_at from code_snippets s where {scope} and {_match(list(FIELDS.values()), q)}),
top as (select id, 0 as phase, rank, created_at from hits order by rank desc, id limit {offset + limit}),
rel as (select s.id, 1 as phase, 0::bigint as rank, s.created_at from code_snippets s where {scope} and s.id in (select related_snippet_id from nb where snippet_id in (select id from top)) and s.id not in (select id from hits) order by s.id limit {limit}),
ph1 as (select * from top union all select * from rel),
pg as ({_pages(q, where=pages)}),
fb as (select s.id, 2 as phase, 0::bigint as rank, s.created_at, s.document_id from code_snippets s where {scope} and s.document_id in (select doc_id from pg) and s.id not in (select id from ph1) {few} order by s.created_at desc nulls first, s.id limit {offset + limit})"""


def _pipeline(q: str, limit: int, offset: int, enhanced: bool, scope: str = "true", pages: str = "true") -> str:
    return f"""{_phases(q, limit, offset, enhanced, scope, pages)}
select id, phase, rank from (select * from ph1 union all select id, phase, rank, created_at from fb) order by phase, rank desc, case when phase = 2 then created_at end desc nulls first, id limit {limit} offset {offset}"""


# ---- search -----------------------------------------------------------------------------------------


@query(f"select id, title, language, rank from ({DIRECT}) order by rank desc, id limit 10")
def search_direct(t):
    return search.search_direct(t, "cache buffer")


@query(f"select id, title, language, rank from ({DIRECT}) where language = 'python' order by rank desc, id limit 10 offset 5")
def search_language_page(t):
    return search.search_direct(t, "cache buffer", 10, 5, language="Python")


@query(f"select id, title, language, rank from ({DIRECT}) where document_id in (select doc_id from documents where crawl_job_id = '{JOB}') order by rank desc, id limit 10")
def search_in_source(t):
    return search.search_direct(t, "cache buffer", source_ids=[JOB])


@query("select id, title, language, 0::bigint as rank from code_snippets order by created_at desc, id limit 10")
def search_without_query(t):
    return search.search_direct(t, "")


@query(f"select id, title, source_url, language, {_rank(FIELDS, 'queue', similarity.WEIGHTS)} as rank, substr(code_content, 1, 200) as snippet_preview from code_snippets where contains(lower(source_url), 'guide') and {_match(list(FIELDS.values()), 'queue')} order by rank desc, id limit 10")
def search_function(t):
    return search.search_function(t, "queue", "guide")


@query(_pages("socket pager"))
def search_pages(t):
    return search.search_pages(t, "socket pager")


@query(_pipeline("cache buffer", 10, 0, False))
def search_pipeline(t):
    return search.search(t, "cache buffer")


@query(_pipeline("socket pager lexer cursor", 10, 0, False))
def search_fallback(t):
    return search.search(t, "socket pager lexer cursor")


@query(_pipeline("cache buffer", 10, 10, True))
def search_enhanced_page2(t):
    return search.search(t, "cache buffer", offset=10, enhanced=True)


IN_JOB = f"s.document_id in (select doc_id from documents where crawl_job_id = '{JOB}')"


@query(_pipeline("socket pager", 10, 0, False, IN_JOB, f"crawl_job_id = '{JOB}'"))
def search_in_source_fallback(t):
    return search.search(t, "socket pager", [JOB])


@query(_pipeline("cache", 30, 0, True, f"{IN_JOB} and s.language = 'python' and s.snippet_type = 'code'", f"crawl_job_id = '{JOB}'"))
def search_related_in_source(t):
    return search.search(t, "cache", [JOB], "Python", 30, enhanced=True, snippet_type="code")


@query(f"""select p.id, p.phase, p.rank, case p.phase when 0 then 'direct' when 1 then 'related' else 'markdown' end as method, g.rank as page_rank
from ({_pipeline("socket pager lexer cursor", 10, 0, False)}) p left join code_snippets s on s.id = p.id left join ({_pages("socket pager lexer cursor")}) g on p.phase = 2 and g.doc_id = s.document_id""")
def search_methods(t):
    return search.search_annotated(t, "socket pager lexer cursor").drop("contexts")


@query(f"""with ph as ({_phases("socket pager", 10, 0, False)} select phase, count(*) as n from (select * from ph1) group by phase), h as (select count(*) as n from code_snippets where {_match(list(FIELDS.values()), "socket pager")}),
shown as (select coalesce(sum(n), 0) as n, coalesce(sum(n) filter (phase = 1), 0) as r from ph),
more as (select count(*) as n from code_snippets s where s.document_id in (select doc_id from ({_pages("socket pager")})) and s.id not in (select id from ({_phases("socket pager", 10, 0, False)} select id from ph1)))
select h.n as direct, cast(shown.r as bigint) as related, case when shown.n < 5 then more.n else 0 end as from_pages, cast(h.n + shown.r + case when shown.n < 5 then more.n else 0 end as bigint) as total from h, shown, more""")
def search_totals(t):
    return search.search_total(t, "socket pager")


@query("select term, id, field, count(*) as tf from (" + " union all ".join(f"select id, '{k}' as field, unnest({_tok(f)}) as term from code_snippets" for k, f in FIELDS.items()) + ") group by all")
def search_postings(t):
    return search.postings(t.snippets)


@query(f"select id, rank from ({DIRECT}) order by rank desc, id limit 10")
def search_by_postings(t):
    return search.search_postings(search.postings(t.snippets), "cache buffer")


@query("""with s as (select doc_id, i - 1 as section_no, string_split(regexp_replace(markdown_content, '\\n(#+ )', chr(10) || chr(1) || '\\1', 'g'), chr(10) || chr(1)) as p, i
  from (select doc_id, markdown_content, unnest(range(1, len(string_split(regexp_replace(markdown_content, '\\n(#+ )', chr(10) || chr(1) || '\\1', 'g'), chr(10) || chr(1))) + 1)) as i from documents where contains(lower(markdown_content), 'dispatcher'))),
h as (select doc_id, cast(section_no as int) as section_no, p[i] as section from s where contains(lower(p[i]), 'dispatcher')),
u as (select *, cast(sum(length(section) // 4) over (partition by doc_id order by section_no) as bigint) as used from h)
select * from u where used <= 500""")
def page_sections(t):
    return search.sections(t, "dispatcher")


@query(f"select id, {_sim('code_content', chr(39) + 'def open_cache(buffer): return buffer.read()' + chr(39))} as score from code_snippets where score > 0.1 order by score desc, id limit 10")
def similar_code(t):
    return search.similar_code(t, "def open_cache(buffer): return buffer.read()")


@query(f"select id, {_sim('code_content', chr(39) + 'def open_cache(buffer): return buffer.read()' + chr(39))} as score from code_snippets where score > 0.1 order by score desc, id limit 10")
def similar_code_by_postings(t):
    return search.similar_by_postings(search.trigram_postings(t.snippets), "def open_cache(buffer): return buffer.read()")


@query(f"""with {NEIGHBOURS}, p as (select id, rank from ({DIRECT}) order by rank desc, id limit 20)
select id, rank, true as is_primary from p union all (select distinct related_snippet_id, 0::bigint, false from nb join code_snippets s on s.id = related_snippet_id where snippet_id in (select id from p) and related_snippet_id not in (select id from p) order by 1 limit (select 20 - count(*) from p))""")
def search_with_relationships(t):
    return search.with_relationships(t, "cache buffer").drop("contexts")


@query(f"select doc_id, rank from ({_pages('socket pager', 5)})")
def ranked_excerpts(t):
    return search.ranked_excerpts(t, "socket pager").select("doc_id", "rank")


@query("""with p as (select doc_id, string_split(regexp_replace(markdown_content, '\\n(#+ )', chr(10) || chr(1) || '\\1', 'g'), chr(10) || chr(1)) as a from documents where contains(lower(markdown_content), 'cache')),
x as (select doc_id, unnest(range(1, len(a) + 1)) as no, a from p), h as (select doc_id, no, a[no] as sec from x where contains(lower(a[no]), 'cache')),
u as (select *, sum(length(sec) // 4) over (partition by doc_id order by no) as used from h),
g as (select doc_id, string_agg(sec, chr(10) || chr(10) order by no) filter (used <= 300) as kept, arg_min(sec, no) filter (used > 300) as over_ from u group by 1)
select doc_id, case when over_ is null then kept when kept is null then substr(over_, 1, 1200) || chr(10) || chr(10) || '[Section truncated to fit token limit...]' else kept || chr(10) || chr(10) || '[1 more matching sections omitted due to token limit]' end as text from g""")
def section_digests(t):
    return search.section_digests(t, "cache", 300)


@query()
def page_headlines(t):
    return chunking.headlines(t.documents, "doc_id", "markdown_content", "socket pager")


# ---- libraries --------------------------------------------------------------------------------------

LIBS = f"""with {STATS}, l as (select job_id, name, version, domain, job_type, snippet_count, {_sim('lower(name)', "'dabopa'")} as name_similarity,
  case when domain is not null then {_sim("lower(split_part(domain, '.', 1))", "'dabopa'")} else 0.0 end as domain_similarity, case when lower(name) = 'dabopa' or coalesce(lower(split_part(domain, '.', 1)) = 'dabopa', false) then 0 else 1 end as exact from stats),
f as (select * from l where contains(lower(name), 'dabopa') or coalesce(contains(lower(split_part(domain, '.', 1)), 'dabopa'), false) or greatest(name_similarity, domain_similarity) > 0.1)"""


@query(LIBS + " select job_id, name, version, job_type, snippet_count, name_similarity from f order by exact, greatest(name_similarity, domain_similarity) desc, snippet_count desc, name, job_id limit 10")
def search_libraries(t):
    return resolve.search_libraries(t, "dabopa")


@query(f"with {STATS} select job_id, name, version, job_type, snippet_count, 1.0::double as name_similarity from stats order by snippet_count desc, name, job_id limit 10")
def list_libraries(t):
    return resolve.search_libraries(t)


@query(LIBS + " select count(*) as n from f")
def count_libraries(t):
    return resolve.count_libraries(t, "dabopa")


@query(LIBS + " select job_id, name, case when lower(name) = 'dabopa' then 'exact' when contains(lower(name), 'dabopa') then 'contains' else 'similarity' end as match, case when lower(name) = 'dabopa' then 100 else cast(round_even(name_similarity * 100, 0) as int) end as confidence, snippet_count < 10 as few_snippets from f")
def explain_matches(t):
    return resolve.explain_matches(t, "dabopa")


# ---- statistics -------------------------------------------------------------------------------------


@query(f"with {STATS} select * from stats")
def source_statistics(t):
    return catalog.source_statistics(t)


@query(f"""with {STATS}, o as (select *, cast(floor(date_diff('microsecond', last_updated, timestamp '{NOW}') / 86400000000.0) as bigint) as days from stats where job_type = 'crawl')
select job_id, name, upper(substr(status, 1, 1)) || substr(status, 2) as status, snippet_count, coalesce(total_characters, 0) as tokens,
 case when last_updated is null then null when days = 0 then 'Today' when days = 1 then 'Yesterday' when days < 7 then cast(cast(days as bigint) as varchar) || ' days ago' when days < 30 then cast(cast(days // 7 as bigint) as varchar) || case when days // 7 > 1 then ' weeks ago' else ' week ago' end else strftime(last_updated, '%m/%d/%Y') end as updated from o""")
def source_overview(t):
    return catalog.crawl_source_overview(t, NOW)


@query("select language, count(*) as n from code_snippets where language is not null and language <> '' and document_id in (select doc_id from documents where crawl_job_id in (select id from crawl_jobs)) group by 1")
def languages(t):
    return catalog.languages(t)


@query(f"with {DOCS} select job_id as source_id, language, count(*) as n from code_snippets s join d on d.doc_id = s.document_id where language is not null group by 1, 2")
def source_languages(t):
    return catalog.source_languages(t)


@query("select language, count(*) as n from code_snippets where language is not null and language <> '' and document_id in (select doc_id from documents where crawl_job_id in (select id from crawl_jobs)) group by 1 order by n desc, language limit 10")
def top_languages(t):
    return catalog.languages(t).orderBy(F.desc("n"), "language").limit(10)


_ALIAS_SQL = "case " + " ".join(f"when lower(trim(language)) = '{a}' then '{c}'" for a, c in text.ALIASES.items()) + " else lower(trim(language)) end"


@query(f"select case when language is null or language = '' then 'text' else {_ALIAS_SQL} end as language, count(*) as n from code_snippets group by 1")
def canonical_languages(t):
    return catalog.canonical_languages(t)


@query(f"with {DOCS} select job_id as source_id, count(*) as snippet_count from code_snippets s join d on d.doc_id = s.document_id group by 1")
def snippet_counts(t):
    return catalog.snippet_counts(t)


@query(f"""with {SOURCES} select 'sources' as metric, count(*) as value from src where status = 'completed' union all select 'documents', count(*) from documents union all select 'snippets', count(*) from code_snippets
union all select 'language:' || language, count(*) from code_snippets where language is not null group by language""")
def dashboard(t):
    return catalog.dashboard(t)


@query("""select * from (select id, name, status, created_at, 'crawl' as kind from crawl_jobs union all select id, name, status, created_at, 'upload' from upload_jobs) order by created_at desc, id limit 5""")
def recent_jobs(t):
    return catalog.recent_jobs(t)


# ---- listings ---------------------------------------------------------------------------------------


@query(f"""with {STATS} select s.id, s.name, s.version, coalesce(s.domain, 'upload') as domain, case when s.kind = 'upload' then 'Uploaded: ' || strftime(s.created_at, '%Y-%m-%d') else s.start_urls[1] end as base_url, st.document_count, st.snippet_count, s.file_count
from src s join stats st on st.job_id = s.id order by s.updated_at desc, s.id limit 10 offset 5""")
def list_sources(t):
    return catalog.list_sources(t, 10, 5)


@query(f"""with {STATS} select st.job_id as id, st.name, st.job_type, st.snippet_count from stats st join src s on s.id = st.job_id
where st.status = 'completed' and (contains(lower(s.name), 'e') or len(list_filter(s.start_urls, lambda u: contains(lower(u), 'e'))) > 0) and st.snippet_count >= 20 and st.snippet_count <= 400""")
def sources_filtered(t):
    return catalog.filtered_sources(t, "e", 20, 400)


@query(f"""with {STATS}, f as (select * from stats where status = 'completed' and job_type = 'crawl') select count(*) as total, cast(ceil(count(*) / 10.0) as bigint) as total_pages, 2 < ceil(count(*) / 10.0) as has_next, true as has_previous from f""")
def sources_page_total(t):
    return catalog.page_total(catalog.filtered_sources(t, kind="crawl"), 10, 2)


@query(f"""select d.doc_id, url, title, (select count(*) from code_snippets s where s.document_id = d.doc_id) as snippet_count from documents d where crawl_job_id = '{JOB}' order by created_at desc, doc_id limit 10 offset 10""")
def source_documents(t):
    return catalog.source_documents(t, JOB, 10, 10)


@query(f"""select id, title, language, created_at from code_snippets where document_id in (select doc_id from documents where crawl_job_id = '{JOB}') and language = 'python'
and (contains(lower(title), 're') or contains(lower(description), 're') or contains(lower(code_content), 're')) order by created_at desc, id limit 10""")
def source_snippets(t):
    return catalog.source_snippets(t, JOB, "python", "re")


@query("select doc_id, title, url from documents where contains(lower(title), 'linker') order by created_at desc, doc_id limit 10")
def documents_by_title(t):
    return catalog.documents_by_title(t, "Linker")


@query("""select doc_id, title, case when lower(title) = 'cache' then 0 when contains(lower(title), 'cache') then 1 when contains(lower(url), '/cache') then 2 else 3 end as priority from documents
where contains(lower(title), 'cache') or contains(lower(url), 'cache') or contains(lower(markdown_content), 'cache') order by priority, title asc nulls last, doc_id limit 20""")
def documents_by_priority(t):
    return catalog.documents_by_priority(t, "cache", 20)


@query(f"""select s.id, s.title, j.name as source_name, s.created_at from code_snippets s join documents d on d.doc_id = s.document_id join crawl_jobs j on j.id = d.crawl_job_id
where s.created_at >= timestamp '{NOW}' - interval 72 hours order by s.created_at desc, s.id limit 10""")
def recent_snippets(t):
    return catalog.recent_snippets(t, NOW, 72)


@query("select id, title, imports from code_snippets where list_contains(imports, 'widget')")
def by_import(t):
    return catalog.by_member(t, "imports", "widget")


@query("select id, title, functions from code_snippets where list_contains(functions, 'queuePolicy')")
def by_function(t):
    return catalog.by_member(t, "functions", "queuePolicy")


@query(f"""select j.id, name, status, case when coalesce(total_pages, 0) <= 0 then 0 else least(100, cast(round_even(coalesce(processed_pages, 0) * 100.0::double / total_pages, 0) as int)) end as progress, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created,
case when last_heartbeat is null then 'unknown' when date_diff('microsecond', last_heartbeat, timestamp '{LIVE}') // 1000000 > 60 then 'stalled' when date_diff('microsecond', last_heartbeat, timestamp '{LIVE}') // 1000000 > 30 then 'warning' else 'healthy' end as health,
(select count(*) from failed_pages f where f.crawl_job_id = j.id) as failed_pages from crawl_jobs j""")
def job_list(t):
    return catalog.job_list(t, LIVE)


@query(f"select id, url, error_message, failed_at from failed_pages where crawl_job_id = '{JOB}'")
def failed_pages(t):
    return catalog.failed_pages_of(t, JOB)


@query("select doc_id, case when coalesce(markdown_content <> '', false) then 'success' else 'no_content' end as status, nullif(markdown_content, '') as content, coalesce(length(markdown_content), 0) as content_length from documents")
def document_markdown(t):
    return catalog.document_markdown(t)


@query(f"""with j as (select *, status = 'running' and (last_heartbeat is null or date_diff('microsecond', last_heartbeat, timestamp '{LIVE}') // 1000000 > 60) as stale, id in (select crawl_job_id from failed_pages) as hf from crawl_jobs)
select id, case when not stale then 'none' when hf then 'retry_failed' else 'restart' end as decision, case when stale and not hf then coalesce(retry_count, 0) + 1 else coalesce(retry_count, 0) end as retry_count from j""")
def resume_decisions(t):
    return catalog.resume_decisions(t, LIVE)


@query("""select 'document_has_one_job' as rule, count(*) filter ((crawl_job_id is null) = (upload_job_id is null)) as n from documents
union all select 'snippet_type', count(*) filter (snippet_type not in ('function', 'class', 'example', 'config', 'code')) from code_snippets
union all select 'relationship_type', count(*) filter (relationship_type not in ('imports', 'extends', 'implements', 'uses', 'example_of', 'configuration_for', 'related')) from snippet_relationships
union all select 'max_depth', count(*) filter (not (max_depth between 0 and 5)) from crawl_jobs
union all select 'url_unique', count(*) from (select url from documents group by url having count(*) > 1)""")
def quality_violations(t):
    return catalog.quality_violations(t)


@query("select language, count(*) as n from (select language from code_snippets order by created_at desc nulls first, id limit 50) where language is not null group by 1")
def page_language_facet(t):
    return catalog.language_facet(t.snippets.orderBy(F.desc_nulls_first("created_at"), "id").limit(50))


@query(f"with {DOCS} select s.id, d.job_id as source_id, coalesce(c.name, u.name) as source_name from code_snippets s join d on d.doc_id = s.document_id left join crawl_jobs c on c.id = d.job_id left join upload_jobs u on u.id = d.job_id")
def snippet_owner(t):
    return catalog.snippet_view(t).select("id", "source_id", "source_name")


# ---- relationships ----------------------------------------------------------------------------------


@query(f"with {NEIGHBOURS} select * from nb")
def related_snippets(t):
    return relations.neighbours(t)


@query(f"with {NEIGHBOURS} select related_snippet_id as snippet_id, count(*) as n from nb where snippet_id in (select id from code_snippets where language = 'python') group by 1")
def related_to_python(t):
    return relations.neighbours(t, t.snippets.where("language = 'python'").select("id")).groupBy(F.col("related_snippet_id").alias("snippet_id")).agg(F.count("*").alias("n"))


@query("""select r.id, r.source_snippet_id, r.target_snippet_id, r.relationship_type, s.title as source_title, s.language as source_language, d.url as source_url, x.title as target_title, x.language as target_language, e.url as target_url
from snippet_relationships r join code_snippets s on s.id = r.source_snippet_id join documents d on d.doc_id = s.document_id join code_snippets x on x.id = r.target_snippet_id join documents e on e.doc_id = x.document_id""")
def relationship_view(t):
    return relations.relationship_view(t)


@query(f"""with {NEIGHBOURS}, p as (select id from code_snippets where language = 'go')
select related_snippet_id as id, '[' || string_agg(distinct '{{"snippet_id":' || snippet_id || ',"relationship_type":"' || relationship_type || '"}}', ',' order by snippet_id, relationship_type) || ']' as contexts from (select distinct related_snippet_id, snippet_id, relationship_type from nb where snippet_id in (select id from p) and related_snippet_id not in (select id from p)) group by 1""".replace("string_agg(distinct", "string_agg("))
def related_contexts(t):
    return relations.related_contexts(t, t.snippets.where("language = 'go'").select("id"))


META = "'{\"relationships\": [{\"related_index\": ' || cast(id % 4 as {s}) || ', \"relationship_type\": \"uses\", \"description\": \"d\"}, {\"related_index\": 0, \"relationship_type\": \"related\"}]}'"


@query("""with n as (select id, document_id, row_number() over (partition by document_id order by id) - 1 as pos from code_snippets),
w as (select id, document_id, id % 4 as pos, 'uses' as k, 'd' as description from code_snippets union all select id, document_id, 0, 'related', null from code_snippets)
select w.id as source, n.id as target, w.k as relationship_type, w.description from w join n using (document_id, pos) where w.id <> n.id""")
def relationships_from_json(t):
    s = t.snippets.select("id", "document_id", F.expr(META.replace("{s}", "string")).alias("meta_data"))
    return relations.edges_from_metadata(s)


# ---- scalars ----------------------------------------------------------------------------------------

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("""with l as (select doc_id, markdown_content as c from documents), k as (select doc_id, c, array_to_string(list_filter(string_split(c, chr(10)), lambda x: not regexp_matches(x, '\\[[^\\]]+\\]\\([^)]+\\)|!\\[[^\\]]*\\]\\([^)]+\\)|^\\s*\\[[^\\]]+\\]:\\s*https?://')), chr(10)) as kept from l)
select doc_id, md5(regexp_replace(regexp_replace(kept, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as h from k""")
def clean_link_lines(t):
    return t.documents.select("doc_id", F.md5(text.drop_link_lines(F.col("markdown_content"))).alias("h"))


@query("""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(markdown_content, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '\\[([^\\]]+)\\]\\[[^\\]]+\\]', '\\1', 'g'), '(?m)^\\[[^\\]]+\\]:\\s+.+$', '', 'g')) as h from documents""")
def strip_links(t):
    return t.documents.select("doc_id", F.md5(text.unlink_markdown(F.col("markdown_content"))).alias("h"))


@query("""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(markdown_content, '!\\[([^\\]]*)\\]\\([^)]+\\)', '', 'g'), '!\\[([^\\]]*)\\]\\[[^\\]]+\\]', '', 'g'), '(?s)<!--.*?-->', '', 'g')) as h from documents""")
def strip_images(t):
    return t.documents.select("doc_id", F.md5(text.drop_html_comments(text.drop_images(F.col("markdown_content")))).alias("h"))


@query("""select doc_id, len(list_filter(string_split(markdown_content, chr(10)), lambda x: regexp_matches(regexp_replace(lower(x), '^\\s+|\\s+$', '', 'g'), '^(previous|next|back|forward|home|index|contents?|table of contents)$|^go to|^return to|^back to|^\\[?(<|>|<<|>>|←|→)\\]?$|^page \\d+'))) as n from documents where markdown_content is not null""")
def navigation_lines(t):
    return t.documents.where("markdown_content is not null").select("doc_id", F.size(F.filter(F.split("markdown_content", "\n"), text.is_navigation)).alias("n"))


@query("""select id, coalesce(regexp_replace(code_content, '^\\s+|\\s+$', '', 'g') <> '' and (contains(code_content, chr(10)) or len(regexp_extract_all(code_content, '[\\p{L}\\p{N}_]{3,}')) >= 3), false) as keep, length(code_content) // 4 as tokens, md5(code_content) as h from code_snippets""")
def snippet_eligibility(t):
    return t.snippets.select("id", text.is_code_worth_keeping(F.col("code_content")).alias("keep"), text.count_tokens(F.col("code_content")).alias("tokens"), text.content_hash(F.col("code_content")).alias("h"))


@query("""select doc_id, nullif(lower(regexp_extract(case when regexp_matches(url, '^https?://') then url when contains(url, '.') and not contains(url, ' ') then 'https://' || url end, '^https?://([^/?#]*)', 1)), '') as domain, regexp_replace(regexp_replace(url, '/$', ''), '#.*$', '') as normal, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') as valid from documents""")
def url_parts(t):
    u = F.col("url")
    return t.documents.select("doc_id", text.domain_of(u).alias("domain"), text.normalize_url(u).alias("normal"), text.is_valid_url(u).alias("valid"))


@query("""select doc_id, case when starts_with(url, 'upload://') and contains(regexp_extract(url, '^upload://(.*)$', 1), '/') then regexp_replace(regexp_extract(url, '^upload://[^/]*/(.*)$', 1), '\\.[^.]*$', '') when starts_with(url, 'upload://') then regexp_extract(url, '^upload://(.*)$', 1) else 'Untitled Document' end as from_url,
case when regexp_matches(lower(url), '\\.(md|markdown|mdx|mdown|mkd|mdwn)$') then 'markdown' when regexp_matches(lower(url), '\\.(rst|rest|restx|rtxt|rstx)$') then 'restructuredtext' when regexp_matches(lower(url), '\\.(html|htm)$') then 'html' when regexp_matches(lower(url), '\\.txt$') then 'text' end as content_type,
regexp_replace(list_filter(list_transform(string_split(markdown_content, chr(10))[1:20], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: starts_with(x, '# '))[1][3:], '^\\s+|\\s+$', '', 'g') as heading from documents""")
def titles(t):
    return t.documents.select("doc_id", text.title_of_url(F.col("url")).alias("from_url"), text.content_type_of(F.col("url")).alias("content_type"), text.title_of_markdown(F.col("markdown_content")).alias("heading"))


@query("""select id, list_distinct(list_filter(list_transform(start_urls, lambda u: nullif(lower(regexp_extract(u, '^https?://([^/?#]*)', 1)), '')), lambda x: x is not null)) as domains, nullif(lower(regexp_extract(start_urls[1], '^https?://([^/?#]*)', 1)), '') as main, try_cast(json_extract_string(config, '$.max_pages') as int) as max_pages from crawl_jobs""")
def job_domains(t):
    return t.crawl_jobs.select("id", text.domains_of(F.col("start_urls")).alias("domains"), text.primary_domain(F.col("start_urls")).alias("main"), F.get_json_object("config", "$.max_pages").try_cast("int").alias("max_pages"))


@query("""select id, 'TITLE: ' || coalesce(nullif(title, ''), 'Untitled') || chr(10) || 'DESCRIPTION: ' || coalesce(nullif(description, ''), 'No description available') || chr(10) || 'SOURCE: ' || coalesce(source_url, 'None') || chr(10) || chr(10) || 'LANGUAGE: ' || coalesce(nullif(language, ''), 'unknown') || chr(10) || 'CODE:' || chr(10) || '```' || chr(10) || coalesce(code_content, 'None') || chr(10) || '```' || chr(10) || chr(10) || repeat('-', 40) as shown from code_snippets""")
def formatted_snippets(t):
    return t.snippets.select("id", text.format_snippet(*map(F.col, ("title", "description", "source_url", "language", "code_content"))).alias("shown"))


@query("""with c as (select id, code_content as c, substr(code_content, 1, 400) as cut from code_snippets), p as (select *, instr(reverse(substr(cut, 321)), chr(10)) as behind from c)
select id, case when length(c) // 4 <= 100 then c when behind > 0 and length(cut) - behind > 0 then substr(cut, 1, length(cut) - behind) else cut end as short from p""")
def truncated_snippets(t):
    return t.snippets.select("id", text.smart_truncate(F.col("code_content"), 100).alias("short"))


@query("select doc_id, coalesce((length(lower(markdown_content)) - length(replace(lower(markdown_content), 'cache', ''))) // 5, 0) as n from documents")
def occurrence_counts(t):
    return t.documents.select("doc_id", text.count_occurrences(F.col("markdown_content"), "cache").alias("n"))


@query("select id, substr(code_content, 1, 400) as short, coalesce(length(code_content) > 400, false) as truncated from code_snippets")
def hard_truncated_snippets(t):
    cut = text.hard_truncate(F.col("code_content"), 100)
    return t.snippets.select("id", cut["text"].alias("short"), cut["truncated"].alias("truncated"))


@query()
def site_names(t):
    return t.documents.select("doc_id", text.site_name(F.col("title"), F.col("meta_data")).alias("site"))


@query("""select id, coalesce(nullif(title, ''), nullif(section_title, '') || ' - Code Block ' || line_start, 'Code Block ' || line_start) as title, coalesce(nullif(description, ''), 'Code snippet from ' || coalesce(nullif(section_title, ''), 'documentation')) as description, case snippet_type when 'example' then 'example' else 'code' end as snippet_type from code_snippets""")
def fallback_metadata(t):
    s = F.col("section_title")
    return t.snippets.select("id", text.fallback_title(F.col("title"), s, F.col("line_start")).alias("title"), text.fallback_description(F.col("description"), s).alias("description"), text.snippet_type_of(F.col("snippet_type")).alias("snippet_type"))


# ---- extraction -------------------------------------------------------------------------------------

_MD = "concat('# Page ', {i}, '\n\nIntro of page ', {i}, ' with words.\n\n```python\ndef f{x}():\n    return ', {n}, '\n```\n\n## Part\n\n- An item here\n\n~~~\nplain one\nplain two\n~~~\n')"
_RST = "concat('Page ', {i}, '\n==============\n\nIntro of page ', {i}, '.\n\n.. code-block:: python\n   :linenos:\n\n   def f{x}():\n       return ', {n}, '\n\nPart\n----\n\nSee this::\n\n   literal a\n   literal b\n\nEnd.\n')"
_HTML = "concat('<html><body><h1>Page ', {i}, '</h1><p>Intro of the page number ', {i}, '</p><pre><code>def f():\n    return ', {n}, '</code></pre><h2>Part</h2><ul><li>Some item text here</li></ul><pre>x = 1\ny = 2<button>Copy</button></pre></body></html>')"


def _corpus(t, template: str):
    sql = template.replace("{i}", "cast(doc_id as string)").replace("{n}", "cast(coalesce(n_chars, 0) as string)").replace("{x}", "")
    return t.documents.select("doc_id", F.expr(sql.replace("\n", "\\n")).alias("content"))


@query("""select doc_id as id, 1 as block_no, 'def f():' || chr(10) || '    return ' || coalesce(n_chars, 0) as code_content, 'python' as language, 'Page ' || doc_id as title, 'Intro of page ' || doc_id || ' with words.' as description, 5 as line_start, 8 as line_end from documents
union all select doc_id, 2, 'plain one' || chr(10) || 'plain two', null, 'Part | Page ' || doc_id, 'An item here', 14, 17 from documents""")
def extract_markdown(t):
    return extract.extract(_corpus(t, _MD), kind="markdown")


@query("""select doc_id as id, 1 as block_no, 'def f():' || chr(10) || '    return ' || coalesce(n_chars, 0) as code_content, 'python' as language, 'Page ' || doc_id as title, 'Intro of page ' || doc_id || '.' as description, 6 as line_start, 11 as line_end from documents
union all select doc_id, 2, 'literal a' || chr(10) || 'literal b', null, 'Part | Page ' || doc_id, null, 15, 19 from documents""")
def extract_rst(t):
    return extract.extract(_corpus(t, _RST), kind="restructuredtext")


@query("""select doc_id as id, 1 as block_no, 'def f():' || chr(10) || '    return ' || coalesce(n_chars, 0) as code_content, null::varchar as language, 'Page ' || doc_id as title, 'Intro of the page number ' || doc_id as description, null::int as line_start, null::int as line_end from documents
union all select doc_id, 2, 'x = 1' || chr(10) || 'y = 2', null, 'Part | Page ' || doc_id, 'Some item text here', null, null from documents""")
def extract_html(t):
    return extract.extract(_corpus(t, _HTML), kind="html")


@query()
def extract_pages(t):
    """Blocks of the pages as they were fetched, all read as Markdown."""
    return extract.extract(t.documents, content="markdown_content", kind="markdown")


@query()
def rst_titles(t):
    return t.documents.select("doc_id", extract.rst_title(F.col("markdown_content")).alias("title"))


@query()
def html_to_markdown(t):
    """The pages' own texts, read as HTML, as Markdown."""
    return t.documents.select("doc_id", html_markdown.to_markdown(F.col("markdown_content")).alias("markdown"))


@query()
def extract_pages_as_html(t):
    return extract.extract(t.documents, content="markdown_content", kind="html")


@query()
def extract_pages_as_rst(t):
    return extract.extract(t.documents, content="markdown_content", kind="restructuredtext")


# ---- ingest -----------------------------------------------------------------------------------------

_BATCHES = "with o as (select * from (select *, row_number() over (partition by url order by doc_id desc) as rn from documents where batch_no = 0) where rn = 1), i as (select * from documents where batch_no > 0)"


def _stored(t):
    from pyspark.sql import Window

    w = Window.partitionBy("url").orderBy(F.desc("doc_id"))
    return t.documents.where("batch_no = 0").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query(_BATCHES + " select i.doc_id, i.url, case when o.url is null then 'new' when lower(i.content_hash) is not distinct from lower(o.content_hash) then 'unchanged' else 'changed' end as change from i left join o on o.url = i.url")
def ingest_classify(t):
    return ingest.classify(t.documents.where("batch_no > 0"), _stored(t)).select("doc_id", "url", "change")


@query(_BATCHES + ", c as (select case when o.url is not null and lower(i.content_hash) is not distinct from lower(o.content_hash) then 1 else 0 end as s from i left join o on o.url = i.url) select count(*) as pages, cast(sum(s) as bigint) as skipped, round(sum(s) * 100.0::double / count(*), 4) as percent from c")
def ingest_skip_rate(t):
    return ingest.skip_rate(ingest.classify(t.documents.where("batch_no > 0"), _stored(t)))


@query("""with b as (select s.id, coalesce('c:' || crawl_job_id, 'u:' || upload_job_id, '-') as scope, md5(code_content) as code_hash, document_id from code_snippets s join documents d on d.doc_id = s.document_id where code_content <> '')
select id, scope, code_hash from (select *, row_number() over (partition by scope, code_hash order by document_id, id) as rn from b) where rn = 1""")
def dedupe_scoped(t):
    d = t.documents.select(F.col("doc_id").alias("document_id"), ingest.scope().alias("scope"))
    b = t.snippets.join(d, "document_id").withColumn("code_hash", text.content_hash(F.col("code_content")))
    return ingest.first_per_scope(b, order=["document_id", "id"]).select("id", "scope", "code_hash")


@query(_BATCHES + ", n as (select * from (select *, row_number() over (partition by url order by updated_at desc nulls last) as r2 from i) where r2 = 1) select url, title from n union all select url, title from o where url not in (select url from n where url is not null)")
def ingest_upsert(t):
    return ingest.upsert(_stored(t).select("url", "title", "updated_at"), t.documents.where("batch_no > 0").select("url", "title", "updated_at"), newest="updated_at").select("url", "title")


@query("""select case when d.batch_no > 0 then s.id + 1000000000 else s.id end as id from code_snippets s left join documents d on d.doc_id = s.document_id""")
def replace_snippets(t):
    """The snippets of later batches come in again under new ids and take the place of the old ones."""
    later = t.documents.where("batch_no > 0").select(F.col("doc_id").alias("document_id"))
    fresh = t.snippets.join(later, "document_id", "left_semi").withColumn("id", F.col("id") + 1_000_000_000)
    return ingest.replace_snippets(t.snippets, fresh).select("id")


@query()
def ingest_composed(t):
    """All later batches through the composed path, on top of the first."""
    of = lambda c: t.documents.where(c)
    old = of("coalesce(batch_no, 0) = 0")
    snippets = t.snippets.join(old.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    return ingest.ingest_pages(old, snippets, of("batch_no > 0")).pages


@query("select f.id, f.crawl_job_id, f.url from failed_pages f where not exists (select 1 from documents d where d.crawl_job_id = f.crawl_job_id and d.url = f.url)")
def failed_pages_clear(t):
    return ingest.clear_failed(t.failed_pages, t.documents.where("crawl_job_id is not null")).select("id", "crawl_job_id", "url")


@query("select crawl_job_id, url, id from (select *, row_number() over (partition by crawl_job_id, url order by failed_at, id) as rn from failed_pages) where rn = 1")
def failed_pages_once(t):
    return ingest.distinct_failed(t.failed_pages).select("crawl_job_id", "url", "id")


@query("""with w as (select distinct name, version from crawl_jobs union select distinct name, 'next' from crawl_jobs), j as (select name, version, min(id) as old from crawl_jobs group by all)
select w.name, w.version, coalesce(old, md5(w.name || chr(1) || coalesce(w.version, chr(2)))) as id, old is null as created from w left join j on j.name = w.name and j.version is not distinct from w.version""")
def job_upsert(t):
    wanted = t.crawl_jobs.select("name", "version").unionByName(t.crawl_jobs.select("name", F.lit("next").alias("version")))
    return ingest.get_or_create_jobs(t.crawl_jobs, wanted)


@query("""select id, coalesce(case when id % 2 = 0 then 'New ' || id end, title) as title, coalesce(case when id % 2 = 0 then 'New ' || id end, title) is distinct from title as changed from code_snippets""")
def regenerate_metadata(t):
    new = t.snippets.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("New "), F.col("id").cast("string"))).alias("title"))
    return ingest.apply_changes(t.snippets.select("id", "title"), new, "id", ["title"])


@query("select (select count(*) from code_snippets) as total, count(*) filter (id % 2 = 0 and ('New ' || id) is distinct from title) as changed, [2, 4, 6, 8, 10]::bigint[] as preview from code_snippets")
def regeneration_summary(t):
    new = t.snippets.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("New "), F.col("id").cast("string"))).alias("title"))
    return ingest.regeneration_summary(ingest.apply_changes(t.snippets.select("id", "title"), new, "id", ["title"]), "id")


@query()
def search_pages_by_stem(t):
    return search.search_pages(t, "caching buffers", stems=True)


@query()
def auto_named_jobs(t):
    return ingest.auto_names(t.crawl_jobs.withColumn("name", F.lit(ingest.AUTO + " from x]")), t.documents)


# ---- mutations --------------------------------------------------------------------------------------


@query(f"""with {STATS}, g as (select job_id as id from stats where status = 'completed' and snippet_count <= 60), gd as (select doc_id from documents where coalesce(crawl_job_id, upload_job_id) in (select id from g)), gs as (select id from code_snippets where document_id in (select doc_id from gd))
select 'crawl_jobs' as name, count(*) as n from crawl_jobs where id not in (select id from g) union all select 'upload_jobs', count(*) from upload_jobs where id not in (select id from g)
union all select 'documents', count(*) from documents where doc_id not in (select doc_id from gd) union all select 'failed_pages', count(*) from failed_pages where crawl_job_id not in (select id from g)
union all select 'snippets', count(*) from code_snippets where id not in (select id from gs) union all select 'relationships', count(*) from snippet_relationships where source_snippet_id not in (select id from gs) and target_snippet_id not in (select id from gs)""")
def delete_sources(t):
    return mutate.remaining(mutate.delete_sources(t, catalog.filtered_sources(t, most=60).select("id")))


@query(f"select id from code_snippets where document_id in (select doc_id from documents where crawl_job_id = '{JOB}') and ({_match(['code_content'], 'cache')} or {_match(['title'], 'cache')} or {_match(['description'], 'cache')})")
def delete_matches(t):
    return mutate.matching_snippets(t, JOB, "cache")


@query(f"select id, case when id = '{JOB}' then 'Renamed' else name end as name, case when id = '{JOB}' then '9' else version end as version, false as conflict from crawl_jobs")
def rename_source(t):
    return mutate.rename(t.crawl_jobs, JOB, "Renamed", "9")


@query("select id, case when status in ('pending', 'running', 'paused') then 'running' else 'completed' end as status from upload_jobs")
def simplify_status(t):
    return mutate.simplify_status(t.upload_jobs).select("id", "status")


# ---- chunks -----------------------------------------------------------------------------------------


@query("""select id, cast(ceil(length(code_content) / 400.0) as int) as n, coalesce(substr(code_content, 401, 400), '') as second from code_snippets where length(code_content) > 0""")
def chunk_fixed(t):
    c = F.col("code_content")
    return t.snippets.where(F.length(c) > 0).select("id", F.size(chunking.fixed_chunks(c, 100)).alias("n"), chunking.chunk_at(c, 100, 1)["content"].alias("second"))


@query()
def chunk_paragraphs(t):
    return chunking.page_chunks(t.documents, "doc_id", "markdown_content", 500)


# ---- liveness ---------------------------------------------------------------------------------------

_BEATS = "b as (select distinct crawl_job_id, ts, phase, processed from crawl_heartbeats)"


@query(f"with {_BEATS} select crawl_job_id, min(ts) as first_ts, max(ts) as last_ts, max(processed) as processed, max_by(phase, struct_pack(a := ts, b := phase)) filter (phase is not null) as phase, count(*) as reports from b group by 1")
def job_progress(t):
    return live.progress(t.heartbeats)


@query(f"with m as (select crawl_job_id, max(ts) as m from crawl_heartbeats group by 1), a as (select crawl_job_id, cast(floor(date_diff('microsecond', m, timestamp '{LIVE}') / 1000000.0) as bigint) as age_s from m) select crawl_job_id, age_s, case when age_s > 60 then 'stalled' when age_s > 30 then 'warning' else 'healthy' end as health from a")
def job_health(t):
    return live.job_health(t.heartbeats, LIVE)


@query(f"""with {_BEATS}, p as (select crawl_job_id, max(ts) as last_ts, max_by(phase, struct_pack(a := ts, b := phase)) filter (phase is not null) as phase from b group by 1)
select j.id as crawl_job_id, 'Job stalled in phase ' || coalesce(phase, 'unknown') as error_message from crawl_jobs j left join p on p.crawl_job_id = j.id where j.status = 'running' and (last_ts is null or date_diff('microsecond', last_ts, timestamp '{LIVE}') // 1000000 > 60)""")
def stalled_jobs(t):
    return live.stalled(t.crawl_jobs, t.heartbeats, LIVE)


@query(f"with {_BEATS}, n as (select crawl_job_id, ts, processed, row_number() over (partition by crawl_job_id order by ts, processed nulls first, phase nulls first) as no from b) select * from n where (no - 1) % 3 = 0")
def progress_notifications(t):
    return live.notifications(t.heartbeats)


@query(f"with {_BEATS} select crawl_job_id, date_trunc('hour', ts) as window_start, count(*) as reports from b group by all")
def job_activity(t):
    return live.activity(t.heartbeats)


@query(f"select distinct cast(floor(i / 2) as bigint) as days, case when i // 2 = 0 then 'Today' when i // 2 = 1 then 'Yesterday' when i // 2 < 7 then (i // 2) || ' days ago' when i // 2 < 30 then (i // 2 // 7) || case when i // 2 // 7 > 1 then ' weeks ago' else ' week ago' end else strftime(timestamp '{NOW}' - i * interval 12 hours, '%m/%d/%Y') end as label from (select unnest(range(0, 120)) as i)")
def relative_dates(t):
    i = t.documents.sparkSession.range(120)
    ts = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), (F.col("id") * 12).cast("int"))
    return i.select(F.floor(F.col("id") / 2).alias("days"), clock.relative_label(ts, clock.at(NOW)).alias("label")).distinct()


# ---- crawling ---------------------------------------------------------------------------------------


@query("""with recursive l as (select distinct parent_url as s, url as t from documents where parent_url is not null and url is not null), r as (select distinct url, 0 as depth from documents where parent_url is null and url is not null union select l.t, r.depth + 1 from r join l on l.s = r.url where r.depth < 8)
select url, min(depth) as depth from r group by 1""")
def crawl_frontier(t):
    links = t.documents.where("parent_url is not null and url is not null").select(F.col("parent_url").alias("source"), F.col("url").alias("target"))
    return frontier.crawl(links, t.documents.where("parent_url is null and url is not null").select("url"), 8)


@query("""select doc_id, regexp_matches(url, '^https://[^/]*/guide/.*$') and not regexp_matches(url, '^.*cache.*$') as ok from documents""")
def url_scope(t):
    return t.documents.select("doc_id", frontier.in_scope(F.col("url"), include=["https://*/guide/**"], exclude=["**cache**"]).alias("ok"))


# ---- jobs -------------------------------------------------------------------------------------------


@query(f"""select id, name, version, status, 'crawl' as kind, (select count(*) from documents where crawl_job_id = '{JOB}') as document_count, (select count(*) from code_snippets where document_id in (select doc_id from documents where crawl_job_id = '{JOB}')) as snippet_count from crawl_jobs where id = '{JOB}'""")
def source_by_id(t):
    return jobs.source(t, JOB)


@query("select id, name, status, file_count, processed_files, case when file_count > 0 then round_even(processed_files * 100.0::double / file_count, 1) else 0.0 end as percent, error_message from upload_jobs")
def upload_status(t):
    return jobs.upload_status(t)


@query("select id, try_cast(case when regexp_matches(trim(cast(id as varchar)), '^[0-9]+$') then trim(cast(id as varchar)) end as bigint) as parsed, cast(null as bigint) as negative, cast(null as bigint) as word from code_snippets")
def snippet_ids_checked(t):
    i = F.col("id").cast("string")
    return t.snippets.select("id", jobs.snippet_id(F.concat(F.lit(" "), i, F.lit(" "))).alias("parsed"), jobs.snippet_id(F.concat(F.lit("-"), i)).alias("negative"), jobs.snippet_id(F.concat(F.lit("x"), i)).alias("word"))


@query(r"select id, regexp_matches(id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') as ok from crawl_jobs")
def source_ids_checked(t):
    return t.crawl_jobs.select("id", jobs.is_source_id(F.col("id")).alias("ok"))


@query("""with f as (select crawl_job_id as id, count(*) as n from failed_pages group by 1)
select j.id as retry_of, name, version, start_urls, max_depth, try_cast(json_extract_string(config, '$.max_pages') as int) as max_pages, domain_restrictions, coalesce(n, 0) as failed from crawl_jobs j left join f on f.id = j.id""")
def retry_jobs(t):
    return jobs.retry_jobs(t).withColumn("failed", F.get_json_object("metadata", "$.failed_pages_count").cast("bigint")).drop("metadata")


@query(f"""select id as retry_of, case when id = '{JOB}' then ['https://a.example/1', 'https://a.example/2'] else start_urls end as start_urls, case when id = '{JOB}' then 0 else max_depth end as max_depth, case when id = '{JOB}' then 2 else try_cast(json_extract_string(config, '$.max_pages') as int) end as max_pages from crawl_jobs""")
def retry_addresses(t):
    return jobs.retry_jobs(t, {JOB: ["https://a.example/1", "https://a.example/2"]}).select("retry_of", "start_urls", "max_depth", "max_pages")


@query("select distinct crawl_job_id, url, 0 as max_depth from failed_pages where crawl_job_id in (select id from crawl_jobs)")
def failed_to_retry(t):
    return jobs.failed_to_retry(t)


@query("""with c as (select *, try_cast(json_extract_string(config, '$.max_pages') as int) as p, coalesce(try_cast(json_extract_string(config, '$.max_concurrent_crawls') as int), 5) as m, coalesce(cast(json_extract(config, '$.url_patterns') as varchar[]), cast(json_extract(config, '$.include_patterns') as varchar[]), []) as u from crawl_jobs where status = 'completed')
select id, name, '9.9' as version, case when list_contains(u, '**/new/**') then u else u || ['**/new/**'] end as url_patterns, ['**/old/**'] as exclude_patterns, 7 as max_depth, p as max_pages, m as concurrent from c""")
def update_crawls(t):
    return jobs.update_crawls(t, ["**/new/**"], ["**/old/**"], max_depth=7, version="9.9").drop("changes")


@query("select id, name, start_urls, max_depth, try_cast(json_extract_string(config, '$.max_pages') as int) as max_pages from crawl_jobs where status = 'completed'")
def recrawls(t):
    return jobs.recrawls(t).drop("metadata")


@query("""with h as (select crawl_job_id as id, count(*) as d, coalesce(sum((select count(*) from code_snippets s where s.document_id = doc_id)), 0) as n from documents where crawl_job_id is not null group by 1)
select j.id, coalesce(d, 0) as processed_pages, cast(coalesce(n, 0) as bigint) as snippets_extracted, cast(coalesce(n, 0) as bigint) as base_snippets from crawl_jobs j left join h on h.id = j.id""")
def resumed_counters(t):
    return jobs.reset_counters(t.crawl_jobs, t.documents, t.snippets, True)


@query("select id, name, version from crawl_jobs where contains(lower(name), 'o') or contains(lower(version), 'o') order by name, id limit 50")
def sources_by_substring(t):
    return jobs.filter_names(t.crawl_jobs.select("id", "name", "version"), "O", ["name", "version"], 50)


@query("select crawl_job_id as concurrency, count(*) as requests, avg(processed) as mean_s, quantile_cont(processed, 0.95) as p95_s, quantile_cont(processed, 0.99) as p99_s, avg(case when phase is null then 1.0 else 0.0 end) * 100 as error_percent from crawl_heartbeats group by 1")
def request_metrics(t):
    r = t.heartbeats.select(F.col("crawl_job_id").alias("concurrency"), F.col("processed").alias("seconds"), F.col("phase").isNull().alias("failed"))
    return jobs.request_metrics(r)


@query(f"""with {_BEATS}, p as (select crawl_job_id, max(processed) as m from b group by 1)
select id as crawl_job_id, case when status = 'completed' and error_message is null then 'completed' else 'failed' end as event, greatest(coalesce(processed_pages, 0)::bigint, coalesce(m, 0)) as processed, snippets_extracted::bigint as snippets_extracted, cast(trunc(date_diff('microsecond', started_at, completed_at) / 1000000.0) as bigint) as seconds, error_message
from crawl_jobs left join p on p.crawl_job_id = id where status in ('completed', 'failed', 'cancelled')""")
def completion_events(t):
    return live.completions(t.crawl_jobs, t.heartbeats)


@query("""with e as (select crawl_job_id, url from failed_pages), s as (select 'c' || (row_number() over (order by id) % 3) as client, id as crawl_job_id from crawl_jobs)
select client, e.crawl_job_id, url from e join s using (crawl_job_id) union all select 'all', crawl_job_id, url from e""")
def subscribed_events(t):
    from pyspark.sql import Window

    every = t.crawl_jobs.sparkSession.createDataFrame([("all", None)], "client string, crawl_job_id string")
    own = t.crawl_jobs.select(F.concat(F.lit("c"), (F.row_number().over(Window.orderBy("id")) % 3).cast("string")).alias("client"), F.col("id").alias("crawl_job_id"))
    return live.for_subscribers(t.failed_pages.select("crawl_job_id", "url"), own.unionByName(every))


@query("select id, coalesce(status in ('running', 'pending'), false) as active from crawl_jobs")
def active_jobs(t):
    return live.active(t.crawl_jobs)
