"""The registered queries of this subpackage; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from .batch_dedup import new_batch_duplicates
from .bpe_encode import encode_corpus
from .code_neardup import near_duplicate_groups, near_duplicate_pairs
from .eval_leak import leaks
from .keyword_spam import judged as spam_judged
from .keyword_spam import spam_pages
from .main_content import main_bodies, outside_lines
from .site_lines import repeated_lines, without_repeated_lines
from .splitting import split_all
from .template_residue import residue_pages


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_pages(read_table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_all(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "code_snippets"))
    return pieces.where("piece_no = 0 and n_pieces > 1").select("item_kind", "item_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_all(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "code_snippets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_batch_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "line_no")


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(read_table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outside_lines(read_table(spark, sf_dir, "documents"))


def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_bodies(read_table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(read_table(spark, sf_dir, "code_snippets"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "code_snippets"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(read_table(spark, sf_dir, "documents"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_judged(read_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p2_found, p2_pieces, p3_found, p4_found, p4_cleaned, p5_found, p5_bodies, p6_found, p6_groups, p7_ids, p8_found, p9_found, p9_scores]
    return {f.__name__: f for f in found}


LINES_SQL = r"""
with l as (
  select doc_id, crawl_job_id as j, cast(i - 1 as int) as line_no,
         trim(regexp_replace(lower(string_split(markdown_content, chr(10))[i]), '[^\p{L}]+', ' ', 'g')) as n
  from (select doc_id, crawl_job_id, markdown_content, unnest(range(1, len(string_split(markdown_content, chr(10))) + 1)) as i
        from documents where crawl_job_id is not null and markdown_content is not null)
), c as (
  select j, n, count(distinct doc_id) as pages from l where length(replace(n, ' ', '')) >= 20 group by j, n
), s as (select crawl_job_id as j, count(*) as total from documents where crawl_job_id is not null group by 1)
select l.doc_id, l.line_no from l join c using (j, n) join s using (j)
where c.pages >= 5 and c.pages >= 0.15 * s.total
"""


PAIRS_SQL = r"""
with t as (
  select id, regexp_extract_all(code_content, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') as tok from code_snippets where code_content is not null
), g as (
  select distinct id, array_to_string(tok[i : i + 3], ' ') as gram
  from (select id, tok, unnest(range(1, len(tok) - 2)) as i from t where len(tok) >= 25)
), n as (select id, count(*) as n from g group by id), both_ as (
  select a.id as id_a, b.id as id_b, count(*) as c from g a join g b on a.gram = b.gram and a.id < b.id group by 1, 2
)
select id_a, id_b from both_ join n x on x.id = id_a join n y on y.id = id_b where 10 * c >= 7 * (x.n + y.n - c)
"""

LEAKS_SQL = r"""
with iw as (
  select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items where text is not null
), ir as (
  select distinct item_id, least(10, len(w)) as size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as run
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from iw where len(w) > 0)
), dw as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null
), dr as (
  select doc_id, size, array_to_string(w[i : i + size - 1], ' ') as run
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, (select distinct size from ir) where len(w) >= size)
)
select distinct doc_id, item_id from dr join ir using (size, run)
"""


def llm_oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            select 'document' as item_kind, doc_id as item_id from documents where length(markdown_content) > 8000
            union all select 'snippet', id from code_snippets where length(code_content) > 2000""",
        "p4_found": LINES_SQL,
        "p6_found": PAIRS_SQL,
        "p8_found": LEAKS_SQL,
    }
