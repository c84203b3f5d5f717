"""The graph of snippet relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import Tables

# Names of relationships seen from their target.
INVERSE = {"imports": "imported_by", "extends": "extended_by", "implements": "implemented_by", "uses": "used_by", "example_of": "has_example", "configuration_for": "configured_by"}


def inverse(kind: Column) -> Column:
    out = F.lit("related")
    for k, v in INVERSE.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def neighbours(t: Tables, ids: DataFrame | None = None, kinds: list[str] | None = None) -> DataFrame:
    """(snippet_id, related_snippet_id, relationship_type, description): distinct edges from the given
    snippets (column id), or from all, in both directions."""
    e = t.relationships
    if kinds:
        e = e.where(F.col("relationship_type").isin(kinds))
    forward = e.select(F.col("source_snippet_id").alias("snippet_id"), F.col("target_snippet_id").alias("related_snippet_id"), "relationship_type", "description")
    back = e.select(F.col("target_snippet_id").alias("snippet_id"), F.col("source_snippet_id").alias("related_snippet_id"), inverse(F.col("relationship_type")).alias("relationship_type"), "description")
    both = forward.unionByName(back)
    if ids is not None:
        both = both.join(ids.select(F.col("id").alias("snippet_id")), "snippet_id", "left_semi")
    return both.distinct()


def relationship_view(t: Tables) -> DataFrame:
    """Every edge with both ends' titles, languages and addresses; edges with a missing end fall away."""
    end = lambda p: t.snippets.join(t.documents.select(F.col("doc_id").alias("document_id"), "url"), "document_id").select(F.col("id").alias(f"{p}_snippet_id"), F.col("title").alias(f"{p}_title"), F.col("language").alias(f"{p}_language"), F.col("url").alias(f"{p}_url"))
    return t.relationships.select("id", "source_snippet_id", "target_snippet_id", "relationship_type").join(end("source"), "source_snippet_id").join(end("target"), "target_snippet_id")


def related_contexts(t: Tables, primary: DataFrame) -> DataFrame:
    """(id, contexts): snippets related to the primary ones (column id), without those themselves, with
    their edges as sorted JSON."""
    n = neighbours(t, primary).join(primary.select(F.col("id").alias("related_snippet_id")), "related_snippet_id", "left_anti")
    edge = F.struct(F.col("snippet_id"), F.col("relationship_type"))
    # an edge list is bounded by the primary page's size times the kinds
    return n.groupBy(F.col("related_snippet_id").alias("id")).agg(F.to_json(F.sort_array(F.collect_set(edge))).alias("contexts"))


def edges_from_metadata(snippets: DataFrame, meta: str = "meta_data") -> DataFrame:
    """Edges named in snippet metadata: relationships[].related_index is the place of the target among
    its document's snippets, by id from 0. Loops and unknown places give no edge, repeats give one."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("id")) - 1
    at = snippets.select("document_id", F.col("id").alias("target"), place.alias("related_index"))
    parsed = F.from_json(F.get_json_object(meta, "$.relationships"), "array<struct<related_index:int,relationship_type:string,description:string>>")
    wanted = snippets.select(F.col("id").alias("source"), "document_id", F.explode(parsed).alias("r")).select("source", "document_id", "r.*")
    e = wanted.join(at, ["document_id", "related_index"]).where("source <> target and relationship_type is not null")
    first = F.row_number().over(Window.partitionBy("source", "target", "relationship_type").orderBy(F.asc_nulls_last("description")))
    return e.withColumn("rn", first).where("rn = 1").select("source", "target", "relationship_type", "description")
