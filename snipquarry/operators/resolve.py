"""Finding a library by name."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import similarity
from .catalog import Tables, source_statistics

_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
LEAST, BEST, SELECT, GAP, SUGGEST = 0.1, 0.8, 0.7, 0.2, 0.3


def libraries(t: Tables, query: str = "") -> DataFrame:
    """Sources whose name or first domain label holds the query or is similar to it; all without a query.

    The returned score is that of the name, while order uses the better of name and domain.
    """
    s = source_statistics(t).select("job_id", "name", "version", "domain", "job_type", "snippet_count")
    if not query.strip():
        return s.withColumn("name_similarity", F.lit(1.0)).withColumn("domain_similarity", F.lit(0.0)).withColumn("exact", F.lit(1))
    q = F.lit(query.lower())
    label = F.lower(F.split_part("domain", F.lit("."), F.lit(1)))
    s = s.withColumn("name_similarity", similarity(F.lower("name"), q)).withColumn("domain_similarity", F.when(F.col("domain").isNotNull(), similarity(label, q)).otherwise(0.0))
    hit = F.contains(F.lower("name"), q) | F.coalesce(F.contains(label, q), F.lit(False)) | (F.greatest("name_similarity", "domain_similarity") > LEAST)
    exact = F.when((F.lower("name") == q) | F.coalesce(label == q, F.lit(False)), 0).otherwise(1)
    return s.where(hit).withColumn("exact", exact)


def search_libraries(t: Tables, query: str = "", limit: int = 10, offset: int = 0) -> DataFrame:
    found = libraries(t, query)
    order = [F.desc("snippet_count"), "name", "job_id"] if not query.strip() else ["exact", F.desc(F.greatest("name_similarity", "domain_similarity")), F.desc("snippet_count"), "name", "job_id"]
    return found.orderBy(*order).offset(offset).limit(limit).select("job_id", "name", "version", "job_type", "snippet_count", "name_similarity")


def did_you_mean(names: list[str], query: str, n: int = 5) -> list[tuple[str, float]]:
    """The names nearest to the query by longest matching blocks, best first."""
    scored = ((x, SequenceMatcher(None, query.lower(), x.lower()).ratio()) for x in names)
    return sorted(((x, r) for x, r in scored if r > SUGGEST), key=lambda p: (-p[1], p[0]))[:n]


def resolve(t: Tables, name: str) -> dict:
    """status selected (with id) or suggestions for a name or id, by a handful of best candidates."""
    if _UUID.fullmatch(name.strip()):
        return {"status": "selected", "id": name.strip(), "reason": "id"}
    rows = search_libraries(t, name, limit=10).collect()  # at most ten
    exact = [r for r in rows if r["name"].lower() == name.lower()]
    if exact:
        return {"status": "selected", "id": exact[0]["job_id"], "reason": "exact"}
    if len(rows) == 1:
        return {"status": "selected", "id": rows[0]["job_id"], "reason": "single"}
    if rows and rows[0]["name_similarity"] > SELECT and rows[0]["name_similarity"] - rows[1]["name_similarity"] > GAP:
        return {"status": "selected", "id": rows[0]["job_id"], "reason": "score"}
    if rows:
        return {"status": "suggestions", "suggestions": [r["name"] for r in rows[:5]]}
    # names of sources are a bounded catalogue; the hundred busiest are compared
    names = [r["name"] for r in search_libraries(t, "", limit=100).collect()]
    return {"status": "not_found", "suggestions": [x for x, _ in did_you_mean(names, name)]}


def source_ids(t: Tables, name: str) -> list[str]:
    """Ids a search in a named source runs over: the best match if it is alone or very good, else all ten."""
    rows = search_libraries(t, name, limit=10).collect()
    if len(rows) > 1 and rows[0]["name_similarity"] <= BEST:
        return [r["job_id"] for r in rows]
    return [r["job_id"] for r in rows[:1]]


def explain_matches(t: Tables, query: str) -> DataFrame:
    """Libraries with the kind of match and a confidence in percent."""
    low = query.lower()
    kind = F.when(F.lower("name") == low, "exact").when(F.contains(F.lower("name"), F.lit(low)), "contains").otherwise("similarity")
    return libraries(t, query).select("job_id", "name", kind.alias("match"), F.when(F.lower("name") == low, 100).otherwise(F.bround(F.col("name_similarity") * 100, 0).cast("int")).alias("confidence"), (F.col("snippet_count") < 10).alias("few_snippets"))


def count_libraries(t: Tables, query: str = "") -> DataFrame:
    """(n): how many sources ``search_libraries`` goes through."""
    return libraries(t, query).agg(F.count("*").alias("n"))


def best_and_others(t: Tables, query: str, others: int = 4) -> DataFrame:
    """(place, job_id, name, match, confidence, few_snippets): the best match, place 0, and the next ones."""
    from pyspark.sql import Window

    found = search_libraries(t, query, limit=1 + others)
    order = Window.orderBy("exact", F.desc(F.greatest("name_similarity", "domain_similarity")), F.desc("snippet_count"), "name", "job_id")
    place = libraries(t, query).join(F.broadcast(found.select("job_id")), "job_id", "left_semi").select("job_id", (F.row_number().over(order) - 1).alias("place"))  # at most 1 + others rows
    return explain_matches(t, query).join(F.broadcast(place), "job_id").select("place", "job_id", "name", "match", "confidence", "few_snippets")
