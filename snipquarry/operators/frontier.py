"""Breadth-first link following over a table of links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import domain_of, glob_to_regex
from ..session import materialize


def in_scope(url, domains: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None):
    """Column: the address lies in allowed domains, matches an include pattern if there are any, and no
    exclude pattern."""
    ok = F.lit(True)
    if domains:
        ok = ok & domain_of(url).isin([d.lower() for d in domains])
    if include:
        any_ = F.lit(False)
        for g in include:
            any_ = any_ | url.rlike(glob_to_regex(g))
        ok = ok & any_
    for g in exclude or []:
        ok = ok & ~url.rlike(glob_to_regex(g))
    return ok


def crawl(links: DataFrame, starts: DataFrame, max_depth: int, max_pages: int | None = None, **scope) -> DataFrame:
    """(url, depth): pages reached from ``starts`` (url) over ``links`` (source, target), each at its least depth.

    One join per depth against the new frontier only; every level is written, so plans don't grow.
    """
    links = links.where(in_scope(F.col("target"), **scope)).select("source", "target").distinct()
    frontier = materialize(starts.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    return _levels(frontier, lambda f, depth: links.join(f.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct(), max_depth, max_pages)


def crawl_fetch(starts: DataFrame, fetch, links_of, max_depth: int, max_pages: int | None = None, **scope) -> tuple[DataFrame, DataFrame]:
    """(found, pages): a crawl that fetches each level before it knows the next.

    ``fetch`` turns (url, depth) into pages (url, ...), such as a read of the page source, and ``links_of``
    pages into (source, target). Each level is fetched once and written.
    """
    pages = []

    def step(f: DataFrame, depth: int) -> DataFrame:
        got = materialize(fetch(f), "fetched")
        pages.append(got)
        return links_of(got).where(in_scope(F.col("target"), **scope)).select(F.col("target").alias("url")).distinct()

    first = materialize(starts.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    found = _levels(first, step, max_depth, max_pages)
    if len(pages) <= max_depth:  # the last level has no step of its own
        rest = found.join(pages[0].select("url") if len(pages) == 1 else reduce(DataFrame.unionByName, [p.select("url") for p in pages]), "url", "left_anti") if pages else found
        pages.append(materialize(fetch(rest), "fetched"))
    return found, reduce(DataFrame.unionByName, pages)


def _levels(frontier: DataFrame, step, max_depth: int, max_pages: int | None) -> DataFrame:
    """Levels until nothing new, the depth or the number of pages is reached; a level is cut in the order of its addresses."""
    left = None if max_pages is None else max_pages
    if left is not None:
        frontier = materialize(frontier.orderBy("url").limit(left), "frontier")
        left -= frontier.count()
    seen = frontier
    for depth in range(1, max_depth + 1):
        if left == 0:
            break
        new = step(frontier, depth).join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        frontier = materialize(new if left is None else new.orderBy("url").limit(left), "frontier")
        n = frontier.count()
        if not n:
            break
        left = None if left is None else left - n
        seen = seen.unionByName(frontier)
    return seen
