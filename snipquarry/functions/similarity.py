"""Trigram similarity and text ranking as Column functions."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Field weights of the ranking, as whole numbers so that sums are exact: A title, B description, C code.
WEIGHTS = {"title": 10, "description": 4, "code_content": 2, "functions": 4, "imports": 2}


def trigrams(c: Column) -> Column:
    """Distinct padded trigrams: words of letters and digits in lower case, two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" "))), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared share of two texts' trigrams, 0 for texts without any; null counts as none."""
    x, y = F.coalesce(trigrams(a), F.array().cast("array<string>")), F.coalesce(trigrams(b), F.array().cast("array<string>"))

    def ratio(t: Column) -> Column:
        both = F.size(F.array_intersect(t, y))
        n = F.size(t) + F.size(y) - both
        return F.when(n == 0, 0.0).otherwise(both / n)

    return let(x, ratio)


def tokens(c: Column) -> Column:
    """Lexemes of the simple analyser: runs of letters and digits in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def query_tokens(query: str | None) -> list[str]:
    import regex

    return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", (query or "").lower())))


def field_texts(with_code: bool = True) -> dict[str, Column]:
    """The five searched fields of a snippet as text."""
    return {"title": F.col("title"), "description": F.col("description"), "code_content": F.col("code_content"), "functions": F.array_join("functions", " "), "imports": F.array_join("imports", " ")}


def matches(fields: list[Column], query: str) -> Column:
    """Every lexeme of the query stands in some field; an empty query matches nothing."""
    wanted = query_tokens(query)
    if not wanted:
        return F.lit(False)
    # plain substring tests come first: they are compiled, and spare most rows the analyser
    low = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    may = reduce(and_, [reduce(or_, [F.contains(c, F.lit(w)) for c in low]) for w in wanted])
    every = F.flatten(F.array(*[tokens(f) for f in fields]))
    return may & (F.size(F.array_intersect(every, F.array(*map(F.lit, wanted)))) == len(wanted))


def _equals(word: str):
    return lambda x: x == word


def rank(fields: dict[str, Column], query: str, weights: dict[str, int] | None = None) -> Column:
    """Sum over lexemes and fields of weight x 1000 x tf / (1 + tf), in whole numbers."""
    weights = weights or WEIGHTS
    total = F.lit(0).cast("long")
    for name, text in fields.items():
        own = tokens(text)
        for w in query_tokens(query):
            tf = F.size(F.filter(own, _equals(w))).cast("long")
            total = total + F.floor(tf * (1000 * weights[name]) / (tf + 1)).cast("long")
    return total
