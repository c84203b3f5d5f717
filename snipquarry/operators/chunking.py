"""Token-budgeted chunks of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens


def fixed_chunks(c: Column, size: int) -> Column:
    """Array of chunks of ``size`` estimated tokens, the last one shorter; none for null and empty."""
    width = size * 4
    n = F.ceil(F.length(c) / width).cast("int")
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(c, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def chunk_at(c: Column, size: int, index: int) -> Column:
    """struct(content, total, error) of one fixed chunk."""
    chunks = fixed_chunks(c, size)
    n = F.size(chunks)
    bad = F.concat(F.lit(f"Chunk index {index} out of range (0-"), (n - 1).cast("string"), F.lit(")"))
    return F.struct(F.coalesce(F.get(chunks, index), F.lit("")).alias("content"), n.alias("total"), F.when(F.lit(index) >= n, bad).alias("error"))


def _greedy(paragraphs: list[str], size: int) -> list[list[str]]:
    """Paragraphs in order, as many to a chunk as fit; each further chunk repeats last paragraphs within a tenth."""
    chunks: list[list[str]] = []
    open_, used = [], 0
    cost = [len(p) // 4 for p in paragraphs]
    for i, p in enumerate(paragraphs):
        if open_ and used + cost[i] > size:
            chunks.append([paragraphs[j] for j in open_])
            tail, used = [], 0
            for j in reversed(open_):
                if used + cost[j] > size // 10:
                    break
                tail.append(j)
                used += cost[j]
            open_ = tail[::-1]
        open_.append(i)
        used += cost[i]
    if open_:
        chunks.append([paragraphs[j] for j in open_])
    return chunks


def pack_paragraphs(text: str | None, size: int = 4000) -> list[str]:
    """Chunks of a page at blank lines with an overlap of up to a tenth; one paragraph is never cut."""
    return ["\n\n".join(c) for c in _greedy(text.split("\n\n"), size)] if text else []


def within_budget(chunks: list[str], max_tokens: int) -> str:
    """Leading chunks within a budget; a part of the next one only if over 100 tokens are left."""
    out, used = [], 0
    for c in chunks:
        n = len(c) // 4
        if used + n > max_tokens:
            left = max_tokens - used
            if left > 100 and n:
                out.append(c[: left * (len(c) // n)] + "\n\n[Content truncated...]")
            break
        out.append(c)
        used += n
    return "\n\n".join(out)


def page_chunks(df: DataFrame, id_col: str, text: str, size: int = 4000) -> DataFrame:
    """(id, chunk_no, n_chunks, chunk): greedy packing carries state from chunk to chunk, so it runs in
    Arrow batches; pages that fit one chunk never leave the JVM."""
    d = df.select(F.col(id_col).alias("id"), F.col(text).alias("body")).where("body is not null and body <> ''")
    fits = count_tokens(F.col("body")) <= size
    small = d.where(fits).select("id", F.lit(0).alias("chunk_no"), F.lit(1).alias("n_chunks"), F.col("body").alias("chunk"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, no, len(cs), c) for i, t in zip(pdf["id"], pdf["body"], strict=True) for cs in [pack_paragraphs(t, size)] for no, c in enumerate(cs)]
            yield pd.DataFrame(rows, columns=["id", "chunk_no", "n_chunks", "chunk"])

    kind = d.schema["id"].dataType.simpleString()
    return small.unionByName(d.where(~fits).mapInPandas(run, f"id {kind}, chunk_no int, n_chunks int, chunk string"))


def headline(text: str | None, terms: list[str], fragments: int = 5, most: int = 100, before: str = "****", after: str = "****", between: str = "\n\n---\n\n") -> str | None:
    """Excerpts around query terms with the terms marked; null when no term occurs.

    Hits are grouped from the left: a fragment takes hits while it spans at most ``most`` words, then it
    is widened evenly to that size; fragments with more different terms come first, in text order.
    """
    import regex

    if not text or not terms:
        return None
    words = list(regex.finditer(r"[\p{L}\p{N}]+", text))
    hits = [i for i, w in enumerate(words) if w[0].lower() in terms]
    spans: list[list[int]] = []
    for h in hits:
        if spans and h - spans[-1][0] < most:
            spans[-1].append(h)
        else:
            spans.append([h])
    if not spans:
        return None
    score = lambda s: len({words[i][0].lower() for i in s})
    chosen = sorted(sorted(range(len(spans)), key=lambda k: (-score(spans[k]), k))[:fragments])
    out = []
    for k in chosen:
        s = spans[k]
        pad = (most - (s[-1] - s[0] + 1)) // 2
        a, b = max(0, s[0] - pad), min(len(words) - 1, s[-1] + pad)
        piece, at = "", words[a].start()
        for i in s:
            piece += text[at : words[i].start()] + before + words[i][0] + after
            at = words[i].end()
        out.append(piece + text[at : words[b].end()])
    return between.join(out)


def headlines(df: DataFrame, id_col: str, text: str, query: str, **options) -> DataFrame:
    """(id, excerpt) of the rows that hold all the query's terms; only those reach Python."""
    from ..functions.similarity import matches, query_tokens

    terms = query_tokens(query)
    d = df.where(matches([F.col(text)], query)).select(F.col(id_col).alias("id"), F.col(text).alias("body"))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(excerpt=[headline(t, terms, **options) for t in pdf["body"]])[["id", "excerpt"]]

    return d.mapInPandas(run, f"id {d.schema['id'].dataType.simpleString()}, excerpt string")


def result_cap(results: DataFrame) -> DataFrame:
    """Token cap per result: 2000 for a single one, else 500."""
    one = results.agg((F.count("*") == 1).alias("one"))
    return results.crossJoin(F.broadcast(one)).withColumn("cap", F.when(F.col("one"), 2000).otherwise(500)).drop("one")
