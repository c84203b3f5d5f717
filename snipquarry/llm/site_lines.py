"""Lines repeated across one source's documents.

Method: a line's page frequency within its source is held against the same line's page frequency in all
other sources by a log-likelihood ratio (G²) with Benjamini-Hochberg false-discovery control; significant
excess lines that also reach the stated counts are taken out by an anti-join, and pages are put together
again by line position. The outside rate is never taken above a tenth of a percent, as a notice that all
sources share is repeated in each of them. Everything runs in the JVM; ranks come from counts of p-values
by bins, so no source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_side

MIN_LETTERS = 20
MIN_PAGES = 5
MIN_SHARE = 0.15
FDR = 0.01
#: The outside rate is never taken above this, so that a line all sources repeat still shows.
MAX_BACKGROUND = 0.001
#: Bins of log p-values: of a quarter each, down to -1000.
BINS, LEAST_BIN = 4, -4000
BROADCAST_ROWS = 200_000


def line_key(line: Column) -> Column:
    """Hash of a line's comparison form; null for lines with too few letters."""
    norm = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))
    letters = F.length(F.translate(norm, " ", ""))
    return F.when(letters >= MIN_LETTERS, F.xxhash64(norm))


def _jobs(df: DataFrame, source: str, doc: str, text: str) -> DataFrame:
    return df.where(F.col(source).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(source)).alias("s"), F.col(text).alias("body"))


def line_statistics(df: DataFrame, source: str = "crawl_job_id", doc: str = "doc_id", text: str = "markdown_content") -> DataFrame:
    """(s, k, pages, rows, outside_rate, llr, significant) of each line key standing in at least MIN_PAGES pages of a source."""
    d = _jobs(df, source, doc, text)
    sizes = d.groupBy("s").agg(F.count("*").alias("rows"))
    # hash each line once and drop repeats within the page before anything is exploded or shuffled
    keys = d.select("s", F.explode(F.array_distinct(F.transform(F.split("body", "\n"), line_key))).alias("k")).where("k is not null")
    counts = materialize(keys.groupBy("s", "k").agg(F.count("*").alias("pages")), "line-counts")
    per_source = counts.groupBy("s").agg(F.count("*").alias("kinds"))
    found = counts.where(F.col("pages") >= MIN_PAGES)
    # a key's pages in all sources, for the keys in question only
    every = counts.join(found.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.sum("pages").alias("everywhere"))
    total = sizes.agg(F.sum("rows").alias("all_rows"))
    found = found.join(every, "k").join(per_source, "s").join(sizes, "s").crossJoin(F.broadcast(total))  # total is one row
    outside = (F.col("everywhere") - F.col("pages")) / F.greatest(F.col("all_rows") - F.col("rows"), F.lit(1))
    k, n = F.col("pages").cast("double"), F.col("rows").cast("double")
    p0 = F.col("outside_rate")
    miss = n - k
    llr = 2 * (k * F.log(k / (n * p0)) + F.when(miss > 0, miss * F.log(miss / (n * (1 - p0)))).otherwise(0.0))
    found = found.withColumn("outside_rate", F.least(F.greatest(outside, F.lit(1e-9)), F.lit(MAX_BACKGROUND))).withColumn("llr", F.when(k / n > p0, llr).otherwise(0.0))
    # chi-square tail with one degree of freedom, by its upper bound exp(-llr / 2), rounded up to a bin
    found = materialize(found.withColumn("bin", F.greatest(F.ceil(-F.col("llr") / 2 * BINS), F.lit(LEAST_BIN))), "line-tests")
    w = Window.partitionBy("s").orderBy("bin")
    bins = found.groupBy("s", "kinds", "bin").agg(F.count("*").alias("n")).withColumn("r", F.sum("n").over(w))  # at most -LEAST_BIN rows a source
    last = bins.where(F.col("bin") / BINS <= F.log(F.lit(FDR) * F.col("r") / F.col("kinds"))).groupBy("s").agg(F.max("bin").alias("last"))
    found = found.join(last, "s", "left")
    return found.withColumn("significant", F.coalesce(F.col("bin") <= F.col("last"), F.lit(False))).select("s", "k", "pages", "rows", "outside_rate", "llr", "significant")


def repeated_lines(df: DataFrame, source: str = "crawl_job_id", doc: str = "doc_id", text: str = "markdown_content") -> DataFrame:
    """(doc_id, line_no, source): every occurrence of a line repeated within its source.

    Rows without source or text give nothing, but rows without text count as rows of their source.
    Repeated rows count as often as they stand; an empty table gives an empty result.
    """
    stats = line_statistics(df, source, doc, text)
    bad = stats.where(F.col("significant") & (F.col("pages") >= MIN_SHARE * F.col("rows"))).select("s", "k")
    bad = small_side(materialize(bad, "site-lines"), BROADCAST_ROWS)
    # a page's lines become keys once; positions of keys survive as array positions
    lines = _jobs(df, source, doc, text).select("doc_id", "source", "s", F.posexplode(F.transform(F.split("body", "\n"), line_key)).alias("line_no", "k")).where("k is not null")
    return lines.join(bad, ["s", "k"], "left_semi").select("doc_id", "line_no", "source")


def without_repeated_lines(df: DataFrame, source: str = "crawl_job_id", doc: str = "doc_id", text: str = "markdown_content") -> DataFrame:
    """(doc_id, cleaned, n_removed) of every row: the text without its source's repeated lines, in order.

    A null text stays null.
    """
    hits = repeated_lines(df, source, doc, text).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))  # bounded by a page's lines
    joined = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("body")).join(hits, "doc_id", "left")
    gone = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    kept = F.filter(F.split("body", "\n"), lambda _, i: ~F.array_contains(gone, i))
    return joined.select("doc_id", F.array_join(kept, "\n").alias("cleaned"), F.size(gone).alias("n_removed"))
