"""Files, uploads and repositories as document sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_type_of, glob_to_regex, resolve_title

MAX_BYTES = 10 * 1024 * 1024
BINARY_CHECK = 1024
TEXT_ENDINGS = ("md", "markdown", "mdx", "mdown", "mkd", "mdwn", "rst", "rest", "restx", "rtxt", "rstx", "html", "htm", "txt")
# Folders of a repository that hold no documentation.
SKIPPED_FOLDERS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", "target", ".tox", "vendor")


def read_files(spark: SparkSession, path: str, endings: tuple[str, ...] = TEXT_ENDINGS, max_bytes: int = MAX_BYTES, include: list[str] | None = None, exclude: list[str] | None = None, root: str = "") -> DataFrame:
    """(path, content, content_type, problem) of the files below a folder.

    Listing and the tests on ending, size and globs need no content; bytes are read for files that pass
    them. ``problem`` is null for good files, else too_large, binary or not_utf8, with null content.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/") + "/", "") if root else F.col("path")
    f = raw.withColumn("rel", rel).where(F.lower("path").rlike(r"\.(" + "|".join(endings) + ")$"))
    f = f.where(~F.col("path").rlike("(^|/)(" + "|".join(x.replace(".", r"\.") for x in SKIPPED_FOLDERS) + ")/"))
    if include:
        f = f.where(F.col("rel").rlike("|".join(glob_to_regex(g) for g in include)))
    for g in exclude or []:
        f = f.where(~F.col("rel").rlike(glob_to_regex(g)))
    big = F.col("length") > max_bytes
    binary = F.position(F.lit(b"\x00"), F.substring("content", 1, BINARY_CHECK)) > 0
    problem = F.when(big, "too_large").when(binary, "binary").when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8")
    return f.select("path", "rel", "length", problem.alias("problem"), F.when(problem.isNull(), F.decode("content", "UTF-8")).alias("content"), content_type_of(F.col("path")).alias("content_type"))


def as_uploads(files: DataFrame, source: str) -> DataFrame:
    """Good files as documents of an uploaded source, bad ones left out."""
    url = F.concat(F.lit(f"upload://{source}/"), F.regexp_extract("path", r"([^/]*)$", 1))
    d = files.where("problem is null").withColumn("url", url)
    return d.select("url", resolve_title(F.lit(None).cast("string"), F.col("content"), F.col("url")).alias("title"), "content_type", F.col("content").alias("markdown_content"), F.md5("content").alias("content_hash"))


def as_repository(files: DataFrame, repo_url: str, branch: str = "main") -> DataFrame:
    """Good files as documents of a repository checkout, addressed at their branch, in path order."""
    from ..functions.text import blob_url

    d = files.where("problem is null").withColumn("url", blob_url(F.lit(repo_url), F.lit(branch), F.col("rel")))
    return d.select("url", "rel", "content_type", F.col("content").alias("markdown_content"), F.md5("content").alias("content_hash")).orderBy("rel")


def write_version(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A table version as Parquet, one folder per version."""
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as one JSON text each."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
