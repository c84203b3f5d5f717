"""Table-valued extraction: one document to its code blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.parsers import PARSERS, parser_for
from ..functions.parsers import rst_title as parser_title

BLOCK = "block_no int, code_content string, language string, title string, description string, line_start int, line_end int"


def extract(df: DataFrame, id_col: str = "doc_id", content: str = "content", content_type: str | None = "content_type", kind: str | None = None) -> DataFrame:
    """(id, block_no from 1, code_content, language, title, description, line_start, line_end).

    Parsers are line and tree machines, so rows go through Arrow batches; null and empty documents stay
    in the JVM. Keep filters, such as unchanged pages, below this call. No parser recurses, so depth of
    nesting has no limit.
    """
    d = df.where(F.length(content) > 0).select(F.col(id_col).alias("id"), F.col(content).alias("body"), (F.lit(None).cast("string") if kind or not content_type else F.col(content_type)).alias("type"))

    def run(batches):
        for pdf in batches:
            rows = []
            for i, body, t in zip(pdf["id"], pdf["body"], pdf["type"], strict=True):
                blocks = PARSERS[kind or parser_for(t)](body)
                rows += [(i, no, b.code, b.language, b.title, b.description, b.line_start, b.line_end) for no, b in enumerate(blocks, 1)]
            out = pd.DataFrame(rows, columns=["id", "block_no", "code_content", "language", "title", "description", "line_start", "line_end"])
            yield out.astype({"line_start": "Int32", "line_end": "Int32"})

    return d.mapInPandas(run, f"id {d.schema['id'].dataType.simpleString()}, {BLOCK}")


def rst_title(c: Column) -> Column:
    """The title of a page of reStructuredText; null if there is none."""

    @F.pandas_udf("string")
    def titles(s: pd.Series) -> pd.Series:
        return s.map(lambda x: parser_title(x) if x else None)

    return titles(c)


def register(spark: SparkSession) -> None:
    """Make extract_markdown, extract_rst and extract_html usable as table functions in SQL."""
    for name, kind in (("extract_markdown", "markdown"), ("extract_rst", "restructuredtext"), ("extract_html", "html")):

        @udtf(returnType=BLOCK)
        class Extract:
            parser = staticmethod(PARSERS[kind])

            def eval(self, content: str):
                if content:
                    for no, b in enumerate(self.parser(content), 1):
                        yield no, b.code, b.language, b.title, b.description, b.line_start, b.line_end

        spark.udtf.register(name, Extract)
