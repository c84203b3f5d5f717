"""Pages behind addresses as a Spark data source, fetched in parallel on executors."""

from __future__ import annotations

import urllib.request
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class _Urls(InputPartition):
    urls: list[str]


class PageSource(DataSource):
    """format("page"), options ``urls`` (by line feed), ``timeout`` (seconds), ``per_task``.

    One row per address; a failed fetch gives a row with ``error`` and no content. Any scheme that the
    standard opener knows works, files included.
    """

    @classmethod
    def name(cls) -> str:
        return "page"

    def schema(self) -> str:
        return "url string, content string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.timeout = float(options.get("timeout", "60"))
        self.per_task = int(options.get("per_task", "16"))

    def partitions(self):
        step = self.per_task
        return [_Urls(self.urls[i : i + step]) for i in range(0, len(self.urls), step)] or [_Urls([])]

    def read(self, partition):
        for url in partition.urls:
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as r:  # noqa: S310
                    yield url, r.read().decode("utf-8", "replace"), None
            except Exception as e:
                yield url, None, f"{type(e).__name__}: {e}"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
