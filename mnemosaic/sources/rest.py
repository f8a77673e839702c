"""A batch source for memories behind a JSON endpoint: spark.read.format("memory_rest").option("url", ...)."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, content string, source string"


class Page(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class Reader(DataSourceReader):
    """One task for each page: `pages` (default 1) of `url`, whose `{page}` counts from 0. A page that doesn't answer is an error, not an empty page."""

    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.pages = options["url"], int(options.get("pages", "1"))
        self.source, self.timeout = options.get("source", "rest"), float(options.get("timeout", "10"))

    def partitions(self) -> list[Page]:
        return [Page(self.url.replace("{page}", str(n))) for n in range(self.pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        with urllib.request.urlopen(partition.url, timeout=self.timeout) as answer:
            found = json.load(answer)
        for row in found.get("results", found.get("memories", [])) if isinstance(found, dict) else found:
            yield (str(row.get("id", "")), row.get("content") or row.get("memory") or row.get("text") or "", self.source)


class MemoryRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "memory_rest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MemoryRest)
