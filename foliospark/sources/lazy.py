"""A data source of single pages: one partition a page range, only the asked bytes are read.

    spark.dataSource.register(PageSource)
    spark.read.format("document_pages").option("index", json of [[path, page_index, start, end], ...]).load()

It opens files by path on the executors, so it is for storage that is mounted there; elsewhere use
``documents.page_bytes``, which reads through Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PageRange(InputPartition):
    def __init__(self, rows: list):
        super().__init__(0)
        self.rows = rows


class PageReader(DataSourceReader):
    def __init__(self, rows: list, each: int):
        self.rows, self.each = rows, each

    def partitions(self) -> list[PageRange]:
        return [PageRange(self.rows[i : i + self.each]) for i in range(0, len(self.rows), self.each)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for path, page, start, end in partition.rows:
            with open(path.removeprefix("file:"), "rb") as f:
                f.seek(start)
                yield path, page, f.read(end - start)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_pages"

    def schema(self) -> str:
        return "path string, page_index int, page binary"

    def reader(self, schema) -> PageReader:
        return PageReader(json.loads(self.options["index"]), int(self.options.get("pages_per_partition", "1")))
