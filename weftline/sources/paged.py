"""Vectors of a service that gives them in pages, as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[int, str | None, int], tuple[list[tuple], str | None]]


class _Shard(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, shards: int, page: int):
        self.fetch, self.shards, self.page = fetch, shards, page

    def partitions(self) -> list[InputPartition]:
        return [_Shard(i) for i in range(self.shards)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cursor, seen = None, set()
        while True:
            rows, cursor = self.fetch(partition.number, cursor, self.page)
            yield from rows
            if cursor is None:
                return
            if cursor in seen:
                raise ValueError(f"the service gave the cursor {cursor} twice")
            seen.add(cursor)


def paged(spark: SparkSession, fetch: Fetch, schema: str, shards: int = 8, page: int = 1000, name: str = "paged_vectors") -> DataFrame:
    """Rows of ``fetch(shard, cursor, limit) -> (rows, next cursor)``; a null cursor begins and ends a shard.

    Each shard is one task that holds a page at a time; a lost task reads its shard again from the start.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, shards, page)

    spark.dataSource.register(Pages)
    return spark.read.format(name).load()
