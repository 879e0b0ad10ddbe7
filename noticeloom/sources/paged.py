"""Paged interfaces as a data source: numbered pages of records, of which a short one is the last.

    spark.dataSource.register(PagedRecords)
    spark.read.format("paged").option("path", folder).option("api", "jobs").load()

Rows are (api, page, place, value), a record's JSON each. Pages are read by several readers at once, each from its own first page on and
with the number of readers as its step, until it comes to a page that isn't full; behind a short page there are none. As a stream, the offset is the next page to read; full
pages are read once, and the short one too as soon as it is there, so that a page must not grow after it was read short.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .work import ship

SCHEMA = "api string, page int, place int, value string"
#: Records of a full page; readers at once.
PAGE, READERS = 100, 8


def stored_page(path: str, api: str, page: int) -> list[str]:
    """The records of a page that was stored in a folder, one a line; none where there is no such page."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    folder = fs.FileSelector(f"{root}/api={api}/page={page}", allow_not_found=True)
    lines: list[str] = []
    for info in sorted(store.get_file_info(folder), key=lambda f: f.path):
        if info.is_file and not info.base_name.startswith(("_", ".")):
            with store.open_input_stream(info.path) as f:
                lines += [line for line in f.read().decode().split("\n") if line]
    return lines


class _Pages(InputPartition):
    def __init__(self, api: str, first: int, step: int, end: int | None = None):
        self.api, self.first, self.step, self.end = api, first, step, end


class _Reading:
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("pagesize", PAGE))
        self.apis, self.readers = [a.strip() for a in options["api"].split(",")], int(options.get("readers", READERS))

    def page(self, api: str, number: int) -> list[str]:
        return stored_page(self.path, api, number)

    def read(self, partition: _Pages) -> Iterator[tuple]:
        number = partition.first
        while partition.end is None or number < partition.end:
            records = self.page(partition.api, number)
            yield from ((partition.api, number, k, r) for k, r in enumerate(records))
            if len(records) < self.size:
                return
            number += partition.step


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[_Pages]:
        return [_Pages(api, first, self.readers) for api in self.apis for first in range(1, self.readers + 1)]


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {api: 1 for api in self.apis}

    def latestOffset(self, *known) -> dict:
        """The page after the last that is there, from where the stream has come to."""
        at = dict(getattr(self, "reached", None) or self.initialOffset())
        for api in self.apis:
            while records := self.page(api, at[api]):
                at[api] += 1
                if len(records) < self.size:
                    break
        self.reached = at
        return at

    def partitions(self, start: dict, end: dict) -> list[_Pages]:
        self.reached = {api: max(end[api], (getattr(self, "reached", None) or end)[api]) for api in self.apis}
        return [_Pages(api, page, 1, page + 1) for api in self.apis for page in range(start[api], end[api])]

    def commit(self, end: dict) -> None:
        self.reached = dict(end)


class PagedRecords(DataSource):
    """Options: path, api (one or more, by commas), pagesize, readers."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format "paged" known to a session and its executors."""
    ship(spark)
    spark.dataSource.register(PagedRecords)


