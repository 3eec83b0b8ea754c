"""A data source for numbered pages of JSON: one partition for each run of pages asked for.

``spark.read.format("paged_json").schema(...).option("path", ...).options(pageSize=50,
offset=120, limit=300).load()`` reads the pages that hold rows 120 to 419 and no other.
Pages lie in folders ``page=0``, ``page=1`` ... of files that hold a JSON array, all but
the last of ``pageSize`` items. As a stream its offset is the number of the next page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass
class Pages(InputPartition):
    first: int  #: the first page
    last: int  #: the last one
    start: int  #: the first row wanted, counted over all pages
    stop: int | None  #: the row after the last one wanted


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _items(store: fs.FileSystem, folder: str) -> list[dict]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    out: list[dict] = []
    for info in sorted(found, key=lambda x: x.path):
        if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
            with store.open_input_stream(info.path) as stream:
                out += json.loads(stream.read().decode())
    return out


def _numbers(store: fs.FileSystem, folder: str) -> list[int]:
    names = [x.base_name for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == fs.FileType.Directory]
    return sorted(int(n[5:]) for n in names if n.startswith("page=") and n[5:].isdigit())


class _Common:
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.size, self.together = int(options.get("pagesize", 100)), int(options.get("pagesperpartition", 1))

    def runs(self, first: int, last: int, start: int, stop: int | None) -> list[Pages]:
        return [Pages(a, min(a + self.together - 1, last), start, stop) for a in range(first, last + 1, self.together)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        store, folder = _store(self.path)
        kinds = to_arrow_schema(self.schema)
        names = {f.name for f in self.schema} - {"page", "row"}
        for page in range(partition.first, partition.last + 1):
            rows = []
            for row, item in enumerate(_items(store, f"{folder}/page={page}"), page * self.size):
                if row >= partition.start and (partition.stop is None or row < partition.stop):
                    rows.append({n: item.get(n) for n in names} | {"page": page, "row": row})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)


class PageReader(_Common, DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        super().__init__(schema, options)
        self.start = int(options.get("offset", 0))
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[InputPartition]:
        """The pages that hold the rows wanted; without a limit the folder is listed for the last one."""
        first = self.start // self.size
        if self.limit is None:
            last = max(_numbers(*_store(self.path)), default=-1)
            stop = None
        else:
            stop = self.start + self.limit
            last = (stop - 1) // self.size
        return self.runs(first, last, self.start, stop) or [Pages(0, -1, 0, 0)]


class PageStream(_Common, DataSourceStreamReader):
    """New pages are read once each; pages appear in order and whole."""

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": max(_numbers(*_store(self.path)), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.runs(start["page"], end["page"] - 1, start["page"] * self.size, None)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        raise ValueError("paged_json needs a schema; columns page and row, if named there, are the numbers of each")

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self._options())

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(schema, self._options())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
