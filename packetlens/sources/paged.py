"""A Python data source of pages: one partition a file, one row a page. How a file opens is plugged in by its suffix."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Of a suffix, the function from a file's bytes to the texts of its pages. Libraries for other formats add theirs.
OPENERS: dict[str, Callable[[bytes], list[str]]] = {".txt": lambda data: data.decode("utf-8", "replace").split("\f")}


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", ".txt")

    def partitions(self) -> list[File]:
        if os.path.isfile(self.path):
            return [File(self.path)]
        return [File(os.path.join(d, f)) for d, _, files in sorted(os.walk(self.path)) for f in sorted(files) if f.endswith(self.suffix)]

    def read(self, partition: File) -> Iterator[tuple]:
        try:
            with open(partition.path, "rb") as file:
                pages = OPENERS[self.suffix](file.read())
        except (OSError, ValueError, KeyError) as error:
            yield (partition.path, None, None, str(error))
            return
        for number, text in enumerate(pages):
            yield (partition.path, number, text, None)


class Paged(DataSource):
    """spark.dataSource.register(Paged), then spark.read.format("paged").load(folder): (packet_id, page_no, text, error).

    Paths are those of a file system that every executor mounts; a file that can't be read is a row with an error.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "packet_id string, page_no long, text string, error string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
