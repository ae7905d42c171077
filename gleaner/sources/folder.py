"""A folder of documents as a Spark data source: every file, whatever its kind, in one table.

    documents(spark, folder).filter("suffix = 'docx'")

Files are listed once, when the scan is planned, and dealt to partitions by their bytes (option partitionBytes), small ones together. Word documents give
paragraphs and tables, text files their lines; a file of another kind and one that cannot be read is one row with an error, so that none is passed
over. Filters on the suffix leave other files unread. Python sources have no way to be told which columns are wanted.

Defined cases: an empty folder has no rows; an empty text file is one empty line; bytes that are no UTF-8 are replaced; a path without a scheme is a local one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .docx import blocks

SCHEMA = "path string, suffix string, block_idx int, block_type string, content string, style string, outline int, cells array<array<string>>, error string"
TEXTS = ("txt", "md")
PARTITION_BYTES = 32 << 20


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """The file system and the path in it, and what to put before paths to have them back as given."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri, ""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    fs, path = pyarrow.fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)
    return fs, path, uri[: len(uri) - len(path)] if uri.endswith(path) else ""


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


@dataclass
class Files(InputPartition):
    paths: list[str]


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path", "")
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.suffixes: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Keeps the suffixes that all filters on them allow; Spark applies the other filters."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("suffix",):
                allowed = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.suffixes = allowed if self.suffixes is None else self.suffixes & allowed
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, path, _ = opened(self.path)
        top = fs.get_file_info(path)
        every = [top] if top.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        wanted = sorted((f.path, f.size) for f in every if f.type == pyarrow.fs.FileType.File and (self.suffixes is None or suffix_of(f.path) in self.suffixes))
        out: list[Files] = []
        room = 0
        for name, size in wanted:
            if not out or size > room:
                out.append(Files([]))
                room = self.most
            out[-1].paths.append(name)
            room -= size
        return out or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _, lead = opened(self.path)
        for path in partition.paths:  # type: ignore[attr-defined]
            suffix = suffix_of(path)
            whole = (lead + path, suffix)
            try:
                if suffix != "docx" and suffix not in TEXTS:
                    raise ValueError(f"no reader for .{suffix}")
                with fs.open_input_file(path) as file:
                    data = file.read()
                if suffix == "docx":
                    rows = [(*whole, i, *b, None) for i, b in enumerate(blocks(data))]
                else:
                    lines = re.split("\r?\n", data.decode("utf-8", "replace"))
                    rows = [(*whole, i, "paragraph", line, None, None, None, None) for i, line in enumerate(lines)]
            except Exception as error:  # whatever is wrong with one file is that file's row
                rows = [(*whole, None, None, None, None, None, None, f"{type(error).__name__}: {error}")]
            yield from rows


def documents(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The rows (SCHEMA) of all files below a path; makes the source known to the session, and lets it have filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    return spark.read.format(FolderSource.name()).option("path", path).option("partitionBytes", partition_bytes).load()


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options)
