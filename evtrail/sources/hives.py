"""Registry hives as a Spark data source (survey A12, A13, A19, 2.14): a row for each value of each key.

    spark.dataSource.register(HiveSource)
    spark.read.format("hive_file").load("/evidence/hives").filter("lkey = 'software\\\\run'")

Files are listed once and packed into partitions by their bytes; a task holds one hive, and hands on its rows in
batches. A filter on lkey (equal, one of several, a prefix) or on parent (equal) is pushed to the reader, which then
goes down just those paths instead of through the hive. Files that aren't hives give one row that says so, in fault.

Files are opened with Arrow's file systems (local folders, S3, GCS, HDFS with libhdfs), as a Python source has no part
in Spark's own; the ingest of evidence keeps to Spark's readers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from . import binary

#: Bytes of files in a partition, and rows in a batch.
PACKED, ROWS = 64 * 1024 * 1024, 10_000
SCHEMA = "path string, parent string, key string, lkey string, last_write string, value string, kind string, data string, fault string"
_SCHEMA = pa.schema([(x.split()[0], pa.string()) for x in SCHEMA.split(", ")])


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: tuple[str, ...]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Spark's file:/x is file:///x."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def found(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files below a folder."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.is_file]
    scheme = path.partition("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((scheme + x.path, x.size) for x in below)


def packed(files: list[tuple[str, int]], most: int = PACKED) -> list[Files]:
    """Files in turn, most bytes or one file to a partition."""
    out, own, size = [], [], 0
    for path, n in files:
        if own and size + n > most:
            out.append(Files(tuple(own)))
            own, size = [], 0
        own.append(path)
        size += n
    return [*out, Files(tuple(own))] if own else out


class HiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hive_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> HiveReader:  # noqa: ANN401, ARG002
        return HiveReader(self.options["path"])


class HiveReader(DataSourceReader):
    """keys: paths of which the values are read; parents: paths of which the subkeys' are; below: a path from which all is; None: no such wish."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.keys: set[str] | None = None
        self.parents: set[str] | None = None
        self.below: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Notes where to go. All filters are given back: Spark tests the rows once more, so a path too many does no harm."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("lkey",), ("parent",)):
                wished = {str(f.value)} if isinstance(f, EqualTo) else {str(v) for v in f.value if v is not None}
                if f.attribute == ("lkey",):
                    self.keys = wished if self.keys is None else self.keys & wished
                else:
                    self.parents = wished if self.parents is None else self.parents & wished
            elif isinstance(f, StringStartsWith) and f.attribute == ("lkey",):
                below = f.value.rpartition("\\")[0]
                self.below = max(self.below or "", below, key=len)
            yield f

    def partitions(self) -> list[Files]:
        return packed(found(self.path))

    def rows_of(self, hive: binary.Hive, path: str) -> Iterator[tuple]:
        for key, name, depth in self._places(hive):
            for at, full in hive.keys(key, name, depth):
                written, parent = hive.written(at), full.rpartition("\\")[0].lower()
                values = hive.values(at) or [(None, None, None)]
                for value, kind, data in values:
                    text = data if data is None or isinstance(data, str) else "\n".join(data) if isinstance(data, list) else str(data)
                    yield path, parent, full, full.lower(), written, value, kind, text, None

    def _places(self, hive: binary.Hive) -> Iterator[tuple[int, str, int]]:
        """(key, its path, levels below it to read) that the wishes lead to; of several kinds of wishes the first alone is followed."""
        if self.keys is not None:
            for k in sorted(self.keys):
                if (at := hive.place(k)) is not None:
                    yield *at, 0
        elif self.parents is not None:
            for k in sorted(self.parents):
                if (at := hive.place(k)) is not None:
                    yield from ((key, f"{at[1]}\\{hive.name(key)}".lstrip("\\"), 0) for key in hive.subkeys(at[0]))
        elif (at := hive.place(self.below or "")) is not None:
            yield *at, binary.MOST_DEPTH

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            store, at = opened(path)
            with store.open_input_stream(at) as file:
                content = file.read()
            rows = self._guarded(content, path)
            while own := list(islice(rows, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*own, strict=True)], schema=_SCHEMA)

    def _guarded(self, content: bytes, path: str) -> Iterator[tuple]:
        try:
            yield from self.rows_of(binary.Hive(content), path)
        except binary.Malformed as fault:
            yield path, None, None, None, None, None, None, None, str(fault)


def hives(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all hives in a folder, or of one file. Filters on lkey and parent reach the reader."""
    spark.dataSource.register(HiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("hive_file").load(path)


def key_values(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(path, key, last_write, value, kind, data) of one key in each hive, whatever its case."""
    wanted = key.replace("/", "\\").strip("\\").lower()
    return hives(spark, path).filter(F.col("lkey") == wanted).filter("value IS NOT NULL").select("path", "key", "last_write", "value", "kind", "data")


def subkeys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(path, key) of the keys right below one."""
    wanted = key.replace("/", "\\").strip("\\").lower()
    return hives(spark, path).filter(F.col("parent") == wanted).filter("lkey <> ''").select("path", "key").distinct()


def autoruns(spark: SparkSession, path: str) -> DataFrame:
    """Values of the Run keys of all hives."""
    return hives(spark, path).filter(F.col("lkey").isin(*(p.lower() for p in binary.RUN_PATHS))).filter("value IS NOT NULL").select("path", "key", "last_write", "value", "data")
