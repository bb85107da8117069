"""CSV members of zip archives as a data source: one partition for each member of each archive, read as a stream.

    register(spark)
    spark.read.format("archive_csv").schema("i int, s string").load("/data/archives")

Archives are opened where the reader runs, by a path that every executor sees (a
shared folder, or an address that Arrow's file systems know). The directories at
the archives' ends are read when the scan is planned; members are unpacked piece
by piece, so that neither an archive nor a member is ever held whole.
"""

from __future__ import annotations

import fnmatch
import re
import sys
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import csv as pacsv
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a member that are parsed at once.
BLOCK = 1 << 20
ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "date": pa.date32(), "timestamp": pa.timestamp("us", "UTC"), "timestamp_ntz": pa.timestamp("us")}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it; ``file:`` addresses as Spark writes them, too."""
    plain = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), plain) if plain.startswith("/") else pafs.FileSystem.from_uri(path)


class Member(InputPartition):
    def __init__(self, path: str, name: str) -> None:
        self.path, self.name = path, name


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.types = {f.name: ARROW[f.dataType.simpleString()] for f in schema.fields}
        self.path, self.archive, self.member = options["path"], options.get("archives", "*.zip"), options.get("members", "*.csv")
        self.block = int(options.get("block", BLOCK))

    def partitions(self) -> list[Member]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.File:
            found = [path]
        else:
            found = [f.path for f in system.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.archive)]

        def members(one: str) -> list[Member]:
            with system.open_input_file(one) as f, zipfile.ZipFile(f) as archive:
                return [Member(one, m.filename) for m in archive.infolist() if not m.is_dir() and fnmatch.fnmatch(m.filename, self.member)]

        with ThreadPoolExecutor(32) as pool:
            return [m for some in pool.map(members, sorted(found)) for m in some]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive, no member
            return
        system, _ = opened(self.path)
        read = pacsv.ReadOptions(block_size=self.block)
        convert = pacsv.ConvertOptions(column_types=self.types, include_columns=list(self.types), include_missing_columns=True, strings_can_be_null=True, null_values=[""])
        with system.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive, archive.open(partition.name) as m:
            if archive.getinfo(partition.name).file_size:
                yield from pacsv.open_csv(m, read_options=read, convert_options=convert)


class ArchiveSource(DataSource):
    """Options: ``archives`` and ``members`` (name patterns, *.zip and *.csv), ``block`` (bytes parsed at once)."""

    @classmethod
    def name(cls) -> str:
        return "archive_csv"

    def schema(self) -> str:
        raise ValueError("an archive source needs a schema")

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
