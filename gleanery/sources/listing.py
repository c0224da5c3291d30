"""A data source that lists and reads the objects below a folder, whatever their names.

Spark's file sources leave out empty files and names that begin with ``_``, and give paths
in percent-encoding. This source asks the store itself. A listing is split by folders, so
that a store with very many objects is listed by many tasks; the driver sees folders only.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that are enough to keep a cluster busy; the tree is not opened further for more.
FOLDERS = 256
#: Objects in one Arrow batch, and bytes of content after which a batch ends.
BATCH_OBJECTS = 4096
BATCH_BYTES = 32 << 20

LISTED = "name string, size_bytes long, modified_at timestamp"
_ARROW = pa.schema([("name", pa.string()), ("size_bytes", pa.int64()), ("modified_at", pa.timestamp("us", "UTC"))])


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with its scheme, as the session's file systems resolve it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri().toString()
    return re.sub(r"^file:/+", "file:///", full)


def _hidden(name: str) -> bool:
    return any(part.startswith(".") for part in name.split("/"))


def _entries(system: fs.FileSystem, folder: str, recursive: bool) -> Iterator[tuple[str, bool, int, int]]:
    """(path, is a folder, bytes, microseconds since 1970) of what lies in ``folder``; none if it is not there.

    Mounted folders are walked entry by entry, so that one may hold any number of files.
    Other stores answer with the whole list, which is let go of while it is read.
    """
    if not isinstance(system, fs.LocalFileSystem):
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=recursive))
        while found:
            f = found.pop()
            if f.type in (fs.FileType.File, fs.FileType.Directory):
                is_folder = f.type == fs.FileType.Directory
                yield f.path, is_folder, 0 if is_folder else f.size, (f.mtime_ns or 0) // 1000
        return
    open_ = [folder]
    while open_:
        try:
            entries = os.scandir(open_.pop())
        except FileNotFoundError:
            continue
        with entries:
            for entry in entries:
                try:
                    state = entry.stat()
                except FileNotFoundError:  # gone by now
                    continue
                if stat.S_ISDIR(state.st_mode):
                    if recursive:
                        open_.append(entry.path)
                    yield entry.path, True, 0, 0
                elif stat.S_ISREG(state.st_mode):
                    yield entry.path, False, state.st_size, state.st_mtime_ns // 1000


class _Folder(InputPartition):
    def __init__(self, path: str, recursive: bool) -> None:
        self.path, self.recursive = path, recursive


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["root"]
        self.prefix = options.get("prefix", "")
        self.recursive = options.get("recursive", "true").lower() == "true"

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.root)
        return system, base.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        system, base = self._open()
        if not self.recursive:
            return [_Folder(base, False)]
        own, open_ = [], [base]
        while open_ and len(open_) < FOLDERS:
            deeper = []
            for folder in open_:
                own.append(_Folder(folder, False))
                found = _entries(system, folder, False)
                deeper += [path for path, is_folder, _, _ in found if is_folder and self._may_hold(path[len(base) + 1 :])]
            open_ = deeper
        return own + [_Folder(folder, True) for folder in open_]

    def _may_hold(self, folder: str) -> bool:
        """Whether names below a folder can have the prefix and be shown."""
        return not _hidden(folder) and (f"{folder}/".startswith(self.prefix) or self.prefix.startswith(f"{folder}/"))

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        system, base = self._open()
        found = _entries(system, partition.path, partition.recursive)
        files = ((path[len(base) + 1 :], size, changed) for path, is_folder, size, changed in found if not is_folder)
        shown = (f for f in files if f[0].startswith(self.prefix) and not _hidden(f[0]))
        while some := list(islice(shown, BATCH_OBJECTS)):
            names, sizes, changed = zip(*some)
            moments = pa.array(changed, pa.int64()).cast(_ARROW.field("modified_at").type)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), moments], schema=_ARROW)


class ObjectListing(DataSource):
    """``spark.read.format("object_listing").option("root", uri)``; also ``prefix``, ``recursive``."""

    @classmethod
    def name(cls) -> str:
        return "object_listing"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def listing(spark: SparkSession, root: str, prefix: str = "", recursive: bool = True) -> DataFrame:
    """(name, size_bytes, modified_at) of every object whose name starts with ``prefix``.

    Names are relative to ``root`` and as the store has them. Only names with a part that
    begins with a dot are left out. A folder that does not exist is empty.
    """
    spark.dataSource.register(ObjectListing)
    reader = spark.read.format("object_listing").option("root", qualified(spark, root))
    return reader.option("prefix", prefix).option("recursive", str(recursive).lower()).load()


def with_content(objects: DataFrame, root: str) -> DataFrame:
    """``objects`` with their bytes as ``content``; one that is gone by now has null.

    Few objects are held at a time, whatever their number in a partition.
    """
    uri = qualified(objects.sparkSession, root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            start, held, contents = 0, 0, []
            names = batch.column("name").to_pylist()
            for k, name in enumerate(names, 1):
                try:
                    with system.open_input_stream(f"{base.rstrip('/')}/{name}", compression=None) as source:
                        contents.append(source.read())
                except FileNotFoundError:
                    contents.append(None)
                held += len(contents[-1] or b"")
                if held >= BATCH_BYTES or k == len(names):
                    part = batch.slice(start, k - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*batch.schema.names, "content"])
                    start, held, contents = k, 0, []

    schema = T.StructType([*objects.schema.fields, T.StructField("content", T.BinaryType())])
    return objects.mapInArrow(read, schema)
