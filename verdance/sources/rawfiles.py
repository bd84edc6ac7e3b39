"""Raw files under their own names: a Spark data source that writes one text file per row and reads them back.

Instruments and their tools exchange single text files named by instrument and time. Spark's own writers name files
after tasks, and its text reader weighs every file like several megabytes. This source does both by the file:

* ``df.write.format("named_files").mode("append").save(path)`` writes each row's ``value`` to ``path/[folder/]file_name``.
  A task writes below a staging folder and moves its files into place when all are written, so a task that fails leaves
  none; a task that runs twice writes the same files again. The job's end, good or bad, removes the staging folder.
* ``spark.read.format("named_files").load(path)`` gives ``folder, file_name, arrived, value``. The names and sizes are
  listed once, and files go to tasks by bytes (option ``taskBytes``), however many or few that makes.

Names must be plain: no separators, no leading dot or underscore, and unique within their folder, or the write fails.
Where two runs may have one name, :func:`apart` gives each file a folder in which its name is unique.
A row without a name or value is refused as well; nothing is written for a task that has one. Paths may be local or any
URI of a file system that PyArrow knows. For other stores :func:`verdance.sources.raw.discover` reads the same files by
Spark's text reader.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FORMAT = "named_files"
SCHEMA = "folder STRING, file_name STRING, arrived TIMESTAMP, value STRING"
TASK_BYTES = 64 << 20
#: Rows of a batch that the reader hands over.
_ROWS = 64


def _store(path: str):
    """File system and path within it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def _plain(name: str | None, what: str) -> str:
    if not name or "/" in name or "\\" in name or name[0] in "._" or name != name.strip():
        raise ValueError(f"bad_name: {what} {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the driver: numbers only, however many files it wrote."""

    files: int
    bytes: int


@dataclass
class Share(InputPartition):
    """The files of one task: path and modification time."""

    files: list[tuple[str, float]]


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return NamedFilesReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("named_files adds files to a folder and replaces those of equal name: use mode append")
        return NamedFilesWriter(self.options, schema.fieldNames())


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        if not {"file_name", "value"} <= set(columns):
            raise ValueError("named_files writes the columns file_name, value and optionally folder")
        self.path, self.columns = options["path"], columns
        self.staging = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.path)
        context = TaskContext.get()
        own = posixpath.join(root, self.staging, f"{context.partitionId()}-{context.taskAttemptId()}")
        at = {c: self.columns.index(c) for c in ("folder", "file_name", "value") if c in self.columns}
        made: dict[str, str] = {}
        size = 0
        try:
            for row in iterator:
                name = _plain(row[at["file_name"]], "file")
                folder = row[at["folder"]] if "folder" in at else None
                parts = [_plain(p, "folder") for p in folder.split("/")] if folder else []
                target = posixpath.join(root, *parts, name)
                text = row[at["value"]]
                if text is None:
                    raise ValueError(f"no_text: {name}")
                if target in made:
                    raise ValueError(f"double_name: {posixpath.join(*parts, name)}")
                made[target] = posixpath.join(own, str(len(made)))
                if len(made) == 1:
                    store.create_dir(own, recursive=True)
                data = text.encode()
                size += len(data)
                with store.open_output_stream(made[target]) as out:
                    out.write(data)
            for folder in {posixpath.dirname(t) for t in made}:
                store.create_dir(folder, recursive=True)
            for target, staged in made.items():
                store.move(staged, target)
        except BaseException:
            self._drop(store, own)
            raise
        return Written(len(made), size)

    def commit(self, messages: list[Written | None]) -> None:
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _store(self.path)
        self._drop(store, posixpath.join(root, self.staging))

    @staticmethod
    def _drop(store, folder: str) -> None:
        from pyarrow import fs

        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class NamedFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.task_bytes = int(options.get("taskbytes", options.get("taskBytes", TASK_BYTES)))

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            inner = posixpath.relpath(info.path, root)
            hidden = any(p[0] in "._" for p in inner.split("/"))
            if info.type == fs.FileType.File and not hidden and inner.lower().endswith(".csv"):
                found.append((inner, info.size or 0, info.mtime_ns / 1e9 if info.mtime_ns else 0.0))
        shares: list[Share] = []
        held = self.task_bytes
        for inner, size, changed in sorted(found):
            # a file counts its bytes and what it costs to open it
            if held + size > self.task_bytes:
                shares.append(Share([]))
                held = 0
            shares[-1].files.append((inner, changed))
            held += size + 4096
        return shares or [Share([])]

    def read(self, partition: Share) -> Iterator:
        import datetime as dt

        import pyarrow as pa

        store, root = _store(self.path)
        kinds = [("folder", pa.string()), ("file_name", pa.string()), ("arrived", pa.timestamp("us", "UTC")), ("value", pa.string())]
        for lo in range(0, len(partition.files), _ROWS):
            columns: list[list] = [[], [], [], []]
            for inner, changed in partition.files[lo : lo + _ROWS]:
                with store.open_input_stream(posixpath.join(root, inner)) as stream:
                    text = stream.read().decode("utf-8", "replace")
                folder, name = posixpath.split(inner)
                at = dt.datetime.fromtimestamp(changed, dt.timezone.utc)
                for column, v in zip(columns, (folder or None, name, at, text), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def register(spark: SparkSession) -> None:
    """Make the format known to the session; its code travels with the job, so workers need no package."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(NamedFiles)


def apart(files: DataFrame) -> DataFrame:
    """``files`` with a folder each: of rows with one path the first keeps it, others go below ``again-1``, ``again-2``, ...

    The given folder stays the end of the path. A name tells a run's second only, so two runs can share one: neither is
    lost, nor is a row that comes twice. They are numbered in the order of their texts, so that a task that runs again
    deals them alike.
    """
    folder = F.coalesce("folder", F.lit("")) if "folder" in files.columns else F.lit("")
    numbered = files.withColumn("folder", folder)
    again = F.row_number().over(Window.partitionBy("folder", "file_name").orderBy("value")) - 1
    above = F.when(again > 0, F.concat(F.lit("again-"), again))
    own = F.concat_ws("/", above, F.nullif("folder", F.lit("")))
    return numbered.withColumn("folder", F.nullif(own, F.lit("")))


def write_files(files: DataFrame, path: str) -> None:
    """Write ``file_name, value`` and optionally ``folder`` as one text file per row.

    Rows are dealt by their path, so that two rows with one path meet in a task, which then fails by ``double_name``.
    """
    register(files.sparkSession)
    columns = [c for c in ("folder", "file_name", "value") if c in files.columns]
    dealt = files.select(*columns).repartition(*[c for c in columns if c != "value"])
    dealt.write.format(FORMAT).mode("append").save(path)


def read_files(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``folder, file_name, arrived, value`` of the CSV files below ``path``."""
    register(spark)
    return spark.read.format(FORMAT).option("taskBytes", str(task_bytes)).load(path)
