"""Merged blocks as real text files: a Spark data source named `block_files`.

    spark.dataSource.register(BlockFiles)
    files.write.format("block_files").mode("append").save(path)      # (doc_id, filename, lang, content)
    spark.read.format("block_files").load(path)

A file is `<path>/part-<write>-<task>/<doc_id>/<lang>/<filename>`, and its text is the content, byte for byte; so files of several documents
with one name don't meet. A task writes to a staging folder that readers don't look at. Commit moves one folder per task
to its place, abort removes them all, so a failed write leaves nothing. The driver only ever handles one name per
task. Reading has one partition per group of those folders; each partition lists its own.

Paths are those that pyarrow's file systems know (file:, hdfs:, s3: and others); on a cluster, a store that all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "doc_id bigint, filename string, lang string, content string"
#: Folders of tasks that one partition reads, unless the option `folders` says otherwise; rows of one batch.
FOLDERS, ROWS = 16, 1024
_STAGING, _DONE, _NULL = "_staging-", "part-", "_null"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    #: The task's folder in the staging folder; empty for a task without rows.
    folder: str


@dataclass
class Folders(InputPartition):
    names: tuple[str, ...]


class BlockFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.write_id = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        task = TaskContext.get()
        # An attempt has a folder of its own: one that was lost or is repeated doesn't meddle with the one that counts.
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        here, known = f"{root}/{_STAGING}{self.write_id}/{name}", set()
        for batch in iterator:
            for row in batch.to_pylist():
                doc = _NULL if row["doc_id"] is None else str(row["doc_id"])
                place = f"{here}/{doc}/{quote(row['lang'] or _NULL, safe='')}"
                if place not in known:
                    known.add(place)
                    store.create_dir(place)
                with store.open_output_stream(f"{place}/{quote(row['filename'], safe='')}") as out:
                    out.write((row["content"] or "").encode())
        return Written(name if known else "")

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.base_name.startswith(_DONE):
                    store.delete_dir(x.path)
        for m in messages:
            if m is not None and m.folder:
                store.move(f"{root}/{_STAGING}{self.write_id}/{m.folder}", f"{root}/{_DONE}{self.write_id}-{m.folder}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        staging = f"{root}/{_STAGING}{self.write_id}"
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class BlockFilesReader(DataSourceReader):
    def __init__(self, path: str, folders: int):
        self.path, self.folders = path, folders

    def partitions(self) -> list[Folders]:
        store, root = _store(self.path)
        found = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.startswith(_DONE))
        return [Folders(tuple(found[k : k + self.folders])) for k in range(0, len(found), self.folders)] or [Folders(())]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, root = _store(self.path)
        rows: list[tuple] = []
        for name in partition.names:
            for x in store.get_file_info(fs.FileSelector(f"{root}/{name}", recursive=True)):
                if x.type == fs.FileType.File:
                    doc, lang, filename = x.path.rsplit("/", 3)[1:]
                    with store.open_input_stream(x.path) as file:
                        rows.append((None if doc == _NULL else int(doc), unquote(filename), None if lang == _NULL else unquote(lang), file.read().decode()))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "filename", "lang", "content"])


class BlockFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BlockFilesReader:
        return BlockFilesReader(self.options["path"], int(self.options.get("folders", FOLDERS)))

    def writer(self, schema: StructType, overwrite: bool) -> BlockFilesWriter:
        return BlockFilesWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """Files of (doc_id, filename, lang, content); names are unique in a document and language."""
    files.sparkSession.dataSource.register(BlockFiles)
    files.select("doc_id", "filename", "lang", "content").write.format("block_files").mode(mode).save(path)


def read_files(spark: SparkSession, path: str, folders: int = FOLDERS) -> DataFrame:
    """The files under path; a partition reads so many tasks' folders."""
    spark.dataSource.register(BlockFiles)
    return spark.read.format("block_files").option("folders", folders).load(path)
