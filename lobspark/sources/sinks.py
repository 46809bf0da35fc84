"""A sink of byte files of any layout, committed as a whole.

Rows are (file, content): a task appends each row's bytes to the file of that name, in the order in which rows come; a batch's
rows of one file go there at once. It writes
under a folder of its own attempt; when all tasks are done their files are moved to their names, and when one has
failed for good everything is removed. So a retried task leaves one copy, and a failed write none. The store is
whatever ``pyarrow.fs`` writes to; the cluster's tasks and driver must share it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lobspark.sources.ranges import opened

NAME = "byte_files"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: where it is now, and under which name it belongs."""

    files: list[tuple[str, str]]


class ByteFilesWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.job = uri, overwrite, uuid.uuid4().hex

    def place(self) -> tuple[fs.FileSystem, str, str]:
        store, root = opened(self.uri)
        return store, root.rstrip("/"), f"{root.rstrip('/')}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, temporary = self.place()
        context = TaskContext.get()
        own = f"{temporary}/{context.partitionId()}-{context.taskAttemptId()}"
        files: dict[str, str] = {}
        now, out = None, None
        try:
            for batch in iterator:
                runs, at = pc.run_end_encode(batch.column("file"), run_end_type=pa.int64()), 0
                for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    content, at = batch.column("content").slice(at, end - at), end
                    if out is None or name != now:
                        if out:
                            out.close()
                        if not name or "/" in name or name.startswith((".", "_")) or name in files:
                            raise ValueError(f"not a file's name, or its rows are apart: {name!r}")
                        if not files:
                            store.create_dir(own, recursive=True)
                        now, out = name, store.open_output_stream(f"{own}/{name}")
                        files[name] = f"{own}/{name}"
                    out.write(b"".join(content.drop_null().to_pylist()))
        finally:
            if out:
                out.close()
        return Written([(at, name) for name, at in files.items()])

    def commit(self, messages: list[Written | None]) -> None:
        store, root, temporary = self.place()
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a file's rows are in several tasks")
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for at, name in files:
            store.move(at, f"{root}/{name}")
        if files:
            store.delete_dir(temporary)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, temporary = self.place()
        if store.get_file_info(temporary).type == fs.FileType.Directory:
            store.delete_dir(temporary)


class ByteFiles(DataSource):
    """``df.write.format("byte_files").mode("append").save(path)``, after ``register``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> ByteFilesWriter:
        if {f.name for f in schema} != {"file", "content"}:
            raise ValueError("rows must be (file, content)")
        return ByteFilesWriter(self.options["path"], overwrite)


def write_bytes(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes rows (file, content) to files in a folder; a file's rows must be in one task, in their order."""
    rows.sparkSession.dataSource.register(ByteFiles)
    rows.select("file", "content").write.format(NAME).mode("overwrite" if overwrite else "append").save(path)
