"""A sink for lines of text in two phases: tasks write files aside, and the driver's commit moves them to where readers look.

``df`` has one column ``value`` (see ``ndjson.as_json``). A batch is committed as a
folder by one rename, so that readers see all of it or nothing; a streaming batch is ``batch=N``,
and one that runs again after its commit changes nothing. What is aside is in
folders whose names begin with an underscore, which Spark's readers skip. The
file system must be one that all executors reach and that can rename.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    lines: int


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Lines:
    """What both writers share; it travels to the tasks."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = _filesystem(self.path)
        name, lines, out = f"part-{uuid.uuid4().hex}.json", 0, None
        try:
            for row in iterator:
                if out is None:
                    files.create_dir(f"{root}/{self.pending}", recursive=True)
                    out = files.open_output_stream(f"{root}/{self.pending}/{name}")
                out.write(((row[0] or "") + "\n").encode())
                lines += 1
        finally:
            if out is not None:
                out.close()
        # the folder goes along: a stream's commit may be called on another copy of the writer
        return _Written(f"{self.pending}/{name}" if out is not None else None, lines)

    def _move(self, messages: list[WriterCommitMessage | None], target: str) -> None:
        """The files of tasks that count become a folder; those of attempts that don't are deleted."""
        files, root = _filesystem(self.path)
        staged = f"{root}/_staged-{uuid.uuid4().hex}"
        files.create_dir(staged, recursive=True)
        for file in _files(messages):
            files.move(f"{root}/{file}", f"{staged}/{file.rpartition('/')[2]}")
        files.move(staged, f"{root}/{target}")
        self._discard(messages)

    def _discard(self, messages: list[WriterCommitMessage | None]) -> None:
        """Drops what is pending of this write."""
        files, root = _filesystem(self.path)
        for pending in {self.pending, *(f.partition("/")[0] for f in _files(messages))}:
            if files.get_file_info(f"{root}/{pending}").type != fs.FileType.NotFound:
                files.delete_dir(f"{root}/{pending}")


def _files(messages: list[WriterCommitMessage | None]) -> list[str]:
    return [m.file for m in messages if isinstance(m, _Written) and m.file]


class _Batch(_Lines, DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        super().__init__(path)
        self.overwrite = overwrite

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _filesystem(self.path)
        old = [f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory and f.base_name.startswith(("run=", "batch="))] if self.overwrite else []
        self._move(messages, f"run={uuid.uuid4().hex}")
        for folder in old:
            files.delete_dir(folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._discard(messages)


class _Stream(_Lines, DataSourceStreamWriter):
    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        files, root = _filesystem(self.path)
        if files.get_file_info(f"{root}/batch={batchId}").type == fs.FileType.NotFound:
            self._move(messages, f"batch={batchId}")
        else:
            self._discard(messages)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self._discard(messages)


class LinesSink(DataSource):
    """``df.write.format("lines").option("path", folder)``, and the same with ``writeStream``."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Batch(self.options["path"], overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Stream(self.options["path"])
