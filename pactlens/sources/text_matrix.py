"""A sink for matrices as aligned text, with commit.

``rows.write.format("text_matrix").mode("overwrite").save(path)`` writes one line per row, the
first column to the left and the others to the right, under one line with their names.  Tasks
write to a folder of their own job below ``path``, which the driver makes; the driver moves the files of the successful
attempts into place when all tasks are done, so a failed or repeated task leaves nothing behind.
``path`` is any place that pyarrow can open on all executors.

Defined cases: a null cell is an empty one; no cell is cut, longer ones widen their line; an
empty table gives the line of names only; of several tasks each writes a file, in the order of
their numbers, and the names stand in the first one alone.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

# Ship the writer with the task, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIRST, OTHERS = 24, 8
#: Attempts to delete the folder of an aborted job while its last tasks end.
ABORTS = 20


def matrix_line(cells: list) -> str:
    """The first cell to the left, the others to the right, at least one space between two."""
    first, *others = ["" if c is None else str(c) for c in cells]
    return first.ljust(FIRST) + "".join(" " + c.rjust(OTHERS - 1) for c in others)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _is_folder(files, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type == fs.FileType.Directory


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str


class TextMatrixWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.job = path.rstrip("/"), names, overwrite, uuid.uuid4().hex

    @property
    def staged(self) -> str:
        return f"{self.path}/_staged-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Part:
        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        files, staged = _open(self.staged)
        if not _is_folder(files, staged):
            raise FileNotFoundError(f"{staged} is gone: the job has been aborted")
        with files.open_output_stream(f"{staged}/{name}") as out:
            for row in iterator:
                out.write((matrix_line(list(row)) + "\n").encode())
        return Part(task.partitionId(), name)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        files, path = _open(self.path)
        staged = f"{path}/_staged-{self.job}"
        files.create_dir(staged, recursive=True)
        before = [f.path for f in files.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-")]
        with files.open_output_stream(f"{staged}/names") as out:
            out.write((matrix_line(self.names) + "\n").encode())
        parts = ["names", *(m.name for m in sorted((m for m in messages if m), key=lambda m: m.number))]
        for k, name in enumerate(parts):
            files.move(f"{staged}/{name}", f"{path}/part-{self.job}-{k:05d}.txt")
        if self.overwrite:
            for old in before:
                files.delete_file(old)
        files.delete_dir(staged)
        with files.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[Part | None]) -> None:
        files, staged = _open(self.staged)
        for left in reversed(range(ABORTS)):
            if not _is_folder(files, staged):
                break
            try:
                files.delete_dir(staged)
            except OSError:  # a task that still ran has opened a file meanwhile; without the folder none can
                if not left:
                    raise


class TextMatrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_matrix"

    def writer(self, schema: StructType, overwrite: bool) -> TextMatrixWriter:
        made = TextMatrixWriter(self.options["path"], schema.fieldNames(), overwrite)
        files, staged = _open(made.staged)
        files.create_dir(staged, recursive=True)  # by the driver: a task that outlives an abort does not bring it back
        return made


def write_matrix(matrix: DataFrame, path: str) -> None:
    """The rows of a matrix as text, in the order of their first column, instead of what was there.

    A matrix has a row per label, so one task writes it.
    """
    matrix.sparkSession.dataSource.register(TextMatrix)
    matrix.orderBy(matrix.columns[0]).coalesce(1).write.format("text_matrix").mode("overwrite").save(path)
