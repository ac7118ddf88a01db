"""Files as a two-phase sink: tasks stage them, and only the whole write puts them in place."""

from __future__ import annotations

import os
import shutil
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class NoteFiles(DataSource):
    """``note_files``: rows (path, content) become files below the option ``folder``, which all machines have mounted.

    A task writes into a folder of its own attempt.  The commit moves what the
    successful attempts wrote into place; if any task fails for good, nothing
    is moved and what was staged is taken away.
    """

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["folder"])


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.staging = os.path.join(folder, f".staging-{uuid.uuid4().hex}")

    def write(self, rows: Iterator[Row]) -> Staged:
        attempt = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(attempt)
        for row in rows:
            with open(os.path.join(attempt, row.path), "w", encoding="utf-8") as file:
                file.write(row.content)
        return Staged(attempt)

    def commit(self, messages: list[Staged | None]) -> None:
        for message in messages:
            if message is not None:
                for name in os.listdir(message.folder):
                    os.replace(os.path.join(message.folder, name), os.path.join(self.folder, name))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


# so that tasks need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
