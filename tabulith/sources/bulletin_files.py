"""Bulletin files as a data source of Spark: a reader that skips files by the year and month in their names, and a writer with a commit.

    register(spark)
    spark.read.format("bulletins").option("roots", "/first/place,/second/place").load().where("year = 1950 and month <= 6")
    answers.write.format("bulletins").mode("append").save("/place")

Folders may be paths or URIs of any file system that pyarrow knows; driver and executors must both reach them.
"""

from __future__ import annotations

import datetime
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from tabulith.sources.corpus import FILE_NAME

SCHEMA = "file_name string, year int, month int, pub_date date, text string"
#: Files that a task reads, about.
FILES_A_TASK = 64
#: Where writers put files until they are committed.
PENDING = "_pending"

_ARROW = pa.schema([("file_name", pa.string()), ("year", pa.int32()), ("month", pa.int32()), ("pub_date", pa.date32()), ("text", pa.string())])


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def first_folder(roots: list[str]) -> str | None:
    """SRC1: the first of the roots that is a folder; none if there is none."""
    for root in roots:
        if root:
            system, path = located(root)
            if system.get_file_info(path).type == fs.FileType.Directory:
                return root
    return None


def listed(root: str) -> list[tuple[str, int | None, int | None]]:
    """SRC2: (name, year, month) of the bulletins in a folder, in the order of their names; a month that is none is null with its year."""
    system, path = located(root)
    names = sorted(posixpath.basename(f.path) for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File)
    out = []
    for name in names:
        if name.startswith("treasury_bulletin_") and name.endswith(".txt"):
            found = re.match(FILE_NAME, name)
            good = found and 1 <= int(found[2]) <= 12
            out.append((name, int(found[1]), int(found[2])) if good else (name, None, None))
    return out


def passes(value: int | None, test: Filter) -> bool:
    """Whether a file's year or month passes a filter; null passes none."""
    if value is None:
        return False
    match test:
        case EqualTo():
            return value == test.value
        case In():
            return value in test.value
        case GreaterThan():
            return value > test.value
        case GreaterThanOrEqual():
            return value >= test.value
        case LessThan():
            return value < test.value
        case LessThanOrEqual():
            return value <= test.value
    raise TypeError(type(test).__name__)


@dataclass
class Files(InputPartition):
    """The files of a task."""

    names: list[tuple[str, int | None, int | None]]


class BulletinReader(DataSourceReader):
    """Lists names on the driver and reads texts in tasks; filters on year, month and file name leave files unread.

    A file that cannot be read, or is not UTF-8, is an empty text.  Without any folder there are no rows.
    """

    def __init__(self, roots: list[str], files_a_task: int):
        self.root = first_folder(roots)
        self.files_a_task = files_a_task
        self.tests: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for test in filters:
            column = test.attribute[0] if isinstance(test, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(test.attribute) == 1 else ""
            if column in ("year", "month", "file_name"):
                self.tests.append((column, test))
            else:
                yield test

    def wanted(self) -> list[tuple[str, int | None, int | None]]:
        at = {"file_name": 0, "year": 1, "month": 2}
        return [f for f in (listed(self.root) if self.root else []) if all(passes(f[at[c]], test) for c, test in self.tests)]

    def partitions(self) -> list[Files]:
        names = self.wanted()
        return [Files(names[i : i + self.files_a_task]) for i in range(0, len(names), self.files_a_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for name, year, month in partition.names:
            try:
                system, path = located(self.root)
                with system.open_input_stream(posixpath.join(path, name)) as f:
                    text = f.read().decode()
            except (OSError, UnicodeDecodeError):
                text = ""
            date = datetime.date(year, month, 1) if year else None
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, year, month, date, text), _ARROW.types, strict=True)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has put into the pending folder."""

    names: list[str]


class BulletinWriter(DataSourceWriter):
    """SRC12: one file for each row (file_name, text).  Tasks write into a pending folder of the job; the commit moves all files, an abort drops them.

    A task that is run again writes the same names in a folder of its own, so the files of the attempt that committed are the ones that count.
    """

    def __init__(self, root: str):
        self.root = root
        self.job = f"{PENDING}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, path = located(self.root)
        folder = posixpath.join(path, self.job, uuid.uuid4().hex)
        system.create_dir(folder, recursive=True)
        names = []
        for row in iterator:
            if not row["file_name"] or "/" in row["file_name"]:
                raise ValueError(f"not a file name: {row['file_name']}")
            with system.open_output_stream(posixpath.join(folder, row["file_name"])) as f:
                f.write((row["text"] or "").encode())
            names.append(posixpath.join(folder, row["file_name"]))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = located(self.root)
        system.create_dir(path, recursive=True)
        for message in messages:
            for name in message.names if message else []:
                system.move(name, posixpath.join(path, posixpath.basename(name)))
        self._drop(system, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*located(self.root))

    def _drop(self, system: fs.FileSystem, path: str) -> None:
        pending = posixpath.join(path, self.job)
        if system.get_file_info(pending).type == fs.FileType.Directory:
            system.delete_dir(pending)


class Bulletins(DataSource):
    """Options: ``roots``, folders by preference, between commas (or ``path``, one); ``files_a_task``."""

    @classmethod
    def name(cls) -> str:
        return "bulletins"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BulletinReader:
        roots = self.options.get("roots", self.options.get("path", "")).split(",")
        return BulletinReader([r.strip() for r in roots], int(self.options.get("files_a_task", FILES_A_TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> BulletinWriter:
        if overwrite:
            raise ValueError("bulletin files are only added")
        if not {"file_name", "text"} <= set(schema.fieldNames()):
            raise ValueError("rows need file_name and text")
        return BulletinWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Bulletins)
