"""Document formats as Spark data sources: a subclass says what its files are called and what their pages are.

    class Notes(DocumentSource):
        suffixes = (".note",)

        @classmethod
        def name(cls):
            return "notes"

        def pages(self, content, name):
            return content.decode().split("\\f")

    load(spark, Notes, "docs/").filter("length < 1000000")

Reading is planned by bytes: files are packed into partitions of ``partitionBytes`` (option, 64 MB), and filters on path
and length are applied to the listing, so files that they rule out are never opened. As a stream, files are taken in
order of (time of change, path), ``maxFilesPerTrigger`` (option) at a time; the last one taken is the offset.

A file that fails is one row with its error; one without pages gives none.
"""

from __future__ import annotations

import json
import operator
import posixpath
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

_COMPARE: dict[type, Callable] = {
    ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le,
    ds.In: lambda x, values: x in values, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: str.__contains__,
}


def register(spark: SparkSession, source: type[ds.DataSource]) -> None:
    """Makes a source known by its name, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def load(spark: SparkSession, source: type[ds.DataSource], path: str, **options) -> DataFrame:
    """The pages of the files under ``path``.

    Spark keeps a relation's last pushed filters until others are pushed, so a query without any would see those of an
    earlier one; the condition here, which all rows meet, makes every query push its own."""
    register(spark, source)
    return spark.read.format(source.name()).options(**options).load(path).filter("path IS NOT NULL")


@dataclass(frozen=True, order=True)
class Listed:
    modified: int  # nanoseconds
    path: str
    length: int


@dataclass
class Files(ds.InputPartition):
    files: tuple[Listed, ...]


def packed(files: Iterable[Listed], most: int) -> list[Files]:
    """Files in order, packed into partitions of ``most`` bytes; a larger file is one by itself."""
    out, now, size = [], [], 0
    for f in files:
        if now and size + f.length > most:
            out.append(Files(tuple(now)))
            now, size = [], 0
        now.append(f)
        size += f.length
    return [*out, Files(tuple(now))] if now else out


class DocumentSource(ds.DataSource):
    """Pages of files: (path, modified, length, page_index, text, error). Override ``name``, ``suffixes`` and ``pages``."""

    #: Endings of the files that are read; none: all files.
    suffixes: tuple[str, ...] = ()

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "path string, modified timestamp, length long, page_index int, text string, error string"

    def pages(self, content: bytes, name: str) -> list[str]:
        """The texts of a file's pages, in order."""
        return [content.decode("utf-8", "replace")]

    def reader(self, schema) -> ds.DataSourceReader:
        return _Reader(self)

    def streamReader(self, schema) -> ds.DataSourceStreamReader:
        return _StreamReader(self)

    def option(self, name: str, default):
        """An option's value as the default's type; names are the same in any case."""
        given = {k.lower(): v for k, v in self.options.items()}
        return type(default)(given.get(name.lower(), default))

    def listing(self) -> list[Listed]:
        folder = self.options["path"]
        system, where = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        found = system.get_file_info(fs.FileSelector(where, recursive=True))
        hidden = lambda path: any(p.startswith(("_", ".")) for p in posixpath.relpath(path, where).split("/"))
        return sorted(Listed(f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(self.suffixes or ("",)) and not hidden(f.path))

    def rows(self, files: Iterable[Listed]) -> Iterator[tuple]:
        import datetime

        folder = self.options["path"]
        system = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
        for f in files:
            changed = datetime.datetime.fromtimestamp(f.modified / 1e9, datetime.UTC)
            try:
                with system.open_input_stream(f.path) as stream:
                    texts = self.pages(stream.read(), f.path.rsplit("/", 1)[-1])
            except Exception as e:
                yield f.path, changed, f.length, None, None, f"{type(e).__name__}: {e}"
                continue
            for k, text in enumerate(texts):
                yield f.path, changed, f.length, k, text, None


class _Reader(ds.DataSourceReader):
    def __init__(self, source: DocumentSource):
        self.source, self.tests = source, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column in ("path", "length") and len(f.attribute) == 1 and type(f) in _COMPARE:
                self.tests.append((column, type(f), f.value))
            elif not (isinstance(f, ds.IsNotNull) and column in ("path", "length")):
                yield f

    def partitions(self) -> list[Files]:
        kept = [f for f in self.source.listing() if all(_COMPARE[kind](getattr(f, column), value) for column, kind, value in self.tests)]
        return packed(kept, self.source.option("partitionBytes", 64 << 20)) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.source.rows(partition.files)


class _StreamReader(ds.DataSourceStreamReader):
    """An offset is the last file taken, as [time of change, path]."""

    def __init__(self, source: DocumentSource):
        self.source, self.last = source, None

    def initialOffset(self) -> dict:
        return {"after": [-1, ""]}

    def latestOffset(self) -> dict:
        start = tuple(self.last or self.initialOffset()["after"])
        new = [f for f in self.source.listing() if (f.modified, f.path) > start]
        most = self.source.option("maxFilesPerTrigger", 1000)
        self.last = [new[:most][-1].modified, new[:most][-1].path] if new else list(start)
        return {"after": self.last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = tuple(start["after"]), tuple(end["after"])
        self.last = max(list(high), self.last or [-1, ""])
        new = [f for f in self.source.listing() if low < (f.modified, f.path) <= high]
        return packed(new, self.source.option("partitionBytes", 64 << 20)) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.source.rows(partition.files)

    def commit(self, end: dict) -> None:
        """Nothing to clean up: files stay where they are."""


class Chapters(DocumentSource):
    """Plain text whose pages are parted by form feeds."""

    suffixes = (".txt", ".text")

    @classmethod
    def name(cls) -> str:
        return "chapters"

    def pages(self, content: bytes, name: str) -> list[str]:
        return content.decode("utf-8", "replace").replace("\r\n", "\n").split("\f")


class Records(DocumentSource):
    """JSON lines, a page each; ``field`` (option) names the text."""

    suffixes = (".jsonl",)

    @classmethod
    def name(cls) -> str:
        return "records"

    def pages(self, content: bytes, name: str) -> list[str]:
        return [str(json.loads(line).get(self.option("field", "text")) or "") for line in content.decode("utf-8", "replace").splitlines() if line.strip()]
