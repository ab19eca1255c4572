"""A keyed, versioned state table: copy on write by buckets, with a ledger of commits.

``merge`` takes new rows by key. Rows are kept in buckets of a hash of ``by``; a merge writes its rows to a folder of its
own. Buckets in which old rows have the same ``by`` (or that lie in many folders) are rewritten, in another folder; to
the others the new rows are added. Then one record goes to the ledger, which says for
every bucket in which folders it lies, and how far each writer has come. The record is renamed into place and never
overwrites another, so a merge counts wholly or not at all: what a crash leaves behind is in folders that no record
names, and readers go by the last record alone. Each merge has a writer's name and a number; one that the ledger has
already seen changes nothing, so a batch that is repeated after a lost answer is written once.

A writer that finds that another one has committed meanwhile starts over from the new state. The ledger is small
(a name for each bucket and writer); the rows are never gathered anywhere.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import CheckpointError

# Fixed value: a bucket in so many folders is rewritten by the next merge that touches it.
MOST_FOLDERS = 16


@dataclass
class Commit:
    version: int = 0
    buckets: dict[str, list[str]] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)
    schema: dict | None = None


class StateTable:
    """Rows by ``key`` at ``path``. ``by`` (part of the key) chooses the bucket.

    ``generation``: a column that tells one content of ``by`` from another: where new rows have another value of it
    than old ones with the same ``by``, the old ones go. Keys of one merge's rows must differ, unless ``latest``
    names columns that order them; then the greatest counts."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], by: list[str], buckets: int = 64, generation: str | None = None, latest: list[str] | None = None):
        if not set(by) <= set(key):
            raise CheckpointError("buckets must depend on the key alone")
        self.spark, self.path, self.key, self.by, self.n, self.generation, self.latest = spark, path.rstrip("/"), key, by, buckets, generation, latest

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, conf, at.getFileSystem(conf)

    def _names(self, folder: str) -> list[str]:
        jvm, _, fs = self._files()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def head(self) -> Commit:
        """The last record of the ledger."""
        names = [n for n in self._names("ledger") if n.endswith(".json")]
        if not names:
            return Commit()
        body = "".join(r["value"] for r in self.spark.read.text(f"{self.path}/ledger/{names[-1]}", wholetext=True).collect())
        found = Commit(**json.loads(body))
        found.buckets = {b: [f] if isinstance(f, str) else f for b, f in found.buckets.items()}  # ledgers of one folder a bucket
        return found

    def _commit(self, commit: Commit) -> bool:
        """Puts a record into the ledger; False if its version is there already."""
        jvm, conf, fs = self._files()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        fs.mkdirs(path("ledger"))
        own, target = path(f"ledger/.{uuid.uuid4().hex}"), path(f"ledger/{commit.version:012d}.json")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps(commit.__dict__).encode()))
        out.close()
        if fs.exists(target):
            fs.delete(own, False)
            return False
        rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        kinds = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            rename.rename(fs.makeQualified(own), fs.makeQualified(target), kinds)
        except Exception as e:
            fs.delete(own, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise CheckpointError(f"cannot commit version {commit.version} of {self.path}") from e
        return True

    def _rows(self, commit: Commit, buckets: list[str] | None = None) -> DataFrame | None:
        """The rows of some buckets (all), or None where there are none."""
        held = [f"{self.path}/data/{folder}/_bucket={b}" for b, folders in sorted(commit.buckets.items()) if buckets is None or b in buckets for folder in folders]
        return self.spark.read.schema(StructType.fromJson(commit.schema)).parquet(*held) if held else None

    def read(self) -> DataFrame | None:
        """The table as of the last commit; None before the first."""
        head = self.head()
        if head.schema is None:
            return None
        rows = self._rows(head)
        return self.spark.createDataFrame([], StructType.fromJson(head.schema)) if rows is None else rows

    def merge(self, news: DataFrame, writer: str, number: int, attempts: int = 5) -> bool:
        """Takes ``news`` in; False if this writer's merge of that number (or a later one) is in already."""
        if self.head().writers.get(writer, -1) >= number:
            return False
        if self.latest:
            news = news.groupBy(*self.key).agg(F.max_by(F.struct(*(F.col(c) for c in news.columns)), F.struct(*self.latest)).alias("_row")).select("_row.*")
        folder = uuid.uuid4().hex
        self._write(news, folder)  # computed once: the rows' buckets say what has to be read
        for _ in range(attempts):
            if (done := self._merged(news.schema, f"{self.path}/data/{folder}", writer, number)) is not None:
                break
        self._drop_unnamed(folder)  # after an error nobody knows whether the record is there: ``vacuum`` does
        if done is None:
            raise CheckpointError(f"other writers were faster {attempts} times in a row: {self.path}")
        return done

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.n)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> None:
        """Rows in buckets, gathered by bucket, or each task would write a file to each."""
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")

    def _drop_unnamed(self, folder: str) -> None:
        if not any(folder in folders for folders in self.head().buckets.values()):
            jvm, _, fs = self._files()
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{folder}"), True)

    def _buckets_in(self, folder: str) -> list[str]:
        return sorted(n.partition("=")[2] for n in self._names(f"data/{folder}") if n.startswith("_bucket="))

    def _same(self, names: list[str]) -> list:
        return [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]

    def _hit(self, head: Commit, news: DataFrame, touched: list[str]) -> set[str]:
        """The buckets in which old and new rows have the same ``by``; no other column is read."""
        old = self._rows(head, touched)
        if old is None:
            return set()
        both = old.select(*self.by).join(news.select(*(F.col(c).alias(f"_{c}") for c in self.by)), self._same(self.by), "left_semi")
        return {str(r[0]) for r in both.select(self._bucket()).distinct().collect()}

    def _staying(self, old: DataFrame, news: DataFrame) -> DataFrame:
        """Old rows that no new one replaces."""
        old = old.join(news.select(*(F.col(c).alias(f"_{c}") for c in self.key)), self._same(self.key), "left_anti")
        if self.generation:
            now = news.select(*(F.col(c).alias(f"_{c}") for c in self.by), F.col(self.generation).alias("_generation")).distinct()
            old = old.join(now, [*self._same(self.by), ~F.col(self.generation).eqNullSafe(F.col("_generation"))], "left_anti")
        return old

    def _merged(self, schema: StructType, staged: str, writer: str, number: int) -> bool | None:
        head, own = self.head(), staged.rpartition("/")[2]
        if head.writers.get(writer, -1) >= number:
            return False
        touched = self._buckets_in(own)
        commit = Commit(head.version + 1, dict(head.buckets), head.writers | {writer: number}, json.loads(schema.json()) if head.schema is None else head.schema)
        if touched:
            read = lambda buckets: self.spark.read.schema(schema).parquet(*(f"{staged}/_bucket={b}" for b in buckets))
            again = self._hit(head, read(touched), touched) | {b for b in touched if len(head.buckets.get(b, [])) >= MOST_FOLDERS}
            if head.schema is not None:
                was = StructType.fromJson(head.schema)
                now = self.spark.createDataFrame([], was).unionByName(self.spark.createDataFrame([], schema), allowMissingColumns=True).schema
                commit.schema = json.loads(now.json())
                if any(now[f.name].dataType != f.dataType for f in was):
                    again = {b for b in touched if b in head.buckets}  # files keep their types
            for b in touched:
                if b not in again:
                    commit.buckets[b] = [*head.buckets.get(b, []), own]
            if again:
                folder = f"{commit.version:012d}-{uuid.uuid4().hex}"
                news = read(sorted(again))
                self._write(self._staying(self._rows(head, sorted(again)), news).unionByName(news, allowMissingColumns=True), folder)
                commit.buckets |= {b: [folder] for b in self._buckets_in(folder)}
        return True if self._commit(commit) else None

    def vacuum(self) -> int:
        """Removes folders that the last record does not name, when no one writes or reads older versions; how many."""
        jvm, _, fs = self._files()
        named = {f for folders in self.head().buckets.values() for f in folders}
        gone = [n for n in self._names("data") if n not in named]
        for n in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{n}"), True)
        return len(gone)


def pages_table(spark: SparkSession, output_dir: str, buckets: int = 64) -> StateTable:
    """The state of a run's pages: one row a page of the content that its file has now."""
    return StateTable(spark, f"{output_dir.rstrip('/')}/pages", ["path", "page_index"], ["path"], buckets, generation="sha256")
