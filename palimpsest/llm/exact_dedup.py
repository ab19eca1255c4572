"""Exact dedup: Grace hash deduplication over complete contents.

Every task first folds its own rows in an open-addressing table that compares whole texts
(a pre-aggregation: a group of copies, however large, leaves each task as a few rows).
The survivors are shuffled by SHA-256 and folded again, by the same table. A table takes
``table_bytes`` of text; when more comes, its records go to spill files, partitioned by
further bits of the hash, and each file is folded in turn, recursively. Copies that no
further bits can part (one text) need one slot, so recursion always ends.

Of equal texts the row with the largest doc_id stays. Defined results: null text counts as
the empty text and equals it; null doc_id sorts before all others; rows that repeat both
doc_id and text count in the group's size, and ``deduplicate`` returns one of them; an
empty table gives an empty table; further columns travel with their row in ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C

_LEAST = -(2**63)
_FAN = 16


class ContentTable:
    """Open addressing with linear probing; a slot holds (hash, id, count, text, row)."""

    def __init__(self) -> None:
        self.slots: list = [None] * 1024
        self.used = 0
        self.bytes = 0

    def add(self, h: bytes, doc_id: int, count: int, text: bytes, row) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(h[8:16], "little") & mask
        while (slot := self.slots[at]) is not None:
            if slot[0] == h and slot[3] == text:
                slot[2] += count
                if doc_id > slot[1]:
                    slot[1], slot[4] = doc_id, row
                return
            at = (at + 1) & mask
        self.slots[at] = [h, doc_id, count, text, row]
        self.used += 1
        self.bytes += len(text) + 200
        if self.used * 3 > len(self.slots) * 2:
            self._grow()

    def _grow(self) -> None:
        old, self.slots = self.slots, [None] * (len(self.slots) * 4)
        mask = len(self.slots) - 1
        for slot in old:
            if slot is not None:
                at = int.from_bytes(slot[0][8:16], "little") & mask
                while self.slots[at] is not None:
                    at = (at + 1) & mask
                self.slots[at] = slot

    def __iter__(self) -> Iterator[list]:
        return (s for s in self.slots if s is not None)


def grace(records: Iterator[tuple], table_bytes: int, level: int = 0) -> Iterator[list]:
    """Fold (hash, id, count, text, row) records; one slot for each distinct text.

    Once the table is full, texts that it holds still fold into it, and others go to one of
    ``_FAN`` spill files by four more bits of their hash."""
    table, files = ContentTable(), None
    for r in records:
        if files is None and table.bytes < table_bytes:
            table.add(*r)
            continue
        if files is None:
            files = [tempfile.TemporaryFile() for _ in range(_FAN)]
            held = {s[0] for s in table}
        if r[0] in held:
            table.add(*r)  # the table compares contents; an unequal text takes a slot of its own
        else:
            pickle.dump(r, files[(r[0][level // 2] >> (4 * (level % 2))) & 15], protocol=5)
    yield from table
    if files is None:
        return
    del table
    for f in files:
        f.seek(0)

        def read(f=f):
            try:
                while True:
                    yield pickle.load(f)
            except EOFError:
                f.close()

        yield from grace(read(), table_bytes, level + 1)


def fold_groups(docs: DataFrame, carry: bool = False, table_bytes: int = 64 << 20) -> DataFrame:
    """One row for each distinct text: (h, keep_id, n, text), and with ``carry`` the kept row's
    other columns as the struct ``row``."""
    others = [F.col(f"`{c}`").alias(f"c{k + 1}") for k, c in enumerate(c for c in docs.columns if c != "text")] if carry else []
    d = docs.select(
        F.coalesce("doc_id", F.lit(_LEAST)).alias("keep_id"), F.lit(1).cast("long").alias("n"), F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        F.struct(F.col("text").isNull().alias("null_text"), F.struct(F.lit(0).alias("c0"), *others).alias("others")).alias("row"),
    )
    if not carry:
        d = d.drop("row")
    schema = T.StructType([T.StructField("h", T.BinaryType()), *d.schema.fields])
    arrow = to_arrow_schema(schema)

    def records(batches, hashed):
        for whole in batches:
            for b in C.slices(whole, "text", 8 << 20):
                texts = b["text"].to_pylist()
                hashes = b["h"].to_pylist() if hashed else [hashlib.sha256(t).digest() for t in texts]
                rows = b["row"].to_pylist() if carry else [None] * b.num_rows
                yield from zip(hashes, b["keep_id"].to_pylist(), b["n"].to_pylist(), texts, rows, strict=True)

    def fold(hashed):
        def run(batches):
            out, size = [], 0
            for s in grace(records(batches, hashed), table_bytes):
                out.append(s)
                size += len(s[3])
                if size > 8 << 20 or len(out) >= 10_000:
                    yield arrays(out)
                    out, size = [], 0
            if out:
                yield arrays(out)

        return run

    def arrays(out):
        h, ids, n, texts, rows = zip(*out, strict=True)
        cols = {"h": h, "keep_id": ids, "n": n, "text": texts, "row": rows}
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    local = d.mapInArrow(C.lean(fold(False)), schema)
    return local.repartition(C.part_count(docs), "h").mapInArrow(C.lean(fold(True)), schema)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``, all columns unchanged."""
    g = fold_groups(docs, carry=True)
    text = F.when(~F.col("row.null_text"), F.col("text").cast("string"))
    others = iter(range(1, len(docs.columns)))  # by place: names may clash
    kept = [text.alias("text") if c == "text" else F.col("row.others").getField(f"c{next(others)}").alias(c) for c in docs.columns]
    return g.select(*kept)


def memberships(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``."""
    # groups of one need no lookup: only repeated texts are sent to the join
    groups = fold_groups(docs).filter("n > 1").select("h", "keep_id", "n")
    d = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.nullif("keep_id", F.lit(_LEAST)))
    return d.join(groups.hint("merge"), "h", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("h")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships(C.documents(spark, sf_dir))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
