"""Vector code compression: product quantisation whose nearest entries are found by annular norm pruning.

A vector's components become integers ``floor(4096 * x)`` and are cut into equal consecutive parts. Each part
position has a codebook: at first the parts of the least vec_ids, then six rounds of assigning every part to its
nearest entry and moving each entry to the floored mean of its parts. All arithmetic on components is exact.

*Search.* Entries are sorted by norm. A part of norm r at a distance D from some entry can only be closer to (or as
close to) entries with norms in [r - D, r + D]; that annulus is found by binary search, both ends included and
widened by far more than rounding could shift them, and only its entries are evaluated exactly. The best distance so
far narrows the annulus from step to step; ties go to the lower index.

*Scale.* A round is one pass over the table, whose tasks send their counts and sums by entry (a thousand numbers each,
in limbs of 40 bits, so that no total overflows). The driver holds the codebooks, ``entries`` whole vectors, and nothing
that grows with the rows. Errors by label are pre-aggregated; the result is written once and joined to the labels'
totals, which Spark broadcasts only when they are small and otherwise joins with large partitions split.

Defined results: rows with a null vector, no component, or a null or non-finite component are dropped, and so are
vectors of another length than the most common one (of equally common ones the shorter); a length that the number of
parts does not divide is filled up with zeros at the end. A null vec_id counts as the greatest; of equal vec_ids the
lesser vector comes first, and every repeated row has its row in the result. With fewer rows than entries, codebooks
have as many entries as there are rows. An error beyond a long is the greatest long. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCALE = 4096
_LIMB = 40
_MOST = 2**63 - 1


def whole(x: float) -> int:
    """floor(4096 * x) of any finite number."""
    return int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE)


def integers(flat: np.ndarray, rows: int, parts: int, width: int) -> np.ndarray:
    """Components as (rows, parts, width) integers; Python's own where 64 bits could be too few."""
    flat = flat.astype(np.float64).reshape(rows, -1)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    if parts * width * (2 * np.abs(scaled).max(initial=0.0)) ** 2 >= 2.0**62:
        scaled = np.array([whole(v) for v in flat.ravel().tolist()], object).reshape(flat.shape)
    else:
        scaled = scaled.astype(np.int64)
    short = parts * width - flat.shape[1]
    if short:
        scaled = np.concatenate([scaled, np.zeros((rows, short), scaled.dtype)], axis=1)
    return scaled.reshape(rows, parts, width)


class Codebook:
    """The entries of one part position, in their order and sorted by norm."""

    def __init__(self, entries: list[list[int]]):
        self.entries = entries
        flat = [v for e in entries for v in e]
        self.largest = max(map(abs, flat), default=0)
        if self.largest < 2**31:
            own = np.array(entries, np.int64).reshape(len(entries), -1)
            norms = np.sqrt((own.astype(np.float64) ** 2).sum(axis=1))
            self.index = np.argsort(norms, kind="stable")
            self.norms, self.sorted = norms[self.index], own[self.index]

    def nearest(self, x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` the index of its nearest entry and their squared distance."""
        if x.dtype == object or parts * x.shape[1] * (float(np.abs(x).max(initial=0)) + self.largest) ** 2 >= 2.0**62:
            return self._plain(x)
        k, n = len(self.norms), len(x)
        r = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        slack = 1e-9 * (r + self.norms[-1] + 1)
        first = np.minimum(np.searchsorted(self.norms, r), k - 1)
        lower = np.maximum(first - 1, 0)
        first = np.where(r - self.norms[lower] < np.abs(self.norms[first] - r), lower, first)
        best = ((x - self.sorted[first]) ** 2).sum(axis=1)
        index = self.index[first]

        def annulus(r, best, slack):
            reach = np.sqrt(best.astype(np.float64)) + slack
            return np.searchsorted(self.norms, r - reach, "left"), np.searchsorted(self.norms, r + reach, "right")

        low, high = annulus(r, best, slack)
        live = np.arange(n)
        for step in range(1, k):
            live = live[(first[live] + step < high[live]) | (first[live] - step >= low[live])]
            if not len(live):
                break
            for place in (first[live] + step, first[live] - step):
                inside = (place >= low[live]) & (place < high[live])
                rows, at = live[inside], place[inside]
                if not len(rows):
                    continue
                d = ((x[rows] - self.sorted[at]) ** 2).sum(axis=1)
                won = (d < best[rows]) | ((d == best[rows]) & (self.index[at] < index[rows]))
                rows, at, d = rows[won], at[won], d[won]
                best[rows], index[rows] = d, self.index[at]
                low[rows], high[rows] = annulus(r[rows], d, slack[rows])
        return index, best

    def _plain(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every entry, in integers of any size: for numbers whose squares leave 64 bits."""
        found = [min((sum((a - b) ** 2 for a, b in zip(row, e, strict=True)), i) for i, e in enumerate(self.entries)) for row in x.tolist()]
        return np.array([i for _, i in found], np.int64), np.array([d for d, _ in found], object)


def kept(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The rows that are encoded, as (vec_id, v, label), and the length of their vectors."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good).select("vec_id", F.col("embedding").alias("v"), "label")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    length = common[0]["d"] if common else 0
    return rows.filter(F.size("v") == length), length


def _matrix(b: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    return integers(b["v"].flatten().to_numpy(zero_copy_only=False), b.num_rows, parts, width)


def learn(rows: DataFrame, length: int, parts: int = 8, entries: int = 16, rounds: int = 6) -> list[Codebook]:
    """Codebooks of ``rows`` (vec_id, v), one a part position."""
    width = -(-length // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return []
    start = integers(np.array([r["v"] for r in first], np.float64), len(first), parts, width)
    books = [Codebook([list(map(int, e)) for e in start[:, p]]) for p in range(parts)]
    for _ in range(rounds):
        books = _moved(rows, books, parts, width)
    return books


def _moved(rows: DataFrame, books: list[Codebook], parts: int, width: int) -> list[Codebook]:
    k = len(books[0].entries)

    def add_up(batches):
        counts = np.zeros((parts, k), np.int64)
        sums = np.zeros((parts, k, width), object)
        for b in batches:
            x = _matrix(b, parts, width)
            for p in range(parts):
                index, _ = books[p].nearest(x[:, p], parts)
                counts[p] += np.bincount(index, minlength=k)
                part = np.zeros((k, width), x.dtype)
                np.add.at(part, index, x[:, p])
                sums[p] += part.astype(object)
        out = []
        for slot in np.flatnonzero(counts):
            out.append((int(slot), -1, 0, int(counts.flat[slot])))
            for j, v in enumerate(sums.reshape(-1, width)[slot]):
                v, limb = int(v), 0
                while not -(1 << (_LIMB - 1)) <= v < 1 << (_LIMB - 1):
                    out.append((int(slot), j, limb, v & ((1 << _LIMB) - 1)))
                    v, limb = v >> _LIMB, limb + 1
                out.append((int(slot), j, limb, v))
        slot, j, limb, v = zip(*out, strict=True) if out else ([], [], [], [])
        yield C.batch("slot int, j int, limb int, v long", slot=slot, j=j, limb=limb, v=v)

    # a number for each entry, component and limb: as many as the codebooks have, however many rows there are
    sums = rows.select("v").mapInArrow(C.lean(add_up), "slot int, j int, limb int, v long").groupBy("slot", "j", "limb").agg(F.sum("v").alias("v"))
    count, total = {}, {}
    for r in sums.collect():
        if r["j"] < 0:
            count[r["slot"]] = r["v"]
        else:
            total[r["slot"], r["j"]] = total.get((r["slot"], r["j"]), 0) + (r["v"] << (_LIMB * r["limb"]))
    moved = lambda p, e: [total[p * k + e, j] // count[p * k + e] for j in range(width)] if p * k + e in count else books[p].entries[e]
    return [Codebook([moved(p, e) for e in range(k)]) for p in range(parts)]


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all entries' components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b.entries for v in e).encode()).hexdigest()


def encode(rows: DataFrame, books: list[Codebook], length: int) -> DataFrame:
    """(vec_id, label, codes, error): a byte for each part, and the squared distances' sum."""
    parts = len(books)
    width = -(-length // parts) if parts else 0
    ids = rows.schema["vec_id"].dataType.simpleString()
    labels = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, parts, width)
            codes, error = np.empty((b.num_rows, parts), np.uint8), 0
            for p in range(parts):
                index, d = books[p].nearest(x[:, p], parts)
                codes[:, p] = index
                error = error + d
            if error.dtype == object:
                error = np.array([min(int(e), _MOST) for e in error], np.int64)
            blobs = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], blobs, pa.array(error, pa.int64())], names=["vec_id", "label", "codes", "error"])

    return rows.mapInArrow(C.lean(run), f"vec_id {ids}, label {labels}, codes binary, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, list[Codebook]]:
    """The codes of ``vectors`` (vec_id, embedding, label), with ``label_error``, and the codebooks."""
    C.bound_batches(vectors.sparkSession)
    rows, length = kept(vectors)
    books = learn(rows, length, parts, entries, rounds)
    coded = C.materialise(encode(rows, books, length), "vector-codes")
    # a sum of longs can pass a long at a third of all rows: it is taken in decimals
    total = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One common table expression for each assignment and each move."""
    nearest = """a{r} AS MATERIALIZED (SELECT vec_id, p, e, d FROM (SELECT d.*, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS k FROM
  (SELECT x.vec_id, x.p, c.e, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{r} c ON c.p = x.p AND c.j = x.j GROUP BY x.vec_id, x.p, c.e) d) WHERE k = 1)"""
    move = """c{s} AS MATERIALIZED (SELECT c.p, c.e, c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN
  (SELECT a.p, a.e, x.j, (sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{r} a JOIN x ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY a.p, a.e, x.j) m
  ON m.p = c.p AND m.e = c.e AND m.j = c.j)"""
    steps = [nearest.format(r=0)]
    for r in range(rounds):
        steps += [move.format(r=r, s=r + 1), nearest.format(r=r + 1)]
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding, len(embedding) // {parts} AS w, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
x AS MATERIALIZED (SELECT vec_id, rank, (i - 1) // w AS p, (i - 1) % w AS j, CAST(floor(4096 * CAST(v AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, rank, w, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT p, rank AS e, j, x FROM x WHERE rank < {entries}),
{(", " + chr(10)).join(steps)},
book AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS digest FROM c{rounds}),
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', CAST(e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT coded.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM coded JOIN kept ON coded.vec_id = kept.vec_id CROSS JOIN book
"""


ORACLE = _oracle()
