"""Shared ground of the training-data operators.

* shared scratch tables in the folder named by ``spark.checkpoint.dir``;
* numpy views of Arrow text columns, word boundaries and 64-bit word hashes;
* compact blobs of numpy columns, so that a shuffle moves few large rows.
"""

from __future__ import annotations

import atexit
import ctypes
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    # Large arrays go back to the system when they are freed: Python workers live on from task to task,
    # and what they keep counts against the executor.
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, 6 << 20)  # M_MMAP_THRESHOLD
    _libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
except (OSError, AttributeError):  # another C library: nothing to set
    _libc = None


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def lean(task: Callable) -> Callable:
    """``task`` (a function of an iterator of batches), after which freed memory goes back to the system:
    idle Python workers then hold little more than their modules."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            _give_back()

    return run


#: The bytes that separate words: space and 0x09-0x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII capitals to small letters, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB unless the session says otherwise: rows may be long, Python workers are small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(4 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, removed when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = getattr(spark, "_own_scratch", None) or tempfile.mkdtemp(prefix="palimpsest-")
        spark._own_scratch = root
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already when the driver ends
            pass

    atexit.register(remove)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int, name: str) -> DataFrame:
    """As ``materialise``, as a table in buckets by ``column``: joins on it shuffle only their other side."""
    spark, table = df.sparkSession, f"palimpsest_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).sortBy(column).option("path", scratch(spark, name)).saveAsTable(table)

    def drop() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the session may be gone already when the driver ends
            pass

    atexit.register(drop)
    return spark.table(table)


def in_buckets(spark: SparkSession, parts: int) -> tuple[int, int]:
    """(parts, buckets): at least ``parts``, a multiple of the buckets, of which there are no more than Spark allows.

    What ``bucket_of`` deals to a part is then of one bucket, which several parts' files make up."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    each = -(-parts // most)
    buckets = -(-parts // each)
    return buckets * each, buckets


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that Spark gives each 64-bit integer: its Murmur3 hash with seed 42, modulo ``buckets``."""
    turn = lambda x, k: (x << np.uint32(k)) | (x >> np.uint32(32 - k))
    h = np.full(len(ids), 42, np.uint32)
    for half in (ids.view(np.uint64).astype(np.uint32), (ids.view(np.uint64) >> np.uint64(32)).astype(np.uint32)):
        h ^= turn(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    h ^= h >> np.uint32(16)
    return (h.view(np.int32) % buckets).astype(np.int32)


def part_count(df: DataFrame, bytes_per_part: int = 48 << 20) -> int:
    """Partitions for an exchange: the session's setting, or more if the input's size asks for it."""
    spark = df.sparkSession
    bound_batches(spark)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # unknown
        size = 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_per_part), 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column on end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with about ``max_bytes`` of text each, one row at least."""
    _, o = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(o, o[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def byte_codes(data: np.ndarray) -> np.ndarray:
    """A random 64-bit code for each byte."""
    return _BYTE_CODES[data]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums over bytes; ``span_hash`` takes hashes of spans from them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    codes = _BYTE_CODES[data]
    codes *= up[:-1]
    np.cumsum(codes, out=out[1:])
    return out


def code_sums(codes: np.ndarray) -> np.ndarray:
    """As ``prefix_sums``, over given codes."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and n + 1 offsets of documents among the words."""
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(WHITE[data], out=word[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside, before, after = word[1:-1], word[:-2], word[2:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k values from each place on (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0x9FB21C651E98DF25) + h[j : j + n]
    return mix(acc)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The document of each unit, from offsets of documents among the units."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ids_of(column: pa.Array) -> np.ndarray:
    """Document ids as int64; null counts as the least."""
    return column.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes; integers go as byte planes, which compress well when sorted or small."""
    out = [struct.pack("<q", len(columns[0]))]
    for c in columns:
        out.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() if len(c) else b"")
    return b"".join(out)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<q", blob)
    out, at = [], 8
    for kind in map(np.dtype, kinds):
        plane = np.frombuffer(blob, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, with the length at the end."""
    n = len(sorted_values)
    if n == 0:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [n]])


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting: several times as fast here as numpy's own, which hashes first."""
    s = np.sort(x)
    return s[np.concatenate([np.ones(min(len(s), 1), bool), s[1:] != s[:-1]])]


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each hash: by its high 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def spread(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, blob) for each part that has rows; rows keep their order within a part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = [c[order] for c in columns]
    edges = runs(part)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[a]), pack(*(c[a:b] for c in columns))


def keep_rows(docs: DataFrame, run: Callable) -> DataFrame:
    """``run`` over Arrow batches of all columns of ``docs``, whatever their names; all but doc_id and text go by number."""
    plain = docs.toDF(*(c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)))
    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)


BLOB = "part int, blob binary"
_BLOB_ARROW = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_BLOB_ARROW)


def exchange(blobs: DataFrame, parts: int, reduce: Callable[[list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Send blobs to their parts, one task for each, and apply ``reduce`` to all blobs of a task."""

    def whole(batches):
        gathered = [x for b in batches for x in b.column("blob").to_pylist()]
        if gathered:
            yield from reduce(gathered)

    return blobs.repartitionById(parts, F.col("part")).mapInArrow(lean(whole), schema)


def batch(schema: str, **columns) -> pa.RecordBatch:
    """An Arrow batch for a flat schema such as ``'doc_id long, n int'``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[n], pa.Array) and c.type == kinds[t] else pa.array(c, kinds[t]) for n, t in fields], names=[n for n, _ in fields])
