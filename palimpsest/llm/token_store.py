"""Token-ID output: one wavelet matrix file a shard, readable without unpacking the whole.

Documents are range-partitioned by doc_id, so shards hold ascending ids and the number of a
task orders its shards. A task tokenises its documents, appends the end id to each, and
writes a file for every ``shard_tokens`` tokens at most. Repeated words are encoded once a
block: texts are cut before single spaces between visible characters, where byte-level BPE
always cuts too, and the distinct pieces are encoded together.

File (little endian): ``PWM1``; header of int64: bit planes, tokens, documents; document ids
and lengths (zstd); then, for each plane from the highest bit on: number of zeros, number of
blocks, a directory of (offset, size, ones before) and blocks of 2**19 bits, zstd-compressed.
Every plane stably sorts the sequence by its bit, zeros first: rank and select on the planes
give ``access``, ``rank``/``count`` and ``select`` (occurrence lookup) by reading single blocks.

Files are written under a temporary name and renamed, so a repeated task leaves one whole
file. Paths may be any URI that pyarrow.fs can open.

Defined results: null or empty text is the end id alone; documents that share an id stand
side by side, ordered by text; a null id sorts first; other columns are ignored; an empty
table writes no file and gives no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

_BLOCK_BYTES = 1 << 16
_OPEN = np.zeros(256, bool)  # bytes beside which a single space is surely a token border
_OPEN[0x21:0x7F] = True
_WIDE_SPACE = {0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}  # first bytes of Unicode spaces


class WaveletMatrix:
    """A sequence of small integers as bit planes with rank and select."""

    def __init__(self, n: int, zeros: list[int], read_block, ones_before: list[np.ndarray]) -> None:
        self.n, self.zeros, self._read, self._ones_before = n, zeros, read_block, ones_before
        self.bits = len(zeros)
        self._cache: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def planes(values: np.ndarray, bits: int):
        """(zeros, bits packed in bytes) of each plane, highest first."""
        for k in range(bits - 1, -1, -1):
            one = (values & values.dtype.type(1 << k)) != 0
            yield len(values) - int(np.count_nonzero(one)), np.packbits(one, bitorder="little")
            values = np.concatenate([np.compress(~one, values), np.compress(one, values)])

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        if (plane, block) not in self._cache:
            if len(self._cache) > 64:
                self._cache.clear()
            raw = self._read(plane, block)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(raw), dtype=np.int64)])
            self._cache[plane, block] = raw, counts
        return self._cache[plane, block]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of the plane."""
        block, byte = divmod(i >> 3, _BLOCK_BYTES)
        if block >= len(self._ones_before[plane]):
            return self.n - self.zeros[plane]
        raw, counts = self._block(plane, block)
        ones = int(self._ones_before[plane][block] + counts[byte])
        return ones + (int(raw[byte] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.bits):
            before, after = self._rank1(p, i), self._rank1(p, i + 1)
            bit = after - before
            value = value << 1 | bit
            i = self.zeros[p] + before if bit else i - before
        return value

    def rank(self, value: int, end: int) -> int:
        """How often ``value`` occurs in the first ``end`` places."""
        a, b = 0, end
        for p in range(self.bits):
            ra, rb = self._rank1(p, a), self._rank1(p, b)
            a, b = (self.zeros[p] + ra, self.zeros[p] + rb) if value >> (self.bits - 1 - p) & 1 else (a - ra, b - rb)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of ``value``, or -1."""
        if not 0 <= k < self.count(value):
            return -1
        a = 0
        for p in range(self.bits):
            r = self._rank1(p, a)
            a = self.zeros[p] + r if value >> (self.bits - 1 - p) & 1 else a - r
        i = a + k
        for p in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - p) & 1
            want = i - self.zeros[p] if one else i  # the place of the want-th one or zero of the plane
            lo, hi = 0, self.n
            while lo < hi:
                mid = (lo + hi) // 2
                ones = self._rank1(p, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    hi = mid
                else:
                    lo = mid + 1
            i = lo
        return i

    def decode(self) -> np.ndarray:
        """The whole sequence."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            raw = np.concatenate([self._read(p, b) for b in range(len(self._ones_before[p]))]) if self.n else np.zeros(0, np.uint8)
            one = np.unpackbits(raw, count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[np.flatnonzero(~one)] = values[: self.zeros[p]]
            back[np.flatnonzero(one)] = values[self.zeros[p] :] | kind(1 << (self.bits - 1 - p))
            values = back
        return values


def to_file_bytes(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, bits: int) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out = [b"PWM1", struct.pack("<qqq", bits, len(ids), len(doc_ids))]
    for column in (doc_ids, lengths):
        z = squeeze(C.pack(column.astype(np.int64)))
        out += [struct.pack("<q", len(z)), z]
    for zeros, raw in WaveletMatrix.planes(ids.astype(np.uint16 if bits <= 16 else np.uint32), bits):
        blocks = [raw[a : a + _BLOCK_BYTES] for a in range(0, len(raw), _BLOCK_BYTES)]
        stored = [squeeze(b.tobytes()) for b in blocks]
        sizes = np.array([len(s) for s in stored], np.int64)
        ones = np.array([int(np.bitwise_count(b).sum()) for b in blocks], np.int64)
        directory = np.column_stack([np.cumsum(sizes) - sizes, sizes, np.cumsum(ones) - ones]).astype("<i8") if len(blocks) else np.zeros((0, 3), "<i8")
        out += [struct.pack("<qqq", zeros, len(blocks), int(sizes.sum())), directory.tobytes(), *stored]
    return b"".join(out)


class ShardFile:
    """Random access to one file; only directories are read at once."""

    def __init__(self, path: str) -> None:
        system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self._file = system.open_input_file(where)
        if self._file.read_at(4, 0) != b"PWM1":
            raise ValueError(f"not a token file: {path}")
        bits, n, docs = struct.unpack("<qqq", self._file.read_at(24, 4))
        at, columns = 28, []
        expand = zstandard.ZstdDecompressor()
        for _ in range(2):
            (size,) = struct.unpack("<q", self._file.read_at(8, at))
            columns.append(C.unpack(expand.decompress(self._file.read_at(size, at + 8)), np.int64)[0])
            at += 8 + size
        self.doc_ids, self.lengths = columns
        zeros, directories, base = [], [], []
        for _ in range(bits):
            z, blocks, size = struct.unpack("<qqq", self._file.read_at(24, at))
            directories.append(np.frombuffer(self._file.read_at(24 * blocks, at + 24), "<i8").reshape(blocks, 3))
            zeros.append(z)
            base.append(at + 24 + 24 * blocks)
            at = base[-1] + size

        def block(plane: int, k: int) -> np.ndarray:
            offset, size, _ = directories[plane][k].tolist()
            return np.frombuffer(expand.decompress(self._file.read_at(size, base[plane] + offset)), np.uint8)

        self.matrix = WaveletMatrix(n, zeros, block, [d[:, 2] for d in directories])

    def document(self, k: int) -> list[int]:
        """The ids of the file's k-th document."""
        start = int(self.lengths[:k].sum())
        return [self.matrix.access(i) for i in range(start, start + int(self.lengths[k]))]


def write_file(path: str, data: bytes) -> None:
    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    system.create_dir(os.path.dirname(where), recursive=True)
    own = f"{where}.{os.getpid()}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
    with system.open_output_stream(own) as f:
        f.write(data)
    system.move(own, where)


class PieceCache:
    """Ids of pieces seen before in this process, by 128 bits of hash, in a few arrays; at most ``most`` pieces."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.most = most
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each piece, or -1."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def add(self, key: np.ndarray, check: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        """Pieces with their ids on end."""
        if len(self.key) >= self.most or not len(key):
            return
        start = np.cumsum(count) - count + len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        order = np.argsort(key)
        at = np.searchsorted(self.key, key[order])
        self.key = np.insert(self.key, at, key[order])
        self.check, self.start, self.count = (np.insert(old, at, new[order]) for old, new in ((self.check, check), (self.start, start), (self.count, count)))


_SECOND = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 256, dtype=np.uint64)


class BlockEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct piece once."""

    def __init__(self, tokenizer_file: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.end_id = end_id
        self.cache = PieceCache()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bits = max(max(vocabulary.values()), end_id, 1).bit_length()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token: byte-level tokens have a letter a byte
        for token, i in vocabulary.items():
            self.width[i] = len(token)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where texts are cut: before single spaces between visible bytes, and at their ends; which bytes are visible."""
        is_open = _OPEN.copy()
        if not any(np.isin(data[1:][data[:-1] == a], b).any() for a, b in _WIDE_SPACE.items()):
            is_open[0x80:] = True
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            cut[1:-2] = (data[1:-1] == 0x20) & is_open[data[:-2]] & is_open[data[2:]]
        cut[offsets] = True
        return np.flatnonzero(cut).astype(np.int32), is_open

    def _encode_new(self, words: pa.Array, is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and all ids on end."""
        raw, wo = C.text_bytes(words)
        lengths, counts = np.diff(wo), np.zeros(len(words), np.int64)
        # together: pieces that start with the space before a visible byte and end in a visible byte
        second = raw[np.minimum(wo[:-1] + 1, len(raw) - 1)]
        joined = (raw[wo[:-1]] == 0x20) & (lengths > 1) & is_open[second] & is_open[raw[wo[1:] - 1]]
        together, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        parts = []
        for a in range(0, len(together), 20_000):
            some = together[a : a + 20_000]
            text = "".join(words.take(pa.array(some)).to_pylist())
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(lengths[some])) + 1
            counts[some] = np.diff(ends, prepend=0)
            parts.append(ids)
        for a in range(0, len(alone), 20_000):
            some = alone[a : a + 20_000]
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words.take(pa.array(some)).to_pylist(), add_special_tokens=False)]
            counts[some] = [len(x) for x in got]
            parts += got
        # back to the order of the pieces
        order = np.concatenate([together, alone])
        start = np.empty(len(words), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        flat = np.concatenate(parts)
        return counts, flat[np.arange(len(flat)) + np.repeat(start - (np.cumsum(counts) - counts), counts)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, the end id after each, and the number of each text's ids."""
        edges, is_open = self._pieces(data, offsets)
        pieces = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data)) if len(edges) > 1 else pa.array([], pa.string())
        coded = pieces.dictionary_encode()
        words = coded.dictionary
        raw, wo = C.text_bytes(words)
        key, check = (C.span_hash(sums, wo[:-1], wo[1:]) for sums in (C.prefix_sums(raw), C.code_sums(_SECOND[raw])))
        entry = self.cache.find(key, check)
        new = np.flatnonzero(entry < 0)
        count, start = np.empty(len(words) + 1, np.int64), np.empty(len(words) + 1, np.int64)
        old = np.flatnonzero(entry >= 0)
        count[old], start[old] = self.cache.count[entry[old]], self.cache.start[entry[old]]
        held, flat = self.cache.flat, np.zeros(0, np.uint32)
        if len(new):
            counts, flat = self._encode_new(words.take(pa.array(new)), is_open)
            count[new], start[new] = counts, np.cumsum(counts) - counts + len(held)
            self.cache.add(key[new], check[new], counts, flat)
        flat = np.concatenate([held, flat, np.array([self.end_id], np.uint32)])
        count[-1], start[-1] = 1, len(flat) - 1
        # the piece list of each text, and the end piece after it
        index = np.insert(coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(edges, offsets[1:]), len(words))
        size = count[index]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((start[index] - (ends - size)).astype(np.int32), size)
        return flat[at], np.diff(ends[index == len(words)], prepend=0)


@lru_cache(maxsize=2)
def encoder_for(tokenizer_file: str, end_id: int) -> BlockEncoder:
    """One encoder a process: tasks of the same worker share it and its cache."""
    return BlockEncoder(tokenizer_file, end_id)


_MANIFEST = "task long, sequence long, path string, documents long, tokens long"


def write_shards(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 2, shard_tokens: int = 16 << 20) -> DataFrame:
    """Write token files in ascending doc_id order; the manifest, one row for each file."""

    def run(batches):
        encoder = encoder_for(tokenizer_file, end_id)
        task, sequence = TaskContext.get().partitionId(), 0
        ids, doc_ids, lengths, held = [], [], [], 0
        kind = np.uint16 if encoder.bits <= 16 else np.uint32

        def flush():
            nonlocal ids, doc_ids, lengths, held, sequence
            path = f"{folder}/shard-{task:08d}-{sequence:05d}.pwm"
            write_file(path, to_file_bytes(np.concatenate(ids), np.concatenate(doc_ids), np.concatenate(lengths), encoder.bits))
            row = C.batch(_MANIFEST, task=[task], sequence=[sequence], path=[path], documents=[sum(map(len, doc_ids))], tokens=[held])
            ids, doc_ids, lengths, held, sequence = [], [], [], 0, sequence + 1
            return row

        for whole in batches:
            for b in C.slices(whole, "text", 16 << 20):
                got, n = encoder.encode(*C.text_bytes(b["text"]))
                ids.append(got.astype(kind))
                doc_ids.append(C.ids_of(b["doc_id"]))
                lengths.append(n)
                held += len(got)
                if held >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    placed = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(C.part_count(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return placed.mapInArrow(C.lean(run), _MANIFEST)


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files."""
    # where each file's first token stands among all: one window over a few numbers a file, each of some 10**7 tokens
    before = F.sum("tokens").over(Window.orderBy("task", "sequence")) - F.col("tokens")
    placed = manifest.select("path", before.cast("long").alias("start"), (F.row_number().over(Window.orderBy("task", "sequence")) - 1).alias("number"))
    files = min(max(manifest.count(), 1), 10_000)
    listed = placed.repartitionById(files, F.pmod("number", F.lit(files)).cast("int")).select("path", "start")

    def run(batches):
        for b in batches:
            for path, start in zip(b["path"].to_pylist(), b["start"].to_pylist(), strict=True):
                shard = ShardFile(path)
                ids = shard.matrix.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * e]) for a, e in zip((ends - shard.lengths).tolist(), ends.tolist(), strict=True)]
                yield C.batch(_READ, doc_id=pa.array(shard.doc_ids, mask=shard.doc_ids == -(2**63)), start=start + ends - shard.lengths, n_tokens=shard.lengths, ids_crc32=crc)

    return listed.mapInArrow(C.lean(run), _READ)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_wavelet_tokens(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    folder = C.scratch(spark, "token-files")
    manifest = C.materialise(write_shards(C.documents(spark, sf_dir), folder, tokenizer_file or default_tokenizer()), "token-manifest")
    return read_documents(manifest)
