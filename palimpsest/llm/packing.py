"""Best-fit packing of token sequences into bins of several permitted lengths.

Texts are encoded as in ``token_store`` (an end id after each). Sequences longer than the
largest capacity are cut into pieces of that capacity and a rest. Pieces are placed in
descending length: each goes into the open bin whose free space it fills best; if none has
room, a bin is opened. Its size is chosen among all permitted ones together: for each, the
bin is filled in mind with the longest pieces still to be placed that fit, and the size of
least cost for each token so held is taken, at the price of the size that the bin would shrink
to (``cost(c) = overhead + c + c * c / quadratic``: fixed cost, linear layers, attention). In
the end every bin is downsized to the smallest permitted capacity that its contents fit. The
same pieces are also packed with each size as the only one (longer pieces in the next size
that takes them), and the cheapest of these packings is kept, so that mixing sizes never costs
more than the best of them alone.

Encoded texts are written once; a task packs what it reads of them in groups of about
``group_tokens`` tokens, so nothing is shuffled, no id gathers in one place, and a task that is
repeated packs the same. Open bins, and the lengths still to be placed, are indexed by bit
masks: a placement costs no scan of bins.

Defined results: null or empty text is one piece with the end id alone; rows that repeat a
doc_id are packed each; a null doc_id is packed like others; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import token_store

CAPACITIES = (512, 1024, 2048, 4096)
_TOKENS = "doc_id long, n_tokens long, ids binary"
_SCHEMA = "doc_id long, piece int, n_tokens int, bin_id long, bin_offset int, bin_capacity int, bin_used int, ids binary"


def cost(capacity: int, overhead: float = 64.0, quadratic: float = 16384.0) -> float:
    return overhead + capacity + capacity * capacity / quadratic


class OpenBins:
    """Bins by free space; the fullest bin that still has room is found from a bit mask."""

    def __init__(self, largest: int) -> None:
        self.by_free: list[list[int]] = [[] for _ in range(largest + 1)]
        self.mask = 0

    def put(self, number: int, free: int) -> None:
        if free:
            self.by_free[free].append(number)
            self.mask |= 1 << free

    def best(self, need: int) -> tuple[int, int] | None:
        fits = self.mask >> need
        if not fits:
            return None
        free = need + ((fits & -fits).bit_length() - 1)
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        return number, free


class Waiting:
    """The lengths still to be placed, with their counts."""

    def __init__(self, lengths: np.ndarray, largest: int) -> None:
        self.counts = np.bincount(lengths, minlength=largest + 1).tolist()
        self.mask = sum(1 << n for n, c in enumerate(self.counts) if c)

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            self.mask &= ~(1 << length)

    def filling(self, free: int) -> int:
        """What the longest waiting pieces, one after the other, would fill of ``free``."""
        total, fits = 0, self.mask & ((2 << free) - 1)
        while fits:
            length = fits.bit_length() - 1
            some = min(self.counts[length], free // length) * length
            total, free = total + some, free - some
            fits &= (1 << min(length, free + 1)) - 1
        return total


def best_fit(lengths: np.ndarray, sizes: list[int], only: int | None = None) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """For each piece: bin, offset; for each bin: capacity, used. ``only``: the one size that is opened where it takes the piece."""
    order = np.argsort(-lengths, kind="stable")
    price = {u: cost(c) for c, below in zip(sizes, [0, *sizes], strict=False) for u in range(below + 1, c + 1)}
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    open_bins, waiting = OpenBins(sizes[-1]), Waiting(lengths, sizes[-1])
    for k, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        waiting.take(need)
        found = open_bins.best(need)
        if found is None:
            fits = [c for c in sizes if c >= need]
            if only is not None:
                c = max(only, fits[0])
            elif len(fits) == 1:
                c = fits[0]
            else:
                held = {c: need + waiting.filling(c - need) for c in fits}
                c = min(fits, key=lambda c: (price[held[c]] / held[c], c))
            found = len(used), c
            used.append(0)
        b, free = found
        bins[k], offsets[k] = b, used[b]
        used[b] += need
        open_bins.put(b, free - need)
    return bins, offsets, [min(c for c in sizes if c >= u) for u in used], used


def pack_pieces(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES) -> tuple[np.ndarray, ...]:
    """For each piece (1 <= length <= largest capacity): bin, offset; for each bin: capacity, used."""
    sizes = sorted(set(capacities))
    tries = [best_fit(lengths, sizes, only) for only in (None, *sizes)]
    bins, offsets, down, used = min(tries, key=lambda t: sum(map(cost, t[2])))
    return bins, offsets, np.array(down, np.int64), np.array(used, np.int64)


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """(doc_id, n_tokens, ids): ids little-endian and unsigned, of 16 bits if all the tokenizer's fit, else of 32; a written table."""

    def run(batches):
        encoder = token_store.encoder_for(tokenizer_file, end_id)
        kind = "<u2" if encoder.bits <= 16 else "<u4"
        for whole in batches:
            for b in C.slices(whole, "text", 4 << 20):
                ids, n = encoder.encode(*C.text_bytes(b["text"]))
                flat = ids.astype(kind)
                o = np.concatenate([[0], np.cumsum(n)]) * flat.itemsize
                column = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(o.astype(np.int32)), pa.py_buffer(flat)])
                yield C.batch(_TOKENS, doc_id=b["doc_id"], n_tokens=n, ids=column)

    return C.materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(C.lean(run), _TOKENS), "encoded-texts")


def pack(tokens: DataFrame, capacities: Sequence[int] = CAPACITIES, group_tokens: int = 4 << 20) -> DataFrame:
    """Pack rows (doc_id, n_tokens >= 1, ids); one row for each piece, with its ids."""
    largest = max(capacities)

    def packed(held: list[pa.RecordBatch], first_bin: int):
        n = np.concatenate([b["n_tokens"].to_numpy() for b in held])
        raw = np.concatenate([C.text_bytes(b["ids"])[0] for b in held])
        ids = pa.concat_arrays([b["doc_id"] for b in held])
        width = len(raw) // max(int(n.sum()), 1)
        pieces = -(-n // largest)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[row] - piece * largest, largest)
        bins, offsets, capacity, used = pack_pieces(size, capacities)
        edges = np.concatenate([[0], np.cumsum(size)]) * width
        ints = lambda x: pa.array(x.astype(np.int32))
        for a in range(0, len(row), 4096):
            z = slice(a, min(a + 4096, len(row)))
            flat = pa.BinaryArray.from_buffers(pa.binary(), z.stop - a, [None, pa.py_buffer((edges[a : z.stop + 1] - edges[a]).astype(np.int32)), pa.py_buffer(raw[edges[a] : edges[z.stop]])])
            yield C.batch(_SCHEMA, doc_id=ids.take(pa.array(row[z])), piece=ints(piece[z]), n_tokens=ints(size[z]), bin_id=first_bin + bins[z], bin_offset=ints(offsets[z]), bin_capacity=ints(capacity[bins[z]]), bin_used=ints(used[bins[z]]), ids=flat)

    def run(batches):
        held, size, group = [], 0, 0
        task = TaskContext.get().partitionId()
        for whole in batches:
            for b in C.slices(whole, "ids", 1 << 20):
                held.append(b)
                size += int(b["n_tokens"].to_numpy().sum())
                if size >= group_tokens:
                    yield from packed(held, (task << 40) + (group << 24))
                    held, size, group = [], 0, group + 1
        if size:
            yield from packed(held, (task << 40) + (group << 24))

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(C.lean(run), _SCHEMA)


def pack_documents(docs: DataFrame, tokenizer_file: str | None = None, capacities: Sequence[int] = CAPACITIES, end_id: int = 2) -> DataFrame:
    """One row for each piece of each document: its ids, its bin, its place there, the bin's capacity and use."""
    return pack(encoded(docs, tokenizer_file or token_store.default_tokenizer(), end_id), capacities)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each bin: capacity, ids of its pieces on end, and their documents and lengths (a bin is never larger than its capacity)."""
    pieces = F.sort_array(F.collect_list(F.struct("bin_offset", "doc_id", "n_tokens", "ids")))
    bins = packed.groupBy("bin_id").agg(F.first("bin_capacity").alias("capacity"), F.first("bin_used").alias("used"), pieces.alias("p"))
    return bins.select("bin_id", "capacity", "used", F.expr("aggregate(p.ids, X'', (a, b) -> a || b)").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.n_tokens").alias("lengths"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with the CRC-32 of their ids' bytes in place of the ids."""
    return pack_documents(C.documents(spark, sf_dir)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
