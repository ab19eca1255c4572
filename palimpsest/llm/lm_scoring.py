"""LM scoring: deleted interpolation of n-gram estimates of order three (or two, where c(u v w) and c(u v) count as 0).

The probability of word w after the words u v mixes four maximum-likelihood estimates,

    P(w | u v) = a3 * c(u v w) / c(u v)  +  a2 * c(v w) / c(v)  +  a1 * c(w) / N  +  a0 / (V + 1),

with weights a that depend on the context's frequency bucket: floor(2 log2(c(u v) + 1)), or, where
u v was never seen, the same of c(v) in buckets of its own. The weights are learned by
expectation-maximisation on held-out counts: one fold of the training documents is deleted from all
counts and predicted from the rest; the final estimates use all training documents. ``score`` is the
log10 probability that this one model gives a text. ``score_without_own`` deletes a training document's
own counts for its own score, so that it says what the rest of the corpus makes of a text, in training
or not, and a text that stands twice in the corpus is told from one that merely knows itself. The
text's end is a token, and also the words before the first (each text has one end and one beginning,
so c(end) counts both).

Everything is counted over all training tokens, in three steps. Texts are written once as compressed
chunks. Each chunk sends its distinct n-grams of every order with their counts in it to the
parts of their hashes, so that an n-gram, however frequent, is one entry a chunk; each part adds up
and answers every chunk with the sums in the order in which it asked, so that no hash travels back.
Answers and texts meet at the chunk's home, where every token's counts, and those of
its contexts, which are the counts of the token before, are then known. That shuffle is read
twice (weights, then scores) from the same files.

N-grams are 64-bit hashes of their lower-cased words. Defined results: null text is the end
token alone; rows that share a doc_id give one row, the sums of theirs, each row's own counts
deleted for itself; a null doc_id is a document of its own, in training; without training tokens P is 1 / (V + 1) = 1;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

END = np.uint64(0x51ED270B7A6C9E35)
ORDERS = (1, 2, 3)
_HALF = 128  # buckets of one kind of context
_CHUNK = 1 << 20  # bytes of text that are worked on at a time
_RANGES = 8  # ranges of hashes in which a part adds up
_OUT = "doc_id long, n_tokens long, n_known long, base_score double, score double, score_without_own double"
_U, _I, _F = np.uint64, np.int64, np.float64
_STEP = {2: _U(0x9FB21C651E98DF25), 3: _U(0xC2B2AE3D27D4EB4F)}


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, the row of each token, and which are first."""
    data = C.LOWER[data]
    starts, ends, wo = C.word_bounds(data, offsets)
    h = np.insert(C.span_hash(C.prefix_sums(data), starts, ends), wo[1:], END)
    row = np.repeat(np.arange(len(wo) - 1), np.diff(wo) + 1)
    first = np.ones(len(h), bool)
    first[1:] = row[1:] != row[:-1]
    return h, row, first


def before(x: np.ndarray, first: np.ndarray, fill) -> np.ndarray:
    """The value of the token before each, ``fill`` for the first of a text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = fill
    return out


def grams(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The hash of the one, two and three words up to each token."""
    v = before(h, first, END)
    two = C.mix(v * _STEP[2] + h)
    return [h, two, C.mix(before(v, first, END) * _STEP[3] + two)]


def home_of(chunk: int, parts: int) -> int:
    return int(C.part_of(C.mix(np.array([chunk], _I).view(_U)), parts)[0])


def written_chunks(docs: DataFrame, parts: int, folds: int, held: int, deleted: int) -> DataFrame:
    """(part, blob): texts with ids and roles (0 held out, 1 training, 2 training and in the deleted fold) in numbered chunks."""

    def cut(batches):
        task, number = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for b in C.slices(whole, "text", _CHUNK):
                data, o = C.text_bytes(b["text"])
                r = b["crc"].to_numpy(zero_copy_only=False) % folds
                role = np.where(r == held, 0, np.where(r == deleted, 2, 1)).astype(np.uint8)
                chunk = (task << 24) + number
                number += 1
                yield C.blob_batch([(home_of(chunk, parts), b"X" + struct.pack("<q", chunk) + squeeze(C.pack(C.ids_of(b["doc_id"]), role, np.diff(o)) + data.tobytes()))])

    return C.materialise(docs.mapInArrow(C.lean(cut), C.BLOB), "texts")


def opened(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, ids, roles, text bytes and offsets of a chunk."""
    (chunk,) = struct.unpack_from("<q", blob, 1)
    body = zstandard.ZstdDecompressor().decompress(blob[9:])
    (n,) = struct.unpack_from("<q", body)
    ids, role, sizes = C.unpack(body[: 8 + 17 * n], _I, np.uint8, _I)
    return chunk, ids, role, np.frombuffer(body, np.uint8, offset=8 + 17 * n), np.concatenate([[0], np.cumsum(sizes)])


def asked(texts: DataFrame, parts: int, order: int) -> DataFrame:
    """Blobs by the n-grams' parts: order, chunk, distinct hashes (as differences, compressed) with their counts in
    training and in the deleted fold."""

    def cut(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for blob in b["blob"].to_pylist():
                chunk, _, role, data, o = opened(blob)
                h, row, first = tokens(data, o)
                role = role[row]
                for n, g in zip(ORDERS[:order], grams(h, first), strict=False):
                    u, place = np.unique(g, return_inverse=True)
                    c, f = (np.bincount(place[x], minlength=len(u)).astype(np.int32) for x in (role > 0, role == 2))
                    part = C.part_of(u, parts)
                    edges = C.runs(part)
                    rows = [(int(part[x]), struct.pack("<Bq", n, chunk) + squeeze(C.pack(np.diff(u[x:y], prepend=_U(0)), c[x:y], f[x:y]))) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    yield C.blob_batch(rows)

    return texts.mapInArrow(C.lean(cut), C.BLOB)


def answered(requests: DataFrame, parts: int) -> DataFrame:
    """Blobs by the chunks' homes: order, chunk, part, sums for what was asked. Part -1: tokens, words, tokens of the deleted fold."""

    def add(blobs):
        squeeze, expand = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for n in ORDERS:
            mine = [(struct.unpack_from("<q", x, 1)[0], *C.unpack(expand(x[9:]), _U, np.int32, np.int32)) for x in blobs if x[0] == n]
            if not mine:
                continue
            hashes = [np.cumsum(m[1]) for m in mine]
            chunks, c, f = [m[0] for m in mine], [m[2] for m in mine], [m[3] for m in mine]
            del mine
            here = int(C.part_of(hashes[0][:1], parts)[0])
            total = np.zeros(3, _I)
            sums = [[] for _ in chunks]
            # a range of the hashes after the other: what sorting them needs is a fraction of the part
            low, high = min(int(h[0]) for h in hashes), max(int(h[-1]) for h in hashes)
            at = [0] * len(chunks)
            for k in range(1, _RANGES + 1):
                end = [len(h) for h in hashes] if k == _RANGES else [int(np.searchsorted(h, _U(low + (high - low) * k // _RANGES))) for h in hashes]
                u, place = np.unique(np.concatenate([h[a:b] for h, a, b in zip(hashes, at, end, strict=True)]), return_inverse=True)
                both = [np.bincount(place, weights=np.concatenate([x[a:b] for x, a, b in zip(y, at, end, strict=True)]), minlength=len(u)).astype(_I) for y in (c, f)]
                if n == 1:
                    total += [both[0].sum(), (both[0] > 0).sum(), both[1].sum()]
                done = 0
                for j, (a, b) in enumerate(zip(at, end, strict=True)):
                    some = place[done : done + b - a]
                    done += b - a
                    sums[j].append(squeeze(C.pack(both[0][some], both[1][some])))
                at = end
            for chunk, own in zip(chunks, sums, strict=True):
                yield C.blob_batch([(home_of(chunk, parts), b"A" + struct.pack("<Bqi", n, chunk, here) + b"".join(struct.pack("<q", len(x)) + x for x in own))])
            if n == 1:
                yield C.blob_batch([(-1, C.pack(total))])

    return C.materialise(C.exchange(requests, parts, add, C.BLOB), "n-gram-counts")


@dataclass(frozen=True)
class Seen:
    """Tokens of whole texts with the counts of their n-grams by order, in training (c) and in the deleted fold (f)."""

    ids: np.ndarray
    row: np.ndarray
    role: np.ndarray
    first: np.ndarray
    c: list[np.ndarray]
    f: list[np.ndarray]
    own: list[np.ndarray]
    order: int

    def contexts(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the two words and of the word before each token; the text's last token, its end, tells of its beginning."""
        begin = np.flatnonzero(self.first)
        end = x[0][np.append(begin[1:], len(self.row)) - 1]
        return before(x[1], self.first, end) * (self.order > 2), before(x[0], self.first, end)


def places(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value among the distinct ones, and how often it stands in its own text."""
    order = np.argsort(g, kind="stable")
    values, texts = g[order], row[order]  # equal values stay in the order of the texts
    new = np.ones(len(g), bool)
    new[1:] = values[1:] != values[:-1]
    place, own = np.empty(len(g), _I), np.empty(len(g), _I)
    place[order] = np.cumsum(new) - 1
    new[1:] |= texts[1:] != texts[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(begin, append=len(g))
    own[order] = np.repeat(size, size)
    return place, own


def sums_of(answers: list[bytes], expand) -> tuple[np.ndarray, np.ndarray]:
    """The counts of all that a chunk asked for in one order, from its parts' answers in order."""
    both = []
    for x in answers:
        at = 14
        while at < len(x):
            (size,) = struct.unpack_from("<q", x, at)
            both.append(C.unpack(expand(x[at + 8 : at + 8 + size]), _I, _I))
            at += 8 + size
    return np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])


def at_home(blobs: Iterator[bytes], fold: bool, order: int) -> Iterator[Seen]:
    """The chunks of a home; ``fold``: only their texts of the deleted fold."""
    texts, answers = [], {}
    for x in blobs:
        if x[:1] == b"X":
            texts.append(x)
        else:
            n, chunk, part = struct.unpack_from("<Bqi", x, 1)
            answers.setdefault(chunk, []).append((n, part, x))
    expand = zstandard.ZstdDecompressor().decompress
    for x in texts:
        chunk, ids, role, data, o = opened(x)
        h, row, first = tokens(data, o)
        got = sorted(answers.pop(chunk, []), key=lambda a: a[:2])  # parts are ranges of the hash
        mine = role[row] == 2 if fold else np.ones(len(row), bool)
        if not mine.any():
            continue
        c, f, own = [], [], []
        for n, g in zip(ORDERS, grams(h, first), strict=True):
            if n > order:
                c.append(np.zeros(int(mine.sum()), _I)), f.append(c[-1]), own.append(c[-1])
                continue
            all_c, all_f = sums_of([y for k, _, y in got if k == n], expand)
            if fold:
                place, mine_only = np.searchsorted(C.distinct(g), g[mine]), np.zeros(0, _I)
            else:
                place, mine_only = places(g, row)
            c.append(all_c[place])
            f.append(all_f[place] if fold else np.zeros(0, _I))
            own.append(mine_only)
        yield Seen(ids, row[mine], role[row[mine]], first[mine], c, f, own, order)


def bucket(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Of contexts seen ``two`` times with both words, or else ``one`` times with the last."""
    level = lambda n: np.floor(2 * np.log2(n + 1.0) + 1e-9).astype(_I)
    return np.where(two > 0, level(two), _HALF + level(one))


def em_rows(s: Seen) -> bytes:
    """What texts of the deleted fold show: their tokens' counts without it, and how often; equal rows are added up."""
    rest = [c - f for c, f in zip(s.c, s.f, strict=True)]
    (c1, c2, c3), (two, one) = rest, s.contexts(rest)
    rows = [bucket(two, one), c3, np.where(c3 > 0, two, 0), c2, np.where(c2 > 0, one, 0), c1]  # of a context never followed so only the bucket counts
    order = np.lexsort(rows[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in rows:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    return C.pack(*(k[order][at] for k in rows), np.diff(at, append=len(order)))


@dataclass(frozen=True)
class Mixture:
    """Weights (uniform, one word, two, three) of each bucket, with the corpus totals."""

    weights: np.ndarray
    n: int
    v: int

    def log10(self, c3, c2, c1, two, one, less) -> np.ndarray:
        """``less``: tokens that are deleted from the corpus for this one."""
        a = self.weights[bucket(two, one)]
        return np.log10(a[:, 3] * c3 / np.maximum(two, 1) + a[:, 2] * c2 / np.maximum(one, 1) + a[:, 1] * c1 / np.maximum(self.n - less, 1) + a[:, 0] / (self.v + 1))

    def base(self, c) -> np.ndarray:
        return np.log10((c + 1.0) / (self.n + self.v + 1.0))


def learn_weights(held: DataFrame, n: int, v: int, rounds: int = 10) -> np.ndarray:
    """Expectation-maximisation over the deleted fold's rows."""
    weights = np.full((2 * _HALF, 4), 1 / 4)
    for _ in range(rounds):

        def expect(batches, a=weights):
            total = np.zeros((2 * _HALF, 4))
            for batch in batches:
                for x in batch["blob"].to_pylist():
                    b, c3, two, c2, one, c1, times = C.unpack(x, *[_I] * 7)
                    p = np.column_stack([np.full(len(b), 1 / (v + 1)), c1 / max(n, 1), c2 / np.maximum(one, 1), c3 / np.maximum(two, 1)]) * a[b]
                    p *= (times / np.maximum(p.sum(axis=1), 1e-300))[:, None]
                    for k in range(4):
                        total[:, k] += np.bincount(b, weights=p[:, k], minlength=2 * _HALF)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        total = np.zeros((2 * _HALF, 4))
        for r in held.mapInArrow(C.lean(expect), "sums binary").collect():
            total += np.frombuffer(r["sums"]).reshape(2 * _HALF, 4)
        every = total.sum(axis=0) + 1e-3
        smooth = total + 3 * every / every.sum()  # buckets with little evidence lean on the overall weights
        weights = smooth / smooth.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, folds: int = 7, held: int = 2, deleted: int = 3, order: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_without_own) for each document."""
    spark, parts = docs.sparkSession, C.part_count(docs)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.select(F.col("doc_id").cast("long"), "text", crc.alias("crc"))
    texts = written_chunks(docs, parts, folds, held, deleted)
    counts = answered(asked(texts, parts, order), parts)
    # three numbers a part; null where there are no tokens
    of_part = counts.filter("part < 0").mapInArrow(lambda it: (C.batch("n long, v long, f long", n=[t[0]], v=[t[1]], f=[t[2]]) for b in it for x in b["blob"].to_pylist() for t in C.unpack(x, _I)), "n long, v long, f long")
    n, v, n_deleted = (x or 0 for x in of_part.agg(F.sum("n"), F.sum("v"), F.sum("f")).first())
    # an RDD keeps its shuffle files: the second reading does not repeat the exchange
    homes = texts.union(counts.filter("part >= 0")).repartitionById(parts, F.col("part")).rdd

    def learn(rows):
        for s in at_home((bytes(r["blob"]) for r in rows), True, order):
            yield 0, em_rows(s)

    learned = C.materialise(spark.createDataFrame(homes.mapPartitions(learn), C.BLOB), "deleted-fold")
    known = spark.sparkContext.broadcast(Mixture(learn_weights(learned, n - n_deleted, v), n, v))

    def scored(rows):
        model = known.value
        for s in at_home((bytes(r["blob"]) for r in rows), False, order):
            add = lambda x, s=s: np.bincount(s.row, weights=x, minlength=len(s.ids))
            rest = [c - np.where(s.role > 0, o, 0) for c, o in zip(s.c, s.own, strict=True)]
            size = np.bincount(s.row, minlength=len(s.ids))
            p = add(model.log10(*reversed(s.c), *s.contexts(s.c), 0))
            others = add(model.log10(*reversed(rest), *s.contexts(rest), np.where(s.role > 0, size[s.row], 0)))
            yield from C.spread(C.part_of(C.mix(s.ids.view(_U)), parts), s.ids, size.astype(np.int32), add((s.c[0] > 0).astype(float)).astype(np.int32), add(model.base(s.c[0])), p, others)

    def add_up(blobs):
        ids, count, seen, base, p, others = (np.concatenate(x) for x in zip(*(C.unpack(x, _I, np.int32, np.int32, _F, _F, _F) for x in blobs), strict=True))
        order = np.argsort(ids, kind="stable")
        at = C.runs(ids[order])[:-1]
        add = lambda x: np.add.reduceat(x[order], at)
        u = ids[order][at]
        yield C.batch(_OUT, doc_id=pa.array(u, mask=u == -(2**63)), n_tokens=add(count.astype(_I)), n_known=add(seen.astype(_I)), base_score=add(base), score=add(p), score_without_own=add(others))

    out = C.exchange(spark.createDataFrame(homes.mapPartitions(scored), C.BLOB), parts, add_up, _OUT)
    return out.select("doc_id", (crc % folds == held).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "score_without_own")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of order two: order three takes more disk and memory than the check tool allows (README)."""
    return score(C.documents(spark, sf_dir), order=2)
