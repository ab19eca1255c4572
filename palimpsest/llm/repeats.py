"""Finding repeated windows over a whole corpus: the ground of the two substring operators.

A text is a sequence of units (bytes or words); a window is ``length`` units of one text.
Which windows also occur elsewhere is settled in four steps, all exact:

1. Anchors. Every window has one anchor: the least-hashed of its ``gram``-unit grams, the
   last of equals. It depends on the window's content alone, so equal windows have equal
   anchors. Neighbouring windows mostly share theirs; a run of them is one entry. Entries
   are shuffled by the anchor's hash as sorted blobs (one for every ten to forty units), and
   anchors that occur once are done with.
2. Contexts. Texts are shuffled by document and meet the list of their repeated
   runs. A run's context (from its first window's start to its last window's end) goes to
   the anchor's task. Of equal contexts in one task only the first holder's goes on, the
   others are already decided.
3. Decision. Contexts of one anchor are compared by the operator's own index: first holders
   of equal contexts need no index, others are looked up window by window.
4. Removal. Decided spans and, once more, the texts go to the documents' parts. Texts travel
   as zstd blobs, so that moving them twice costs about what the plain texts would once.

Skew: anchors that repeat within a chunk of texts send one entry for all; equal contexts
collapse before they are sent; anchors with ``HOT_FROM`` and more entries (the 2**17 most
frequent ones, a fixed bound on what is broadcast) are split by the window's offset, their
windows keyed by nearly all of their content.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HOT_FROM, HOT_MOST = 256, 1 << 17
_U, _I = np.uint64, np.int64
_HELD_BYTES = 24 << 20  # contexts that a task holds back to find equal ones


@dataclass(frozen=True)
class Kind:
    """What a unit is and how windows are decided.

    ``units(data, offsets)``: hash codes of all units and the texts' offsets among them.
    ``contents(text, spans)``: the bytes of each span (start, end) of units of a text.
    ``decide(contexts)``: contexts are (order key, document, start, windows, content), all of
    one shard; gives (document, first removed window, end) spans of window starts.
    ``same_document``: whether an earlier window of the same document counts.
    """

    length: int
    gram: int
    split: int
    units: Callable
    contents: Callable
    decide: Callable
    same_document: bool
    hot_from: int = HOT_FROM
    chunk: int = 1 << 20  # bytes of text that are worked on at a time


def anchor_runs(sums: np.ndarray, offsets: np.ndarray, kind: Kind):
    """For all runs of windows with one anchor, in order: text, first window, windows, anchor place, anchor hash."""
    n, length, gram = len(sums) - 1, kind.length, kind.gram
    if n < length:
        z = np.zeros(0, _I)
        return z, z, z, z, np.zeros(0, _U)
    _, down = C.powers(n + 1)
    grams = sums[gram:] - sums[: n - gram + 1]
    grams *= down[: n - gram + 1]
    grams ^= grams >> _U(29)
    grams *= _U(0xD6E8FEB86659FD93)  # the high bits, which alone are compared, depend on all bits
    bits = _U(max(20, int(n).bit_length()))
    low = (_U(1) << bits) - _U(1)
    key = grams & ~low
    key |= low - np.arange(len(key), dtype=_U)  # least hash, then the last place
    width, least, span = length - gram + 1, key, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(key) - width + 1], least[width - span : width - span + len(key) - width + 1])
    del key
    least &= low
    place = (low - least).astype(np.int32)
    del least
    text = C.row_of(offsets).astype(np.int32)
    first = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    place = place[first]
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)
    start = np.flatnonzero(new)
    count = np.diff(start, append=len(first))
    at = place[start].astype(_I)
    return text[first[start]].astype(_I), first[start], count, at, grams[at]


def _ordinals(text: np.ndarray) -> np.ndarray:
    """The number of each run within its text."""
    begin = np.ones(len(text), bool)
    begin[1:] = text[1:] != text[:-1]
    start = np.flatnonzero(begin)
    return np.arange(len(text)) - np.repeat(start, np.diff(start, append=len(text)))


def repeated_runs(docs: DataFrame, kind: Kind, parts: int) -> DataFrame:
    """Blobs by the document's part (A: document, run) of anchors that repeat; T blobs (part -1): frequent anchors."""

    def cut(batches):
        for whole in batches:
            for b in C.slices(whole, "text", kind.chunk):
                codes, offsets = kind.units(*C.text_bytes(b["text"]))
                text, _, _, _, h = anchor_runs(C.code_sums(codes), offsets, kind)
                ids, run = C.ids_of(b["doc_id"]), _ordinals(text).astype(np.uint32)
                who = ids[text]
                order = np.lexsort((who, h))
                h, who, run = h[order], who[order], run[order]
                edges = C.runs(h)
                size = np.diff(edges)
                several = size > 1
                if len(h) and not kind.same_document:
                    several &= who[edges[:-1]] != who[edges[1:] - 1]
                local = np.repeat(several, size)
                rows = [(p, b"S" + x) for p, x in C.spread(C.part_of(C.mix(h[edges[:-1]][several]), parts), h[edges[:-1]][several], size[several].astype(np.int32))] if len(h) else []
                rows += [(p, b"K" + x) for p, x in _by_document(who[local], run[local], parts)]
                h, who, run = h[~local], who[~local], run[~local]
                order = np.lexsort((run, who))
                for p, x in C.spread(C.part_of(C.mix(h[order]), parts), h[order], who[order], run[order]):
                    hh, ww, rr = C.unpack(x, _U, _I, np.uint32)
                    rows.append((p, b"E" + C.pack(hh, np.diff(ww, prepend=_I(0)), rr)))
                yield C.blob_batch(rows)

    def meet(blobs):
        hs, ws, rs, ns = [], [], [], []
        for blob in blobs:
            body = blob[1:]
            if blob[:1] == b"K":
                yield C.blob_batch([(int.from_bytes(body[:4], "little"), b"A" + body[4:])])
            elif blob[:1] == b"S":
                h, n = C.unpack(body, _U, np.int32)
                hs.append(h), ns.append(n), ws.append(np.zeros(len(h), _I)), rs.append(np.full(len(h), 0xFFFFFFFF, np.uint32))
            else:
                h, w, r = C.unpack(body, _U, _I, np.uint32)
                hs.append(h), ws.append(np.cumsum(w)), rs.append(r), ns.append(np.ones(len(h), np.int32))
        if not hs:
            return
        h, w, r, n = (np.concatenate(x) for x in (hs, ws, rs, ns))
        order = np.lexsort((w, h))
        h, w, r, n = h[order], w[order], r[order], n[order]
        edges = C.runs(h)
        size = np.diff(edges)
        total = np.add.reduceat(n, edges[:-1])
        again = total > 1
        if not kind.same_document:  # entries of one document alone are no repetition
            known = np.maximum.reduceat((r == 0xFFFFFFFF).astype(np.int8), edges[:-1]) > 0
            again &= known | (w[edges[:-1]] != w[edges[1:] - 1])
        take = np.repeat(again, size) & (r != 0xFFFFFFFF)
        rows = [(p, b"A" + x) for p, x in _by_document(w[take], r[take], parts, prefixed=False)]
        hot = total >= kind.hot_from
        if hot.any():
            rows.append((-1, C.pack(h[edges[:-1]][hot], total[hot].astype(_I))))
        yield C.blob_batch(rows)

    return C.exchange(docs.mapInArrow(C.lean(cut), C.BLOB), parts, meet, C.BLOB)


def _by_document(who: np.ndarray, run: np.ndarray, parts: int, prefixed: bool = True):
    """Blobs (document, run) by the document's part; ``prefixed`` ones travel by way of that part with its number."""
    order = np.lexsort((run, who))
    who, run = who[order], run[order]
    for p, x in C.spread(C.part_of(C.mix(who.view(_U)), parts), who, run):
        w, r = C.unpack(x, _I, np.uint32)
        body = C.pack(np.diff(w, prepend=_I(0)), r)
        yield p, (p.to_bytes(4, "little") + body if prefixed else body)


def _frequent(found: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent anchors, HOT_MOST at most."""

    def open_blobs(batches):
        for b in batches:
            for x in b["blob"].to_pylist():
                h, n = C.unpack(x, _U, _I)
                yield C.batch("h long, n long", h=h.view(_I), n=n)

    rows = found.filter("part < 0").mapInArrow(C.lean(open_blobs), "h long, n long").orderBy(F.desc("n"), "h").limit(HOT_MOST).collect()
    return np.sort(np.array([r[0] for r in rows], _I).view(_U))


def _texts(docs: DataFrame, parts: int) -> DataFrame:
    """Texts as compressed blobs by the document's part."""

    def cut(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for b in C.slices(whole, "text"):
                ids = C.ids_of(b["doc_id"])
                part = C.part_of(C.mix(ids.view(_U)), parts)
                data, o = C.text_bytes(b["text"])
                raw, rows = data.tobytes(), []
                order = np.argsort(part, kind="stable")
                edges = C.runs(part[order])
                for a, e in zip(edges[:-1], edges[1:], strict=True):
                    some = order[a:e]
                    body = C.pack(ids[some], np.diff(o)[some]) + b"".join(raw[o[i] : o[i + 1]] for i in some.tolist())
                    rows.append((int(part[some[0]]), b"X" + squeeze(body)))
                yield C.blob_batch(rows)

    return docs.mapInArrow(C.lean(cut), C.BLOB)


def _open_texts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob[1:])
    n = int.from_bytes(body[:8], "little")
    ids, sizes = C.unpack(body[: 8 + 16 * n], _I, _I)
    return ids, np.frombuffer(body, np.uint8, offset=8 + 16 * n), np.concatenate([[0], np.cumsum(sizes)])


def _kinds(blobs: list[bytes], *kinds: bytes) -> list[list[bytes]]:
    return [[b for b in blobs if b[:1] == k] for k in kinds]


def _group_blobs(blobs: list[bytes], chunk: int):
    """Text blobs in groups of some ``chunk`` bytes."""
    group, size = [], 0
    for b in blobs:
        group.append(b)
        size += 3 * len(b)  # about what a compressed blob holds
        if size > chunk:
            yield group
            group, size = [], 0
    if group:
        yield group


def _join_texts(group: list[bytes]):
    opened = [_open_texts(b) for b in group]
    ids = np.concatenate([x[0] for x in opened])
    data = np.concatenate([x[1] for x in opened])
    sizes = np.concatenate([np.diff(x[2]) for x in opened])
    return ids, data, np.concatenate([[0], np.cumsum(sizes)])


def contexts(blobs: list[bytes], kind: Kind, parts: int, hot: np.ndarray):
    """For one part of documents: context blobs by anchor, and R blobs of what is decided already."""
    texts, answers = _kinds(blobs, b"X", b"A")
    marked: dict[int, list] = {}
    for blob in answers:
        w, r = C.unpack(blob[1:], _I, np.uint32)
        w = np.cumsum(w)
        edges = C.runs(w)
        for a, e in zip(edges[:-1], edges[1:], strict=True):
            marked.setdefault(int(w[a]), []).append(r[a:e])
    if not marked:
        return
    wanted = np.array(sorted(marked), _I)
    holders: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}  # (anchor, content): (document, start, windows)
    sum_of = [0]
    for group in _group_blobs(texts, kind.chunk):
        ids, data, o = _join_texts(group)
        codes, offsets = kind.units(data, o)
        sums = C.code_sums(codes)
        text, first, count, place, h = anchor_runs(sums, offsets, kind)
        run = _ordinals(text)
        size = np.bincount(text, minlength=len(ids))
        begin = np.cumsum(size) - size
        pick = np.zeros(len(text), bool)
        for t in np.flatnonzero(np.isin(ids, wanted)).tolist():
            for r in marked[int(ids[t])]:
                pick[begin[t] + r[r < size[t]].astype(_I)] = True
        text, first, count, place, h = (x[pick] for x in (text, first, count, place, h))
        del run
        if len(hot) and len(h):
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            text, first, count, h = _split(sums, text, first, count, place, h, hot[at] == h, kind)
        local = first - offsets[text]
        edges = C.runs(text)
        for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            t, d = int(text[a]), int(ids[text[a]])
            spans = list(zip(local[a:e].tolist(), (local[a:e] + count[a:e] - 1 + kind.length).tolist(), strict=True))
            for key, content, (s, _), n in zip(h[a:e].tolist(), kind.contents(data[o[t] : o[t + 1]].tobytes(), spans), spans, count[a:e].tolist(), strict=True):
                holders.setdefault((key, content), []).append((d, s, n))
                sum_of[0] += len(content) + 300
        if sum_of[0] > _HELD_BYTES:
            yield from _send(holders, kind, parts)
            holders.clear()
            sum_of[0] = 0
    yield from _send(holders, kind, parts)


def _send(holders: dict, kind: Kind, parts: int):
    """Context blobs of what is held, and R blobs of what is decided already."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out, done = [], []
    for (key, content), held in holders.items():
        held = sorted(set(held))
        least = held[0]
        for x in held:
            if x == least or (not kind.same_document and x[0] == least[0]):
                out.append((key, *x, content))
            else:
                done.append((x[0], x[1], x[1] + x[2]))
    yield from _removals(done, parts)
    # anchors are least hashes and so bunch near zero: they are scrambled again to be dealt evenly
    h = np.array([r[0] for r in out], _U)
    part = C.part_of(C.mix(h), parts)
    order = np.argsort(part, kind="stable")
    part, h, out = part[order], h[order], [out[i] for i in order.tolist()]
    edges = C.runs(part)
    for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows = out[a:e]
        cols = [np.array([r[k] for r in rows], _I) for k in (1, 2, 3)]
        sizes = np.array([len(r[4]) for r in rows], _I)
        yield int(part[a]), b"C" + squeeze(C.pack(h[a:e], *cols, sizes) + b"".join(r[4] for r in rows))


def _split(sums, text, first, count, place, h, hot, kind: Kind):
    """Runs of frequent anchors, cut by the windows' offset to the anchor and keyed by what all windows of a piece hold."""
    plain = ~hot
    rows = [(text[plain], first[plain], count[plain], h[plain])]
    i = np.repeat(np.flatnonzero(hot), count[hot])
    window = np.arange(len(i)) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot]) + first[i]
    piece = (place[i] - window) // kind.split
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (piece[1:] != piece[:-1])
    start = np.flatnonzero(new)
    i, piece, window, n = i[start], piece[start], window[start], np.diff(start, append=len(new))
    left = place[i] - piece * kind.split
    key = C.span_hash(sums, left, left - kind.split + 1 + kind.length)
    rows.append((text[i], window, n, C.mix(key ^ piece.astype(_U) ^ _U(0xA5A5A5A5A5A5A5A5))))
    text, first, count, h = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], first[order], count[order], h[order]


def _removals(spans: list[tuple[int, int, int]], parts: int):
    """R blobs (document, first window, end) by the document's part."""
    if spans:
        w, a, e = (np.array(x, _I) for x in zip(*sorted(spans), strict=True))
        for p, x in C.spread(C.part_of(C.mix(w.view(_U)), parts), w, a, e):
            yield p, b"R" + x


def decided(blobs: list[bytes], kind: Kind, parts: int):
    """For one part of anchors: removals from the contexts that met there; R blobs pass on to their documents' parts."""
    rows = []
    expand = zstandard.ZstdDecompressor().decompress
    passing, blobs = _kinds(blobs, b"R", b"C")
    for blob in passing:
        w, a, e = C.unpack(blob[1:], _I, _I, _I)
        yield int(C.part_of(C.mix(w[:1].view(_U)), parts)[0]), blob
    for blob in blobs:
        blob = expand(blob[1:])
        n = int.from_bytes(blob[:8], "little")
        h, d, s, c, sizes = C.unpack(blob[: 8 + 40 * n], _U, _I, _I, _I, _I)
        ends = np.cumsum(sizes)
        body = blob[8 + 40 * n :]
        rows += zip(h.tolist(), d.tolist(), s.tolist(), c.tolist(), [body[a:e] for a, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], strict=True)
    rows.sort()
    removed: list[tuple[int, int, int]] = []
    shard: list[tuple] = []

    def close(group):
        # equal contexts: the first holder decides for the others
        first: dict[bytes, tuple] = {}
        for r in group:
            f = first.get(r[4])
            if f is None:
                first[r[4]] = r
            elif r[1:3] != f[1:3] and (kind.same_document or r[1] != f[1]):
                removed.append((r[1], r[2], r[2] + r[3]))
        if len(first) > 1:
            keep = [r for r in group if first[r[4]][:3] == r[:3] or (not kind.same_document and r[1] == first[r[4]][1])]
            shard.append(keep)

    a = 0
    size = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[a][0]:
            if i - a > 1:
                before = len(shard)
                close(rows[a:i])
                if len(shard) > before:
                    size += sum(len(r[4]) for r in shard[-1])
                if size > 512 << 10:
                    removed += kind.decide(shard)
                    shard.clear()
                    size = 0
            a = i
    if shard:
        removed += kind.decide(shard)
    yield from _removals(removed, parts)


def _batched(make: Callable):
    """A reduce step for ``exchange`` from a generator of (part, blob): Arrow batches of some 4 MB."""

    def run(blobs):
        rows, size = [], 0
        for r in make(blobs):
            rows.append(r)
            size += len(r[1])
            if size > 4 << 20:
                yield C.blob_batch(rows)
                rows, size = [], 0
        if rows:
            yield C.blob_batch(rows)

    return run


def apply_removals(docs: DataFrame, kind: Kind, finish: Callable, schema: str) -> DataFrame:
    """``finish(ids, data, offsets, removed)`` turns the texts of a group, with each text's list of removed
    window-start spans, into an Arrow batch of ``schema``."""
    spark, parts = docs.sparkSession, C.part_count(docs)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = C.materialise(repeated_runs(docs, kind, parts), "repeated-anchors")
    hot = spark.sparkContext.broadcast(_frequent(found))
    texts = _texts(docs, parts)
    sent = C.exchange(found.filter("part >= 0").union(texts), parts, _batched(lambda blobs: contexts(blobs, kind, parts, hot.value)), C.BLOB)
    removals = C.exchange(sent, parts, _batched(lambda blobs: decided(blobs, kind, parts)), C.BLOB)

    def last(blobs):
        texts, spans = _kinds(blobs, b"X", b"R")
        removed: dict[int, list] = {}
        for blob in spans:
            w, a, e = C.unpack(blob[1:], _I, _I, _I)
            edges = C.runs(w)
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                removed.setdefault(int(w[x]), []).extend(zip(a[x:y].tolist(), e[x:y].tolist(), strict=True))
        for group in _group_blobs(texts, kind.chunk):
            yield finish(*_join_texts(group), removed)

    return C.exchange(removals.union(texts), parts, last, schema)


def merged(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of units that the windows starting in ``spans`` cover."""
    out: list[list[int]] = []
    for a, e in sorted(spans):
        end = e - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([a, end])
    return [(a, e) for a, e in out]
