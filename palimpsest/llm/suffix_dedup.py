"""Suffix-array dedup over bytes: matching statistics on a run-length index of repeated passages.

Every byte that a ``length``-byte string covers which also starts earlier (smaller doc_id, or
the same document at an earlier place) is removed; strings are judged on the input.

The contexts that may hold repeated strings come from ``repeats`` in groups of one anchor;
several groups make a shard of about 0.5 MB. In a shard, the contexts of each group are halved
in corpus order. All earlier halves make one index: a run-compressed Burrows-Wheeler transform
(run heads, run starts, the LF value at each run's start) with the places of the first and last
row of each run as samples. The later halves stream past it backwards, all in step: where the
transform has the wanted symbol LF follows it, else the walk jumps to the nearer run end that
has it, and the sample there says how much of the match stays. This gives each place's matching
statistic, the length of the longest string from there that the index holds. A window whose
statistic reaches ``length`` starts earlier and is removed. Then each half is halved in turn.
Removed windows are cut out of the later halves first, so at every level all halves of all
groups share one index: a window that is still undecided occurs in no group part before it
that it was held against, and none behind it has it.

Defined results: null text is empty; rows that share a doc_id are one document: a place of any
of them that is removed is removed in all; a null doc_id sorts before all others; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import repeats

LENGTH = 100
_I = np.int64


def suffix_array(symbols: np.ndarray, most: int) -> np.ndarray:
    """By prefix doubling; only suffixes that are still tied are sorted again. No two suffixes may be equal."""
    n, depth = len(symbols), 1
    key = symbols.copy()
    while depth < 4 and most ** (2 * depth) < 2**62:  # several symbols at once
        more = np.zeros(n, _I)
        more[: n - depth] = key[depth:]
        key = key * most**depth + more
        depth *= 2
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, _I)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while len(tied := np.flatnonzero(~(new & np.append(new[1:], True)))):
        some = order[tied]
        second = np.zeros(len(some), _I)
        inside = some + depth < n
        second[inside] = rank[some[inside] + depth] + 1
        key = rank[some] * (n + 1) + second
        by = np.argsort(key)
        key, some = key[by], some[by]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        order[tied], new[tied] = some, fresh
        rank[some] = np.maximum.accumulate(np.where(fresh, tied, 0))
        depth *= 2
    return order


class RunLengthIndex:
    """The run-compressed BWT of several byte strings, each closed by an end symbol of its own, with run-end samples."""

    def __init__(self, texts: list[bytes]) -> None:
        m = len(texts)
        sizes = np.array([len(t) for t in texts], _I)
        ends = np.cumsum(sizes + 1) - 1
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        symbols = raw.astype(_I) + m
        symbols[ends] = np.arange(m)  # end symbols sort before all bytes, in the order of their texts
        n = self.n = len(symbols)
        suffixes = suffix_array(symbols, m + 257)
        # the transform, run by run; all end symbols count as one symbol (0) that is never followed
        head = np.maximum(symbols[suffixes - 1] - m + 1, 0)
        new = np.ones(n, bool)
        new[1:] = head[1:] != head[:-1]
        self.run_starts = np.flatnonzero(new)
        self.heads = head[self.run_starts]
        self.run_sizes = np.diff(self.run_starts, append=n)
        self.by_symbol = np.lexsort((self.run_starts, self.heads))
        sizes_by = self.run_sizes[self.by_symbol]
        self.lf = np.empty(len(sizes_by), _I)
        self.lf[self.by_symbol] = np.cumsum(sizes_by) - sizes_by
        self.symbol_key = self.heads[self.by_symbol] * (n + 1) + self.run_starts[self.by_symbol]
        self.first_sample, self.last_sample = suffixes[self.run_starts], suffixes[self.run_starts + self.run_sizes - 1]
        # the text itself, eight bytes from each place on, and how far each place's text goes
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        self.words = np.zeros(n, np.uint64)
        for k in range(8):
            self.words |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        self.room = np.repeat(ends, sizes + 1) - np.arange(n)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from the places a and b on agree, ``most`` at most."""
        out = np.minimum(most, self.room[b])
        live, k = np.flatnonzero(out > 0), 0
        while len(live):
            x = self.words[a[live] + k] ^ self.words[b[live] + k]
            low = x & (~x + np.uint64(1))
            out[live] = np.where(x != 0, np.minimum(out[live], k + (np.bitwise_count(low - np.uint64(1)) >> 3)), out[live])
            k += 8
            live = live[(x == 0) & (out[live] > k)]
        return out

    def matching_statistics(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each place of the texts on end: the length of the longest string from there on that the index holds."""
        sizes = np.diff(offsets)
        texts = np.argsort(-sizes, kind="stable")
        ends, sizes = offsets[1:][texts], sizes[texts]
        out = np.zeros(len(data), np.int32)
        row, place, length = np.zeros(len(texts), _I), np.full(len(texts), self.first_sample[0]), np.zeros(len(texts), _I)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t))  # texts longer than t
            row, place, length = row[:live], place[:live], length[:live]
            at = ends[:live] - 1 - t
            symbol = data[at].astype(_I) + 1
            run = np.searchsorted(self.run_starts, row, "right") - 1
            found = self.heads[run] == symbol
            other = np.flatnonzero(~found)
            if len(other):
                c = symbol[other]
                after = np.searchsorted(self.symbol_key, c * (self.n + 1) + row[other])
                down = np.minimum(after, len(self.by_symbol) - 1)
                up = np.maximum(after - 1, 0)
                down, up = self.by_symbol[down], self.by_symbol[up]
                has_down, has_up = (after < len(self.by_symbol)) & (self.heads[down] == c), (after > 0) & (self.heads[up] == c)
                here, held = place[other], length[other]
                stay_up = np.where(has_up, self.common(here, self.last_sample[up], np.where(has_up, held, 0)), -1)
                stay_down = np.where(has_down, self.common(here, self.first_sample[down], np.where(has_down, held, 0)), -1)
                above = stay_up >= stay_down
                run[other] = np.where(above, up, down)
                jumped = has_up | has_down
                to = other[jumped]
                row[to] = np.where(above, self.run_starts[up] + self.run_sizes[up] - 1, self.run_starts[down])[jumped]
                place[to] = np.where(above, self.last_sample[up], self.first_sample[down])[jumped]
                length[other] = np.where(jumped, np.maximum(stay_up, stay_down), -1)
                found[to] = True
            # LF: the rows of the suffixes one symbol longer; an unknown symbol ends the match where the walk stands
            row[found] = self.lf[run[found]] + row[found] - self.run_starts[run[found]]
            place[found] -= 1
            length += 1
            out[at] = length
        return out

    def occurrences(self, pattern: bytes) -> int:
        """How often ``pattern`` occurs (backward search on the runs)."""
        lo, hi = 0, self.n
        starts = np.concatenate([self.run_starts, [self.n]])
        for byte in reversed(pattern):
            mine = np.flatnonzero(self.heads == byte + 1)
            if not len(mine):
                return 0
            first = self.lf[mine[0]]
            rank = lambda i, mine=mine: int(np.clip(i - starts[mine], 0, starts[mine + 1] - starts[mine]).sum())
            lo, hi = first + rank(lo), first + rank(hi)
            if lo >= hi:
                return 0
        return hi - lo


def _by_place(group: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """The removed windows of a group in which texts that share a doc_id have windows at the same places."""
    least: dict[bytes, tuple[int, int]] = {}
    windows = [(d, s + p, content[p : p + length]) for _, d, s, n, content in group for p in range(n)]
    for d, p, w in windows:
        least[w] = min(least.get(w, (d, p)), (d, p))
    return [(d, p, p + 1) for d, p, w in windows if least[w] < (d, p)]


def _decider(length: int):
    def decide(shards):
        removed, level = [], []
        for group in shards:
            node = sorted((r[1], r[2], r[3], r[4]) for r in group)
            if any(a[0] == b[0] and a[1] + a[2] > b[1] for a, b in zip(node[:-1], node[1:], strict=True)):
                removed += _by_place(group, length)
            else:
                level.append(node)
        while level:
            halves = [(node[: len(node) // 2], node[len(node) // 2 :]) for node in level]
            later = [c for _, right in halves for c in right]
            index = RunLengthIndex([c[3] for left, _ in halves for c in left])
            sizes = np.array([len(c[3]) for c in later], _I)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            statistics = index.matching_statistics(np.frombuffer(b"".join(c[3] for c in later), np.uint8), offsets)
            # windows of all later contexts on end, in runs of removed and of undecided ones
            windows = np.array([c[2] for c in later], _I)
            first = np.cumsum(windows) - windows
            owner = np.repeat(np.arange(len(later)), windows)
            p = np.arange(len(owner)) - first[owner]
            gone = statistics[offsets[owner] + p] >= length
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (gone[1:] != gone[:-1])
            begin = np.flatnonzero(new)
            left_over: list[list] = [[] for _ in later]
            for k, a, n, g in zip(owner[begin].tolist(), p[begin].tolist(), np.diff(begin, append=len(owner)).tolist(), gone[begin].tolist(), strict=True):
                d, s, _, content = later[k]
                if g:
                    removed.append((d, s + a, s + a + n))
                else:
                    left_over[k].append((d, s + a, n, content[a : a + n - 1 + length]))
            level, k = [], 0
            for left, right in halves:
                rest = [x for c in left_over[k : k + len(right)] for x in c]
                k += len(right)
                level += [node for node in (left, rest) if len(node) > 1]
        return removed

    return decide


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return C.byte_codes(data), offsets


def _contents(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    return [text[a:e] for a, e in spans]


def kind(length: int = LENGTH, hot_from: int = repeats.HOT_FROM) -> repeats.Kind:
    gram = max(1, min(32, length // 3))
    return repeats.Kind(length, gram, max(1, (length - gram) // 8), _units, _contents, _decider(length), same_document=True, hot_from=hot_from, chunk=512 << 10)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_content: bool = True, hot_from: int = repeats.HOT_FROM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, if ``with_content``, the kept bytes as ``content`` (a cut may part a character)."""

    def finish(ids, data, o, removed):
        out = []
        for k, d in enumerate(ids.tolist()):
            text = data[o[k] : o[k + 1]].tobytes()
            spans = repeats.merged(removed.get(d, []), length)
            kept, at = [], 0
            for a, e in spans:
                kept.append(text[at:a])
                at = e
            whole = b"".join(kept) + text[at:]
            out.append((None if d == -(2**63) else d, len(text), len(text) - len(whole), len(spans), hashlib.sha256(whole).hexdigest(), whole if with_content else None))
        cols = dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "content"), zip(*out, strict=True), strict=True))
        return C.batch(schema, **cols)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", content binary" * with_content
    return repeats.apply_removals(docs, kind(length, hot_from), finish, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.documents(spark, sf_dir), with_content=False)


ORACLE = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS i FROM b WHERE length(h) >= 200),
win AS (SELECT doc_id, i, md5(substr(h, i * 2 + 1, 200)) AS g FROM places),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) x WHERE k > 1),
isl AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM later),
num AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM isl),
spans AS (SELECT doc_id, n, min(i) AS a, max(i) + 100 AS e FROM num GROUP BY doc_id, n),
kept AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS h, sum(e - a) AS removed, count(*) AS n FROM (
  SELECT s.doc_id, s.a, s.e, substr(b.h, coalesce(lag(s.e) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) * 2 + 1, (s.a - coalesce(lag(s.e) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0)) * 2) AS part FROM spans s JOIN b ON s.doc_id = b.doc_id) q GROUP BY doc_id),
tail AS (SELECT s.doc_id, max(s.e) AS e FROM spans s GROUP BY s.doc_id)
SELECT b.doc_id, CAST(length(b.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(kept.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN kept.doc_id IS NULL THEN b.h ELSE kept.h || substr(b.h, tail.e * 2 + 1) END)) AS kept_sha256
FROM b LEFT JOIN kept ON b.doc_id = kept.doc_id LEFT JOIN tail ON b.doc_id = tail.doc_id
"""
