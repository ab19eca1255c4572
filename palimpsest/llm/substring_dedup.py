"""Substring dedup over words: suffix automata of reference shards, streamed for matching statistics.

A window is ``length`` consecutive words of one document. Every word that is covered by a
window whose words also start in a document with a smaller doc_id is removed; windows are
judged on the input.

The reference of a document is all documents before it, so it grows with the corpus and
cannot be broadcast as it stands. The shards are therefore those of ``repeats``: the
contexts (at most 2 * length - gram words) of one anchor that occurs in several documents,
sent to one task. In a shard the documents come in ascending order: each context is streamed
through the automaton of those before it, whose states know the least document they occur
in, and the words' matching statistics give the spans of windows to remove; then the context
is added. ``match_reference`` is the other use: automata of a reference of bounded size are
broadcast and whole documents stream past them.

Defined results: null or empty texts have no words; rows that share a doc_id are each
judged against smaller ids only; a null doc_id sorts before all others; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import repeats

LENGTH = 13
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class SuffixAutomaton:
    """A suffix automaton of several sequences; states keep the least owner that they occur in.

    Sequences must be added in ascending order of their owners."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [-(2**63)]

    def _state(self, length: int, owner: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.owner.append(owner)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, word) -> int:
        c = self._state(self.length[p] + 1, self.owner[q], dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, words: list, owner: int) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:  # already a state: share it, or split it where it is longer
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
                continue
            new = self._state(self.length[last] + 1, owner, {}, 0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
            last = new

    def matches(self, words: list):
        """For each word: (state, length) of the longest suffix up to it that occurs."""
        s, n = 0, 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s = self.next[s][w]
                n += 1
            yield s, n

    def earlier(self, words: list, length: int, owner: int) -> list[int]:
        """The starts of windows that occur with an owner before ``owner``."""
        found = []
        for i, (s, n) in enumerate(self.matches(words)):
            if n >= length:
                while self.length[self.link[s]] >= length:  # the state of the window itself
                    s = self.link[s]
                if self.owner[s] < owner:
                    found.append(i - length + 1)
        return found


def _spans(starts: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in starts:
        if out and out[-1][1] == s:
            out[-1][1] = s + 1
        else:
            out.append([s, s + 1])
    return [(a, e) for a, e in out]


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, wo = C.word_bounds(data, offsets)
    return C.span_hash(C.prefix_sums(data), starts, ends), wo


def _contents(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()  # bytes: at exactly [\x20\x09-\x0D]
    return [b" ".join(words[a:e]) for a, e in spans]


def _decider(length: int):
    def decide(shards):
        out = []
        for group in shards:
            automaton = SuffixAutomaton()
            for _, d, s, _, content in sorted(group, key=lambda r: (r[1], r[2])):
                words = content.split(b" ")
                out += [(d, s + a, s + e) for a, e in _spans(automaton.earlier(words, length, d))]
                automaton.add(words, d)
        return out

    return decide


def kind(length: int = LENGTH, hot_from: int = repeats.HOT_FROM) -> repeats.Kind:
    gram = max(1, min(5, length - 1))
    return repeats.Kind(length, gram, 1, _units, _contents, _decider(length), same_document=False, hot_from=hot_from)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True, hot_from: int = repeats.HOT_FROM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) and, if ``with_text``, the kept words joined by one space as ``text``."""

    def finish(ids, data, o, removed):
        out = []
        for k, d in enumerate(ids.tolist()):
            words = data[o[k] : o[k + 1]].tobytes().split()
            kept, at, gone = [], 0, 0
            for a, e in repeats.merged(removed.get(d, []), length):
                kept += words[at:a]
                at, gone = e, gone + e - a
            whole = b" ".join(kept + words[at:])
            out.append((None if d == -(2**63) else d, len(words), gone, hashlib.sha256(whole).hexdigest(), whole.decode("utf-8", "replace") if with_text else None))
        cols = dict(zip(("doc_id", "n_words", "n_removed", "kept_sha256", "text"), zip(*out, strict=True), strict=True))
        return C.batch(schema, **cols)

    schema = _OUT + ", text string" * with_text
    return repeats.apply_removals(docs, kind(length, hot_from), finish, schema)


def match_reference(docs: DataFrame, reference: DataFrame, length: int = LENGTH, shard_words: int = 50_000) -> DataFrame:
    """(doc_id, start, end): maximal word spans of ``docs`` that windows of ``reference`` texts cover.

    The reference is cut into shards of some ``shard_words`` words; the automaton of each is built once and
    broadcast, and whole documents stream past it. It is meant for references that are small beside ``docs``
    (test sets, licences): every shard reads all documents once more."""
    known = reference.filter("text IS NOT NULL")
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // (4 * shard_words)))
    schema = "doc_id long, start long, end long"
    found = None
    for k in range(shards):
        built = SuffixAutomaton()
        for r in known.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == k).select("text").distinct().collect():
            built.add(r[0].encode().split(), 0)
        held = docs.sparkSession.sparkContext.broadcast(built)

        def run(batches, held=held):
            automaton = held.value
            for b in batches:
                for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    spans = repeats.merged(_spans(automaton.earlier((t or "").encode().split(), length, 1)), length)
                    if spans:
                        yield C.batch(schema, doc_id=[d] * len(spans), start=[a for a, _ in spans], end=[e for _, e in spans])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(C.lean(run), schema)
        found = part if found is None else found.unionByName(part)
    if shards == 1:
        return found

    def join(batches):
        pdf = pa.Table.from_batches(batches).to_pylist()
        by: dict = {}
        for r in pdf:
            by.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
        rows = [(d, a, e) for d, s in by.items() for a, e in repeats.merged([(a, e) for a, e in s], 1)]
        yield C.batch(schema, doc_id=[r[0] for r in rows], start=[r[1] for r in rows], end=[r[2] - 0 for r in rows])

    return found.repartition("doc_id").mapInArrow(lambda it: join(b) if (b := list(it)) else iter(()), schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.documents(spark, sf_dir), with_text=False)


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS g FROM places),
f AS (SELECT g, min(doc_id) AS earliest FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM (SELECT win.doc_id, win.i FROM win JOIN f ON win.g = f.g WHERE f.earliest < win.doc_id) h),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT pos.doc_id, count(gone.p) AS n, string_agg(pos.word, ' ' ORDER BY pos.p) FILTER (WHERE gone.p IS NULL) AS kept FROM pos LEFT JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
