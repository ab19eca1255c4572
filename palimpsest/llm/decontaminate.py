"""Benchmark decontamination: BM25 index of the test items, block-max WAND, overlap check.

The index is inverted over test items; each passage of a training document is a query. Items
are kept in classes by length (powers of two of words): a class's passages are windows of twice
its length that move by it, so every copy of an item lies wholly in some passage, and what a
passage is for an item depends on that item alone. An item is retrieved when its BM25 score in
a passage reaches ``min_share`` of the score that the item gives itself.

Pruning is exact. An item's weakest postings, as long as they add up to less than 0.6 of its
threshold, are granted to every passage; the others are essential. Essential impacts are
divided by what is missing then, so that an item must add up to 1. All passages of a batch
are first held against the block maxima (items stand in blocks of 32): only passages in which
some block can reach 1 go on. Each of those is searched document at a time by block-max WAND:
the posting lists stand in the order of their current items; the pivot is the first
item at which the lists' maxima add up to 1; if the pivot's block maxima do not, all lists up to
it skip the block, else the pivot is scored, or the lists behind it skip to it. Retrieved items
get their full score and are verified: word 5-grams of the question part and words of the
answer part (the item's last sentence, or its last third if that sentence has under three
words) must be found in the passage.

BM25 statistics (number of items, mean length, document frequencies) are those of all items.
Items come in shards of at most ``shard_words`` words (a checked bound for what is shipped
to the executors); documents are read once for every ``_SHARDS`` shards, which a task visits in
turn. Nothing is shuffled.

Words are runs of letters and digits (any non-ASCII counts as a letter), in lower case, so
changes of case and punctuation do not hide a copy. Defined results: null or empty texts
match nothing; items without words are never found; equal items are each reported;
rows that repeat a document are reported each; a null doc_id is reported as null; other columns
are ignored or, in ``clean``, kept.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

_FOLD = C.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_BLOCK = 32
_SHARDS = 4  # shards held at a time
_REACHED = 1 - 1e-9
_GRANTED = 0.6  # share of its threshold that an item's weakest terms may make up before they count as essential
_ANSWER = 3  # words that a last sentence must have to be the answer
_SCHEMA = "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double"


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case (ASCII and Latin-1 letters); other ASCII than letters and digits as spaces."""
    out = _FOLD[data]
    if len(data) > 1:
        big = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][big] += 0x20
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = folded(data)
    starts, ends, wo = C.word_bounds(data, offsets)
    return C.span_hash(C.prefix_sums(data), starts, ends), wo


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer, or the last third of the words if that has under three.

    Of three words one may change in a copy and two thirds are still found; of two, every one would have to stay."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    if len(sentences) > 1 and len(_hashes(sentences[-1])) >= _ANSWER:
        return text[: text.rstrip().rindex(sentences[-1])], sentences[-1]
    words = text.split()
    cut = max(1, len(words) * 2 // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


@dataclass(frozen=True)
class Statistics:
    """Of all items with words: how many, their mean length, and in how many each word stands."""

    n: int
    mean: float
    df: dict[int, int]


@dataclass(frozen=True)
class Item:
    """A test item: its words, BM25 impacts, threshold, and what verifies it."""

    item_id: int
    words: np.ndarray
    impact: dict[int, float]
    threshold: float
    question: np.ndarray
    question_n: int
    answer: np.ndarray


class Postings:
    """Essential postings of items of one class of lengths, by term and by block."""

    def __init__(self, items: list[Item], stride: int) -> None:
        self.items, self.stride = items, stride
        essential = []
        for k, item in enumerate(items):
            rest, mine = 0.0, []
            for w, x in sorted(item.impact.items(), key=lambda p: (p[1], p[0])):
                if rest + x < _GRANTED * item.threshold:
                    rest += x
                else:
                    mine.append((w, x))
            essential += [(w, k, x / (item.threshold - rest)) for w, x in mine]
        essential.sort()
        words, of_item = np.array([e[0] for e in essential], np.uint64), np.array([e[1] for e in essential], np.int64)
        weight = np.array([e[2] for e in essential])
        self.terms = np.unique(words)
        term = np.searchsorted(self.terms, words)
        edges = np.searchsorted(term, np.arange(len(self.terms) + 1)).tolist()
        self.lists = [(of_item[a:e].tolist(), weight[a:e].tolist()) for a, e in zip(edges[:-1], edges[1:], strict=True)]
        # block-max: for each term, its blocks with the largest impact in each
        self.blocks = len(items) // _BLOCK + 1
        key, place = np.unique(term * self.blocks + of_item // _BLOCK, return_inverse=True)
        self.block_max = np.zeros(len(key))
        np.maximum.at(self.block_max, place, weight)
        self.block_of = key % self.blocks
        self.block_start = np.searchsorted(key // self.blocks, np.arange(len(self.terms) + 1))
        self.maxima = [dict(zip(self.block_of[a:e].tolist(), self.block_max[a:e].tolist(), strict=True)) for a, e in zip(self.block_start[:-1].tolist(), self.block_start[1:].tolist(), strict=True)]
        self.top = [max(m.values()) for m in self.maxima]

    def passages(self, h: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
        """(document, first word, end, terms) of each passage in which the block maxima of some block add up to 1."""
        if not len(self.terms) or not len(h):
            return
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == h)
        term, doc = at[hit], np.searchsorted(offsets, hit, "right") - 1
        # passages are numbered by document: passage p of a document covers words [p, p + 2) * stride
        per_doc = np.diff(offsets) // self.stride + 1
        first = np.cumsum(per_doc) - per_doc
        p = (hit - offsets[doc]) // self.stride
        before = p > 0
        passage = np.concatenate([first[doc] + p, (first[doc] + p - 1)[before]])
        term = np.concatenate([term, term[before]])
        pair = C.distinct(passage * len(self.terms) + term)
        passage, term = pair // len(self.terms), pair % len(self.terms)
        n = self.block_start[term + 1] - self.block_start[term]
        row = np.repeat(np.arange(len(term)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.block_start[term], n)
        key, group = np.unique(passage[row] * self.blocks + self.block_of[place], return_inverse=True)
        opened = np.unique(key[np.bincount(group, weights=self.block_max[place], minlength=len(key)) >= _REACHED] // self.blocks)
        lo, hi = np.searchsorted(passage, opened, "left"), np.searchsorted(passage, opened, "right")
        d = np.searchsorted(first, opened, "right") - 1
        start = offsets[d] + (opened - first[d]) * self.stride
        for k, a, end, x, y in zip(d.tolist(), start.tolist(), np.minimum(start + 2 * self.stride, offsets[d + 1]).tolist(), lo.tolist(), hi.tolist(), strict=True):
            yield k, a, end, term[x:y].tolist()

    def wand(self, terms: list[int]) -> list[int]:
        """The items whose essential impacts add up to 1 in a passage with these terms: block-max WAND."""
        lists, maxima, top = [self.lists[t] for t in terms], [self.maxima[t] for t in terms], [self.top[t] for t in terms]
        at, found = [0] * len(terms), []
        live = [(x[0][0], i) for i, x in enumerate(lists)]
        while True:
            live.sort()
            bound, pivot = 0.0, -1
            for item, i in live:
                bound += top[i]
                if bound >= _REACHED:
                    pivot = item
                    break
            if pivot < 0:
                return found
            upto = [i for item, i in live if item <= pivot]
            block = pivot // _BLOCK
            if sum(maxima[i].get(block, 0.0) for i in upto) < _REACHED:
                to = (block + 1) * _BLOCK
                if len(upto) < len(live):
                    to = min(to, live[len(upto)][0])
            elif live[0][0] == pivot:
                if sum(lists[i][1][at[i]] for i in upto) >= _REACHED:
                    found.append(pivot)
                to = pivot + 1
            else:
                to = pivot
            for i in upto:
                at[i] = bisect_left(lists[i][0], to, at[i])
            live = [(lists[i][0][at[i]], i) for _, i in live if at[i] < len(lists[i][0])]


class Index:
    """BM25 postings of items by classes of length.

    Scores rest on ``known``, the statistics of all shards' items; without it the items are all there are."""

    def __init__(self, items: list[tuple[int, str]], min_share: float, k1: float = 1.2, b: float = 0.75, known: Statistics | None = None) -> None:
        hashed = [(i, t, h) for i, t in items if len(h := _hashes(t))]
        if known is None:
            known = Statistics(len(hashed), sum(len(h) for _, _, h in hashed) / max(len(hashed), 1), Counter(w for _, _, h in hashed for w in set(h.tolist())))
        classes: dict[int, list[Item]] = {}
        for i, t, h in hashed:
            norm = k1 * (1 - b + b * len(h) / known.mean)
            own = {w: math.log(1 + (known.n - known.df[w] + 0.5) / (known.df[w] + 0.5)) * f * (k1 + 1) / (f + norm) for w, f in Counter(h.tolist()).items()}
            question, answer = (_hashes(x) for x in parts_of(t))
            size = min(5, len(question))
            item = Item(i, h, own, min_share * sum(own.values()) * (1 - 1e-9), np.unique(C.rolled(question, size)) if size else np.zeros(0, np.uint64), size, np.unique(answer))
            classes.setdefault(max(32, 1 << (len(h) - 1).bit_length()), []).append(item)
        self.classes = [Postings(classes[stride], stride) for stride in sorted(classes)]

    @property
    def items(self) -> list[Item]:
        return [item for c in self.classes for item in c.items]

    def search(self, h: np.ndarray, offsets: np.ndarray, min_question: float = 0.0, min_answer: float = 0.0) -> list[tuple[int, int, float, float, float]]:
        """(document, item_id, score, question overlap, answer overlap) of verified items, from the best passage that passes."""
        found: dict[tuple[int, int, int], tuple[float, float, float]] = {}
        for c, postings in enumerate(self.classes):
            for d, a, e, terms in postings.passages(h, offsets):
                held = None
                for k in postings.wand(terms):
                    item = postings.items[k]
                    if held is None:
                        words, grams = h[a:e], {}
                        held = set(words.tolist())
                    score = math.fsum(x for w, x in item.impact.items() if w in held)
                    if score < item.threshold:
                        continue
                    if item.question_n not in grams:
                        grams[item.question_n] = np.unique(C.rolled(words, item.question_n)) if item.question_n else np.zeros(0, np.uint64)
                    asked = float(np.isin(item.question, grams[item.question_n]).mean()) if len(item.question) else 1.0
                    told = float(np.isin(item.answer, words).mean()) if len(item.answer) else 1.0
                    if asked < min_question or told < min_answer:
                        continue  # another passage may pass, however much this one has of the other part
                    if (d, c, k) not in found or (asked + told, score) > (sum(found[d, c, k][1:]), found[d, c, k][0]):
                        found[d, c, k] = (score, asked, told)
        return [(d, self.classes[c].items[k].item_id, *v) for (d, c, k), v in sorted(found.items())]


def _measured(known: DataFrame) -> tuple[Statistics, DataFrame]:
    """Statistics of all items (text, shard) but for df, and a table (shard, w, df) with the words of each shard."""

    def lengths(batches):
        for whole in batches:
            for b in C.slices(whole, "text"):
                n = np.diff(word_hashes(*C.text_bytes(b["text"]))[1])
                yield C.batch("n long, total long", n=[int((n > 0).sum())], total=[int(n.sum())])

    def words(batches):
        for whole in batches:
            for b in C.slices(whole, "text"):
                h, o = word_hashes(*C.text_bytes(b["text"]))
                row = C.row_of(o)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                yield C.batch("shard long, w long", shard=b["shard"].take(pa.array(row[new])), w=h[new].view(np.int64))

    sums = known.select("text").mapInArrow(C.lean(lengths), "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    of_shard = known.select("text", "shard").mapInArrow(C.lean(words), "shard long, w long").groupBy("shard", "w").agg(F.count("*").alias("c"))
    table = of_shard.select("shard", "w", F.sum("c").over(Window.partitionBy("w")).alias("df"))
    n = sums[0] or 0
    return Statistics(n, (sums[1] or 0) / n if n else 1.0, {}), C.materialise(table, "item-words")


def indexes(items: DataFrame, min_share: float, shard_words: int = 2_000_000) -> Iterator[Index]:
    """One index for each shard of the items, each of bounded size; how items are dealt changes no result."""
    known = items.filter("text IS NOT NULL")
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // (4 * shard_words)))  # four characters a word or more
    known = known.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("long").alias("shard"))
    whole, words = _measured(known) if shards > 1 else (None, None)
    for s in range(shards):
        rows = known.filter(F.col("shard") == s).select("item_id", "text").orderBy("item_id", "text").collect()
        if shards > 1:
            t = words.filter(F.col("shard") == s).toArrow()
            df = dict(zip(t["w"].to_numpy().view(np.uint64).tolist(), t["df"].to_pylist(), strict=True))
            yield Index([(r[0], r[1]) for r in rows], min_share, known=replace(whole, df=df))
        else:
            yield Index([(r[0], r[1]) for r in rows], min_share)


def _held(docs: DataFrame, items: DataFrame, min_share: float, shard_words: int) -> Iterator:
    """Broadcasts of some shards' indexes, one after the other."""
    some: list[Index] = []
    for index in indexes(items, min_share, shard_words):
        some.append(index)
        if len(some) == _SHARDS:
            yield docs.sparkSession.sparkContext.broadcast(some)
            some = []
    if some:
        yield docs.sparkSession.sparkContext.broadcast(some)


def leaks(docs: DataFrame, items: DataFrame, min_share: float = 0.5, min_question: float = 0.3, min_answer: float = 0.6, shard_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, bm25, question_overlap, answer_overlap): verified items of each document."""
    out = None
    for held in _held(docs, items, min_share, shard_words):

        def run(batches, held=held):
            for whole in batches:
                for b in C.slices(whole, "text"):
                    words = word_hashes(*C.text_bytes(b["text"]))
                    rows = [r for index in held.value for r in index.search(*words, min_question, min_answer)]
                    if rows:
                        d, i, s, q, a = zip(*rows, strict=True)
                        yield C.batch(_SCHEMA, doc_id=b["doc_id"].take(pa.array(d)), item_id=i, bm25=s, question_overlap=q, answer_overlap=a)

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(C.lean(run), _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, min_share: float = 0.5, min_question: float = 0.3, min_answer: float = 0.6, shard_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no verified item, all columns unchanged."""
    for held in _held(docs, items, min_share, shard_words):

        def run(batches, held=held):
            for whole in batches:
                for b in C.slices(whole, "text"):
                    words, mask = word_hashes(*C.text_bytes(b["text"])), np.ones(b.num_rows, bool)
                    for index in held.value:
                        mask[[r[0] for r in index.search(*words, min_question, min_answer)]] = False
                    yield b.filter(pa.array(mask))

        docs = C.keep_rows(docs, run)
    return docs


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
