"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics (lengths, shares of byte classes, shares
of word kinds, repetition). Every class has its mean and a covariance that is shrunk
towards the pooled covariance and its diagonal; a document's score is the logistic of the
difference of the two Gaussian log-densities plus the log prior odds, the densities taken
from Mahalanobis distances by Cholesky factors that are computed once and kept.

Learning uses all labelled rows of the training fold: each task adds up counts, sums and
sums of products (a fixed number of numbers), so nothing is sampled and no row leaves its
executor. Statistics are computed once, written to the shared folder (some 150 bytes a
document) and read for learning and for scoring. Labels, language, source and id are never
inputs of a score.

Defined results: null text counts as the empty text; empty texts are scored like others;
null ids or null labels take no part in learning; without labels of both classes every
score is 0.5 (without any) or the known class's prior.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digit", "stop", "exclaim", "symbol", "bar", "newline", "non_ascii", "distinct_words", "distinct_pairs", "shouted", "odd_end", "top_word", "word_spread", "line_words")
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 digit, 3 stop, 4 exclamation, 5 symbol, 6 bar, 7 newline, 8 not ASCII, 9 small letter
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 3
_CLASS[ord("!")] = 4
_CLASS[[ord(c) for c in "#$%&*@~^_=+<>/\\{}[]`"]] = 5
_CLASS[ord("|")] = 6
_CLASS[10] = 7
_CLASS[128:] = 8
_CLASS[0x61:0x7B] = 9


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kinds = np.bincount(C.row_of(offsets) * 10 + _CLASS[data], minlength=10 * n).reshape(n, 10).astype(float)
    starts, ends, wo = C.word_bounds(data, offsets)
    words = np.diff(wo).astype(float)
    doc = C.row_of(wo)
    length = (ends - starts).astype(float)
    some, chars = np.maximum(words, 1), np.maximum(size, 1)
    sums = C.prefix_sums(C.LOWER[data])
    h = C.span_hash(sums, starts, ends)

    def distinct(values, owner):
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        edges = np.append(np.flatnonzero(new), len(v))
        top = np.zeros(n)
        np.maximum.at(top, o[edges[:-1]], np.diff(edges))
        return np.bincount(o[new], minlength=n).astype(float), top

    kinds_of_words, top = distinct(h, doc)
    pairs = C.rolled(h, 2)
    inside = doc[1:] == doc[:-1] if len(doc) > 1 else np.zeros(0, bool)
    pairs_distinct, _ = distinct(pairs[inside], doc[1:][inside])
    upper = np.concatenate([[0], np.cumsum(_CLASS[data] == 1)])
    small = np.concatenate([[0], np.cumsum(_CLASS[data] == 9)])
    shouted = (upper[ends] - upper[starts] >= 2) & (small[ends] == small[starts])
    odd = np.isin(_CLASS[data[ends - 1]], (4, 5, 6)) if len(ends) else np.zeros(0, bool)
    of = lambda x: np.bincount(doc, weights=x.astype(float), minlength=n)
    mean = of(length) / some
    share = lambda x: np.log(x + 1e-3)  # noqa: E731  bounded below, near symmetric for small shares
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(mean), share(kinds[:, 1] / chars), share(kinds[:, 2] / chars), share(kinds[:, 3] / chars), share(kinds[:, 4] / chars),
        share(kinds[:, 5] / chars), share(kinds[:, 6] / chars), share(kinds[:, 7] / chars), share(kinds[:, 8] / chars), kinds_of_words / some, pairs_distinct / np.maximum(words - 1, 1),
        share(of(shouted) / some), share(of(odd) / some), share(top / some), np.sqrt(np.maximum(of(length**2) / some - mean**2, 0)), np.log1p(words / (kinds[:, 7] + 1)),
    ])


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the statistics of ``text`` as an array ``x``."""
    d = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("_text"))
    schema = d.drop("_text").withColumn("x", F.array(F.lit(0.0))).schema

    def run(batches):
        for whole in batches:
            for b in C.slices(whole, "_text"):
                x = statistics(*C.text_bytes(b["_text"]))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), flat], names=[*keep, "x"])

    return d.mapInArrow(C.lean(run), schema)


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians with their Cholesky factors (inverted) and log determinants."""

    means: tuple
    whiten: tuple
    offset: tuple
    fixed: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        log = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offset, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def fit(rows: DataFrame, shrink: float = 0.1, ridge: float = 0.05) -> Discriminant:
    """Learn from rows (x, label 0/1). ``shrink``: weight of the pooled covariance; ``ridge``: of its diagonal."""
    k = len(FEATURES)

    def add_up(batches):
        total = np.zeros((2, 1 + k + k * k))
        for b in batches:
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            y = b["label"].to_numpy(zero_copy_only=False)
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    # one row of fixed size a task; folded on the way so that the driver sees few of them
    def fold(batches):
        total = np.zeros(2 * (1 + k + k * k))
        for b in batches:
            for v in b["sums"].to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = rows.select("x", "label").mapInArrow(C.lean(add_up), "sums binary").repartition(32).mapInArrow(C.lean(fold), "sums binary")
    total = np.sum([np.frombuffer(r["sums"]) for r in sums.collect()] or [np.zeros(2 * (1 + k + k * k))], axis=0).reshape(2, -1)
    n = total[:, 0]
    if n.min() < 2:
        return Discriminant((), (), (), fixed=0.5 if n.sum() == 0 else float((n[1] + 1) / (n.sum() + 2)))
    means = [total[c, 1 : k + 1] / n[c] for c in (0, 1)]
    own = [total[c, k + 1 :].reshape(k, k) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (own[0] * n[0] + own[1] * n[1]) / n.sum()
    base = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled)) + 1e-4 * np.eye(k)
    whiten, offset = [], []
    for c in (0, 1):
        s = shrink + (1 - shrink) * k / (k + n[c])  # few rows of a class: rely on the pooled covariance
        factor = np.linalg.cholesky((1 - s) * own[c] + s * base)
        whiten.append(np.linalg.inv(factor))
        offset.append(math.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(tuple(means), tuple(whiten), tuple(offset))


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """``rows`` with ``score`` for their ``x``."""

    def run(batches):
        for b in batches:
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            keep = [i for i, f in enumerate(b.schema) if f.name != "x"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(model.score(x))], names=[*(b.schema.field(i).name for i in keep), "score"])

    return rows.mapInArrow(C.lean(run), rows.drop("x").withColumn("score", F.lit(0.0)).schema)


def held_out(doc_id: str = "doc_id", folds: int = 5):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(statistics_of: DataFrame, labels: DataFrame) -> Discriminant:
    """``statistics_of``: (doc_id, x); rows of the held-out fold and rows without label are left out."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    return fit(statistics_of.filter(~held_out()).join(known.hint("merge"), "doc_id"))


def op10_quality_qda(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    x = C.materialise(with_statistics(C.documents(spark, sf_dir), ["doc_id"]), "op10-statistics")
    model = learn(x, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = scored(x, model)
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns.

    The model is learnt from the labelled rows among ``docs``; each text is then scored where it
    stands, so texts are not shuffled."""
    model = learn(C.materialise(with_statistics(docs, ["doc_id"]), "quality-statistics"), labels)

    def run(batches):
        for whole in batches:
            for b in C.slices(whole, "text"):
                mask = model.score(statistics(*C.text_bytes(b["text"]))) >= threshold
                yield b.filter(pa.array(mask))

    return C.keep_rows(docs, run)
