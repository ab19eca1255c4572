"""Vector codes against a plain version that evaluates every entry in Python's integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import vector_codes as V

from ..oracle import connect, same_rows

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).withColumns({"codes": F.lit("clash"), "v": F.lit(1), "error": F.lit(2)}).repartition(3)


def plain(rows, parts=8, entries=16, rounds=6):
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    lengths = [len(r[1]) for r in good]
    d = min(set(lengths), key=lambda n: (-lengths.count(n), n), default=0)
    good = sorted((r for r in good if len(r[1]) == d), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = -(-d // parts)
    q = [[math.floor(4096 * x) for x in r[1]] + [0] * (parts * w - d) for r in good]
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for v in q[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for v in q:
                held[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, members in held.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for r, v in zip(good, q, strict=True):
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = min(sum(f[0] for f in found), 2**63 - 1)
        by[r[2]] += error
        out.append((r[0], "".join(f"{f[1]:02x}" for f in found), error, r[2]))
    return sorted((i, c, e, min(by[k], 2**63 - 1), sha) if i is not None else (-1, c, e, min(by[k], 2**63 - 1), sha) for i, c, e, k in out)


def ours(df):
    codes, books = V.compress(df)
    rows = codes.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error").collect()
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, V.digest(books)) for r in rows)


def f32(v):
    return [None if x is None else float(np.float32(x)) for x in v]


def test_agrees_with_duckdb(spark, sf_dir):
    same_rows(V.op12_vector_codes(spark, sf_dir), connect(sf_dir), V.ORACLE)


def test_edges(spark):
    rng = random.Random(3)
    vec = lambda n=16: f32([rng.gauss(0, 0.3) for _ in range(n)])
    rows = [(i, vec(), rng.choice([0, 1, None])) for i in range(60)]
    rows += [(i, rows[5][1], 2) for i in range(100, 160)]  # one very common vector
    rows += [(3, vec(), 1), (3, vec(), 1), rows[7], (None, vec(), None), (None, vec(), 1)]  # repeated ids and rows, null ids
    bad = [(500, None, 1), (501, [], 1), (502, [None] * 16, 1), (503, [NAN] + [0.0] * 15, 1), (504, [INF] * 16, None), (505, [-INF] + [0.0] * 15, 1), (506, vec(15), 1)]
    assert ours(frame(spark, rows + bad)) == plain(rows)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, f32([v] * 8), 0) for i, v in enumerate([1, -1, 1, 0, 2, -2, 0, 0.5, -0.5, 3, -3, 0.25, 0, 0, 1, 1])] + [(100 + i, f32([0.0] * 8), 1) for i in range(20)]
    assert ours(frame(spark, rows)) == plain(rows)


def test_numbers_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = [(i, f32([rng.choice([1, -1, 3e38, -2.5e38, 1e20, 0.1]) for _ in range(8)]), i % 2) for i in range(40)]
    assert ours(frame(spark, rows)) == plain(rows)


@pytest.mark.parametrize("d", [1, 5, 8, 20])
def test_lengths_that_parts_do_not_divide(spark, d):
    rng = random.Random(d)
    rows = [(i, f32([rng.gauss(0, 1) for _ in range(d)]), i % 3) for i in range(30)]
    assert ours(frame(spark, rows)) == plain(rows)


def test_few_and_no_rows(spark):
    rows = [(7, f32(range(8)), 1), (2, f32(range(8, 16)), None)]
    assert ours(frame(spark, rows)) == plain(rows)
    assert ours(frame(spark, [])) == []


def test_annulus_leaves_most_entries_out(spark, monkeypatch):
    """Only entries within the annulus are evaluated, and never too few of them."""
    rng = np.random.default_rng(5)
    book = V.Codebook([[int(v) for v in rng.normal(0, 50 * (1 + k), 8)] for k in range(16)])
    x = np.concatenate([rng.normal(0, s, (200, 8)) for s in (10, 200, 800)]).astype(np.int64)
    index, best = book.nearest(x, 8)
    want = book._plain(x)
    assert index.tolist() == want[0].tolist() and best.tolist() == want[1].tolist()
    seen = []
    real = book.sorted

    class Counted:
        def __getitem__(self, at):
            seen.append(len(at))
            return real[at]

    book.sorted = Counted()
    book.nearest(x, 8)
    assert sum(seen) < 0.6 * 16 * len(x)
