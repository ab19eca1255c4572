"""Language model, classifier, tokens, packing and decontamination."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common as C
from palimpsest.llm import decontaminate, lm_scoring, packing, quality, token_store

from .test_dedup import EDGES, frame, lower, prose


def lm_brute(rows, folds=7, held=2, deleted=3, order=3):
    texts, role = {}, {}
    for i, t in rows:
        texts[i] = [w.decode() for w in lower(t or "").encode().split()] + [None]
        r = zlib.crc32(str(i).encode()) % folds
        role[i] = 0 if r == held else 2 if r == deleted else 1
    c, f = Counter(), Counter()  # of n-grams of all orders
    trigrams = lambda t: zip([None, None, *t], [None, *t], t, strict=False)
    for i, t in texts.items():
        for u, v, w in trigrams(t):
            for g in ((w,), (v, w), (u, v, w))[:order]:
                c[g] += role[i] > 0
                f[g] += role[i] == 2
    n, v_size = sum(x for g, x in c.items() if len(g) == 1), sum(x > 0 for g, x in c.items() if len(g) == 1)
    held_n = n - sum(x for g, x in f.items() if len(g) == 1)
    level = lambda x: math.floor(2 * math.log2(x + 1) + 1e-9)

    def parts(u, v, w, first, c, n):
        """The bucket, and the four estimates; the words before a text are as frequent as ends."""
        two, one = 0 if order < 3 else c[(None,)] if first else c[u, v], c[(v,)]
        return (level(two) if two > 0 else 128 + level(one)), [1 / (v_size + 1), c[(w,)] / max(n, 1), c[v, w] / max(one, 1), c[u, v, w] / max(two, 1)]

    rest = Counter({g: c[g] - f[g] for g in c})
    seen = [parts(u, v, w, k == 0, rest, held_n) for i, t in texts.items() if role[i] == 2 for k, (u, v, w) in enumerate(trigrams(t))]
    a = [[1 / 4] * 4 for _ in range(256)]
    for _ in range(10):
        total = [[0.0] * 4 for _ in range(256)]
        for b, p in seen:
            mixed = [x * y for x, y in zip(a[b], p, strict=True)]
            for k in range(4):
                total[b][k] += mixed[k] / max(sum(mixed), 1e-300)
        every = [sum(t[k] for t in total) + 1e-3 for k in range(4)]
        smooth = [[t[k] + 3 * every[k] / sum(every) for k in range(4)] for t in total]
        a = [[x / sum(t) for x in t] for t in smooth]
    out = {}
    for i, t in texts.items():
        own = Counter(g for u, v, w in trigrams(t) for g in ((w,), (v, w), (u, v, w))[:order]) if role[i] else Counter()
        others = Counter({g: c[g] - own[g] for u, v, w in trigrams(t) for g in ((w,), (v,), (u, v), (v, w), (u, v, w), (None,))})
        mixed = [parts(u, v, w, k == 0, others, n - len(t) if role[i] else n) for k, (u, v, w) in enumerate(trigrams(t))]
        log = lambda mixed: sum(math.log10(sum(x * y for x, y in zip(a[b], p, strict=True))) for b, p in mixed)
        score = log([parts(u, v, w, k == 0, c, n) for k, (u, v, w) in enumerate(trigrams(t))]), log(mixed)
        out[i] = (role[i] == 0, len(t), sum(c[(w,)] > 0 for w in t), n, sum(math.log10((c[(w,)] + 1) / (n + v_size + 1)) for w in t), score)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scoring(spark, order):
    """Also in chunks of a few texts, so that n-grams are asked for by many chunks."""
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 40), 60).replace("w1", "W1")) for i in range(80)] + EDGES
    rows += [(500 + i, f"a gram that a third of all documents hold {prose(rng, rng.randint(0, 5), 60)}") for i in range(40)]
    want = lm_brute(rows, order=order)
    got = lm_scoring.score(frame(spark, rows, 7), order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and (r.score, r.score_without_own) == (pytest.approx(w[5][0], rel=1e-9), pytest.approx(w[5][1], rel=1e-9))


def test_lm_scores_texts_that_occur_twice_apart(spark):
    """Held out or in training: a text that another document repeats is likelier, token by token, than one that stands alone."""
    rng = random.Random(2)
    once = [(i, prose(rng, 60, 800)) for i in range(150)]
    twice = [(1000 + i, prose(rng, 60, 800)) for i in range(20)]
    rows = once + twice + [(2000 + i, t) for i, (_, t) in enumerate(twice)]
    got = {r.doc_id: r.score_without_own / r.n_tokens for r in lm_scoring.score(frame(spark, rows)).collect()}
    line = sorted(got[i] for i, _ in once)[int(0.9 * len(once))]
    trained = [i for i in got if i >= 1000 and zlib.crc32(str(i).encode()) % 7 != 2]
    assert sum(got[i] > line for i in trained) > 0.8 * len(trained)


def test_lm_edges(spark):
    assert lm_scoring.score(frame(spark, [])).count() == 0
    got = lm_scoring.score(frame(spark, [(None, "a b"), (None, None), (3, "a"), (3, "b")])).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 4), (3, 4)]


def test_lm_long_text_and_repeated_rows(spark):
    """One text longer than any slice; rows that repeat an id are pieces of one document."""
    long = "one two three " * 120_000
    rows = [(1, long), (2, "two three four"), (2, "two three four"), (4, None)]
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, rows)).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {1: 360_001, 2: 8, 4: 1}
    want = lm_brute([(1, long), (4, None)])
    alone = {r.doc_id: r.score for r in lm_scoring.score(frame(spark, [(1, long), (4, None)])).collect()}
    assert alone == {i: pytest.approx(w[5][0], rel=1e-7) for i, w in want.items()}


def test_lm_beats_base_on_held_out(spark, sf_dir):
    r = lm_scoring.op1_lm_scoring(spark, sf_dir).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_quality_held_out_accuracy(spark, sf_dir):
    d = quality.op10_quality_qda(spark, sf_dir.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    rows = d.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 30 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in d.collect())


def test_densities_against_plain_matrices(spark):
    """Scores from inverses and determinants, without Cholesky factors or running sums."""
    rng = np.random.default_rng(5)
    k, n = len(quality.FEATURES), 400
    x = np.concatenate([rng.normal(0, 1, (n, k)) @ rng.normal(0, 1, (k, k)), rng.normal(0.7, 2, (n // 4, k))])
    y = np.array([0] * n + [1] * (n // 4))
    rows = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "x array<double>, label int")
    model = quality.fit(rows, shrink=0.1, ridge=0.05)
    pooled = sum(np.cov(x[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / len(y)
    base = 0.95 * pooled + 0.05 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(k)
    log = []
    for c in (0, 1):
        own, count = np.cov(x[y == c].T, bias=True), (y == c).sum()
        s = 0.1 + 0.9 * k / (k + count)
        cov = (1 - s) * own + s * base
        gap = x - x[y == c].mean(axis=0)
        log.append(math.log(count / len(y)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))
    assert np.allclose(model.score(x), want, rtol=1e-6, atol=1e-9)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = [(k, "plain words in a row, all well" if k % 2 else "SHOUT!! $$$ ### |||") for k in range(200)] + EDGES + [(None, "x")]
    docs = frame(spark, rows)
    model = quality.learn(quality.with_statistics(docs, ["doc_id"]), labels)
    got = quality.scored(quality.with_statistics(docs, ["doc_id"]), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 200)
    kept = quality.accept(docs, labels)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 200} == set(range(1, 200, 2))
    none = quality.learn(quality.with_statistics(docs, ["doc_id"]), labels.filter("false"))
    assert {r.score for r in quality.scored(quality.with_statistics(docs, ["doc_id"]), none).collect()} == {0.5}
    assert quality.accept(frame(spark, []), labels).count() == 0


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_block_encoder_is_exact():
    path, tk = tokenizer()
    rng = random.Random(1)
    bits = ["a", "B", "é", " ", "  ", "\n", "\t", " ", "　", "'s", "12", "!!", "<|endoftext|>", "日本", "x y", "\x85", "\x1c", "\r\n", "😀", " <|endoftext|> ", "don't"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["", " ", "a", "é ", None]
    enc = token_store.BlockEncoder(path, 2)
    plain = [re.sub("[ 　\x85]", "", t or "") for t in texts]
    for batch in (texts, plain, plain, [""], [None, "a b"]):
        ids, n = enc.encode(*C.text_bytes(pa.array(batch, pa.string())))
        want = [tk.encode(t or "", add_special_tokens=False).ids + [2] for t in batch]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_wavelet_matrix(tmp_path):
    v = np.random.default_rng(0).integers(0, 50257, 3000).astype(np.uint32)
    v[::3] = 7
    path = str(tmp_path / "x.pwm")
    token_store.write_file(path, token_store.to_file_bytes(v, np.array([5, 9]), np.array([1000, 2000]), 16))
    s = token_store.ShardFile(path)
    assert (s.matrix.decode() == v).all() and s.doc_ids.tolist() == [5, 9] and s.document(0) == v[:1000].tolist()
    where = np.flatnonzero(v == 7)
    assert s.matrix.count(7) == len(where) and s.matrix.rank(7, 1234) == (where < 1234).sum() and s.matrix.count(50256) == (v == 50256).sum()
    assert [s.matrix.select(7, k) for k in (0, 10, len(where) - 1, len(where))] == [where[0], where[10], where[-1], -1]
    with pytest.raises(ValueError):
        (tmp_path / "y").write_bytes(b"none of ours")
        token_store.ShardFile(str(tmp_path / "y"))


def test_token_store_round_trip(spark, tmp_path):
    path, tk = tokenizer()
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 30))) for i in range(100)] + EDGES
    m = C.materialise(token_store.write_shards(frame(spark, rows), str(tmp_path), path, shard_tokens=200), "manifest")
    assert m.count() >= 4
    got = sorted(token_store.read_documents(m).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, (i, t) in zip(got, sorted(rows), strict=True):
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = C.materialise(token_store.write_shards(frame(spark, []), str(tmp_path / "e"), path), "manifest")
    assert token_store.read_documents(empty).count() == 0


def test_packing(spark):
    path, tk = tokenizer()
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 5, 100, 511, 512, 900, 3000, 9000])) for i in range(200)] + EDGES + [(None, "a"), (7, "again"), (7, "again"), (9000, "long text " * 900_000)]
    packed = packing.pack(packing.encoded(frame(spark, rows), path), group_tokens=200_000)
    bins, ids = {}, {}
    for r in packed.collect():
        bins.setdefault(r.bin_id, []).append(r)
        ids.setdefault(r.doc_id, []).append((r.piece, r.n_tokens, bytes(r.ids)))
    for b in bins.values():
        b.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in b:
            assert r.bin_offset == at and len(r.ids) == 2 * r.n_tokens
            at += r.n_tokens
        assert at == b[0].bin_used <= b[0].bin_capacity
        assert b[0].bin_capacity == min(c for c in packing.CAPACITIES if c >= at)
    one = lambda t: np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u2").tobytes()
    for i, t in rows:
        if i != 7:
            assert [p for p, _, _ in sorted(ids[i])] == list(range(len(ids[i]))) and b"".join(x for _, _, x in sorted(ids[i])) == one(t), i
    texts = sorted([one("w " * 0) if rows[7][1] == "" else one(rows[7][1]), one("again"), one("again")])
    assert sorted(x for _, n, x in ids[7] if n < 100) == [x for x in texts if len(x) < 200]
    for r in packing.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(bytes(x.ids) for x in bins[r.bin_id]) and sum(r.lengths) == r.used and r.doc_ids == [x.doc_id for x in bins[r.bin_id]]
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def total_cost(packing_of):
    return sum(packing.cost(int(c)) for c in packing_of[2])


def cheapest(lengths, sizes):
    """By trying every way to part the pieces."""
    best = [math.inf]

    def go(k, sums):
        price = sum(packing.cost(min(c for c in sizes if c >= s)) for s in sums)
        if price >= best[0]:
            return
        if k == len(lengths):
            best[0] = price
            return
        for j in range(len(sums)):
            if sums[j] + lengths[k] <= sizes[-1]:
                go(k + 1, [*sums[:j], sums[j] + lengths[k], *sums[j + 1 :]])
        go(k + 1, [*sums, lengths[k]])

    go(0, [])
    return best[0]


def test_packing_is_near_the_optimum():
    rng = random.Random(15)
    ratios = []
    for _ in range(150):
        n = np.array([rng.choice([rng.randint(1, 500), rng.randint(300, 1200), rng.randint(1, 4096)]) for _ in range(rng.randint(1, 8))])
        ratios.append(total_cost(packing.pack_pieces(n)) / cheapest(n.tolist(), sorted(packing.CAPACITIES)))
    assert min(ratios) >= 1 - 1e-12 and max(ratios) < 1.25 and sum(ratios) / len(ratios) < 1.02


def test_sizes_are_chosen_jointly():
    """The size opened depends on what waits; never dearer than the best single size; several sizes are used."""
    sizes = sorted(packing.CAPACITIES)
    assert packing.best_fit(np.array([600] * 30), sizes)[2][0] != packing.best_fit(np.array([600] + [400] * 30), sizes)[2][0]
    rng = random.Random(16)
    for low, high in ((1, 60), (50, 900), (500, 700), (600, 3000), (300, 1500), (1, 4096)):
        n = np.array([rng.randint(low, high) for _ in range(3000)])
        got = total_cost(packing.pack_pieces(n))
        alone = [total_cost(packing.best_fit(n, sizes, only)) for only in sizes]
        assert got <= min(alone) and got <= total_cost(packing.best_fit(n, sizes))
        if (low, high) not in ((1, 60), (1, 4096)):
            assert got < min(alone) and len(set(packing.pack_pieces(n)[2].tolist())) > 1
    assert packing.pack_pieces(np.zeros(0, np.int64))[2].tolist() == []


def test_best_fit_choices():
    bins, offsets, capacity, used = packing.pack_pieces(np.array([6, 4, 3, 7]), (10, 20))
    assert sorted(used.tolist(), reverse=True) == used.tolist() or used.sum() == 20
    assert all(c in (10, 20) for c in capacity) and (used <= capacity).all()
    o = packing.OpenBins(100)
    o.put(1, 30)
    o.put(2, 20)
    assert o.best(15) == (2, 20) and o.best(15) == (1, 30) and o.best(15) is None


def leaks_brute(items, texts, min_share=0.5, min_question=0.0, min_answer=0.0, k1=1.2, b=0.75):
    """(document, item, score, question overlap, answer overlap) from strings alone: every passage against every item."""
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    known = {i: words(t) for i, t in items if t and words(t)}
    df, mean = Counter(w for x in known.values() for w in set(x)), sum(map(len, known.values())) / max(len(known), 1)
    five = lambda x, n: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
    out = []
    for i, t in items:
        if i not in known:
            continue
        x = known[i]
        impact = {w: math.log(1 + (len(known) - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(x) / mean)) for w, f in Counter(x).items()}
        threshold = min_share * sum(impact.values()) * (1 - 1e-9)
        sentences = [y for y in re.split(r"(?<=[.!?])\s+", t.strip()) if y]
        if len(sentences) > 1 and len(words(sentences[-1])) >= 3:
            question, answer = words(" ".join(sentences[:-1])), words(sentences[-1])
        else:
            cut = max(1, len(t.split()) * 2 // 3)
            question, answer = words(" ".join(t.split()[:cut])), words(" ".join(t.split()[cut:]))
        stride = 32
        while stride < len(x):
            stride *= 2
        n = min(5, len(question))
        for d, text in enumerate(texts):
            h, best = words(text), None
            for p in range(len(h) // stride + 1):
                w = h[p * stride : (p + 2) * stride]
                score = sum(v for u, v in impact.items() if u in set(w))
                if score < threshold:
                    continue
                asked = len(five(question, n) & five(w, n)) / len(five(question, n)) if n else 1.0
                told = len(set(answer) & set(w)) / len(set(answer)) if answer else 1.0
                if asked >= min_question and told >= min_answer and (best is None or (asked + told, score) > (best[1] + best[2], best[0])):
                    best = (score, asked, told)
            if best:
                out.append((d, i, *best))
    return sorted(out)


def same_leaks(got, want):
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for x, y in zip(got, want, strict=True):
        assert x[2:] == pytest.approx(y[2:], rel=1e-9)


@pytest.mark.parametrize("limits", [(0.0, 0.0), (0.3, 0.6)])
def test_wand_finds_what_scoring_everything_finds(limits):
    """Near copies at all distances, equal items, items of one word and of several lengths, documents without words."""
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(3, 80), 200) + rng.choice(["", ". " + prose(rng, rng.randint(1, 6), 200) + "."])) for k in range(90)]
    items += [(200, items[0][1]), (201, "w7"), (202, "..."), (203, "")]
    near = lambda t, p: " ".join(w if rng.random() > p else "zz" for w in t.split())
    texts = [f"{prose(rng, rng.randint(0, 200), 200)} {near(rng.choice(items[:90])[1], rng.random() * 0.7)} {prose(rng, rng.randint(0, 90), 200)}" for _ in range(100)] + ["", "w7", "!"]
    h, o = decontaminate.word_hashes(*C.text_bytes(pa.array(texts)))
    got = decontaminate.Index(items, 0.5).search(h, o, *limits)
    same_leaks(sorted(got), leaks_brute(items, texts, 0.5, *limits))
    assert len(got) > 60


def test_nothing_is_found_without_wand(monkeypatch):
    items = [(1, "one two three four five six. seven eight nine ten.")]
    h, o = decontaminate.word_hashes(*C.text_bytes(pa.array([items[0][1]])))
    assert len(decontaminate.Index(items, 0.5).search(h, o)) == 1
    monkeypatch.setattr(decontaminate.Postings, "wand", lambda self, terms: [])
    assert decontaminate.Index(items, 0.5).search(h, o) == []


def test_near_copies_and_near_misses(spark):
    """One word in eight replaced is a copy; two in three replaced, or the question's topic words alone, is none."""
    rng = random.Random(10)
    items = [(k, f"{prose(rng, 40, 3000).capitalize()}. {prose(rng, 9, 3000)}.") for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    change = lambda t, every, at: " ".join(f"z{j}" if j % every != at else w for j, w in enumerate(t.split()))
    copies = [(k, f"{prose(rng, 60, 3000)} " + " ".join("zz" if j % 8 == k % 8 else w for j, w in enumerate(t.split())) + f" {prose(rng, 60, 3000)}") for k, t in items]
    misses = [(100 + k, f"{prose(rng, 60, 3000)} {change(t, 3, k % 3)}") for k, t in items]
    shuffled = [(200 + k, " ".join(rng.sample(t.split(), len(t.split())))) for k, t in items]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, copies + misses + shuffled), bench).collect()}
    assert got == {(k, k) for k in range(40)}


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(k, f"{prose(rng, 20, 500).capitalize()}. {prose(rng, 8, 500)}.") for k in range(30)] + [(100, None), (101, ""), (102, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = [(i, prose(rng, rng.randint(0, 300), 500)) for i in range(60)] + EDGES
    leaked = []
    for k in range(30):
        t = items[k][1]
        t = t.upper().replace(".", " !") if k % 3 == 0 else t.replace(" ", "\n") if k % 3 == 1 else t
        leaked.append((1000 + k, f"{prose(rng, rng.randint(0, 150), 500)} {t} {prose(rng, rng.randint(0, 150), 500)}"))
    docs = frame(spark, clean + leaked)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1000 + k, k) for k in range(30)}
    kept = decontaminate.clean(docs, bench)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in clean)
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.clean(docs, bench.filter("false")).count() == len(clean) + 30


def test_passage_that_fails_hides_none_that_passes(spark):
    """A document quotes the question without its answer and holds a near copy of both further on."""
    rng = random.Random(6)
    question, answer = [f"q{k}" for k in range(40)], [f"a{k}" for k in range(8)]
    bench = spark.createDataFrame([(k, f"{prose(rng, 40, 500).capitalize()}. {prose(rng, 8, 500)}.") for k in range(20)] + [(77, f"{' '.join(question)}. {' '.join(answer)}.")], "item_id long, text string")
    quote = " ".join([*question, *answer[:4]])
    copy = " ".join(f"z{k}" if k % 8 == 7 else w for k, w in enumerate(question + answer))
    gap = prose(rng, 400, 500)
    docs = frame(spark, [(1, f"{quote} {gap} {copy}"), (2, f"{copy} {gap} {quote}"), (3, f"{quote} {gap}"), (4, copy)])
    got = {r.doc_id: r for r in decontaminate.leaks(docs, bench).collect()}
    assert sorted(got) == [1, 2, 4] and {r.item_id for r in got.values()} == {77}
    assert all(r.question_overlap >= 0.3 and r.answer_overlap >= 0.6 for r in got.values())
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [3]


def test_last_sentence_of_two_words(spark):
    """A near copy may lose one of the last two words; three words and more are an answer of their own."""
    rng = random.Random(8)
    items = [(k, f"{prose(rng, 40, 500).capitalize()}. Be in{k}.") for k in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    copies = [(k, t.replace(f"in{k}.", "zz") if k % 2 else t.replace("Be ", "zz ")) for k, t in items]
    docs = frame(spark, copies + [(100 + k, prose(rng, 200, 500)) for k in range(20)])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(k, k) for k in range(10)}
    assert decontaminate.parts_of("One two three. Four five six.") == ("One two three. ", "Four five six.")


def test_index_shards(spark):
    """However items are dealt to shards, every row is the same, scores included; uneven lengths, near copies around the threshold."""
    rng = random.Random(9)
    items = [(k, f"{prose(rng, rng.randint(3, 60) if k else 150, 300).capitalize()}. {prose(rng, 5, 300)}.") for k in range(60)] + [(k, t) for k, t in ((90, None), (91, "..."), (92, ""))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = lambda t, p: " ".join(w if rng.random() > p else "zz" for w in t.split())
    texts = [f"{prose(rng, rng.randint(0, 200), 300)} {near(items[k % 60][1], rng.random() * 0.7)} {prose(rng, 90, 300)}" for k in range(200)]
    docs = frame(spark, list(enumerate(texts)))
    size = sum(len(t or "") for _, t in items)
    rows = {}
    for shards in (1, 2, 16):
        assert len(list(decontaminate.indexes(bench, 0.5, shard_words=-(-size // (4 * shards))))) == shards
        rows[shards] = sorted(tuple(r) for r in decontaminate.leaks(docs, bench, 0.5, 0.0, 0.0, shard_words=-(-size // (4 * shards))).collect())
    assert rows[1] == rows[2] == rows[16] and len(rows[1]) > 60
    same_leaks(rows[1], leaks_brute(items, texts))
    kept = [sorted(r.doc_id for r in decontaminate.clean(docs, bench, shard_words=w).collect()) for w in (2_000_000, size // 40)]
    assert kept[0] == kept[1]


def test_a_long_item_moves_no_other_items_passages(spark):
    rng = random.Random(13)
    items = [(k, f"{prose(rng, 40, 400).capitalize()}. {prose(rng, 8, 400)}.") for k in range(30)]
    texts = [f"{prose(rng, rng.randint(0, 300), 400)} {items[k][1]} {prose(rng, rng.randint(0, 300), 400)}" for k in range(30)]
    docs = frame(spark, list(enumerate(texts)))
    found = []
    for extra in ([], [(99, " ".join(f"long{k}" for k in range(5000)))]):
        bench = spark.createDataFrame(items + extra, "item_id long, text string")
        found.append(sorted((r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in decontaminate.leaks(docs, bench).collect()))
    assert found[0] == found[1] and len(found[0]) >= 30


def test_decontamination_edges(spark):
    """Repeated rows, null ids, equal items, one text longer than any slice."""
    rng = random.Random(14)
    item = f"{prose(rng, 40, 400).capitalize()}. {prose(rng, 8, 400)}."
    bench = spark.createDataFrame([(1, item), (2, item), (3, None)], "item_id long, text string")
    long = "plain filler words " * 500_000
    docs = frame(spark, [(None, item), (5, item), (5, item), (6, long + item), (7, long), (8, None)])
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert got == {(None, 1): 1, (None, 2): 1, (5, 1): 2, (5, 2): 2, (6, 1): 1, (6, 2): 1}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [7, 8]
