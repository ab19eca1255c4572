"""Deduplication operators against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, jaccard_join, line_dedup, substring_dedup, suffix_dedup
from palimpsest.llm import common as C

WHITE = " \t\n\x0b\x0c\r"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("clash"), "n": F.lit(7), "key": F.lit(1)}).repartition(parts)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def prose(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


EDGES = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "é" * 3000), (9005, "word " * 4000), (9006, "a b"), (9007, "a  b"), (9008, "A B")]


def test_exact_dedup(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["", "x", "y\n", "é", None, "long " * 50])) for i in range(60)] + EDGES
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.memberships(frame(spark, rows)).collect()}
    assert got == {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), sha(t or "")) for i, t in rows}
    df = frame(spark, rows)
    kept = exact_dedup.deduplicate(df)
    assert kept.schema == df.schema and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert {r.doc_id: r.text for r in kept.collect()}.items() <= dict(rows).items()


def test_exact_dedup_spills(spark):
    """A table of a few bytes: everything goes through several levels of spill files."""
    rng = random.Random(2)
    texts = [f"text {k} " * 5 for k in range(300)]
    rows = [(hashlib.sha256(t.encode()).digest(), i, 1, t.encode(), None) for i, t in enumerate(rng.choice(texts) for _ in range(2000))]
    got = {s[3]: (s[1], s[2]) for s in exact_dedup.grace(iter(rows), table_bytes=500)}
    want = {}
    for _, i, _, t, _ in rows:
        last, n = want.get(t, (-1, 0))
        want[t] = (max(last, i), n + 1)
    assert got == want


def test_exact_dedup_compares_contents():
    """Equal hashes of unequal texts stay apart, also beyond all hash bits."""
    h = bytes(32)
    rows = [(h, k, 1, b"%d" % (k % 7) * 100, None) for k in range(100)]
    got = sorted((s[3], s[2]) for s in exact_dedup.grace(iter(rows), table_bytes=1 << 20))
    assert [n for _, n in got] == [15, 15, 14, 14, 14, 14, 14]


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b")]
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in exact_dedup.memberships(frame(spark, rows)).collect())
    assert got == [(-1, -1, 1), (-1, 1, 3), (1, 1, 3), (1, 1, 3)]
    assert exact_dedup.deduplicate(frame(spark, rows)).count() == 2
    clash = frame(spark, rows).withColumns({c: F.lit(c) for c in ("_null", "null_text", "row", "c0", "c1", "others", "keep_id", "a.b")})
    kept = exact_dedup.deduplicate(clash)
    assert kept.schema == clash.schema and {(r["_null"], r["a.b"], r["n"]) for r in kept.collect()} == {("_null", "a.b", 7)}
    assert exact_dedup.memberships(frame(spark, [])).count() == 0 and exact_dedup.deduplicate(frame(spark, [])).count() == 0


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = [f"This is the common line number {k}" for k in range(6)] + ["short", "", " \tPADDED common line, twenty+ \r"] + ["exactly twenty chars" [:20], "nineteen characters"]
    rows = [(i, "\n".join(rng.choice(lines).upper() if rng.random() < 0.3 else rng.choice(lines) for _ in range(rng.randint(0, 8)))) for i in range(50)] + EDGES
    rows += [(8000 + k, "line with\x0bvertical and é accents inside\n\n") for k in range(3)]
    holders = defaultdict(set)
    key = lambda x: lower(x.strip(WHITE))
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    want = {}
    for i, t in rows:
        x = (t or "").split("\n")
        kept = [y for y in x if not (len(key(y)) >= 20 and len(holders[key(y)]) >= 3 and max(holders[key(y)]) != i)]
        want[i] = (len(x), len(x) - len(kept), sha("\n".join(kept)), "\n".join(kept))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256, r.text) for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect()}
    assert got == want
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0
    assert line_dedup.drop_repeated_lines(frame(spark, [(None, "x" * 30)] * 4)).count() == 4


def jaccard_brute(rows):
    sets = {}
    for i, t in rows:
        w = [x.decode() for x in lower(t or "").encode().split()]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n):
    """Copies at all distances, so that many pairs stand near the threshold."""
    rng = random.Random(seed)
    bases = [prose(rng, rng.randint(5, 60)).split() for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(w) // 8))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        if rng.random() < 0.3:
            w = w[: rng.randint(1, len(w))]
        rows.append((i, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = near_copies(seed, 200) + EDGES
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(frame(spark, rows)).collect()}
    assert got == jaccard_brute(rows)


def test_jaccard_without_rounds(spark):
    """The last step alone finds the same: no link depends on the choice of leaders."""
    rows = near_copies(3, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(frame(spark, rows), rounds=0).collect()}
    assert got == jaccard_brute(rows)


def test_jaccard_edges(spark):
    assert jaccard_join.near_components(frame(spark, [])).count() == 0
    same = [(k, "one two three four five six seven") for k in range(20)] + [(5, "one two three four five six seven"), (None, "one two three four five six seven"), (None, None)]
    got = jaccard_join.near_components(frame(spark, same)).collect()
    assert len(got) == 23 and {r.component_id for r in got if r.n_shingles} == {None}
    kept = jaccard_join.keep_first(frame(spark, [r for r in same[:20]] + [(100, "quite another text of several words here")]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 100]


def test_masked_product_of_blocks():
    import numpy as np

    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64)) for _ in range(4)]
    sets = []
    for k in range(40):
        some = base[k % 4][rng.random(60) < 0.9]
        sets.append(np.unique(np.concatenate([some, rng.integers(0, 2**64, rng.integers(0, 12), dtype=np.uint64)])))
    block = lambda x: (np.concatenate(x), np.concatenate([[0], np.cumsum([len(y) for y in x])]))
    leaders, rows = sets[:15], sets[15:]
    mask = [(r, c) for r in range(len(rows)) for c in range(len(leaders)) if rng.random() < 0.6]
    row, leader = (np.array(x) for x in zip(*mask, strict=True))
    live = jaccard_join.overlaps(block(leaders), block(rows), row, leader)
    both = lambda r, c: len(np.intersect1d(rows[r], leaders[c]))
    want = [k for k, (r, c) in enumerate(mask) if 100 * both(r, c) >= 75 * (len(rows[r]) + len(leaders[c]) - both(r, c))]
    assert live.tolist() == want and 10 < len(want) < len(mask) - 10


def test_links_are_those_of_the_product(spark):
    import numpy as np

    rows = near_copies(5, 40)
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(40) if a != b], "a long, b long")
    seen = jaccard_join.scan(frame(spark, rows), 3).filter("kind = 0").select("doc_id", "f1", "f2")
    sets = jaccard_join.sets_of(frame(spark, rows), seen, 3)
    got = {(r.a, r.b) for r in jaccard_join.links_among(pairs, sets, 3).collect()}
    held = {r.doc_id: set(np.frombuffer(r.grams, np.uint64).tolist()) for r in sets.collect()}
    assert got == {(a, b) for a in held for b in held if a != b and held[a] and 100 * len(held[a] & held[b]) >= 75 * len(held[a] | held[b])} and got


def test_jaccard_hot_columns_and_leaders(spark, monkeypatch):
    """A gram in a third of all documents, tables of frequent shingles of one entry, blocks and columns that must be split."""
    monkeypatch.setattr(jaccard_join, "_HOT_MOST", 1)
    monkeypatch.setattr(jaccard_join, "_LEADER_ENTRIES", 4)
    monkeypatch.setattr(jaccard_join, "_HOLDERS", 3)
    rng = random.Random(12)
    rows = near_copies(4, 100) + [(500 + k, f"one passage that very many texts hold {prose(rng, rng.randint(0, 3), 9)}") for k in range(60)]
    for rounds in (0, 2):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(frame(spark, rows), rounds=rounds).collect()}
        assert got == jaccard_brute(rows)


def test_jaccard_document_on_several_texts(spark):
    """The largest set speaks for the document; its other texts' rows are in the same component."""
    long, other = [" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 40), ("b", 20))]
    rows = [(1, other), (5, long), (5, other), (5, long), (7, long + " z"), (8, other + " z"), (9, other)]
    for parts in (1, 5):
        got = sorted(tuple(r) for r in jaccard_join.near_components(frame(spark, rows, parts)).collect())
        assert got == [(1, 16, 1), (5, 16, 1), (5, 36, 5), (5, 36, 5), (7, 37, 5), (8, 17, 1), (9, 16, 1)]


def test_components_over_several_parts(spark):
    """A path, a star and a ring whose edges lie in many parts."""
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(7, 7)]
    random.Random(2).shuffle(edges)
    want = {v: 0 for v in range(41)} | {v: 100 for v in range(100, 130)} | {v: 200 for v in range(200, 209)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.v: r.root for r in got} == want
    assert jaccard_join.components(spark.createDataFrame([(3, 3)], "a long, b long")) is None


def test_chain_of_links(spark):
    """Links that form a path of many steps end in one component."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k * 3 : k * 3 + 40])) for k in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(frame(spark, rows)).collect()}
    assert got == jaccard_brute(rows) and len({c for _, c in got.values()}) == 1


def words_brute(rows, length):
    first, words = {}, {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def bytes_brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice(["aa", "b", "ccc", "é"]) for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(shared) if rng.random() < 0.7 else prose(rng, rng.randint(1, 9)) for _ in range(rng.randint(0, 12))]
        rows.append((i, rng.choice(["", " "]) + rng.choice([" ", "\n"]).join(parts)))
    return rows + [(1000, "a" * 3000), (1001, "a" * 300), (1002, None), (1003, "ab " * 300), (1004, "ab " * 300), (1005, ""), (1006, "é" * 200)]


@pytest.mark.parametrize(("length", "hot"), [(13, 256), (13, 3), (6, 2), (1, 256), (2, 256)])
def test_substring_dedup(spark, length, hot):
    rows = passages(length)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows), length, hot_from=hot).collect()}
    assert got == words_brute(rows, length)


@pytest.mark.parametrize(("length", "hot"), [(100, 256), (100, 3), (20, 2), (33, 256)])
def test_suffix_dedup(spark, length, hot):
    rows = passages(length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, rows), length, hot_from=hot).collect()}
    assert got == bytes_brute(rows, length)


def joined_bytes_brute(rows, length):
    """Rows that share a doc_id are one document: a place that is removed in one is removed in all."""
    windows = [((-(2**63) if i is None else i, k), (t or "").encode()[k : k + length]) for i, t in rows for k in range(len((t or "").encode()) - length + 1)]
    least = {}
    for at, w in windows:
        least[w] = min(least.get(w, at), at)
    gone = defaultdict(set)
    for (d, k), w in windows:
        if least[w] < (d, k):
            gone[d].update(range(k, k + length))
    return [(i, sha(bytes(x for k, x in enumerate((t or "").encode()) if k not in gone[-(2**63) if i is None else i]))) for i, t in rows]


def test_suffix_dedup_repeated_rows_and_null_ids(spark):
    rng = random.Random(11)
    shared = [prose(rng, 30) for _ in range(3)]
    rows = [(k % 5, f"{rng.choice(shared)} {prose(rng, 9)} {rng.choice(shared)}") for k in range(12)] + [(7, shared[0])] * 3 + [(8, shared[0] + shared[0]), (9, shared[1] * 3)]
    for extra in ([], [(None, shared[2])]):
        got = suffix_dedup.remove_repeats(frame(spark, rows + extra), 30, hot_from=4).collect()
        assert sorted(((r.doc_id, r.kept_sha256) for r in got), key=str) == sorted(joined_bytes_brute(rows + extra, 30), key=str)


def test_removed_text_and_edges(spark):
    r = {x.doc_id: x for x in substring_dedup.remove_repeats(frame(spark, [(1, "a b c d e"), (2, "x a b c y"), (None, "a b c")]), 3).collect()}
    assert r[1].text == "d e" and r[2].text == "x y" and r[None].n_removed == 0
    r = {x.doc_id: bytes(x.content) for x in suffix_dedup.remove_repeats(frame(spark, [(1, "abcdefgh12345"), (2, "zzabcdefghzz")]), 8).collect()}
    assert r == {1: b"abcdefgh12345", 2: b"zzzz"}
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0 and suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_texts_longer_than_any_slice(spark):
    """Two million bytes in one row, twice: line, word and byte deduplication and the n-gram join."""
    rng = random.Random(21)
    long = "\n".join(prose(rng, 12, 5000) for _ in range(30_000))
    rows = [(1, long), (2, "head " + long), (3, "short text of its own here")]
    assert len(long) > 3 << 19
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows), with_text=False).collect()}
    n = len(long.split())
    assert words == {1: (n, 0), 2: (n + 1, n), 3: (6, 0)}
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(frame(spark, rows), with_content=False).collect()}
    assert cut == {1: (len(long), 0, 0), 2: (len(long) + 5, len(long), 1), 3: (26, 0, 0)}
    near = {r.doc_id: r.component_id for r in jaccard_join.near_components(frame(spark, rows)).collect()}
    assert near == {1: 1, 2: 1, 3: 3}
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.drop_repeated_lines(frame(spark, [*rows, (4, long)])).collect()}
    # the first line of document 2 begins with another word, so that line stands in two documents only, and stays
    assert lines[1] == (30_000, 29_999) and lines[4] == (30_000, 0) and lines[2] == (30_000, 29_999)
    kept = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.memberships(frame(spark, [*rows, (4, long)])).collect()}
    assert kept == {1: (4, 2), 2: (2, 1), 3: (3, 1), 4: (4, 2)}


def test_match_reference(spark):
    reference = spark.createDataFrame([("alpha beta gamma delta epsilon",), (None,), ("one two three four",)], "text string")
    docs = frame(spark, [(1, "x beta gamma delta y"), (2, "one two"), (3, None), (4, "zero one two three four alpha beta gamma")])
    want = {(1, 1, 4), (4, 1, 5), (4, 5, 8)}
    for shard in (50_000, 1):
        got = {(r.doc_id, r.start, r.end) for r in substring_dedup.match_reference(docs, reference, 3, shard_words=shard).collect()}
        merged = {(1, 1, 4), (4, 1, 8)}
        assert got in (want, merged)


def test_suffix_automaton():
    rng = random.Random(4)
    for _ in range(200):
        seqs = [[rng.choice("ab") for _ in range(rng.randint(0, 12))] for _ in range(4)]
        a = substring_dedup.SuffixAutomaton()
        for owner, s in enumerate(seqs):
            want = [k for k in range(len(s) - 2) if any(s[k : k + 3] == t[j : j + 3] for t in seqs[:owner] for j in range(len(t) - 2))]
            assert a.earlier(s, 3, owner) == want
            a.add(s, owner)


def test_run_length_index():
    rng = random.Random(5)
    for length in (3, 5, 8, 20):
        texts = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(0, 40))) for _ in range(30)]
        ix = suffix_dedup.RunLengthIndex(texts)
        for p in [b"a", b"ab", b"\0\xff", *(t[2:7] for t in texts if len(t) > 8)]:
            assert ix.occurrences(p) == sum(t[k : k + len(p)] == p for t in texts for k in range(len(t) - len(p) + 1))


def test_matching_statistics_by_the_run_length_index():
    import numpy as np

    rng = random.Random(6)
    for alphabet, repeat in ((b"ab", 1), (b"abcd\0\xff", 1), (b"abcdefgh", 6)):
        for _ in range(15):
            base = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(6)]
            texts = [b"".join(rng.choice(base) for _ in range(repeat)) for _ in range(8)] + [b""]
            queries = [bytes(rng.choice(alphabet + b"z") for _ in range(rng.randint(0, 8))) + b"".join(rng.choice(base) for _ in range(2)) for _ in range(10)] + [b""]
            want = [max((n for n in range(len(q) - k + 1) if any(q[k : k + n] in t for t in texts)), default=0) for q in queries for k in range(len(q))]
            o = np.concatenate([[0], np.cumsum([len(q) for q in queries])])
            assert suffix_dedup.RunLengthIndex(texts).matching_statistics(np.frombuffer(b"".join(queries), np.uint8), o).tolist() == want


def test_decisions_rest_on_matching_statistics(monkeypatch, spark):
    """Without statistics nothing is removed in texts whose contexts differ."""
    rows = [(k, f"{k} " * 40 + "the passage that all of them share is here, and it is more than long enough for this " + f" {k}" * 40) for k in range(6)]
    contexts = [(7, i, 0, len(t) - 19, t.encode()) for i, t in rows]
    decide = suffix_dedup._decider(20)
    assert {d for d, _, _ in decide([contexts])} == set(range(1, 6))
    monkeypatch.setattr(suffix_dedup.RunLengthIndex, "matching_statistics", lambda self, data, offsets: data * 0)
    assert decide([contexts]) == []


def test_more_parts_than_buckets_are_allowed(spark):
    """64 parts in at most 8 buckets: the same components as in as many buckets as parts."""
    rng = random.Random(31)
    base = [prose(rng, 60, 300).split() for _ in range(12)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else "changed" for w in rng.choice(base))) for i in range(120)] + EDGES
    keys = {"spark.sql.sources.bucketing.maxBuckets": "8", "spark.sql.shuffle.partitions": "64"}
    found = lambda: sorted(tuple(r) for r in jaccard_join.near_components(frame(spark, rows)).collect())
    want, before = found(), {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert C.in_buckets(spark, 64) == (64, 8) and C.in_buckets(spark, 20) == (21, 7) and C.in_buckets(spark, 5) == (5, 5)
        assert found() == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_buckets_are_those_of_spark(spark):
    import numpy as np

    ids = [0, 1, -1, 2**63 - 1, -(2**63), 123456789012345, *range(5, 60)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(F.pmod(F.hash("i"), F.lit(13))).collect()]
    assert C.bucket_of(np.array(ids, np.int64), 13).tolist() == got


def test_blobs_round_trip():
    import numpy as np

    a, b = np.array([1, 2**63 - 1, -5]), np.array([1.5, -2.0, 0.0])
    x, y = C.unpack(C.pack(a, b), np.int64, np.float64)
    assert (x == a).all() and (y == b).all()
    assert [len(z) for z in C.unpack(C.pack(a[:0]), np.int64)] == [0]
