"""The conversation trie against a plain trie of dictionaries, with partitions that cut hot nodes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import prefix_trie as T

from ..oracle import connect, same_rows

SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("clash"), "turns": F.lit(1), "part": F.lit(2)}).repartition(3)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(int)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -(10**9), len(m), kids[n], leaves[n], saved[n], sha(n)) for n, m in members.items())


def ours(df, parts):
    out = T.nodes(T.rebuilt(T.turn_arrays(df)), parts).collect()
    return sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


def talk(rng, convs, words=3, longest=9):
    return [(c, k, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", rng.choice("abcdefgh"[:words]) * rng.randint(1, 2)) for c in convs for k in range(rng.randint(1, longest))]


def test_agrees_with_duckdb(spark, sf_dir):
    same_rows(T.op13_prefix_trie(spark, sf_dir), connect(sf_dir), T.ORACLE)


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_partitions_change_nothing(spark, parts):
    rng = random.Random(parts)
    rows = talk(rng, rng.sample(range(1000), 150))
    rows += [(c, k, "user", "hot") for c in range(2000, 2100) for k in range(4)]  # copies, longer than their heads, over many partitions
    rows += [(c, k, "user", "hot") for c in range(2100, 2130) for k in range(rng.randint(4, 8))]
    rows += [(c, k, None, "hot" if k == 0 else f"{c}") for c in range(3000, 3080) for k in range(3)]
    assert ours(frame(spark, rows), parts) == plain(rows)


def test_edges(spark):
    rng = random.Random(9)
    rows = talk(rng, range(-130, -80)) + talk(rng, range(40))
    rows += [(7, None, "user", "first"), (7, None, None, None), (8, 0, "user", None), (8, 0, "", ""), (None, 1, "user", "lost"), rows[3], rows[3]]
    rows += [(5000, k, "user", "x" * k) for k in range(700)] + [(5001, k, "user", "x" * k) for k in range(690)]  # long conversations
    rows += [(5002, 0, "user", "é" * 100_000), (5003, 0, "user", "é\U0001f600")]
    for parts in (1, 5):
        assert ours(frame(spark, rows), parts) == plain(rows)


def test_no_rows(spark):
    assert ours(frame(spark, []), 4) == []
    assert ours(frame(spark, [(None, 1, "user", "x")]), 4) == []
    assert ours(frame(spark, [(3, 1, "user", "x")]), 4) == plain([(3, 1, "user", "x")])


def test_sweep_holds_a_bounded_number_of_waiting_rows():
    """A node opened within a partition, with very many children and ends: both are sent before it closes."""
    rows = [(c, f"{1:032x}", [1]) for c in range(200_000)] + [(200_000 + k, f"{1:032x}{k:032x}", [1, 2]) for k in range(60_000)]
    state, most, sent = T._Sweep(0), 0, defaultdict(int)
    state.add(-1, b"\0" * 16, [1])
    for c, turns, sizes in rows:
        state.add(c, bytes.fromhex(turns), sizes)
        most = max(most, *(len(n.waiting or ()) + len(n.ends or ()) for n in state.stack))
        for b in state.taken(1000):
            for k in b["kind"].to_pylist():
                sent[k] += 1
    assert most <= T.ENDS and sent[T.PIECE] >= 3 and sent[T.CLOSED] >= 2 * T.WAITING


@pytest.mark.parametrize("n", [0, 1, 5, 64, 1000])
def test_common_turns(n):
    rng = random.Random(n)
    a = rng.randbytes(16 * 1000)
    b = a[: 16 * n] + rng.randbytes(16 * 50)
    assert T.common_turns(a, b) == T.common_turns(b, a) == n and T.common_turns(a[: 16 * n], a) == n
