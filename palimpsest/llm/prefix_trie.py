"""Conversation prefix trie: turn arrays are sorted globally, and a sweep with a stack turns LCP intervals into nodes.

1. *Turn arrays.* A turn is 16 bytes of the SHA-256 of its role and text, and the text's code points; texts never move.
   A conversation is the array of its turns, rebuilt with the head that it shares (``rebuilt``).
2. *Global range sort* by (array, conv_id), so that copies of one conversation can lie in many partitions.
3. *Sweep.* Each task compares neighbours (their longest common prefix, LCP) and keeps a stack of open nodes: a node is
   the interval of arrays that begin with it, closed by the first neighbour with a shorter LCP. What a closed node adds
   up (members, leaves, savings) goes to the node below it on the stack.
4. *Stitching.* Nodes on the paths of a partition's first and last array may go on in its neighbours. Those paths are
   sent as partial sums. From the LCP of each partition's first array with the last one before it follows what the sums
   counted twice; then partial sums of one node are added. Children of such nodes learn their parent's conv_id by a join
   on (partition, parent), so a parent that a third of all nodes share is spread over the partitions that hold them.

Ends of a node that lies in several partitions come as pieces in order and are hashed as a stream, piece by piece. A
node whose children or ends wait in too large a number for their parent is sent in the same way as an open one, so a
task holds a bounded number of them beside the stack, which is as high as the longest conversation. A conversation is
one array: 24 bytes a turn.

Defined results: null turns come before others; turns with equal numbers are ordered by their digest, so the order of
rows never matters, and repeated rows are turns of their own; null role and text are empty; rows without conv_id belong
to no conversation and are left out; the remainders of negative ids are negative (c % 100 as SQL has it), as is the
crc32 of the decimal with its sign; a conversation whose turns all go is a member of the root alone. An empty table
gives no node, not even the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH = 16
#: Closed children, and ends, that wait for their parent before it is sent as an open node.
WAITING, ENDS = 20_000, 65_536

_NODE = {"node": pa.binary(), "parent": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string()}
_SWEPT = pa.schema({"kind": pa.int32(), "part": pa.int32(), **_NODE, "first": pa.bool_(), "last": pa.bool_(), "before": pa.int64(), "piece": pa.int64(), "blob": pa.binary(), "other": pa.binary()})
_SWEPT_SQL = "kind int, part int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, first boolean, last boolean, before long, piece long, blob binary, other binary"
CLOSED, OPEN, PIECE, BOUNDS = range(4)
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NOTHING = hashlib.sha256().hexdigest()


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, sizes): the digests of a conversation's turns end to end, and their texts' code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("k"), F.coalesce("turn", F.lit(0)).alias("t"), digest.alias("d"), F.length(text).cast("long").alias("n")).alias("x"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return held.select("conv_id", F.unhex(F.array_join(F.transform("x", lambda t: t["d"]), "")).alias("turns"), F.transform("x", lambda t: t["n"]).alias("sizes"))


def rebuilt(arrays: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """``arrays`` with the first crc32(conv_id) % most turns taken from the first conversation of its block."""
    heads = arrays.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("head"), F.substring("turns", 1, WIDTH * (most - 1)).alias("head_turns"), F.slice("sizes", 1, most - 1).alias("head_sizes"))
    d = arrays.withColumns({"head": F.col("conv_id") - F.col("conv_id") % block, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")}).join(heads, "head", "left")
    cut = F.expr(f"concat(coalesce(substring(head_turns, 1, {WIDTH} * h), X''), substring(turns, {WIDTH} * h + 1, {2**31 - 1 - WIDTH * most}))")
    return d.select("conv_id", cut.alias("turns"), F.expr("concat(coalesce(slice(head_sizes, 1, h), cast(array() AS array<bigint>)), slice(sizes, h + 1, size(sizes)))").alias("sizes"))


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two arrays have in common at their beginning."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // WIDTH
    low, high = 0, most // WIDTH  # equal up to low, different up to high
    step = 1
    while low + step < high and a[: (low + step) * WIDTH] == b[: (low + step) * WIDTH]:
        low, step = low + step, 2 * step
    high = min(high, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH] else (low, mid)
    return low


class _Node:
    __slots__ = ("id", "depth", "size", "before", "n", "least", "children", "leaves", "saved", "ends", "pieces", "waiting", "first", "sent")

    def __init__(self, id, depth, size, before, first):
        self.id, self.depth, self.size, self.before, self.first = id, depth, size, before, first
        self.n = self.children = self.leaves = self.saved = self.pieces = 0
        self.least, self.ends, self.waiting, self.sent = None, None, None, first


class _Sweep:
    """The open nodes of one partition's arrays, and the rows that closed ones gave."""

    def __init__(self, part: int):
        self.part, self.rows, self.stack = part, [], []
        self.first = self.first_sizes = self.last = None

    def row(self, kind, **values):
        self.rows.append({"kind": kind, "part": self.part, **values})

    def piece(self, node: _Node) -> None:
        self.row(PIECE, node=node.id, piece=node.pieces, blob=",".join(map(str, node.ends)).encode())
        node.pieces, node.ends = node.pieces + 1, None

    def send_children(self, node: _Node) -> None:
        self.rows += node.waiting or ()
        node.waiting = None

    def add(self, conv: int, turns: bytes, sizes: list[int]) -> None:
        if self.first is None:
            self.first, self.first_sizes, shared = turns, sizes, 0
            self.stack.append(_Node(b"", 0, 0, 0, True))
        else:
            shared = common_turns(self.last, turns)
            while self.stack[-1].depth > shared:
                self.close(False)
        opening = self.last is None
        while (top := self.stack[-1]).depth < len(turns) // WIDTH:
            d = top.depth
            id = hashlib.blake2b(top.id + turns[d * WIDTH : (d + 1) * WIDTH], digest_size=16).digest()
            self.stack.append(_Node(id, d + 1, sizes[d], top.before + top.size, opening))
        top = self.stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(conv, top.least)
        if top.ends is None:
            top.ends = array("q")
        top.ends.append(conv)
        if len(top.ends) >= ENDS:
            top.sent = True
            self.piece(top)
        self.last = turns

    def close(self, last: bool) -> None:
        """The node on top is complete here; ``last``: it is on the path of the partition's last array."""
        node = self.stack.pop()
        below = self.stack[-1] if self.stack else None
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.size
        if below is not None:
            below.n, below.children, below.leaves, below.saved = below.n + node.n, below.children + 1, below.leaves + node.leaves, below.saved + node.saved
            below.least = node.least if below.least is None else min(node.least, below.least)
        own = {"node": node.id, "conv_id": node.least, "depth": node.depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "parent": below.id if below else None}
        if node.sent or last:
            if node.ends is not None:
                self.piece(node)
            self.send_children(node)
            self.row(OPEN, **own, first=node.first, last=last, before=node.before)
            return
        own["ends_sha256"] = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends is not None else _NOTHING
        for child in node.waiting or ():
            child["parent_conv_id"], child["parent"] = node.least, None
        self.send_children(node)
        own |= {"kind": CLOSED, "part": self.part}
        if below.first:
            self.rows.append(own)
            return
        if below.waiting is None:
            below.waiting = []
        below.waiting.append(own)
        if len(below.waiting) >= WAITING:
            below.sent = True
            self.send_children(below)

    def end(self) -> None:
        if self.first is None:
            return
        while self.stack:
            self.close(True)
        self.row(BOUNDS, blob=self.first, other=self.last, n_convs=len(self.first_sizes), node=array("q", self.first_sizes).tobytes())

    def taken(self, least: int):
        if len(self.rows) >= least:
            rows, self.rows = self.rows, []
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _SWEPT], schema=_SWEPT)


def sweep(batches):
    state = _Sweep(TaskContext.get().partitionId())
    for b in batches:
        for conv, turns, sizes in zip(b["conv_id"].to_pylist(), b["turns"].to_pylist(), b["sizes"].to_pylist(), strict=True):
            state.add(conv, turns, sizes)
            yield from state.taken(20_000)
    state.end()
    yield from state.taken(1)


def _bounds(swept: DataFrame) -> DataFrame:
    """(part, shared, shared_size, extended): turns that a partition's first array shares with the last one before it,
    their code points, and whether the first array after the partition begins with its whole last one.

    One row a partition; only the numbers of those that have rows pass through the driver."""
    spark = swept.sparkSession
    rows = swept.filter(F.col("kind") == BOUNDS).select("part", F.col("blob").alias("first"), F.col("other").alias("last"), F.col("node").alias("sizes"))
    parts = sorted(r["part"] for r in rows.select("part").collect())
    before = spark.createDataFrame(list(zip(parts[1:], parts[:-1], strict=True)), "part int, previous int")
    pairs = rows.select("part", "first", "sizes").join(before, "part", "left").join(rows.select(F.col("part").alias("previous"), F.col("last").alias("last")), "previous", "left")

    def compare(batches):
        for b in batches:
            out = []
            for part, previous, first, last, sizes in zip(*(b[c].to_pylist() for c in ("part", "previous", "first", "last", "sizes")), strict=True):
                shared = 0 if last is None else common_turns(last, first)
                whole = last is not None and shared == len(last) // WIDTH
                out.append((part, previous, shared, sum(array("q", sizes)[:shared]), whole))
            if out:
                part, previous, shared, size, whole = zip(*out, strict=True)
                yield C.batch("part int, previous int, shared long, shared_size long, whole boolean", part=part, previous=previous, shared=shared, shared_size=size, whole=whole)

    found = C.materialise(pairs.select("part", "previous", "first", "last", "sizes").mapInArrow(compare, "part int, previous int, shared long, shared_size long, whole boolean"), "trie-bounds")
    after = found.filter("whole").select(F.col("previous").alias("part"), F.lit(True).alias("extended"))
    return found.select("part", "shared", "shared_size").join(after, "part", "left").withColumn("extended", F.coalesce("extended", F.lit(False)))


def _ends(swept: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes whose ends came in pieces."""

    def run(batches):
        node, state, done = None, None, []
        for b in batches:
            for n, blob in zip(b["node"].to_pylist(), b["blob"].to_pylist(), strict=True):
                if n != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(blob)
                else:
                    state.update(b"," + blob)
        if node is not None:
            done.append((node, state.hexdigest()))
        if done:
            yield C.batch("node binary, ends_sha256 string", node=[x for x, _ in done], ends_sha256=[x for _, x in done])

    pieces = swept.filter(F.col("kind") == PIECE).select("node", "part", "piece", "blob")
    return pieces.repartition("node").sortWithinPartitions("node", "part", "piece").mapInArrow(C.lean(run), "node binary, ends_sha256 string")


def nodes(arrays: DataFrame, parts: int) -> DataFrame:
    """The trie of ``arrays`` (conv_id, turns, sizes), one row a node."""
    C.bound_batches(arrays.sparkSession)
    swept = arrays.repartitionByRange(parts, "turns", "conv_id").sortWithinPartitions("turns", "conv_id").mapInArrow(C.lean(sweep), _SWEPT_SQL)
    swept = C.materialise(swept, "trie-sweep")
    open_ = swept.filter(F.col("kind") == OPEN).join(_bounds(swept), "part")
    # what a first array shares with the one before was opened there; a last array that goes on is no leaf
    twice = F.when(F.col("first") & (F.col("depth") < F.col("shared")), 1).otherwise(0)
    saved = F.when(F.col("first"), F.greatest(F.col("shared_size") - F.col("before"), F.lit(0))).otherwise(0)
    leaf = F.when(F.col("last") & F.col("extended"), 1).otherwise(0)
    spine = open_.groupBy("node", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum(F.col("n_children") - twice).alias("n_children"), F.sum(F.col("n_leaves") - leaf).alias("n_leaves"), F.sum(F.col("saved_tokens") + saved).alias("saved_tokens")
    )
    spine = C.materialise(spine, "trie-spine")
    ids = spine.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = spine.join(ids, "parent", "left").join(_ends(swept), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))
    here = swept.filter(F.col("kind") == OPEN).select("part", F.col("node").alias("parent")).join(ids, "parent")
    closed = swept.filter(F.col("kind") == CLOSED)
    known, waiting = closed.filter("parent IS NULL"), closed.filter("parent IS NOT NULL").drop("parent_conv_id")
    return whole.select(NODE).unionByName(known.select(NODE)).unionByName(waiting.join(here, ["part", "parent"]).select(NODE))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = C.materialise(turn_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turn-arrays")
    return nodes(rebuilt(arrays), C.part_count(arrays, 16 << 20))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS own FROM t GROUP BY conv_id),
b AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base,
             flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> CAST(i AS INTEGER)) & 1))) AS bits FROM o),
h AS (SELECT conv_id, own, base, xor(list_reduce(bits, lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, CAST(bit AS BIGINT)) & 1)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 6 AS h FROM b),
s AS (SELECT h.conv_id, list_concat(CASE WHEN o.own IS NULL THEN [] ELSE list_slice(o.own, 1, h) END, list_slice(h.own, h + 1, len(h.own))) AS seq FROM h LEFT JOIN o ON o.conv_id = h.base),
p AS (SELECT conv_id, len(seq) AS n, d, list_slice(seq, 1, d) AS node FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY node, d),
kids AS (SELECT list_slice(node, 1, d - 1) AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(node[d].t) END AS saved FROM nodes LEFT JOIN kids USING (node)),
sums AS (SELECT list_slice(node, 1, e) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM own) GROUP BY 1)
SELECT own.conv_id, own.d AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN sums USING (node) LEFT JOIN own up ON own.d > 0 AND up.node = list_slice(own.node, 1, own.d - 1)
"""
