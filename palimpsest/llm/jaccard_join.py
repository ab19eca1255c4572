"""N-gram Jaccard join: documents whose sets of word 5-grams overlap, as connected components.

Two documents link when ``100 * intersection >= 75 * union`` of their sets of distinct
5-word shingles (a text of fewer words is one shingle; a text without words has none and
links with nothing). The operator finds all components without listing all pairs of a group:

1. Equal sets are one class; only the class's smallest document goes on.
2. Filter. A set of n must share at least a = ceil(0.75 n) shingles with a partner, so of
   its first n - a + n / 8 shingles in hash order at least some 0.75 * n / 8 occur in
   another set (size-derived bound). Those prefixes are shuffled as sorted blobs by ranges
   of the hash; documents below the bound are alone. A shingle that several sets of one
   chunk hold is counted there and sent once without an owner, so that a shingle that
   a third of all documents hold is a few entries a task.
3. The sets of the rest are written once: a sparse document-by-shingle incidence matrix in
   row blocks. A second prefix, in the order of rising frequency, gives the columns in
   which partners must meet. Sets of n and m need an overlap of o = ceil(3 (n + m) / 7); the
   first column in which they meet stands at place n - o or before in the one, m - o or
   before in the other. Pairs that meet later only are discarded unseen.
4. Rounds: in every column with several components, each document is offered the column's
   leader (first the document with the largest share of frequent shingles, the likely
   origin of copies; then a pseudo-random one) if that is of another component; it takes
   the one that it meets in most columns. These offers are the mask of a sparse product: the
   incidence rows of some leaders, transposed, are one block; the rows of the documents
   offered to them stream past it, and overlap counts of the mask's entries add up over
   blocks of columns (``overlaps``). After each block of columns the entries are discarded whose
   count, with all that is left of the smaller set, stays under the bound. A leader with many
   documents stands in several blocks. The mask is what keeps the product linear: the full
   one has an entry for every pair of a group. What reaches the bound is a link;
   components are contracted.
5. Remainder: pairs of documents of *different* components that still meet in a column and
   were not tested are the last mask. After the rounds these are few, and none are inside a
   group. So no link between different texts is lost. Columns with many holders are split, and
   only sets of fitting sizes meet.

Shingles are 64-bit hashes of the words' hashes. Defined results: null text has no words;
rows that repeat a doc_id and its text each get the same answer; if a doc_id stands on several
texts, that with the largest set (of equal ones, the largest fingerprint) is held against other
documents, and each row is in the component of the smallest document with its set; a null
doc_id is one document that sorts before all others; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHARE = 75
_HOT_FROM, _HOT_MOST = 32, 1 << 17
_COLUMN_BLOCKS = 8  # by the highest bits of a shingle's hash
_BLOCK_ENTRIES, _LEADER_ENTRIES = 96, 128  # entries of the mask in a block on average, and of one leader at most
_HOLDERS = 256  # of one column in one part of the last step
_SETS = "doc_id long, n long, grams binary"


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text on end, and n + 1 offsets of texts among them."""
    data = C.LOWER[data]
    starts, ends, wo = C.word_bounds(data, offsets)
    h = C.span_hash(C.prefix_sums(data), starts, ends)
    words, doc = np.diff(wo), C.row_of(wo)
    grams = C.rolled(h, k)
    inside = doc[: len(grams)] == doc[k - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[inside], doc[: len(grams)][inside]
    for m in range(1, k):  # short texts: all their words as one shingle
        short = np.flatnonzero(words == m)
        if len(short):
            one = C.rolled(h, m)[wo[short]] + np.uint64(m)
            grams, owner = np.concatenate([grams, one]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(offsets)))


def _fingerprints(grams: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, independent of order."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(C.mix(grams ^ np.uint64(salt)))])
        out.append((sums[o[1:]] - sums[o[:-1]]).view(np.int64))
    return out[0], out[1]


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap that a set of n shingles has with a partner."""
    return -(-n * SHARE // 100)


def scan(docs: DataFrame, parts: int) -> DataFrame:
    """One pass over the texts. Rows: kind 0 (doc_id, n, f1, f2) for each document, kind 1
    (doc_id, n = prefix shingles that other sets hold too)."""
    schema = "kind int, doc_id long, n long, f1 long, f2 long"

    def cut(batches):
        for whole in batches:
            for b in C.slices(whole, "text"):
                ids = C.ids_of(b["doc_id"])
                grams, o = shingles(*C.text_bytes(b["text"]))
                n = np.diff(o)
                f1, f2 = _fingerprints(grams, o)
                rows = [(int(p), b"D" + x) for p, x in C.spread(C.part_of(C.mix(ids.view(np.uint64)), parts), ids, n, f1, f2)]
                # of equal sets in this chunk the smallest document speaks for all
                order = np.lexsort((ids, f2, f1))
                first = np.ones(len(ids), bool)
                first[1:] = (f1[order][1:] != f1[order][:-1]) | (f2[order][1:] != f2[order][:-1])
                speaks = np.zeros(len(ids), bool)
                speaks[order[first]] = True
                length = np.where(speaks & (n > 0), np.minimum(n, n - needed(n) + np.maximum(n // 8, 1)), 0)
                owner = np.repeat(np.arange(len(n)), length)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + o[owner]
                h = grams[at]
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                edges = C.runs(h)
                several = np.repeat(np.diff(edges) > 1, np.diff(edges))
                here = np.bincount(owner[several], minlength=len(n))
                known = np.flatnonzero(here)
                rows += [(int(p), b"K" + x) for p, x in C.spread(C.part_of(C.mix(ids[known].view(np.uint64)), parts), ids[known], here[known])]
                heads = edges[:-1][np.diff(edges) > 1] if len(h) else np.zeros(0, np.int64)
                rows += [(int(p), b"S" + x) for p, x in C.spread(C.part_of(C.mix(h[heads]), parts), h[heads])]
                h, who = h[~several], ids[owner[~several]]
                order = np.argsort(who, kind="stable")
                for p, x in C.spread(C.part_of(C.mix(h[order]), parts), h[order], who[order]):
                    hh, ww = C.unpack(x, np.uint64, np.int64)
                    rows.append((p, b"E" + C.pack(hh, np.diff(ww, prepend=np.int64(0)))))
                yield C.blob_batch(rows)

    def count(blobs):
        hashes, owners = [], []
        for blob in blobs:
            kind, body = blob[:1], blob[1:]
            if kind == b"D":
                i, n, f1, f2 = C.unpack(body, np.int64, np.int64, np.int64, np.int64)
                yield C.batch(schema, kind=np.zeros(len(i), np.int32), doc_id=i, n=n, f1=f1, f2=f2)
            elif kind == b"K":
                i, n = C.unpack(body, np.int64, np.int64)
                yield C.batch(schema, kind=np.ones(len(i), np.int32), doc_id=i, n=n, f1=n, f2=n)
            elif kind == b"S":
                (h,) = C.unpack(body, np.uint64)
                hashes.append(h)
                owners.append(np.full(len(h), -(2**63) + 1, np.int64))
            else:
                h, d = C.unpack(body, np.uint64, np.int64)
                hashes.append(h)
                owners.append(np.cumsum(d))
        if not hashes:
            return
        h, w = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        h, w = h[order], w[order]
        edges = C.runs(h)
        w = w[np.repeat(np.diff(edges) > 1, np.diff(edges))]
        i, n = np.unique(w[w != -(2**63) + 1], return_counts=True)
        if len(i):
            yield C.batch(schema, kind=np.ones(len(i), np.int32), doc_id=i, n=n, f1=n, f2=n)

    blobs = docs.select("doc_id", "text").mapInArrow(C.lean(cut), C.BLOB)
    return C.exchange(blobs, parts, count, schema)


def sets_of(docs: DataFrame, chosen: DataFrame, parts: int, buckets: int | None = None) -> DataFrame:
    """The whole sets (sorted hashes) of the chosen documents (doc_id, f1, f2), each once: a table in buckets by doc_id,
    so that no join by document moves them again. Texts go to the buckets' tasks, ``parts``, compressed."""

    def send(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for b in C.slices(whole, "text"):
                ids = C.ids_of(b["doc_id"])
                data, o = C.text_bytes(b["text"])
                part, rows, raw = C.bucket_of(ids, parts), [], data.tobytes()
                order = np.argsort(part, kind="stable")
                edges = C.runs(part[order])
                for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    some = order[a:e]
                    rows.append((int(part[some[0]]), b"X" + squeeze(C.pack(ids[some], np.diff(o)[some]) + b"".join(raw[o[i] : o[i + 1]] for i in some.tolist()))))
                yield C.blob_batch(rows)

    def name(batches):
        for b in batches:
            ids, f1, f2 = (b[k].to_numpy() for k in ("doc_id", "f1", "f2"))
            yield C.blob_batch([(p, b"C" + x) for p, x in C.spread(C.bucket_of(ids, parts), ids, f1, f2)])

    def build(blobs):
        named = [C.unpack(x[1:], *[np.int64] * 3) for x in blobs if x[:1] == b"C"]
        if not named:
            return
        wanted, w1, w2 = (np.concatenate(x) for x in zip(*named, strict=True))
        order = np.argsort(wanted)
        wanted, w1, w2 = wanted[order], w1[order], w2[order]
        done = np.zeros(len(wanted), bool)  # of equal rows of a document the first counts
        for x in blobs:
            if x[:1] != b"X":
                continue
            body = zstandard.ZstdDecompressor().decompress(x[1:])
            n = int.from_bytes(body[:8], "little")
            ids, sizes = C.unpack(body[: 8 + 16 * n], np.int64, np.int64)
            at = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
            mine = np.flatnonzero((wanted[at] == ids) & ~done[at])
            if not len(mine):
                continue
            data, o = np.frombuffer(body, np.uint8, offset=8 + 16 * n), np.concatenate([[0], np.cumsum(sizes)])
            data = np.concatenate([data[o[i] : o[i + 1]] for i in mine.tolist()])
            ids, at, o = ids[mine], at[mine], np.concatenate([[0], np.cumsum(sizes[mine])])
            grams, o = shingles(data, o)
            f1, f2 = _fingerprints(grams, o)
            take = (f1 == w1[at]) & (f2 == w2[at])
            _, first = np.unique(np.where(take, at, -1), return_index=True)
            once = np.zeros(len(at), bool)
            once[first] = True
            take &= once
            done[at[take]] = True
            flat = pa.BinaryArray.from_buffers(pa.binary(), len(o) - 1, [None, pa.py_buffer((o * 8).astype(np.int32)), pa.py_buffer(grams.view(np.uint8))])
            yield C.batch(_SETS, doc_id=ids, n=np.diff(o), grams=flat).filter(pa.array(take))

    blobs = chosen.mapInArrow(C.lean(name), C.BLOB).union(docs.select("doc_id", "text").mapInArrow(C.lean(send), C.BLOB))
    return C.bucketed(C.exchange(blobs, parts, build, _SETS), "doc_id", buckets or parts, "sets")


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, o = C.text_bytes(column)
    return np.frombuffer(raw.tobytes(), np.uint64), o // 8


def frequent(sets: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (at most _HOT_MOST, a fixed bound) and their frequencies."""

    def cut(batches):
        for b in batches:
            grams, _ = _rows(b["grams"])
            h, n = np.unique(grams, return_counts=True)
            yield C.blob_batch(list(C.spread(C.part_of(h, parts), h, n.astype(np.int32))))

    def add(blobs):
        got = [C.unpack(x, np.uint64, np.int32) for x in blobs]
        h, n = (np.concatenate(x) for x in zip(*got, strict=True))
        h, place = np.unique(h, return_inverse=True)
        n = np.bincount(place, weights=n)
        hot = n >= _HOT_FROM
        if hot.any():
            yield C.batch("h long, n long", h=h[hot].view(np.int64), n=n[hot].astype(np.int64))

    rows = C.exchange(sets.select("grams").mapInArrow(C.lean(cut), C.BLOB), parts, add, "h long, n long").orderBy(F.desc("n"), "h").limit(_HOT_MOST).collect()
    h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r[1] for r in rows], np.int64)[order]


def columns_of(sets: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, doc_id, place): the first n - needed + 1 shingles of each set, rare ones first; one row without gram
    for each set holds n as ``place``, and in ``core`` how many of a thousand of its shingles are frequent."""
    held = sets.sparkSession.sparkContext.broadcast(hot)
    schema = "gram long, doc_id long, place int, core int"

    def run(batches):
        top, freq = held.value
        for whole in batches:
            for b in C.slices(whole, "grams"):
                grams, o = _rows(b["grams"])
                owner, n = C.row_of(o), np.diff(o)
                rank = np.zeros(len(grams), np.int64)
                if len(top):
                    at = np.minimum(np.searchsorted(top, grams), len(top) - 1)
                    rank = np.where(top[at] == grams, freq[at], 0)
                order = np.lexsort((grams, rank, owner))
                place = np.arange(len(grams)) - np.repeat(o[:-1], n)
                within = place < np.repeat(n - needed(n) + 1, n)
                take = order[within]
                ids = C.ids_of(b["doc_id"])
                core = np.bincount(owner, weights=rank > 0, minlength=len(n)) * 1000 // np.maximum(n, 1)
                yield C.batch(schema, gram=grams[take].view(np.int64), doc_id=ids[owner[take]], place=place[within].astype(np.int32), core=np.full(len(take), -1, np.int32))
                yield C.batch(schema, gram=pa.nulls(len(n), pa.int64()), doc_id=ids, place=n.astype(np.int32), core=core.astype(np.int32))

    return sets.mapInArrow(C.lean(run), schema)


def overlaps(leaders: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], row: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """The masked product of two sparse blocks: which of the entries (row, leader), distinct and in ascending order, reach the bound.

    Blocks are (shingles, offsets of the sets). Counts add up over blocks of columns; after each one, entries that
    cannot reach their bound any more are discarded."""
    (cols, co), (grams, ro) = leaders, rows
    n, m = np.diff(ro), np.diff(co)
    need = -(-SHARE * (n[row] + m[leader]) // (100 + SHARE))
    live = np.flatnonzero(need <= np.minimum(n[row], m[leader]))
    by = np.argsort(cols, kind="stable")  # the leaders' block, transposed: columns with the leaders that hold them
    cols, holder = cols[by], C.row_of(co)[by]
    owner, part = C.row_of(ro), (grams >> np.uint64(61)).astype(np.int64)

    def ahead(of, block, sets):
        """Of each set: how many of its shingles are in each block of columns and those behind it."""
        counts = np.bincount(of * _COLUMN_BLOCKS + block, minlength=sets * _COLUMN_BLOCKS).reshape(sets, _COLUMN_BLOCKS)
        return np.column_stack([counts[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros(sets, np.int64)])

    row_left, leader_left = ahead(owner, part, len(n)), ahead(holder, (cols >> np.uint64(61)).astype(np.int64), len(m))
    total = np.zeros(len(row), np.int64)
    for k in range(_COLUMN_BLOCKS):
        if not len(live):
            break
        asked = np.zeros(len(n), bool)
        asked[row[live]] = True
        mine = np.flatnonzero((part == k) & asked[owner])
        lo, hi = np.searchsorted(cols, grams[mine], "left"), np.searchsorted(cols, grams[mine], "right")
        times = hi - lo
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
        entry = np.repeat(owner[mine], times) * len(m) + holder[at]
        mask = row[live] * len(m) + leader[live]
        place = np.minimum(np.searchsorted(mask, entry), len(mask) - 1)
        total[live] += np.bincount(place[mask[place] == entry], minlength=len(live))
        live = live[total[live] + np.minimum(row_left[row[live], k + 1], leader_left[leader[live], k + 1]) >= need[live]]
    return live


def links_among(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """The pairs (a, b) whose sets link: the mask's entries ``b`` (leader) by ``a`` (document), block by block."""
    # as many blocks for each task
    blocks = parts * max(1, -(-pairs.count() // (_BLOCK_ENTRIES * parts)))
    many = pairs.groupBy("b").agg(F.count("*").alias("c")).filter(F.col("c") > _LEADER_ENTRIES)
    # a leader of many documents is dealt to several blocks, by document
    share = F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("c") / _LEADER_ENTRIES), F.lit(1)))
    mask = pairs.select("a", "b").join(many.hint("merge"), "b", "left").select("a", "b", F.pmod(F.xxhash64("b", share), F.lit(blocks)).alias("block"))
    mask = C.materialise(mask, "product-mask")
    of = lambda x: mask.select("block", F.col(x).alias("doc_id")).distinct().join(sets, "doc_id")
    none = F.lit(None)
    records = (
        of("b").select("block", F.lit(0).alias("kind"), F.col("doc_id").alias("x"), none.cast("long").alias("y"), "grams")
        .union(mask.select("block", F.lit(1), "a", "b", none.cast("binary")))
        .union(of("a").select("block", F.lit(2), "doc_id", none.cast("long"), "grams"))
    )

    def run(batches):
        leaders, ids, entries = [], [], []  # of the block at hand
        ready, now = None, None
        for whole in batches:
            for x in C.slices(whole, "grams"):
                block, kind = x["block"].to_numpy(), x["kind"].to_numpy()
                edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]), [True]]))
                for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if block[a] != now:
                        now, leaders, ids, entries, ready = block[a], [], [], [], None
                    some = x.slice(a, e - a)
                    if kind[a] == 0:
                        leaders.append(_rows(some["grams"]))
                        ids.append(some["x"].to_numpy())
                    elif kind[a] == 1:
                        entries.append((some["x"].to_numpy(), some["y"].to_numpy()))
                    else:
                        if ready is None:
                            who = np.concatenate(ids)
                            flat = np.concatenate([g for g, _ in leaders]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in leaders]))])
                            by = np.argsort(who)
                            doc, lead = (np.concatenate(c) for c in zip(*entries, strict=True))
                            lead = by[np.searchsorted(who[by], lead)]
                            order = np.argsort(doc, kind="stable")
                            ready = flat, who, doc[order], lead[order]
                        flat, who, doc, lead = ready
                        mine = some["x"].to_numpy()
                        by = np.argsort(mine)
                        lo, hi = np.searchsorted(doc, mine[by], "left"), np.searchsorted(doc, mine[by], "right")
                        at = np.concatenate([np.arange(p, q) for p, q in zip(lo.tolist(), hi.tolist(), strict=True)])
                        row, column = np.repeat(by, hi - lo), lead[at]
                        order = np.lexsort((column, row))
                        row, column = row[order], column[order]
                        live = overlaps(flat, _rows(some["grams"]), row, column)
                        yield C.batch("a long, b long", a=mine[row[live]], b=who[column[live]])

    return records.repartitionById(parts, (F.col("block") % parts).cast("int")).sortWithinPartitions("block", "kind").mapInArrow(C.lean(run), "a long, b long")


def forest(edges: DataFrame) -> DataFrame:
    """(v, w): for each part of the edges (a, b), its vertices under the least of the part's component."""

    def run(batches):
        got = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        ids, place = np.unique(np.concatenate([x for pair in got for x in pair]), return_inverse=True)
        edges = np.cumsum([0] + [len(x) for pair in got for x in pair])
        a, b = (np.concatenate([place[edges[k] : edges[k + 1]] for k in range(side, len(edges) - 1, 2)]) for side in (0, 1))
        root = np.arange(len(ids))
        while (root[a] != root[b]).any():
            x, y = root[a], root[b]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        under = np.flatnonzero(root != np.arange(len(ids)))
        if len(under):
            yield C.batch("v long, w long", v=ids[under], w=ids[root[under]])

    return edges.select("a", "b").distinct().mapInArrow(C.lean(run), "v long, w long")


def components(edges: DataFrame) -> DataFrame | None:
    """(v, root): the least vertex that each vertex of the edges (a, b) reaches; None without edges.

    Each part's edges become trees of depth one; then hooking to the least neighbour's root and pointer jumping, as
    joins; every round is a written table and no vertex's neighbours are ever gathered."""
    trees = C.materialise(forest(edges), "edges")
    if trees.isEmpty():
        return None
    both = trees.union(trees.select("w", "v"))
    roots = C.materialise(both.groupBy("v").agg(F.least(F.first("v"), F.min("w")).alias("root")), "roots")
    while True:
        # jump: v's root's root; hook: the least root among the neighbours
        up = roots.select(F.col("v").alias("root"), F.col("root").alias("up"))
        jumped = roots.join(up.hint("merge"), "root").select("v", F.col("root").alias("old"), "up")
        near = both.join(jumped.select(F.col("v").alias("w"), F.col("up").alias("near")).hint("merge"), "w").groupBy("v").agg(F.min("near").alias("near"))
        # the hook also moves the root itself, so whole trees merge at once
        moved = jumped.join(near.hint("merge"), "v").select("v", "old", "up", F.least("up", "near").alias("new"))
        lift = moved.groupBy(F.col("up").alias("v")).agg(F.min("new").alias("lifted"))
        after = C.materialise(moved.join(lift.hint("merge"), "v", "left").select("v", "old", F.least("new", F.coalesce("lifted", "new")).alias("root")), "roots")
        if after.filter("root <> old").isEmpty():
            return after.select("v", "root")
        roots = after.select("v", "root")


def contract(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (doc_id, comp) after linking by edges (a, b)."""
    of = lambda x: labels.select(F.col("doc_id").alias(x), F.col("comp").alias(f"{x}c")).hint("merge")
    between = edges.join(of("a"), "a").join(of("b"), "b").filter("ac <> bc").select(F.col("ac").alias("a"), F.col("bc").alias("b"))
    roots = components(between)
    if roots is None:
        return labels
    roots = roots.select(F.col("v").alias("comp"), "root")
    return C.materialise(labels.join(roots.hint("merge"), "comp", "left").select("doc_id", "n", "core", F.coalesce("root", "comp").alias("comp")), "labels")


def near_components(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    parts, buckets = C.in_buckets(docs.sparkSession, C.part_count(docs))
    seen = C.materialise(scan(docs, parts), "shingle-scan")
    per_doc = seen.filter("kind = 0").select("doc_id", "n", "f1", "f2")
    classes = per_doc.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    met = seen.filter("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("met"))
    enough = F.greatest(F.lit(1), F.floor(F.greatest(F.floor(F.col("n") / 8), F.lit(1)) * 3 / 4))
    # a document that stands on several texts goes on with its largest set
    texts = per_doc.groupBy("doc_id").agg(F.max(F.struct("n", "f1", "f2")).alias("x")).select("doc_id", "x.*")
    chosen = classes.join(met.hint("merge"), classes.rep == met.doc_id).filter(F.col("met") >= enough).select("doc_id").distinct()
    chosen = C.materialise(texts.join(chosen.hint("merge"), "doc_id", "left_semi").select("doc_id", "f1", "f2"), "chosen")
    sets = sets_of(docs, chosen, parts, buckets)
    raw = C.materialise(columns_of(sets, frequent(sets, parts)), "all-columns")
    about = raw.filter("gram IS NULL").select("doc_id", F.col("place").alias("n"), "core")
    raw = raw.filter("gram IS NOT NULL").select("gram", "doc_id", "place")
    shared = raw.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram")
    cols = C.bucketed(raw.join(shared.hint("merge"), "gram").repartition(parts, "doc_id"), "doc_id", buckets, "columns")
    labels = C.materialise(about.withColumn("comp", F.col("doc_id")), "labels")
    tested = None
    for r in range(rounds + 1):
        of = cols.join(labels, "doc_id").repartition(parts, "gram")
        first = -F.col("core") if r == 0 else F.xxhash64("comp", F.lit(r))
        order = F.struct(first.alias("o"), F.col("doc_id").alias("d"), F.col("n").alias("dn"), F.col("place").alias("dplace"), F.col("comp").alias("dc"))
        active = of.groupBy("gram").agg(F.min(order).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("gram", "lead.*")
        overlap = F.expr("((n + dn) * 3 + 6) div 7")
        may = (F.col("place") + overlap <= F.col("n")) & (F.col("dplace") + overlap <= F.col("dn"))
        if r < rounds:
            met = of.join(active.hint("merge"), "gram").filter((F.col("comp") != F.col("dc")) & may)
            best = met.groupBy("doc_id", "d").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.max(F.struct("c", (-F.col("d")).alias("minus"), "d")).alias("x"))
            pairs = best.select(F.col("doc_id").alias("a"), F.col("x.d").alias("b"))
        else:
            held = active.join(of.groupBy("gram").agg(F.count("*").alias("c")).hint("merge"), "gram").select("gram", F.ceil(F.col("c") / _HOLDERS).cast("int").alias("shares"))
            # partners' sizes differ by a third at most, so by one step of sizes; columns with many holders are split by the one side
            step = F.floor(F.log("n") / F.log(F.lit(1.34))).cast("int")
            mine = of.join(held.hint("merge"), "gram").withColumn("step", step)
            other = mine.select("gram", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"), F.col("doc_id").alias("d"), F.col("n").alias("dn"), F.col("place").alias("dplace"), F.col("comp").alias("dc"), "shares")
            other = other.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
            mine = mine.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int"))
            pairs = mine.join(other.hint("merge"), ["gram", "step", "share"]).filter((F.col("comp") < F.col("dc")) & may).select(F.col("doc_id").alias("a"), F.col("d").alias("b")).distinct()
            if tested is not None:
                known = tested.union(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
                pairs = pairs.join(known.hint("merge"), ["a", "b"], "left_anti")
        pairs = C.materialise(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        labels = contract(labels, links_among(pairs, sets, parts))
    comp = classes.join(labels.select(F.col("doc_id").alias("rep"), "comp").hint("merge"), "rep", "left").select("n", "f1", "f2", F.coalesce("comp", "rep").alias("comp"))
    out = per_doc.join(comp.hint("merge"), ["n", "f1", "f2"], "left")
    known = F.nullif("doc_id", F.lit(-(2**63)))
    return out.select(known.alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("comp", "doc_id"), F.lit(-(2**63))).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first (smallest doc_id) in their component."""
    gone = near_components(docs).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(C.documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM places UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.x, p.y FROM p JOIN n nx ON p.x = nx.doc_id JOIN n ny ON p.y = ny.doc_id WHERE 100 * p.o >= 75 * (nx.n + ny.n - p.o)),
u AS (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, u.b FROM r JOIN u ON r.m = u.a)
SELECT r.d AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.m) AS component_id FROM r LEFT JOIN n ON r.d = n.doc_id GROUP BY r.d
"""
