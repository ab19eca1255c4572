"""Edit distances of long texts: many small problems between common anchors.

The full table of two texts has as many cells as the product of their lengths. Here runs of ``n`` words that stand
exactly once in either text are anchors; of their places the longest chain that rises in both texts is kept (patience
sorting), thinned to one in ``least`` characters, and the texts are cut in the middle of each anchor. The distance is the
sum over the pieces, each over its full table, so it is the length of a real edit script: never less than the
distance, and equal to it where the anchors lie on a best alignment, as in two readings of one text. A pair without
anchors is one piece, and exact.

Both texts of a pair stand in one row, so it is cut where it lies: nothing is shuffled but what the caller spreads, and
memory is that of one pair and its words.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..sources.reader import bound_batches

_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def rising_chain(a: list[int], b: list[int]) -> list[int]:
    """Of pairs ordered by ``a``, the places of a longest chain whose ``b`` rises."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(b)
    for k, x in enumerate(b):
        p = bisect_left(tops, x)
        before[k] = at[p - 1] if p else -1
        if p == len(tops):
            tops.append(x)
            at.append(k)
        else:
            tops[p], at[p] = x, k
    k, chain = (at[-1] if at else -1), []
    while k >= 0:
        chain.append(k)
        k = before[k]
    return chain[::-1]


def anchors(text: str, n: int) -> dict[str, int]:
    """Where each run of ``n`` words stands that the text has once only."""
    found = [(m.group(), m.start()) for m in _WORD.finditer(text)]
    at: dict[str, int] = {}
    for k in range(len(found) - n + 1):
        gram = " ".join(w for w, _ in found[k : k + n])
        at[gram] = -1 if gram in at else found[k][1]
    return {gram: start for gram, start in at.items() if start >= 0}


def cut(a: str, b: str, n: int = 3, least: int = 400) -> list[tuple[str, str]]:
    """Two texts cut at common anchors."""
    if a == b or len(a) < least:
        return [(a, b)]
    first, second = anchors(a, n), anchors(b, n)
    met = sorted((i, second[gram]) for gram, i in first.items() if gram in second)
    out, i, j = [], 0, 0
    for k in rising_chain([x for x, _ in met], [y for _, y in met]):
        x, y = met[k]
        if x - i >= least and y > j:
            out.append((a[i:x], b[j:y]))
            i, j = x, y
    return [*out, (a[i:], b[j:])]


def _texts(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    bound_batches(pairs.sparkSession)
    return pairs.select(*key, F.coalesce(a, F.lit("")).alias("_a"), F.coalesce(b, F.lit("")).alias("_b"))


def pieces(pairs: DataFrame, key: list[str], a: str, b: str, n: int = 3, least: int = 400) -> DataFrame:
    """(key, piece, a, b): texts cut at common anchors; the pieces of one pair, in order, make up its texts."""

    @F.pandas_udf("array<struct<a:string,b:string>>")
    def parts(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"a": p, "b": q} for p, q in cut(s, t, n, least)] for s, t in zip(x, y, strict=True)])

    return _texts(pairs, key, a, b).select(*key, F.posexplode(parts("_a", "_b")).alias("piece", "_p")).select(*key, "piece", "_p.a", "_p.b")


def distances(pairs: DataFrame, key: list[str], a: str, b: str, n: int = 3, least: int = 400) -> DataFrame:
    """(key, char_errors, ref_chars, hyp_chars) of each pair of texts, of any length; null counts as empty.

    Rows stay where they are: callers deal them out first (``metrics.spread``) if they lie in few partitions."""

    @F.pandas_udf("long")
    def errors(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([sum(metrics.edit_distance(p, q) for p, q in cut(s, t, n, least)) for s, t in zip(x, y, strict=True)], dtype="int64")

    return _texts(pairs, key, a, b).select(*key, errors("_a", "_b").alias("char_errors"), F.length("_a").cast("long").alias("ref_chars"), F.length("_b").cast("long").alias("hyp_chars"))
