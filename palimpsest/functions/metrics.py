"""Error rates and agreement of transcriptions.

Edit distances come from Myers' bit-parallel algorithm over Python integers, in Arrow batches:
Spark's own ``levenshtein`` fills the whole table character by character, and took three to
ten times as long on lines of a few hundred characters, more on longer ones. Two readings of one text mostly differ
within words, where two bounds meet and no table is needed (``_between_bounds``). Rows are spread
over tasks first (``spread``), since edit distances take far longer than reading."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from . import text as T


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores: small tables come in few partitions, edit distances take long."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


@lru_cache(maxsize=1 << 16)
def _word_distance(a: str, b: str) -> int:
    return _by_columns(a, b)


def _between_bounds(a: str, b: str) -> int | None:
    """The distance of texts of as many words, if two bounds of it meet.

    Word for word edits are one way from ``a`` to ``b``, so the distance is no more; and each edit takes away one
    character at most and adds one at most, so it is no less than the characters that either text has beyond the other."""
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y):
        return None
    pairs = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    if any(len(p) > 64 or len(q) > 64 for p, q in pairs):
        return None
    own, other = Counter("".join(p for p, _ in pairs)), Counter("".join(q for _, q in pairs))
    least, most = max((own - other).total(), (other - own).total()), 0
    for p, q in pairs:
        most += _word_distance(p, q)
        if most > least:
            return None
    return most


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Unit-cost edit distance of two sequences (code points of texts, tokens of lists)."""
    if a == b:
        return 0
    if isinstance(a, str) and isinstance(b, str) and min(len(a), len(b)) > 32:
        found = _between_bounds(a, b)
        if found is not None:
            return found
    return _by_columns(a, b)


def _by_columns(a: Sequence, b: Sequence) -> int:
    """The distance by Myers' algorithm, a column of the table for each element of ``b``."""
    start, end, least = 0, 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n  # vertical differences of +1 and -1 along the column
    for x in b:
        hit = places.get(x, 0)
        flat = (((hit & up) + up) ^ up) | hit | down
        right_up = down | (full & ~(flat | up))
        right_down = up & flat
        score += 1 if right_up & last else -1 if right_down & last else 0
        right_up = (right_up << 1 | 1) & full
        right_down = right_down << 1 & full
        hit |= down
        up = right_down | (full & ~(hit | right_up))
        down = right_up & hit
    return score


@F.pandas_udf(LongType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance over code points; null if either text is."""
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance over tokens; null if either text is."""
    return pd.Series([None if x is None or y is None else edit_distance(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(DoubleType())
def mean_similarity(texts: pd.Series) -> pd.Series:
    """Mean over all pairs of an array's texts of 1 - distance / longer length; null for fewer than two."""

    def one(ts) -> float | None:
        if ts is None or len(ts) < 2:
            return None
        pairs = [(x, y) for i, x in enumerate(ts) for y in ts[i + 1 :]]
        return sum(1.0 - edit_distance(x, y) / max(len(x), len(y)) if x or y else 1.0 for x, y in pairs) / len(pairs)

    return texts.map(one).astype("float64")


def _rate(distance: Column, length: Column, other_empty: Column) -> Column:
    return F.when(length > 0, distance / length.cast("double")).otherwise(F.when(other_empty, 0.0).otherwise(F.lit(float("inf"))))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate; an empty reference gives 0 or infinity."""
    return _rate(distance(reference, hypothesis), F.length(reference), hypothesis == "")


def wer(reference: Column, hypothesis: Column) -> Column:
    return _rate(word_distance(reference, hypothesis), F.size(T.tokens(reference)), F.size(T.tokens(hypothesis)) == 0)


def study_cer(a: Column, b: Column) -> Column:
    """Distance over the longer text: symmetric, unlike ``cer``."""
    return distance(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)).cast("double")


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - distance(a, b) / longest.cast("double"))


def evaluate(df: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", normalize: bool = True) -> DataFrame:
    """Adds cer, wer (rounded to 4 places), ref_chars, hyp_chars and normalized."""
    of = T.normalized if normalize else (lambda x: x)
    d = spread(df).withColumns({"_r": of(F.col(reference)), "_h": of(F.col(hypothesis))})
    return d.withColumns({
        "cer": F.bround(cer(F.col("_r"), F.col("_h")), 4), "wer": F.bround(wer(F.col("_r"), F.col("_h")), 4),
        "ref_chars": F.length("_r").cast("long"), "hyp_chars": F.length("_h").cast("long"), "normalized": F.lit(normalize),
    }).drop("_r", "_h")
