"""Text clean-up, comparison and counting as column expressions.

White space and word characters are those of Unicode: Java's ``(?U)\\s`` lacks U+001C-U+001F
and its ``\\w`` differs from letters, digits and underscore, so both classes are spelled out.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WS = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
# The default clean-up of the pipeline, and all steps in order.
DEFAULT_STEPS = ("soft_hyphens", "em_dash_breaks", "whitespace_normalize", "ligature_expand", "stray_control_chars")
ALL_STEPS = ("soft_hyphens", "dehyphenate", *DEFAULT_STEPS[1:])
# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}
# Characters that clean-up must not lose.
PRESERVED = ["§", "–", "—", "’", "¶"]


def ptrim(x: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(x, rf"(?U)\A{WS}+|{WS}+\z", "")


def blank(x: Column) -> Column:
    return ptrim(F.coalesce(x, F.lit(""))) == ""


def soft_hyphens(x: Column) -> Column:
    return F.replace(F.regexp_replace(x, rf"(?U)¬{WS}*\n{WS}*", ""), F.lit("¬"), F.lit(""))


def dehyphenate(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)({WORD})-{WS}*\n{WS}*({WORD})", "$1$2")


def em_dash_breaks(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)—{WS}*\n{WS}*", "—")


def whitespace_normalize(x: Column) -> Column:
    few = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.regexp_replace(few, r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", "")


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def expand_ligatures(x: Column) -> Column:
    for a, b in LIGATURES.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def ligature_expand(x: Column) -> Column:
    """NFKC, which Spark lacks, by an Arrow function; the rest stays in the JVM."""
    return expand_ligatures(nfkc(x))


def stray_control_chars(x: Column) -> Column:
    return F.regexp_replace(x, r"[\x00-\x08\x0B-\x1F\x7F]", "")


STEPS = {f.__name__: f for f in (soft_hyphens, dehyphenate, em_dash_breaks, whitespace_normalize, ligature_expand, stray_control_chars)}


def postprocess(x: Column, steps=DEFAULT_STEPS) -> Column:
    """The named steps in the order given; unknown names are passed over."""
    for s in steps:
        if s in STEPS:
            x = STEPS[s](x)
    return x


def preserved_chars_present(x: Column) -> Column:
    return F.create_map(*(v for c in PRESERVED for v in (F.lit(c), F.contains(x, F.lit(c)))))


def strip_comments(x: Column) -> Column:
    return F.regexp_replace(x, "(?s)<!--.*?-->", "")


def strip_leading_comment(x: Column) -> Column:
    """Cut one comment at the very start, and strip."""
    return F.when(x.startswith("<!--") & F.contains(x, F.lit("-->")), ptrim(F.regexp_replace(x, r"(?s)\A<!--.*?-->", ""))).otherwise(x)


def normalized(x: Column) -> Column:
    """White space collapsed, stripped, lower case: what error rates compare."""
    return F.lower(F.trim(F.regexp_replace(x, rf"(?U){WS}+", " ")))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, rf"(?U){WS}+"), lambda t: t != "")


def word_count(x: Column) -> Column:
    return F.size(tokens(x)).cast("long")


def non_latin_ratio(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"[^\x00-\x7F]")) / F.greatest(F.length(x), F.lit(1)).cast("double")
