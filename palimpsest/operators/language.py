"""Language detection by profiles of character trigrams, learnt from texts whose language is known.

A text is its letters in lower case, with one space for all between them. A language's profile has its ``top`` most
frequent trigrams; for each trigram of any profile and each language the weight is the (add-one) log probability, in
thousandths, so that sums are whole numbers and do not depend on their order. A text's language is the one with the
greatest sum over its trigrams; of equals the first by name.

Learning is one pass, pre-aggregated before its shuffle; the profiles, ``top`` rows a language at most, are broadcast,
and a text's trigrams are streamed past them and added up, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dims, scratch
from ..functions import script as S
from ..functions import text as T

#: Scripts that one language stands for where nothing else is known.
BY_SCRIPT = {"cyrillic": "ru", "cjk": "zh", "arabic": "ar", "greek": "el", "devanagari": "hi"}
SHORTEST = 10


def trigrams(x: Column) -> Column:
    """The trigrams of a text's letters, words parted by one space."""
    letters = F.concat(F.lit(" "), F.regexp_replace(F.lower(x), r"[^\p{L}]+", " "), F.lit(" "))
    return F.regexp_extract_all(letters, F.lit(r"(?s)(?=(...))"), 1)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", top: int = 300) -> DataFrame:
    """(gram, weights): for each trigram of a profile, each language's weight; languages are ordered by name."""
    counts = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.explode(trigrams(F.col(text))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    counts = scratch.materialise(counts, "trigrams")
    ranked = counts.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= top)
    chosen = ranked.select("gram").distinct()
    known = counts.join(F.broadcast(chosen), "gram")
    totals = known.groupBy("lang").agg(F.sum("n").alias("total"))
    # as many rows as trigrams in profiles times languages
    size = chosen.agg(F.count("*").alias("v"))
    every = chosen.crossJoin(F.broadcast(totals)).join(known, ["gram", "lang"], "left").crossJoin(F.broadcast(size))
    weight = F.round(1000 * F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("v")))).cast("long")
    return scratch.materialise(every.groupBy("gram").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", weight.alias("w"))))).alias("weights")), "language-profiles")


def detect(texts: DataFrame, profiles: DataFrame, key: str, text: str = "text", hints: Column | None = None) -> DataFrame:
    """(key, language) for each text: '' for fewer than ten visible characters or without a known trigram.

    Texts in a script of their own are known by it; confused languages are replaced, and the first of ``hints`` (a
    column of ``texts``) counts unless the answer is one of them. Keys must differ."""
    first = profiles.select("weights").first()
    langs = sorted(first["weights"]) if first else []
    d = texts.select(F.col(key), F.col(text).alias("_x"), (hints if hints is not None else F.array().cast("array<string>")).alias("_hints"))
    grams = d.select(key, F.explode(trigrams(F.col("_x"))).alias("gram")).join(F.broadcast(profiles), "gram")
    sums = grams.groupBy(key).agg(*(F.sum(F.col("weights")[c]).alias(f"_w{i}") for i, c in enumerate(langs)), F.count("*").alias("_n"))
    best = F.array_max(F.array(*(F.struct(F.col(f"_w{i}").alias("w"), F.lit(-i).alias("i"), F.lit(c).alias("lang")) for i, c in enumerate(langs))))["lang"] if langs else F.lit("")
    d = d.join(sums.select(key, best.alias("_best")), key, "left")
    found = F.when(F.coalesce(F.length(T.ptrim(F.col("_x"))), F.lit(0)) < SHORTEST, "").otherwise(F.coalesce(dims.lookup(BY_SCRIPT, S.detect_script(F.col("_x"))), F.col("_best"), F.lit("")))
    return d.select(key, S.settle_language(found, F.col("_hints")).alias("language"))
