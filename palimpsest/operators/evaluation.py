"""Summaries of error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import script as S
from ..functions import text as T

def profile_summary(results: DataFrame) -> DataFrame:
    """Means of cer and wer for each profile, and over all items (profile null): a rollup, so the overall mean is of items."""
    return results.rollup("profile").agg(F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"), F.count("*").alias("items")).orderBy(F.col("profile").asc_nulls_last())


def script_config_summary(results: DataFrame) -> DataFrame:
    """Means by (script, config); null error rates are left out."""
    return results.groupBy("script", "config").agg(
        F.avg("char_count").alias("avg_chars"), F.avg("word_count").alias("avg_words"), F.avg("non_latin_ratio").alias("avg_non_latin"), F.avg("cer").alias("avg_cer"), F.count("*").alias("pages")
    ).orderBy("script", "config")


def against_baseline(outputs: DataFrame, baselines: DataFrame, page: list[str]) -> DataFrame:
    """Each output page with the first baseline that exists for it (least ``candidate_rank``), or null."""
    best = baselines.groupBy(*page).agg(F.min_by("text", "candidate_rank").alias("baseline_text"))
    return outputs.join(best, page, "left")


def unmatched(truth: DataFrame, outputs: DataFrame, key: list[str]) -> DataFrame:
    """Ground truth without an output: reported, not scored."""
    return truth.join(outputs.select(*key).distinct(), key, "left_anti")


# The columns of the two reports.
BENCHMARK_COLUMNS = ["profile", "fixture", "cer", "wer", "ref_chars", "hyp_chars"]
METRIC_COLUMNS = [
    "config", "profile", "script", "pdf_hash", "page", "char_count", "word_count", "non_latin_ratio", "cyrillic_found", "cjk_found", "arabic_found", "diacritics_found",
    "engines_agreement", "engine_count", "cross_cer_vs_baseline",
]


def benchmark(truth: DataFrame, outputs: DataFrame, key: list[str]) -> DataFrame:
    """One scored row (BENCHMARK_COLUMNS) for each ground truth (profile, fixture, reference) with an output (hypothesis)."""
    scored = metrics.evaluate(truth.join(outputs, key))
    return scored.select(*BENCHMARK_COLUMNS).orderBy("fixture")


def page_metrics(pages: DataFrame, baselines: DataFrame, page: list[str]) -> DataFrame:
    """METRIC_COLUMNS of pages (config, profile, script, pdf_hash, page, text, engines_agreement, engine_count).

    A leading comment is cut off first; the error rate is against the first baseline of the page, null without one."""
    plain = pages.withColumn("text", T.strip_leading_comment(F.coalesce("text", F.lit(""))))
    d = metrics.spread(against_baseline(plain, baselines, page))
    t = F.col("text")
    return d.withColumns({
        "char_count": F.length(t).cast("long"), "word_count": T.word_count(t), "non_latin_ratio": T.non_latin_ratio(t),
        **{f"{s}_found": S.has_script(t, s) for s in ("cyrillic", "cjk", "arabic", "diacritics")},
        "cross_cer_vs_baseline": metrics.study_cer(t, T.strip_leading_comment(F.col("baseline_text"))),
    }).select(*METRIC_COLUMNS)


def write_report(rows: DataFrame, path: str) -> None:
    """A report as one CSV file with a header: reports are summaries, a few thousand rows at most."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)
