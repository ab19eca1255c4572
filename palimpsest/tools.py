"""Tool functions over the library, and views of what it knows: formats, profiles, languages, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from . import dims
from .operators import language, state, store
from .pipeline import Pipeline
from .sources import files, reader

PREVIEW, ABSTRACT = 2000, 500


def formats(spark: SparkSession) -> DataFrame:
    """Every known ending with its format and media type."""
    return dims.dim_extension(spark).orderBy("ext")


def profiles(spark: SparkSession, user: dict | None = None) -> DataFrame:
    return dims.dim_profile(spark, dims.PROFILES | (user or {})).orderBy("profile")


def engines(spark: SparkSession, available: set[str] | frozenset = frozenset()) -> DataFrame:
    """Engines with cost, number of languages, and whether one is at hand."""
    n = dims.dim_engine_language(spark).groupBy("engine").agg(F.count("*").alias("languages"))
    return dims.dim_engine(spark).join(n, "engine", "left").select("engine", "cost", F.coalesce("languages", F.lit(0)).alias("languages"), F.col("engine").isin(*available or {""}).alias("available")).orderBy("engine")


def languages(spark: SparkSession, engine: str | None = None) -> DataFrame:
    """Codes and names, of one engine if it is named."""
    if engine is None:
        return dims.dim_language(spark).orderBy("code")
    known = dims.engine_languages()
    if engine not in known:
        raise settings.ConfigError(f"unknown engine {engine}; known: {', '.join(sorted(known))}")
    el = dims.dim_engine_language(spark).filter(F.col("engine") == engine).select("code")
    return el.join(dims.dim_language(spark), "code", "left").select("code", F.coalesce("name", "code").alias("name")).orderBy("code")


def unknown_languages(codes: list[str]) -> list[str]:
    """One warning for each unknown code, with a suggestion where one is known."""
    out = []
    for c in codes:
        if c not in dims.LANGUAGE_NAMES:
            fix = dims.CODE_SUGGESTIONS.get(c.lower())
            out.append(f"unknown language code {c!r}" + (f"; did you mean {fix!r} ({dims.LANGUAGE_NAMES[fix]})?" if fix else ""))
    return out


def detect(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, mimetype, size_mb, verdict) of files."""
    d = files.detect(spark.read.format("binaryFile").load(path))
    return d.select("path", "format", "mimetype", F.round(F.col("length") / 1048576.0, 2).alias("size_mb"), files.size_verdict(F.col("length") / 1048576.0).alias("verdict"))


def dry_run(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    return files.listing(files.scan(spark, folder, extensions))


def page(spark: SparkSession, path: str, page_index: int) -> DataFrame:
    found = files.detect(spark.read.format("binaryFile").load(path))
    return reader.pages(found).filter(F.col("page_index") == page_index).select("path", "page_label", "text", "page_count", "error")


def document_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A file's metadata as columns, the abstract cut."""
    d = reader.pages(files.detect(spark.read.format("binaryFile").load(path))).filter("page_index = 0").select("path", "metadata.*")
    return d.withColumn("abstract", F.substring("abstract", 1, ABSTRACT))


def process(spark: SparkSession, config: settings.Config, engines: list | None = None, merger=None) -> DataFrame:
    """Run and return (path, title, preview, n_pages) of the documents."""
    p = Pipeline(spark, config, engines or [], merger)
    p.run()
    d = spark.read.parquet(f"{config.output_dir}/documents")
    return d.select("path", "title", F.substring("document", 1, PREVIEW).alias("preview"), "n_pages")


def status(spark: SparkSession, output_dir: str) -> DataFrame:
    return state.checkpoint_stats(store.pages_table(spark, output_dir).read().withColumnRenamed("path", "rel_path"))


def transcript(texts: DataFrame, profiles: DataFrame, key: str = "path", column: str = "text", limit: int = 10_000) -> DataFrame:
    """Transcripts with their language by ``profiles`` (``language.learn``), cut for display."""
    found = language.detect(texts, profiles, key, column)
    return texts.join(found, key).withColumn(column, F.substring(column, 1, limit))


def handwriting_lines(lines: DataFrame, page_key: list[str], per_page: int = 50) -> DataFrame:
    """(page, text, confidence): recognised lines (line_no, text, confidence) joined, 50 a page at most; no lines: 0."""
    kept = lines.filter(F.col("line_no") <= per_page)
    listed = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return kept.groupBy(*page_key).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
