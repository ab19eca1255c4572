"""State of files and pages: what is done, what is pending, and counts of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import display

DONE = ["complete", "extracted", "skipped"]
FINISHED = ["complete", "extracted"]
RUNNING = ["rendered", "ocr_running", "merging"]


def with_identity(files: DataFrame) -> DataFrame:
    """Adds sha256, short_sha and the checkpoint key of files (rel_path, content)."""
    d = files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    return d.withColumns({"short_sha": display.short_sha(F.col("sha256")), "checkpoint_key": display.checkpoint_key(F.col("rel_path"))})


def pending_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(~F.col("status").isin(DONE))


def pages_to_do(pages: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Pages that no finished row of the state table covers. Key on (rel_path, sha256) to redo changed files."""
    return pages.join(done.filter(F.col("status").isin(DONE)).select(*key).distinct(), key, "left_anti")


def files_all_done(pages: DataFrame, file: list[str]) -> DataFrame:
    return pages.groupBy(*file).agg(F.bool_and(F.col("status").isin(FINISHED)).alias("all_done"))


def _count(x: Column) -> Column:
    return F.count_if(x).cast("long")


def checkpoint_stats(pages: DataFrame, file: str = "rel_path") -> DataFrame:
    """Counts of pages by bucket over everything; skipped pages have a bucket of their own."""
    s = F.col("status")
    per_file = pages.groupBy(file).agg(
        F.count("*").alias("n"), _count(s.isin(FINISHED)).alias("c"), _count(s == "failed").alias("f"), _count(s == "pending").alias("p"),
        _count(s.isin(RUNNING)).alias("r"), _count(s == "skipped").alias("k"), F.sum("estimated_cost").alias("cost"),
    )
    return per_file.agg(
        F.count("*").alias("total_files"), F.sum("n").alias("total_pages"), F.sum("c").alias("pages_complete"), F.sum("f").alias("pages_failed"),
        F.sum("p").alias("pages_pending"), F.sum("r").alias("pages_running"), F.sum("k").alias("pages_skipped"), F.round(F.sum("cost"), 4).alias("total_cost"),
    )


def run_stats(pages: DataFrame) -> DataFrame:
    s = F.col("status")
    done = F.greatest(_count(s.isin(FINISHED)), F.lit(1))
    return pages.agg(
        F.count("*").alias("pages_processed"), _count(s.isin(FINISHED)).alias("pages_complete"), _count(s == "failed").alias("pages_failed"),
        F.round(F.sum("estimated_cost"), 4).alias("total_cost"), F.round(F.sum(F.coalesce("confidence", F.lit(0.0))) / done, 3).alias("avg_confidence"),
    )


def file_stats(pages: DataFrame, file: list[str]) -> DataFrame:
    s = F.col("status")
    return pages.groupBy(*file).agg(
        F.count("*").alias("pages_processed"), _count(s.isin(FINISHED)).alias("pages_complete"), _count(s == "failed").alias("pages_failed"),
        F.sum(F.coalesce("confidence", F.lit(0.0))).alias("confidence_sum"),
    )


def page_estimate(files: DataFrame, test_mode: bool = False) -> DataFrame:
    """Expected pages: unknown counts as 1; in test mode at most 3 for each file."""
    total = F.sum(F.coalesce("page_count", F.lit(1))).cast("long")
    return files.agg((F.least(total, 3 * F.count("*")) if test_mode else total).alias("total_pages"))


def unchanged(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose size and time of change are those of the state table."""
    return files.join(state.select("rel_path", "size_bytes", "mtime").distinct(), ["rel_path", "size_bytes", "mtime"], "left_semi")


def invalidate(state: DataFrame, files: DataFrame) -> DataFrame:
    """The state table without the rows of ``files``."""
    return state.join(files.select("rel_path").distinct(), "rel_path", "left_anti")


def migrated(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Rows of the page table from checkpoint files of any version, one JSON text a row, mixed as they come.

    Version 1 is an object of files by path; later ones hold one file under ``pdf``. Files are values of the JSON, and
    so are their pages: no schema is imposed, fields that are missing have the state's defaults, texts that are no JSON
    and files without pages give nothing. Of one path's files the one of the highest version counts, and of equal ones
    the one last updated."""
    spark = bodies.sparkSession
    texts = bodies.select(F.try_parse_json(F.col(body)).alias("v")).filter("v IS NOT NULL")
    files = spark.sql(
        """SELECT path, version, updated, file FROM (
             SELECT variant_get(v, '$.rel_path', 'string') AS path, try_variant_get(v, '$.version', 'int') AS version, coalesce(try_variant_get(v, '$.updated_at', 'string'), '') AS updated, variant_get(v, '$.pdf') AS file FROM {t} WHERE variant_get(v, '$.pdf') IS NOT NULL
             UNION ALL SELECT f.key, 1, '', f.value FROM {t}, LATERAL variant_explode(v) AS f WHERE variant_get(v, '$.pdf') IS NULL AND f.key IS NOT NULL AND schema_of_variant(f.value) LIKE 'OBJECT<%')
           WHERE variant_get(file, '$.pages') IS NOT NULL""",
        t=texts,
    )
    latest = W.partitionBy("path").orderBy(F.desc("version"), F.desc("updated"))
    files = files.withColumn("k", F.row_number().over(latest)).filter("k = 1")
    pages = spark.sql(
        """SELECT path AS rel_path, version, coalesce(try_variant_get(file, '$.sha256', 'string'), '') AS sha256, p.pos, p.value AS page FROM {f}, LATERAL variant_explode(variant_get(file, '$.pages')) AS p""", f=files
    )
    of = lambda name, kind: F.expr(f"try_variant_get(page, '$.{name}', '{kind}')")
    index = F.coalesce(of("page_index", "int"), F.col("pos"))
    return pages.select(
        "rel_path", "version", "sha256", index.alias("page_index"), F.coalesce(of("page_label", "string"), display.page_label(index)).alias("page_label"), F.coalesce(of("status", "string"), F.lit("pending")).alias("status"),
        F.coalesce(of("estimated_cost", "double"), F.lit(0.0)).alias("estimated_cost"), of("confidence", "double").alias("confidence"), of("error", "string").alias("error"),
    )
