"""Stand-in inputs made from the driver's tables, and the same inputs as DuckDB SQL.

Conversations serve as multi-page documents: a conversation is a file, a turn a page. Three
recognisers are imitated over each page, with errors, blanks, cut texts and misreadings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii(x):
    """Non-ASCII characters as ?: the oracle's edit distance counts bytes."""
    return F.regexp_replace(x, r"[^\x00-\x7F]", "?")


def engine_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, engine, ord, text, error, confidence); one pass over the pages."""
    t = ascii(F.coalesce("text", F.lit("")))
    n = F.length(t)
    none = F.lit(None).cast("string")
    row = lambda e, k, text, error, conf: F.struct(F.lit(e).alias("engine"), F.lit(k).alias("ord"), text.alias("text"), error.alias("error"), conf.cast("double").alias("confidence"))
    rows = F.array(
        row("marker", 0, t, F.when(F.col("role") == "system", "timeout").otherwise(none), F.lit(None)),
        row("tesseract", 1, F.when(t.startswith("A"), "  ").otherwise(F.replace(F.replace(t, F.lit("rn"), F.lit("m")), F.lit("e "), F.lit("c "))), none, (n % 100) / 100.0),
        row("mathpix", 2, F.when(F.contains(t, F.lit("?")) & (F.col("role") == "user"), F.substring(t, F.lit(1), F.floor(n / 2).cast("int"))).otherwise(t), F.when(n > 1200, "too long").otherwise(none), F.when(F.col("role") == "user", 0.5)),
    )
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(rows))


ENGINE_OUTPUTS = r"""
src AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '?', 'g') AS t FROM conversations),
eo AS (
  SELECT conv_id, turn, 'marker' AS engine, 0 AS ord, t AS text, CASE WHEN role = 'system' THEN 'timeout' END AS error, CAST(NULL AS DOUBLE) AS confidence FROM src
  UNION ALL SELECT conv_id, turn, 'tesseract', 1, CASE WHEN starts_with(t, 'A') THEN '  ' ELSE replace(replace(t, 'rn', 'm'), 'e ', 'c ') END, NULL, (length(t) % 100) / 100.0 FROM src
  UNION ALL SELECT conv_id, turn, 'mathpix', 2, CASE WHEN contains(t, '?') AND role = 'user' THEN substr(t, 1, CAST(length(t) // 2 AS BIGINT)) ELSE t END,
                   CASE WHEN length(t) > 1200 THEN 'too long' END, CASE WHEN role = 'user' THEN 0.5 END FROM src),
us AS (SELECT * FROM eo WHERE error IS NULL AND trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '')
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, page_index, status, estimated_cost, confidence, text): a state table."""
    n = F.length(F.coalesce("text", F.lit("")))
    status = (
        F.when(F.col("role") == "system", "skipped").when((F.col("role") == "user") & (n < 120), "failed").when(F.col("role") == "user", "complete")
        .when(n > 900, "pending").when(n > 600, "ocr_running").when(n > 500, "merging").otherwise("extracted")
    )
    return read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("in/"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("rel_path"), F.col("turn").cast("int").alias("page_index"), status.alias("status"),
        F.when(F.col("role") == "user", 0.005).otherwise(0.0015).alias("estimated_cost"), F.when(F.col("role") != "system", (n % 100) / 100.0).cast("double").alias("confidence"), "text",
    )


PAGES = """
pg AS (SELECT 'in/' || CAST(conv_id AS VARCHAR) || '.pdf' AS rel_path, CAST(turn AS INTEGER) AS page_index,
  CASE WHEN role = 'system' THEN 'skipped' WHEN role = 'user' AND length(coalesce(text, '')) < 120 THEN 'failed' WHEN role = 'user' THEN 'complete'
       WHEN length(coalesce(text, '')) > 900 THEN 'pending' WHEN length(coalesce(text, '')) > 600 THEN 'ocr_running' WHEN length(coalesce(text, '')) > 500 THEN 'merging' ELSE 'extracted' END AS status,
  CASE WHEN role = 'user' THEN CAST(0.005 AS DOUBLE) ELSE CAST(0.0015 AS DOUBLE) END AS estimated_cost,
  CASE WHEN role <> 'system' THEN CAST((length(coalesce(text, '')) % 100) / 100.0 AS DOUBLE) END AS confidence, text FROM conversations)
"""
