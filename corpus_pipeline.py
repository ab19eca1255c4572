"""A training corpus from raw documents: quality, exact copies, near copies, leaks, packing.

Each stage is written as Parquet and read again as the next one's documents. All but the last keep
the columns of documents, whatever they are, and their types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import common as C
from palimpsest.llm import decontaminate, exact_dedup, jaccard_join, packing, quality


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go.

    Null and empty texts are scored as empty; every row is judged by itself, so repeated rows and null ids are
    too; without labelled rows all scores are 0.5 and all rows stay; an empty table stays empty."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest doc_id stays.

    Null counts as empty here, but stays null in a row that is kept; a null doc_id is the smallest; of rows with
    equal text and id one stays; an empty table stays empty."""
    return exact_dedup.deduplicate(docs)


def keep_dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the smallest doc_id of each group of near copies stays.

    Texts without words are in no group and stay; a null doc_id is the smallest and stays; rows that share the
    smallest id all stay; an empty table stays empty."""
    return jaccard_join.keep_first(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a verified test item go.

    Null and empty texts hold none and stay; repeated rows and null ids are judged by their texts; without test
    items all stay; an empty table stays empty."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: one row for each piece of each document, with its token ids, its bin and its place there.

    Null and empty texts are one piece with the end token alone; repeated rows are packed each, null ids like
    others; an empty table gives no rows. Other columns do not go into bins."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", keep_distinct),
    ("n-gram Jaccard join", keep_dissimilar),
    ("benchmark decontamination", keep_clean),
    ("best-fit packing", pack),
]

#: The classifier and later stages are no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = C.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
