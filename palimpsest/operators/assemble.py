"""Documents from pages, collections from documents, frontmatter from metadata.

A document is as large as its file and is built in one row. A collection grows with the corpus: ``write_collection``
writes it as ordered files with a manifest, and ``collection_parts`` keeps it as ordered rows; ``collection`` makes the
single text that small collections are written as.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import prefix

# Frontmatter fields in order.
FRONTMATTER = [
    "title", "authors", "document_type", "language", "doi", "isbn", "journal", "publisher", "volume", "issue", "year", "date",
    "court", "docket_number", "edition", "series", "part_number", "revision", "pages", "abstract", "keywords", "identifiers",
]


def documents(pages: DataFrame, file: list[str], index: str = "page_index", text: str = "text") -> DataFrame:
    """(file, document, n_pages): non-blank pages in order, parted by an empty line."""
    kept = pages.filter(~T.blank(F.col(text)))
    listed = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t"))))
    return kept.groupBy(*file).agg(F.array_join(F.transform(listed, lambda p: p["t"]), "\n\n").alias("document"), F.count("*").alias("n_pages"))


def _yaml(x: Column) -> Column:
    """A double-quoted YAML scalar, which is also a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def frontmatter_map(df: DataFrame) -> Column:
    """The fields that are not empty, as an ordered map of text; abstracts are cut at 500 characters."""
    pairs = []
    for f in FRONTMATTER:
        if f in df.columns:
            kind = dict(df.dtypes)[f]
            v = F.substring(F.col(f), 1, 500) if f == "abstract" else F.array_join(f, ", ") if kind.startswith("array") else F.to_json(f) if kind.startswith("map") else F.col(f).cast("string")
            pairs.append(F.struct(F.lit(f).alias("key"), F.coalesce(v, F.lit("")).alias("value")))
    return F.filter(F.array(*pairs), lambda p: ~p["value"].isin("", "{}"))


def frontmatter_document(df: DataFrame, body: str = "document") -> Column:
    """``---``, the fields as YAML, ``---``, and the body."""
    lines = []
    for f in FRONTMATTER:
        if f in df.columns:
            kind = dict(df.dtypes)[f]
            if kind.startswith("array"):
                items = F.concat(F.lit(f"{f}:\n"), F.array_join(F.transform(f, lambda x: F.concat(F.lit("- "), _yaml(x))), "\n"), F.lit("\n"))
                lines.append(F.when(F.size(F.coalesce(F.col(f), F.array().cast(kind))) > 0, items).otherwise(""))
            elif kind.startswith("map"):
                lines.append(F.when(F.size(F.coalesce(F.map_keys(f), F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{f}: "), F.to_json(f), F.lit("\n"))).otherwise(""))
            else:
                v = F.substring(F.col(f), 1, 500) if f == "abstract" else F.col(f).cast("string")
                lines.append(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{f}: "), _yaml(v), F.lit("\n"))).otherwise(""))
    block = F.concat(*lines) if lines else F.lit("")
    return F.concat(F.lit("---\n"), F.when(block == "", "{}\n").otherwise(block), F.lit("---\n\n"), F.coalesce(F.col(body), F.lit("")))


def collection_parts(docs: DataFrame, order: list[str], text: str = "document") -> DataFrame:
    """Non-blank documents in order, one row each: what a collection is made of."""
    return docs.filter(~T.blank(F.col(text))).select(*order, F.col(text).alias("part")).orderBy(*order)


def collection(docs: DataFrame, order: list[str], text: str = "document") -> DataFrame:
    """One row (n_documents, body): documents in order, parted by rules. For collections that fit a row (2 GB)."""
    kept = docs.filter(~T.blank(F.col(text)))
    listed = F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in order), F.col(text).alias("_t"))))
    return kept.agg(F.count("*").alias("n_documents"), F.array_join(F.transform(listed, lambda d: d["_t"]), "\n\n---\n\n").alias("body"))


RULE = "\n\n---\n\n"


def manifest(docs: DataFrame, order: list[str], text: str = "document", parts: int | None = None) -> DataFrame:
    """The non-blank documents with ``position`` (from 0), ``offset`` and ``bytes`` in the collection's UTF-8, ``sha256`` of
    each, and ``_part``, the file that it is in.

    Lengths are added up by ranges of the order, so neither the collection nor its list is ever in one task."""
    d = prefix.ranges(docs.filter(~T.blank(F.col(text))), order, parts)
    size = F.octet_length(text).cast("long")
    d = prefix.sums_before(d, {"position": F.lit(1).cast("long"), "offset": size + F.lit(len(RULE)).cast("long")})
    return d.withColumns({"bytes": size, "sha256": F.sha2(F.col(text), 256)})


def write_collection(docs: DataFrame, order: list[str], folder: str, text: str = "document", parts: int | None = None) -> DataFrame:
    """Writes the documents in order, parted by rules, as files under ``folder``; returns their manifest without texts.

    ``_part=N`` holds range N of the order, in one file; end to end, by number, the files are the collection and a last
    line break."""
    known = manifest(docs, order, text, parts)
    last = known.agg(F.max("position")).first()[0]
    line = F.when(F.col("position") == last, F.col(text)).otherwise(F.concat(F.col(text), F.lit(RULE[:-1])))
    # a range is one task and one file, whose rows are sorted by part first, as the writer wants them
    rows = known.select("_part", "position", line.alias("value")).repartition("_part").sortWithinPartitions("_part", "position")
    rows.select("_part", "value").write.partitionBy("_part").text(folder)
    return known.drop(text)
