"""Metadata: first hit of several sources, and filling of empty fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identifiers

TEXT_FIELDS = ["title", "date", "language", "publisher", "document_type", "doi", "isbn", "abstract"]


def filled(current: Column, other: Column) -> Column:
    """``current`` unless it is empty."""
    return F.coalesce(F.nullif(current, F.lit("")), other, current)


def filled_list(current: Column, other: Column) -> Column:
    return F.when(F.size(F.coalesce(current, F.array().cast("array<string>"))) > 0, current).otherwise(F.coalesce(other, current))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def html_precedence(meta: Column) -> Column:
    """Title, author, publisher, date and language from the names that pages use for them; ``meta`` is a map."""
    get = lambda *names: first_non_empty(*(F.try_element_at(meta, F.lit(n)) for n in names))
    return F.struct(
        get("title", "citation_title", "dc.title", "og:title").alias("title"), get("author", "citation_author", "dc.creator").alias("author"),
        get("publisher", "dc.publisher", "citation_publisher").alias("publisher"), get("date", "citation_date", "dc.date").alias("date"), get("dc.language", "language").alias("language"),
    )


def fill_from_sidecar(meta: DataFrame, sidecar: DataFrame, key: str = "rel_path") -> DataFrame:
    """Left join of sidecar rows (key, text fields, authors, keywords): they only fill what is empty."""
    have = [c for c in [*TEXT_FIELDS, "authors", "keywords"] if c in meta.columns and c in sidecar.columns]
    s = sidecar.select(key, *(F.col(c).alias(f"_s_{c}") for c in have), F.lit(True).alias("_hit"))
    d = meta.join(s, key, "left")
    d = d.withColumns({c: (filled_list if c in ("authors", "keywords") else filled)(F.col(c), F.col(f"_s_{c}")) for c in have})
    if "extraction_method" in meta.columns:
        d = d.withColumn("extraction_method", F.when(F.col("_hit"), F.concat(F.lit("sidecar+"), "extraction_method")).otherwise(F.col("extraction_method")))
    return d.drop("_hit", *(f"_s_{c}" for c in have))


def first_hit(candidates: DataFrame, key: list[str], rank: str, hit: Column) -> DataFrame:
    """For each key the candidate row of least rank that is a hit (native, model, header service, none)."""
    w = W.partitionBy(*key).orderBy(rank)
    return candidates.filter(hit).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_pages(pages: DataFrame, key: list[str], index: str = "page_index", text: str = "text", n: Column | int = 3) -> DataFrame:
    """(key, pages): what a model is shown to find metadata, the first ``n`` pages (1 to 5, whatever is asked), in order.

    Not more than five pages of a file are held at a time, however many it has."""
    most = F.least(F.greatest(F.coalesce(n if isinstance(n, Column) else F.lit(n), F.lit(1)), F.lit(1)), F.lit(5))
    d = pages.withColumns({"_n": most, "_k": F.row_number().over(W.partitionBy(*key).orderBy(index))}).filter(F.col("_k") <= F.col("_n"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.coalesce(text, F.lit("")).alias("t"))))
    return d.groupBy(*key).agg(F.transform(listed, lambda p: p["t"]).alias("pages"))


def enrich(meta: DataFrame, dois: DataFrame, isbns: DataFrame) -> DataFrame:
    """Fill from registry answers: ``dois`` (doi, body) first, then ``isbns`` (isbn, body)."""
    d = meta.withColumns({"_doi": identifiers.normalize_doi(F.coalesce("doi", F.lit(""))), "_isbn": identifiers.normalize_isbn(F.coalesce("isbn", F.lit("")))})
    a = dois.select(identifiers.normalize_doi(F.col("doi")).alias("_doi"), identifiers.crossref_fields(F.col("body")).alias("_a")).dropDuplicates(["_doi"])
    b = isbns.select(identifiers.normalize_isbn(F.col("isbn")).alias("_isbn"), identifiers.library_fields(F.col("body")).alias("_b")).dropDuplicates(["_isbn"])
    d = d.join(a, "_doi", "left").join(b, "_isbn", "left")
    for c in ("title", "publisher", "language", "abstract"):
        if c in meta.columns:
            d = d.withColumn(c, filled(filled(F.col(c), F.col(f"_a.{c}")), F.col(f"_b.{c}") if c != "abstract" else F.lit(None)))
    if "date" in meta.columns:
        d = d.withColumn("date", filled(filled(F.col("date"), F.col("_a.year")), F.col("_b.year")))
    if "authors" in meta.columns:
        names = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.split(c, "; "))
        d = d.withColumn("authors", filled_list(filled_list(F.col("authors"), names("_a.authors")), names("_b.authors")))
    if "keywords" in meta.columns:
        d = d.withColumn("keywords", filled_list(F.col("keywords"), F.when(F.coalesce(F.col("_b.subjects"), F.lit("")) != "", F.split("_b.subjects", ", "))))
    return d.drop("_doi", "_isbn", "_a", "_b")


def model_json(answer: Column) -> Column:
    """A model's metadata answer: fences off, null as '', identifiers split out."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(answer), r"\A```[a-zA-Z]*\s*", ""), r"\s*```\z", "")
    m = F.from_json(plain, "title string, authors array<string>, document_type string, language string, date string, publisher string, journal string, abstract string, keywords array<string>, identifiers map<string,string>")
    text = lambda c: F.coalesce(m[c], F.lit(""))
    ident = lambda k: F.coalesce(F.try_element_at(m["identifiers"], F.lit(k)), F.lit(""))
    lists = lambda c: F.coalesce(F.filter(m[c], lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return F.struct(*(text(c).alias(c) for c in ("title", "document_type", "language", "date", "publisher", "journal", "abstract")), lists("authors").alias("authors"), lists("keywords").alias("keywords"), ident("doi").alias("doi"), ident("isbn").alias("isbn"))
