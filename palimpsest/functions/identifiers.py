"""Identifiers of works: DOIs, ISBNs, and the records that registries give for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

CROSSREF_SCHEMA = (
    "message struct<title:array<string>,`container-title`:array<string>,author:array<struct<given:string,family:string>>,publisher:string,volume:string,issue:string,page:string,"
    "ISSN:array<string>,DOI:string,type:string,abstract:string,language:string,issued:struct<`date-parts`:array<array<int>>>,license:array<struct<URL:string>>,subject:array<string>>"
)
LIBRARY_SCHEMA = "title string, publish_date string, publishers array<struct<name:string>>, authors array<struct<name:string>>, subjects array<struct<name:string>>, languages array<struct<key:string>>"


def normalize_doi(x: Column) -> Column:
    return F.regexp_replace(T.ptrim(x), r"^https?://(dx\.)?doi\.org/", "")


def normalize_isbn(x: Column) -> Column:
    return F.regexp_replace(T.ptrim(x), "[- ]", "")


def epub_isbn(identifiers: Column) -> Column:
    """The last urn:isbn:, else the first bare number of 10 or 13 characters."""
    urns = F.filter(identifiers, lambda v: v.startswith("urn:isbn:"))
    bare = F.filter(identifiers, lambda v: F.length(v).isin(10, 13) & F.rlike(F.replace(v, F.lit("-"), F.lit("")), F.lit("^[0-9]+$")))
    return F.coalesce(F.replace(F.try_element_at(urns, F.lit(-1)), F.lit("urn:isbn:"), F.lit("")), F.try_element_at(bare, F.lit(1)), F.lit(""))


def crossref_fields(body: Column) -> Column:
    """The fields of a registry answer for a DOI, '' where missing."""
    m = F.from_json(body, CROSSREF_SCHEMA)["message"]
    one = lambda x: F.coalesce(x, F.lit(""))
    people = F.transform(m["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    year = F.get(F.get(m["issued"]["date-parts"], 0), 0).cast("string")
    license_url = F.try_element_at(F.filter(F.transform(m["license"], lambda v: v["URL"]), lambda u: u != ""), F.lit(1))
    return F.struct(
        one(F.get(m["title"], 0)).alias("title"), one(F.array_join(F.filter(people, lambda p: p != ""), "; ")).alias("authors"), one(F.get(m["container-title"], 0)).alias("journal"),
        one(m["publisher"]).alias("publisher"), one(m["volume"]).alias("volume"), one(m["issue"]).alias("issue"), one(m["page"]).alias("pages"), one(year).alias("year"),
        one(m["abstract"]).alias("abstract"), one(m["language"]).alias("language"), one(m["type"]).alias("document_type"), one(license_url).alias("license_url"),
    )


def library_fields(body: Column) -> Column:
    """The fields of a library answer for an ISBN; the year is the first run of four digits of the date."""
    m = F.from_json(body, LIBRARY_SCHEMA)
    names = lambda a, sep: F.coalesce(F.array_join(F.transform(m[a], lambda x: x["name"]), sep), F.lit(""))
    return F.struct(
        F.coalesce(m["title"], F.lit("")).alias("title"), names("authors", "; ").alias("authors"), F.coalesce(F.get(m["publishers"], 0)["name"], F.lit("")).alias("publisher"),
        F.coalesce(F.regexp_extract(m["publish_date"], r"\b(\d{4})\b", 1), F.lit("")).alias("year"),
        F.coalesce(F.element_at(F.split(F.get(m["languages"], 0)["key"], "/"), -1), F.lit("")).alias("language"), names("subjects", ", ").alias("subjects"),
    )
