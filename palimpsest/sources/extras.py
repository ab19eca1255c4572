"""Answers of outside programs and parts of containers, as rows: header and reference records, media probes, images."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tiff", ".tif", ".svg")
_LEAST_BYTES = 100


_AUTHOR = "struct<_VALUE:string,persName:struct<forename:array<string>,surname:string>>"
_ID = "struct<_VALUE:string,_type:string>"
_MONOGR = "struct<title:array<string>,imprint:struct<biblScope:array<struct<_VALUE:string,_unit:string>>,date:array<struct<_VALUE:string,_when:string,_type:string>>>>"
_ENTRY = f"struct<author:array<{_AUTHOR}>,idno:array<{_ID}>,note:array<string>,analytic:struct<title:array<string>,author:array<{_AUTHOR}>,idno:array<{_ID}>>,monogr:{_MONOGR}>"
_TITLED = "titleStmt:struct<title:array<string>>"
_SOURCE = f"sourceDesc:struct<biblStruct:{_ENTRY}>"
_LISTED = f"listBibl:array<struct<biblStruct:array<{_ENTRY}>>>"
#: Records as outside programs write them; each part also where shorter records have it.
RECORD = (
    f"teiHeader struct<fileDesc:struct<{_TITLED},{_SOURCE}>,{_TITLED},{_SOURCE},profileDesc:struct<abstract:struct<p:array<string>,div:array<struct<p:array<string>>>>,textClass:struct<keywords:struct<term:array<string>>>>>, "
    f"text struct<{_LISTED},back:struct<{_LISTED},div:array<struct<{_LISTED}>>>>"
)


def _text(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit(""))


def _first(x: Column) -> Column:
    return _text(F.get(x, 0))


def _all(x: Column, kind: str) -> Column:
    return F.coalesce(x, F.array().cast(f"array<{kind}>"))


def record(xml: Column) -> Column:
    """A record's XML as a struct, prefixes of names left out; null fields where it is broken."""
    return F.from_xml(F.regexp_replace(xml, r"(</?)[A-Za-z_][\w.-]*:", "$1"), RECORD, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})


def person(author: Column) -> Column:
    """Forenames and surname, else what the element says itself."""
    names = F.concat(_all(author["persName"]["forename"], "string"), F.array(author["persName"]["surname"]))
    named = F.array_join(F.filter(F.transform(names, _text), lambda n: n != ""), " ")
    return F.coalesce(F.nullif(named, F.lit("")), _text(author["_VALUE"]))


def people(authors: Column) -> Column:
    return F.filter(F.transform(_all(authors, _AUTHOR), person), lambda n: n != "")


def _doi(entry: Column) -> Column:
    ids = F.concat(_all(entry["analytic"]["idno"], _ID), _all(entry["idno"], _ID))
    return _text(F.get(F.filter(ids, lambda i: i["_type"] == "DOI"), 0)["_VALUE"])


def _authors(entry: Column) -> Column:
    return F.concat(people(entry["analytic"]["author"]), people(entry["author"]))


def _imprint(entry: Column) -> dict[str, Column]:
    i = entry["monogr"]["imprint"]
    scope = lambda unit: _text(F.get(F.filter(i["biblScope"], lambda s: s["_unit"] == unit), 0)["_VALUE"])
    date = F.coalesce(F.get(F.filter(i["date"], lambda d: d["_type"] == "published"), 0), F.get(i["date"], 0))
    year = F.coalesce(F.nullif(F.substring(date["_when"], 1, 4), F.lit("")), _text(date["_VALUE"]))
    return {"journal": _first(entry["monogr"]["title"]), "volume": scope("volume"), "issue": scope("issue"), "pages": scope("page"), "year": year}


def headers(records: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """(key, title, authors, abstract, keywords, doi, journal, volume, issue, pages, year) of header records; '' where
    missing or broken."""
    d = records.select(key, record(F.col(xml)).alias("_r"))
    h = F.col("_r")["teiHeader"]
    entry = F.coalesce(h["fileDesc"]["sourceDesc"]["biblStruct"], h["sourceDesc"]["biblStruct"])
    about = h["profileDesc"]["abstract"]
    terms = F.filter(F.transform(_all(h["profileDesc"]["textClass"]["keywords"]["term"], "string"), _text), lambda t: t != "")
    return d.select(
        key, F.coalesce(F.get(h["fileDesc"]["titleStmt"]["title"], 0), _first(h["titleStmt"]["title"])).alias("title"), _authors(entry).alias("authors"), F.coalesce(F.get(about["p"], 0), _first(F.get(about["div"], 0)["p"])).alias("abstract"),
        terms.alias("keywords"), _doi(entry).alias("doi"), *(v.alias(k) for k, v in _imprint(entry).items()),
    )


def references(records: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """(key, number, title, authors, doi, journal, year, volume, pages, raw): one row a reference; empty ones are left out."""
    t = F.col("_r")["text"]
    kind = f"struct<biblStruct:array<{_ENTRY}>>"
    lists = F.concat(_all(t["listBibl"], kind), _all(t["back"]["listBibl"], kind), F.flatten(F.transform(_all(t["back"]["div"], f"struct<{_LISTED}>"), lambda d: _all(d["listBibl"], kind))))
    entries = F.flatten(F.transform(lists, lambda x: _all(x["biblStruct"], _ENTRY)))

    def fields(e: Column) -> dict[str, Column]:
        im = _imprint(e)
        return {"title": _first(e["analytic"]["title"]), "authors": _authors(e), "doi": _doi(e), **{k: im[k] for k in ("journal", "year", "volume", "pages")}, "raw": _first(e["note"])}

    rows = F.transform(entries, lambda e: F.struct(*(v.alias(k) for k, v in fields(e).items())))
    kept = F.filter(rows, lambda r: (F.size(r["authors"]) > 0) | (F.concat(*(r[k] for k in ("title", "doi", "journal", "year", "volume", "pages", "raw"))) != ""))
    return records.select(key, record(F.col(xml)).alias("_r")).select(key, F.posexplode(kept).alias("number", "_e")).select(key, "number", "_e.*")


PROBE = "format struct<format_name:string,duration:string,bit_rate:string,size:string>, streams array<struct<codec_type:string,codec_name:string,channels:string,width:string,height:string>>"


def media_summary(name: Column, kind: Column, probe: Column) -> Column:
    """The Markdown page of a media file from its probe (JSON)."""
    p = F.from_json(probe, PROBE)
    known = lambda x: F.coalesce(x, F.lit("unknown"))
    line = lambda s, i: (
        F.when(s["codec_type"] == "audio", F.concat(F.lit("- Stream "), i.cast("string"), F.lit(": audio ("), F.coalesce(s["codec_name"], F.lit("?")), F.lit("), "), F.coalesce(s["channels"], F.lit("")), F.lit(" ch")))
        .when(s["codec_type"] == "video", F.concat(F.lit("- Stream "), i.cast("string"), F.lit(": video ("), F.coalesce(s["codec_name"], F.lit("?")), F.lit("), "), F.coalesce(s["width"], F.lit("?")), F.lit("x"), F.coalesce(s["height"], F.lit("?"))))
        .otherwise(F.concat(F.lit("- Stream "), i.cast("string"), F.lit(": "), F.coalesce(s["codec_type"], F.lit("?"))))
    )
    f = p["format"]
    streams = F.array_join(F.transform(F.coalesce(p["streams"], F.array().cast("array<struct<codec_type:string,codec_name:string,channels:string,width:string,height:string>>")), line), "\n")
    return F.concat(
        F.lit("# "), F.initcap(kind), F.lit(": "), name, F.lit("\n\n**Format**: "), known(f["format_name"]), F.lit("\n**Duration**: "), known(f["duration"]), F.lit("s\n**Bitrate**: "), known(f["bit_rate"]),
        F.lit("\n**Size**: "), known(f["size"]), F.lit(" bytes\n\n## Streams\n\n"), streams,
    )


def embedded_images(files: DataFrame, extra: dict[str, Callable] | None = None) -> DataFrame:
    """(path, name, ext, data): images inside zip containers (EPUB, DOCX, PPTX, ODT), each content of a file once, none under 100 bytes.

    ``extra``: functions (bytes) -> [(name, data)] for other formats, by format name."""

    def run(batches):
        for b in batches:
            rows = []
            for path, kind, content in zip(b["path"], b["format"], b["content"], strict=True):
                try:
                    if extra and kind in extra:
                        found = extra[kind](bytes(content))
                    else:
                        with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                            found = [(n, z.read(n)) for n in sorted(z.namelist()) if n.lower().endswith(_IMAGE_ENDINGS)]
                except Exception:
                    continue
                for n, data in found:
                    ext = n.rsplit(".", 1)[-1].lower()
                    rows.append((path, n.replace("/", "_").replace("\\", "_"), {"jpeg": "jpg"}.get(ext, ext), data))
            yield pd.DataFrame(rows, columns=["path", "name", "ext", "data"])

    images = files.select("path", "format", "content").mapInPandas(run, "path string, name string, ext string, data binary")
    big = images.filter(F.length("data") >= _LEAST_BYTES).withColumn("_sha", F.sha2("data", 256))
    return big.groupBy("path", "_sha").agg(F.min_by(F.struct("name", "ext", "data"), "name").alias("i")).select("path", "i.*")
