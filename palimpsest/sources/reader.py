"""Files to pages: one pass over each file's bytes gives its pages and its metadata."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SizeError
from ..functions import display
from . import files as _files
from . import parse_text
from .parse_python import PARSERS

META = (
    "struct<title:string,authors:array<string>,date:string,language:string,publisher:string,document_type:string,doi:string,isbn:string,abstract:string,"
    "keywords:array<string>,extraction_method:string,extra:map<string,string>>"
)
PAGES = f"path string, format string, sha256 string, page_index int, page_label string, text string, page_count int, error string, metadata {META}"
_TEXT = ("title", "date", "language", "publisher", "document_type", "doi", "isbn", "abstract", "extraction_method")
#: Formats that an outside program must read; a function (bytes, name) -> (pages, metadata) can be given for each.
EXTERNAL = ("djvu", "ebook", "media")


def _record(meta: dict) -> dict:
    strings = {k: str(meta.get(k) or "") for k in _TEXT}
    lists = {k: [str(x) for x in meta.get(k) or []] for k in ("authors", "keywords")}
    return strings | lists | {"extra": [(str(k), str(v)) for k, v in (meta.get("extra") or {}).items()]}


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches by size, unless the session says otherwise: a batch of whole files may not be 10,000 of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most))


def parsed_pages(found: DataFrame, extra: dict[str, Callable] | None = None) -> DataFrame:
    """Pages of files (path, format, content[, text]) by parsers, in Arrow batches.

    ``text``, where it is not null, is the only page already. A file that fails is one row with its error,
    and so is one without content (``files.scan`` leaves it out of files of refused size)."""
    bound_batches(found.sparkSession)
    parsers = PARSERS | (extra or {})
    given = F.col("text") if "text" in found.columns else F.lit(None).cast("string")
    # one pass over the bytes: what needs no parser leaves them behind
    d = found.select("path", "format", F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha256"), F.when(given.isNull(), F.col("content")).alias("content"), given.alias("text"))
    schema = f"path string, format string, sha256 string, page_index int, text string, page_count int, error string, metadata {META}"
    text = pa.string()
    arrow = pa.struct([*((k, text) for k in ("title",)), ("authors", pa.list_(text)), *((k, text) for k in ("date", "language", "publisher", "document_type", "doi", "isbn", "abstract")), ("keywords", pa.list_(text)), ("extraction_method", text), ("extra", pa.map_(text, text))])
    kinds = pa.schema([("path", text), ("format", text), ("sha256", text), ("page_index", pa.int32()), ("text", text), ("page_count", pa.int32()), ("error", text), ("metadata", arrow)])

    def of_file(path, kind, content, only) -> tuple[list[str], dict, str | None]:
        if only is not None:
            sub = kind == "subtitle"
            return [only], {"document_type": kind if sub else "", "extraction_method": "subtitle-parsing" if sub else "none"}, None
        try:
            if content is None:
                raise SizeError("too large to be read")
            if kind not in parsers:
                raise ValueError(f"no reader for {kind} is given")
            return *parsers[kind](content, path.rsplit("/", 1)[-1]), None
        except Exception as e:
            return [], {}, f"{type(e).__name__}: {e}"

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for path, kind, sha, content, only in zip(*(b[c] for c in ("path", "format", "sha256", "content", "text")), strict=True):
                path, kind, sha = path.as_py(), kind.as_py(), sha.as_py()
                pages, meta, error = of_file(path, kind, content.as_py(), only.as_py())
                record = _record(meta)
                for k, t in enumerate(pages or [None]):
                    rows.append((path, kind, sha, k, t, len(pages), error, record))
                    size += len(t or "") + 500
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return d.mapInArrow(run, schema).withColumn("page_label", display.page_label(F.col("page_index")))


def native_text(found: DataFrame) -> Column:
    """The text of formats that columns express; null for others and for files without content."""
    content = F.col("content")
    t = parse_text.decode(content)
    text = F.when(F.col("format") == "subtitle", parse_text.subtitles(t, F.col("ext"))).when(F.col("format") == "dxf", parse_text.dxf(t)).when(F.col("format") == "txt", parse_text.plain_text(content))
    return F.when(content.isNotNull(), text)


def pages(found: DataFrame, extra: dict[str, Callable] | None = None, test_mode: bool = False) -> DataFrame:
    """Pages of detected files (``files.detect``), in one pass over them. ``test_mode``: three pages a file."""
    out = parsed_pages(found.withColumn("text", native_text(found)), extra)
    return out.filter("page_index < 3") if test_mode else out


def read_folder(spark: SparkSession, folder: str, extensions: list[str] | None = None, extra: dict[str, Callable] | None = None, test_mode: bool = False) -> DataFrame:
    """Scan, guard, detect, parse."""
    return pages(_files.detect(_files.scan(spark, folder, extensions)), extra, test_mode)


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(path, fields): YAML files beside documents, ``{file}.meta.yaml`` before ``{file}.meta.yml``; malformed ones are empty."""
    import yaml

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.{yaml,yml}").load(folder).select("path", "content")
    schema = "path string, rank int, title string, authors array<string>, date string, language string, publisher string, document_type string, doi string, isbn string, abstract string, keywords array<string>, license string, license_url string"

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    data = yaml.safe_load(bytes(content).decode("utf-8"))
                except (yaml.YAMLError, UnicodeDecodeError):
                    data = None
                if not isinstance(data, dict):
                    continue
                listed = lambda v, sep=None: [str(x) for x in v] if isinstance(v, list) else ([x.strip() for x in str(v).split(sep)] if sep else [str(v)]) if v else []
                texts = {k: str(data[k]) if data.get(k) else "" for k in ("title", "date", "language", "publisher", "document_type", "doi", "isbn", "abstract", "license", "license_url")}
                rows.append(texts | {"path": path.rsplit(".meta.", 1)[0], "rank": int(path.endswith(".yml")), "authors": listed(data.get("authors") or data.get("author")), "keywords": listed(data.get("keywords"), ",")})
            import pandas as pd

            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    d = found.mapInPandas(run, schema)
    one = d.groupBy("path").agg(F.min_by(F.struct(*(F.col(c) for c in d.columns if c not in ("path", "rank"))), "rank").alias("s"))
    return one.select("path", "s.*")
