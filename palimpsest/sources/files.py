"""Files as rows: scan, size guard, format detection.

``binaryFile`` lists paths, lengths and times without opening files; ``content`` is read only
by stages that need it, and filters on length and time are pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims

REFUSE_MB, WARN_MB = 2000.0, 500.0
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def size_verdict(megabytes: Column) -> Column:
    """'refused' over 2000 MB, 'large' over 500 MB, else 'ok'; unknown sizes pass."""
    return F.when(megabytes > REFUSE_MB, "refused").when(megabytes > WARN_MB, "large").otherwise("ok")


def scan(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder; content is null for files of refused
    size, whose bytes are never read (the condition on length is part of the scan)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        either = ",".join(sorted({e.lstrip(".") for e in extensions}))
        reader = reader.option("pathGlobFilter", f"*.{{{either}}}")
    found, most = reader.load(folder), int(REFUSE_MB * 1048576)
    refused = found.filter(F.col("length") > most).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return found.filter(F.col("length") <= most).unionByName(refused)


def listing(files: DataFrame) -> DataFrame:
    """The dry run: distinct paths with their size and verdict, in order. Contents are not read."""
    megabytes = F.col("length") / 1048576.0
    return files.select("path", F.round(megabytes, 2).alias("size_mb"), size_verdict(megabytes).alias("verdict")).distinct().orderBy("path")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ending(path: Column) -> Column:
    """The longest known ending of a file name (``.tei.xml`` before ``.xml``), in lower case, '' if none."""
    name = F.lower(file_name(path))
    last = F.regexp_extract(name, r"[^/](\.[^./]+)$", 1)
    two = F.regexp_extract(name, r"[^/](\.[^./]+\.[^./]+)$", 1)
    known = dims.map_of(dims.ENDINGS)
    return F.when(F.map_contains_key(known, two), two).otherwise(last)


def zip_directory(content: Column) -> Column:
    """The central directory of a zip file (the names of all members), as text; null if its end record is missing."""
    # the end record is at most 65,557 bytes before the end: size and place of the directory follow its signature
    tail = F.decode(F.substring(content, -65557, 65557), "ISO-8859-1")
    record = F.encode(F.when(F.contains(tail, F.lit("PK\x05\x06")), F.substring_index(tail, "PK\x05\x06", -1)), "ISO-8859-1")
    number = lambda at: F.conv(F.concat(*(F.hex(F.substring(record, at + k, 1)) for k in (3, 2, 1, 0))), 16, 10).cast("long")
    return F.decode(content.substr((number(13) + 1).cast("int"), number(9).cast("int")), "ISO-8859-1")


def sniff(content: Column) -> Column:
    """A format from the first bytes (of a zip file also from its directory), or null."""
    head = F.substring(content, 1, 4096)
    starts = lambda h: F.hex(F.substring(head, 1, len(h) // 2)) == h
    names = F.when(starts("504B0304"), F.concat(F.decode(head, "ISO-8859-1"), F.coalesce(zip_directory(content), F.lit(""))))
    has = lambda s: F.contains(names, F.lit(s))
    images = ["89504E470D0A1A0A", "FFD8FF", "49492A00", "4D4D002A", "47494638"]
    image = starts(images[0])
    for h in images[1:]:
        image = image | starts(h)
    webp = starts("52494646") & (F.hex(F.substring(head, 9, 4)) == "57454250")
    return (
        F.when(starts("25504446"), "pdf").when(image | webp, "image")
        .when(has("application/epub+zip"), "epub").when(has("word/"), "docx").when(has("xl/"), "excel").when(has("ppt/"), "pptx")
        .when((F.length(head) > 0) & ~F.rlike(F.decode(head, "ISO-8859-1"), F.lit(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]")), "txt")
    )


def detect(files: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ext, format and mimetype: by ending (a broadcast join), else by the first bytes, else null (or an error)."""
    ext = F.broadcast(dims.dim_extension(files.sparkSession).select("ext", F.col("format").alias("_f")))
    d = files.withColumn("ext", ending(F.col("path"))).join(ext, "ext", "left")
    found = F.coalesce("_f", sniff(F.col("content"))) if "content" in files.columns else F.col("_f")
    if strict:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("Unsupported file type for "), file_name(F.col("path")))).cast("string"))
    return d.withColumn("format", found).withColumn("mimetype", dims.lookup(dims.MIMETYPES, F.col("format"))).drop("_f")


def ebook_drm(ext: Column, content: Column) -> Column:
    """Whether an e-book is protected, from its first 200 bytes."""
    head = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    has = lambda s: F.position(F.lit(s), head) > 0
    return F.when(ext == ".kfx", True).when(ext.isin(".azw", ".azw3"), ~(has("EBOK") | has("PDOC") | has("BOOKMOBI"))).otherwise(False)
