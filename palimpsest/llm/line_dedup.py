"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in
lower case. A key of at least ``min_chars`` code points held by at least ``min_docs``
documents loses all its lines except in the document with the largest id that holds it.

The key travels as the first 16 bytes of its SHA-256. Keys are made distinct within a
document before any shuffle and the distinct count runs in two steps, by (key, document)
and then by key, so a line that a third of all documents hold costs one counter row a
task. The join that tells documents which keys to drop is an inner sort-merge join, whose
large partitions adaptive execution splits. Texts move once, for the reassembly.

Defined results: null text is one empty line; rows that share a doc_id are pieces of one
document; a null doc_id is a document of its own that sorts before all others; an empty
table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_STRIP = " \t\n\x0b\x0c\r"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER_BYTES = bytes.maketrans(_UPPER.encode(), _SMALL.encode())
_LEAST = -(2**63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_STRIP)), _UPPER, _SMALL)


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, keys): for each document, the hashes of the lines that it loses."""
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_key)
    long = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))
    held = docs.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("doc_id"), F.explode(long).alias("key")).select("doc_id", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("h"))
    # distinct (key, document) first: a key's count is then a plain sum
    common = held.groupBy("h").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs).select("h", "last")
    # as a written table: both sides of the join are then shuffled for it, which lets a frequent key's rows be split
    common = C.materialise(common, "repeated-lines")
    lost = held.join(common.hint("merge"), "h").filter(F.col("doc_id") < F.col("last"))
    return lost.groupBy("doc_id").agg(F.collect_set("h").alias("keys"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept_sha256) for each row of ``docs``."""
    d = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_LEAST)).alias("_key"))
    lost = repeated_lines(docs, min_chars, min_docs).withColumnRenamed("doc_id", "_key")
    schema = "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string"

    def reassemble(batches):
        for whole in batches:
            for b in C.slices(whole, "text", 32 << 20):
                out = []
                for i, text, keys in zip(b["doc_id"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), b["keys"].to_pylist(), strict=True):
                    lines = text.split(b"\n")
                    kept = lines
                    if keys:
                        gone = set(keys)
                        kept = [x for x in lines if len(k := x.strip(b" \t\n\x0b\x0c\r").translate(_LOWER_BYTES)) < min_chars or hashlib.sha256(k).digest()[:16] not in gone]
                    whole_text = b"\n".join(kept)
                    out.append((i, whole_text.decode("utf-8", "replace"), len(lines), len(lines) - len(kept), hashlib.sha256(whole_text).hexdigest()))
                cols = list(zip(*out, strict=True))
                yield C.batch(schema, doc_id=cols[0], text=cols[1], n_lines=cols[2], n_dropped=cols[3], kept_sha256=cols[4])

    return d.join(lost.hint("merge"), "_key", "left").select("doc_id", "text", "keys").mapInArrow(C.lean(reassemble), schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(C.documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.last) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
