"""Labels, durations and comment lines of outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_label(index: Column) -> Column:
    return F.format_string("page_%04d", index.cast("int") + 1)


def format_duration(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 12)


def checkpoint_key(rel_path: Column) -> Column:
    return F.concat(F.substring(F.sha2(rel_path, 256), 1, 16), F.lit(".json"))


def confidence_line(text: Column, confidence: Column) -> Column:
    """The text after a comment with its confidence, if it has one."""
    line = F.concat(F.lit("<!-- OCR confidence: "), F.bround(confidence * 100, 1).cast("string"), F.lit("% -->\n\n"))
    return F.when(confidence.isNull(), text).otherwise(F.concat(line, text))


def page_comment(text: Column, page_index: Column, title: Column, author: Column, language: Column, kind: Column) -> Column:
    """The text after a comment that names its document and page; texts that have one stay as they are."""
    part = lambda x, before, after="": F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(before), x, F.lit(after))).otherwise("")
    comment = F.concat(
        F.lit("<!-- doc:"), part(title, '" ', '"'), part(author, " | author: "), part(language, " | lang: "), part(kind, " | type: "),
        F.lit(" | page: "), (page_index + 1).cast("string"), F.lit(" -->\n\n"),
    )
    return F.when(text.startswith("<!-- doc:"), text).otherwise(F.concat(comment, text))


def iso(t: Column) -> Column:
    """A time in UTC as ISO 8601; microseconds where there are any."""
    seconds = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(t, ".SSSSSS")
    return F.concat(seconds, F.when(micros == ".000000", "").otherwise(micros), F.lit("+00:00"))


def now_iso() -> Column:
    """The time at which a query began, the same in all its rows."""
    return iso(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))
