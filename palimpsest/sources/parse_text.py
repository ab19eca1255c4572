"""Text-like formats that columns can express: all native expressions over ``content``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Characters kept of a text file of more bytes, and what is said then.
TXT_CAP = 100 * 1024 * 1024
TXT_NOTE = "\n\n[truncated at 100 MB]"


def decode(content: Column) -> Column:
    """UTF-8, with replacement characters for bytes that are none; every line end is a line feed."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "\r\n?", "\n")


def plain_text(content: Column) -> Column:
    """A text file in UTF-8; null if it is in another encoding, which a parser has to find."""
    text = decode(content)
    long = F.length(content) > TXT_CAP
    return F.when(F.is_valid_utf8(content.cast("string")), F.when(long, F.concat(F.substring(text, 1, TXT_CAP), F.lit(TXT_NOTE))).otherwise(text))


def strip_tags(html: Column) -> Column:
    """The fallback for pages no parser takes: tags become spaces, white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), rf"(?U){T.WS}+", " "))


def html_title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return T.ptrim(raw)


def srt(text: Column) -> Column:
    """One line a cue: numbers and times dropped (and lines of digits alone)."""
    keep = lambda x: ~F.rlike(x, F.lit(r"\A\d+\z")) & ~F.rlike(x, F.lit(r"\A\d{2}:\d{2}:\d{2}[,.]\d{3}\s*-->")) & (x != "")
    cue = lambda block: F.array_join(F.filter(F.transform(F.split(T.ptrim(block), "\n"), lambda x: T.ptrim(x)), keep), " ")
    return F.array_join(F.filter(F.transform(F.split(text, "\n\n"), cue), lambda c: c != ""), "\n")


def vtt(text: Column) -> Column:
    """Lines after the first empty one, without times, notes, styles, tags and numbers."""
    lines = F.transform(F.split(text, "\n"), lambda x: T.ptrim(x))
    first = F.array_position(lines, "")
    body = F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    said = F.filter(body, lambda x: ~F.rlike(x, F.lit(r"\A\d{2}:\d{2}:\d{2}\.\d{3}\s*-->")) & ~x.startswith("NOTE") & ~x.startswith("STYLE"))
    plain = F.transform(said, lambda x: T.ptrim(F.regexp_replace(x, "<[^>]+>", "")))
    return F.array_join(F.filter(plain, lambda x: (x != "") & ~F.rlike(x, F.lit(r"\A\d+\z"))), "\n")


def subtitles(text: Column, ext: Column) -> Column:
    return F.when(ext == ".srt", srt(text)).when(ext == ".vtt", vtt(text)).otherwise(text)


def json_first_valid(text: Column) -> Column:
    """The whole text if it is JSON, else its first line that is, else the text itself as a JSON string."""
    whole = F.try_parse_json(text)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: T.ptrim(x)), lambda x: (x != "") & F.try_parse_json(x).isNotNull())
    return F.coalesce(F.when(whole.isNotNull(), text), F.try_element_at(lines, F.lit(1)), F.to_json(F.struct(text.alias("v"))))


def geojson_summary(text: Column) -> Column:
    """Counts, types and property names (50 at most, in order) of a feature collection."""
    m = F.from_json(text, "type string, crs string, features array<struct<geometry:struct<type:string>,properties:map<string,string>>>")
    kinds = F.array_sort(F.array_distinct(F.transform(m["features"], lambda f: F.coalesce(f["geometry"]["type"], F.lit("Unknown")))))
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform(m["features"], lambda f: F.coalesce(F.map_keys(f["properties"]), F.array().cast("array<string>"))))))
    return F.struct(m["type"].alias("type"), F.size(m["features"]).cast("long").alias("feature_count"), F.coalesce(m["crs"], F.lit("")).alias("crs"), kinds.alias("geometry_types"), F.slice(keys, 1, 50).alias("properties_keys"))


def dxf(text: Column) -> Column:
    """Texts of TEXT, MTEXT and ATTRIB entities: code and value lines are paired, sections tracked in order."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit(""))))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(lines) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(lines, i * 2).alias("code"), F.coalesce(F.get(lines, i * 2 + 1), F.lit("")).alias("value")))
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("texted"), F.lit("").alias("now"), F.array().cast("array<string>").alias("found"))

    def step(a: Column, p: Column) -> Column:
        inside = F.when((p["code"] == "2") & (p["value"] == "ENTITIES"), True).when((p["code"] == "0") & (p["value"] == "ENDSEC"), False).otherwise(a["inside"])
        entity = inside & (p["code"] == "0") & p["value"].isin("TEXT", "MTEXT", "ATTRIB")
        other = inside & (p["code"] == "0") & ~p["value"].isin("TEXT", "MTEXT", "ATTRIB")
        texted = F.when(entity, True).when(other, False).otherwise(a["texted"] & inside)
        flush = (entity | other | ((p["code"] == "0") & (p["value"] == "ENDSEC"))) & (a["now"] != "")
        found = F.when(flush, F.concat(a["found"], F.array(a["now"]))).otherwise(a["found"])
        now = F.when(inside & (p["code"] == "1") & a["texted"], p["value"]).when(flush, "").otherwise(a["now"])
        return F.struct(inside.alias("inside"), texted.alias("texted"), now.alias("now"), found.alias("found"))

    end = F.aggregate(pairs, start, step)
    return F.array_join(F.filter(F.concat(end["found"], F.array(end["now"])), lambda t: t != ""), "\n\n")


def markdown_table(rows: Column) -> Column:
    """An array of rows (arrays of cells) as a table: rows are padded and cut to the header's width."""
    head = F.get(rows, 0)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    n = F.size(head)
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(n - F.size(r), F.lit(0)))), F.lit(1), n)
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(fit(r)))
    return F.array_join(F.concat(F.array(line(head), line(F.transform(head, lambda _: F.lit("---")))), body), "\n")


def table_of(df: DataFrame, columns: list[str], order: list[str], group: list[str] | None = None) -> DataFrame:
    """Rows of a DataFrame as one Markdown table (for each group), in order."""
    cells = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*(F.col(o) for o in order), cells.alias("_c")))), lambda r: r["_c"])
    head = F.array(F.array(*(F.lit(c) for c in columns)))
    return df.groupBy(*(group or [])).agg(markdown_table(F.concat(head, listed)).alias("markdown"))
