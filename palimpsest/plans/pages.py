"""Queries over page formats and sources: markup, tables, subtitles, JSON, detection, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims, scratch
from ..formats import pages as formats
from ..operators import metadata
from ..sources import files, parse_text, reader
from .inputs import ENGINE_OUTPUTS, engine_outputs, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import display

    d = read(spark, sf_dir, "conversations")
    return d.select("conv_id", F.col("turn").cast("int").alias("page_index"), display.page_label(F.col("turn")).alias("page_label"), "text", F.lit("complete").alias("status"), F.lit(None).cast("double").alias("confidence"))


@query(
    f"""WITH {ENGINE_OUTPUTS}, o AS (SELECT conv_id, turn, string_agg(to_json(engine) || ':{{"text":' || to_json(text) || ',"error":' || coalesce(to_json(error), 'null') || '}}', ',' ORDER BY ord) AS outs FROM eo GROUP BY conv_id, turn)
    SELECT c.conv_id, CAST(c.turn AS INTEGER) AS page_index, '{{"page_index":' || c.turn || ',"page_label":"page_' || lpad(CAST(c.turn + 1 AS VARCHAR), 4, '0') || '","markdown":' || coalesce(to_json(c.text), 'null') || ',"status":"complete","engine_outputs":{{' || o.outs || '}}}}' AS content
    FROM conversations c JOIN o ON c.conv_id = o.conv_id AND c.turn = o.turn"""
)
def json_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JSON with their engines' outputs."""
    outs = engine_outputs(spark, sf_dir).groupBy("conv_id", F.col("turn").cast("int").alias("page_index")).agg(F.array_sort(F.collect_list(F.struct("ord", "engine", "text", "error"))).alias("outputs"))
    d = _page_table(spark, sf_dir).join(outs, ["conv_id", "page_index"])
    return formats.json_page(d).select("conv_id", "page_index", "content")


def _blocks(d: DataFrame) -> DataFrame:
    """One heading block and its lines as children, with boxes."""
    lines = F.split("text", "\n")
    box = lambda y0, y1: F.struct(F.lit(10.0).alias("x0"), y0.cast("double").alias("y0"), F.lit(500.0).alias("x1"), y1.cast("double").alias("y1"))
    block = lambda path, kind, text, b: F.struct(path.alias("path"), F.lit(kind).alias("type"), text.alias("text"), b.alias("bbox"), F.lit(0.9).alias("confidence"), F.lit(None).cast("array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>>").alias("words"))
    head = F.array(block(F.array(F.lit(0)), "heading", F.get(lines, 0), box(F.lit(0), F.lit(20))))
    rest = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda t, i: block(F.array(F.lit(0), i.cast("int")), "text", t, box(i * 20 + 20, i * 20 + 40)))
    return d.withColumn("blocks", F.concat(head, rest).cast(formats.BLOCKS))


# One row a line of a page, with its place, its words and their number; lines without words have none.
_LINES_OF = r"""l AS (SELECT conv_id, turn, generate_subscripts(x, 1) - 1 AS i, trim(regexp_replace(unnest(x), '<!--.*?-->', '', 'gs'), ' ' || chr(9) || chr(13) || chr(11) || chr(12) || chr(160)) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations)),
e AS (SELECT conv_id, turn, i, line, replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM l),
w AS (SELECT conv_id, turn, i, list_filter(regexp_split_to_array(safe, '[\s\x{a0}]+'), lambda v: v <> '') AS ws FROM e)"""


def _attribute(value: str) -> str:
    return f"CASE WHEN NOT contains({value}, chr(34)) THEN chr(34) || {value} || chr(34) WHEN NOT contains({value}, chr(39)) THEN chr(39) || {value} || chr(39) ELSE chr(34) || replace({value}, chr(34), '&quot;') || chr(34) END"


_PLACE = "' HPOS=\"10\" VPOS=\"' || (20 * i) || '\" WIDTH=\"490\" HEIGHT=\"20\"'"
_ALTO = formats.alto_xml("@label@", "", [], time="").replace("'", "''")
_PRINTED = _ALTO.index("</PrintSpace>") if "</PrintSpace>" in _ALTO else _ALTO.index("></PrintSpace")


@query(
    f"""WITH {_LINES_OF}, b AS (SELECT conv_id, turn, i, '<TextBlock ID="elem_' || (i + 1) || '"' || {_PLACE} || '>' || CASE WHEN len(ws) = 0 THEN '' ELSE '<TextLine' || {_PLACE} || '>' ||
      array_to_string(list_transform(ws, lambda v: '<String CONTENT=' || {_attribute("v")} || {_PLACE} || ' WC="0.9000"/>'), '<SP/>') || '</TextLine>' END || '</TextBlock>' AS block FROM w)
    SELECT conv_id, CAST(turn AS INTEGER) AS page_index, replace('{_ALTO[:_PRINTED]}', '@label@', 'page_' || lpad(CAST(turn + 1 AS VARCHAR), 4, '0')) || string_agg(block, '' ORDER BY i) || '{_ALTO[_PRINTED:]}' AS content FROM b GROUP BY conv_id, turn"""
)
def alto_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ALTO."""
    return formats.alto(_blocks(_page_table(spark, sf_dir))).select("conv_id", "page_index", "content")


_HOCR = formats.hocr_html("@label@", 0, "", []).replace("'", "''").replace("ppageno 1", "ppageno @number@")
_AREA = _HOCR.index("</div></body>")
_BOX = "'title=\"bbox 10 ' || (20 * i) || ' 500 ' || (20 * i + 20)"


@query(
    f"""WITH {_LINES_OF}, n AS (SELECT *, coalesce(sum(1 + CASE WHEN len(ws) > 0 THEN 2 + len(ws) ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM w),
    b AS (SELECT conv_id, turn, i, '<div class="ocr_carea" id="block_' || (k + 1) || '" ' || {_BOX} || '">' || CASE WHEN len(ws) = 0 THEN '' ELSE '<p class="ocr_par" id="par_' || (k + 2) || '" ' || {_BOX} || '"><span class="ocr_line" id="line_' || (k + 3) || '" ' || {_BOX} || '">' ||
      array_to_string(list_transform(ws, lambda v, j: '<span class="ocrx_word" id="word_' || (k + 3 + j) || '" ' || {_BOX} || '; x_wconf 90">' || v || '</span>'), ' ') || '</span></p>' END || '</div>' AS block FROM n)
    SELECT conv_id, CAST(turn AS INTEGER) AS page_index, replace(replace('{_HOCR[:_AREA]}', '@label@', 'page_' || lpad(CAST(turn + 1 AS VARCHAR), 4, '0')), '@number@', CAST(turn + 1 AS VARCHAR)) || string_agg(block, '' ORDER BY i) || '{_HOCR[_AREA:]}' AS content FROM b GROUP BY conv_id, turn"""
)
def hocr_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as hOCR."""
    return formats.hocr(_blocks(_page_table(spark, sf_dir))).select("conv_id", "page_index", "content")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_strip_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", parse_text.strip_tags(F.col("html")).alias("text"))


@query(r"SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '""'), '&#39;', ''''), '&amp;', '&')) AS title FROM pages".replace('""', '"'))
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", parse_text.html_title(F.col("html")).alias("title"))


_RAW = "(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>"
_PLAIN = "{}"
for _entity, _sign in (("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("nbsp", 160), ("copy", 169), ("middot", 183), ("mdash", 8212), ("ndash", 8211), ("hellip", 8230), ("raquo", 187), ("laquo", 171)):
    _PLAIN = f"replace({_PLAIN}, '&{_entity};', chr({_sign}))"
_PLAIN = f"regexp_replace({_PLAIN}, '&amp;?', '&', 'g')"
# Scripts and styles are text as they stand; elsewhere tags go and entities are read.
_TEXT_OF = rf"""h AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<![a-zA-Z][^>]*>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, h, regexp_split_to_array(h, '{_RAW}') AS outside, regexp_extract_all(h, '{_RAW}') AS raw FROM h),
t AS (SELECT page_id, h, array_to_string(list_transform(outside, lambda x, i: {_PLAIN.format("regexp_replace(x, '<[/a-zA-Z?][^>]*>', '', 'g')")} || coalesce(regexp_replace(regexp_replace(raw[i], '^<[^>]*>', ''), '</[^>]*>$', ''), '')), '') AS t FROM b),
p AS (SELECT page_id, h, trim(t, ' ' || chr(10) || chr(9) || chr(13) || chr(160)) AS text FROM t)"""


@query(f"""WITH {_TEXT_OF} SELECT page_id, text, trim(replace(replace(replace(replace(replace(regexp_extract(h, '(?is)<title[^>]*>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')) AS title FROM p""")
def html_text_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser's text and title of whole pages."""
    found = read(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("format"), F.col("html").cast("binary").alias("content"))
    return reader.parsed_pages(found).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("page_id"), "text", F.col("metadata.title").alias("title"))


@query(
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'own ' || page_id WHEN page_id % 3 = 0 THEN 'cited ' || page_id ELSE 'og ' || page_id END AS title, CASE WHEN page_id % 3 = 0 THEN 'c. author' ELSE 'dc author' END AS author,
    'pub' AS publisher, CASE WHEN page_id % 2 = 0 THEN '2024' ELSE '' END AS date FROM pages"""
)
def html_meta_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several names of a field wins."""
    p = F.col("page_id").cast("string")
    two, three = F.col("page_id") % 2 == 0, F.col("page_id") % 3 == 0
    text = lambda cond, v: F.when(cond, v).otherwise("")
    m = F.create_map(F.lit("title"), text(two, F.concat(F.lit("own "), p)), F.lit("citation_title"), text(three, F.concat(F.lit("cited "), p)), F.lit("og:title"), F.concat(F.lit("og "), p), F.lit("citation_author"), text(three, F.lit("c. author")), F.lit("dc.creator"), F.lit("dc author"), F.lit("dc.publisher"), F.lit("pub"), F.lit("citation_date"), text(two, F.lit("2024")))
    return read(spark, sf_dir, "pages").select("page_id", metadata.html_precedence(m).alias("m")).select("page_id", "m.title", "m.author", "m.publisher", "m.date")


@query("SELECT n_regionkey AS region, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey")
def csv_markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "region")
    return parse_text.table_of(n, ["n_nationkey", "n_name"], ["n_nationkey"], ["region"])


@query("SELECT n_regionkey AS region, 'FeatureCollection' AS type, CAST(count(*) AS BIGINT) AS feature_count, CASE WHEN bool_or(n_nationkey % 2 = 0) AND bool_or(n_nationkey % 2 = 1) THEN 'Point,Polygon' WHEN bool_or(n_nationkey % 2 = 0) THEN 'Point' ELSE 'Polygon' END AS kinds, 'key,name' AS properties FROM nation GROUP BY n_regionkey")
def geojson_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, kinds and property names of feature collections (one a region)."""
    kind = F.when(F.col("n_nationkey") % 2 == 0, "Point").otherwise("Polygon")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(kind.alias("type")).alias("geometry"), F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("properties"))
    g = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("g"))
    s = g.select("region", parse_text.geojson_summary(F.col("g")).alias("s"))
    return s.select("region", "s.type", "s.feature_count", F.array_join("s.geometry_types", ",").alias("kinds"), F.array_join("s.properties_keys", ",").alias("properties"))


_LINES = r"regexp_replace(replace(trim(text, ' ' || chr(10)), chr(10), ' '), '\s+', ' ', 'g')"


@query(f"SELECT conv_id, string_agg({_LINES}, chr(10) ORDER BY turn) AS transcript FROM conversations WHERE length({_LINES}) > 0 GROUP BY conv_id")
def subtitle_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as SubRip files, every other one with carriage returns, and read back, a cue a turn."""
    line = F.regexp_replace(F.replace(F.trim(F.regexp_replace("text", r"\A[ \n]+|[ \n]+\z", "")), F.lit("\n"), F.lit(" ")), r"\s+", " ")
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), line)
    d = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n\n").alias("srt"))
    content = F.when(F.col("conv_id") % 2 == 0, F.replace("srt", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("srt")).cast("binary")
    return d.select("conv_id", parse_text.subtitles(parse_text.decode(content), F.lit(".srt")).alias("transcript"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose first line is broken and whose second is JSON."""
    raw = F.concat(F.lit("{broken\n"), F.col("props"), F.lit("\n{}"))
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(parse_text.json_first_valid(raw), "$.k").cast("long").alias("k"))


_EXT = ", ".join(f"('{e}', '{f}')" for e, f in dims.ENDINGS.items())


@query(
    f"""WITH x(ext, format) AS (VALUES {_EXT}), n AS (SELECT page_id, 'f' || page_id || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.tei.xml' WHEN 2 THEN '.weird' WHEN 3 THEN '.html' ELSE '.tar' END AS name FROM pages),
    e AS (SELECT page_id, name, CASE WHEN regexp_matches(lower(name), '\\.tei\\.xml$') THEN '.tei.xml' ELSE regexp_extract(lower(name), '(\\.[^.]+)$', 1) END AS ext FROM n) SELECT e.page_id, e.ext, coalesce(x.format, 'txt') AS format FROM e LEFT JOIN x ON e.ext = x.ext""".replace("\\\\", "\\")
)
def extension_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format by ending, else by the first bytes."""
    tail = F.element_at(F.array(*(F.lit(x) for x in (".PDF", ".tei.xml", ".weird", ".html", ".tar"))), (F.col("page_id") % 5).cast("int") + 1)
    d = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("dir.x/f"), F.col("page_id").cast("string"), tail).alias("path"), F.col("html").cast("binary").alias("content"))
    return files.detect(d).select("page_id", "ext", "format")


@query(f"""WITH {_TEXT_OF} SELECT page_id, 0 AS page_index, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM p""")
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, page_index, n_chars, text_sha256) of all web pages, one file each, read by a stream in four micro-batches or more."""
    from ..pipeline import write_text_files
    from ..streaming import ingest

    base = scratch.folder(spark, "stream")
    raw = read(spark, sf_dir, "pages").select("page_id", "html").repartition("page_id")  # a table of one row group would be written by one task
    named = raw.select(F.concat("page_id", F.lit(".html")).alias("name"), F.col("html").alias("content"))
    per_trigger = max(1, -(-write_text_files(named, f"{base}/in").count() // 4))  # a merge rewrites the table: their number is fixed
    out = ingest.ingest(spark, f"{base}/in", f"{base}/pages", f"{base}/checkpoint", "*.html", per_trigger)
    page_id = F.regexp_extract("path", r"(-?\d+)[.]html$", 1).cast("long").alias("page_id")
    return out.select(page_id, F.col("page_index").cast("int").alias("page_index"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))
