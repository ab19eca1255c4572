"""Queries over files, pages and documents: state, assembly, metadata, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import display, identifiers
from ..operators import assemble, layout, metadata, state
from .inputs import PAGES, pages, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {PAGES} SELECT rel_path, page_index, status FROM pg WHERE status NOT IN ('complete', 'extracted', 'skipped')")
def pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pending_pages(pages(spark, sf_dir)).select("rel_path", "page_index", "status")


@query(f"WITH {PAGES} SELECT rel_path, page_index FROM pg WHERE NOT EXISTS (SELECT 1 FROM pg q WHERE q.rel_path = pg.rel_path AND q.page_index = pg.page_index AND q.status IN ('complete', 'extracted', 'skipped'))")
def pages_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the state table does not show as done: a left anti join."""
    p = pages(spark, sf_dir)
    return state.pages_to_do(p, p, ["rel_path", "page_index"]).select("rel_path", "page_index")


@query(f"WITH {PAGES} SELECT rel_path, bool_and(status IN ('complete', 'extracted')) AS all_done FROM pg GROUP BY rel_path")
def file_all_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.files_all_done(pages(spark, sf_dir), ["rel_path"])


@query(
    f"""WITH {PAGES} SELECT CAST(count(DISTINCT rel_path) AS BIGINT) AS total_files, CAST(count(*) AS BIGINT) AS total_pages, CAST(count(*) FILTER (WHERE status IN ('complete', 'extracted')) AS BIGINT) AS pages_complete,
    CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS pages_failed, CAST(count(*) FILTER (WHERE status = 'pending') AS BIGINT) AS pages_pending,
    CAST(count(*) FILTER (WHERE status IN ('rendered', 'ocr_running', 'merging')) AS BIGINT) AS pages_running, CAST(count(*) FILTER (WHERE status = 'skipped') AS BIGINT) AS pages_skipped, round(sum(estimated_cost), 4) AS total_cost FROM pg"""
)
def checkpoint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.checkpoint_stats(pages(spark, sf_dir))


@query(
    f"""WITH {PAGES} SELECT CAST(count(*) AS BIGINT) AS pages_processed, CAST(count(*) FILTER (WHERE status IN ('complete', 'extracted')) AS BIGINT) AS pages_complete, CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS pages_failed,
    round(sum(estimated_cost), 4) AS total_cost, round(sum(coalesce(confidence, 0.0)) / greatest(count(*) FILTER (WHERE status IN ('complete', 'extracted')), 1), 3) AS avg_confidence FROM pg"""
)
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.run_stats(pages(spark, sf_dir))


@query(
    f"""WITH {PAGES} SELECT rel_path, CAST(count(*) AS BIGINT) AS pages_processed, CAST(count(*) FILTER (WHERE status IN ('complete', 'extracted')) AS BIGINT) AS pages_complete,
    CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS pages_failed, round(sum(coalesce(confidence, 0.0)), 6) AS confidence_sum FROM pg GROUP BY rel_path"""
)
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.file_stats(pages(spark, sf_dir), ["rel_path"]).withColumn("confidence_sum", F.round("confidence_sum", 6))


@query(f"WITH {PAGES}, f AS (SELECT rel_path, count(*) AS n FROM pg GROUP BY rel_path) SELECT CAST(least(sum(n), 3 * count(*)) AS BIGINT) AS total_pages FROM f")
def page_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.page_estimate(pages(spark, sf_dir).groupBy("rel_path").agg(F.count("*").alias("page_count")), test_mode=True)


@query("SELECT conv_id, turn FROM conversations WHERE turn < 3")
def test_mode_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three pages of each file: the feature of test runs, a pushed-down filter."""
    return read(spark, sf_dir, "conversations").filter("turn < 3").select("conv_id", "turn")


@query("SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 12) AS short_sha, substr(sha256('in/' || CAST(doc_id AS VARCHAR)), 1, 16) || '.json' AS checkpoint_key FROM documents")
def sha_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("in/"), F.col("doc_id").cast("string")).alias("rel_path"), F.col("text").alias("content"))
    return state.with_identity(files).select("doc_id", "sha256", "short_sha", "checkpoint_key")


@query("SELECT substr(sha256(text), 1, 12) AS output_dir, CAST(count(*) AS BIGINT) AS files, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def shared_output_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal contents share an output directory."""
    sha = display.short_sha(F.sha2("text", 256))
    return read(spark, sf_dir, "documents").groupBy(sha.alias("output_dir")).agg(F.count("*").alias("files"), F.min("doc_id").alias("first_doc")).filter("files > 1")


@query("SELECT doc_id, CASE WHEN n_chars / 10.0 > 2000 THEN 'refused' WHEN n_chars / 10.0 > 500 THEN 'large' ELSE 'ok' END AS verdict FROM documents")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused over 2000, warned over 500 (here: tens of characters for megabytes)."""
    from ..sources.files import size_verdict

    return read(spark, sf_dir, "documents").select("doc_id", size_verdict(F.col("n_chars") / 10.0).alias("verdict"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS document, CAST(count(*) AS BIGINT) AS n_pages FROM conversations WHERE trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) <> '' GROUP BY conv_id")
def document_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.documents(read(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query(
    """WITH d AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS document FROM conversations WHERE trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) <> '' GROUP BY conv_id),
    c AS (SELECT count(*) AS n, string_agg(document, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY conv_id) AS body FROM d) SELECT CAST(n AS BIGINT) AS n_documents, sha256(body) AS body_sha256, CAST(length(body) AS BIGINT) AS body_chars FROM c"""
)
def collection_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = assemble.collection(assemble.documents(read(spark, sf_dir, "conversations"), ["conv_id"], "turn"), ["conv_id"])
    return d.select("n_documents", F.sha2("body", 256).alias("body_sha256"), F.length("body").cast("long").alias("body_chars"))


@query(
    """WITH f AS (SELECT doc_id, unnest([{'k': 1, 'key': 'title', 'value': coalesce(split_part(text, chr(10), 1), '')}, {'k': 2, 'key': 'language', 'value': CASE WHEN lang = 'en' THEN '' ELSE lang END},
    {'k': 3, 'key': 'publisher', 'value': source}, {'k': 4, 'key': 'abstract', 'value': substr(text, 1, 500)}]) AS p FROM documents) SELECT doc_id, string_agg(p.key || '=' || p.value, '|' ORDER BY p.k) AS fields FROM f WHERE p.value <> '' GROUP BY doc_id"""
)
def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty fields dropped, the abstract cut at 500 characters."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", "\n"), 0).alias("title"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("language"), F.col("source").alias("publisher"), F.col("text").alias("abstract"))
    return d.select("doc_id", F.array_join(F.transform(assemble.frontmatter_map(d), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "|").alias("fields"))


@query(
    """SELECT conv_id, '---' || chr(10) || 'title: "Conversation: ' || conv_id || '"' || chr(10) || 'language: "en"' || chr(10) || '---' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn) AS document
    FROM conversations WHERE trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) <> '' GROUP BY conv_id"""
)
def frontmatter_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with YAML frontmatter."""
    d = assemble.documents(read(spark, sf_dir, "conversations"), ["conv_id"], "turn").withColumns({"title": F.concat(F.lit("Conversation: "), F.col("conv_id").cast("string")), "language": F.lit("en")})
    return d.select("conv_id", assemble.frontmatter_document(d).alias("document"))


@query(
    """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '<!-- doc: kept -->' || text ELSE text END AS text, role FROM conversations)
    SELECT conv_id, turn, CASE WHEN starts_with(text, '<!-- doc:') THEN text ELSE '<!-- doc:" Talk ' || CAST(conv_id AS VARCHAR) || '"' || ' | author: ' || role || CASE WHEN turn % 2 = 0 THEN ' | lang: en' ELSE '' END || ' | page: ' || CAST(turn + 1 AS VARCHAR) || ' -->' || chr(10) || chr(10) || text END AS page FROM t"""
)
def page_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("role") == "system", F.concat(F.lit("<!-- doc: kept -->"), "text")).otherwise(F.col("text")))
    title = F.concat(F.lit("Talk "), F.col("conv_id").cast("string"))
    lang = F.when(F.col("turn") % 2 == 0, "en").otherwise("")
    return d.select("conv_id", "turn", display.page_comment(F.col("text"), F.col("turn"), title, F.col("role"), lang, F.lit("")).alias("page"))


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN text ELSE '<!-- OCR confidence: ' || CAST((length(text) % 100) AS VARCHAR) || '.0% -->' || chr(10) || chr(10) || text END AS page, 'page_' || lpad(CAST(turn + 1 AS VARCHAR), 4, '0') AS page_label FROM conversations")
def markdown_confidence_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.when(F.col("role") != "system", (F.length("text") % 100) / 100.0).cast("double")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", display.confidence_line(F.col("text"), conf).alias("page"), display.page_label(F.col("turn")).alias("page_label"))


@query(
    """SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN coalesce('q' || CAST(l.quality AS VARCHAR), '') ELSE d.lang END AS language, d.source AS publisher,
    CASE WHEN l.doc_id IS NULL THEN 'native' ELSE 'sidecar+native' END AS extraction_method FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def sidecar_fill_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar rows (labels) fill the language where it is empty, never the publisher."""
    meta = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("language"), F.col("source").alias("publisher"), F.lit("native").alias("extraction_method"))
    side = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("language"), F.lit("x").alias("publisher"))
    return metadata.fill_from_sidecar(meta, side, "doc_id")


_HIT = "WITH c AS (SELECT doc_id, 0 AS rank, 'native' AS method, CASE WHEN lang = 'en' THEN '' ELSE source END AS title FROM documents UNION ALL SELECT doc_id, 1, 'vlm', CASE WHEN quality = 1 THEN 'q' ELSE '' END FROM labels UNION ALL SELECT doc_id, 3, 'none', '-' FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS k FROM c WHERE title <> '') SELECT doc_id, method, title FROM r WHERE k = 1"


@query(_HIT)
def metadata_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source of metadata that gives a title."""
    d = read(spark, sf_dir, "documents")
    native = d.select("doc_id", F.lit(0).alias("rank"), F.lit("native").alias("method"), F.when(F.col("lang") == "en", "").otherwise(F.col("source")).alias("title"))
    model = read(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("rank"), F.lit("vlm").alias("method"), F.when(F.col("quality") == 1, "q").otherwise("").alias("title"))
    none = d.select("doc_id", F.lit(3).alias("rank"), F.lit("none").alias("method"), F.lit("-").alias("title"))
    return metadata.first_hit(native.union(model).union(none), ["doc_id"], "rank", F.col("title") != "").select("doc_id", "method", "title")


@query("SELECT p_partkey AS part, '10.1000/' || p_name AS doi FROM part")
def doi_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces and four kinds of prefix come off."""
    head = F.element_at(F.array(F.lit("https://doi.org/"), F.lit("http://dx.doi.org/"), F.lit("https://dx.doi.org/"), F.lit("http://doi.org/"), F.lit("")), F.pmod("p_partkey", F.lit(5)).cast("int") + 1)
    raw = F.concat(F.lit("  "), head, F.lit("10.1000/"), "p_name", F.lit("\n"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), identifiers.normalize_doi(raw).alias("doi"))


@query("SELECT p_partkey AS part, '978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS isbn FROM part")
def isbn_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    raw = F.concat(F.lit(" 978-"), F.substring(n, 1, 1), F.lit("-"), F.substring(n, 2, 5), F.lit(" "), F.substring(n, 7, 4), F.lit(" "))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), identifiers.normalize_isbn(raw).alias("isbn"))


_BOXES = "b AS (SELECT l_orderkey AS page, l_linenumber AS box_id, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_linenumber AS DOUBLE) * 10 AS y0, CAST(l_quantity AS DOUBLE) + 20 AS x1, CAST(l_linenumber AS DOUBLE) * 10 + 15 AS y1 FROM lineitem)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double") * 10
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box_id"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 15).alias("y1"))


@query(f"WITH {_BOXES} SELECT a.page, CAST(a.box_id AS BIGINT) AS box_id, CAST(b.box_id AS BIGINT) AS line_id FROM b a JOIN b ON a.page = b.page WHERE greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1, b.y1)")
def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in layout boxes of a page: equi-join on the page, inequalities within."""
    b = _boxes(spark, sf_dir)
    hit = layout.lines_in_boxes(b, b.withColumnRenamed("box_id", "line_id"), ["page"])
    return hit.select("page", F.col("box_id").cast("long").alias("box_id"), F.col("line_id").cast("long").alias("line_id"))


@query("WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations), u AS (SELECT conv_id, turn, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS word_no FROM w) SELECT conv_id, turn, CAST(word_no AS BIGINT) AS word_no, word, 10.0 + word_no * (500.0 / n) AS word_x0, 10.0 + (word_no + 1) * (500.0 / n) AS word_x1 FROM u".replace("\\\\", "\\"))
def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's width dealt to its words."""
    lines = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit(10.0).alias("x0"), F.lit(510.0).alias("x1"))
    return layout.word_boxes(lines).select("conv_id", "turn", F.col("word_no").cast("long").alias("word_no"), "word", "word_x0", "word_x1")


@query(f"WITH {_BOXES} SELECT page, string_agg(CAST(box_id AS VARCHAR), ',' ORDER BY y0, x0, box_id) AS boxes FROM b GROUP BY page")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = layout.reading_order(_boxes(spark, sf_dir), ["page"])
    return d.select("page", F.array_join(F.transform("box_ids", lambda x: x.cast("string")), ",").alias("boxes"))


@query(
    """WITH g AS (SELECT n_regionkey AS r, n_nationkey // 5 AS i, n_nationkey % 5 AS j, n_name FROM nation), m AS (SELECT r, max(i) AS mi, max(j) AS mj FROM g GROUP BY r),
    f AS (SELECT m.r, a.i, b.j FROM m JOIN range(0, 100) a(i) ON a.i <= m.mi JOIN range(0, 100) b(j) ON b.j <= m.mj), rw AS (SELECT f.r, f.i, '<tr>' || string_agg('<td>' || coalesce(g.n_name, '') || '</td>', '' ORDER BY f.j) || '</tr>' AS h FROM f LEFT JOIN g ON g.r = f.r AND g.i = f.i AND g.j = f.j GROUP BY f.r, f.i)
    SELECT r AS region, '<table>' || string_agg(h, '' ORDER BY i) || '</table>' AS html FROM rw GROUP BY r"""
)
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table on a full grid."""
    n = read(spark, sf_dir, "nation")
    cells = n.select(F.col("n_regionkey").alias("region"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("row"), (F.col("n_nationkey") % 5).cast("int").alias("col"), F.col("n_name").alias("text"), F.col("n_nationkey").alias("ord"))
    return layout.table_html(cells, ["region"])


@query("SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS box_id, CAST(trunc(l_quantity) AS INTEGER) AS hpos, CAST(greatest(0, trunc(l_quantity * 0.5 - l_quantity)) AS INTEGER) AS width FROM lineitem")
def alto_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers; a negative width becomes 0."""
    q = F.col("l_quantity").cast("double")
    d = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("box_id"), layout.alto_box(q, F.lit(0.0), q * 0.5, F.lit(1.0)).alias("b"))
    return d.select("page", "box_id", "b.hpos", "b.width")


_LABELS = ", ".join(f"('{k}', '{v}')" for k, v in dims.LAYOUT_LABELS.items())


@query(f"WITH m(raw, label) AS (VALUES {_LABELS}) SELECT e.event_id, coalesce(m.label, 'text') AS label FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'SectionHeader' WHEN 'view' THEN 'Picture' WHEN 'error' THEN 'Footnote' WHEN 'signup' THEN 'Equation' ELSE 'Unheard' END AS raw FROM events) e LEFT JOIN m ON e.raw = m.raw")
def layout_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dims.lookup({"click": "SectionHeader", "view": "Picture", "error": "Footnote", "signup": "Equation"}, F.col("event_type"), F.lit("Unheard"))
    return read(spark, sf_dir, "events").select("event_id", layout.map_label(raw).alias("label"))


@query("SELECT event_id, CAST(CAST(floor(value * 60) AS BIGINT) // 3600 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(value * 60) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(value * 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS duration FROM events")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", display.format_duration(F.col("value") * 60).alias("duration"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


_CODES = ["en", "fr", "irish", "xx", "gle", "Latin", "no", "de"]
_LANGS = f"langs(code, name) AS (VALUES {_values(dims.LANGUAGE_NAMES.items())})"
_EL = f"el(engine, code) AS (VALUES {_values((e, c) for e, cs in dims.engine_languages().items() for c in cs)})"


@query(
    f"""WITH {_LANGS}, fix(wrong, code) AS (VALUES {_values(dims.CODE_SUGGESTIONS.items())}), c AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'Latin' WHEN 'fr' THEN 'xx' ELSE lang END AS code FROM documents)
    SELECT c.doc_id, c.code, l.code IS NOT NULL AS valid, CASE WHEN l.code IS NULL THEN f.code END AS suggestion FROM c LEFT JOIN langs l ON c.code = l.code LEFT JOIN fix f ON lower(c.code) = f.wrong"""
)
def lang_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known and unknown codes, with a suggestion for names mistaken for codes."""
    code = F.when(F.col("lang") == "en", "Latin").when(F.col("lang") == "fr", "xx").otherwise(F.col("lang"))
    d = read(spark, sf_dir, "documents").select("doc_id", code.alias("code"))
    known = F.broadcast(dims.dim_language(spark).select("code", F.lit(True).alias("_k")))
    return d.join(known, "code", "left").select("doc_id", "code", F.col("_k").isNotNull().alias("valid"), F.when(F.col("_k").isNull(), dims.lookup(dims.CODE_SUGGESTIONS, F.lower("code"))).alias("suggestion"))


#: Codes as they are found: those of the documents, some of which no engine reads.
_FOUND = "found AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'gle' WHEN doc_id % 13 = 0 THEN 'he' WHEN doc_id % 17 = 0 THEN 'xx' ELSE lang END AS code FROM documents)"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    code = F.when(i % 11 == 0, "gle").when(i % 13 == 0, "he").when(i % 17 == 0, "xx").otherwise(F.col("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", code.alias("code"))


@query(
    f"""WITH {_FOUND}, {_EL}, lb AS (SELECT code, '(' || CASE WHEN count(*) = 4 THEN 'all engines' ELSE string_agg(engine, ', ' ORDER BY CASE engine WHEN 'marker' THEN 0 WHEN 'surya2' THEN 1 WHEN 'google_doc_ai' THEN 2 ELSE 3 END) END || ')' AS label FROM el GROUP BY code)
    SELECT found.code, coalesce(label, '(no engine)') AS label, CAST(count(*) AS BIGINT) AS documents FROM found LEFT JOIN lb ON found.code = lb.code GROUP BY ALL"""
)
def engine_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which engines read the languages of the documents."""
    order = dims.lookup({e: k for k, e in enumerate(dims.engine_languages())}, F.col("engine"))
    d = dims.dim_engine_language(spark).groupBy("code").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), "engine"))).alias("e"))
    names = F.array_join(F.transform("e", lambda x: x["engine"]), ", ")
    labels = d.select("code", F.concat(F.lit("("), F.when(F.size("e") == 4, "all engines").otherwise(names), F.lit(")")).alias("label"))
    counted = _found(spark, sf_dir).groupBy("code").agg(F.count("*").alias("documents"))
    return counted.join(F.broadcast(labels), "code", "left").select("code", F.coalesce("label", F.lit("(no engine)")).alias("label"), "documents")


@query(f"WITH {_FOUND}, {_EL} (SELECT 'union' AS op, code FROM found UNION SELECT 'union', code FROM el WHERE engine = 'surya2') UNION ALL (SELECT 'except' AS op, code FROM found EXCEPT SELECT 'except', code FROM el WHERE engine = 'google_doc_ai') UNION ALL (SELECT 'intersect' AS op, code FROM found INTERSECT SELECT 'intersect', code FROM el WHERE engine = 'marker')")
def lang_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set algebra on the languages of the documents and those of engines."""
    found, el = _found(spark, sf_dir).select("code").distinct(), dims.dim_engine_language(spark)
    of = lambda e: el.filter(F.col("engine") == e).select("code")
    tag = lambda op, d: d.select(F.lit(op).alias("op"), "code")
    return tag("union", found.union(of("surya2")).distinct()).union(tag("except", found.subtract(of("google_doc_ai")))).union(tag("intersect", found.intersect(of("marker"))))


@query(f"WITH m(a, b) AS (VALUES {_values(dims.ISO639_3.items())}), c(a, b) AS (VALUES {_values(dims.CONFUSION_PAIRS.items())}), t AS (SELECT doc_id, CASE lang WHEN 'es' THEN 'ca' WHEN 'de' THEN 'no' ELSE lang END AS lang FROM documents), f AS (SELECT doc_id, t.lang AS detected, coalesce(c.b, t.lang) AS lang FROM t LEFT JOIN c ON t.lang = c.a) SELECT doc_id, detected, CASE WHEN f.lang IN ('en', 'es') THEN f.lang ELSE 'en' END AS language, coalesce(m.b, f.detected) AS language3 FROM f LEFT JOIN m ON f.detected = m.a")
def language_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confused languages replaced, hints preferred, three-letter codes."""
    from ..functions import script as S

    detected = F.when(F.col("lang") == "es", "ca").when(F.col("lang") == "de", "no").otherwise(F.col("lang"))
    d = read(spark, sf_dir, "documents").select("doc_id", detected.alias("detected"))
    hints = F.array(F.lit("en"), F.lit("es"))
    return d.select("doc_id", "detected", S.settle_language(F.col("detected"), hints).alias("language"), S.iso639_3(F.col("detected")).alias("language3"))


@query(f"WITH {_FOUND}, {_LANGS} SELECT found.code, name, found.code IN ('ar', 'fa', 'ur', 'he', 'ps', 'sd', 'ug', 'ku') AS rtl, CAST(count(*) AS BIGINT) AS documents FROM found LEFT JOIN langs ON found.code = langs.code GROUP BY ALL")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of the documents, by name; null: a code that is none."""
    from ..functions import script as S

    counted = _found(spark, sf_dir).groupBy("code").agg(F.count("*").alias("documents"))
    return counted.select("code", S.language_name(F.col("code")).alias("name"), S.is_rtl(F.col("code")).alias("rtl"), "documents")


_NAMES = sorted(dims.PROFILES)
_PROFILED = f"pr AS (SELECT doc_id, {_NAMES!r}[CAST(doc_id % {len(_NAMES)} AS INTEGER) + 1] AS profile, CASE lang WHEN 'de' THEN 'cyrillic' WHEN 'es' THEN 'cjk' ELSE 'latin' END AS script FROM documents)"


@query(f"WITH {_PROFILED}, rt(profile, script, model) AS (VALUES {_values((p.name, s, m) for p in dims.PROFILES.values() for s, m in p.model_routing.items())}) SELECT pr.profile, pr.script, rt.model, CAST(count(*) AS BIGINT) AS documents FROM pr LEFT JOIN rt ON pr.profile = rt.profile AND pr.script = rt.script GROUP BY ALL")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that documents go to, by profile and script."""
    profile = F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES)).cast("int"))
    script = F.when(F.col("lang") == "de", "cyrillic").when(F.col("lang") == "es", "cjk").otherwise("latin")
    d = read(spark, sf_dir, "documents").select(profile.alias("profile"), script.alias("script")).groupBy("profile", "script").agg(F.count("*").alias("documents"))
    return d.join(F.broadcast(dims.dim_routing(spark)), ["profile", "script"], "left").select("profile", "script", "model", "documents")


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso FROM events"""
)
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import display

    return read(spark, sf_dir, "events").select("event_id", display.iso(F.col("ts")).alias("iso"))


@query(
    """WITH k AS (SELECT conv_id, coalesce(text, '') AS t, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_pages, sha256(string_agg(t, chr(12) ORDER BY turn)) AS shown FROM k WHERE k <= least(greatest(conv_id % 8 - 1, 1), 5) GROUP BY conv_id"""
)
def metadata_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages of each file, as many as were asked for between one and five."""
    d = metadata.first_pages(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", F.col("conv_id") % 8 - 1)
    return d.select("conv_id", F.size("pages").cast("long").alias("n_pages"), F.sha2(F.array_join("pages", "\f"), 256).alias("shown"))
