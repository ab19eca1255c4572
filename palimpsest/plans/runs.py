"""Runs over time: state tables, streams with state, one budget for a run, ordered collections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import progress, scratch
from ..operators import assemble, costing, state, store
from ..sources import datasource, extras
from ..streaming import stateful
from .inputs import PAGES, pages, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _runs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three runs over conversations as files: two thirds of them; those whose pages failed, again, with changed and
    new files; the changed ones once more, without their last page."""
    c = read(spark, sf_dir, "conversations").withColumns({"path": F.concat(F.lit("in/"), "conv_id"), "page_index": F.col("turn").cast("int"), "text": F.coalesce("text", F.lit(""))})
    failed = (F.col("conv_id") * 7 + F.col("turn") * 3) % 5 == 0
    row = lambda run, sha, status: ["path", "page_index", sha.alias("sha256"), status.alias("status"), F.lit(run).alias("run"), F.length("text").cast("long").alias("n_chars")]
    own, changed, last = F.sha2(F.col("conv_id").cast("string"), 256), F.col("conv_id") % 7 == 1, F.max("turn").over(W.partitionBy("conv_id"))
    first = c.filter("conv_id % 3 <> 0").select(*row(1, own, F.when(failed, "failed").otherwise("complete")))
    second = c.filter((F.col("conv_id") % 3 == 0) | changed | failed).select(*row(2, F.when(changed, F.sha2(F.concat(F.lit("new "), "conv_id"), 256)).otherwise(own), F.lit("complete")))
    third = c.withColumn("last", last).filter(changed & (F.col("turn") < F.col("last"))).select(*row(3, F.sha2(F.concat(F.lit("third "), "conv_id"), 256), F.lit("complete")))
    return [first, second, third]


_AFTER = """
c AS (SELECT conv_id, 'in/' || conv_id AS path, CAST(turn AS INTEGER) AS page_index, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, (conv_id * 7 + turn * 3) % 5 = 0 AS failed, conv_id % 7 = 1 AS changed, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
after AS (SELECT path, page_index, n_chars, 'complete' AS status,
   CASE WHEN changed AND last > 0 THEN 3 WHEN conv_id % 3 = 0 OR changed OR failed THEN 2 ELSE 1 END AS run,
   sha256(CASE WHEN changed AND last > 0 THEN 'third ' || conv_id WHEN changed THEN 'new ' || conv_id ELSE CAST(conv_id AS VARCHAR) END) AS sha256
 FROM c WHERE NOT (changed AND last > 0 AND page_index = last))
"""
_STATE = ["path", "page_index", "sha256", "status", "run", "n_chars"]


@query(f"WITH {_AFTER} SELECT path, page_index, sha256, status, run, n_chars FROM after")
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state table after three runs with failed, new and changed files: each page once, of its file's last content."""
    table = store.pages_table(spark, scratch.folder(spark, "state"), 16)
    for number, rows in enumerate(_runs(spark, sf_dir)):
        table.merge(rows, "run", number)
    return table.read().select(_STATE)


@query(f"WITH {_AFTER} SELECT path, page_index, sha256, status, run, n_chars FROM after")
def state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every merge is repeated, and two of them break off before their commit and are done again."""
    table = store.pages_table(spark, scratch.folder(spark, "state"), 16)
    for number, rows in enumerate(_runs(spark, sf_dir)):
        if number:
            torn = store.pages_table(spark, table.path.removesuffix("/pages"), 16)
            torn._commit = lambda commit: False  # everything but the commit
            try:
                torn.merge(rows, "run", number, attempts=1)
            except Exception as e:
                if "other writers" not in str(e):
                    raise
        for _ in range(2):
            table.merge(rows, "run", number)
    return table.read().select(_STATE)


@query(f"WITH {_AFTER}, f AS (SELECT path, bool_and(status IN ('complete', 'extracted')) AS all_done, count(*) AS n_pages FROM after GROUP BY path) SELECT path, all_done, CAST(n_pages AS BIGINT) AS n_pages FROM f")
def state_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that asks the table what is left before each merge: only pages that are not done go in."""
    table = store.pages_table(spark, scratch.folder(spark, "state"), 16)
    for number, rows in enumerate(_runs(spark, sf_dir)):
        before = table.read()
        table.merge(rows if before is None else state.pages_to_do(rows, before, ["path", "page_index", "sha256"]), "run", number)
    done = table.read()
    return state.files_all_done(done, ["path"]).join(done.groupBy("path").agg(F.count("*").alias("n_pages")), "path")


def _stream(spark: SparkSession, rows: DataFrame, last: DataFrame, deal, batches: int, run) -> DataFrame:
    """What ``run`` gives for ``rows`` as a stream of files, dealt by ``deal`` and then ``last``, in as many micro-batches and one."""
    base = scratch.folder(spark, "stream")
    for k in range(batches):
        rows.filter(F.pmod(deal, F.lit(batches)) == k).write.mode("append").parquet(f"{base}/in")
    files = len(spark.read.schema(rows.schema).parquet(f"{base}/in").inputFiles())
    last.select(*(F.col(c).cast(t) for c, t in rows.dtypes)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{base}/in")
    q = run(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(
    """WITH e AS (SELECT CAST(user_id % 8 AS VARCHAR) AS engine, event_id, ts, event_type = 'error' AS bad FROM events),
    i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY engine ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM e),
    r AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY engine, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM i) SELECT engine, event_id AS seq, CAST(n AS BIGINT) AS failures, n >= 2 AS is_open FROM r"""
)
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakers over events as a stream whose micro-batches hold rows of all times: late rows fall into place."""
    d = read(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("string").alias("engine"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    # a call far in the future lets the watermark pass all others; it waits itself
    last = d.agg(F.expr("max(ts) + INTERVAL 2000 DAYS").alias("ts")).select(F.lit("end").alias("engine"), "ts", F.lit(-1).alias("seq"), F.lit(False).alias("failed"))
    return _stream(spark, d, last, F.xxhash64("seq"), 3, lambda s: stateful.breaker(s, 2, "1000 days"))


@query(
    f"""WITH {PAGES}, n AS (SELECT rel_path AS path, CAST(count(*) FILTER (WHERE status IN ('complete', 'extracted', 'skipped')) AS BIGINT) AS pages_done, CAST(count(*) AS BIGINT) AS page_count FROM pg GROUP BY rel_path)
    SELECT path, pages_done, page_count, pages_done = page_count AS complete FROM n"""
)
def stream_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as their pages stream in, each page twice: one row a document, complete or given up."""
    p = pages(spark, sf_dir).select(F.col("rel_path").alias("path"), F.col("page_index").alias("page"), F.col("status").isin(*state.DONE).alias("is_done"))
    size = p.groupBy("path").agg(F.count("*").alias("page_count"))
    d = p.join(size, "path").withColumn("ts", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, page, 0)")).select("path", F.col("page").cast("long"), "page_count", "is_done", "ts")
    last = spark.createDataFrame([("end", 0, 9, False)], "path string, page long, page_count long, is_done boolean").withColumn("ts", F.expr("TIMESTAMP '2034-01-01 00:00:00'"))
    return _stream(spark, d.union(d), last, F.xxhash64("path", "page"), 2, lambda s: stateful.completions(s, "1 day", 3_600_000)).filter("path <> 'end'")


@query(
    """WITH RECURSIVE c AS MATERIALIZED (SELECT event_id, CAST(round(value * 1000000) AS BIGINT) AS a, row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
    t AS MATERIALIZED (SELECT CAST(sum(a) * 2 / 5 AS BIGINT) AS cap FROM c),
    f AS (SELECT k, event_id, a <= cap AS admitted, CASE WHEN a <= cap THEN a ELSE 0 END AS spent FROM c, t WHERE k = 1
          UNION ALL SELECT c.k, c.event_id, f.spent + c.a <= cap, CASE WHEN f.spent + c.a <= cap THEN f.spent + c.a ELSE f.spent END FROM f JOIN c ON c.k = f.k + 1, t)
    SELECT event_id, admitted, round(spent / 1000000.0, 6) AS spent FROM f"""
)
def budget_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cap over all events in order, two fifths of what they would cost; refused calls spend nothing."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "value")
    total = e.agg(F.sum(F.round(F.col("value") * 1_000_000).cast("long"))).first()[0] or 0
    d = costing.admit_run(e, round(total * 2 / 5) / 1e6, ["ts", "event_id"], "value", "value")
    return d.select("event_id", "admitted", F.round("spent", 6).alias("spent"))


@query(
    r"""WITH d AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS document FROM conversations WHERE regexp_matches(coalesce(text, ''), '\S') GROUP BY conv_id),
    s AS (SELECT conv_id, strlen(document) AS bytes, sha256(document) AS sha256 FROM d)
    SELECT conv_id, CAST(row_number() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS position, CAST(coalesce(sum(bytes + 7) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(bytes AS BIGINT) AS bytes, sha256 FROM s"""
)
def collection_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written in order as files; where each lies in the collection."""
    d = assemble.documents(read(spark, sf_dir, "conversations"), ["conv_id"], "turn")
    m = assemble.write_collection(d, ["conv_id"], scratch.folder(spark, "collection"))
    return m.select("conv_id", "position", "offset", "bytes", "sha256")


@query(
    r"""WITH f AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(12) ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, strlen(body) AS length, unnest(string_split(body, chr(12))) AS text, generate_subscripts(string_split(body, chr(12)), 1) - 1 AS page_index FROM f)
    SELECT conv_id, CAST(length AS BIGINT) AS length, CAST(page_index AS INTEGER) AS page_index, sha256(text) AS sha256 FROM p WHERE length >= 2000"""
)
def source_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files of a format of its own, read as a data source that opens only files of 2,000 bytes and more."""
    from ..pipeline import write_text_files

    folder = scratch.folder(spark, "chapters")
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\f").alias("content"))
    write_text_files(c.select(F.concat("conv_id", F.lit(".txt")).alias("name"), "content"), folder).count()
    d = datasource.load(spark, datasource.Chapters, folder, partitionBytes=1 << 20).filter("length >= 2000")
    return d.select(F.regexp_extract("path", r"(-?\d+)[.]txt$", 1).cast("long").alias("conv_id"), "length", "page_index", F.sha2("text", 256).alias("sha256"))


@query(
    f"""WITH {PAGES}, x AS (SELECT rel_path, page_index, status, CAST(estimated_cost AS DOUBLE) AS estimated_cost, CAST(regexp_extract(rel_path, '[0-9]+') AS BIGINT) AS k FROM pg)
    SELECT rel_path, CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END AS version, CASE WHEN k % 2 = 0 THEN '' ELSE 'sha' || k END AS sha256, page_index, 'page_' || lpad(CAST(page_index + 1 AS VARCHAR), 4, '0') AS page_label,
      CASE WHEN k % 2 = 0 AND status = 'pending' THEN 'pending' ELSE status END AS status, estimated_cost FROM x"""
)
def state_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint files of two versions in one read: files of even numbers in old ones together, the others one each, and
    also, outdated, in the old ones; some texts are broken."""
    p = pages(spark, sf_dir).withColumn("k", F.regexp_extract("rel_path", "[0-9]+", 0).cast("long"))
    old = F.struct("page_index", F.when(F.col("status") != "pending", F.col("status")).alias("status"), "estimated_cost")
    new = F.struct("page_index", F.concat(F.lit("page_"), F.lpad((F.col("page_index") + 1).cast("string"), 4, "0")).alias("page_label"), "status", "estimated_cost", "confidence")
    by_file = lambda page: p.groupBy("rel_path", "k").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    first = by_file(old).withColumn("pages", F.when(F.col("k") % 2 == 0, F.col("pages")).otherwise(F.slice("pages", 1, 1)))
    entry = F.concat(F.to_json(F.struct(F.col("rel_path").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("rel_path").alias("v")))) - 6), F.lit(":"), F.to_json(F.struct("pages")))
    files_of_old = first.groupBy(F.floor(F.col("k") / 50).alias("g")).agg(F.concat(F.lit('{"note":"none","empty":{},'), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("body")).select("body")
    single = by_file(new).filter("k % 2 = 1").select(F.to_json(F.struct(F.lit(3).alias("version"), F.lit("2026-01-01").alias("updated_at"), "rel_path", F.struct(F.concat(F.lit("sha"), "k").alias("sha256"), "pages").alias("pdf"))).alias("body"))
    broken = single.select(F.concat(F.col("body"), F.lit("}")).alias("body"))
    d = state.migrated(files_of_old.union(single).union(broken))
    return d.select("rel_path", "version", "sha256", "page_index", "page_label", "status", "estimated_cost")


_RECORDS = """r AS (SELECT doc_id, lang, source, list_filter(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header records of documents: a title and authors of their words, an imprint, and a reference for every third word of ten."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "), " "), lambda w: w != "").alias("w"))
    word = lambda k: F.coalesce(F.get("w", k), F.lit(""))
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name.split()[0]}>"))
    author = lambda a, b: tag("author", tag("persName", tag('forename type="first"', a), tag("surname", b)))
    number = F.col("doc_id").cast("string")
    source = tag("sourceDesc", tag("biblStruct", tag("analytic", author(word(0), word(1)), author(word(2), word(3)), tag('idno type="DOI"', F.lit("10.1/"), number)),
        tag("monogr", tag('title level="j"', F.lit("Journal "), F.col("lang")), tag("imprint", tag('biblScope unit="volume"', number), F.lit('<biblScope unit="page" from="1" to="2">1-2</biblScope><date type="other">1800</date><date type="published" when="2020-05-01"/>')))))
    about = tag("profileDesc", tag("abstract", tag("p", word(4), F.lit(" "), word(5))), tag("textClass", tag("keywords", tag("term", word(6)), F.lit("<term/>"), tag("term", F.lit("known")))))
    listed = F.array_join(F.transform(F.slice("w", 1, 9), lambda w, i: F.when(i % 3 == 2, tag("biblStruct", tag("analytic", tag("title", w), tag("author", F.lit("Some One"))), F.lit("<monogr><imprint><date>1999</date></imprint></monogr>"))).otherwise(F.lit("<biblStruct/>"))), "")
    record = F.concat(F.lit('<?xml version="1.0"?><tei:TEI xmlns:tei="http://www.tei-c.org/ns/1.0" xmlns="http://www.tei-c.org/ns/1.0">'), tag("teiHeader", tag("fileDesc", tag("titleStmt", tag("title", word(0), F.lit(" "), word(1))), source), about), tag("text", tag("back", tag("div", tag("listBibl", listed)))), F.lit("</tei:TEI>"))
    return d.select("doc_id", F.when(F.col("doc_id") % 10 == 9, F.lit("broken <")).otherwise(record).alias("xml"))


@query(
    f"""WITH {_RECORDS}, g AS (SELECT *, doc_id % 10 <> 9 AS ok, list_transform(range(1, 8), lambda i: coalesce(w[i], '')) AS v FROM r)
    SELECT doc_id, CASE WHEN ok THEN trim(v[1] || ' ' || v[2]) ELSE '' END AS title, CASE WHEN ok THEN array_to_string(list_filter([trim(v[1] || ' ' || v[2]), trim(v[3] || ' ' || v[4])], lambda a: a <> ''), ';') ELSE '' END AS authors,
      CASE WHEN ok THEN trim(v[5] || ' ' || v[6]) ELSE '' END AS abstract, CASE WHEN NOT ok THEN '' WHEN v[7] = '' THEN 'known' ELSE v[7] || ';known' END AS keywords, CASE WHEN ok THEN '10.1/' || doc_id ELSE '' END AS doi,
      CASE WHEN ok THEN 'Journal ' || lang ELSE '' END AS journal, CASE WHEN ok THEN CAST(doc_id AS VARCHAR) ELSE '' END AS volume, '' AS issue, CASE WHEN ok THEN '1-2' ELSE '' END AS pages, CASE WHEN ok THEN '2020' ELSE '' END AS year FROM g"""
)
def record_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of header records, by columns over their XML."""
    d = extras.headers(_records(spark, sf_dir), "doc_id")
    return d.withColumns({"authors": F.array_join("authors", ";"), "keywords": F.array_join("keywords", ";")})


@query(
    f"""WITH {_RECORDS}, i AS (SELECT doc_id, w[i] AS title, i // 3 - 1 AS number FROM (SELECT doc_id, w, unnest([3, 6, 9]) AS i FROM r WHERE doc_id % 10 <> 9) WHERE len(w) >= i)
    SELECT doc_id, CAST(number AS INTEGER) AS number, title, 'Some One' AS authors, '1999' AS year, '' AS doi FROM i"""
)
def record_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of records, empty ones left out."""
    d = extras.references(_records(spark, sf_dir), "doc_id")
    return d.select("doc_id", "number", "title", F.array_join("authors", ";").alias("authors"), "year", "doi")


@query(
    f"""WITH {PAGES}, n AS (SELECT count(*) AS pages, count(*) FILTER (WHERE status IN ('complete', 'extracted', 'skipped')) AS done, count(*) FILTER (WHERE status = 'failed') AS failed, round(sum(estimated_cost), 4) AS cost FROM pg)
    SELECT unnest(['batch', 'stream']) AS kind, CAST(pages AS BIGINT) AS pages, CAST(done AS BIGINT) AS done, CAST(failed AS BIGINT) AS failed, cost FROM n"""
)
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is observed while the pages are written, in a batch and in a stream of several micro-batches."""
    import time

    base = scratch.folder(spark, "progress")
    seen_pages, seen = progress.observed(pages(spark, sf_dir))
    seen_pages.repartition(3, "page_index").write.parquet(f"{base}/in")
    log = progress.ProgressLog("pages")
    spark.streams.addListener(log)
    try:
        source = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        q = progress.observed_stream(source).writeStream.format("noop").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        until = time.time() + 60
        while str(q.id) not in log.ended and time.time() < until:  # listeners are told a little later
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    row = lambda kind, c: (kind, c["pages"], c["done"], c["failed"], round(c["cost"] or 0.0, 4))
    return spark.createDataFrame([row("batch", seen.get), row("stream", {"pages": 0, "done": 0, "failed": 0, "cost": 0.0} | log.total())], "kind string, pages long, done long, failed long, cost double")
