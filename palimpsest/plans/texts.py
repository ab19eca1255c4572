"""Queries over texts: clean-up, scripts, error rates, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import metrics as M
from ..functions import script as S
from ..functions import text as T
from ..operators import alignment, evaluation, language, reconcile
from .inputs import ascii, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_HYP = lambda x: F.replace(F.replace(x, F.lit("rn"), F.lit("m")), F.lit("e "), F.lit("c "))
_NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_ASCII = r"regexp_replace({}, '[^\x00-\x7F]', '?', 'g')"


@query(
    rf"""WITH l AS (SELECT lang, source, unnest(string_split({_ASCII.format("coalesce(text, '')")}, chr(10))) AS line FROM documents),
    n AS (SELECT lang, source, {_NORM.format("line")} AS r, {_NORM.format("replace(replace(line, 'rn', 'm'), 'e ', 'c ')")} AS h FROM l)
    SELECT lang, source, CAST(sum(levenshtein(r, h)) AS BIGINT) AS char_errors, CAST(sum(length(r)) AS BIGINT) AS ref_chars FROM n GROUP BY lang, source"""
)
def cer_by_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character errors of a misread text against its reference, line by line, by language and source."""
    d = M.spread(read(spark, sf_dir, "documents").select("lang", "source", "text")).select("lang", "source", F.explode(F.split(ascii(F.coalesce("text", F.lit(""))), "\n")).alias("line"))
    d = d.select("lang", "source", T.normalized(F.col("line")).alias("r"), T.normalized(_HYP(F.col("line"))).alias("h"))
    return d.groupBy("lang", "source").agg(F.sum(M.distance(F.col("r"), F.col("h"))).alias("char_errors"), F.sum(F.length("r")).alias("ref_chars"))


@query(
    rf"""WITH n AS (SELECT role, {_NORM.format(_ASCII.format("text"))} AS r, {_NORM.format("replace(replace(" + _ASCII.format("text") + ", 'rn', 'm'), 'e ', 'c ')")} AS h FROM conversations)
    SELECT role, CAST(sum(levenshtein(r, h)) AS BIGINT) AS char_errors, CAST(sum(length(r)) AS BIGINT) AS ref_chars, round(avg(CASE WHEN length(r) > 0 THEN levenshtein(r, h) / CAST(length(r) AS DOUBLE) ELSE 0.0 END), 6) AS mean_cer
    FROM n GROUP BY role"""
)
def cer_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.spread(read(spark, sf_dir, "conversations").select("role", ascii(F.col("text")).alias("t")))
    d = d.select("role", T.normalized(F.col("t")).alias("r"), T.normalized(_HYP(F.col("t"))).alias("h"))
    return d.groupBy("role").agg(F.sum(M.distance(F.col("r"), F.col("h"))).alias("char_errors"), F.sum(F.length("r")).alias("ref_chars"), F.round(F.avg(M.cer(F.col("r"), F.col("h"))), 6).alias("mean_cer"))


# The full table over words, row by row: a step takes what deletions and substitutions give, and a running minimum the insertions.
@query(
    rf"""WITH RECURSIVE n AS MATERIALIZED (SELECT row_number() OVER () AS id, role, list_filter(string_split({_NORM.format("coalesce(text, '')")}, ' '), lambda w: w <> '') AS r,
      list_filter(string_split({_NORM.format("replace(replace(coalesce(text, ''), 'rn', 'm'), 'e ', 'c ')")}, ' '), lambda w: w <> '') AS h FROM conversations),
    rt AS MATERIALIZED (SELECT id, unnest(r) AS w, generate_subscripts(r, 1) AS j FROM n), ht AS MATERIALIZED (SELECT id, unnest(h) AS w, generate_subscripts(h, 1) AS i FROM n),
    d AS (SELECT id, CAST(0 AS BIGINT) AS i, unnest(range(0, len(r) + 1)) AS j, unnest(range(0, len(r) + 1)) AS v FROM n
      UNION ALL SELECT id, i, j, min(t - j) OVER (PARTITION BY id ORDER BY j) + j FROM (SELECT d.id, d.i + 1 AS i, d.j, CASE WHEN d.j = 0 THEN d.i + 1
        ELSE least(d.v + 1, lag(d.v) OVER (PARTITION BY d.id ORDER BY d.j) + CASE WHEN rt.w = ht.w THEN 0 ELSE 1 END) END AS t FROM d JOIN ht ON ht.id = d.id AND ht.i = d.i + 1 LEFT JOIN rt ON rt.id = d.id AND rt.j = d.j))
    SELECT n.role, CAST(sum(d.v) AS BIGINT) AS word_errors, CAST(sum(len(n.r)) AS BIGINT) AS ref_words FROM d JOIN n ON d.id = n.id AND d.i = len(n.h) AND d.j = len(n.r) GROUP BY n.role"""
)
def wer_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of a misread text against its reference."""
    d = M.spread(read(spark, sf_dir, "conversations").select("role", F.coalesce("text", F.lit("")).alias("t")))
    d = d.select("role", T.normalized(F.col("t")).alias("r"), T.normalized(_HYP(F.col("t"))).alias("h"))
    return d.groupBy("role").agg(F.sum(M.word_distance(F.col("r"), F.col("h"))).alias("word_errors"), F.sum(F.size(T.tokens(F.col("r")))).alias("ref_words"))


@query(
    rf"""WITH n AS (SELECT doc_id, {_ASCII.format("coalesce(text, '')")} AS r, replace(replace({_ASCII.format("coalesce(text, '')")}, 'rn', 'm'), 'e ', 'c ') AS h FROM documents)
    SELECT doc_id, CAST(levenshtein(r, h) AS BIGINT) AS char_errors, CAST(length(r) AS BIGINT) AS ref_chars, CAST(length(h) AS BIGINT) AS hyp_chars FROM n"""
)
def cer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character errors over whole documents of any length, by pieces between common anchors."""
    d = M.spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", ascii(F.coalesce("text", F.lit(""))).alias("r"))
    return alignment.distances(d.withColumn("h", _HYP(F.col("r"))), ["doc_id"], "r", "h")


@query(
    rf"""WITH t AS (SELECT conv_id, turn, {_ASCII.format("text")} AS a, lead({_ASCII.format("text")}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
    SELECT conv_id, turn, levenshtein(a, b) / CAST(greatest(length(a), length(b), 1) AS DOUBLE) AS study_cer FROM t WHERE b IS NOT NULL"""
)
def study_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", ascii(F.col("text")).alias("a"))
    t = t.withColumn("b", F.lead("a").over(W.partitionBy("conv_id").orderBy("turn"))).filter("b IS NOT NULL")
    return t.select("conv_id", "turn", M.study_cer(F.col("a"), F.col("b")).alias("study_cer"))


# Clean-up: the tables hold no such characters, so they are put in by replacements that both engines share.
_INJECT = {
    "soft_hyphens": ([("tion", "ti¬ \n on"), ("the", "th¬e")], r"replace(regexp_replace({}, '¬\s*\n\s*', '', 'g'), '¬', '')"),
    "dehyphenate": ([("tion", "ti-\n on"), ("eau", "é-\n à")], r"regexp_replace({}, '([\pL\pN_])-\s*\n\s*([\pL\pN_])', '\1\2', 'g')"),
    "em_dash_breaks": ([(". ", "— \n ")], r"regexp_replace({}, '—\s*\n\s*', '—', 'g')"),
    "whitespace_normalize": ([(". ", ". \t\n\n\n\n"), (", ", ",  \n")], r"regexp_replace(regexp_replace({}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t\r\f\v]+(\n|$)', '\1', 'g')"),
    "stray_control_chars": ([(", ", ",\x07\x1b "), (". ", ".\x7f\r ")], r"regexp_replace({}, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g')"),
    "ligature_expand": ([("fi", "ﬁ"), ("ff", "ﬀ"), ("fl", "ﬂ"), ("ae", "æ"), ("oe", "œ")], "replace(replace(replace(replace(replace({}, 'ﬁ', 'fi'), 'ﬀ', 'ff'), 'ﬂ', 'fl'), 'æ', 'ae'), 'œ', 'oe')"),
}


def _sql_literal(s: str) -> str:
    out = []
    for c in s:
        if out and c.isprintable() and out[-1].startswith("'"):
            out[-1] = out[-1][:-1] + c.replace("'", "''") + "'"
        else:
            out.append("'" + c.replace("'", "''") + "'" if c.isprintable() else f"chr({ord(c)})")
    return "(" + " || ".join(out or ["''"]) + ")"


def _injected(x: Column, pairs) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _injected_sql(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {_sql_literal(a)}, {_sql_literal(b)})"
    return x


def _cleanup(step: str) -> None:
    pairs, sql = _INJECT[step]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = M.spread(read(spark, sf_dir, "documents").select("doc_id", "text")) if step == "ligature_expand" else read(spark, sf_dir, "documents")
        return d.select("doc_id", T.STEPS[step](_injected(F.col("text"), pairs)).alias("cleaned"))

    QUERIES[f"postprocess_{step}"] = run
    ORACLES[f"postprocess_{step}"] = f"SELECT doc_id, {sql.format(_injected_sql('text', pairs))} AS cleaned FROM documents"


for _step in _INJECT:
    _cleanup(_step)

_ALL = [("tion", "ti¬ \n on"), ("eau", "é-\n à"), (". ", "— \n "), (", ", ",  \n\n\n\n"), ("fi", "ﬁ"), ("is", "i\x07s")]


def _all_sql() -> str:
    x = _injected_sql("text", _ALL)
    for step in T.ALL_STEPS:
        x = _INJECT[step][1].format(x)
    return f"SELECT doc_id, sha256({x}) AS cleaned_sha256, CAST(length({x}) AS BIGINT) AS cleaned_chars FROM documents"


@query(_all_sql())
def postprocess_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clean-up steps in order."""
    d = M.spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.postprocess(_injected(F.col("text"), _ALL), T.ALL_STEPS).alias("c"))
    return d.select("doc_id", F.sha2("c", 256).alias("cleaned_sha256"), F.length("c").cast("long").alias("cleaned_chars"))


@query("SELECT doc_id, contains(text, '§') AS section, contains(text, '–') AS en_dash, contains(text, '—') AS em_dash, contains(text, '’') AS apostrophe, contains(text, '¶') AS pilcrow FROM (SELECT doc_id, replace(replace(text, 'tion', '—'), 'eau', '§') AS text FROM documents)")
def preserved_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", T.preserved_chars_present(_injected(F.col("text"), [("tion", "—"), ("eau", "§")])).alias("m"))
    return d.select("doc_id", *(F.element_at("m", c).alias(n) for c, n in zip(T.PRESERVED, ("section", "en_dash", "em_dash", "apostrophe", "pilcrow"), strict=True)))


# Scripts: Cyrillic, Han, Arabic and Greek letters are put in by replacements.
_SCRIPTED = [("th", "жд"), ("ción", "漢字"), ("eau", "عر"), ("sch", "λμ")]
_SQL_CLASSES = {s: c.replace("\\x{", "\\x{") for s, c in dims.SCRIPT_CLASSES.items()}
_SCRIPT_SRC = f"WITH t AS (SELECT doc_id, {_injected_sql('text', _SCRIPTED)} AS x FROM documents)"


@query(_SCRIPT_SRC + " SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(x, '{c}')) AS BIGINT) AS {s}" for s, c in _SQL_CLASSES.items()) + " FROM t")
def script_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", _injected(F.col("text"), _SCRIPTED).alias("x"))
    return d.select("doc_id", *(c.alias(s) for s, c in S.script_counts(F.col("x")).items()))


_DETECT = (
    _SCRIPT_SRC
    + ", s AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{s}' AS script, len(regexp_extract_all(x, '{c}')) AS n, strpos(x, regexp_extract(x, '{c}')) AS first_at FROM t" for s, c in _SQL_CLASSES.items())
    + "), b AS (SELECT doc_id, script, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS k FROM s WHERE n > 0), d AS (SELECT t.doc_id, coalesce(b.script, 'latin') AS script FROM t LEFT JOIN b ON t.doc_id = b.doc_id AND b.k = 1)"
)


@query(_DETECT + " SELECT doc_id, script FROM d")
def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", S.detect_script(_injected(F.col("text"), _SCRIPTED)).alias("script"))


_ROUTES = ", ".join(f"('{p.name}', '{s}', '{m}')" for p in dims.PROFILES.values() for s, m in p.model_routing.items())


@query(
    _DETECT
    + f", r(profile, script, model) AS (VALUES {_ROUTES}), p AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'general' WHEN 'fr' THEN 'books' WHEN 'de' THEN 'technical' ELSE 'mathematical' END AS profile FROM documents) "
    "SELECT p.doc_id, p.profile, d.script, coalesce(r.model, 'gemini-2.5-flash') AS model FROM p JOIN d ON p.doc_id = d.doc_id LEFT JOIN r ON r.profile = p.profile AND r.script = d.script"
)
def script_route_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = F.when(F.col("lang") == "en", "general").when(F.col("lang") == "fr", "books").when(F.col("lang") == "de", "technical").otherwise("mathematical")
    d = read(spark, sf_dir, "documents").select("doc_id", profile.alias("profile"), _injected(F.col("text"), _SCRIPTED).alias("x"))
    return reconcile.route_model(d, "profile", "x", dims.dim_routing(spark), "gemini-2.5-flash").select("doc_id", "profile", "script", "model")


@query(
    r"""WITH t AS (SELECT doc_id, text AS marker, CASE lang WHEN 'fr' THEN replace(text, 'eau', '[illegible]') WHEN 'de' THEN substr(text, 1, CAST(length(text) // 3 AS BIGINT)) WHEN 'es' THEN regexp_replace(text, '[^ \n]', ' ', 'g') ELSE text END AS result FROM documents)
    SELECT doc_id, (length(result) - length(replace(result, '[illegible]', ''))) / 11 > 3 OR length(regexp_replace(result, '^\s+|\s+$', '', 'g')) = 0 OR length(regexp_replace(result, '\S', '', 'g')) > 0.8 * length(result)
      OR (length(regexp_replace(marker, '^\s+|\s+$', '', 'g')) > 0 AND length(regexp_replace(result, '^\s+|\s+$', '', 'g')) < 0.5 * length(regexp_replace(marker, '^\s+|\s+$', '', 'g'))) AS low_quality FROM t"""
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a merge must be tried again."""
    t, lang = F.col("text"), F.col("lang")
    result = (
        F.when(lang == "fr", F.replace(t, F.lit("eau"), F.lit("[illegible]"))).when(lang == "de", F.substring(t, F.lit(1), F.floor(F.length(t) / 3).cast("int")))
        .when(lang == "es", F.regexp_replace(t, r"[^ \n]", " ")).otherwise(t)
    )
    return read(spark, sf_dir, "documents").select("doc_id", reconcile.low_quality(result, t).alias("low_quality"))


@query(
    r"""SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS words,
    len(regexp_extract_all(text, '[^\x00-\x7F]')) / CAST(greatest(length(text), 1) AS DOUBLE) AS non_latin_ratio, regexp_matches(text, '[\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{00FF}]') AS diacritics FROM documents"""
)
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, words, share beyond ASCII, diacritics: the measures of the comparison study."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), T.word_count(t).alias("words"), T.non_latin_ratio(t).alias("non_latin_ratio"), S.has_script(t, "diacritics").alias("diacritics"))


@query(r"SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS stripped FROM pages")
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.strip_comments(F.col("html")).alias("stripped"))


@query(
    """WITH r AS (SELECT d.source AS profile, coalesce(l.quality, 0) AS q, coalesce(l.toxic, 0) AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
    SELECT profile, CAST(count(*) AS BIGINT) AS items, avg(CAST(q AS DOUBLE)) AS mean_cer, avg(CAST(t AS DOUBLE)) AS mean_wer FROM r GROUP BY ROLLUP(profile)"""
)
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group means with the overall mean of items: labels stand in for error rates."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("profile")).join(read(spark, sf_dir, "labels"), "doc_id")
    return evaluation.profile_summary(d.select("profile", F.col("quality").cast("double").alias("cer"), F.col("toxic").cast("double").alias("wer"))).select("profile", "items", "mean_cer", "mean_wer")


@query(
    r"""WITH r AS (SELECT d.lang AS script, d.source AS config, length(d.text) AS c, len(list_filter(regexp_split_to_array(d.text, '\s+'), lambda x: x <> '')) AS w, l.quality AS e FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT script, config, avg(CAST(c AS DOUBLE)) AS avg_chars, avg(CAST(w AS DOUBLE)) AS avg_words, avg(CAST(e AS DOUBLE)) AS avg_cer, CAST(count(*) AS BIGINT) AS pages FROM r GROUP BY script, config"""
)
def script_config_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("script"), F.col("source").alias("config"), F.length("text").alias("char_count"), T.word_count(F.col("text")).alias("word_count"), T.non_latin_ratio(F.col("text")).alias("non_latin_ratio"))
    d = d.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("cer")), "doc_id", "left")
    return evaluation.script_config_summary(d).drop("avg_non_latin")


_SCRIPT_OF = " ".join(f"WHEN script = '{s}' THEN '{c}'" for s, c in language.BY_SCRIPT.items())
_PAIRS = " ".join(f"WHEN lang = '{a}' THEN '{b}'" for a, b in dims.CONFUSION_PAIRS.items())
_THREE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dims.ISO639_3.items())
# Trigrams of letters, counted on four folds of five; the 300 most frequent of each language, weighted as log probabilities.
_LANGUAGES = (
    _DETECT.replace(_SCRIPT_SRC, "WITH t AS (SELECT doc_id, text AS x FROM documents)", 1)
    + rf""", ch AS (SELECT doc_id, lang, doc_id % 5 <> 0 AS train, string_split(' ' || regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g') || ' ', '') AS c FROM documents WHERE text IS NOT NULL),
    tg AS MATERIALIZED (SELECT doc_id, lang, train, g, count(*) AS m FROM (SELECT doc_id, lang, train, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM ch) GROUP BY doc_id, lang, train, g),
    cn AS (SELECT lang, g, sum(m) AS n FROM tg WHERE train AND lang IS NOT NULL GROUP BY lang, g),
    us AS (SELECT DISTINCT g FROM (SELECT g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS k FROM cn) WHERE k <= 300),
    tt AS (SELECT lang, sum(n) AS total FROM cn JOIN us USING (g) GROUP BY lang),
    wt AS MATERIALIZED (SELECT us.g, tt.lang AS l, CAST(round(1000 * ln((coalesce(cn.n, 0) + 1) / (tt.total + (SELECT count(*) FROM us)))) AS BIGINT) AS w FROM us CROSS JOIN tt LEFT JOIN cn ON cn.g = us.g AND cn.lang = tt.lang),
    sc AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY sum(m * w) DESC, l) AS k FROM tg JOIN wt USING (g) GROUP BY doc_id, l),
    lg AS (SELECT t.doc_id, CASE WHEN x IS NULL OR length(trim(x, ' ' || chr(10) || chr(9) || chr(13))) < 10 THEN '' {_SCRIPT_OF} ELSE coalesce(sc.l, '') END AS lang FROM t JOIN d ON t.doc_id = d.doc_id LEFT JOIN sc ON sc.doc_id = t.doc_id AND sc.k = 1),
    lf AS (SELECT doc_id, CASE {_PAIRS} ELSE lang END AS language FROM lg)"""
)


def _languages(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """Languages of the texts that meet a condition."""
    d = read(spark, sf_dir, "documents")
    return language.detect(d.filter(which), language.learn(d.filter("doc_id % 5 <> 0")), "doc_id")


@query(_LANGUAGES + f" SELECT doc_id, language, CASE language {_THREE} ELSE language END AS language3 FROM lf")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts by trigrams learnt on four folds of five, with three-letter codes."""
    return _languages(spark, sf_dir).select("doc_id", "language", S.iso639_3(F.col("language")).alias("language3"))


@query(_LANGUAGES + " SELECT d.lang, CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (WHERE lf.language = d.lang) AS BIGINT) AS found, CAST(count(*) FILTER (WHERE lf.language = '') AS BIGINT) AS unknown FROM documents d JOIN lf USING (doc_id) WHERE d.doc_id % 5 = 0 GROUP BY d.lang")
def language_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many held-out texts are told right, by their true language."""
    d = read(spark, sf_dir, "documents").filter("doc_id % 5 = 0").select("doc_id", "lang").join(_languages(spark, sf_dir, "doc_id % 5 = 0"), "doc_id")
    return d.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("language") == F.col("lang")).alias("found"), F.count_if(F.col("language") == "").alias("unknown"))
