import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import display, identifiers, metrics, script
from palimpsest.functions import text as T
from palimpsest.operators import language


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


# The same steps in plain Python, written from their descriptions.
PY = {
    "soft_hyphens": lambda t: re.sub(r"¬\s*\n\s*", "", t).replace("¬", ""),
    "dehyphenate": lambda t: re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", t),
    "em_dash_breaks": lambda t: re.sub(r"—\s*\n\s*", "—", t),
    "whitespace_normalize": lambda t: "\n".join(x.rstrip() for x in re.sub(r"\n{3,}", "\n\n", t).split("\n")),
    "stray_control_chars": lambda t: "".join(c for c in t if c in "\n\t" or (ord(c) >= 32 and ord(c) != 127)),
}


@pytest.mark.parametrize("step", sorted(PY))
def test_cleanup_steps(spark, step):
    rows = ["", "plain", "Wör¬ \n tern¬", "Donau-\n  dampf", "é-\nà x- \ny", "so — \n\t it", "a  \n\n\n\n b\t\n \n", "\x00a\x07\tb\x7f\r\n\x85", "¬\n¬ ¬", "-\n-", "x -\n y"]
    assert values(spark, T.STEPS[step](F.col("x")), rows) == [PY[step](r) for r in rows]


ALPHABET = st.text(alphabet=list("ab é-¬—\n\t\x1c\x85\xa0 _²½1ﬁ\x07"), max_size=30)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ALPHABET, min_size=40, max_size=80))
def test_cleanup_agrees_and_settles(spark, rows):
    for step in ("soft_hyphens", "em_dash_breaks", "whitespace_normalize", "stray_control_chars"):
        got = values(spark, T.STEPS[step](F.col("x")), rows)
        if step != "whitespace_normalize":
            assert got == [PY[step](r) for r in rows]
        if step != "stray_control_chars" and step != "whitespace_normalize":
            assert values(spark, T.STEPS[step](F.col("x")), got) == got


def test_ligatures_and_postprocess(spark):
    assert values(spark, T.ligature_expand(F.col("x")), ["oﬃce ﬂow Æon œuvre ①", None]) == ["office flow AEon oeuvre 1", None]
    assert values(spark, T.postprocess(F.col("x"), ["unheard", "soft_hyphens"]), ["a¬\nb-\nc"]) == ["ab-\nc"]
    whole = "§ 12 – “x” — ¶’"
    assert values(spark, T.postprocess(F.col("x"), T.ALL_STEPS), [whole]) == [whole]
    assert values(spark, T.preserved_chars_present(F.col("x")), [whole])[0] == {c: True for c in T.PRESERVED}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


PAIRS = [("kitten", "sitting"), ("", ""), ("", "x"), ("ab", ""), ("é", "e"), ("the cat sat", "the bat sat down"), ("a b c", "c b a"), ("  x  y ", "x y")]


def test_error_rates(spark):
    inf = float("inf")
    want = [distance(a, b) / len(a) if a else (0.0 if not b else inf) for a, b in PAIRS]
    assert values(spark, metrics.cer(F.col("a"), F.col("b")), PAIRS, "a string, b string") == want
    words = [distance(a.split(), b.split()) for a, b in PAIRS]
    assert values(spark, metrics.word_distance(F.col("a"), F.col("b")), PAIRS, "a string, b string") == words
    want = [n / len(a.split()) if a.split() else (0.0 if not b.split() else inf) for n, (a, b) in zip(words, PAIRS, strict=True)]
    assert values(spark, metrics.wer(F.col("a"), F.col("b")), PAIRS, "a string, b string") == want
    want = [distance(a, b) / max(len(a), len(b), 1) for a, b in PAIRS]
    assert values(spark, metrics.study_cer(F.col("a"), F.col("b")), PAIRS, "a string, b string") == want
    rows = metrics.evaluate(spark.createDataFrame([("A  b\n", "a b")], "reference string, hypothesis string")).collect()
    assert (rows[0].cer, rows[0].wer, rows[0].ref_chars, rows[0].normalized) == (0.0, 0.0, 3, True)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abé ", max_size=12), st.text("abé ", max_size=12)), min_size=30, max_size=60))
def test_similarity_bounds(spark, pairs):
    ab = values(spark, metrics.similarity(F.col("a"), F.col("b")), pairs, "a string, b string")
    ba = values(spark, metrics.similarity(F.col("b"), F.col("a")), pairs, "a string, b string")
    assert ab == ba and all(0 <= x <= 1 for x in ab)


def test_readings_of_one_text_fill_no_long_table(monkeypatch):
    rng, filled, full = random.Random(2), [], metrics._by_columns
    monkeypatch.setattr(metrics, "_by_columns", lambda a, b: filled.append(len(a)) or full(a, b))
    text = " ".join("".join(rng.choice("acemnrst") for _ in range(rng.randint(1, 9))) for _ in range(80))
    misread = text.replace("rn", "m").replace("e ", "c ")
    assert metrics.edit_distance(text, misread) == metrics.edit_distance(misread, text) == distance(text, misread) > 0
    assert max(filled) < 20


def test_edit_distance_where_bounds_do_not_meet():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
    for k in range(300):
        a = [word() for _ in range(rng.randint(12, 24))]
        b = [word() if rng.random() < 0.2 else w for w in a]
        if k % 3 == 0:
            b = b[1:] + [word()]  # words that move: as many, but not in their places
        if k % 5 == 0:
            b.insert(rng.randint(0, len(b)), word())
        a, b = " ".join(a), " ".join(b)
        assert metrics.edit_distance(a, b) == distance(a, b), (a, b)
    assert metrics.edit_distance("ab " * 20 + "x" * 70, "ba " * 20 + "x" * 70 + "y") == distance("ab " * 20 + "x" * 70, "ba " * 20 + "x" * 70 + "y")


def test_scripts(spark):
    rows = ["Hello", "Привет мир", "漢字かな", "مرحبا", "Ελλάδα", "नमस्ते", "", "123", "жa", "aж", "ἀ"]
    want = ["latin", "cyrillic", "cjk", "arabic", "greek", "devanagari", "latin", "latin", "cyrillic", "latin", "latin"]
    assert values(spark, script.detect_script(F.col("x")), rows) == want
    assert values(spark, script.is_rtl(F.col("x")), ["ar", "he", "fa", "en", "zh"]) == [True, True, True, False, False]
    assert values(spark, script.tesseract_languages(F.split("x", ",")), ["en,fr", "zh,xx", ""]) == ["eng+fra", "chi_sim+xx", ""]


def test_language_rules(spark):
    hints = F.array(F.lit("fr"), F.lit("en"))
    assert values(spark, script.settle_language(F.col("x"), hints), ["en", "de", "no", ""]) == ["en", "fr", "fr", ""]
    none = F.array().cast("array<string>")
    assert values(spark, script.settle_language(F.col("x"), none), ["no", "bs", "ca", "en"]) == ["nb", "hr", "es", "en"]


def test_scripts_of_mixed_texts(spark):
    """Every mixture of the classes, against counting characters one by one."""
    rng = random.Random(2)
    some = {"latin": "aé", "cyrillic": "жд", "cjk": "漢か", "arabic": "مر", "greek": "Ελ", "devanagari": "मस", "": " 1.—"}
    rows = ["".join(rng.choice(some[rng.choice(list(some))]) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    want, counted = [], []
    for r in rows:
        n = {s: sum(c in some[s] for c in r) for s in some if s}
        best = max(n.values())
        want.append("latin" if best == 0 else min((s for s in n if n[s] == best), key=lambda s: min(r.index(c) for c in r if c in some[s])))
        counted.append(tuple(n[s] for s in sorted(n)))
    assert values(spark, script.detect_script(F.col("x")), rows) == want
    counts = script.script_counts(F.col("x"))
    assert [tuple(v) for v in values(spark, F.array(*(counts[s] for s in sorted(counts))), rows)] == counted


def test_detected_languages(spark):
    known = [("en", "the cat sat on the mat and it was good for all that they have"), ("fr", "le chat est dans la maison avec une amie et les enfants"), (None, "nobody knows")]
    profiles = language.learn(spark.createDataFrame(known, "lang string, text string"), top=50)
    rows = [(1, "the hat of that man"), (2, "une maison dans les champs"), (3, "short"), (4, "Это довольно длинный текст"), (5, None), (6, "??? !!! 12345 67890"), (7, "x" * 20)]
    df = spark.createDataFrame(rows, "k long, text string")
    assert {r.k: r.language for r in language.detect(df, profiles, "k").collect()} == {1: "en", 2: "fr", 3: "", 4: "ru", 5: "", 6: "", 7: ""}
    hinted = {r.k: r.language for r in language.detect(df, profiles, "k", hints=F.array(F.lit("fr"))).collect()}
    assert hinted == {1: "fr", 2: "fr", 3: "", 4: "fr", 5: "", 6: "", 7: ""}
    assert language.detect(df, language.learn(spark.createDataFrame([], "lang string, text string")), "k").filter("language = 'ru' OR language = ''").count() == 7
    assert values(spark, language.trigrams(F.col("x")), ["Ab, c", ""]) == [[" ab", "ab ", "b c", " c "], []]


def test_identifiers(spark):
    rows = [" https://doi.org/10.1/x ", "http://dx.doi.org/10.2/y", "10.3/z", "doi:10.4/q"]
    assert values(spark, identifiers.normalize_doi(F.col("x")), rows) == ["10.1/x", "10.2/y", "10.3/z", "doi:10.4/q"]
    assert values(spark, identifiers.normalize_isbn(F.col("x")), [" 978-0 306 40615-7 "]) == ["9780306406157"]
    lists = [(["urn:isbn:111", "urn:isbn:222"],), (["uuid", "9780306406157"],), (["0-306-40615"],), ([],)]
    assert values(spark, identifiers.epub_isbn(F.col("x")), lists, "x array<string>") == ["222", "9780306406157", "", ""]
    body = '{"message": {"title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "issued": {"date-parts": [[2019, 1]]}, "license": [{"URL": ""}, {"URL": "u"}], "publisher": null}}'
    r = values(spark, identifiers.crossref_fields(F.col("x")), [body])[0]
    assert (r.title, r.authors, r.year, r.license_url, r.publisher) == ("T", "A B; C", "2019", "u", "")
    r = values(spark, identifiers.library_fields(F.col("x")), ['{"title": "B", "publish_date": "March 2001", "authors": [{"name": "X"}], "languages": [{"key": "/languages/eng"}]}'])[0]
    assert (r.title, r.year, r.authors, r.language) == ("B", "2001", "X", "eng")


def test_display(spark):
    assert values(spark, display.page_label(F.col("x")), [0, 11], "x int") == ["page_0001", "page_0012"]
    assert values(spark, display.format_duration(F.col("x")), [0.0, 59.9, 3661.0, -4.0], "x double") == ["0:00:00", "0:00:59", "1:01:01", "0:00:00"]
    assert values(spark, display.confidence_line(F.lit("t"), F.col("x")), [0.953, None], "x double") == ["<!-- OCR confidence: 95.3% -->\n\nt", "t"]
    made = display.page_comment(F.col("x"), F.lit(0), F.lit("T"), F.lit(""), F.lit("en"), F.lit(""))
    assert values(spark, made, ["body", "<!-- doc: y -->z"]) == ['<!-- doc:" T" | lang: en | page: 1 -->\n\nbody', "<!-- doc: y -->z"]
    assert unicodedata.is_normalized("NFC", "é")
