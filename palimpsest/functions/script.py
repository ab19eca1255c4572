"""Scripts of texts and codes of languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

# The classes of the comparison study.
STUDY_CLASSES = {
    "cyrillic": r"[\x{0400}-\x{04FF}]",
    "cjk": r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]",
    "arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]",
    "diacritics": r"[\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{00FF}]",
}


def _removed(x: Column, script: str) -> Column:
    """Characters of a script: what a text loses with all runs of them, which is one match a run and not a character."""
    return (F.length(x) - F.length(F.regexp_replace(x, f"{dims.SCRIPT_CLASSES[script]}+", ""))).cast("long")


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def _beyond_ascii(x: Column) -> Column:
    """The characters that can be of another script than latin."""
    return F.regexp_replace(x, r"[\x00-\x7F]+", "")


def script_counts(x: Column) -> dict[str, Column]:
    """Characters of each script."""
    return {s: _removed(x if s == "latin" else _beyond_ascii(x), s) for s in dims.SCRIPT_CLASSES}


def detect_script(x: Column) -> Column:
    """The most frequent script; of equals the one whose character comes first; none: latin.

    Two passes over the text, for latin characters and for those beyond ASCII; only where latin ones are not the
    majority is what the second leaves looked through for each script."""

    def settled(v: Column) -> Column:
        counts = F.array(*(F.struct((v["latin"] if s == "latin" else _removed(v["rest"], s)).alias("n"), F.lit(s).alias("script")) for s in dims.SCRIPT_CLASSES))
        found = F.filter(counts, lambda c: c["n"] > 0)
        return F.when(v["latin"] > F.length(v["rest"]), F.lit("latin")).otherwise(_bound(found, among))

    def among(found: Column) -> Column:
        return _bound(F.array_max(found), lambda best: first_of(F.filter(found, lambda s: s["n"] == best["n"]), best))

    def first_of(equals: Column, best: Column) -> Column:
        # places are looked for only where two scripts are equally frequent
        places = F.create_map(*(v for s, c in dims.SCRIPT_CLASSES.items() for v in (F.lit(s), F.regexp_instr(x, F.lit(c)))))
        first = F.array_max(F.transform(equals, lambda s: F.struct((-F.try_element_at(places, s["script"])).alias("at"), s["script"].alias("script"))))["script"]
        return F.when(F.size(equals) > 1, first).otherwise(best["script"])

    return F.coalesce(_bound(F.struct(_removed(x, "latin").alias("latin"), _beyond_ascii(x).alias("rest")), settled), F.lit("latin"))


def has_script(x: Column, script: str) -> Column:
    return F.rlike(x, F.lit(STUDY_CLASSES[script]))


def is_rtl(code: Column) -> Column:
    return code.isin(dims.RTL_LANGUAGES)


def language_name(code: Column) -> Column:
    return dims.lookup(dims.LANGUAGE_NAMES, code)


def iso639_3(code: Column) -> Column:
    return dims.lookup(dims.ISO639_3, code, code)


def tesseract_languages(codes: Column) -> Column:
    """Codes of the engine, joined by +; unknown ones pass."""
    names = dims.map_of(dims.TESSERACT_CODES)
    return F.array_join(F.transform(codes, lambda c: F.coalesce(F.try_element_at(names, c), c)), "+")


def settle_language(detected: Column, hints: Column) -> Column:
    """What becomes of a detector's answer: confused languages replaced, then the first hint unless it is a hint."""
    lang = dims.lookup(dims.CONFUSION_PAIRS, detected, detected)
    hinted = (F.size(hints) > 0) & ~F.array_contains(hints, lang)
    return F.when(F.coalesce(detected, F.lit("")) == "", "").when(hinted, F.try_element_at(hints, F.lit(1))).otherwise(lang)
