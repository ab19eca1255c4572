"""Formats, services, settings, the whole run, streams, tools."""

import json
import re
from pathlib import Path
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from palimpsest import catalogue, cli, dims, services, tools
from palimpsest import config as settings
from palimpsest.errors import ConfigError, MergeError
from palimpsest.formats import formatter
from palimpsest.formats import pages as formats
from palimpsest.operators import language, store
from palimpsest.pipeline import Pipeline, write_text_files
from palimpsest.sources import files, reader
from palimpsest.streaming import ingest


def box(*c):
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, c), strict=True)) if c else None


BLOCKS = [
    {"path": [0], "type": "heading", "text": "Title <b> & x", "bbox": box(10, 20, 200, 40), "confidence": 0.95, "words": None},
    {"path": [1], "type": "Table", "text": "", "bbox": box(0, 50, 5, 40), "confidence": 0.0, "words": None},
    {"path": [1, 0], "type": "text", "text": "cell one", "bbox": None, "confidence": 0.0, "words": None},
    {"path": [2], "type": "figure", "text": "ignored", "bbox": box(1, 2, 3, 4), "confidence": 0.0, "words": None},
    {"path": [3], "type": "text", "text": "two words", "bbox": box(0, 0, 9, 9), "confidence": 0.0, "words": [{"text": "two", "bbox": box(1, 1, 4, 3), "confidence": 0.5}, {"text": "words", "bbox": None, "confidence": 0.0}]},
]


def test_alto():
    root = ET.fromstring(formats.alto_xml("page_0001", "", BLOCKS, 100, 200).encode())
    ns = {"a": "http://www.loc.gov/standards/alto/ns-v4#"}
    ids = [e.get("ID") for e in root.iter() if (e.get("ID") or "").startswith("elem")]
    assert ids == [f"elem_{k}" for k in range(1, 6)]
    strings = [(s.get("CONTENT"), s.get("WC"), s.get("HPOS")) for s in root.iterfind(".//a:String", ns)]
    assert strings[:3] == [("Title", "0.9500", "10"), ("<b>", "0.9500", "10"), ("&", "0.9500", "10")]
    assert ("two", "0.5000", "1") in strings and ("words", None, "0") in strings and ("cell", None, "0") in strings
    assert root.find(".//a:ComposedBlock", ns).get("HEIGHT") == "0" and root.find(".//a:Illustration", ns) is not None
    plain = ET.fromstring(formats.alto_xml("p", "<!-- c -->all text", None).encode())
    assert plain.find(".//a:String", ns).get("CONTENT") == "all text" and plain.find(".//a:Page", ns).get("WIDTH") == "2550"


def test_hocr():
    html = formats.hocr_html("page_0002", 1, "", BLOCKS)
    body = html.split("?>", 1)[1].split(">", 1)[1]
    root = ET.fromstring(body.encode())
    by = lambda c: [e for e in root.iter() if e.get("class") == c]
    assert by("ocr_page")[0].get("title") == "image page_0002.png; bbox 0 0 2550 3300; ppageno 2"
    words = [(e.text, e.get("title")) for e in by("ocrx_word")]
    assert words[0] == ("Title", "bbox 10 20 200 40; x_wconf 95") and ("two", "bbox 1 1 4 3; x_wconf 50") in words and ("words", "bbox 0 0 9 9") in words
    assert len(by("ocr_table")) == len(by("ocr_image")) == 1
    assert len(re.findall('class="ocrx_word"', formats.hocr_html("p", 0, "a b c", None))) == 3


def test_column_formats(spark):
    d = spark.createDataFrame([(0, "page_0001", "t", "complete", 0.5)], "page_index int, page_label string, text string, status string, confidence double")
    assert formatter("markdown")(d).first().content == "<!-- OCR confidence: 50.0% -->\n\nt"
    d = d.withColumn("outputs", F.array(F.struct(F.lit("marker").alias("engine"), F.lit("é").alias("text"), F.lit(None).cast("string").alias("error"))))
    assert json.loads(formatter("json")(d).first().content) == {"page_index": 0, "page_label": "page_0001", "markdown": "t", "status": "complete", "engine_outputs": {"marker": {"text": "é", "error": None}}}
    assert "<alto" in formatter("alto")(d).first().content and "ocr_page" in formatter("hocr")(d).first().content
    with pytest.raises(ConfigError):
        formatter("docx")


def test_retry():
    calls, waits = [], []

    def fails(n):
        calls.append(1)
        if len(calls) <= n:
            raise OSError("x")
        return "ok"

    assert services.with_retry(lambda: fails(2), sleep=waits.append) == ("ok", 2) and waits == [0.5, 1.0]
    calls.clear()
    with pytest.raises(OSError):
        services.with_retry(lambda: fails(9), sleep=waits.append)
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(ZeroDivisionError):
        services.with_retry(lambda: calls.append(1) or 1 / 0)
    assert len(calls) == 1
    with pytest.raises(ConfigError):
        services.recognizers(["nobody"], {})
    assert [e.engine_name for e in services.recognizers(["a"], {"a": lambda: services.StubRecognizer("a")})] == ["a"]


def test_merge_falls_back(spark):
    class Poor:
        def merge(self, image, message, prompt, model):
            if model == "broken":
                raise MergeError("down")
            return ("[illegible]" * 4 if model == "first" else "good"), "{}", model, 0.25

    d = spark.createDataFrame([("m", "first", ""), ("m", "broken", "")], "message string, model string, marker_text string")
    got = {r.model: r for r in services.merge(d, Poor(), [], "p", "second", services.poor_answer).collect()}
    assert (got["first"].merged_text, got["first"].model_used, got["first"].merge_cost) == ("good", "second", 0.5)
    assert (got["broken"].merged_text, got["broken"].merge_error) == (None, "down")


def test_resolver(spark):
    ids = spark.createDataFrame([("10.1",), ("10.1",), ("",), (None,), ("10.2",)], "doi string")
    got = services.resolve(ids, "doi", services.StubResolver((("10.1", "{}"),))).collect()
    assert {(r.doi, r.body) for r in got} == {("10.1", "{}"), ("10.2", "")}


def test_settings(tmp_path):
    y = tmp_path / "c.yaml"
    y.write_text("engines: [marker, mathpix]\nvlm:\n  enabled: false\n  model: m\nretry:\n  max_retries: 5\npostprocess:\n  steps: [dehyphenate]\nbudget_cap_usd: 2\npdf_concurrency: 9\nunknown: 1\n")
    c = settings.from_yaml(str(y))
    assert (c.engines, c.vlm_enabled, c.vlm_model, c.max_retries, c.postprocess_steps, c.budget_cap_usd, c.file_concurrency) == (("marker", "mathpix"), False, "m", 5, ("dehyphenate",), 2.0, 9)
    c = settings.from_env(c, {"PALIMPSEST_ENGINES": "a, b", "PALIMPSEST_VLM_ENABLED": "true", "PALIMPSEST_BUDGET_CAP_USD": ""})
    assert (c.engines, c.vlm_enabled, c.budget_cap_usd) == (("a", "b"), True, None)
    args = cli.parser().parse_args(["-i", "in", "-o", "out", "-c", str(y), "--profile", "academic", "--langs", "fr", "--no-postprocess", "--budget", "7", "--input-extensions", ".pdf,txt"])
    c = cli.build_config(args)
    assert (c.input_dir, c.engines, c.languages, c.postprocess_enabled, c.budget_cap_usd, c.profile, c.input_extensions) == ("in", ("marker", "mathpix"), ("fr",), False, 7.0, "academic", ("pdf", "txt"))
    with pytest.raises(ConfigError):
        settings.with_values(settings.Config(), {"render_dpi": "many"})
    (tmp_path / "p.yaml").write_text("name: mine\nsystem_prompt: x\n")
    (tmp_path / "q.yaml").write_text("name: broken\n")
    mine = settings.load_profiles(str(tmp_path))
    assert list(mine) == ["mine"] and settings.profile("mine", mine).suggested_engines == ("marker",) and settings.profile("nobody").name == "general"
    assert settings.profile_names(mine) == sorted([*dims.PROFILES, "mine"])


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("Plain text¬\nhere")
    (src / "b.html").write_text("<title>Web</title><p>page</p>")
    (src / "b.html.meta.yaml").write_text("language: en\n")
    (src / "s.cbz").write_bytes(_comic())
    (src / "bad.docx").write_bytes(b"no zip")
    return src, tmp_path / "out"


def _comic():
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k in range(3):
            z.writestr(f"{k}.png", "x")
    return b.getvalue()


def test_run(spark, folder):
    src, out = folder
    c = settings.with_values(settings.Config(), {"input_dir": str(src), "output_dir": str(out), "input_extensions": "txt,html,cbz,docx", "output_formats": "markdown,alto", "engines": "marker,mathpix"})
    engines = [services.StubRecognizer("marker", "scan number {index}", fails_on=(2,), confidence=0.8), services.StubRecognizer("mathpix", "totally different words {index}", fails_on=(2,))]
    stats = Pipeline(spark, c, engines, services.StubMerger("merged by model", cost=0.01)).run()
    assert (stats["pages_processed"], stats["pages_complete"], stats["pages_failed"]) == (6, 4, 2)
    pages = {(r.path.rsplit("/", 1)[1], r.page_index): r for r in store.pages_table(spark, str(out)).read().collect()}
    assert (pages["a.txt", 0].status, pages["a.txt", 0].text, pages["a.txt", 0].estimated_cost) == ("extracted", "Plain text¬\nhere", 0.0)
    assert pages["b.html", 0].text.startswith('<!-- doc:" Web"')
    assert (pages["s.cbz", 0].status, pages["s.cbz", 0].merge_strategy, pages["s.cbz", 0].estimated_cost, pages["s.cbz", 0].confidence) == ("complete", "vlm", pytest.approx(0.015), 0.8)
    assert "merged by model" in pages["s.cbz", 1].text
    assert (pages["s.cbz", 2].status, pages["s.cbz", 2].error) == ("failed", "All OCR engines failed")
    assert pages["bad.docx", 0].error.startswith("BadZipFile")
    docs = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(f"{out}/documents").collect()}
    assert set(docs) == {"a.txt", "b.html", "s.cbz"} and "language: \"en\"" in docs["b.html"].document and docs["s.cbz"].n_pages == 2
    assert spark.read.parquet(f"{out}/formats/alto").count() == 6
    # a second run finds nothing new but the failures
    again = Pipeline(spark, c, engines)
    assert {r.path.rsplit("/", 1)[1] for r in again.pending(again.discover()).select("path").collect()} == {"s.cbz", "bad.docx"}
    assert again.collection().count() == 3
    assert tools.status(spark, str(out)).first().pages_complete == 4


def test_run_within_budget(spark, folder):
    src, out = folder
    c = settings.with_values(settings.Config(), {"input_dir": str(src), "output_dir": str(out), "input_extensions": "cbz", "budget_cap_usd": 0.00015})
    engines = [services.StubRecognizer("tesseract", "one {index}"), services.StubRecognizer("marker", "something else {index}")]
    Pipeline(spark, c, engines, services.StubMerger("merged")).run()
    got = sorted((r.page_index, r.merge_strategy) for r in store.pages_table(spark, str(out)).read().collect())
    assert got == [(0, "vlm"), (1, "pick_best"), (2, "pick_best")]


def test_files_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.md", "X"), ("y.md", None)], "name string, content string")
    assert write_text_files(rows, str(tmp_path)).count() == 2
    assert (tmp_path / "a" / "x.md").read_text() == "X" and (tmp_path / "y.md").read_text() == "" and not list(tmp_path.rglob("*.tmp"))


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    args = (spark, str(src), str(tmp_path / "pages"), str(tmp_path / "cp"))
    assert [r.text for r in ingest.ingest(*args).collect()] == ["one"]
    (src / "b.html").write_text("<p>two</p>")
    assert sorted(r.text for r in ingest.ingest(*args).collect()) == ["one", "two"]


def test_streaming_ingest_takes_all_pages(spark, sf_dir, monkeypatch):
    """Every web page as a file, over several micro-batches, parsed as without a stream."""
    real, checkpoints = ingest.ingest, []
    monkeypatch.setattr(ingest, "ingest", lambda *args: checkpoints.append(args[3]) or real(*args))
    got = sorted(tuple(r) for r in catalogue.QUERIES["streaming_ingest"](spark, sf_dir).collect())
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    raw = raw.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.length("content").cast("long").alias("length"), "content")
    want = reader.pages(files.detect(raw)).select(F.regexp_extract("path", r"(\d+)[.]html", 1).cast("long"), "page_index", F.length("text"), F.sha2("text", 256))
    assert got == sorted(tuple(r) for r in want.collect()) and len({r[0] for r in got}) == raw.count() >= 50
    assert len([p for p in Path(checkpoints[0].removeprefix("file:"), "commits").iterdir() if p.name.isdigit()]) >= 4


def test_tools(spark, folder, capsys):
    src, out = folder
    assert tools.formats(spark).count() == len(dims.ENDINGS) and tools.profiles(spark).count() == 8 and tools.languages(spark).count() == 53
    assert tools.languages(spark, "marker").count() == 43
    with pytest.raises(ConfigError):
        tools.languages(spark, "nobody")
    assert tools.unknown_languages(["en", "Irish", "qq"]) == ["unknown language code 'Irish'; did you mean 'gle' (Irish (Gaeilge))?", "unknown language code 'qq'"]
    assert [r.available for r in tools.engines(spark, {"marker"}).filter("engine = 'marker'").collect()] == [True]
    assert tools.detect(spark, str(src / "b.html")).first().format == "html"
    assert tools.page(spark, str(src / "a.txt"), 0).first().text.startswith("Plain")
    assert tools.document_metadata(spark, str(src / "b.html")).first().title == "Web"
    c = settings.with_values(settings.Config(), {"input_dir": str(src), "output_dir": str(out), "input_extensions": "txt"})
    assert tools.process(spark, c).first().n_pages == 1
    lines = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "b", 1.0), (1, 51, "c", 0.0)], "page int, line_no int, text string, confidence double")
    assert tools.handwriting_lines(lines, ["page"]).first().asDict() == {"page": 1, "text": "a\nb", "confidence": 0.75}
    profiles = language.learn(spark.createDataFrame([("en", "the cat and the dog in the house"), ("fr", "le chat et le chien dans la maison")], "lang string, text string"))
    assert tools.transcript(spark.createDataFrame([("p", "the dog and the cat of the house")], "path string, text string"), profiles).first().language == "en"
    for flags in (["--list-profiles"], ["--list-engines"], ["--list-languages"], ["--list-languages-for", "marker"], ["-i", str(src), "-o", str(out), "--dry-run", "--input-extensions", "txt"]):
        assert cli.main(flags, spark) == 0
    assert "a.txt" in capsys.readouterr().out
