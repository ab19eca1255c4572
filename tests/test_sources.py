"""Every reader on small inputs made here, and on broken ones."""

import gzip
import io
import json
import struct
import tarfile
import zipfile

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest import catalogue
from palimpsest.formats import pages as formats
from palimpsest.plans import readers
from palimpsest.sources import files, latex, parse_text, reader
from palimpsest.sources import parse_python as P

from .oracle import same_rows


def zipped(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in members.items():
            z.writestr(n.replace("__", "/").replace("_dot_", "."), t)
    return b.getvalue()


def zip_of(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in members.items():
            z.writestr(n, t)
    return b.getvalue()


def text_of(kind, raw, name):
    pages, meta = P.PARSERS[kind](raw if isinstance(raw, bytes) else raw.encode(), name)
    return pages, meta


def test_html():
    page = """<html><head><title> T &amp; U </title><meta name="citation_title" content="C"><meta name="dc.publisher" content="Pub"><meta property="og:title" content="O">
    <script type="application/ld+json">[{"@type": "ScholarlyArticle", "headline": "L", "author": [{"name": "A"}], "datePublished": "2024"}]</script></head><body><!-- no --><p>x &lt; y</p><script>var s;</script></body></html>"""
    pages, m = text_of("html", page, "a.html")
    assert (m["title"], m["authors"], m["date"], m["publisher"]) == ("L", ["A"], "2024", "Pub")
    assert "x < y" in pages[0] and "var s;" in pages[0] and "no" not in pages[0].split()
    assert text_of("html", "<title>only</title>", "a.html")[1]["title"] == "only"
    assert text_of("html", '<meta name="citation_title" content="C"><meta property="og:title" content="O">', "a")[1]["title"] == "C"


def test_latex():
    src = r"\title{The Big One}\author{A. B.}\begin{abstract}An \emph{abstract}.\end{abstract}\begin{document}Hello \textbf{world}. % gone" + "\n" + r"50\% kept\section{S}\end{document}"
    pages, m = text_of("latex", src, "arxiv1.tex")
    assert (m["title"], m["authors"], m["abstract"], m["document_type"]) == ("The Big One", ["A. B."], "An abstract.", "preprint")
    assert "world" in pages[0] and "gone" not in pages[0] and "\\textbf" not in pages[0] and "S" in pages[0]
    assert latex.shown(latex.tree(r"\frac{a}{b}")) == "b"
    nested = r"\title{On {\em nested {deep {groups}}} \& signs}\author[x]{A {B}}\begin{document}\section*{S} a\\b \unknown c {d} 5\% % gone {" + "\n" + r"\begin{abstract}In \emph{it}\end{abstract}\end{document} after"
    pages, m = text_of("latex", nested, "a.tex")
    assert (m["title"], m["authors"], m["abstract"]) == ("On nested deep groups & signs", ["A B"], "In it")
    assert pages == ["S a\nb c d 5% \nIn it"]
    assert text_of("latex", "{" * 5000 + "x" + "}" * 5001 + r"\textbf{", "a.tex")[0] == ["x"]


def test_markdown():
    pages, m = text_of("markdown", "---\ntitle: T\nauthor: A\ndate: 2024-01-02\nlang: en\n---\n# Body <!-- c\n -->x", "a.md")
    assert (m["title"], m["authors"], m["date"], m["language"], pages) == ("T", ["A"], "2024-01-02", "en", ["# Body x"])
    pages, m = text_of("markdown", "<!-- doc: title: T2 | author: B -->text", "a.md")
    assert (m["title"], m["authors"], pages) == ("T2", ["B"], ["text"])
    assert text_of("markdown", "---\n: [bad\n---\nbody", "a.md")[0] == ["body"]


def test_json_and_notebook():
    assert json.loads(text_of("json", "{broken\n {\"a\": 1}\n{\"b\": 2}", "a.jsonl")[0][0]) == {"a": 1}
    assert json.loads(text_of("json", "no json at all", "a.json")[0][0]) == "no json at all"
    m = text_of("json", json.dumps({"@context": "https://schema.org", "x": [{"@context": "schema.org", "name": "N", "creator": "C"}]}), "a.json")[1]
    assert (m["title"], m["authors"], m["document_type"]) == ("N", ["C"], "json-ld")
    assert len(P.parse_jsonl_records(b'{"a": 1}\nbad\n{"b": 2}', "a.jsonl")[0]) == 2
    nb = {"metadata": {"title": "NB", "language_info": {"name": "python"}}, "cells": [
        {"cell_type": "markdown", "source": ["# H\n", "t"]}, {"cell_type": "raw", "source": "r"},
        {"cell_type": "code", "source": "1+1", "outputs": [{"output_type": "stream", "text": ["out\n"]}, {"output_type": "execute_result", "data": {"text/plain": ["2"]}}]},
    ]}
    pages, m = text_of("notebook", json.dumps(nb), "a.ipynb")
    assert pages == ["# H\nt\n\nr\n\n```python\n1+1\n```\n\n```\nout\n```\n\n2"] and m["title"] == "NB"


def test_tables():
    assert text_of("csv", "a;b\n1;2;3\n4\n", "a.csv")[0] == ["| a | b |\n| --- | --- |\n| 1 | 2 |\n| 4 |  |"]
    assert text_of("csv", "a\tb\n1\t2\n", "a.tsv")[0] == ["| a | b |\n| --- | --- |\n| 1 | 2 |"]
    assert text_of("csv", b"n\xe4me,x\n1,2\n", "a.csv")[0][0].startswith("| n")
    assert text_of("csv", "", "a.csv")[0] == [""]
    assert text_of("csv", 'a,b\r\n"x\r\ny","p ""q"", r"\r\n', "a.csv")[0] == ['| a | b |\n| --- | --- |\n| x y | p "q", r |']
    wb = '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="i1"/><sheet name="S2" r:id="i2"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="i1" Target="worksheets/s1.xml"/><Relationship Id="i2" Target="/xl/worksheets/s2.xml"/></Relationships>'
    s1 = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="B2"><v>1.5</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    x = zip_of({"xl/workbook.xml": wb, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/s1.xml": s1, "xl/worksheets/s2.xml": "<worksheet/>", "xl/sharedStrings.xml": "<sst><si><t>sh</t></si></sst>"})
    assert text_of("excel", x, "a.xlsx")[0] == ["# S1\n\n| sh |  |  |\n| --- | --- | --- |\n|  | 1.5 | in |", "# S2\n\n(empty sheet)"]


W = 'xmlns:w="w"'


def test_office():
    doc = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>one</w:t><w:br w:type="page"/><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>'
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    assert text_of("docx", zip_of({"word/document.xml": doc, "word/styles.xml": styles}), "a.docx")[0] == ["# Head\n\none", "two"]
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Title</a:t></a:r></a:p><a:p/><a:p><a:r><a:t>bu</a:t></a:r><a:r><a:t>llet</a:t></a:r></a:p></p:sld>'
    notes = '<p:notes xmlns:p="p" xmlns:a="a"><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><a:p><a:r><a:t>say this</a:t></a:r></a:p></p:sp></p:notes>'
    rels = '<Relationships><Relationship Type="x/notesSlide" Target="../notesSlides/n1.xml"/></Relationships>'
    pages = text_of("pptx", zip_of({"ppt/slides/slide2.xml": slide, "ppt/slides/slide10.xml": slide, "ppt/slides/_rels/slide2.xml.rels": rels, "ppt/notesSlides/n1.xml": notes}), "a.pptx")[0]
    assert pages == ["## Slide 1\n\nTitle\nbullet\n\n**Notes:** say this", "## Slide 2\n\nTitle\nbullet"]
    t = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    content = f'<o:c xmlns:o="o" xmlns:text="{t}"><text:h>Head</text:h><text:p>a <text:span>b</text:span> c</text:p></o:c>'
    meta = '<m xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:creator>A</dc:creator></m>'
    pages, m = text_of("odt", zip_of({"content.xml": content, "meta.xml": meta}), "a.odt")
    assert pages == ["Head\n\na\n\nc"] and (m["title"], m["authors"]) == ("T", ["A"])
    pages, m = text_of("pages", zip_of({"index.xml": '<d xmlns:sf="sf"><sf:text-storage>Some <sf:b>text</sf:b></sf:text-storage></d>'}), "a.pages")
    assert pages == ["Some text"] and m["title"] == "a" and text_of("pages", b"old", "a.pages")[0][0].startswith("[Legacy")


def test_books():
    opf = '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:language>en</dc:language><dc:identifier>urn:isbn:123</dc:identifier></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>'
    book = {"META-INF/container.xml": '<c><rootfile full-path="O/c.opf"/></c>', "O/c.opf": opf, "O/a.xhtml": "<p>first &amp; last</p>", "O/b.xhtml": b"<p>caf\xe9</p>"}
    pages, m = text_of("epub", zip_of(book), "a.epub")
    assert pages == ["café", "first & last"] and (m["title"], m["authors"], m["isbn"], m["extra"]["has_drm"]) == ("T", ["A", "B"], "123", "false")
    assert text_of("epub", zip_of(book | {"META-INF/rights.xml": "x"}), "a.epub")[1]["extra"]["has_drm"] == "true"
    fb = '<FictionBook xmlns="f"><description><title-info><genre>g1</genre><author><first-name>A</first-name><last-name>B</last-name></author><book-title>T</book-title><lang>en</lang></title-info><publish-info><isbn>9</isbn><year>1999</year></publish-info></description><body><section><title><p>Head</p></title><p>one</p><section><p>two</p></section></section></body><body name="notes"><section id="n1"><p>note</p></section></body></FictionBook>'
    pages, m = text_of("fb2", fb, "a.fb2")
    assert pages == ["### Head\n\none\n\ntwo\n\n## notes\n\n[n1] note"] and (m["title"], m["authors"], m["isbn"], m["date"]) == ("T", ["A B"], "9", "1999")
    assert text_of("comic", zip_of({"b.PNG": "x", "a.jpg": "x", "c.txt": "x"}), "c.cbz")[0] == ["", ""]


def test_xml():
    tei = '<TEI xmlns="t"><teiHeader><title>T</title><author><persName><forename>A</forename><surname>B</surname></persName></author><publisher>P</publisher><date>1900</date><language ident="la"/></teiHeader><text><body><head>H</head><p>one<lb/>two</p></body></text></TEI>'
    pages, m = text_of("tei", tei, "a.tei.xml")
    assert pages == ["H\n\none\n\ntwo"] and (m["title"], m["authors"], m["publisher"], m["date"], m["language"]) == ("T", ["A B"], "P", "1900", "la")
    svg = '<svg xmlns="http://www.w3.org/2000/svg"><title>T</title><text>a<tspan>b</tspan> c</text></svg>'
    assert text_of("svg", svg, "a.svg") == (["a c\nb"], {"title": "T", "document_type": "vector-graphic", "extraction_method": "svg-parsing"})
    assert text_of("svg", gzip.compress(svg.encode()), "a.svgz")[0] == ["a c\nb"]
    bomb = '<!DOCTYPE x [<!ENTITY e "boom">]><x>&e;</x>'
    for raw in (bomb, "<!--" + "c" * 70_000 + "-->" + bomb, '<?xml version="1.0" encoding="UTF-16"?>'.encode("utf-16") + bomb.encode("utf-16-le"), '<!DOCTYPE x [<!ENTITY % p "q">]><x/>'):
        with pytest.raises(ValueError, match="entity"):
            text_of("tei", raw, "a.tei")


def test_mail_and_records():
    eml = "From: a@x\nTo: b@x\nDate: today\nSubject: Hi\nContent-Type: multipart/alternative; boundary=B\n\n--B\nContent-Type: text/plain\n\nplain one\n--B\nContent-Type: text/html\n\n<b>no</b>\n--B--\n"
    pages, m = text_of("email", eml, "a.eml")
    assert m["title"] == "Hi" and m["authors"] == ["a@x"] and "plain one" in pages[0] and "<b>" not in pages[0]
    box = "From x Mon\nFrom: a\nSubject: 1\n\nbody1\n\nFrom y Tue\nFrom: b\nSubject: 2\n\nbody2\n>From quoted\n"
    pages, m = text_of("email", box, "a.mbox")
    assert len(pages) == 2 and "body2\nFrom quoted" in pages[1] and m["title"] == "1"

    def field(subs):
        return b"10" + b"".join(b"\x1f" + c.encode() + v.encode() for c, v in subs) + b"\x1e"

    fields = [("020", field([("a", "9780306406157 (pbk)")])), ("100", field([("a", "Doe, J.")])), ("245", field([("a", "Title :"), ("b", "sub")])), ("260", field([("b", "Pub"), ("c", "c1999.")])), ("500", field([("a", "A note")])), ("650", field([("a", "Topic")]))]
    directory, data = b"", b""
    for tag, f in fields:
        directory += tag.encode() + b"%04d%05d" % (len(f), len(data))
        data += f
    base = 24 + len(directory) + 1
    record = b"%05d" % (base + len(data) + 1) + b"nam a22" + b"%05d" % base + b" a 4500" + directory + b"\x1e" + data + b"\x1d"
    pages, m = text_of("marc", record * 2, "a.mrc")
    assert len(pages) == 2 and (m["title"], m["authors"], m["isbn"], m["date"], m["keywords"]) == ("Title : sub", ["Doe, J."], "9780306406157", "1999", ["Topic"])
    assert "Publisher: Pub, 1999" in pages[0] and "Notes: A note" in pages[0]
    xml = '<collection><record><datafield tag="245"><subfield code="a">X</subfield></datafield></record></collection>'
    assert text_of("marc", xml, "a.xml")[1]["title"] == "X"
    rtf = r"{\rtf1{\fonttbl{\f0 Arial;}}Hello {\b bold}\par caf\'e9 " + chr(92) + "u8364?}"
    assert text_of("rtf", rtf, "a.rtf")[0] == ["Hello bold\ncafé €"]


def test_archives_maps_images():
    pages, m = text_of("archive", zip_of({"b.txt": "x", "docs/README.md": "read me", "../readme": "evil"}), "a.zip")
    assert "Files: 3" in pages[0] and "read me" in pages[0] and "evil" not in pages[0] and m["extra"]["file_count"] == "3"
    many = text_of("archive", zip_of({f"f{k:04d}": "" for k in range(510)}), "a.zip")[0][0]
    assert "... and 10 more files" in many
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as t:
        i = tarfile.TarInfo("readme.txt")
        i.size = 2
        t.addfile(i, io.BytesIO(b"hi"))
    assert "hi" in text_of("archive", b.getvalue(), "a.tgz")[0][0]
    assert "Compressed file: a.txt" in text_of("archive", gzip.compress(b"x"), "a.txt.gz")[0][0]
    assert P.decompress(gzip.compress(b"x"), "a.gz") == b"x"
    g = {"type": "FeatureCollection", "features": [{"geometry": {"type": "Point"}, "properties": {"b": 1, "a": 2}}, {"geometry": None, "properties": None}]}
    pages, m = text_of("gis", json.dumps(g), "m.geojson")
    assert "- **geometry_types**: Point, Unknown" in pages[0] and "- **properties_keys**: a, b" in pages[0] and m["title"] == "m"
    shp = bytes(32) + struct.pack("<i4d", 1, 0, 0, 2, 3) + bytes(32) + struct.pack(">ii", 1, 10) + bytes(20)
    assert "- **feature_count**: 1" in text_of("gis", shp, "m.shp")[0][0]
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 0) + struct.pack("<I", 14) + struct.pack("<H", 0) + struct.pack("<I", 0)
    assert text_of("image", tiff, "a.tif")[0] == ["", ""] and text_of("image", b"\x89PNG", "a.png")[0] == [""]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_native_formats(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\n42\n\n\n3\n00:00:05.000 --> 00:00:06.000\nend"
    assert one(spark, parse_text.srt(F.col("x")), srt) == "Hello there\nend"
    vtt = "WEBVTT\nnot this\n\nNOTE x\n00:00:01.000 --> 00:00:02.000\n<b>Hi</b>\n7\n\nSTYLE\nyou"
    assert one(spark, parse_text.vtt(F.col("x")), vtt) == "Hi\nyou"
    dxf = "0\nSECTION\n2\nHEADER\n1\nno\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nTEXT\n8\nlayer\n1\nfirst\n0\nLINE\n1\nno\n0\nMTEXT\n1\nsecond\n0\nENDSEC\n0\nSECTION\n1\nno\n0\nEOF\n"
    assert one(spark, parse_text.dxf(F.col("x")), dxf) == "first\n\nsecond"
    assert one(spark, parse_text.strip_tags(F.col("x")), "<p>a<br>b</p>\n\n c") == "a b c"
    assert one(spark, parse_text.json_first_valid(F.col("x")), '{bad\n{"a": 1}\n{}') == '{"a": 1}'
    g = '{"type": "FeatureCollection", "features": [{"geometry": {"type": "Point"}, "properties": {"b": 1}}, {"properties": {"a": 1}}]}'
    r = one(spark, parse_text.geojson_summary(F.col("x")), g)
    assert (r.feature_count, r.geometry_types, r.properties_keys) == (2, ["Point", "Unknown"], ["a", "b"])
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1")), F.array(F.lit("2"), F.lit("3"), F.lit("4")))
    assert one(spark, parse_text.markdown_table(rows), "") == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"


def test_detection(spark):
    rows = [("a/b.PDF", b""), ("x.tei.xml", b""), ("x.xml", b"<x/>"), ("noext", b"%PDF-1.4"), ("d.x/noext", b"\x89PNG\r\n\x1a\n"), ("z", zip_of({"word/document.xml": "x"})), ("e", zip_of({"mimetype": "application/epub+zip"})), ("bin", b"\x00\x01\x02"), ("empty", b"")]
    d = files.detect(spark.createDataFrame(rows, "path string, content binary"))
    got = {r.path: r.format for r in d.collect()}
    assert got == {"a/b.PDF": "pdf", "x.tei.xml": "tei", "x.xml": "txt", "noext": "pdf", "d.x/noext": "image", "z": "docx", "e": "epub", "bin": None, "empty": None}
    with pytest.raises(Exception, match="Unsupported file type for bin"):
        files.detect(spark.createDataFrame(rows[-2:-1], "path string, content binary"), strict=True).collect()
    v = spark.createDataFrame([(2000.0,), (2000.1,), (500.0,), (500.1,), (None,)], "m double").select(files.size_verdict(F.col("m"))).collect()
    assert [r[0] for r in v] == ["large", "refused", "ok", "large", "ok"]
    drm = [(".kfx", b"BOOKMOBI"), (".azw", b"xxEBOKxx"), (".azw3", b"secret"), (".mobi", b"?"), (".azw", b"x" * 300 + b"EBOK")]
    got = spark.createDataFrame(drm, "e string, c binary").select(files.ebook_drm(F.col("e"), F.col("c"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, True]


BROKEN = [b"", b"\x00\x01\xfe\xff" * 50, b"PK\x03\x04 cut", b"<a><b>", b"{" * 100, b"x" * 100_000, b"\xff\xfe\x00"]


@pytest.mark.parametrize("kind", sorted(P.PARSERS))
def test_broken_files_are_rows(spark, kind):
    rows = [(f"f{k}.{kind}", kind, b) for k, b in enumerate(BROKEN)]
    got = reader.parsed_pages(spark.createDataFrame(rows, "path string, format string, content binary")).collect()
    assert {r.path for r in got} == {r[0] for r in rows}
    assert all((r.error is None) == (r.page_count > 0) or r.page_count == 0 for r in got)


def test_read_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("hello\fworld")
    (tmp_path / "b.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHi")
    (tmp_path / "c.html").write_text("<title>T</title><p>x</p>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "c.html.meta.yaml").write_text("title: S\nauthor: Me\nkeywords: a, b\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in reader.read_folder(spark, str(tmp_path), ["txt", ".srt", "html", "pdf"]).collect()}
    assert set(got) == {"a.txt", "b.srt", "c.html", "d.pdf"}
    assert got["a.txt"].text == "hello\fworld" and got["b.srt"].text == "Hi" and got["c.html"].metadata.title == "T"
    assert got["d.pdf"].error == "ValueError: the PDF file has no pages"
    more = reader.read_folder(spark, str(tmp_path), ["pdf"], {"pdf": lambda raw, name: (["p1", "p2", "p3", "p4"], {"title": name})}, test_mode=True).collect()
    assert sorted(r.page_label for r in more) == ["page_0001", "page_0002", "page_0003"] and more[0].page_count == 4
    s = reader.sidecars(spark, str(tmp_path)).first()
    assert (s.title, s.authors, s.keywords) == ("S", ["Me"], ["a", "b"])
    assert [r.size_mb for r in files.listing(files.scan(spark, str(tmp_path), ["txt"])).collect()] == [0.0]
    plan = files.scan(spark, str(tmp_path)).select("path")._jdf.queryExecution().toString()
    assert "PushedFilters: [LessThanOrEqual(length" in plan or "LessThanOrEqual(length" in plan


def test_records_probes_images(spark):
    from palimpsest.sources import extras

    tei = """<TEI xmlns="t"><teiHeader><titleStmt><title>Whole</title></titleStmt><sourceDesc><biblStruct><author><persName><forename>A</forename><surname>B</surname></persName></author>
    <monogr><title>J</title><imprint><biblScope unit="volume">3</biblScope><date type="published" when="2020-05-01"/></imprint></monogr><idno type="DOI">10.1/x</idno></biblStruct></sourceDesc>
    <profileDesc><abstract><p>Abs</p></abstract><textClass><keywords><term>k1</term><term>k2</term></keywords></textClass></profileDesc></teiHeader>
    <text><listBibl><biblStruct><analytic><title>R</title><author>C D</author></analytic><monogr><title>RJ</title><imprint><date>1999</date></imprint></monogr><note>raw text</note></biblStruct><biblStruct/></listBibl></text></TEI>"""
    d = spark.createDataFrame([(1, tei), (2, "broken <"), (3, None)], "id int, xml string")
    h = {r.id: r for r in extras.headers(d, "id").collect()}
    assert (h[1].title, h[1].authors, h[1].journal, h[1].volume, h[1].year, h[1].doi, h[1].abstract, h[1].keywords) == ("Whole", ["A B"], "J", "3", "2020", "10.1/x", "Abs", ["k1", "k2"])
    assert h[2].title == "" and h[3].authors == []
    r = extras.references(d, "id").collect()
    assert [(x.id, x.title, x.authors, x.journal, x.year, x.raw) for x in r] == [(1, "R", ["C D"], "RJ", "1999", "raw text")]
    probe = '{"format": {"format_name": "mp3", "duration": "9.5"}, "streams": [{"codec_type": "audio", "codec_name": "mp3", "channels": 2}, {"codec_type": "video", "codec_name": "h264", "width": 10, "height": 20}]}'
    text = spark.createDataFrame([("a.mp3", "audio", probe)], "n string, k string, p string").select(extras.media_summary(F.col("n"), F.col("k"), F.col("p"))).first()[0]
    assert text.startswith("# Audio: a.mp3\n\n**Format**: mp3\n**Duration**: 9.5s\n**Bitrate**: unknown") and text.endswith("- Stream 0: audio (mp3), 2 ch\n- Stream 1: video (h264), 10x20")
    z = zip_of({"w/a.JPEG": "x" * 200, "w/copy.png": "x" * 200, "w/tiny.png": "x", "w/t.txt": "x" * 200})
    files_ = spark.createDataFrame([("d.docx", "docx", z), ("bad", "docx", b"no")], "path string, format string, content binary")
    got = extras.embedded_images(files_).collect()
    assert [(i.path, i.name, i.ext) for i in got] == [("d.docx", "w_a.JPEG", "jpg")]


def test_title_cut_within_a_reference():
    title = lambda x: P.parse_html(f"<title>{x}</title><p>x".encode(), "x.html")[1]["title"]
    assert title("a &amp;&quot; b&amp") == 'a &" b&amp'
    assert [title(x) for x in ("&copy 20 &lt;", "a&b ", " a&amp; ")] == ["© 20 <", "a&b", "a&"]


def test_files_are_built_a_few_at_once():
    whole = pa.RecordBatch.from_pydict({"conv_id": list(range(1000)), "turns": [["t"]] * 1000})
    out = list(readers.built([whole], lambda n, t: f"{n} {t[0]}".encode(), ".x"))
    assert max(b.num_rows for b in out) <= 64
    assert [(r["path"], r["content"]) for b in out for r in b.to_pylist()] == [(f"in/c{n}.x", f"{n} t".encode()) for n in range(1000)]


def test_batches_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        reader.bound_batches(spark)
        assert int(spark.conf.get(key)) <= 4 << 20
        spark.conf.unset(key)
        formats.alto(spark.createDataFrame([(0, "p", "t")], "page_index int, page_label string, text string"))
        assert int(spark.conf.get(key)) <= 4 << 20
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_text_cut_within_a_reference():
    text = lambda x: P.parse_html(x.encode(), "x.html")[0][0]
    assert text("<title>a &quot</title><h1>b &lt </h1><!-- &quot --><p title='&lt'>c &amp</p>&copy; d &#3") == "a &quotb &lt c &© d &#3"
    assert text("<p>a &quot;b &copy 20</p><script>x = '&lt</p>' + y &lt</script>") == "a \"b © 20x = '&lt</p>' + y &lt"
    assert P.parse_html(b"<title>a &quot</title>", "x.html")[1]["title"] == "a &quot"


def test_page_with_cut_references_as_in_sql(spark, tmp_path):
    html = ["<html><head><title>t = &quot</title><style>p{margin:0}</style></head><body><h1>t = &quot</h1><p>&amp;quot; &quot;x&quot; &lt</p><p>&gt</p></body></html>", "<title>a &lt;b&amp</title><p>c &quo</p>", "<title>a</title><p>b &gt"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_text_content", "streaming_ingest"):
        same_rows(catalogue.QUERIES[name](spark, str(tmp_path)), con, catalogue.ORACLES[name])
