"""One query for each reader: conversations written as files of its format, detected and read back.

A conversation is a file, its turns are paragraphs, pages, sheets, slides, cells or members. The turns'
texts are letters of all scripts, digits, commas and points, so that every format can hold them; the SQL says what
the reader must give: (conv_id, page_index, text, title, n_pages).
"""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, reader
from .inputs import read

QUERIES: dict = {}
ORACLES: dict = {}

_FILES = 64  # files that are built at once
_KEPT = r"[^\p{L}0-9.,]+"
_TURNS = rf"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '{_KEPT}', ' ', 'g')) AS t FROM conversations),
k AS (SELECT conv_id, t, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS n, 'Conversation ' || conv_id AS name FROM c WHERE t <> '')
"""


def one_page(text: str, title: str = "''") -> str:
    """SQL of a format of one page: ``text`` gathers the turns."""
    return f"{_TURNS} SELECT conv_id, 0 AS page_index, {text} AS text, {title} AS title, 1 AS n_pages FROM k GROUP BY conv_id, name"


def page_a_turn(text: str, title: str = "''") -> str:
    return f"{_TURNS} SELECT conv_id, i AS page_index, {text} AS text, {title} AS title, n AS n_pages FROM k"


def lines(between: str, turn: str = "t") -> str:
    return f"string_agg({turn}, {between} ORDER BY i)"


_BREAK, _GAP = "chr(10)", "chr(10) || chr(10)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turns)."""
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _KEPT, " "))
    d = read(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t")).filter("t <> ''")
    return d.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]).alias("turns"))


def built(batches, build: Callable[[int, list[str]], bytes], ending: str):
    """Batches of (conv_id, turns) as batches of at most ``_FILES`` files (path, content)."""
    for b in (whole.slice(k, _FILES) for whole in batches for k in range(0, whole.num_rows, _FILES)):
        ids = b["conv_id"].to_pylist()
        made = [build(i, t) for i, t in zip(ids, b["turns"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([f"in/c{i}{ending}" for i in ids]), pa.array(made, pa.binary())], names=["path", "content"])


def reads(ending: str, sql: str) -> Callable:
    """Registers a query that writes files by the decorated function (conv_id, turns) -> bytes and reads them back."""

    def add(build: Callable[[int, list[str]], bytes]) -> Callable:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            reader.bound_batches(spark)
            found = files.detect(turns(spark, sf_dir).mapInArrow(lambda batches: built(batches, build, ending), "path string, content binary"))
            n = F.regexp_extract("path", r"/c(-?\d+)[.]", 1).cast("long")
            return reader.pages(found).select(n.alias("conv_id"), "page_index", F.coalesce("text", "error").alias("text"), F.col("metadata.title").alias("title"), F.col("page_count").alias("n_pages"))

        QUERIES[build.__name__] = query
        ORACLES[build.__name__] = sql
        return build

    return add


def zipped(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


# Office and books


@reads(".docx", page_a_turn("CASE WHEN i = 0 THEN '# ' || name || chr(10) || chr(10) ELSE '' END || t"))
def read_docx(n: int, t: list[str]) -> bytes:
    run = lambda x: f"<w:r><w:t>{escape(x)}</w:t></w:r>"
    head = f'<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr>{run(f"Conversation {n}")}</w:p>'
    body = "".join(f"<w:p>{run(x)}{'<w:r><w:br w:type=\"page\"/></w:r>' if k + 1 < len(t) else ''}</w:p>" for k, x in enumerate(t))
    styles = '<w:styles xmlns:w="w"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{head}{body}</w:body></w:document>', "word/styles.xml": styles})


@reads(".xlsx", page_a_turn("'# Turn ' || i || chr(10) || chr(10) || '| turn | text |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || i || ' | ' || t || ' |'"))
def read_excel(n: int, t: list[str]) -> bytes:
    sheets = "".join(f'<sheet name="Turn {k}" r:id="i{k}"/>' for k in range(len(t)))
    rels = "".join(f'<Relationship Id="i{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(t)))
    text = lambda at, x: f'<c r="{at}" t="s"><v>{x}</v></c>'
    sheet = lambda k: f'<worksheet><sheetData><row r="1">{text("A1", 0)}{text("B1", 1)}</row><row r="2"><c r="A2"><v>{k}</v></c>{text("B2", k + 2)}</row></sheetData></worksheet>'
    strings = "".join(f"<si><t>{escape(x)}</t></si>" for x in ["turn", "text", *t])
    return zipped({"xl/workbook.xml": f'<workbook xmlns:r="r"><sheets>{sheets}</sheets></workbook>', "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>", "xl/sharedStrings.xml": f"<sst>{strings}</sst>", **{f"xl/worksheets/s{k}.xml": sheet(k) for k in range(len(t))}})


@reads(".pptx", page_a_turn("'## Slide ' || (i + 1) || chr(10) || chr(10) || t || CASE WHEN i = 0 THEN chr(10) || chr(10) || '**Notes:** say ' || conv_id ELSE '' END"))
def read_pptx(n: int, t: list[str]) -> bytes:
    slide = lambda x: f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:sld>'
    notes = f'<p:notes xmlns:p="p" xmlns:a="a"><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><a:p><a:r><a:t>say {n}</a:t></a:r></a:p></p:sp></p:notes>'
    rels = '<Relationships><Relationship Type="x/notesSlide" Target="../notesSlides/n1.xml"/></Relationships>'
    return zipped({**{f"ppt/slides/slide{k + 1}.xml": slide(x) for k, x in enumerate(t)}, "ppt/slides/_rels/slide1.xml.rels": rels, "ppt/notesSlides/n1.xml": notes})


@reads(".odt", one_page(lines(_GAP), "name"))
def read_odt(n: int, t: list[str]) -> bytes:
    body = "".join(f"<text:p>{escape(x)}</text:p>" for x in t)
    content = f'<o:c xmlns:o="o" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0">{body}</o:c>'
    return zipped({"content.xml": content, "meta.xml": f'<m xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Conversation {n}</dc:title></m>'})


@reads(".pages", one_page(lines(_GAP), "'c' || conv_id"))
def read_apple_pages(n: int, t: list[str]) -> bytes:
    return zipped({"index.xml": f'<d xmlns:sf="sf">{"".join(f"<sf:text-storage>{escape(x)}</sf:text-storage>" for x in t)}</d>'})


@reads(".epub", page_a_turn("t", "name"))
def read_epub(n: int, t: list[str]) -> bytes:
    items = "".join(f'<item id="i{k}" href="{k}.xhtml"/>' for k in range(len(t)))
    spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(t)))
    opf = f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Conversation {n}</dc:title></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    page = lambda x: f"<html><head><title>no</title><style>p {{}}</style></head><body><p>{escape(x)}</p></body></html>"
    return zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="O/c.opf"/></c>', "O/c.opf": opf, **{f"O/{k}.xhtml": page(x) for k, x in enumerate(t)}})


@reads(".fb2", one_page(f"'### ' || name || {_GAP} || {lines(_GAP)}", "name"))
def read_fb2(n: int, t: list[str]) -> bytes:
    body = "".join(f"<p>{escape(x)}</p>" for x in t)
    return f'<FictionBook xmlns="f"><description><title-info><book-title>Conversation {n}</book-title></title-info></description><body><section><title><p>Conversation {n}</p></title>{body}</section></body></FictionBook>'.encode()


@reads(".rtf", one_page(lines(_BREAK)))
def read_rtf(n: int, t: list[str]) -> bytes:
    units = lambda c: struct.unpack("<" + "h" * (len(c.encode("utf-16-le")) // 2), c.encode("utf-16-le"))
    coded = lambda x: "".join(c if ord(c) < 128 else "".join(f"\\u{u}?" for u in units(c)) for c in x)
    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Times;}}{\\info{\\title no}}" + "\\par ".join(coded(x) for x in t) + "}").encode()


@reads(".pdf", page_a_turn("t"))
def read_pdf(n: int, t: list[str]) -> bytes:
    """Two-byte codes with a ToUnicode map; every second file has its objects in a compressed stream."""
    letters = sorted({c for x in t for c in x})
    code = {c: k + 1 for k, c in enumerate(letters)}
    chars = "\n".join(f"<{code[c]:04x}> <{c.encode('utf-16-be').hex()}>" for c in letters)
    stream = lambda body: b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(z := zlib.compress(body)) + z + b"\nendstream"
    show = lambda x: f"BT /F1 12 Tf 72 700 Td <{''.join(f'{code[c]:04x}' for c in x)}> Tj ET".encode()
    first = 7
    kids = " ".join(f"{first + 2 * k} 0 R" for k in range(len(t)))
    plain = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {len(t)} /Kids [{kids}] /Resources << /Font << /F1 3 0 R >> >> >>".encode(),
        3: b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /ToUnicode 5 0 R /DescendantFonts [4 0 R] >>", 4: b"<< /Type /Font /Subtype /CIDFontType2 /DW 600 >>",
        **{first + 2 * k: f"<< /Type /Page /Parent 2 0 R /Contents {first + 1 + 2 * k} 0 R >>".encode() for k in range(len(t))},
    }
    streams = {5: stream(f"1 begincodespacerange <0000> <ffff> endcodespacerange {len(letters)} beginbfchar\n{chars}\nendbfchar".encode()), **{first + 1 + 2 * k: stream(show(x)) for k, x in enumerate(t)}}
    if n % 2:
        packed, at = [], 0
        for k, body in plain.items():
            packed.append(f"{k} {at}")
            at += len(body) + 1
        head = " ".join(packed).encode() + b" "
        z = zlib.compress(head + b"\n".join(plain.values()))
        streams[6] = b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(plain), len(head), len(z)) + z + b"\nendstream"
        plain = {}
    out, places = bytearray(b"%PDF-1.7\n"), {}
    for k, body in sorted((plain | streams).items()):
        places[k] = len(out)
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    size = first + 2 * len(t)
    if n % 2:
        inside = [1, 2, 3, 4, *range(first, size, 2)]
        rows = b"".join(struct.pack(">BIH", *((1, places[k], 0) if k in places else (2, 6, inside.index(k)) if k in inside else (0, 0, 0))) for k in range(size))
        z, start = zlib.compress(rows), len(out)
        out += b"%d 0 obj\n<< /Type /XRef /W [1 4 2] /Size %d /Root 1 0 R /Length %d /Filter /FlateDecode >>\nstream\n" % (size, size, len(z)) + z + b"\nendstream\nendobj\n"
    else:
        start = len(out)
        table = "".join(f"{places[k]:010d} 00000 n \n" if k in places else "0000000000 65535 f \n" for k in range(size))
        out += f"xref\n0 {size}\n{table}trailer\n<< /Size {size} /Root 1 0 R >>\n".encode()
    return bytes(out + b"startxref\n%d\n%%%%EOF" % start)


# Text and markup


@reads(".txt", one_page(lines(_BREAK)))
def read_txt(n: int, t: list[str]) -> bytes:
    return "\n".join(t).encode()


@reads(".md", one_page(lines(_GAP), "name"))
def read_markdown(n: int, t: list[str]) -> bytes:
    return f"---\ntitle: Conversation {n}\n---\n<!-- not\nshown -->{chr(10).join(x + chr(10) for x in t)}".encode()


@reads(".tex", one_page(f"name || {_GAP} || {lines(_GAP)}", "name"))
def read_latex(n: int, t: list[str]) -> bytes:
    body = "\n\n".join("\\textbf{\\emph{" + x + "}}% a note" if k % 2 else x for k, x in enumerate(t))
    return f"\\documentclass[12pt]{{article}}\\title{{Conversation {{\\em {n}}}}}\\begin{{document}}\\section*{{Conversation {n}}}\n\n{body}\n\\end{{document}}".encode()


@reads(".ipynb", one_page(f"'# ' || name || {_GAP} || {lines(_GAP, 'CASE i % 3 WHEN 0 THEN t WHEN 1 THEN chr(96) || chr(96) || chr(96) || $$python$$ || chr(10) || t || chr(10) || chr(96) || chr(96) || chr(96) || chr(10) || chr(10) || t ELSE t END')}", "name"))
def read_notebook(n: int, t: list[str]) -> bytes:
    cell = lambda k, x: {"cell_type": ("raw", "code", "markdown")[k % 3], "source": [x]} | ({"outputs": [{"output_type": "execute_result", "data": {"text/plain": x}}, {"output_type": "error"}]} if k % 3 == 1 else {})
    return json.dumps({"metadata": {"title": f"Conversation {n}"}, "cells": [{"cell_type": "markdown", "source": f"# Conversation {n}\n"}, *(cell(k, x) for k, x in enumerate(t))]}).encode()


@reads(".json", one_page("""'{' || chr(10) || '  "@context": "https://schema.org",' || chr(10) || '  "name": "' || name || '",' || chr(10) || '  "turns": [' || chr(10) || """ + lines("',' || chr(10)", """'    "' || t || '"'""") + " || chr(10) || '  ]' || chr(10) || '}'", "name"))
def read_json(n: int, t: list[str]) -> bytes:
    return json.dumps({"@context": "https://schema.org", "name": f"Conversation {n}", "turns": t}).encode()


@reads(".jsonl", one_page("""'{' || chr(10) || '  "t": "' || min(t) FILTER (WHERE i = 0) || '"' || chr(10) || '}'"""))
def read_jsonl(n: int, t: list[str]) -> bytes:
    return "\n".join(["{broken", *(json.dumps({"t": x}) for x in t)]).encode()


_TABLE = f"'| turn | text |' || chr(10) || '| --- | --- |' || chr(10) || {lines(_BREAK, chr(39) + '| ' + chr(39) + ' || i || ' + chr(39) + ' | x ' + chr(39) + ' || t || ' + chr(39) + ' |' + chr(39))}"


@reads(".csv", one_page(_TABLE))
def read_csv(n: int, t: list[str]) -> bytes:
    """Cells with commas and line breaks."""
    return "".join(["turn,text\r\n", *(f'{k},"x\n{x}"\r\n' for k, x in enumerate(t))]).encode()


@reads(".tsv", one_page(_TABLE))
def read_tsv(n: int, t: list[str]) -> bytes:
    return "".join(["turn\ttext\n", *(f"{k}\tx {x}\tcut\n" for k, x in enumerate(t))]).encode()


@reads(".vtt", one_page(f"coalesce(string_agg(t, {_BREAK} ORDER BY i) FILTER (WHERE NOT regexp_matches(t, '^[0-9]+$')), '')"))
def read_vtt(n: int, t: list[str]) -> bytes:
    return ("WEBVTT\n\n" + "\n\n".join(f"{k}\n00:00:01.000 --> 00:00:02.000\n<v A>{x}" for k, x in enumerate(t))).encode()


@reads(".html", one_page(f"name || {_BREAK} || {lines(_BREAK)}", "name"))
def read_html(n: int, t: list[str]) -> bytes:
    body = "".join(f"\n<p>{escape(x)}<!-- no --></p>" for x in t)
    return f"<html><head><meta property='og:title' content='no'><title>Conversation {n}</title></head><body>{body}</body></html>".encode()


# XML


@reads(".tei.xml", one_page(lines(_GAP), "name"))
def read_tei(n: int, t: list[str]) -> bytes:
    return f'<TEI xmlns="t"><teiHeader><title>Conversation {n}</title></teiHeader><text><body>{"".join(f"<p>{escape(x)}</p>" for x in t)}</body></text></TEI>'.encode()


@reads(".svg", one_page(lines(_BREAK), "name"))
def read_svg(n: int, t: list[str]) -> bytes:
    return f'<svg xmlns="http://www.w3.org/2000/svg"><title>Conversation {n}</title>{"".join(f"<text>{escape(x)}</text>" for x in t)}</svg>'.encode()


@reads(".dxf", one_page(lines(_GAP)))
def read_dxf(n: int, t: list[str]) -> bytes:
    return "\n".join(["0", "SECTION", "2", "ENTITIES", *(y for x in t for y in ("0", "TEXT", "8", "layer", "1", x, "0", "LINE", "1", "no")), "0", "ENDSEC", "0", "EOF"]).encode()


# Mail and library records

_MAIL = "'From: a@x' || chr(10) || 'To: b@x' || chr(10) || 'Date: today' || chr(10) || 'Subject: ' || name || chr(10) || chr(10) || "


def message(n: int, body: str) -> str:
    return f"From: a@x\nTo: b@x\nDate: today\nSubject: Conversation {n}\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n{body}"


@reads(".eml", one_page(_MAIL + lines(_BREAK), "name"))
def read_email(n: int, t: list[str]) -> bytes:
    return message(n, "\n".join(t)).encode()


@reads(".mbox", page_a_turn(_MAIL + "t || chr(10)", "name"))
def read_mbox(n: int, t: list[str]) -> bytes:
    return "".join(f"From a@x today\n{message(n, '>' + x if x.startswith('From ') else x)}\n" for x in t).encode()


_RECORD = "'Title: ' || t || chr(10) || 'Author: Doe, J.' || chr(10) || 'ISBN: 9780306406157' || chr(10) || 'Publisher: Pub, 1999' || chr(10) || 'LCCN: ' || chr(10) || 'Subjects: One, Two' || chr(10) || 'Physical: '"
_FIELDS = [("020", [("a", "9780306406157 (pbk)")]), ("100", [("a", "Doe, J.")]), ("245", [("a", None)]), ("260", [("b", "Pub"), ("c", "c1999.")]), ("650", [("a", "One")]), ("651", [("a", "Two")])]
_FIRST = "first_value(t) OVER (PARTITION BY conv_id ORDER BY i)"


@reads(".mrc", page_a_turn(_RECORD, _FIRST))
def read_marc(n: int, t: list[str]) -> bytes:
    out = b""
    for x in t:
        directory, data = b"", b""
        for tag, subfields in _FIELDS:
            field = b"10" + b"".join(b"\x1f" + code.encode() + (x if value is None else value).encode() for code, value in subfields) + b"\x1e"
            directory += tag.encode() + b"%04d%05d" % (len(field), len(data))
            data += field
        base = 24 + len(directory) + 1
        out += b"%05d" % (base + len(data) + 1) + b"nam a22" + b"%05d" % base + b" a 4500" + directory + b"\x1e" + data + b"\x1d"
    return out


@reads(".mrc", page_a_turn(_RECORD, _FIRST))
def read_marcxml(n: int, t: list[str]) -> bytes:
    inner = lambda subfields, x: "".join(f'<subfield code="{c}">{escape(x if v is None else v)}</subfield>' for c, v in subfields)
    record = lambda x: "<record>" + "".join(f'<datafield tag="{tag}">{inner(subfields, x)}</datafield>' for tag, subfields in _FIELDS) + "</record>"
    return f'<collection xmlns="m">{"".join(map(record, t))}</collection>'.encode()


# Containers, images, maps


def listing(ending: str) -> str:
    return f"'# Archive: c' || conv_id || '{ending}' || {_GAP} || 'Format: {ending.rsplit('.', 1)[1]}' || chr(10) || 'Files: ' || (count(*) + 1) || {_GAP} || '## Contents' || {_GAP} || '- README.md' || chr(10) || string_agg('- t' || (1000 + i) || '.txt', chr(10) ORDER BY i) || {_GAP} || '## README.md' || {_GAP} || min(t) FILTER (WHERE i = 0)"


@reads(".zip", one_page(listing(".zip"), "'c' || conv_id || '.zip'"))
def read_zip(n: int, t: list[str]) -> bytes:
    return zipped({**{f"t{1000 + k}.txt": x for k, x in enumerate(t)}, "README.md": t[0]})


@reads(".tar.gz", one_page(listing(".tar.gz"), "'c' || conv_id || '.tar.gz'"))
def read_tar(n: int, t: list[str]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as z:
        for name, content in [*((f"t{1000 + k}.txt", x) for k, x in enumerate(t)), ("README.md", t[0])]:
            info = tarfile.TarInfo(name)
            info.size = len(content.encode())
            z.addfile(info, io.BytesIO(content.encode()))
    return out.getvalue()


@reads(".cbz", page_a_turn("''", "'c' || conv_id"))
def read_comic(n: int, t: list[str]) -> bytes:
    return zipped({**{f"{k:04d}.jpg": b"\xff\xd8" + x.encode() for k, x in enumerate(t)}, "info.xml": "no page"})


def tiff(frames: list[bytes]) -> bytes:
    """Frames of one row of grey samples each."""
    out, places = bytearray(b"II*\0\0\0\0\0"), []
    for data in frames:
        at = len(out)
        out += data + b"\0" * (len(data) % 2)
        entries = [(256, len(data)), (257, 1), (258, 8), (259, 1), (262, 1), (273, at), (278, 1), (279, len(data))]
        places.append(len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, 4, 1, v) for tag, v in entries) + b"\0\0\0\0"
    for where, target in zip([4, *(p + 2 + 12 * 8 for p in places)], places, strict=False):
        struct.pack_into("<I", out, where, target)
    return bytes(out)


@reads(".tiff", page_a_turn("''"))
def read_tiff(n: int, t: list[str]) -> bytes:
    return tiff([x.encode() for x in t])


@reads(".geojson", one_page("'# c' || conv_id || '.geojson' || chr(10) || chr(10) || '- **type**: FeatureCollection' || chr(10) || '- **feature_count**: ' || count(*) || chr(10) || '- **crs**: ' || chr(10) || '- **geometry_types**: ' || CASE WHEN count(*) > 1 THEN 'Point, Polygon' ELSE 'Point' END || chr(10) || '- **properties_keys**: name, turn'", "'c' || conv_id"))
def read_geojson(n: int, t: list[str]) -> bytes:
    features = [{"type": "Feature", "geometry": {"type": "Polygon" if k % 2 else "Point", "coordinates": [k, 0]}, "properties": {"turn": k, "name": x}} for k, x in enumerate(t)]
    return json.dumps({"type": "FeatureCollection", "features": features}).encode()


@reads(".shp", one_page("'# c' || conv_id || '.shp' || chr(10) || chr(10) || '- **type**: Shapefile' || chr(10) || '- **feature_count**: ' || count(*) || chr(10) || '- **shape_type**: 1' || chr(10) || '- **bbox**: 0.0, 0.0, ' || count(*) || '.0, 1.0'", "'c' || conv_id"))
def read_shapefile(n: int, t: list[str]) -> bytes:
    points = b"".join(struct.pack(">ii", k + 1, 10) + struct.pack("<idd", 1, k, 0) for k in range(len(t)))
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(points)) // 2) + struct.pack("<ii4d", 1000, 1, 0, 0, len(t), 1) + b"\0" * 32
    return head + points
