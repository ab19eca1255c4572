"""PDF files made here, broken ones, page images, and recognisers that give blocks."""

import struct
import zlib
import zipfile
import io

import pytest
from pyspark.sql import functions as F

from palimpsest import answers, services
from palimpsest.config import Config
from palimpsest.operators import layout, store
from palimpsest.pipeline import Pipeline
from palimpsest.plans import readers
from palimpsest.sources import files, images, pdf, reader
from palimpsest.sources import parse_python as P


def made(objects, root=1, table=True):
    """A file of numbered objects, with a cross-reference table or without."""
    out, places = bytearray(b"%PDF-1.4\n"), {}
    for k, body in objects.items():
        places[k] = len(out)
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    if table:
        out += b"xref\n0 %d\n" % size + b"".join(b"%010d 00000 n \n" % places[k] if k in places else b"0000000000 65535 f \n" for k in range(size))
    out += b"trailer\n<< /Size %d /Root %d 0 R >>\n" % (size, root) + (b"startxref\n%d\n" % start if table else b"") + b"%%EOF"
    return bytes(out)


def stream(body, extra=b""):
    return b"<< /Length %d %s>>\nstream\n" % (len(body), extra) + body + b"\nendstream"


def one_page(content, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", more=None, resources=b"", table=True, extra=b""):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> " + resources + b" >> >>", 4: stream(content, extra), 5: font,
    }
    return made(objects | (more or {}), table=table)


def test_text_operators():
    content = rb"BT /F1 12 Tf 72 700 Td (Caf\351 \(a\)) Tj 0 -14 Td [(Kern) -20 (ed) -300 (word)] TJ T* 14 TL (next) ' 1 0 0 1 72 600 Tm <41 42> Tj ET % end"
    assert pdf.parse_pdf(one_page(content), "a.pdf")[0] == ["Café (a)\nKerned word\nnext\nAB"]
    assert pdf.parse_pdf(one_page(content, table=False), "a.pdf")[0] == ["Café (a)\nKerned word\nnext\nAB"]
    broken = one_page(content).replace(b"startxref\n", b"startxref\n9")
    assert pdf.parse_pdf(broken, "a.pdf")[0][0].startswith("Café")


def test_fonts():
    font = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /eacute /fi /uni0416 /alpha /three /nonsense] >> >>"
    assert pdf.parse_pdf(one_page(b"BT /F1 9 Tf (ABCDEFG) Tj ET", font), "a")[0] == ["éﬁЖα3G"]
    cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfrange <41> <43> <0061> endbfrange 1 beginbfrange <44> <45> [<00660066> <D83DDE00>] endbfrange"
    mapped = one_page(b"BT /F1 9 Tf (ABCDE) Tj ET", b"<< /Type /Font /Subtype /TrueType /ToUnicode 6 0 R >>", {6: stream(zlib.compress(cmap), b"/Filter /FlateDecode ")})
    assert pdf.parse_pdf(mapped, "a")[0] == ["abcff😀"]


def test_forms_filters_and_pages_without_text():
    form = stream(b"BT /F1 9 Tf 10 10 Td (in a form) Tj ET", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 5] ")
    assert pdf.parse_pdf(one_page(b"q /X Do Q", more={6: form}, resources=b"/XObject << /X 6 0 R >>"), "a")[0] == ["in a form"]
    plain = b"BT /F1 9 Tf (packed twice) Tj ET"
    hexed = zlib.compress(plain).hex().encode() + b">"
    assert pdf.parse_pdf(one_page(hexed, extra=b"/Filter [/ASCIIHexDecode /FlateDecode] "), "a")[0] == ["packed twice"]
    assert pdf.parse_pdf(one_page(b"0 0 m 9 9 l S"), "a") == ([""], {"extraction_method": "none", "extra": {"has_extractable_text": "false"}})
    assert pdf._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"  # the example of the PDF specification
    assert pdf._run_lengths(b"\x02abc\xfex\x80") == b"abcxxx"
    rows = b"".join(b"\x02" + bytes([1] * 4) for _ in range(3))
    assert pdf._unpredict(rows, {"Predictor": 12, "Columns": 4}) == bytes([1] * 4 + [2] * 4 + [3] * 4)


def test_refused_and_broken_files():
    with pytest.raises(ValueError, match="encrypted"):
        pdf.Pdf(one_page(b"").replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 5 0 R"))
    for raw in (b"", b"%PDF-1.4", b"no pdf", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj"):
        with pytest.raises(ValueError):
            pdf.parse_pdf(raw, "a.pdf")
    loop = made({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>", 3: b"<< /Type /Page /Parent 2 0 R >>"})
    assert pdf.parse_pdf(loop, "a")[0] == [""]


def test_images_of_a_pdf():
    jpeg, grey = b"\xff\xd8" + b"j" * 2000, bytes(range(150))
    image = lambda body, more: stream(body, b"/Type /XObject /Subtype /Image " + more)
    held = {6: image(jpeg, b"/Filter /DCTDecode "), 7: image(zlib.compress(grey), b"/Filter /FlateDecode /Width 15 /Height 10 /BitsPerComponent 8 /ColorSpace /DeviceGray "), 8: image(b"tiny", b"/Filter /DCTDecode ")}
    raw = one_page(b"", more=held, resources=b"/XObject << /A 6 0 R /B 7 0 R /C 8 0 R /D 6 0 R >>")
    got = pdf.images(raw)
    assert [(k, e) for k, e, _ in got] == [(0, "jpg"), (0, "png")] and got[0][2] == jpeg and got[1][2][1:4] == b"PNG"
    rows = bytes(zlib.decompress(got[1][2][got[1][2].index(b"IDAT") + 4 : -16]))
    assert b"".join(rows[k * 16 + 1 : k * 16 + 16] for k in range(10)) == grey
    assert images.page_images("pdf", raw, [0]) == [jpeg]


def test_page_images():
    tiff = readers.tiff([b"one", b"second", b"3"])
    frames = images.page_images("image", tiff, [0, 2])
    assert [len(P.tiff_directories(f)) for f in frames] == [1, 1]
    at = P.tiff_directories(frames[1])[0]
    assert struct.unpack_from("<HHII", frames[1], at + 2) == (256, 4, 1, 1)  # the third frame is one sample wide
    looped = bytearray(tiff)
    last = P.tiff_directories(tiff)[-1]
    struct.pack_into("<I", looped, last + 2 + 12 * 8, P.tiff_directories(tiff)[0])
    assert len(P.tiff_directories(bytes(looped))) == 3 and P.parse_image(bytes(looped), "a.tif")[0] == [""] * 3
    comic = readers.zipped({"b.jpg": b"second", "a.png": b"first", "x.txt": b"no"})
    assert images.page_images("comic", comic, [1, 0]) == [b"second", b"first"]
    assert images.page_images("docx", b"whole", [0, 1]) == [b"whole", b"whole"]


def test_answers_of_recognisers():
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    rows = [(5, 1, 1, 1, 1, 1, 10, 20, 30, 8, 96.5, "Hello"), (5, 1, 1, 1, 1, 2, 50, 20, 30, 8, -1, "\"w"), (4, 1, 1, 1, 2, 0, 0, 0, 0, 0, -1, ""), (5, 1, 1, 1, 2, 1, 10, 30, 5, 8, 50, "b"), (5, 1, 2, 1, 1, 1, 10, 90, 5, 8, 50, "c")]
    text, sure, (block,) = answers.tesseract(head + "\n".join("\t".join(map(str, r)) for r in rows))
    assert (text, sure) == ('Hello "w\nb\n\nc', None)
    assert [(w["text"], w["confidence"]) for w in block["words"]] == [("Hello", 0.965), ('"w', 0.0), ("b", 0.5), ("c", 0.5)] and block["words"][0]["bbox"] == {"x0": 10, "y0": 20, "x1": 40, "y1": 28}
    boxes = [{"label": "Text", "bbox": [0, 50, 100, 100], "position": 1}, {"label": "SectionHeader", "bbox": [0, 0, 100, 40], "position": 0}]
    lines = [{"text": "two words", "bbox": [0, 60, 90, 70], "confidence": 0.8}, {"text": "Head", "bbox": [0, 10, 40, 20], "confidence": 0.6}, {"text": "apart", "bbox": [200, 0, 240, 10]}]
    text, sure, blocks = answers.layout(boxes, lines)
    assert text == "Head\n\ntwo words\n\napart" and sure == pytest.approx(0.7) and [b["type"] for b in blocks] == ["heading", "text", "text"]
    assert [w["bbox"]["x0"] for w in blocks[1]["words"]] == [0, 45]


class Boxed:
    engine_name = "tesseract"

    def recognize(self, image, page_index, languages):
        return f"{self.engine_name} sees {len(image)}", 0.9, [answers.block([0], f"seen {page_index}", words=[{"text": "seen", "bbox": answers.box(1, 2, 3, 4), "confidence": 0.5}])]

    def health_check(self):
        return True


def test_blocks_reach_alto_and_hocr(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "c.cbz", "w") as z:
        z.writestr("1.jpg", b"x" * 11)
        z.writestr("2.jpg", b"x" * 222)
    (tmp_path / "in" / "t.tiff").write_bytes(readers.tiff([b"abc", b"defg"]))
    config = Config(input_dir=str(tmp_path / "in"), output_dir=str(tmp_path / "out"), input_extensions=("cbz", "tiff"), output_formats=("alto", "hocr"), vlm_enabled=False)
    Pipeline(spark, config, engines=[services.StubRecognizer("marker", "marker {index} {size}"), Boxed()]).run()
    pages = {(r.path.rsplit("/", 1)[1], r.page_index): r for r in store.pages_table(spark, f"{tmp_path}/out").read().collect()}
    assert pages["c.cbz", 0].text.endswith("11") and pages["c.cbz", 1].text.endswith("222") and {r.status for r in pages.values()} == {"complete"}
    assert pages["t.tiff", 1].blocks[0].words[0].bbox.x1 == 3
    formats = spark.read.parquet(f"{tmp_path}/out/formats/alto").filter(F.col("content").contains('HPOS="1" VPOS="2" WIDTH="2" HEIGHT="2" CONTENT="seen" WC="0.5000"'))
    assert formats.count() == 4
    assert spark.read.parquet(f"{tmp_path}/out/formats/hocr").filter(F.col("content").contains("bbox 1 2 3 4; x_wconf 50")).count() == 4


def test_blocks_by_priority(spark):
    shape = "p int, engine string, ord int, error string, blocks array<struct<text:string>>"
    rows = [(1, "tesseract", 0, None, [("t",)]), (1, "surya2", 1, None, [("s",)]), (1, "marker", 2, "failed", [("m",)]), (2, "other", 0, None, [("o",)]), (2, "else", 1, None, [("e",)]), (3, "marker", 0, None, None)]
    assert {r.p: r.blocks[0].text for r in layout.page_blocks(spark.createDataFrame(rows, shape), ["p"]).collect()} == {1: "s", 2: "o"}


def test_sniffing_and_refused_sizes(spark, tmp_path, monkeypatch):
    late = io.BytesIO()
    with zipfile.ZipFile(late, "w") as z:
        z.writestr("[Content_Types].xml", "x" * 9000)
        z.writestr("word/document.xml", "<d/>")
    odd = late.getvalue()[:-2] + b"\x05\x00" + b"note."  # an end record with a comment
    empty = readers.zipped({"plain.txt": "x"})
    rows = [("a.unknown", late.getvalue()), ("b.unknown", odd), ("c.unknown", empty), ("d.unknown", b"PK\x03\x04 broken"), ("e.unknown", b"%PDF-1.4")]
    got = {r.path: r.format for r in files.detect(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert got == {"a.unknown": "docx", "b.unknown": "docx", "c.unknown": None, "d.unknown": None, "e.unknown": "pdf"}
    monkeypatch.setattr(files, "REFUSE_MB", 0.001)
    (tmp_path / "big.txt").write_text("x" * 5000)
    (tmp_path / "small.txt").write_bytes("é".encode("latin-1") + b" plain words in another encoding")
    pages = {r.path.rsplit("/", 1)[1]: r for r in reader.read_folder(spark, str(tmp_path)).collect()}
    assert pages["big.txt"].error == "SizeError: too large to be read" and pages["big.txt"].text is None
    assert pages["small.txt"].error is None and "plain words" in pages["small.txt"].text
    listed = {r.path.rsplit("/", 1)[1]: r.verdict for r in files.listing(files.scan(spark, str(tmp_path))).collect()}
    assert listed == {"big.txt": "refused", "small.txt": "ok"}
