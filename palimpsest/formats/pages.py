"""The four page formats, each a function DataFrame -> DataFrame that adds ``content``.

Pages need page_index, page_label, text, confidence, status and, for JSON, ``outputs`` (array
of structs engine, text, error). ALTO and hOCR take an array ``blocks`` of structs
(path array<int>, type, text, bbox struct, confidence, words), the page's blocks flattened:
children stand under their parent's path. Ids are counted anew on each page.
"""

from __future__ import annotations

import re
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display
from ..sources.reader import bound_batches

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCKS = f"array<struct<path:array<int>,type:string,text:string,bbox:{BBOX},confidence:double,words:array<struct<text:string,bbox:{BBOX},confidence:double>>>>"
# Page size without one, and the block types that hold text.
WIDTH, HEIGHT = 2550, 3300
SOFTWARE = "palimpsest"


def markdown(pages: DataFrame) -> DataFrame:
    return pages.withColumn("content", display.confidence_line(F.coalesce("text", F.lit("")), F.col("confidence")))


def json_page(pages: DataFrame) -> DataFrame:
    """page_index, page_label, markdown, status, and the engines' texts and errors by name."""
    engines = F.map_from_entries(F.transform("outputs", lambda o: F.struct(o["engine"].alias("k"), F.struct(o["text"].alias("text"), o["error"].alias("error")).alias("v"))))
    body = F.struct("page_index", "page_label", F.col("text").alias("markdown"), "status", engines.alias("engine_outputs"))
    return pages.withColumn("content", F.to_json(body, {"ignoreNullFields": "false"}))


def raw_json(pages: DataFrame) -> DataFrame:
    """The record of how a page came about; the agreement is rounded to four places."""
    engines = F.map_from_entries(F.transform("outputs", lambda o: F.struct(o["engine"].alias("k"), F.struct(o["text"].alias("text"), o["error"].alias("error")).alias("v"))))
    body = F.struct("page_index", "page_label", engines.alias("engine_outputs"), F.col("text").alias("merged_markdown"), "model", F.bround("engines_agreement", 4).alias("engines_agreement"))
    return pages.withColumn("content", F.to_json(body, {"ignoreNullFields": "false"}))


class _Ids:
    def __init__(self) -> None:
        self.n = 0

    def __call__(self, prefix: str) -> str:
        self.n += 1
        return f"{prefix}_{self.n}"


def _tag(name: str, inner: str | None = None, /, **attributes) -> str:
    text = "".join(f" {k.rstrip('_')}={quoteattr(str(v))}" for k, v in attributes.items())
    return f"<{name}{text}/>" if inner is None else f"<{name}{text}>{inner}</{name}>"


def _plain(text: str | None) -> str:
    return re.sub(r"(?s)<!--.*?-->", "", text or "").strip()


def tree(blocks) -> list[tuple[dict, list]]:
    """Nested (block, children) of flattened blocks."""
    nodes: dict[tuple, tuple[dict, list]] = {}
    roots: list[tuple[dict, list]] = []
    for b in sorted(blocks if blocks is not None else [], key=lambda b: tuple(b["path"])):
        path = tuple(int(i) for i in b["path"])
        node = nodes[path] = (b, [])
        (nodes[path[:-1]][1] if path[:-1] in nodes else roots).append(node)
    return roots


def _corners(box, width: int, height: int) -> tuple[float, float, float, float]:
    return (box["x0"], box["y0"], box["x1"], box["y1"]) if box is not None else (0, 0, width, height)


def _alto_place(corners) -> dict:
    x0, y0, x1, y1 = corners
    return {"HPOS": int(x0), "VPOS": int(y0), "WIDTH": max(0, int(x1 - x0)), "HEIGHT": max(0, int(y1 - y0))}


def _words(block) -> list:
    w = block["words"]
    w = [] if w is None else list(w)
    return w if any(x["bbox"] is not None for x in w) else []


def _alto_line(block, width: int, height: int) -> str:
    text = _plain(block["text"])
    if not text:
        return ""
    place = _alto_place(_corners(block["bbox"], width, height)) if block["bbox"] is not None else {"HPOS": 0, "VPOS": 0, "WIDTH": width, "HEIGHT": int(height * 0.1)}
    sure = lambda c: {"WC": f"{c:.4f}"} if c and c > 0 else {}
    if boxed := _words(block):
        strings = [_tag("String", **(_alto_place(_corners(w["bbox"], 0, 0)) if w["bbox"] is not None else place), CONTENT=w["text"], **sure(w["confidence"])) for w in boxed]
    else:
        strings = [_tag("String", CONTENT=w, **place, **sure(block["confidence"])) for w in text.split()]
    return _tag("TextLine", "<SP/>".join(strings), **place)


def _alto_block(node, ids: _Ids, width: int, height: int) -> str:
    block, children = node
    place = _alto_place(_corners(block["bbox"], width, height))
    kind = (block["type"] or "text").lower()
    number = ids("elem")
    inner = lambda: "".join(_alto_block(c, ids, width, height) for c in children)
    if kind == "table":
        return _tag("ComposedBlock", inner() if children else _alto_line(block, width, height), ID=number, **place)
    if kind == "figure":
        return _tag("Illustration", ID=number, **place) + inner()
    return _tag("TextBlock", _alto_line(block, width, height), ID=number, **place) + inner()


def alto_xml(label: str, text: str, blocks, width: int = WIDTH, height: int = HEIGHT, time: str = "") -> str:
    ids, page = _Ids(), {"HPOS": 0, "VPOS": 0, "WIDTH": width, "HEIGHT": height}
    body = "".join(_alto_block(n, ids, width, height) for n in tree(blocks))
    if not body and _plain(text):
        body = _tag("TextBlock", _tag("TextLine", _tag("String", CONTENT=_plain(text), **page), **page), ID=ids("elem"), **page)
    step = _tag("ocrProcessingStep", _tag("processingDateTime", escape(time)) + _tag("processingSoftware", _tag("softwareCreator", SOFTWARE)))
    description = _tag("Description", _tag("MeasurementUnit", "pixel") + _tag("sourceImageInformation", _tag("fileName", escape(f"{label}.png"))) + _tag("OCRProcessing", step, ID="ocr_1"))
    layout = _tag("Layout", _tag("Page", _tag("PrintSpace", body, **page), ID="page_1", PHYSICAL_IMG_NR=1, HEIGHT=height, WIDTH=width))
    space = "http://www.loc.gov/standards/alto/ns-v4#"
    names = f'xmlns="{space}" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="{space} http://www.loc.gov/standards/alto/v4/alto-4-4.xsd"'
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<alto {names}>{description}{layout}</alto>\n'


# Classes and id prefixes of block types; others are text areas.
_HOCR = {"table": ("ocr_table", "table"), "figure": ("ocr_image", "image")}


def _hocr_title(corners, confidence=None) -> str:
    sure = f"; x_wconf {round(confidence * 100)}" if confidence and confidence > 0 else ""
    return "bbox " + " ".join(str(int(v)) for v in corners) + sure


def _hocr_text(block, corners, ids: _Ids) -> str:
    text = _plain(block["text"])
    if not text:
        return ""
    if boxed := _words(block):
        words = [(w["text"], _hocr_title(_corners(w["bbox"], 0, 0) if w["bbox"] is not None else corners, w["confidence"])) for w in boxed]
    else:
        words = [(w, _hocr_title(corners, block["confidence"])) for w in text.split()]
    paragraph, line = ids("par"), ids("line")
    spans = " ".join(_tag("span", escape(w), class_="ocrx_word", id=ids("word"), title=t) for w, t in words)
    title = _hocr_title(corners)
    return _tag("p", _tag("span", spans, class_="ocr_line", id=line, title=title), class_="ocr_par", id=paragraph, title=title)


def _hocr_block(node, ids: _Ids, width: int, height: int) -> str:
    block, children = node
    corners = _corners(block["bbox"], width, height)
    name, prefix = _HOCR.get((block["type"] or "text").lower(), ("ocr_carea", "block"))
    number = ids(prefix)
    inner = lambda: "".join(_hocr_block(c, ids, width, height) for c in children)
    own = "" if name == "ocr_image" or (name == "ocr_table" and children) else _hocr_text(block, corners, ids)
    area = lambda body: _tag("div", body, class_=name, id=number, title=_hocr_title(corners))
    return area(inner() if children else own) if name == "ocr_table" else area(own) + inner()


def hocr_html(label: str, index: int, text: str, blocks, width: int = WIDTH, height: int = HEIGHT) -> str:
    ids = _Ids()
    body = "".join(_hocr_block(n, ids, width, height) for n in tree(blocks))
    if not body and _plain(text):
        whole = {"path": (0,), "type": "text", "text": text, "bbox": None, "confidence": 0.0, "words": None}
        body = _hocr_block((whole, []), ids, width, height)
    page = _tag("div", body, class_="ocr_page", id="page_1", title=f"image {label}.png; bbox 0 0 {width} {height}; ppageno {index + 1}")
    head = _tag("title", escape(f"OCR Output — {label}")) + _tag("meta", name="ocr-system", content=SOFTWARE) + _tag("meta", name="ocr-capabilities", content="ocr_page ocr_carea ocr_par ocr_line ocrx_word")
    doctype = '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">'
    return f'<?xml version="1.0" encoding="UTF-8"?>\n{doctype}\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en">{_tag("head", head)}{_tag("body", page)}</html>\n'


def _with_blocks(pages: DataFrame) -> DataFrame:
    if "blocks" not in pages.columns:
        pages = pages.withColumn("blocks", F.lit(None).cast(BLOCKS))
    for c, v in (("page_width", WIDTH), ("page_height", HEIGHT)):
        if c not in pages.columns:
            pages = pages.withColumn(c, F.lit(v))
    return pages.withColumn("completed_at", F.lit("")) if "completed_at" not in pages.columns else pages


def alto(pages: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def render(label: pd.Series, text: pd.Series, blocks: pd.Series, w: pd.Series, h: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([alto_xml(a, b or "", c, int(d), int(e), f or "") for a, b, c, d, e, f in zip(label, text, blocks, w, h, at, strict=True)])

    bound_batches(pages.sparkSession)
    d = _with_blocks(pages)
    return d.withColumn("content", render("page_label", "text", "blocks", "page_width", "page_height", F.col("completed_at").cast("string")))


def hocr(pages: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def render(label: pd.Series, index: pd.Series, text: pd.Series, blocks: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([hocr_html(a, int(i), b or "", c, int(d), int(e)) for a, i, b, c, d, e in zip(label, index, text, blocks, w, h, strict=True)])

    bound_batches(pages.sparkSession)
    return _with_blocks(pages).withColumn("content", render("page_label", "page_index", "text", "blocks", "page_width", "page_height"))
