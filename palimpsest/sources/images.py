"""The image of a page, from the bytes of its file."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parse_python, pdf


def tiff_frame(raw: bytes, index: int) -> bytes:
    """The file with one of its frames: the first directory is that frame's, and the last."""
    order = "<" if raw[:2] == b"II" else ">"
    at = parse_python.tiff_directories(raw)[index]
    entries = struct.unpack(order + "H", raw[at : at + 2])[0]
    out = bytearray(raw)
    struct.pack_into(order + "I", out, 4, at)
    out[at + 2 + 12 * entries : at + 6 + 12 * entries] = b"\0\0\0\0"
    return bytes(out)


def page_images(kind: str, raw: bytes, wanted: list[int]) -> list[bytes]:
    """Images of some pages: a comic's members, a TIFF's frames, a PDF page's largest image; else the file itself."""
    if kind == "comic":
        with parse_python.members(raw) as z:
            names = parse_python.image_names(z)
            return [z.read(names[k]) if k < len(names) else raw for k in wanted]
    if kind == "image" and raw[:4] in (b"II*\0", b"MM\0*"):
        return [tiff_frame(raw, k) for k in wanted]
    if kind == "pdf":
        held: dict[int, bytes] = {}
        for k, _, data in pdf.images(raw, once=False):
            held[k] = max(held.get(k, b""), data, key=len)
        return [held.get(k, raw) for k in wanted]
    return [raw] * len(wanted)


def of_pages(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, page_index, image) of pages (path, page_index) of files (path, format, content): a file's bytes are joined once, not to each page."""
    listed = pages.groupBy("path").agg(F.array_sort(F.collect_list("page_index")).alias("wanted"))
    d = listed.join(found.select("path", "format", "content"), "path")

    def run(batches):
        for b in batches:
            for path, kind, content, wanted in zip(*(b[c] for c in ("path", "format", "content", "wanted")), strict=True):
                path, raw, wanted = path.as_py(), content.as_py() or b"", wanted.as_py()
                try:
                    images = page_images(kind.as_py(), raw, wanted)
                except Exception:  # a broken container: the recognisers see the whole
                    images = [raw] * len(wanted)
                for k, image in zip(wanted, images, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int32()), pa.array([image], pa.binary())], names=["path", "page_index", "image"])

    return d.mapInArrow(run, "path string, page_index int, image binary")
