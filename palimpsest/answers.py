"""Answers of recognisers as (text, confidence, blocks): what an adapter behind ``services.Recognizer`` returns.

A block is a mapping with path, type, text, bbox, confidence and words (``formats.BLOCKS``).
"""

from __future__ import annotations

import csv
import io
from itertools import groupby

from . import dims

Answer = tuple[str, float | None, list[dict]]


def box(x0, y0, x1, y1) -> dict:
    return {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}


def block(path: list[int], text: str, kind: str = "text", bbox: dict | None = None, confidence: float = 0.0, words: list[dict] | None = None) -> dict:
    return {"path": path, "type": kind, "text": text, "bbox": bbox, "confidence": confidence, "words": words}


def tesseract(tsv: str, text: str | None = None) -> Answer:
    """The program's table (``tsv``): rows of level 5 are words. One block holds them; ``text`` is its plain output, else lines and paragraphs of the table."""
    words, lines = [], []
    for r in csv.DictReader(io.StringIO(tsv), delimiter="\t", quoting=csv.QUOTE_NONE):
        shown = (r.get("text") or "").strip()
        try:
            left, top, width, height, sure = (float(r[k]) for k in ("left", "top", "width", "height", "conf"))
        except (KeyError, TypeError, ValueError):
            continue
        if r["level"] == "5" and shown:
            words.append({"text": shown, "bbox": box(left, top, left + width, top + height), "confidence": sure / 100 if sure != -1 else 0.0})
            lines.append(((r["block_num"], r["par_num"]), r["line_num"], shown))
    if text is None:
        text = "\n\n".join("\n".join(" ".join(w for _, _, w in line) for _, line in groupby(paragraph, key=lambda x: x[1])) for _, paragraph in groupby(lines, key=lambda x: x[0]))
    text = text.strip()
    return text, None, [block([0], text, words=words)]


def layout(boxes: list[dict], lines: list[dict]) -> Answer:
    """Layout boxes (label, bbox, position) with the recognised lines (text, bbox, confidence) that overlap each, in reading order.

    Lines that no box takes are text blocks of their own behind them. A line's words share its width evenly."""
    overlap = lambda a, b: max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3])
    order = sorted(range(len(boxes)), key=lambda k: (boxes[k].get("position", k), boxes[k]["bbox"][1], boxes[k]["bbox"][0]))
    taken: dict[int, int] = {}
    for k in order:
        for i, line in enumerate(lines):
            if i not in taken and overlap(boxes[k]["bbox"], line["bbox"]):
                taken[i] = k
    out = []
    for bbox, label, mine in [*((boxes[k]["bbox"], boxes[k].get("label", ""), [i for i in taken if taken[i] == k]) for k in order), *((x["bbox"], "Text", [i]) for i, x in enumerate(lines) if i not in taken)]:
        mine.sort(key=lambda i: (lines[i]["bbox"][1], lines[i]["bbox"][0]))
        words, sure = [], [float(lines[i].get("confidence") or 0.0) for i in mine]
        for i in mine:
            x0, y0, x1, y1 = lines[i]["bbox"]
            said = lines[i]["text"].split()
            step = (x1 - x0) / max(len(said), 1)
            words += [{"text": w, "bbox": box(x0 + j * step, y0, x0 + (j + 1) * step, y1), "confidence": float(lines[i].get("confidence") or 0.0)} for j, w in enumerate(said)]
        out.append(block([len(out)], "\n".join(lines[i]["text"] for i in mine), dims.LAYOUT_LABELS.get(label, "text"), box(*bbox), sum(sure) / len(sure) if sure else 0.0, words))
    known = [b["confidence"] for b in out if b["confidence"] > 0]
    return "\n\n".join(b["text"] for b in out if b["text"]), sum(known) / len(known) if known else None, out
