"""HTML extraction by wrapper induction: DOM trees of one host are aligned by simple tree matching; what stays the same
there is template, and varying slots are content.

*Trees.* A page becomes blocks of text, each in a slot of the page's *shape*: its tree of block elements in which
repeated siblings (rows, items, paragraphs) share one node, so shapes stay small however long a page is.

*Wrapper of a host.* Identical pages count once. The reference is the host's most common shape. Every other shape is
aligned to it by simple tree matching (the greatest number of nodes paired in order, top down), and what each page has
in each slot of the reference is counted. Two kinds of template follow, each from ``min_pages`` different pages on:
a text that fills the same slot on ``constant`` of the pages, and, outside an article, a slot with few different
texts for its pages, such as menus and notices dealt from a stock.

*Extraction.* Menus, headers, footers, sidebars, forms, adverts, notices and reader comments are also known by element
and by class, id or role. Of the rest, blocks of ``article`` (or else ``main``) are the text; without these, those in
varying slots, within the smallest subtree that holds four fifths of it. Template never empties a page.

*Scale.* Shapes and counts are pre-aggregated in each task before they are shuffled, so that a host with a third of all
pages sends a few rows a task and slot. A host's wrapper is one row no larger than its shape and one page's texts. Pages
meet it in a join on the host: Spark broadcasts the wrappers if they are small, and else splits large hosts.

Defined results: null html is an empty page; a null or unusable url is of host ''; an unclosed element ends where HTML
has it end, at the latest with the page; a block that repeats on a page stays as often; repeated rows are extracted
each. White space is any that Unicode counts as such, and ``br`` is one. Elements nested deeper than ``DEPTH`` belong to
the slot of that level; of a parent's slots beyond ``SLOTS``, those of one element are one. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DEPTH, SLOTS = 100, 64

# Elements of HTML by their kind.
_VOID = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
])
_RAW = frozenset([
    "script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math", "object", "audio", "video", "canvas",
])
_INLINE = frozenset([
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var",
])
_AWAY = frozenset([
    "nav", "header", "footer", "aside", "form", "select", "button", "menu", "dialog", "datalist",
])
_ENDS_P = frozenset([
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dd", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "td", "th", "tr", "tbody", "thead", "tfoot", "ul",
])
#: an element that ends open ones of the same kind, up to the nearest of their container
_SIBLINGS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",))}
#: words of a class, id or role that name what is not the article
_NOISE = frozenset([
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "alertdialog", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "comment", "comments", "commentlist", "respond", "disqus",
    "reply", "replies", "share", "sharing", "social", "related", "recommended", "sidebar", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination",
    "pager", "toolbar", "footer", "contentinfo", "complementary", "widget",
])
#: the same, but not within an article
_NOISE_OUTSIDE = frozenset([
    "header", "masthead", "banner", "search", "copyright", "legal", "disclaimer", "side",
])

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>?|[!?/][^>]*>?)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@functools.lru_cache(4096)
def _named(attributes: str) -> tuple[str, bool, bool, str]:
    """(class words for the label, noise anywhere, noise outside an article, main) of an element's attributes."""
    words, label, hidden, main = set(), "", False, ""
    for m in _NAMES.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for token in value.split():
                found = [w.lower() for w in _WORD.findall(token)]
                if not found or found[0] not in ("has", "with", "without", "no", "is", "js"):
                    words.update(found)
            if name == "class":
                label = ".".join(sorted(t for t in value.split() if not re.search(r"\d", t)))
            if name == "role" and value.lower() in ("main", "article"):
                main = value.lower()
        elif name == "itemprop":
            main = main or ("article" if value.lower() == "articlebody" else "")
        else:
            hidden = hidden or name == "hidden" or (name == "style" and bool(_HIDDEN.search(value))) or (name == "aria-hidden" and value.lower() == "true")
    return label, hidden or not words.isdisjoint(_NOISE), not words.isdisjoint(_NOISE_OUTSIDE), main


class Page:
    """The blocks of a page, (slot, text, characters in links), and its shape: labels, parents and kinds of the slots."""

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, int]] = []
        self.labels, self.parents, self.noise, self.kind = ["#"], [-1], [False], [""]
        self._kids: list[dict[str, int]] = [{}]
        self._order: list[list[int]] = [[]]
        self._cursor = [0]
        self._parse(html)

    def _slot(self, parent: int, label: str, tag: str) -> int:
        """The slot of a new element: that of an equal sibling at or after the last one used, or a new one."""
        kids, order = self._kids[parent], self._order[parent]
        if len(order) >= SLOTS and label not in kids:
            label = tag if tag in kids or len(order) < 2 * SLOTS else "*"
        at = kids.get(label)
        if at is not None and (at >= self._cursor[parent] or len(order) >= SLOTS):
            self._cursor[parent] = at
            node = order[at]
            self._cursor[node] = 0
            return node
        node = len(self.labels)
        kids[label] = self._cursor[parent] = len(order)
        order.append(node)
        self.labels.append(label)
        self.parents.append(parent)
        self.noise.append(False)
        self.kind.append("")
        self._kids.append({})
        self._order.append([])
        self._cursor.append(0)
        return node

    def _parse(self, html: str) -> None:
        # of an open element: its name, slot, whether it is noise, and what kind of main text it is in
        stack: list[tuple[str, int, bool, str]] = [("#", 0, False, "")]
        open_: dict[str, int] = {}
        # forms, which may hold a whole page, and elements that are noise by their words alone
        holders: set[int] = set()
        text: list[str] = []
        linked = quiet = 0  # characters within links; open inline noise
        keys: dict[tuple[int, bool, str], int] = {}
        where, seen = 0, False
        at, end = 0, len(html)

        def flush():
            nonlocal linked
            if text:
                whole = "".join(text)
                whole = " ".join((entities.unescape(whole) if "&" in whole else whole).split())
                if whole:
                    self.blocks.append((where, whole, min(linked, len(whole))))
                text.clear()
            linked = 0

        def slot_of(parent: int, label: str, tag: str, noise: bool, kind: str) -> int:
            """Slots of one kind only: an element that is noise and one that is not share none."""
            node = self._slot(parent, f"{label}!" if noise else label, tag)
            self.noise[node], self.kind[node] = self.noise[node] or noise, self.kind[node] or kind
            return node

        def pop(to: int):
            nonlocal quiet, where
            while len(stack) > to:
                name, _, _, kind = stack.pop()
                open_[name] -= 1
                if kind == "quiet":
                    quiet -= 1
            where = next(s[1] for s in reversed(stack) if s[3] != "quiet")

        def back_to(names: tuple[str, ...], stops: tuple[str, ...]) -> int | None:
            if any(open_.get(n) for n in names):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in names:
                        return k
                    if stack[k][0] in stops:
                        return None
            return None

        while at < end:
            m = _TAG.search(html, at)
            piece = html[at : m.start() if m else end]
            if piece and not quiet:
                text.append(piece)
                if open_.get("a"):
                    linked += len(piece.strip())
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in ("br", "p") and not open_.get(tag):
                    text.append(" ")
                    continue
                if not open_.get(tag):
                    continue
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
                if tag in _INLINE:
                    if all(s[0] in _INLINE for s in stack[k:]):
                        pop(k)
                    continue
                flush()
                pop(k)
                continue
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                    at = close.end() if close else end
                if text:
                    text.append(" " if tag in ("svg", "math") else "")
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                elif tag == "br" and not quiet:
                    text.append(" ")
                continue
            label, noise, outside, main = _named(m[3]) if m[3] else ("", False, False, "")
            name, parent, within, kind = stack[-1]
            if tag in _INLINE:
                if noise:
                    stack.append((tag, parent, within, "quiet"))
                    quiet += 1
                    open_[tag] = open_.get(tag, 0) + 1
                elif tag == "a":
                    stack.append((tag, parent, within, kind))
                    open_[tag] = open_.get(tag, 0) + 1
                continue
            flush()
            if tag in ("html", "head", "body") and open_.get(tag):
                continue
            k = back_to(("p",), tuple(_ENDS_P - {"p"})) if tag in _ENDS_P else None
            if tag in _SIBLINGS and (j := back_to(*_SIBLINGS[tag])) is not None:
                k = j if k is None else min(j, k)
            if tag == "body":
                k = back_to(("head",), ())
            if k is not None:
                pop(k)
            # open links and inline noise end with the block around them
            while stack[-1][0] in _INLINE:
                pop(len(stack) - 1)
            _, parent, within, kind = stack[-1]
            if tag in ("article", "main"):
                main = tag
            away = tag in _AWAY and not (tag == "header" and kind in ("article", "main"))
            named_away = noise or (outside and kind not in ("article", "main"))
            if tag in ("html", "head", "body"):
                away = named_away = False
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not noise:
                named_away = False
            if main and not noise and within and not seen and holders:
                # the first article stands in a form, or the main part in what looked like noise: it and what follows in it are none
                j = next((j for j in range(1, len(stack)) if stack[j][2]), 0)
                if stack[j][1] in holders and (main == "main" or stack[j][0] == "form"):
                    stack[j:] = [(x[0], x[1], False, x[3]) for x in stack[j:]]
                within = stack[-1][2]
            now = within or away or named_away
            kind = "article" if "article" in (main, kind) else main or kind
            seen = seen or bool(main and not now)
            deep = len(stack) > DEPTH
            key = (parent, now, kind)
            if deep:
                node = keys.setdefault(key, parent if self.noise[parent] == now and self.kind[parent] == kind else slot_of(parent, "...", "...", now, kind))
            else:
                node = slot_of(parent, f"{tag}.{label}" if label else tag, tag, now, kind)
            if now and not within and (tag == "form" or (named_away and not away)):
                holders.add(node)
            stack.append((tag, node, now, kind))
            open_[tag] = open_.get(tag, 0) + 1
            where = node
        flush()

    def shape(self) -> str:
        """The tree of slots in their order of creation: parents and labels."""
        return "\n".join(f"{p} {label}" for p, label in zip(self.parents, self.labels, strict=True))


def _tree(shape: str) -> tuple[list[str], list[list[int]]]:
    labels, kids = [], []
    for k, line in enumerate(shape.split("\n")):
        parent, _, label = line.partition(" ")
        labels.append(label)
        kids.append([])
        if k:
            kids[int(parent)].append(k)
    return labels, kids


@functools.lru_cache(256)
def align(shape: str, reference: str) -> tuple[int, ...]:
    """Simple tree matching: for each slot of ``shape`` its partner in ``reference``, or -1.

    Roots are partners; of two partners' children, equal labels are paired in order so that the number of pairs in
    the whole subtrees is greatest."""
    a_labels, a_kids = _tree(shape)
    if shape == reference:
        return tuple(range(len(a_labels)))
    b_labels, b_kids = _tree(reference)
    known: dict[tuple[int, int], tuple[int, list]] = {}

    def match(a: int, b: int) -> int:
        if (a, b) not in known:
            left, right = a_kids[a], b_kids[b]
            best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
            for i, x in enumerate(left):
                for j, y in enumerate(right):
                    pair = match(x, y) + 1 + best[i][j] if a_labels[x] == b_labels[y] else 0
                    best[i + 1][j + 1] = max(pair, best[i][j + 1], best[i + 1][j])
            pairs, i, j = [], len(left), len(right)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((left[i], right[j]))
            known[a, b] = best[-1][-1], pairs
        return known[a, b][0]

    match(0, 0)
    partner, todo = [-1] * len(a_labels), [(0, 0)]
    while todo:
        a, b = todo.pop()
        partner[a] = b
        todo += known[a, b][1]
    return tuple(partner)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def profiles(pages: DataFrame) -> DataFrame:
    """(host, page, shape, places) of the different pages of each host: the slots and hashes of their blocks."""

    def run(batches):
        for whole in batches:
            for b in C.slices(whole, "html", 4 << 20):
                page, shape, places = [], [], []
                for raw in b["html"].to_pylist():
                    p = Page(raw or "")
                    page.append(_hash(raw or ""))
                    shape.append(p.shape())
                    held = sorted({(slot, _hash(text)) for slot, text, _ in p.blocks})
                    places.append(C.pack(np.array([s for s, _ in held], np.int32), np.array([h for _, h in held], np.int64)))
                yield pa.RecordBatch.from_arrays([b["host"], pa.array(page, pa.int64()), pa.array(shape, pa.string()), pa.array(places, pa.binary())], names=["host", "page", "shape", "places"])

    found = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(C.lean(run), "host string, page long, shape string, places binary")
    return found.dropDuplicates(["host", "page"])


def wrappers(pages: DataFrame, constant: float = 0.9, varied: float = 0.5, min_pages: int = 8) -> DataFrame:
    """(host, shape, slots, texts): a host's reference shape, its slots that are template, and (slot, text) that are."""
    known = C.materialise(profiles(pages), "page-profiles")
    shapes = known.groupBy("host", "shape").agg(F.count("*").alias("n"))
    reference = C.materialise(shapes.groupBy("host").agg(F.max_by("shape", F.struct("n", "shape")).alias("reference")), "page-references")

    def count(batches):
        held: dict[tuple[str, int, int | None], int] = {}

        def sent():
            rows = list(held.items())
            held.clear()
            return C.batch("host string, slot int, text long, n long", host=[k[0] for k, _ in rows], slot=[k[1] for k, _ in rows], text=[k[2] for k, _ in rows], n=[n for _, n in rows])

        for b in batches:
            for host, shape, reference, blob in zip(*(b[c].to_pylist() for c in ("host", "shape", "reference", "places")), strict=True):
                partner = align(shape, reference)
                slots, texts = C.unpack(blob, np.int32, np.int64)
                own = {(partner[s], t) for s, t in zip(slots.tolist(), texts.tolist(), strict=True) if partner[s] >= 0}
                for key in [*((host, s, t) for s, t in own), *((host, s, None) for s in {s for s, _ in own})]:
                    held[key] = held.get(key, 0) + 1
                if len(held) > 200_000:
                    yield sent()
        if held:
            yield sent()

    counts = known.join(reference, "host").select("host", "shape", "reference", "places").mapInArrow(C.lean(count), "host string, slot int, text long, n long")
    counts = counts.groupBy("host", "slot", "text").agg(F.sum("n").alias("n"))
    # what a slot holds: its pages, its different texts, and the few texts that may be constant (more than one in two of its pages each)
    often = C.materialise(counts, "slot-texts")
    slots = often.groupBy("host", "slot").agg(F.max(F.when(F.col("text").isNull(), F.col("n"))).alias("pages"), F.count("text").alias("texts")).filter(F.col("pages") >= min_pages)
    dull = slots.filter(F.col("texts") <= varied * F.col("pages")).groupBy("host").agg(F.collect_list("slot").alias("slots"))
    same = often.filter(f"text IS NOT NULL AND n >= {constant * min_pages}").join(slots, ["host", "slot"]).filter(F.col("n") >= constant * F.col("pages"))
    same = same.groupBy("host").agg(F.collect_list(F.struct("slot", "text")).alias("texts"))
    return reference.withColumnRenamed("reference", "shape").join(dull, "host", "left").join(same, "host", "left")


def main_blocks(page: Page, wrapper: tuple[str, frozenset, frozenset] | None) -> list[str]:
    """The texts of a page's article, in order."""
    live = [k for k, (slot, _, _) in enumerate(page.blocks) if not page.noise[slot]]
    partner = align(page.shape(), wrapper[0]) if wrapper else None

    def template(k: int, slots: bool) -> bool:
        slot, text, _ = page.blocks[k]
        if partner is None or partner[slot] < 0:
            return False
        return (slots and partner[slot] in wrapper[1]) or (bool(wrapper[2]) and (partner[slot], _hash(text)) in wrapper[2])

    for kind in ("article", "main"):
        inside = [k for k in live if page.kind[page.blocks[k][0]] == kind]
        if inside:
            return [page.blocks[k][1] for k in [k for k in inside if not template(k, False)] or inside]
    rest = [k for k in live if not template(k, True)] or [k for k in live if not template(k, False)] or live
    return [page.blocks[k][1] for k in _densest(page, rest)]


def _densest(page: Page, chosen: list[int]) -> list[int]:
    """Of the blocks ``chosen``, those in the smallest subtree that holds four fifths of their text outside links."""
    weight = [0] * len(page.labels)
    for k in chosen:
        slot, text, linked = page.blocks[k]
        weight[slot] += len(text) - linked
    own = weight[:]
    for node in range(len(weight) - 1, 0, -1):  # children come after their parents
        weight[page.parents[node]] += weight[node]
    kids: dict[int, list[int]] = {}
    for node in range(1, len(weight)):
        kids.setdefault(page.parents[node], []).append(node)
    top = 0
    while own[top] <= 0.2 * weight[0]:
        best = max(kids.get(top, []), key=weight.__getitem__, default=None)
        if best is None or weight[best] < 0.8 * weight[0] or not kids.get(best):
            break
        top = best
    inside = [False] * len(weight)
    for node in range(len(weight)):
        inside[node] = node == top or (node > 0 and inside[page.parents[node]])
    text = [k for k in chosen if inside[page.blocks[k][0]]]
    return [k for k in text if page.blocks[k][2] <= 0.6 * len(page.blocks[k][1]) or len(page.blocks[k][1]) >= 400] or text


def extract(pages: DataFrame, **settings) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html)."""
    C.bound_batches(pages.sparkSession)
    found = C.materialise(wrappers(pages, **settings), "page-wrappers")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(found, "host", "left").select("page_id", "url", "html", "shape", "slots", "texts")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"

    def run(batches):
        for whole in batches:
            for b in C.slices(whole, "html", 4 << 20):
                texts, last, wrapper = [], None, None
                for html, *given in zip(*(b[c].to_pylist() for c in ("html", "shape", "slots", "texts")), strict=True):
                    if given != last:
                        last = given
                        shape, slots, same = given
                        wrapper = None if shape is None else (shape, frozenset(slots or ()), frozenset((x["slot"], x["text"]) for x in same or ()))
                    texts.append("\n".join(main_blocks(Page(html), wrapper)) if html else "")
                yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(C.lean(run), schema).withColumn("n_chars", F.length("text").cast("long"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
