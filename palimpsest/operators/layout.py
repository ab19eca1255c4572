"""Blocks, boxes and tables of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims


def map_label(raw: Column) -> Column:
    return dims.lookup(dims.LAYOUT_LABELS, raw, F.lit("text"))


def lines_in_boxes(boxes: DataFrame, lines: DataFrame, page: list[str]) -> DataFrame:
    """Lines that overlap a box of their page (touching is no overlap).

    The equi-condition on the page keeps the join hash-partitioned; the inequalities only filter
    within a page."""
    b = boxes.select(*page, F.col("box_id"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    meet = (F.greatest("b_x0", "x0") < F.least("b_x1", "x1")) & (F.greatest("b_y0", "y0") < F.least("b_y1", "y1"))
    return b.join(lines, page).filter(meet).drop("b_x0", "b_y0", "b_x1", "b_y1")


def word_boxes(lines: DataFrame, text: str = "text") -> DataFrame:
    """One row for each word of a line, the line's width dealt evenly."""
    from ..functions.text import tokens

    d = lines.withColumn("_w", tokens(F.col(text)))
    width = (F.col("x1") - F.col("x0")) / F.size("_w")
    return d.select("*", width.alias("_d"), F.posexplode("_w").alias("word_no", "word")).withColumns({"word_x0": F.col("x0") + F.col("word_no") * F.col("_d"), "word_x1": F.col("x0") + (F.col("word_no") + 1) * F.col("_d")}).drop("_w", "_d")


def table_html(cells: DataFrame, table: list[str]) -> DataFrame:
    """(table, html): cells (row, col, text) on a full grid; the last of several cells of a place stays."""
    grid = cells.groupBy(*table, "row", "col").agg(F.max_by("text", "ord").alias("text"))
    listed = grid.groupBy(*table).agg(F.max("row").alias("rows"), F.max("col").alias("cols"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", "row", "col").alias("k"), F.col("text").alias("v")))).alias("m"))
    cell = lambda r, c: F.concat(F.lit("<td>"), F.coalesce(F.try_element_at("m", F.concat_ws(",", r, c)), F.lit("")), F.lit("</td>"))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("cols")), lambda c: cell(r, c)), ""), F.lit("</tr>"))
    html = F.concat(F.lit("<table>"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("rows")), row), ""), F.lit("</table>"))
    return listed.select(*table, html.alias("html"))


def block_depth(blocks: DataFrame) -> DataFrame:
    """Adds parent_path and depth to blocks addressed by ``path`` (array of child numbers)."""
    n = F.size("path")
    return blocks.withColumns({"depth": n, "parent_path": F.when(n > 1, F.slice("path", F.lit(1), n - 1))})


def chosen_blocks(blocks: DataFrame, page: list[str]) -> DataFrame:
    """The blocks of each page's first engine, in the order of block priority."""
    rank = dims.lookup({e: k for k, e in enumerate(dims.BLOCK_PRIORITY)}, F.col("engine"))
    ranked = blocks.withColumn("_rank", rank).filter("_rank IS NOT NULL")
    best = ranked.groupBy(*page).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [*page, "_rank"]).drop("_rank")


def page_blocks(outputs: DataFrame, key: list[str]) -> DataFrame:
    """(key, blocks): of each page's outputs that have blocks, those of the engine first in block priority, then in configuration order."""
    last = len(dims.BLOCK_PRIORITY)
    rank = F.struct(dims.lookup({e: k for k, e in enumerate(dims.BLOCK_PRIORITY)}, F.col("engine"), F.lit(last)).alias("rank"), "ord")
    return outputs.filter(F.col("error").isNull() & (F.size("blocks") > 0)).groupBy(*key).agg(F.min_by("blocks", rank).alias("blocks"))


def alto_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whole numbers; width and height are never below 0."""
    whole = lambda v: v.cast("int")
    return F.struct(whole(x0).alias("hpos"), whole(y0).alias("vpos"), F.greatest(F.lit(0), whole(x1 - x0)).alias("width"), F.greatest(F.lit(0), whole(y1 - y0)).alias("height"))


def reading_order(boxes: DataFrame, page: list[str]) -> DataFrame:
    """(page, box_ids): boxes from top to bottom, then left to right."""
    listed = F.array_sort(F.collect_list(F.struct("y0", "x0", "box_id")))
    return boxes.groupBy(*page).agg(F.transform(listed, lambda b: b["box_id"]).alias("box_ids"))
