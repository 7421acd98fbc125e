"""Ruled tables: the grid that a page's lines draw, its cells, and the words in them.

objects(doc_id, page, kind, x0, x1, top, bottom, text): what a PDF reader finds on a page, lines and rectangles (kind
"line", "rect") and words (kind "word"). Every step is a window or an equality join within a page, for all pages together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines nearer than SNAP are one, pieces nearer than JOIN go on, lines that miss by up to CROSS meet; least length
#: of a line, and the distance of tops from which on words stand on another line.
SNAP, JOIN, CROSS, LEAST_LENGTH, LINE_GAP = 3.0, 3.0, 3.0, 3.0, 3.0

_PAGE = ["doc_id", "page"]
_CELL = [*_PAGE, "x0", "top", "x1", "bottom"]


def ruled_edges(objects: DataFrame) -> DataFrame:
    """(doc_id, page, way, at, lo, hi): lines by their way, "h" at a height or "v" at a place; a rectangle gives its four sides."""

    def edge(way: str, at: str, lo: str, hi: str):
        return F.struct(F.lit(way).alias("way"), F.col(at).cast("double").alias("at"), F.col(lo).cast("double").alias("lo"), F.col(hi).cast("double").alias("hi"))

    line = F.array(F.when(F.col("top") == F.col("bottom"), edge("h", "top", "x0", "x1")).otherwise(edge("v", "x0", "top", "bottom")))
    sides = F.array(edge("h", "top", "x0", "x1"), edge("h", "bottom", "x0", "x1"), edge("v", "x0", "top", "bottom"), edge("v", "x1", "top", "bottom"))
    each = objects.where("kind in ('line', 'rect')").select(*_PAGE, F.explode(F.when(F.col("kind") == "line", line).otherwise(sides)).alias("e"))
    return each.select(*_PAGE, "e.*").where("hi > lo")


def straight_lines(edges: DataFrame) -> DataFrame:
    """Edges snapped to the mean place of their neighbours, and pieces on one place joined; short ones are left out."""
    way = [*_PAGE, "way"]
    by_place = Window.partitionBy(*way).orderBy("at")
    jump = (F.col("at") - F.lag("at").over(by_place) > SNAP).cast("int")
    grouped = edges.withColumn("group", F.coalesce(F.sum(jump).over(by_place), F.lit(0)))
    snapped = grouped.withColumn("at", F.round(F.avg("at").over(Window.partitionBy(*way, "group")), 6)).drop("group")
    along = Window.partitionBy(*way, "at").orderBy("lo", "hi")
    reach = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    pieces = snapped.withColumn("fresh", (F.coalesce(F.col("lo") > reach + JOIN, F.lit(True))).cast("int")).withColumn("piece", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = pieces.groupBy(*way, "at", "piece").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("piece")
    return joined.where(F.col("hi") - F.col("lo") >= LEAST_LENGTH)


def crossings(lines: DataFrame) -> DataFrame:
    """(doc_id, page, x, y, v, h): where lines meet; v and h tell the lines on one place apart."""
    v = lines.where("way = 'v'").select(*_PAGE, F.col("at").alias("x"), F.col("lo").alias("v"), F.col("hi").alias("v_end"))
    h = lines.where("way = 'h'").select(*_PAGE, F.col("at").alias("y"), F.col("lo").alias("h"), F.col("hi").alias("h_end"))
    meet = (F.col("v") <= F.col("y") + CROSS) & (F.col("v_end") >= F.col("y") - CROSS) & (F.col("h") <= F.col("x") + CROSS) & (F.col("h_end") >= F.col("x") - CROSS)
    return v.join(h, _PAGE).where(meet).select(*_PAGE, "x", "y", "v", "h")


def cells(points: DataFrame) -> DataFrame:
    """(doc_id, page, x0, top, x1, bottom): of each crossing the least rectangle below and right of it whose sides are lines."""
    below = points.select(*_PAGE, "x", "v", F.col("y").alias("y1"), F.col("h").alias("h1"))
    right = points.select(*_PAGE, "y", "h", F.col("x").alias("x1"), F.col("v").alias("v1"))
    corner = points.select(*_PAGE, F.col("x").alias("x1"), F.col("v").alias("v1"), F.col("y").alias("y1"), F.col("h").alias("h1"))
    boxes = points.join(below, [*_PAGE, "x", "v"]).where("y1 > y").join(right, [*_PAGE, "y", "h"]).where("x1 > x").join(corner, [*_PAGE, "x1", "v1", "y1", "h1"])
    least = boxes.groupBy(*_PAGE, "x", "y", "v", "h").agg(F.min(F.struct("y1", "x1")).alias("to"))
    return least.select(*_PAGE, F.col("x").alias("x0"), F.col("y").alias("top"), F.col("to.x1").alias("x1"), F.col("to.y1").alias("bottom")).distinct()


def grouped_cells(boxes: DataFrame) -> DataFrame:
    """Cells with the number of their table on the page, from 1: cells that share a corner are of one table. A fold over each page's cells."""
    corner = lambda c, x, y: F.struct(c[x].alias("x"), c[y].alias("y"))
    corners = lambda c: F.array(corner(c, "x0", "top"), corner(c, "x1", "top"), corner(c, "x0", "bottom"), corner(c, "x1", "bottom"))
    pages = boxes.groupBy(*_PAGE).agg(F.sort_array(F.collect_list(F.struct("top", "x0", "x1", "bottom"))).alias("all"))
    none = F.expr("cast(array() as array<struct<corners:array<struct<x:double,y:double>>,cells:array<struct<top:double,x0:double,x1:double,bottom:double>>>>)")

    def step(groups, c):
        touches = lambda g: F.arrays_overlap(g["corners"], corners(c))
        met = F.filter(groups, touches)
        merged = F.struct(F.array_union(F.flatten(F.transform(met, lambda g: g["corners"])), corners(c)).alias("corners"), F.array_append(F.flatten(F.transform(met, lambda g: g["cells"])), c).alias("cells"))
        return F.array_append(F.filter(groups, lambda g: ~touches(g)), merged)

    found = pages.select(*_PAGE, F.array_sort(F.transform(F.aggregate("all", none, step), lambda g: F.array_sort(g["cells"]))).alias("tables"))
    each = found.select(*_PAGE, F.posexplode("tables").alias("n", "cells"))
    return each.select(*_PAGE, (F.col("n") + 1).alias("table"), F.explode("cells").alias("c")).select(*_PAGE, "table", "c.x0", "c.top", "c.x1", "c.bottom")


def cell_texts(boxes: DataFrame, objects: DataFrame) -> DataFrame:
    """Cells with the words whose middle lies in them, line by line; right and lower edges are outside, a cell without words has an empty text."""
    words = objects.where("kind = 'word' and text is not null").select(*_PAGE, F.col("x0").alias("wx"), F.col("top").alias("wy"), ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("top") + F.col("bottom")) / 2).alias("my"), "text")
    inside = (F.col("mx") >= F.col("x0")) & (F.col("mx") < F.col("x1")) & (F.col("my") >= F.col("top")) & (F.col("my") < F.col("bottom"))
    placed = boxes.join(words, _PAGE).where(inside)
    down = Window.partitionBy(*_CELL).orderBy("wy")
    jump = (F.col("wy") - F.lag("wy").over(down) > LINE_GAP).cast("int")
    lined = placed.withColumn("line", F.coalesce(F.sum(jump).over(down), F.lit(0)))
    lines = lined.groupBy(*_CELL, "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("wx", "wy", "text"))), lambda w: w["text"]), " ").alias("said"))
    texts = lines.groupBy(*_CELL).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n").alias("text"))
    return boxes.join(texts, _CELL, "left").withColumn("text", F.coalesce("text", F.lit("")))


def ruled_tables(objects: DataFrame) -> DataFrame:
    """(doc_id, page, table, x0, top, x1, bottom, rows, columns, data): the ruled tables of more than one row.

    A row is a top, a column a left edge of any of the table's cells; where no cell begins (a merged cell, a ragged row) data has a null.
    Pages without a closed cell give no rows. Null positions belong to no line and no cell.
    """
    each = cell_texts(grouped_cells(cells(crossings(straight_lines(ruled_edges(objects))))), objects)
    whole = each.groupBy(*_PAGE, "table").agg(
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
        F.array_sort(F.collect_set("top")).alias("tops"), F.array_sort(F.collect_set("x0")).alias("lefts"),
        F.collect_list(F.struct(F.col("top").alias("y"), F.col("x0").alias("x"), "text")).alias("cells"),
    )
    at = lambda y, x: F.get(F.filter("cells", lambda c: (c["y"] == y) & (c["x"] == x)), F.lit(0))["text"]
    data = F.transform("tops", lambda y: F.transform("lefts", lambda x: at(y, x)))
    return whole.where(F.size("tops") > 1).select(*_PAGE, "table", "x0", "top", "x1", "bottom", F.size("tops").alias("rows"), F.size("lefts").alias("columns"), data.alias("data"))
