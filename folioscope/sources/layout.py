"""Page layout: filters on positioned objects, cropping, and the search for tables of contents.

objects(doc_id, page, kind, x0, x1, top, bottom, color, text): what a PDF reader finds on a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least height of an image, and the gap below which a table of contents goes on over a page break.
LEAST_IMAGE, CONTENTS_GAP = 64, 40
# Forms of an entry and of the heading of a table of contents.
CONTENTS_ENTRY = r"[\d.]+\s+.*?\s*[\s.]{2,}\s*\d+|^\s*[o▪•]\s*"
CONTENTS_HEADING = r"table\s+of\s+contents?"


def outside_tables(objects: DataFrame, boxes: DataFrame) -> DataFrame:
    """Objects whose middle lies in no table's box (doc_id, page, bx0, btop, bx1, bbottom); right and lower edges are outside."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    same = (objects["doc_id"] == boxes["doc_id"]) & (objects["page"] == boxes["page"])
    inside = (x >= F.col("bx0")) & (x < F.col("bx1")) & (y >= F.col("btop")) & (y < F.col("bbottom"))
    return objects.join(boxes, same & inside, "left_anti")


def visible(objects: DataFrame) -> DataFrame:
    """Rectangles stay only if filled with color 0."""
    return objects.where((F.col("kind") != "rect") | (F.coalesce("color", F.lit(-1.0)) == 0))


def crop(objects: DataFrame, height: float, top: float = 0, bottom: float = 0) -> DataFrame:
    """Objects within the page without its header and footer; a band that isn't smaller than the page is not cut."""
    keep = F.lit(True)
    if 0 < top < height:
        keep &= F.col("top") >= top
    if 0 < bottom < height:
        keep &= F.col("bottom") <= height - bottom
    return objects.where(keep)


def large_images(images: DataFrame) -> DataFrame:
    return images.where(F.col("bottom") - F.col("top") >= LEAST_IMAGE).withColumn("encoded", F.base64("content"))


def real_tables(tables: DataFrame) -> DataFrame:
    """Tables (data array<array<string>>) of more than one row."""
    return tables.where(F.size("data") > 1)


def contents_spans(lines: DataFrame, page_height: float, gap: float = CONTENTS_GAP) -> DataFrame:
    """lines(doc_id, page, top, bottom, text) -> (doc_id, page, begin, end): where tables of contents stand, at most one a page.

    One begins with a heading and reaches to the last entry of its page; it goes on, on the next page, from the
    first entry there if the blank space between is below gap. Each page is summed up first; a fold over a document's pages, in order,
    carries the last page of a table and the room below it.
    """
    entry, head = F.col("text").rlike(CONTENTS_ENTRY), F.col("text").rlike(f"(?i){CONTENTS_HEADING}")
    of_page = lines.groupBy("doc_id", "page").agg(
        F.min(F.when(head, F.col("top"))).alias("head"), F.min(F.when(entry, F.col("top"))).alias("first"), F.max_by(F.when(entry, F.col("bottom")), F.when(entry, F.col("top"))).alias("last")
    ).where("head is not null or first is not null")  # others end a table as a missing page does
    pages = of_page.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "head", "first", "last"))).alias("pages"))
    span = "struct<page:int,begin:double,end:double>"
    none = F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("double").alias("room"), F.array().cast(f"array<{span}>").alias("found"))

    def step(s: Column, p: Column) -> Column:
        goes_on = p["head"].isNull() & F.coalesce(p["page"] == s["at"] + 1, F.lit(False)) & p["first"].isNotNull()
        begin = F.when(p["head"].isNotNull() & p["first"].isNotNull(), p["head"]).when(goes_on & F.coalesce(p["first"] + s["room"] < gap, F.lit(False)), p["first"])
        at = F.when(p["head"].isNotNull() | goes_on, p["page"].cast("int")).otherwise(s["at"])
        here = F.struct(p["page"].cast("int").alias("page"), begin.cast("double").alias("begin"), p["last"].cast("double").alias("end"))
        found = F.when(begin.isNotNull(), F.array_append(s["found"], here)).otherwise(s["found"])
        return F.struct(at.alias("at"), F.when(begin.isNotNull(), (page_height - p["last"]).cast("double")).otherwise(s["room"]).alias("room"), found.alias("found"))

    found = pages.select("doc_id", F.explode(F.aggregate("pages", none, step)["found"]).alias("s"))
    return found.select("doc_id", "s.page", "s.begin", "s.end")


def outside_contents(lines: DataFrame, page_height: float, gap: float = CONTENTS_GAP) -> DataFrame:
    """lines(doc_id, page, top, bottom, text) without tables of contents (see contents_spans)."""
    spans = contents_spans(lines, page_height, gap)
    placed = lines.join(spans, ["doc_id", "page"], "left")
    return placed.where(F.col("begin").isNull() | (F.col("bottom") <= F.col("begin")) | (F.col("top") >= F.col("end"))).select(*lines.columns)
