"""Element boxes of a page: labels, centres and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.plans.lookups import attach
from trailmark.plans.sequences import Scan, numbered, running


def inside_viewport(left: float, top: float, width: float, height: float) -> Column:
    """Boxes that touch the viewport and cover at most 80% of it."""
    area = F.col("width") * F.col("height")
    return (
        (F.col("bottom") - top >= 0) & (F.col("top") - top <= height) & (F.col("right") - left >= 0)
        & (F.col("left") - left <= width) & (area <= 0.8 * width * height)
    )


def box_content() -> Column:
    """Image text and element text without line breaks and tabs, at most 200 characters of the latter."""
    alt = F.when(F.col("element") == "IMG", F.coalesce("alt", F.lit(""))).otherwise(F.lit(""))
    text = F.regexp_replace(F.trim(F.coalesce("text_content", F.lit(""))), r"[\n\t]", "")
    return F.concat(alt, F.substring(text, 1, 200))


def label_boxes(boxes: DataFrame, left: float, top: float, width: float, height: float) -> DataFrame:
    """Interactable boxes of a page numbered from 1 in box order, with centre and size."""
    seen = boxes.where(inside_viewport(left, top, width, height) & F.col("interactable"))
    labelled = numbered(seen, ["page_id"], ["id"], "label")
    return labelled.select(
        "page_id", "id", "label",
        ((F.col("left") + F.col("right")) / 2 - left).alias("center_x"),
        ((F.col("top") + F.col("bottom")) / 2 - top).alias("center_y"), "width", "height",
    )


def text_lines(
    boxes: DataFrame, left: float, top: float, width: float, height: float, least_width: float = 0, least_height: float = 0
) -> DataFrame:
    """Lines of a page's boxes, in box order: every interactable box with its label, and every static text that no box
    before it showed.

    Interactable boxes below the least size keep their label, but have no line. Style rules are no static text; the text
    of an interactable box hides the same static text behind it, whatever it is.
    """
    seen = boxes.where(inside_viewport(left, top, width, height)).withColumn("content", box_content())
    labels = {"label": Scan("sum", F.when(F.col("interactable"), 1).otherwise(0))}
    seen = running(seen, ["page_id"], ["id"], labels)
    large = (F.col("width") >= least_width) & (F.col("height") >= least_height)
    static = (F.col("content") != "") & ~(F.col("content").startswith(".") & F.col("content").contains("{"))
    told = seen.where(F.when(F.col("interactable"), large).otherwise(static))
    told = told.select("page_id", "id", "interactable", "label", "element", "content")
    first = told.groupBy("page_id", "content").agg(F.min("id").alias("id")).withColumn("_first", F.lit(True))
    marked = attach(told, first, ["page_id", "content", "id"]).where(F.col("interactable") | F.col("_first"))
    head = F.when(F.col("interactable"), F.concat(F.lit("["), F.col("label").cast("string"), F.lit("] ["), F.col("element"), F.lit("] [")))
    return marked.select(
        "page_id", "id", F.concat(F.coalesce(head, F.lit("[] [StaticText] [")), F.col("content"), F.lit("]")).alias("line")
    )


def rectangles_overlap(a: list[Column], b: list[Column], padding: float) -> Column:
    return ~(
        (a[2] < b[0] + padding) | (a[0] > b[2] - padding) | (a[1] > b[3] - padding) | (a[3] < b[1] + padding)
    )


def label_overlaps(labels: DataFrame, padding: float, cell: float) -> DataFrame:
    """Labels (page_id, id, x1, y1, x2, y2) that overlap a label with a smaller id on the same page.

    Every label is written into each cell of ``cell`` units that it touches, so labels that overlap share a cell
    whatever their sizes, and the join key is far finer than a page.  It is a semi-join: the search for a label
    ends at the first overlap, no pairs are produced.
    """
    reach = max(0.0, -padding)

    def cells(low: str, high: str) -> Column:
        ends = [F.floor((F.col(c) + d) / cell) for c, d in ((low, -reach), (high, reach))]
        return F.sequence(F.least(*ends), F.greatest(*ends))

    asking = labels.withColumn("cx", F.explode(cells("x1", "x2"))).withColumn("cy", F.explode(cells("y1", "y2")))
    placed = asking.select(
        "page_id", F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")], "cx", "cy"
    )
    here = [asking[c] for c in ("x1", "y1", "x2", "y2")]
    there = [placed[c] for c in ("_x1", "_y1", "_x2", "_y2")]
    condition = (
        (asking["page_id"] == placed["page_id"]) & (asking["cx"] == placed["cx"]) & (asking["cy"] == placed["cy"])
        & (placed["_id"] < asking["id"]) & rectangles_overlap(here, there, padding)
    )
    return asking.join(placed, condition, "left_semi").select(*labels.columns).distinct()
