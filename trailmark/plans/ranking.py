"""Rank of a counted table over the whole table without a single-task sort of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.plans.lookups import attach
from trailmark.plans.sequences import numbered


def global_rank_by_count(counts: DataFrame, name: str, count: str) -> DataFrame:
    """Add ``rank0`` (0-based, by ``count`` descending then ``name``) and ``total`` rows.

    Rows with equal counts form classes.  Distinct counts that sum to N number at most sqrt(2N), so the
    table of classes stays small enough for the one unpartitioned window used here.
    """
    classes = counts.groupBy(count).agg(F.count(F.lit(1)).alias("_members"))
    order = Window.orderBy(F.col(count).desc())
    everything = Window.partitionBy()
    offsets = classes.select(
        count,
        (F.sum("_members").over(order) - F.col("_members")).alias("_before"),
        F.sum("_members").over(everything).alias("total"),
    )
    placed = numbered(counts, [count], [name], "_pos")
    ranked = attach(placed, offsets, [count], "inner")
    return ranked.select(*counts.columns, (F.col("_before") + F.col("_pos") - 1).alias("rank0"), "total")
