"""Joins of a large table to a table with unique keys."""

from __future__ import annotations

from pyspark.sql import DataFrame


def attach(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Add the columns of ``table``, which has each key once, to the rows of ``df``.

    A plain equi-join of few columns: Spark broadcasts a small table and splits the partitions of dominant keys at run
    time (``spark.sql.adaptive.skewJoin``), which works for the left side of inner and left joins.
    """
    return df.join(table, on, how).select(*df.columns, *[c for c in table.columns if c not in on])
