"""Ordered per-group operators that split large groups over many tasks.

A plain ``Window.partitionBy(keys)`` sends all rows of a key to one task.  The functions here count the groups first, by
one map-side combined aggregate over the key columns, and choose the plan from what they find:

* no group of more than ``trailmark.blockRows`` rows: the plain window, one shuffle;
* otherwise the rows are range-partitioned by keys and order and stored once with the number of their partition, so
  hot keys, null keys, equal leading values and long common prefixes are all cut where their rows lie.  ``running``
  computes prefix aggregates inside each partition and adds the totals of the same key's earlier partitions;
  ``numbered`` is ``running`` over a count; ``framed`` evaluates bounded frames on fixed-size blocks of positions, each
  with a halo of copies.

The number of partitions follows the shuffle partitions, a key has as many totals as partitions, and nothing is
broadcast or collected.  An operator counts its input once and hands the result to all its steps.  Rows of one key with
equal values in all order columns share a partition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from trailmark.plans.lineage import cut, store

BLOCK_ROWS_CONF = "trailmark.blockRows"
DEFAULT_BLOCK_ROWS = 1_000_000


@dataclass(frozen=True)
class Scan:
    """One prefix aggregate: ``kind`` is sum, count, max, min or last (last non-null value)."""

    kind: str
    value: Column
    exclusive: bool = False


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))


def order_columns(order: list[str]) -> list[Column]:
    """``"-name"`` sorts descending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


@dataclass(frozen=True)
class GroupSizes:
    """The large groups of a table by some keys: their keys as a stored table, or None when there are none."""

    keys: tuple[str, ...]
    large: DataFrame | None


def measure(df: DataFrame, keys: list[str]) -> GroupSizes:
    """Find the groups of more than ``block_rows`` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tm_n")).where(F.col("_tm_n") > block_rows(df.sparkSession))
    if counts.isEmpty():
        return GroupSizes(tuple(keys), None)
    return GroupSizes(tuple(keys), store(counts.select(*keys, "_tm_n"), "large"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality on the keys, null being equal to null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def settle(df: DataFrame, sizes: GroupSizes) -> DataFrame:
    """Write the rows between two steps of a split plan.

    A split step reads its input twice.  Steps on top of each other would double the work every time, so
    operators of several steps settle in between; plain plans stay lazy.
    """
    return df if sizes.large is None else cut(df)


def _fitting(sizes: GroupSizes | None, df: DataFrame, keys: list[str]) -> GroupSizes:
    """The given sizes when they were measured for these keys, else fresh ones."""
    return sizes if sizes is not None and sizes.keys == tuple(keys) else measure(df, keys)


def _placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows in ranges of keys and order, stored with the number of their range as ``_tm_part``."""
    ranged = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order_columns(order))
    return store(ranged.withColumn("_tm_part", F.spark_partition_id()), "ranges")


def _aggregate(kind: str, value: Column) -> Column:
    return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[kind](value)


def _plain_running(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, Scan]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order_columns(order))
    made = []
    for name, scan in cols.items():
        frame = window.rowsBetween(Window.unboundedPreceding, -1 if scan.exclusive else 0)
        if scan.kind == "last":
            value = F.last(scan.value, ignorenulls=True).over(frame)
        elif scan.kind == "count":
            value = F.count(scan.value).over(frame)
        else:
            value = _aggregate(scan.kind, scan.value).over(frame)
        made.append(value.alias(name))
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, *made)


def running(
    df: DataFrame, keys: list[str], order: list[str], cols: dict[str, Scan], sizes: GroupSizes | None = None
) -> DataFrame:
    """Add prefix aggregates over each group in ``order``; no task holds a whole large group.

    ``order`` must name the rows of a group uniquely for results that do not depend on ties.
    """
    sizes = _fitting(sizes, df, keys)
    if sizes.large is None:
        return _plain_running(df, keys, order, cols)
    work = df
    for name, scan in cols.items():
        value = F.when(scan.value.isNotNull(), 1).otherwise(0).cast("long") if scan.kind == "count" else scan.value
        work = work.withColumn(f"_v_{name}", value)
    work = _placed(work, keys, order)
    local_window = Window.partitionBy(*keys, "_tm_part").orderBy(*order_columns(order))
    local, totals, at_end = [], [], F.struct(F.col("_tm_end"))
    for name, scan in cols.items():
        frame = local_window.rowsBetween(Window.unboundedPreceding, -1 if scan.exclusive else 0)
        value = F.col(f"_v_{name}")
        if scan.kind == "last":
            local.append(F.last(value, ignorenulls=True).over(frame).alias(f"_l_{name}"))
            totals.append(F.max_by(value, F.when(value.isNotNull(), at_end)).alias(f"_t_{name}"))
        else:
            local.append(_aggregate(scan.kind, value).over(frame).alias(f"_l_{name}"))
            totals.append(_aggregate(scan.kind, value).alias(f"_t_{name}"))
    work = work.select("*", *local, F.row_number().over(local_window).alias("_tm_end"))
    # One row per key and range in which it has rows.
    part_totals = work.groupBy(*keys, "_tm_part").agg(*totals)
    earlier = Window.partitionBy(*keys).orderBy("_tm_part").rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for name, scan in cols.items():
        total = F.col(f"_t_{name}")
        carry = F.last(total, ignorenulls=True) if scan.kind == "last" else _aggregate(scan.kind, total)
        carries.append(carry.over(earlier).alias(f"_c_{name}"))
    carry = part_totals.select(*keys, "_tm_part", *carries)
    # The window output is already partitioned by (keys, range), so only the carries shuffle.
    on = same_keys(work, carry, [*keys, "_tm_part"])
    out = work.join(carry, on, "left").select(work["*"], *[carry[f"_c_{name}"] for name in cols])
    results = []
    for name, scan in cols.items():
        here, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if scan.kind == "count":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        elif scan.kind == "sum":
            value = F.coalesce(here + before, here, before)
        elif scan.kind == "max":
            value = F.greatest(here, before)
        elif scan.kind == "min":
            value = F.least(here, before)
        else:
            value = F.coalesce(here, before)
        results.append(value.alias(name))
    kept = [c for c in df.columns if c not in cols]
    return out.select(*kept, *results)


def numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str, sizes: GroupSizes | None = None
) -> DataFrame:
    """Add the 1-based position of each row in its group."""
    return running(df, keys, order, {name: Scan("count", F.lit(1))}, sizes)


def framed(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    cols: dict[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` rows back and ``after`` rows ahead."""
    sizes = _fitting(sizes, df, keys)
    window = Window.partitionBy(*keys).orderBy(*order_columns(order))
    plain = [make(window).alias(name) for name, make in cols.items()]
    if sizes.large is None:
        return df.select(*df.columns, *plain)
    large, size, split = sizes.large, max(block_rows(df.sparkSession), before, after, 1), df
    if keys:
        split = df.join(large, same_keys(df, large, keys), "left_semi")
    placed = numbered(split, keys, order, "_at", sizes)
    block = F.floor((F.col("_at") - 1) / size)
    offset = (F.col("_at") - 1) % size

    def copy(block_id: Column, halo: bool) -> Column:
        return F.struct(block_id.cast("long").alias("_part"), F.lit(halo).alias("_halo"))

    copies = [copy(block, False)]
    if before:
        copies.append(F.when(offset >= size - before, copy(block + 1, True)))
    if after:
        copies.append(F.when((offset < after) & (block > 0), copy(block - 1, True)))
    parts = placed.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
    parts = parts.select(*df.columns, "_at", "_copy._part", "_copy._halo")
    within = Window.partitionBy(*keys, "_part").orderBy("_at")
    framed_parts = (
        parts.select("*", *[make(within).alias(name) for name, make in cols.items()])
        .where(~F.col("_halo"))
        .select(*df.columns, *cols)
    )
    if not keys:
        return framed_parts
    whole = df.join(large, same_keys(df, large, keys), "left_anti").select(*df.columns, *plain)
    return whole.unionByName(framed_parts)
