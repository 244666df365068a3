"""Steps into twelve buckets: domain tertile by relative position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import DOMAIN_GROUPS, REL_BINS, norm_domain, rel_bin, rel_position, safe_int
from trailmark.plans.lookups import attach
from trailmark.plans.ranking import global_rank_by_count


def normalise_steps(steps: DataFrame) -> DataFrame:
    """Steps with a clean domain and a whole step number."""
    return steps.withColumn("website_name", norm_domain(F.col("website_name"))).withColumn(
        "step_no", safe_int(F.col("step_id"))
    )


def domain_summary(steps: DataFrame) -> DataFrame:
    """Rows per domain."""
    return steps.groupBy(norm_domain(F.col("website_name")).alias("website_name")).agg(
        F.count(F.lit(1)).alias("count")
    )


def task_ranges(steps: DataFrame) -> DataFrame:
    """Smallest and largest step of each task; rows without a task id are left out."""
    return (
        steps.where(F.coalesce(F.col("task_id").cast("string"), F.lit("")) != "")
        .groupBy("task_id")
        .agg(F.min(safe_int(F.col("step_id"))).alias("min_step"), F.max(safe_int(F.col("step_id"))).alias("max_step"))
    )


def with_rel_position(steps: DataFrame) -> DataFrame:
    """Add ``rel`` and ``rel_bin``; task ranges are aggregated and joined back, one row per task."""
    placed = attach(normalise_steps(steps), task_ranges(steps), ["task_id"])
    lo = F.coalesce(F.col("min_step"), F.lit(0))
    hi = F.coalesce(F.col("max_step"), F.lit(0))
    known = F.col("min_step").isNotNull()
    rel = F.when(known, rel_position(F.col("step_no"), lo, hi)).otherwise(F.lit(0.0))
    return placed.withColumn("rel", rel).withColumn("rel_bin", rel_bin(F.col("rel")))


def candidate_groups(steps: DataFrame) -> DataFrame:
    """Rows per domain and bin with their share of the domain."""
    counts = (
        with_rel_position(steps).groupBy("website_name", "rel_bin").agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counts.groupBy("website_name").agg(F.sum("count").alias("within_total"))
    return counts.join(totals, "website_name").withColumn(
        "pct_within_domain", F.col("count") / F.col("within_total")
    )


def tertile(rank0: Column, total: Column) -> Column:
    """Group of a 0-based rank; the first ``total % 3`` groups hold one row more."""
    size, extra = F.floor(total / 3), total % 3
    first = size + F.when(extra > 0, 1).otherwise(0)
    second = first + size + F.when(extra > 1, 1).otherwise(0)
    return (
        F.when(rank0 < first, DOMAIN_GROUPS[0]).when(rank0 < second, DOMAIN_GROUPS[1]).otherwise(DOMAIN_GROUPS[2])
    )


def domain_tertiles(steps: DataFrame) -> DataFrame:
    """Group of every domain: by row count descending, then name."""
    ranked = global_rank_by_count(domain_summary(steps), "website_name", "count")
    return ranked.select("website_name", "count", tertile(F.col("rank0"), F.col("total")).alias("group"))


def assign_domain_group(steps: DataFrame, groups: DataFrame) -> DataFrame:
    """Look up the domain's group; a missing or blank group is the lowest one."""
    table = groups.select("website_name", F.col("group").alias("domain_group"))
    found = attach(steps, table, ["website_name"])
    lowest = F.lit(DOMAIN_GROUPS[2])
    return found.withColumn(
        "domain_group", F.coalesce(F.nullif(F.trim(F.col("domain_group")), F.lit("")), lowest)
    )


def assign_buckets(steps: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Every step with ``domain_group``, ``rel_bin`` and ``bucket``."""
    groups = domain_tertiles(steps) if groups is None else groups
    placed = assign_domain_group(with_rel_position(steps), groups)
    return placed.withColumn("bucket", F.concat_ws("|", "domain_group", "rel_bin"))


def bucket_counts(steps: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Rows per bucket. Rows are counted per domain first, so the group lookup joins counts, not rows."""
    groups = domain_tertiles(steps) if groups is None else groups
    per_domain = with_rel_position(steps).groupBy("website_name", "rel_bin").agg(F.count(F.lit(1)).alias("_rows"))
    # At most four rows per domain are left, so no domain can dominate this lookup.
    placed = assign_domain_group(per_domain, groups)
    return (
        placed.withColumn("bucket", F.concat_ws("|", "domain_group", "rel_bin"))
        .groupBy("bucket")
        .agg(F.sum("_rows").alias("count"))
    )


def group_bin_matrix(buckets: DataFrame) -> DataFrame:
    """Bucket counts as one row per group: counts and row shares of the four bins, zero where empty."""
    group = F.substring_index("bucket", "|", 1)
    bin_name = F.substring_index("bucket", "|", -1)
    cells = [
        F.sum(F.when(bin_name == name, F.col("count")).otherwise(0)).alias(f"q{i}")
        for i, name in enumerate(REL_BINS, start=1)
    ]
    wide = buckets.groupBy(group.alias("domain_group")).agg(*cells, F.sum("count").alias("total"))
    return wide.select("*", *[(F.col(f"q{i}") / F.col("total")).alias(f"q{i}_share") for i in range(1, 5)])


def load_group_map(lookup: DataFrame, steps: DataFrame) -> DataFrame:
    """Groups from a lookup table; when it names no domain at all, computed from the steps.

    Whether the lookup is usable is decided inside the plan, by a subquery.
    """
    name = F.trim(F.coalesce(F.col("website_name"), F.lit("")))
    group = F.coalesce(F.nullif(F.trim(F.col("group")), F.lit("")), F.lit(DOMAIN_GROUPS[2]))
    given = lookup.where(name != "").groupBy(name.alias("website_name")).agg(F.max(group).alias("group"))
    fallback = domain_tertiles(steps).select("website_name", "group").where(~given.exists())
    return given.unionByName(fallback)
