"""Set work on task tables: subsets, splits, upserts and what is left to run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.plans.lookups import attach


def subset_by_ids(wanted: DataFrame, available: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Available rows that are wanted, and wanted ids that are missing."""
    ids = wanted.select(key).distinct()
    matched = available.join(ids, key, "left_semi")
    missing = ids.join(available.select(key), key, "left_anti")
    return matched, missing


def subset_manifest(matched: DataFrame, missing: DataFrame, key: str) -> DataFrame:
    """Status and id of every wanted task; the listing of a manifest without one growing array."""
    rows = matched.select(F.lit("matched").alias("status"), F.col(key))
    return rows.unionByName(missing.select(F.lit("missing").alias("status"), F.col(key)))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy().agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(F.col("status") == "matched").alias("matched"),
        F.count_if(F.col("status") == "missing").alias("missing"),
    )


def latest_by_position(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: the one with the largest position."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), position).alias("_r")).select("_r.*")


def upsert_tasks(target: DataFrame, base: DataFrame, wanted: DataFrame, key: str, position: str, tag: str) -> DataFrame:
    """Target rows with ``tag`` added to the wanted ones, wanted base rows appended, absent ids reported.

    Of several rows with one id the last position counts, as an index by id would keep it; the earlier rows
    stay untouched.  ``outcome`` says kept, tagged, added or missing.
    """
    ids = wanted.select(key).distinct().withColumn("_wanted", F.lit(True))
    last = target.groupBy(key).agg(F.max(position).alias("_last"))
    known = attach(attach(target, last, [key]), ids, [key])
    hit = F.coalesce(F.col("_wanted"), F.lit(False)) & (F.col(position) == F.col("_last"))
    tagged = F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.array(F.lit(tag)))
    present = known.select(
        key, position, F.when(hit, tagged).otherwise(F.col("sources")).alias("sources"),
        F.when(hit, "tagged").otherwise("kept").alias("outcome"),
    )
    absent = ids.join(last, key, "left_anti")
    found = attach(absent, latest_by_position(base, key, position), [key])
    added = found.select(
        key, position,
        F.when(F.col(position).isNotNull(), F.array(F.lit(tag))).alias("sources"),
        F.when(F.col(position).isNotNull(), "added").otherwise("missing").alias("outcome"),
    )
    return present.unionByName(added)


def remaining_samples(expected: DataFrame, runs: DataFrame, overall: DataFrame) -> DataFrame:
    """Expected (agent, task, sample) rows without a record, for pairs that have no overall file."""
    pair = ["agent", "task"]
    open_pairs = expected.join(overall.select(*pair).distinct(), pair, "left_anti")
    return open_pairs.join(runs.select(*pair, "sample").distinct(), [*pair, "sample"], "left_anti")


def unknown_samples(expected: DataFrame, runs: DataFrame) -> DataFrame:
    """Finished samples that nobody expected."""
    key = ["agent", "task", "sample"]
    return runs.select(*key).distinct().join(expected, key, "left_anti")


def first_records(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first record of every sample, later ones are dropped."""
    rest = [c for c in runs.columns if c not in keys]
    first = runs.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return first.select(*keys, "_r.*")


def unfinished_tasks(configs: DataFrame, scores: DataFrame, renders: DataFrame, key: str) -> DataFrame:
    """Tasks without a rendered page or without a final score."""
    best = scores.groupBy(key).agg(F.max("score").alias("score"))
    joined = attach(attach(configs, best, [key]), renders.select(key).distinct().withColumn("_r", F.lit(1)), [key])
    return joined.where(F.col("_r").isNull() | (F.coalesce(F.col("score"), F.lit(-1.0)) < 0)).select(*configs.columns)


def filter_by_split(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows with ``in_split``: whether their id is listed."""
    listed = ids.select(key).distinct().withColumn("_listed", F.lit(True))
    found = attach(rows, listed, [key])
    return found.withColumn("in_split", F.coalesce(F.col("_listed"), F.lit(False))).drop("_listed")


def skip_existing_episodes(wanted: DataFrame, existing: DataFrame, min_timesteps: int = 1000) -> DataFrame:
    """Wanted episodes (name, length) without a finished folder of that name, long enough to convert."""
    done = existing.select(F.substring_index("name", "_contractor_nmFrm", 1).alias("name")).distinct()
    return wanted.join(done, "name", "left_anti").where(F.col("length") >= min_timesteps)


def first_by_position(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """First occurrence of every id."""
    return first_records(rows, keys, position)


def valid_samples(samples: DataFrame, least_distance: float, marker: str = "This is an invalid example") -> DataFrame:
    """Samples whose screenshots differ enough and whose instruction is not marked as invalid."""
    return samples.where((F.col("distance") >= least_distance) & ~F.col("instruction").contains(marker))
