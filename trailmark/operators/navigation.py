"""Navigation links found in observation text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.observations import LINK_LINE
from trailmark.functions.text import lines, strip
from trailmark.functions.urls import is_navigation_url


def navigation_links(steps: DataFrame, keys: list[str], preferred: tuple[str, ...] = ()) -> DataFrame:
    """One row per link line that leads to another page, with its line position and preference flag."""
    flat = steps.select(*keys, "url", F.posexplode(lines(F.col("text_observation"))).alias("pos", "_line"))
    line = strip(F.col("_line"))
    links = flat.where(line.rlike(LINK_LINE)).select(
        *keys, "url", "pos",
        F.regexp_extract(line, LINK_LINE, 1).alias("element_id"),
        F.regexp_extract(line, LINK_LINE, 2).alias("label"),
        F.regexp_extract(line, LINK_LINE, 3).alias("link_url"),
    )
    is_preferred = F.col("link_url").endswith(".html")
    for word in preferred:
        is_preferred = is_preferred | F.col("link_url").contains(word)
    return links.where(
        ~F.lower("label").contains("quick view") & is_navigation_url(F.col("link_url"), F.col("url"))
    ).withColumn("preferred", is_preferred)


def first_nav_candidate(steps: DataFrame, keys: list[str], preferred: tuple[str, ...] = ()) -> DataFrame:
    """The first link of each step with links, preferred ones first, and how many links there are; row by row."""

    def link(raw: Column, pos: Column) -> Column:
        line = strip(raw)
        url, label = F.regexp_extract(line, LINK_LINE, 3), F.regexp_extract(line, LINK_LINE, 2)
        wanted = reduce(lambda a, b: a | b, [url.contains(w) for w in preferred], url.endswith(".html"))
        leads = line.rlike(LINK_LINE) & ~F.lower(label).contains("quick view") & is_navigation_url(url, F.col("url"))
        made = F.struct(
            (~wanted).alias("later"), pos.alias("pos"), F.regexp_extract(line, LINK_LINE, 1).alias("element_id"),
            label.alias("label"), url.alias("link_url"),
        )
        return F.when(leads, made)

    found = F.array_compact(F.transform(lines(F.col("text_observation")), link))
    best = steps.select(*keys, F.array_min(found).alias("_best"), F.size(found).cast("long").alias("num_candidates"))
    return best.where(F.col("num_candidates") > 0).select(
        *keys, F.col("_best.element_id").alias("candidate_eid"), F.col("_best.label").alias("candidate_label"),
        F.col("_best.link_url").alias("candidate_url"), "num_candidates",
    )
