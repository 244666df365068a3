"""Queries: domains, relative positions, buckets."""

from pyspark.sql import functions as F

from trailmark.catalog import views as v
from trailmark.catalog.registry import query
from trailmark.operators import bucketing as b
from trailmark.sources import readers


@query("bucket_counts", "D4 A1 B2 B3", f"WITH {v.BUCKETS} SELECT bucket, count(*) AS count FROM buckets GROUP BY bucket")
def bucket_counts(t):
    return b.bucket_counts(v.domain_steps(t))


@query("domain_summary", "D1", f"WITH {v.DOMAIN_STEPS} SELECT website_name, count(*) AS count FROM domain_steps GROUP BY 1")
def domain_summary(t):
    return b.domain_summary(v.domain_steps(t))


@query("candidate_groups", "D2", f"""WITH {v.DOMAIN_STEPS}, {v.RANGES},
c AS (SELECT website_name, rel_bin, count(*) AS count FROM binned GROUP BY 1, 2)
SELECT website_name, rel_bin, count, CAST(sum(count) OVER (PARTITION BY website_name) AS BIGINT) AS within_total,
       count::DOUBLE / sum(count) OVER (PARTITION BY website_name) AS pct_within_domain FROM c""")
def candidate_groups(t):
    return b.candidate_groups(v.domain_steps(t))


@query("task_ranges", "D3", f"WITH {v.DOMAIN_STEPS}, {v.RANGES} SELECT task_id, lo AS min_step, hi AS max_step FROM ranges")
def task_ranges(t):
    return b.task_ranges(v.domain_steps(t))


@query("rel_position", "B4 E3", f"WITH {v.DOMAIN_STEPS}, {v.RANGES} SELECT page_id, rel, rel_bin FROM binned")
def rel_position(t):
    return b.with_rel_position(v.domain_steps(t)).select("page_id", "rel", "rel_bin")


@query("domain_tertiles", "E2", f"WITH {v.DOMAIN_STEPS}, {v.TERTILES} SELECT website_name, n AS count, grp AS \"group\" FROM tertiles")
def domain_tertiles(t):
    return b.domain_tertiles(v.domain_steps(t))


@query("domain_tertiles_ties", "E2", """SELECT source AS website_name, count(*) AS count,
  CASE ntile(3) OVER (ORDER BY count(*) DESC, source) WHEN 1 THEN 'G1_High' WHEN 2 THEN 'G2_Mid' ELSE 'G3_Low' END AS "group"
  FROM documents GROUP BY source""")
def domain_tertiles_ties(t):
    return b.domain_tertiles(t.documents.select(F.col("source").alias("website_name")))


@query("assign_domain_group", "C1", f"""WITH {v.DOMAIN_STEPS}, {v.TERTILES}
SELECT page_id, website_name, coalesce(grp, 'G3_Low') AS domain_group
FROM domain_steps LEFT JOIN (SELECT * FROM tertiles WHERE n > 3) USING (website_name)""")
def assign_domain_group(t):
    steps = v.domain_steps(t)
    groups = b.domain_tertiles(steps).where("count > 3")
    return b.assign_domain_group(steps, groups).select("page_id", "website_name", "domain_group")


@query("assign_buckets", "C1 E3", f"WITH {v.BUCKETS} SELECT page_id, grp AS domain_group, rel_bin, bucket FROM buckets")
def assign_buckets(t):
    return b.assign_buckets(v.domain_steps(t)).select("page_id", "domain_group", "rel_bin", "bucket")


@query("group_bin_matrix", "D5", f"""WITH {v.BUCKETS}
SELECT grp AS domain_group, count(*) FILTER (rel_bin LIKE 'Q1%') AS q1, count(*) FILTER (rel_bin LIKE 'Q2%') AS q2,
  count(*) FILTER (rel_bin LIKE 'Q3%') AS q3, count(*) FILTER (rel_bin LIKE 'Q4%') AS q4, count(*) AS total,
  q1::DOUBLE / total AS q1_share, q2::DOUBLE / total AS q2_share, q3::DOUBLE / total AS q3_share, q4::DOUBLE / total AS q4_share
FROM buckets GROUP BY grp""")
def group_bin_matrix(t):
    return b.group_bin_matrix(b.bucket_counts(v.domain_steps(t)))


@query("load_group_map", "A7", f"""WITH {v.DOMAIN_STEPS}, {v.TERTILES},
lookup AS (SELECT website_name, CASE WHEN n % 2 = 0 THEN '' ELSE grp END AS grp FROM tertiles)
SELECT website_name, CASE WHEN grp = '' THEN 'G3_Low' ELSE grp END AS "group" FROM lookup""")
def load_group_map(t):
    steps = v.domain_steps(t)
    lookup = b.domain_tertiles(steps).withColumn("group", F.when(F.col("count") % 2 == 0, "").otherwise(F.col("group")))
    return b.load_group_map(lookup, steps)


@query("load_group_map_empty", "A7", f"WITH {v.DOMAIN_STEPS}, {v.TERTILES} SELECT website_name, grp AS \"group\" FROM tertiles")
def load_group_map_empty(t):
    steps = v.domain_steps(t)
    return b.load_group_map(b.domain_tertiles(steps).where("count < 0"), steps)


@query("normalise_steps", "A1", """SELECT '' || conv_id AS task_id, '' || turn AS step_id,
  CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS chosen_action, CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END AS n_rejected
  FROM conversations""")
def normalise_steps(t):
    raw = t.conversations.select(
        F.col("conv_id").cast("string").alias("task_id"), F.col("turn").cast("string").alias("step_id"),
        F.to_json(F.struct(
            F.lit("").alias("thought"),
            F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("action"),
        )).alias("chosen"),
        F.when(F.col("turn") % 3 == 0, "[]").when(F.col("turn") % 3 == 1, '{"thought":"t","action":"a"}')
        .otherwise('[{"thought":"t","action":"a"}]').alias("rejected"),
    )
    steps = readers.normalise_pair_shapes(raw)
    return steps.select("task_id", "step_id", F.col("chosen.action").alias("chosen_action"),
                        F.size("rejected").cast("long").alias("n_rejected"))
