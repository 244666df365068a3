"""Queries: task sets and scores."""

from pyspark.sql import functions as F

from trailmark.catalog.registry import query
from trailmark.operators import scoring as s
from trailmark.operators import tasks as k
from trailmark.operators.episodes import every_nth as every_nth_row
from trailmark.sources.readers import run_log_results, task_scores_from_json

RATE = "count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS fail, round_even(count(*) FILTER (success)::DOUBLE / count(*), 4) * 100 AS success_rate"
CFG = """cfg AS (SELECT doc_id AS task_id, doc_id + 5000 AS old_task_id, CASE doc_id % 4 WHEN 0 THEN ['shopping'] WHEN 1 THEN ['map', 'wikipedia'] WHEN 2 THEN ['reddit', 'gitlab'] ELSE ['gitlab'] END AS sites,
 CASE doc_id % 3 WHEN 0 THEN ['string_match'] WHEN 1 THEN ['url_match'] ELSE ['string_match', 'url_match'] END AS eval_types, CASE WHEN doc_id % 6 = 0 THEN 'N/A' ELSE 'x' END AS fuzzy FROM documents),
res AS (SELECT doc_id AS task_id, quality = 1 AS success FROM labels)"""


def configs(t):
    return t.documents.selectExpr(
        "doc_id AS task_id", "doc_id + 5000 AS old_task_id",
        "CASE doc_id % 4 WHEN 0 THEN array('shopping') WHEN 1 THEN array('map', 'wikipedia') WHEN 2 THEN array('reddit', 'gitlab') ELSE array('gitlab') END AS sites",
        "CASE doc_id % 3 WHEN 0 THEN array('string_match') WHEN 1 THEN array('url_match') ELSE array('string_match', 'url_match') END AS eval_types",
        "CASE WHEN doc_id % 6 = 0 THEN 'N/A' ELSE 'x' END AS fuzzy_match",
    )


def results(t):
    return t.labels.selectExpr("doc_id AS task_id", "quality = 1 AS success")


@query("success_rate", "D14", f"WITH {CFG} SELECT {RATE} FROM res")
def success_rate(t):
    return s.success_rate(results(t), [])


@query("breakdown_by_site", "D15", f"WITH {CFG}, j AS (SELECT success, unnest(sites) AS site FROM res JOIN cfg USING (task_id)) SELECT site, {RATE} FROM j GROUP BY site")
def breakdown_by_site(t):
    return s.breakdown_by_site(results(t), configs(t))


@query("breakdown_by_type", "D16", f"WITH {CFG}, j AS (SELECT success, CASE WHEN eval_types = ['string_match'] THEN 'info_seeking' WHEN eval_types = ['url_match'] THEN 'site_nav' ELSE 'content_config' END AS task_type FROM res JOIN cfg USING (task_id)) SELECT task_type, {RATE} FROM j GROUP BY 1")
def breakdown_by_type(t):
    return s.breakdown_by_type(results(t), configs(t))


@query("breakdown_achievable", "D17", f"WITH {CFG}, j AS (SELECT success, NOT (eval_types = ['string_match'] AND fuzzy = 'N/A') AS achievable FROM res JOIN cfg USING (task_id)) SELECT achievable, {RATE} FROM j GROUP BY 1")
def breakdown_achievable(t):
    return s.breakdown_achievable(results(t), configs(t))


SCORES = "scores AS (SELECT o_custkey AS task_id, 'run' || (o_orderkey % 3) AS run_dir, CASE o_orderstatus WHEN 'O' THEN 0.0 WHEN 'F' THEN 1.0 ELSE 0.5 END AS score FROM orders)"


def scores(t):
    return t.orders.selectExpr("o_custkey AS task_id", "'run' || (o_orderkey % 3) AS run_dir", "CASE o_orderstatus WHEN 'O' THEN 0.0D WHEN 'F' THEN 1.0D ELSE 0.5D END AS score")


@query("pass_rate", "D18", f"WITH {SCORES} SELECT run_dir, count(*) AS finished, count(*) FILTER (score >= 1) AS passed, round_even(passed::DOUBLE / finished * 100, 2) AS partial_accuracy, round_even(passed::DOUBLE / 165 * 100, 2) AS overall_accuracy FROM scores GROUP BY run_dir")
def pass_rate(t):
    return s.pass_rate(scores(t), ["run_dir"], 165)


@query("best_of_runs", "D19", f"WITH {SCORES} SELECT task_id, max(score) AS score FROM scores GROUP BY task_id")
def best_of_runs(t):
    return s.best_of_runs(scores(t))


SITE = f"WITH {CFG}, {SCORES}, b AS (SELECT task_id, max(score) AS score FROM scores GROUP BY task_id), j AS (SELECT array_to_string(sites, ',') AS sites, old_task_id, coalesce(score, 0.0) AS score FROM cfg LEFT JOIN b USING (task_id))"


@query("site_pass_rate", "D20", f"{SITE} SELECT sites, round_even(avg(score) * 100, 1) AS rate, count(*) FILTER (score = 1) AS solved FROM j GROUP BY sites")
def site_pass_rate(t):
    return s.site_pass_rate(configs(t), scores(t))


@query("solved_ids", "D20", f"{SITE} SELECT sites, old_task_id FROM j WHERE score = 1")
def solved_ids(t):
    return s.solved_ids(configs(t), scores(t))


@query("export_score_vector", "A20", f"WITH {SCORES}, b AS (SELECT task_id, max(score) AS score FROM scores GROUP BY 1) SELECT c_custkey AS task_id, CASE WHEN score IS NULL THEN '' WHEN score >= 1 THEN '1.0' ELSE '0.0' END AS line FROM customer LEFT JOIN b ON task_id = c_custkey")
def export_score_vector(t):
    return s.export_score_vector(scores(t), t.customer.selectExpr("c_custkey AS task_id"), show_all=False)


REWARDS = "r AS (SELECT CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS success, (o_orderkey % 10)::DOUBLE / 20 AS initial_reward, (o_custkey % 10)::DOUBLE / 10 AS final_reward FROM orders)"


def rewards(t):
    return t.orders.selectExpr("CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS success", "cast(o_orderkey % 10 as double) / 20 AS initial_reward", "cast(o_custkey % 10 as double) / 10 AS final_reward")


def rounded(df, *names):
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


@query("reward_summary", "D21", f"WITH {REWARDS} SELECT count(*) AS total_count, count(*) FILTER (success) AS success_count, round(success_count::DOUBLE / total_count, 6) AS success_rate, round(sum(CASE WHEN success THEN 1.0 WHEN NOT success THEN greatest(0.0, final_reward) END) / count(*), 6) AS average_reward FROM r")
def reward_summary(t):
    return rounded(s.reward_summary(rewards(t), relative=False), "success_rate", "average_reward")


@query("reward_summary_relative", "D21", f"WITH {REWARDS} SELECT count(*) AS total_count, count(*) FILTER (success) AS success_count, round(success_count::DOUBLE / total_count, 6) AS success_rate, round(sum(CASE WHEN success THEN 1.0 WHEN NOT success THEN greatest(0.0, (final_reward - initial_reward) / (1.0 - initial_reward)) END) / count(*), 6) AS average_reward FROM r")
def reward_summary_relative(t):
    return rounded(s.reward_summary(rewards(t), relative=True), "success_rate", "average_reward")


@query("distance_summary", "D22", "SELECT l_returnflag, round(sum(l_discount) / count(*), 6) AS distance, round(count(*) FILTER (l_discount < l_tax * 2 - 0.05)::DOUBLE / count(*), 6) AS improve, round(count(*) FILTER (l_discount < 0.1)::DOUBLE / count(*), 6) AS em FROM lineitem GROUP BY 1")
def distance_summary(t):
    rows = t.lineitem.selectExpr("l_returnflag", "l_discount AS new_distance", "l_tax * 2 AS distance")
    return rounded(s.distance_summary(rows, ["l_returnflag"]), "distance", "improve", "em")


@query("distance_summary_fixed", "D22", "SELECT round(sum(l_discount) / 165, 4) AS distance, round(count(*) FILTER (l_discount < l_tax * 2 - 0.05)::DOUBLE / 165, 6) AS improve, round(count(*) FILTER (l_discount < 0.1)::DOUBLE / 165, 6) AS em FROM lineitem")
def distance_summary_fixed(t):
    rows = t.lineitem.selectExpr("l_discount AS new_distance", "l_tax * 2 AS distance")
    return rounded(s.distance_summary(rows, [], 165), "improve", "em").withColumn("distance", F.round("distance", 4))


@query("task_aggregates", "U1", "SELECT 'a' || (o_custkey % 3) AS agent, o_orderpriority AS task, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM orders GROUP BY 1, 2")
def task_aggregates(t):
    rows = t.orders.selectExpr("'a' || (o_custkey % 3) AS agent", "o_orderpriority AS task", "o_totalprice")
    families = {"prices": lambda g: g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))}
    return s.task_aggregates(rows, families, "prices")


@query("subset_by_ids", "C2 A18", "SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'matched' END AS status, w.id AS doc_id FROM (SELECT DISTINCT doc_id * 3 AS id FROM labels) w LEFT JOIN documents d ON d.doc_id = w.id")
def subset_by_ids(t):
    wanted = t.labels.select((F.col("doc_id") * 3).alias("doc_id"))
    matched, missing = k.subset_by_ids(wanted, t.documents.select("doc_id"), "doc_id")
    return k.subset_manifest(matched, missing, "doc_id")


@query("write_manifest", "A18", "SELECT count(*) AS requested, count(d.doc_id) AS matched, count(*) - count(d.doc_id) AS missing FROM (SELECT DISTINCT doc_id * 3 AS id FROM labels) w LEFT JOIN documents d ON d.doc_id = w.id")
def write_manifest(t):
    wanted = t.labels.select((F.col("doc_id") * 3).alias("doc_id"))
    matched, missing = k.subset_by_ids(wanted, t.documents.select("doc_id"), "doc_id")
    return k.manifest_counts(k.subset_manifest(matched, missing, "doc_id"))


UPSERT = """tgt AS (SELECT o_custkey AS id, o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'lite' ELSE '' END AS src FROM orders WHERE o_orderstatus = 'O'),
base AS (SELECT o_custkey AS id, max(o_orderkey) AS pos FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1), want AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 12),
lastp AS (SELECT id, max(pos) AS last FROM tgt GROUP BY id)"""


@query("upsert_tasks", "C3", f"""WITH {UPSERT}
SELECT tgt.id, pos, CASE WHEN w.id IS NOT NULL AND pos = last THEN CASE WHEN src = '' THEN 'web' ELSE src || ',web' END ELSE src END AS sources, CASE WHEN w.id IS NOT NULL AND pos = last THEN 'tagged' ELSE 'kept' END AS outcome
FROM tgt JOIN lastp ON lastp.id = tgt.id LEFT JOIN want w ON w.id = tgt.id
UNION ALL SELECT w.id, b.pos, CASE WHEN b.pos IS NULL THEN NULL ELSE 'web' END, CASE WHEN b.pos IS NULL THEN 'missing' ELSE 'added' END FROM want w ANTI JOIN lastp ON lastp.id = w.id LEFT JOIN base b ON b.id = w.id""")
def upsert_tasks(t):
    def part(status):
        return t.orders.where(f"o_orderstatus {status}").selectExpr(
            "o_custkey AS id", "o_orderkey AS pos", "CASE WHEN o_orderkey % 2 = 0 THEN array('lite') ELSE cast(array() as array<string>) END AS sources")

    wanted = t.customer.where("c_nationkey < 12").selectExpr("c_custkey AS id")
    out = k.upsert_tasks(part("= 'O'"), part("<> 'O'"), wanted, "id", "pos", "web")
    return out.withColumn("sources", F.array_join("sources", ","))


REMAIN = """expd AS (SELECT DISTINCT 'agent-' || (o_custkey % 7) AS agent, o_orderpriority AS task, o_orderkey AS sample FROM orders),
ran AS (SELECT DISTINCT 'agent-' || (o_custkey % 7) AS agent, o_orderpriority AS task, CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_orderkey END AS sample FROM orders WHERE o_orderstatus <> 'P'),
overall AS (SELECT 'agent-1' AS agent, '1-URGENT' AS task)"""


def remaining_inputs(t):
    base = t.orders.selectExpr("'agent-' || (o_custkey % 7) AS agent", "o_orderpriority AS task", "o_orderkey AS sample", "o_orderstatus")
    expected = base.select("agent", "task", "sample").distinct()
    ran = base.where("o_orderstatus <> 'P'").withColumn("sample", F.when(F.col("sample") % 50 == 0, -1).otherwise(F.col("sample")))
    overall = expected.where("agent = 'agent-1' AND task = '1-URGENT'").select("agent", "task").distinct()
    return expected, ran, overall


@query("remaining_samples", "C4", f"WITH {REMAIN} SELECT * FROM (SELECT * FROM expd ANTI JOIN overall USING (agent, task)) ANTI JOIN ran USING (agent, task, sample)")
def remaining_samples(t):
    return k.remaining_samples(*remaining_inputs(t))


@query("unknown_samples", "C4", f"WITH {REMAIN} SELECT * FROM ran ANTI JOIN expd USING (agent, task, sample)")
def unknown_samples(t):
    expected, ran, _ = remaining_inputs(t)
    return k.unknown_samples(expected, ran)


@query("first_records", "C4", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def first_records(t):
    return k.first_records(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("unfinished_tasks", "C5", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR d.doc_id % 5 = 0 OR (CASE WHEN quality = 1 THEN 1.0 ELSE -0.1 END) < 0")
def unfinished_tasks(t):
    score = t.labels.selectExpr("doc_id", "CASE WHEN quality = 1 THEN 1.0D ELSE -0.1D END AS score")
    return k.unfinished_tasks(t.documents.select("doc_id"), score, t.documents.where("doc_id % 5 <> 0").select("doc_id"), "doc_id")


@query("filter_by_split", "C6", "SELECT d.doc_id, l.doc_id IS NOT NULL AS in_split FROM documents d LEFT JOIN labels l USING (doc_id)")
def filter_by_split(t):
    return k.filter_by_split(t.documents.select("doc_id"), t.labels, "doc_id")


@query("skip_existing_episodes", "C19", "SELECT 'ep_' || d.doc_id AS name, n_chars AS length FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id WHERE n_chars >= 1000")
def skip_existing_episodes(t):
    wanted = t.documents.selectExpr("'ep_' || doc_id AS name", "n_chars AS length")
    existing = t.labels.selectExpr("'ep_' || doc_id || '_contractor_nmFrm' || (doc_id * 7) || '_term' AS name")
    return k.skip_existing_episodes(wanted, existing)


@query("expected_minus_logged", "F9", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def expected_minus_logged(t):
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id"))


@query("first_by_position", "F10", "SELECT role, conv_id, min(turn) AS turn FROM conversations GROUP BY 1, 2")
def first_by_position(t):
    return k.first_by_position(t.conversations.select("role", "conv_id", "turn"), ["role", "conv_id"], "turn")


@query("every_nth", "F6", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM documents) WHERE (pos - 1) % 7 = 0")
def every_nth(t):
    return every_nth_row(t.documents.select("doc_id"), ["doc_id"], 7)


@query("limit_rows", "F6", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def limit_rows(t):
    return t.documents.select("doc_id", "source").orderBy("doc_id").limit(100)


@query("read_task_scores", "A4", """SELECT run_dir, task_id, score FROM (SELECT 'run' || (event_id % 4) AS run_dir, CASE WHEN event_id % 6 = 0 THEN 1000 ELSE CAST(event_id AS INT) END AS task_id,
 CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN -0.1 WHEN 2 THEN 1.0 ELSE 0.5 END AS score FROM events WHERE event_id % 11 <> 0) WHERE score >= 0""")
def read_task_scores(t):
    text = F.expr("""CASE WHEN event_id % 11 = 0 THEN '[1, 2]' ELSE '{' || CASE WHEN event_id % 6 = 0 THEN '' ELSE '"task_id": ' || event_id || ', ' END
      || CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '"score": -0.1, ' WHEN 2 THEN '"score": 1.0, ' ELSE '"score": 0.5, ' END || '"actions": ["a"]}' END""")
    lines = t.events.select(F.expr("'run' || (event_id % 4)").alias("run_dir"), text.alias("value"))
    return task_scores_from_json(lines).select("run_dir", "task_id", "score")


LOG = "'start' || chr(10) || '[Config file]: /tmp/' || (doc_id % 50) || '.json' || chr(10) || text || chr(10) || '[Result] (' || CASE doc_id % 2 WHEN 0 THEN 'PASS' ELSE 'FAIL' END || ') x' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '[Result] (PASS) again' WHEN 1 THEN '[Config file]: cfg/' || doc_id || '.json' || chr(10) || '[Result] (FAIL)' ELSE 'end' END"


@query("parse_run_log", "A5", """SELECT doc_id AS file, CAST(doc_id % 50 AS INT) AS task_id, doc_id % 2 = 0 OR doc_id % 3 = 0 AS success FROM documents WHERE NOT (doc_id % 3 = 1 AND doc_id < 50)
UNION ALL SELECT doc_id, CAST(doc_id AS INT), false FROM documents WHERE doc_id % 3 = 1""")
def parse_run_log(t):
    lines = t.documents.select(F.col("doc_id").alias("file"), F.posexplode(F.split(F.expr(LOG), "\n")).alias("line", "value"))
    return run_log_results(lines, "file", ["line"])
