"""Queries: episodes, goals, rewards."""

from pyspark.sql import functions as F

from trailmark.catalog import views as v
from trailmark.catalog.registry import query
from trailmark.operators import episodes as e
from trailmark.plans import numbered
from trailmark.sources.readers import episode_urls

EPS = "eps AS (SELECT user_id AS episode_id, count(*) AS length FROM events GROUP BY 1)"
FRAMES = f"{v.KEYED_EVENTS}, fr AS (SELECT *, user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM keyed)"


def eps(t):
    return t.events.groupBy(F.col("user_id").alias("episode_id")).agg(F.count(F.lit(1)).alias("length"))


def frames(t):
    rows = v.keyed_events(t).withColumn("episode_id", F.col("user_id"))
    return numbered(rows, ["episode_id"], ["ts", "event_id"], "_n").withColumn("t", F.col("_n") - 1).drop("_n")


@query("valid_episodes", "B57", f"WITH {EPS} SELECT * FROM eps WHERE length >= greatest(16, 40 + 15, 50 + 15)")
def valid_episodes(t):
    return e.valid_episodes(eps(t), 40, 50)


@query("dataset_frames", "D30", f"WITH {EPS} SELECT count(*) AS episodes, CAST(sum(length) AS BIGINT) AS frames FROM eps WHERE length >= 65")
def dataset_frames(t):
    return e.dataset_frames(eps(t), 40, 50)


@query("chunk_episodes", "E21", f"WITH {EPS}, c AS (SELECT episode_id, length, unnest(range(15, length, 20)) AS s FROM eps WHERE length >= 35) SELECT episode_id, least(s, length - 20) AS start, least(s, length - 20) + 20 AS \"end\" FROM c")
def chunk_episodes(t):
    return e.chunk_episodes(eps(t), 20, 10)


@query("length_mismatch", "D35", """WITH f AS (SELECT user_id AS episode_id, count(*) AS frames, count(*) FILTER (event_type <> 'error' OR user_id % 3 <> 0) AS actions, count(*) FILTER (value > 0.5 OR user_id % 2 = 0) AS embeddings,
  count(*) + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS length FROM events GROUP BY 1) SELECT episode_id, length, frames, actions, embeddings FROM f WHERE NOT (frames = actions AND actions = embeddings AND frames = length)""")
def length_mismatch(t):
    rows = t.events.withColumn("episode_id", F.col("user_id"))
    stored = eps(t).withColumn("length", F.col("length") + F.when(F.col("episode_id") % 10 == 0, 1).otherwise(0))
    return e.length_mismatch(rows, rows.where("event_type <> 'error' OR user_id % 3 <> 0"), rows.where("value > 0.5 OR user_id % 2 = 0"), stored)


@query("next_goal", "C12", f"WITH {FRAMES} SELECT a.event_id, a.t, (SELECT min(g.t) FROM fr g WHERE g.episode_id = a.episode_id AND g.event_type = 'purchase' AND a.t <= g.t + 1) AS goal_t FROM fr a")
def next_goal(t):
    fr = frames(t)
    goals = fr.where("event_type = 'purchase'").select("episode_id", F.col("t").alias("goal_t"))
    return e.next_goal(fr.select("episode_id", "t", "event_id"), goals).select("event_id", "t", "goal_t")


FRACTION = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296::DOUBLE"


@query("relabel_goals", "E22", f"""WITH n AS (SELECT CAST(label AS VARCHAR) AS episode_id, count(*) AS length FROM embeddings GROUP BY 1),
drawn AS (SELECT episode_id, length, i, 5 + CAST(floor({FRACTION.format("'7:' || episode_id || ':' || i")} * 15) AS BIGINT) AS gap FROM n, unnest(range(CAST(ceil(length / 5) AS BIGINT))) AS r(i)),
summed AS (SELECT episode_id, length, CAST(sum(gap) OVER (PARTITION BY episode_id ORDER BY i) AS BIGINT) AS goal_t FROM drawn),
goals AS (SELECT episode_id, goal_t FROM summed WHERE length - goal_t >= 5 UNION ALL SELECT episode_id, length - 1 FROM n),
v AS (SELECT CAST(label AS VARCHAR) AS episode_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding FROM embeddings),
placed AS (SELECT episode_id, t, (SELECT min(g.goal_t) FROM goals g WHERE g.episode_id = v.episode_id AND v.t <= g.goal_t + 1) AS goal_t FROM v)
SELECT p.episode_id, p.t, p.goal_t, CASE WHEN {FRACTION.format("'8:' || p.episode_id")} >= 0.1 THEN round(CAST(v.embedding[1] AS DOUBLE), 6) END AS first_value
FROM placed p LEFT JOIN v ON v.episode_id = p.episode_id AND v.t = p.goal_t""")
def relabel_goals(t):
    episodes = t.embeddings.groupBy(F.col("label").cast("string").alias("episode_id")).agg(F.count(F.lit(1)).alias("length"))
    placed = numbered(t.embeddings.withColumn("episode_id", F.col("label").cast("string")), ["episode_id"], ["vec_id"], "_n")
    vectors = placed.select("episode_id", (F.col("_n") - 1).alias("t"), "embedding")
    out = e.relabel_goals(episodes, vectors, 5, 20, 0.1, 7)
    return out.select("episode_id", "t", "goal_t", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))


@query("split_by_frames", "E23", """WITH o AS (SELECT doc_id AS episode_id, n_chars AS length, (doc_id * 7919) % 100003 AS shuffle FROM documents),
s AS (SELECT *, sum(length) OVER (ORDER BY shuffle, episode_id ROWS UNBOUNDED PRECEDING) AS cum FROM o), u AS (SELECT max(cum) AS used FROM s WHERE cum - length < 200000)
SELECT episode_id, length, CASE WHEN cum - length < 200000 THEN 'train' ELSE 'val' END AS part FROM s, u WHERE cum - length < 200000 OR cum - used - length < 50000""")
def split_by_frames(t):
    rows = t.documents.selectExpr("doc_id AS episode_id", "n_chars AS length", "(doc_id * 7919) % 100003 AS shuffle")
    return e.split_by_frames(rows, 200000, 50000, "shuffle")


@query("mixture", "E24", """WITH o AS (SELECT source AS dataset, doc_id AS episode_id, n_chars AS length, (doc_id * 7919) % 100003 AS shuffle FROM documents),
s AS (SELECT *, sum(length) OVER (PARTITION BY dataset ORDER BY shuffle, episode_id ROWS UNBOUNDED PRECEDING) AS cum FROM o)
SELECT dataset, episode_id, length FROM s WHERE cum - length < (CAST(substr(dataset, 4) AS INT) + 1) * 400""")
def mixture(t):
    rows = t.documents.selectExpr("source AS dataset", "doc_id AS episode_id", "n_chars AS length", "(doc_id * 7919) % 100003 AS shuffle")
    return e.mixture(rows, {f"src{i}": (i + 1) / 256 for i in range(20)}, 102400, "shuffle")


@query("sliding_clips", "E20", f"WITH {FRAMES}, c AS (SELECT episode_id, t, list(event_id) OVER (PARTITION BY episode_id ORDER BY t ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS clip FROM fr) SELECT episode_id, t, array_to_string(clip, ',') AS clip FROM c WHERE len(clip) = 16")
def sliding_clips(t):
    out = e.sliding_clips(frames(t).select("episode_id", "t", "event_id"), "event_id")
    return out.withColumn("clip", F.array_join("clip", ","))


@query("nstep_transitions", "E13", f"""WITH {FRAMES}, c AS (SELECT episode_id, t, event_id, lag(event_id, 2) OVER w AS obs, k + 0.5 * lag(k, 1) OVER w * 0 AS z,
  lag(k, 2) OVER w + 0.5 * lag(k, 1) OVER w + 0.25 * k AS g FROM fr WINDOW w AS (PARTITION BY episode_id ORDER BY t))
SELECT episode_id, t, obs, event_id AS next_obs, g::DOUBLE AS n_step_return, t - 2 AS "index" FROM c WHERE obs IS NOT NULL""")
def nstep_transitions(t):
    rows = frames(t).select("episode_id", "t", F.col("event_id").alias("obs_id"), F.col("k").cast("double").alias("reward"))
    return e.nstep_transitions(rows, 3, 0.5)


CHANGES = f"{FRAMES}, ch AS (SELECT episode_id, t, CASE event_type WHEN 'click' THEN 'log' WHEN 'view' THEN 'log' ELSE event_type END AS item, k % 7 - 3 AS change FROM fr)"


def changes(t):
    return frames(t).selectExpr("episode_id", "t", "CASE event_type WHEN 'click' THEN 'minecraft:log2' WHEN 'view' THEN 'log' ELSE event_type END AS item", "k % 7 - 3 AS change")


REWARDS = {"log": 1.0, "purchase": 2.5}


@query("collect_reward", "D29", f"WITH {CHANGES} SELECT episode_id, sum(change * CASE item WHEN 'log' THEN 1.0 ELSE 2.5 END)::DOUBLE AS reward FROM ch WHERE change > 0 AND item IN ('log', 'purchase') GROUP BY 1")
def collect_reward(t):
    return e.collect_reward(changes(t), REWARDS)


@query("reward_once", "E14", f"WITH {CHANGES} SELECT episode_id, item, min(t) AS t, (CASE item WHEN 'log' THEN 1.0 ELSE 2.5 END)::DOUBLE AS reward FROM ch WHERE change > 0 AND item IN ('log', 'purchase') GROUP BY 1, 2")
def reward_once(t):
    return e.reward_once(changes(t), REWARDS)


@query("touch_reward", "E15", f"""WITH {FRAMES}, tc AS (SELECT episode_id, t, event_type || '_block' AS block FROM fr),
h AS (SELECT episode_id, t, 3.0 AS value FROM tc WHERE contains(block, 'click') UNION ALL SELECT episode_id, min(t), 10.0 FROM tc WHERE contains(block, 'view') GROUP BY 1)
SELECT episode_id, t, sum(value)::DOUBLE AS reward FROM h GROUP BY 1, 2""")
def touch_reward(t):
    touches = frames(t).selectExpr("episode_id", "t", "event_id AS ord", "event_type || '_block' AS block")
    return e.touch_reward(touches, [("click", 3.0, "always"), ("view", 10.0, "onlyOnce")])


@query("distance_reward", "E16", """WITH d AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, sqrt((l_quantity - 25) * (l_quantity - 25) + (l_tax * 100 - 4) * (l_tax * 100 - 4)) AS d FROM lineitem),
p AS (SELECT *, lag(d) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS p FROM d)
SELECT l_suppkey AS episode_id, l_orderkey, l_linenumber, l_partkey, round(CASE WHEN coalesce(p, 0) = 0 THEN 0 ELSE p - d END, 6) AS reward FROM p""")
def distance_reward(t):
    rows = t.lineitem.selectExpr("l_suppkey AS episode_id", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity AS x", "l_tax * 100 AS z", "25.0D AS tx", "4.0D AS tz")
    out = e.distance_reward(rows, ["l_orderkey", "l_linenumber", "l_partkey"], [("x", "tx"), ("z", "tz")])
    return out.select("episode_id", "l_orderkey", "l_linenumber", "l_partkey", F.round("reward", 6).alias("reward"))


@query("milestone_reward", "E17", f"""WITH {FRAMES}, g AS (SELECT episode_id, t, event_type, k > 90 AS reached FROM fr), f AS (SELECT *, max(CASE WHEN reached AND event_type = 'click' THEN 1 ELSE 0 END) OVER w AS c, max(CASE WHEN reached AND event_type = 'view' THEN 1 ELSE 0 END) OVER w AS s FROM g WINDOW w AS (PARTITION BY episode_id ORDER BY t))
SELECT episode_id, t, c * 1.0::DOUBLE + s * 5.0::DOUBLE AS reward FROM f""")
def milestone_reward(t):
    steps = frames(t).selectExpr("episode_id", "t", "event_type AS goal", "k > 90 AS reached")
    return e.milestone_reward(steps, {"click": 1.0, "view": 5.0}, ["t"]).select("episode_id", "t", "reward")


@query("unstick_attack", "E18", f"""WITH {FRAMES}, b AS (SELECT episode_id, t, event_type IN ('click', 'view') AS held, k % 3 = 0 AS pressed FROM fr),
z AS (SELECT episode_id, bool_or(t = 0 AND pressed) AS stuck, min(CASE WHEN t > 0 AND pressed THEN t END) AS release FROM b GROUP BY 1)
SELECT episode_id, t, CASE WHEN held AND NOT (stuck AND (release IS NULL OR t < release)) THEN '0,1' ELSE '1' END AS buttons FROM b JOIN z USING (episode_id)""")
def unstick_attack(t):
    rows = frames(t).selectExpr("episode_id", "t", "CASE WHEN event_type IN ('click', 'view') THEN array(0, 1) ELSE array(1) END AS buttons",
                                "CASE WHEN k % 3 = 0 THEN array(0) ELSE cast(array() as array<int>) END AS new_buttons")
    return e.unstick_attack(rows).select("episode_id", "t", F.array_join(F.col("buttons").cast("array<string>"), ",").alias("buttons"))


@query("hotbar_change", "E19", f"WITH {FRAMES}, h AS (SELECT episode_id, t, k % 9 // 4 AS hotbar FROM fr) SELECT episode_id, t, CASE WHEN hotbar <> lag(hotbar, 1, 0) OVER (PARTITION BY episode_id ORDER BY t) THEN 'hotbar.' || (hotbar + 1) END AS selected FROM h")
def hotbar_change(t):
    rows = frames(t).selectExpr("episode_id", "t", "cast((k % 9) DIV 4 as int) AS hotbar")
    return e.hotbar_change(rows).select("episode_id", "t", "selected")


@query("stalled", "E12", f"""WITH {v.ACTIONS}, s AS (SELECT task_id, step_no, (k % 2)::DOUBLE AS reward, CASE WHEN k % 4 < 3 THEN 'turn' ELSE 'go' END AS action, CASE WHEN k % 3 = 0 THEN 'a' ELSE 'b' END AS result FROM actions),
w AS (SELECT *, lag(reward, 1) OVER o AS r1, lag(reward, 8) OVER o AS r8, lag(reward, 9) OVER o AS r9, lag(reward, 10) OVER o AS r10, first_value(reward) OVER (PARTITION BY task_id ORDER BY step_no) AS r0,
 min(reward) OVER f5 = max(reward) OVER f5 AS e5, min(result) OVER f3 = max(result) OVER f3 AS e3, min(action) OVER f4 = max(action) OVER f4 AS e4, min(action) OVER f6 = max(action) OVER f6 AS e6 FROM s
 WINDOW o AS (PARTITION BY task_id ORDER BY step_no), f5 AS (PARTITION BY task_id ORDER BY step_no ROWS 4 PRECEDING), f3 AS (PARTITION BY task_id ORDER BY step_no ROWS 2 PRECEDING), f4 AS (PARTITION BY task_id ORDER BY step_no ROWS 3 PRECEDING), f6 AS (PARTITION BY task_id ORDER BY step_no ROWS 5 PRECEDING)),
r AS (SELECT task_id, step_no, CASE WHEN step_no - 1 >= 40 AND reward <= r1 AND reward <= r8 AND reward <= r9 AND reward <= r10 THEN 'no_progress' WHEN step_no - 1 >= 30 AND e5 AND reward <= r0 THEN 'flat_reward'
 WHEN step_no >= 4 AND e3 AND e4 AND action <> 'turn' THEN 'same_action' WHEN step_no >= 6 AND e6 AND action = 'turn' THEN 'same_turn' END AS rule FROM w) SELECT * FROM r WHERE rule IS NOT NULL""")
def stalled(t):
    rows = v.actions(t).selectExpr("task_id", "step_no", "cast(k % 2 as double) AS reward", "CASE WHEN k % 4 < 3 THEN 'turn' ELSE 'go' END AS action", "CASE WHEN k % 3 = 0 THEN 'a' ELSE 'b' END AS result")
    return e.stalled(rows)


@query("episode_urls", "A10", """SELECT event_id, 'https://data.example.org/' || event_type || '/part-' || event_id || '.mp4' AS video_url, 'https://data.example.org/' || event_type || '/part-' || event_id || '.jsonl' AS action_url FROM events""")
def urls(t):
    index = t.events.select("event_id", F.lit("https://data.example.org/").alias("basedir"), F.array(F.expr("event_type || '/part-' || event_id || '.mp4'")).alias("relpaths"))
    flat = episode_urls(index)
    return flat.select(F.regexp_extract("video_url", "part-([0-9]+)", 1).cast("long").alias("event_id"), "video_url", "action_url")
