"""Queries: action profiles, step audits, judgements."""

from pyspark.sql import functions as F

from trailmark.catalog import views as v
from trailmark.catalog.registry import query
from trailmark.operators import audits as o
from trailmark.plans import numbered
from trailmark.sources.readers import register_views

BASE = r"regexp_replace(split_part(split_part({0}, '(', 1), '[', 1), '^\s+|\s+$', '', 'g')"
SPACE = "('click','type','hover','press','scroll','new_tab','tab_focus','close_tab','goto','go_back','go_forward','stop','send_msg_to_user')"
OUTSIDE = f"""{v.PREF_STEPS}, h AS (SELECT DISTINCT task_id, event_id, {BASE.format('w')} AS action FROM (SELECT task_id, event_id, unnest(history) AS w FROM pref)),
outside AS (SELECT * FROM h WHERE action NOT IN {SPACE})"""
KIND = "CASE WHEN contains(w, '(') THEN trim(split_part(w, '(', 1)) ELSE w END"
ALL = f"{v.PREF_STEPS}, every AS (SELECT unnest(list_concat(history, [chosen, rejected])) AS w FROM pref)"


@query("unusual_actions", "D6", f"WITH {OUTSIDE} SELECT action, count(*) AS count, count(DISTINCT task_id) AS tasks FROM outside GROUP BY action")
def unusual_actions(t):
    return o.unusual_actions(v.pref_steps(t), ["task_id", "event_id"])


@query("unusual_action_rows", "D6", f"WITH {OUTSIDE} SELECT action, task_id, event_id FROM outside")
def unusual_action_rows(t):
    return o.unusual_action_rows(v.pref_steps(t), ["task_id", "event_id"])


@query("unusual_action_examples", "D6 F3", f"""WITH {OUTSIDE}, r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY event_id) AS rank FROM outside) SELECT action, event_id, rank FROM r WHERE rank <= 3""")
def unusual_action_examples(t):
    rows = o.unusual_action_rows(v.pref_steps(t), ["task_id", "event_id"])
    return o.first_examples(rows, ["action"], [F.col("event_id")], 3).select("action", "event_id", F.col("rank").cast("long").alias("rank"))


@query("frequency_bands", "D7", f"""WITH {OUTSIDE}, c AS (SELECT action, count(*) AS n FROM outside GROUP BY action)
SELECT CASE WHEN n >= 10 THEN 'high(>=10)' WHEN n >= 5 THEN 'mid(5-9)' WHEN n >= 2 THEN 'low(2-4)' ELSE 'single' END AS band, count(*) AS names FROM c GROUP BY 1""")
def frequency_bands(t):
    return o.frequency_bands(o.unusual_actions(v.pref_steps(t), ["task_id", "event_id"]))


@query("action_variants", "C10", f"""WITH {OUTSIDE}, n AS (SELECT DISTINCT action FROM outside), s AS (SELECT unnest(['click','type','hover','press','scroll','new_tab','tab_focus','close_tab','goto','go_back','go_forward','stop','send_msg_to_user']) AS standard)
SELECT action, standard FROM n, s WHERE contains(standard, lower(action)) OR contains(lower(action), standard) OR replace(lower(action), '_', '') = replace(standard, '_', '')""")
def action_variants(t):
    names = o.unusual_actions(v.pref_steps(t), ["task_id", "event_id"])
    return o.action_variants(names)


@query("action_type_distribution", "D8 F7", f"WITH {ALL} SELECT {KIND} AS action_type, count(*) AS count, count(DISTINCT w) AS distinct_actions FROM every GROUP BY 1")
def action_type_distribution(t):
    return o.action_type_distribution(v.pref_steps(t))


@query("top_action_types", "F2", f"WITH {ALL} SELECT {KIND} AS action_type, count(*) AS count, count(DISTINCT w) AS distinct_actions FROM every GROUP BY 1 ORDER BY count DESC, action_type LIMIT 20")
def top_action_types(t):
    return o.action_type_distribution(v.pref_steps(t)).orderBy(F.desc("count"), "action_type").limit(20)


HIST = f"{v.PREF_STEPS}, hist AS (SELECT source_name, unnest(history) AS w FROM pref), by_source AS (SELECT source_name, {KIND} AS action_type, count(*) AS count FROM hist GROUP BY 1, 2)"


@query("actions_by_source", "D9", f"WITH {HIST} SELECT * FROM by_source")
def actions_by_source(t):
    return o.actions_by_source(v.pref_steps(t))


@query("top_actions_by_source", "F2", f"WITH {HIST}, r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY count DESC, action_type) AS rank FROM by_source) SELECT * FROM r WHERE rank <= 10")
def top_actions_by_source(t):
    return o.top_actions_by_source(o.actions_by_source(v.pref_steps(t)))


@query("keyword_actions", "F5", f"""WITH {ALL}, d AS (SELECT DISTINCT w FROM every), k AS (SELECT unnest(['go','back','send','msg','message','user','stop']) AS keyword),
h AS (SELECT w AS written, keyword, row_number() OVER (PARTITION BY keyword ORDER BY w) AS rank FROM d, k WHERE contains(lower(w), keyword)) SELECT * FROM h WHERE rank <= 10""")
def keyword_actions(t):
    return o.keyword_actions(v.pref_steps(t))


MSG = f"""{v.PREF_STEPS}, m AS (SELECT source_name, len(history) AS n, unnest(history) AS w, generate_subscripts(history, 1) AS position FROM pref),
hits AS (SELECT source_name, position, CASE WHEN position = n THEN 'last' WHEN position = 1 THEN 'first' ELSE 'middle' END AS place FROM m WHERE contains(lower(w), 'send_msg_to_user'))"""


@query("message_position_totals", "D10", f"WITH {MSG} SELECT place, count(*) AS count, count(*)::DOUBLE / sum(count(*)) OVER () * 100 AS percent FROM hits GROUP BY place")
def message_position_totals(t):
    return o.message_position_totals(o.message_positions(v.pref_steps(t)))


@query("message_position_histogram", "D10", f"WITH {MSG} SELECT source_name, position, count(*) AS total, count(*) FILTER (place = 'last') AS last, count(*) FILTER (place <> 'last') AS not_last FROM hits GROUP BY 1, 2")
def message_position_histogram(t):
    return o.message_position_histogram(o.message_positions(v.pref_steps(t)))


@query("has_prev_step", "E1 C8", "SELECT conv_id, turn, lag(1) OVER w IS NOT NULL AS has_prev_step, lag(text) OVER w AS prev_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def has_prev_step(t):
    steps = t.conversations.withColumnRenamed("conv_id", "task_id")
    out = o.with_previous_step(steps, ["turn"], ["text"])
    return out.select(F.col("task_id").alias("conv_id"), "turn", "has_prev_step", "prev_text")


@query("goback_samples", "B9 D36", f"WITH {v.PREF_STEPS} SELECT 'chosen' AS context, source_name, count(*) AS samples FROM pref WHERE contains(lower(chosen), 'go_back') GROUP BY 2")
def goback_samples(t):
    return o.goback_by_context(o.goback_samples(v.pref_steps(t)))


@query("task_context", "D34", """WITH w AS (SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'qui'))
SELECT conv_id, turn, role, CASE WHEN length(text) > 300 THEN left(text, 297) || '...' ELSE text END AS text FROM conversations SEMI JOIN w USING (conv_id)""")
def task_context(t):
    steps = t.conversations.withColumnRenamed("conv_id", "task_id")
    wanted = steps.where(F.lower("text").contains("qui"))
    return o.task_context(steps, wanted, {"text": 300}).withColumnRenamed("task_id", "conv_id")


JUDGED = """j AS (SELECT doc_id, quality = 1 AS is_reasonable, CASE WHEN toxic = 1 THEN 'loop' ELSE 'progress' END AS category, (doc_id % 100)::DOUBLE / 100 AS confidence,
  doc_id % 9 = 0 AS skipped, doc_id % 7 = 0 AS err, doc_id % 5 = 0 AS parse_error FROM labels),
judged AS (SELECT d.doc_id, d.source, confidence, category, CASE WHEN j.doc_id IS NULL THEN 'missing' WHEN skipped THEN 'skipped' WHEN err THEN 'error' WHEN parse_error THEN 'parse_error'
  WHEN is_reasonable THEN 'reasonable' ELSE 'unreasonable' END AS verdict FROM documents d LEFT JOIN j USING (doc_id))"""


def judged(t):
    judgements = t.labels.selectExpr(
        "doc_id", "quality = 1 AS is_reasonable", "CASE WHEN toxic = 1 THEN 'loop' ELSE 'progress' END AS category",
        "cast(doc_id % 100 as double) / 100 AS confidence", "CASE WHEN doc_id % 9 = 0 THEN 'no model' END AS skipped",
        "CASE WHEN doc_id % 7 = 0 THEN 'timeout' END AS error", "doc_id % 5 = 0 AS parse_error",
    )
    return o.attach_judgements(t.documents.select("doc_id", "source"), judgements, ["doc_id"])


@query("attach_judgements", "C17", f"WITH {JUDGED} SELECT doc_id, verdict, confidence FROM judged")
def attach_judgements(t):
    return judged(t).select("doc_id", "verdict", "confidence")


@query("judgement_stats", "D11", f"""WITH {JUDGED}, p AS (SELECT *, verdict IN ('reasonable','unreasonable','parse_error','skipped') AND confidence > 0 AS pos FROM judged)
SELECT source, count(*) AS total, count(*) FILTER (verdict = 'reasonable') AS reasonable, count(*) FILTER (verdict = 'unreasonable') AS unreasonable, count(*) FILTER (verdict = 'skipped') AS skipped,
 count(*) FILTER (verdict = 'error') AS error, count(*) FILTER (verdict = 'parse_error') AS parse_error, count(*) FILTER (verdict = 'missing') AS missing, round(avg(confidence) FILTER (pos), 6) AS avg_confidence,
 count(*) FILTER (pos AND confidence < 0.8) AS low_confidence FROM p GROUP BY source""")
def judgement_stats(t):
    return o.judgement_stats(judged(t), ["source"]).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("judgement_categories", "D11", f"WITH {JUDGED} SELECT category, count(*) AS samples FROM judged WHERE verdict IN ('reasonable','unreasonable') GROUP BY category")
def judgement_categories(t):
    return o.judgement_categories(judged(t))


@query("judgement_examples", "F3", f"""WITH {JUDGED}, r AS (SELECT doc_id, verdict, confidence, row_number() OVER (PARTITION BY verdict ORDER BY confidence, doc_id) AS rank FROM judged WHERE verdict <> 'missing') SELECT * FROM r WHERE rank <= 3""")
def judgement_examples(t):
    rows = judged(t).where("verdict <> 'missing'").select("doc_id", "verdict", "confidence")
    return o.first_examples(rows, ["verdict"], [F.col("confidence"), F.col("doc_id")], 3)


@query("discoveries", "E10", f"""WITH {v.ACTIONS} SELECT task_id, event_id, regexp_extract(raw, '"([^"]+)"', 1) AS message, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) - 1 AS number
FROM actions WHERE raw LIKE 'send_msg_to_user("%'""")
def discoveries(t):
    return o.discoveries(v.raw_actions(t), ["ts", "event_id"]).select("task_id", "event_id", "message", "number")


@query("recent_entries", "E9", f"""WITH {v.TURNS} SELECT conv_id, turn, coalesce(string_agg('{{THOUGHT: ' || role || ', ACTION: ' || turn || '}}', chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '(empty)') AS recent FROM turns""")
def recent_entries(t):
    entry = F.expr("'{THOUGHT: ' || role || ', ACTION: ' || turn || '}'")
    return o.recent_entries(v.turns(t), ["conv_id"], ["turn"], 10, entry).select("conv_id", "turn", "recent")


@query("sorted_steps", "F1", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY '' || turn) AS lexical_pos FROM conversations")
def sorted_steps(t):
    rows = t.conversations.select("conv_id", "turn", F.col("turn").cast("string").alias("step_id"))
    lexical = numbered(rows, ["conv_id"], ["step_id"], "lexical_pos")
    return numbered(lexical, [], ["conv_id", "turn"], "pos").select("conv_id", "turn", "pos", "lexical_pos")


@query("task_profile", "D26 A21", "SELECT conv_id, count(*) AS steps, count(DISTINCT turn) AS step_count, min(role) AS any_role, 'string' AS text_type FROM conversations GROUP BY conv_id")
def task_profile(t):
    register_views({"trailmark_steps": t.conversations})
    return t.spark.sql(
        "SELECT conv_id, count(*) AS steps, count(DISTINCT turn) AS step_count, min(role) AS any_role, "
        "any_value(typeof(text)) AS text_type FROM trailmark_steps GROUP BY conv_id"
    )


@query("checklist_timeline", "E29", """SELECT conv_id, turn, length(text) AS items, coalesce(length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS change FROM conversations""")
def checklist_timeline(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("items"))
    return o.checklist_timeline(rows, ["conv_id"], ["turn"], "items").select("conv_id", "turn", "items", "change")
