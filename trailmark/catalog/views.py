"""Views over the given tables that stand in for steps, actions, turns, observations and runs.

Every view exists twice: as a DataFrame for Spark and as a common table expression for the SQL twin.
Where an expression reads the same in both dialects it is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.plans import framed, numbered

# ---------------------------------------------------------------- pages as steps of a domain
HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
DOMAIN_STEPS = f"""domain_steps AS (
  SELECT {HOST} AS website_name, {HOST} AS task_id, CAST(page_id AS VARCHAR) AS step_id, page_id, url
  FROM pages)"""


def domain_steps(t) -> DataFrame:
    host = F.expr(HOST)
    return t.pages.select(
        host.alias("website_name"), host.alias("task_id"), F.col("page_id").cast("string").alias("step_id"),
        "page_id", "url",
    )


RANGES = """ranges AS (
  SELECT task_id, min(CAST(step_id AS BIGINT)) AS lo, max(CAST(step_id AS BIGINT)) AS hi FROM domain_steps GROUP BY task_id),
rel AS (
  SELECT s.*, CASE WHEN hi = lo THEN 0.0::DOUBLE ELSE (CAST(step_id AS BIGINT) - lo)::DOUBLE / (hi - lo) END AS rel
  FROM domain_steps s JOIN ranges USING (task_id)),
binned AS (
  SELECT *, CASE WHEN rel < 0.25 THEN 'Q1_0-25%' WHEN rel < 0.5 THEN 'Q2_25-50%' WHEN rel < 0.75 THEN 'Q3_50-75%'
                 ELSE 'Q4_75-100%' END AS rel_bin FROM rel)"""
TERTILES = """tertiles AS (
  SELECT website_name, n, CASE ntile(3) OVER (ORDER BY n DESC, website_name)
      WHEN 1 THEN 'G1_High' WHEN 2 THEN 'G2_Mid' ELSE 'G3_Low' END AS grp
  FROM (SELECT website_name, count(*) AS n FROM domain_steps GROUP BY website_name))"""
BUCKETS = f"""{DOMAIN_STEPS}, {RANGES}, {TERTILES},
buckets AS (SELECT b.*, grp, grp || '|' || rel_bin AS bucket FROM binned b JOIN tertiles USING (website_name))"""

# ---------------------------------------------------------------- events as actions of a task
ACTION_TEXT = """CASE event_type
  WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'click [' || k || ']'
       WHEN 1 THEN 'click(' || chr(39) || k || chr(39) || ')' ELSE 'click [Save ' || k || ']' END
  WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'scroll [down]' WHEN 1 THEN 'scroll up' WHEN 2 THEN 'hover [' || k || ']'
       ELSE 'goto [http://shop.example.com/p/' || k || ']' END
  WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'type [' || k || '] [blue shirt]' WHEN 1 THEN 'type [' || k || '] [a b] [0]'
       WHEN 2 THEN 'type [Search] [q ' || k || ']' ELSE 'press [Enter]' END
  WHEN 'purchase' THEN CASE k % 3 WHEN 0 THEN 'stop [order ' || k || ']'
       WHEN 1 THEN 'send_msg_to_user("bought ' || k || '")' ELSE 'new_tab' END
  ELSE CASE k % 4 WHEN 0 THEN 'go_back()' WHEN 1 THEN 'go_back' WHEN 2 THEN 'tab_focus [' || (k % 5) || ']'
       ELSE 'noop(' || k || ')' END END"""
PROPS_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
KEYED_EVENTS = f"keyed AS (SELECT *, {PROPS_K} AS k FROM events)"
ACTIONS = f"""{KEYED_EVENTS},
actions AS (
  SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_no,
         event_id, ts, event_type, value AS reward, k, {ACTION_TEXT} AS raw
  FROM keyed)"""


def keyed_events(t) -> DataFrame:
    return t.events.withColumn("k", F.expr(PROPS_K))


def raw_actions(t) -> DataFrame:
    """Actions without their step number, for operators that need no order."""
    return keyed_events(t).select(
        F.col("user_id").alias("task_id"), "event_id", "ts", "event_type", F.col("value").alias("reward"), "k",
        F.expr(ACTION_TEXT).alias("raw"),
    )


def actions(t) -> DataFrame:
    return numbered(raw_actions(t), ["task_id"], ["ts", "event_id"], "step_no")


# A step's history holds the three actions before it; the rejected action is the reversed kind of step.
PREF_STEPS = f"""{ACTIONS},
pref AS (
  SELECT task_id, step_no, event_id, raw AS chosen, event_type AS source_name,
         coalesce(list(raw) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS history,
         CASE WHEN k % 2 = 0 THEN 'go_back()' ELSE 'scroll [up]' END AS rejected
  FROM actions)"""


def pref_steps(t) -> DataFrame:
    history = framed(
        actions(t), ["task_id"], ["ts", "event_id"],
        {"history": lambda w: F.collect_list("raw").over(w.rowsBetween(-3, -1))}, before=3,
    )
    return history.select(
        "task_id", "step_no", "event_id", F.col("raw").alias("chosen"), F.col("event_type").alias("source_name"),
        "history", F.expr("CASE WHEN k % 2 = 0 THEN 'go_back()' ELSE 'scroll [up]' END").alias("rejected"),
    )


# ---------------------------------------------------------------- conversations as agent turns
ACTION_LINE = """CASE (conv_id * 7 + turn - turn % 4) % 5
  WHEN 0 THEN 'Action: edit_rule(".c' || (conv_id % 3) || '", "color", "red")'
  WHEN 1 THEN 'Action: get_selectors_by_html_elements("div")'
  WHEN 2 THEN 'Action: revert_last_edit()'
  WHEN 3 THEN 'Action 1: edit_rule("#top", "width", "' || conv_id || 'px")'
  ELSE 'I have fixed the css style' END"""
TURN_ROLE = "CASE role WHEN 'assistant' THEN 'agent' ELSE role END"
TURN_TEXT = f"CASE role WHEN 'assistant' THEN 'Thought: ' || text || chr(10) || {ACTION_LINE} ELSE text END"
TURNS = f"turns AS (SELECT conv_id, turn, {TURN_ROLE} AS role, {TURN_TEXT} AS content, text FROM conversations)"


def turns(t) -> DataFrame:
    return t.conversations.select(
        "conv_id", "turn", F.expr(TURN_ROLE).alias("role"), F.expr(TURN_TEXT).alias("content"), "text"
    )


# ---------------------------------------------------------------- pages as accessibility-tree text
TAGS = "<(a|p|h1|h2|li|b|div)( [^>]*)?>[^<]*"
LINE = """CASE regexp_extract(x, '^<([a-z0-9]+)', 1)
  WHEN 'a' THEN '[' || {n} || '] link ' || chr(39) || regexp_extract(x, '>([^<]*)', 1) || chr(39) || ', url=' || chr(39)
       || CASE {n} % 5 WHEN 0 THEN 'http://shop.example.com' || regexp_extract(x, 'href="([^"]*)"', 1)
          WHEN 1 THEN 'https://docs.example.org' || regexp_extract(x, 'href="([^"]*)"', 1) || '.html'
          WHEN 2 THEN regexp_extract(x, 'href="([^"]*)"', 1)
          WHEN 3 THEN url || '#part' ELSE 'javascript:void(0)' END || chr(39)
  WHEN 'b' THEN '[' || {n} || '] button ' || chr(39) || regexp_extract(x, '>([^<]*)', 1) || chr(39)
       || CASE {n} % 3 WHEN 0 THEN ' hasPopup: dialog expanded: True controls: menu' WHEN 1 THEN ' expanded: False' ELSE ' focused: True' END
  WHEN 'p' THEN '[' || {n} || '] StaticText ' || chr(39) || regexp_extract(x, '>([^<]*)', 1) || chr(39)
  WHEN 'div' THEN '[' || {n} || '] textbox ' || chr(39) || regexp_extract(x, '>([^<]*)', 1) || chr(39) || ' required: False'
  WHEN 'li' THEN '[' || {n} || '] generic ' || chr(39) || chr(39)
  ELSE '[' || {n} || '] heading ' || chr(39) || regexp_extract(x, '>([^<]*)', 1) || chr(39) END"""
OBSERVATIONS = f"""obs AS (
  SELECT page_id, url, array_to_string(list_transform(regexp_extract_all(html, '{TAGS}'),
         lambda x, i: {LINE.format(n='i')}), chr(10)) AS text_observation
  FROM pages)"""
OBS_LINES = f"""{OBSERVATIONS},
obs_lines AS (
  SELECT page_id, url, unnest(string_split(text_observation, chr(10))) AS line,
         generate_subscripts(string_split(text_observation, chr(10)), 1) AS pos FROM obs)"""


def observations(t) -> DataFrame:
    body = LINE.format(n="(i + 1)")
    text = f"array_join(transform(regexp_extract_all(html, '{TAGS}', 0), (x, i) -> {body}), chr(10))"
    return t.pages.select("page_id", "url", F.expr(text).alias("text_observation"))


# ---------------------------------------------------------------- orders as run reports
RUN_STATUS = """CASE o_orderkey % 11 WHEN 0 THEN 'AGENT_CONTEXT_LIMIT' WHEN 1 THEN 'agent validation failed'
  WHEN 2 THEN 'agent invalid action' WHEN 3 THEN 'TASK_LIMIT_REACHED' WHEN 4 THEN 'unknown' WHEN 5 THEN 'TASK_ERROR'
  ELSE 'completed' END"""
RUN_TASK = """CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'os-std' WHEN '2' THEN 'dbbench-std' WHEN '3' THEN 'm2w-std'
  WHEN '4' THEN 'card-game' ELSE 'webshop-std' END"""
RUNS = f"""runs AS (
  SELECT 'agent-' || (o_custkey % 7) AS agent, {RUN_TASK} AS task, '' || (o_orderkey % 500) AS sample, o_orderkey,
         {RUN_STATUS} AS status, o_orderdate AS ts, o_orderstatus, o_totalprice FROM orders)"""


def runs(t) -> DataFrame:
    return t.orders.select(
        F.expr("'agent-' || (o_custkey % 7)").alias("agent"), F.expr(RUN_TASK).alias("task"),
        F.expr("'' || (o_orderkey % 500)").alias("sample"), "o_orderkey", F.expr(RUN_STATUS).alias("status"),
        F.col("o_orderdate").alias("ts"), "o_orderstatus", "o_totalprice",
    )
