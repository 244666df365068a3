"""Queries: conversations and run control."""

from pyspark.sql import functions as F

from trailmark.catalog import views as v
from trailmark.catalog.actions import KEY, PARSED
from trailmark.catalog.registry import query
from trailmark.functions import actions as a
from trailmark.operators import chats as c
from trailmark.sources.readers import conversation_turns

LAST_LINE = r"regexp_replace(list_extract(string_split(content, chr(10)), -1), '^\s+|\s+$', '', 'g')"


def cleaned(source: str, name: str = "clean") -> str:
    """Common table expressions that drop repeated actions from ``source``."""
    return f"""k_{name} AS (SELECT *, CASE WHEN role = 'agent' THEN {LAST_LINE} END AS key FROM {source}),
d_{name} AS (SELECT *, role = 'agent' AND row_number() OVER (PARTITION BY conv_id, role, key ORDER BY turn) > 1 AS dropped FROM k_{name}),
s_{name} AS (SELECT *, max(CASE WHEN dropped THEN turn END) OVER w AS ld, max(CASE WHEN role <> 'agent' THEN turn END) OVER w AS lr FROM d_{name}
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT * FROM s_{name} WHERE NOT dropped AND NOT (role <> 'agent' AND coalesce(ld > coalesce(lr, -1), false)))"""


@query("drop_repeated_actions", "E6", f"WITH {v.TURNS}, {cleaned('turns')} SELECT conv_id, turn FROM clean")
def drop_repeated_actions(t):
    return c.drop_repeated_actions(v.turns(t).select("conv_id", "turn", "role", "content")).select("conv_id", "turn")


SEG = r"len(regexp_extract_all(content, '\p{L}{1,7}')) + len(regexp_extract_all(content, '[^\p{L} \n]'))"


@query("keep_recent_messages", "E7", f"""WITH {v.TURNS}, s AS (SELECT conv_id, turn, role, content, {SEG} AS seg, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
b AS (SELECT *, max(CASE WHEN pos = 1 THEN seg END) OVER (PARTITION BY conv_id) + sum(CASE WHEN pos > 1 THEN seg ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM s),
f AS (SELECT conv_id, min(pos) AS start, arg_min(role, pos) AS start_role FROM b WHERE pos > 1 AND used < 600 GROUP BY 1),
g AS (SELECT b.*, coalesce(CASE WHEN start_role = 'user' THEN start + 1 ELSE start END, n + 1) AS start FROM b LEFT JOIN f USING (conv_id))
SELECT conv_id, turn, CASE WHEN pos = 1 THEN 'user' ELSE role END AS role, CASE WHEN pos = 1 AND start > 2 THEN content || chr(10) || chr(10) || '[NOTICE] ' || (start - 2) || ' messages are omitted.' ELSE content END AS content FROM g WHERE pos = 1 OR pos >= start""")
def keep_recent_messages(t):
    return c.keep_recent_messages(v.turns(t).select("conv_id", "turn", "role", "content"), budget=600)


@query("keep_head_tail", "E8", r"""WITH """ + v.TURNS + r""", x AS (SELECT conv_id, turn, content, replace(replace(replace(content, chr(10) || chr(10), chr(10)), '```', '`'), '##', '#') AS z FROM turns),
s AS (SELECT conv_id, turn, len(regexp_extract_all(z, '[^\p{L}\p{N} ]')) + len(regexp_extract_all(regexp_replace(z, '[^\p{L}\p{N}\s]', '', 'g'), '[\p{L}\p{N}]{1,6}')) AS tok,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM x),
p AS (SELECT *, CASE WHEN pos > 3 AND pos < n THEN (n - 1 - pos) // 2 END AS pair FROM s),
q AS (SELECT conv_id, pair, sum(tok) AS tok FROM p WHERE pair IS NOT NULL GROUP BY 1, 2),
r AS (SELECT conv_id, pair, sum(tok) OVER (PARTITION BY conv_id ORDER BY pair) AS reach FROM q),
fx AS (SELECT conv_id, sum(tok) AS fixed FROM p WHERE pos <= 3 OR pos = n GROUP BY 1),
k AS (SELECT p.*, pos <= 3 OR pos = n OR reach + fixed <= 700 AS keep FROM p JOIN fx USING (conv_id) LEFT JOIN r ON r.conv_id = p.conv_id AND r.pair = p.pair),
g AS (SELECT conv_id, max(pos) AS gap FROM k WHERE NOT keep GROUP BY 1)
SELECT k.conv_id, turn, coalesce(pos = gap + 1, false) AS truncated FROM k LEFT JOIN g USING (conv_id) WHERE keep""")
def keep_head_tail(t):
    out = c.keep_head_tail(v.turns(t).select("conv_id", "turn", "role", "content"), head=3, budget=700)
    return out.select("conv_id", "turn", "truncated")


@query("renumber_images", "E25", """SELECT conv_id, turn, CASE WHEN f = 1 THEN (sum(f) OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT || '.png' END AS image
FROM (SELECT conv_id, turn, CASE WHEN role <> 'assistant' AND turn > 2 AND contains(text, 'a') THEN 1 ELSE 0 END AS f FROM conversations)""")
def renumber_images(t):
    return c.renumber_images(v.turns(t), F.col("text").contains("a")).select("conv_id", "turn", "image")


@query("conversation_rounds", "E30", f"""WITH {v.TURNS}, i AS (SELECT conv_id, arg_min(content, turn) AS intent, arg_max(content, turn) AS obs FROM turns WHERE role = 'user' GROUP BY 1),
r AS (SELECT conv_id, content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS round FROM turns WHERE role = 'agent'),
h AS (SELECT conv_id, round, CASE WHEN round = 0 THEN 'Task Instruction: ' || intent || chr(10) || chr(10) || 'Round 0' || chr(10) || intent ELSE 'Round ' || round || chr(10) || '** Simplified html **' END AS "user", content AS assistant FROM r JOIN i USING (conv_id)),
tot AS (SELECT conv_id, sum(length("user") + length(assistant)) AS used, max(round) AS last FROM h GROUP BY 1)
SELECT * FROM h UNION ALL SELECT i.conv_id, coalesce(last + 1, 0), 'Round ' || coalesce(last + 1, 0) || chr(10) || chr(10) || left(obs, CAST(greatest(0, 2000 - coalesce(used, 0)) AS BIGINT)), NULL FROM i LEFT JOIN tot USING (conv_id)""")
def conversation_rounds(t):
    return c.conversation_rounds(v.turns(t).select("conv_id", "turn", "role", "content"), limit=2000)


SOURCES = "src AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'hint' WHEN 1 THEN 'gold2' ELSE 'gold1' END AS source FROM orders)"


@query("prefer_source", "E5 F7", f"""WITH {SOURCES}, r AS (SELECT *, CASE source WHEN 'hint' THEN 2 WHEN 'gold2' THEN 1 ELSE -1 END AS p FROM src)
SELECT o_custkey, o_orderkey, source FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, CASE WHEN p < 0 THEN o_orderkey ELSE -o_orderkey END) = 1""")
def prefer_source(t):
    rows = t.orders.selectExpr("o_custkey", "o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN 'hint' WHEN 1 THEN 'gold2' ELSE 'gold1' END AS source")
    return c.prefer_source(rows, "o_custkey", {"hint": 2, "gold2": 1, "gold1": -1}, "o_orderkey")


@query("pair_failed_with_success", "C7", "SELECT DISTINCT c.conv_id, EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system') AS has_success FROM conversations c")
def pair_failed_with_success(t):
    failed = t.conversations.select("conv_id").distinct()
    return c.pair_failed_with_success(failed, t.conversations.where("role = 'system'"), "conv_id")


REPLIES = """CASE WHEN role = 'user' AND conv_id % 3 <> 0 THEN 'You have successfully edited the rule. ' || content
  WHEN role = 'agent' AND conv_id % 4 = 1 THEN 'Action: edit_rule("#n' || turn || '")' ELSE content END"""
HALVES = f"""{v.TURNS}, f AS (SELECT conv_id // 2 AS conv_id, turn, role, {REPLIES} AS content FROM turns WHERE conv_id % 2 = 0),
g AS (SELECT (conv_id - 1) // 2 AS conv_id, turn, role, {REPLIES} AS content FROM turns WHERE conv_id % 2 = 1)"""


def halves(t):
    told = v.turns(t).withColumn("content", F.expr(REPLIES))
    failed = told.where("conv_id % 2 = 0").selectExpr("conv_id DIV 2 AS conv_id", "turn", "role", "content")
    success = told.where("conv_id % 2 = 1").selectExpr("(conv_id - 1) DIV 2 AS conv_id", "turn", "role", "content")
    return failed, success


@query("stitch_conversations", "F11", f"""WITH {HALVES}, {cleaned('f', 'cf')}, {cleaned('g', 'cg')},
e AS (SELECT conv_id, count(*) FILTER (ok) AS edits FROM (SELECT conv_id, role = 'agent' AND contains(content, 'edit_rule') AND coalesce(contains(lead(content) OVER (PARTITION BY conv_id ORDER BY turn), 'You have successfully edited the rule.'), false) AS ok FROM cg) GROUP BY 1),
rich AS (SELECT conv_id FROM e SEMI JOIN f USING (conv_id) WHERE edits > 1),
pf AS (SELECT conv_id, role, content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM cf), pg AS (SELECT conv_id, role, content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM cg)
SELECT conv_id, 'failed' AS part, pos, role, content FROM pf SEMI JOIN rich USING (conv_id) WHERE pos <= 3 UNION ALL SELECT conv_id, 'success', pos, role, content FROM pg SEMI JOIN rich USING (conv_id) WHERE pos > 3""")
def stitch_conversations(t):
    return c.stitch_conversations(*halves(t))


@query("stitch_rebuilt", "F11 U2")
def stitch_rebuilt(t):
    told = v.turns(t).select("conv_id", "turn", "role", "content")
    first = told.where("role = 'agent'").groupBy("conv_id").agg(F.min("turn").alias("first"))
    edited = told.join(first, "conv_id").select("conv_id", "turn", "role", F.expr("""CASE
      WHEN role = 'user' THEN 'You have successfully edited the rule. ' || content
      WHEN turn = first THEN 'Action: edit_rule("#n", "top", "1")' ELSE 'Action: look at #n ' || turn END""").alias("content"))
    return c.stitch_rebuilt(edited, told)


@query("rebuild_conversations", "F11 U2")
def rebuild_conversations(t):
    return c.rebuild_conversations(v.turns(t).select("conv_id", "turn", "role", F.expr(REPLIES).alias("content")))


@query("next_step_records", "E28", "SELECT conv_id, '' || (turn + 1) AS step_id, text AS thought, role AS action FROM conversations")
def next_step_records(t):
    steps = t.conversations.withColumn("step_id", F.col("turn").cast("string"))
    out = c.next_step_records(steps, F.col("role"), F.col("text"))
    return out.select("conv_id", "step_id", F.col("chosen.thought").alias("thought"), F.col("chosen.action").alias("action"))


@query("trace_rows", "A17", f"""WITH {v.TURNS}, i AS (SELECT conv_id, arg_min(content, turn) AS intent FROM turns GROUP BY 1), p AS (SELECT conv_id, turn, role, content, lag(content) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM turns),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step FROM p WHERE role = 'agent')
SELECT conv_id AS trace_id, step AS "index", CASE WHEN step = 0 THEN intent ELSE '** Simplified html **' END AS prompt, prev AS html, content AS response, intent AS target FROM a JOIN i USING (conv_id)""")
def trace_rows(t):
    turns = v.turns(t)
    return c.trace_rows(c.trajectory_states(turns))


@query("read_conversations", "A8", f"WITH {v.TURNS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, content AS text FROM turns")
def read_conversations(t):
    history = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
    )
    stored = v.turns(t).groupBy("conv_id").agg(history.alias("history"))
    records = stored.select(F.col("conv_id").alias("input"), F.lit("done").alias("output"), "history")
    flat = conversation_turns(records)
    return flat.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.get("content.text", F.lit(0)).alias("text"))


STOP = f"""{PARSED}, kk AS (SELECT task_id, step_no, kind, {KEY} AS key FROM parsed),
w AS (SELECT *, sum(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY step_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS fails,
  min(coalesce(key, '')) OVER l AS lo, max(coalesce(key, '')) OVER l AS hi, count(key) OVER l AS n,
  CASE WHEN kind = 'TYPE' THEN row_number() OVER (PARTITION BY task_id, key ORDER BY step_no) END AS seen FROM kk
  WINDOW l AS (PARTITION BY task_id ORDER BY step_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
h AS (SELECT task_id, step_no, CASE WHEN step_no >= 60 THEN 1 WHEN fails >= 3 AND step_no >= 3 THEN 2 WHEN lo = hi AND n = 3 AND kind <> 'TYPE' THEN 3 WHEN seen >= 3 THEN 4 END AS r FROM w)"""


STOP_SQL = f"WITH {STOP} SELECT task_id, min(step_no) AS step_no, CASE arg_min(r, step_no) WHEN 1 THEN 'max_steps' WHEN 2 THEN 'parse_failures' WHEN 3 THEN 'same_action' ELSE 'typing' END AS reason FROM h WHERE r IS NOT NULL GROUP BY task_id"


@query("stop_reasons", "E11", STOP_SQL)
def stop_reasons(t):
    return c.stop_reasons(keyed_actions(t), ["step_no"], max_steps=60, parse=3, repeat=3)


def keyed_actions(t):
    rows = v.actions(t).withColumn("a", a.parse_id_action(F.col("raw")))
    return rows.select("task_id", "step_no", F.col("a.action_type").alias("action_type"), a.action_key(F.col("a")).alias("key"))
