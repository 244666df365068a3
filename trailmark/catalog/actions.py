"""Queries: written and parsed actions."""

from pyspark.sql import functions as F

from trailmark.catalog import views as v
from trailmark.catalog.registry import query
from trailmark.functions import actions as a
from trailmark.functions import messages as m

BASE = r"regexp_replace(split_part(split_part(raw, '(', 1), '[', 1), '^\s+|\s+$', '', 'g')"
SPACE = "('click','type','hover','press','scroll','new_tab','tab_focus','close_tab','goto','go_back','go_forward','stop','send_msg_to_user')"


@query("base_action", "B6 B8", f"WITH {v.ACTIONS} SELECT event_id, {BASE} AS base, {BASE} IN {SPACE} AS standard FROM actions")
def base_action(t):
    base = a.base_action(F.col("raw"))
    return v.raw_actions(t).select("event_id", base.alias("base"), a.in_action_space(base).alias("standard"))


@query("action_type", "B7", f"WITH {v.ACTIONS} SELECT event_id, CASE WHEN contains(raw, '(') THEN trim(split_part(raw, '(', 1)) ELSE raw END AS kind FROM actions")
def action_type(t):
    return v.raw_actions(t).select("event_id", a.action_type(F.col("raw")).alias("kind"))


@query("contains_action", "B9", f"WITH {v.ACTIONS} SELECT event_id, raw FROM actions WHERE contains(lower(raw), 'go_back')")
def contains_action(t):
    return v.raw_actions(t).where(a.contains_action(F.col("raw"), "go_back")).select("event_id", "raw")


PARSED = f"""{v.ACTIONS},
parsed AS (SELECT event_id, task_id, step_no, reward, raw, k, event_type,
 CASE WHEN raw LIKE 'click [%' THEN 'CLICK' WHEN raw LIKE 'type [%' THEN 'TYPE' WHEN raw LIKE 'hover [%' THEN 'HOVER' WHEN raw LIKE 'scroll%' THEN 'SCROLL'
   WHEN raw LIKE 'press [%' THEN 'KEY_PRESS' WHEN raw LIKE 'goto [%' THEN 'GOTO_URL' WHEN raw LIKE 'tab_focus [%' THEN 'PAGE_FOCUS' WHEN raw = 'new_tab' THEN 'NEW_TAB'
   WHEN raw = 'go_back' THEN 'GO_BACK' WHEN raw LIKE 'stop [%' THEN 'STOP' WHEN raw LIKE 'send_msg%' THEN 'SEND_MESSAGE_TO_USER' END AS kind,
 CASE WHEN regexp_matches(raw, '^(click|type|hover) [[][0-9]+[]]') THEN regexp_extract(raw, '[[]([0-9]+)[]]', 1) END AS element_id,
 CASE WHEN regexp_matches(raw, '^(click|type) [[][A-Z]') THEN regexp_extract(raw, '[[]([^]]*)[]]', 1) END AS element_name,
 CASE WHEN raw LIKE 'type [%' THEN regexp_extract(raw, '[]] [[]([^]]*)[]]', 1) || CASE WHEN raw LIKE '%[0]' THEN '' ELSE chr(10) END END AS text,
 CASE WHEN raw LIKE 'goto [%' THEN regexp_extract(raw, '[[]([^]]*)[]]', 1) END AS target_url,
 CASE WHEN raw LIKE 'scroll%' THEN regexp_extract(raw, '(up|down)', 1) END AS direction,
 CASE WHEN raw LIKE 'press [%' THEN regexp_extract(raw, '[[]([^]]*)[]]', 1) END AS key_comb,
 CASE WHEN raw LIKE 'tab_focus [%' THEN CAST(regexp_extract(raw, '[[]([0-9]+)[]]', 1) AS INT) END AS page_number,
 CASE WHEN raw LIKE 'stop [%' THEN regexp_extract(raw, '[[](.*)[]]', 1) WHEN raw LIKE 'send_msg%' THEN regexp_extract(raw, '"([^"]*)"', 1) END AS answer
 FROM actions)"""


def parsed(t):
    return v.raw_actions(t).withColumn("a", a.parse_id_action(F.col("raw")))


@query("parse_id_action", "B17", f"WITH {PARSED} SELECT event_id, kind AS action_type, element_id, element_name, text, target_url AS url, direction, key_comb, page_number, answer FROM parsed")
def parse_id_action(t):
    fields = ("action_type", "element_id", "element_name", "text", "url", "direction", "key_comb", "page_number", "answer")
    return parsed(t).select("event_id", *[F.col(f"a.{name}").alias(name) for name in fields])


DO_TEXT = """CASE event_type WHEN 'click' THEN '# press it' || chr(10) || 'do(action="Click", element="' || k || '")'
 WHEN 'view' THEN 'do(action="Scroll Down")' WHEN 'signup' THEN 'do(action="Type", argument="blue ' || k || '", element="7")'
 WHEN 'purchase' THEN 'exit(message="order ' || k || '")' ELSE CASE k % 2 WHEN 0 THEN 'send_msg_to_user("oops ' || k || '")' ELSE 'do(action="Fly")' END END"""


@query("parse_do_action", "B18", f"""WITH {v.KEYED_EVENTS} SELECT event_id, CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'view' THEN 'SCROLL' WHEN 'signup' THEN 'TYPE'
 WHEN 'purchase' THEN 'STOP' ELSE CASE k % 2 WHEN 0 THEN 'STOP' END END AS action_type, CASE event_type WHEN 'click' THEN '' || k WHEN 'signup' THEN '7' END AS element_id,
 CASE event_type WHEN 'signup' THEN 'blue ' || k END AS text, CASE event_type WHEN 'purchase' THEN 'order ' || k WHEN 'error' THEN CASE k % 2 WHEN 0 THEN 'oops ' || k END END AS answer,
 CASE event_type WHEN 'view' THEN 'down' END AS direction FROM keyed""")
def parse_do_action(t):
    s = v.keyed_events(t).withColumn("a", a.parse_do_action(F.expr(DO_TEXT)))
    return s.select("event_id", *[F.col(f"a.{n}").alias(n) for n in ("action_type", "element_id", "text", "answer", "direction")])


CALL_TEXT = """CASE event_type WHEN 'click' THEN 'page.get_by_role("link", name="v1.' || k || '").click()'
 WHEN 'view' THEN 'page.goto("http://shop.example.com/' || k || '")' WHEN 'signup' THEN 'page.locator("#q").fill("red ' || k || '")'
 WHEN 'purchase' THEN 'page.stop("order ' || k || '")' ELSE CASE k % 3 WHEN 0 THEN 'page.press("Enter")' WHEN 1 THEN 'page.page_focus(' || (k % 4) || ')' ELSE 'page.dance()' END END"""


@query("parse_call_action", "B19", f"""WITH {v.KEYED_EVENTS} SELECT event_id, CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'view' THEN 'GOTO_URL' WHEN 'signup' THEN 'TYPE' WHEN 'purchase' THEN 'STOP'
 ELSE CASE k % 3 WHEN 0 THEN 'KEY_PRESS' WHEN 1 THEN 'PAGE_FOCUS' END END AS action_type,
 CASE event_type WHEN 'view' THEN 'http://shop.example.com/' || k END AS url, CASE event_type WHEN 'signup' THEN 'red ' || k END AS text,
 CASE event_type WHEN 'purchase' THEN 'order ' || k END AS answer, CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'Enter' END AS key_comb,
 CASE WHEN event_type = 'error' AND k % 3 = 1 THEN k % 4 END AS page_number FROM keyed""")
def parse_call_action(t):
    s = v.keyed_events(t).withColumn("a", a.parse_call_action(F.expr(CALL_TEXT)))
    return s.select("event_id", *[F.col(f"a.{n}").alias(n) for n in ("action_type", "url", "text", "answer", "key_comb", "page_number")])


@query("is_valid_action", "B20", f"""WITH {PARSED} SELECT event_id, CASE WHEN kind IS NULL THEN false WHEN kind IN ('NEW_TAB','GO_BACK','STOP','SCROLL','KEY_PRESS','PAGE_FOCUS','GOTO_URL','HOVER','CLICK','TYPE') THEN true
  ELSE length(answer) > 0 END AS valid FROM parsed""")
def is_valid_action(t):
    return parsed(t).select("event_id", a.is_valid_action(F.col("a")).alias("valid"))


KEY = """CASE WHEN kind IN ('NEW_TAB','GO_BACK') THEN kind || ':' WHEN kind = 'SCROLL' THEN kind || ':' || direction WHEN kind = 'KEY_PRESS' THEN kind || ':' || key_comb
 WHEN kind IN ('CLICK','TYPE','HOVER') THEN kind || ':' || CASE WHEN element_id IS NOT NULL THEN 'id|' || element_id ELSE 'role|' || CASE kind WHEN 'CLICK' THEN 'button' ELSE 'textbox' END || '|' || element_name END
 WHEN kind = 'PAGE_FOCUS' THEN kind || ':' || page_number WHEN kind = 'GOTO_URL' THEN kind || ':' || target_url WHEN kind IN ('STOP','SEND_MESSAGE_TO_USER') THEN kind || ':' || answer END"""


@query("action_key", "B21", f"WITH {PARSED} SELECT event_id, {KEY} AS key FROM parsed")
def action_key(t):
    return parsed(t).select("event_id", a.action_key(F.col("a")).alias("key"))


@query("action_to_str", "B22", f"""WITH {PARSED}, e AS (SELECT *, '[' || coalesce(element_id, '') || ']' AS el FROM parsed)
SELECT event_id, CASE kind WHEN 'CLICK' THEN 'click ' || el || ' where ' || el || ' is ' || event_type WHEN 'HOVER' THEN 'hover ' || el || ' where ' || el || ' is ' || event_type
 WHEN 'TYPE' THEN 'type ' || el || ' [' || text || '] where ' || el || ' is ' || event_type WHEN 'SCROLL' THEN 'scroll [' || direction || ']' WHEN 'KEY_PRESS' THEN 'press [' || key_comb || ']'
 WHEN 'GOTO_URL' THEN 'goto [' || target_url || ']' WHEN 'NEW_TAB' THEN 'new_tab' WHEN 'GO_BACK' THEN 'go_back' WHEN 'PAGE_FOCUS' THEN 'page_focus [' || page_number || ']'
 WHEN 'STOP' THEN 'stop [' || answer || ']' WHEN 'SEND_MESSAGE_TO_USER' THEN 'send_msg_to_user("' || answer || '")' END AS written,
 CASE kind WHEN 'CLICK' THEN 'click ' || el || ' where ' || el WHEN 'HOVER' THEN 'hover ' || el || ' where ' || el
 WHEN 'TYPE' THEN 'type ' || el || ' [' || text || '] where ' || el WHEN 'SCROLL' THEN 'scroll [' || direction || ']' WHEN 'KEY_PRESS' THEN 'press [' || key_comb || ']'
 WHEN 'GOTO_URL' THEN 'goto [' || target_url || ']' WHEN 'NEW_TAB' THEN 'new_tab' WHEN 'GO_BACK' THEN 'go_back' WHEN 'PAGE_FOCUS' THEN 'page_focus [' || page_number || ']'
 WHEN 'STOP' THEN 'stop [' || answer || ']' WHEN 'SEND_MESSAGE_TO_USER' THEN 'send_msg_to_user("' || answer || '")' END AS marked,
 CASE WHEN element_id IS NOT NULL THEN lower(kind) || ' ' || el WHEN kind = 'SCROLL' THEN 'scroll [' || direction || ']' WHEN kind = 'STOP' THEN 'stop [' || answer || ']' ELSE lower(kind) END AS short FROM e""")
def action_to_str(t):
    return parsed(t).select(
        "event_id", a.action_to_str(F.col("a"), F.col("event_type")).alias("written"),
        a.action_to_str(F.col("a"), tag="som").alias("marked"), a.concise_action(F.col("a")).alias("short"),
    )


REPLY = """CASE conv_id % 4 WHEN 0 THEN 'THOUGHT: ' || role || chr(10) || 'ACTION: ```click [' || turn || ']```'
 WHEN 1 THEN role || ' In summary, the next action I will perform is ```scroll [down]```' WHEN 2 THEN 'do ```stop [' || turn || ']``` now' ELSE text END"""


@query("extract_thought_action", "B23", f"""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN role WHEN 1 THEN role ELSE '' END AS thought,
 CASE conv_id % 4 WHEN 0 THEN 'click [' || turn || ']' WHEN 1 THEN 'scroll [down]' WHEN 2 THEN 'stop [' || turn || ']' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS action FROM conversations""")
def extract_thought_action(t):
    parts = a.extract_thought_action(F.expr(REPLY))
    return t.conversations.select("conv_id", "turn", parts["thought"].alias("thought"), parts["action"].alias("action"))


@query("extract_action_tail", "B53", """SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'move(' || turn || ')' WHEN 1 THEN 'grasp(' || turn || ')' WHEN 2 THEN 'None ACTION.' ELSE 'turn_left()' END AS action FROM conversations""")
def extract_action_tail(t):
    reply = F.expr("""CASE conv_id % 4 WHEN 0 THEN 'plan ' || role || ' ACTION: move(' || turn || ') # go' WHEN 1 THEN 'ACTION: ```python' || chr(10) || 'grasp(' || turn || ')```'
        WHEN 2 THEN role ELSE 'ACTION: stop ACTION: `turn_left()` ' END""")
    return t.conversations.select("conv_id", "turn", a.extract_action_tail(reply).alias("action"))


@query("edit_selector", "B47", f"""WITH {v.TURNS} SELECT conv_id, turn, CASE WHEN contains(content, 'edit_rule(') THEN nullif(regexp_extract(content, 'edit_rule[(]"([^"]*)"', 1), '') END AS selector,
 regexp_replace(list_extract(string_split(content, chr(10)), -1), '^\\s+|\\s+$', '', 'g') AS line FROM turns WHERE role = 'agent'""")
def edit_selector(t):
    agent = v.turns(t).where("role = 'agent'")
    return agent.select("conv_id", "turn", a.edit_selector(F.col("content")).alias("selector"), a.action_line(F.col("content")).alias("line"))


KEYS = "CASE k % 4 WHEN 0 THEN 'key.keyboard.w' WHEN 1 THEN 'key.keyboard.space' WHEN 2 THEN 'key.keyboard.unknown' ELSE 'key.keyboard.e' END"


@query("input_to_action", "B49", f"""WITH {v.KEYED_EVENTS}, r AS (SELECT event_id, k, k % 4 = 0 AS fwd, k % 4 = 1 AS jmp, k % 4 = 3 AS inv, (k % 5 - 2) * (k % 2) AS dx, event_type, k % 3 AS button FROM keyed)
SELECT event_id, CAST(fwd AS INT) AS forward, CAST(jmp AS INT) AS jump, CAST(inv AS INT) AS inventory, 0 AS sneak, round(dx * 0.15, 6) AS camera_x,
  CAST(event_type = 'click' AND button = 0 AS INT) AS attack, CAST(event_type = 'click' AND button = 1 AS INT) AS use_item, CAST(event_type = 'click' AND button = 2 AS INT) AS pick_item
FROM r WHERE fwd OR jmp OR inv OR dx <> 0 OR event_type = 'click'""")
def input_to_action(t):
    rows = v.keyed_events(t).select(
        "event_id", F.expr(f"array({KEYS})").alias("keys"), F.expr("cast((k % 5 - 2) * (k % 2) as double)").alias("dx"),
        F.lit(0.0).alias("dy"),
        F.expr("CASE WHEN event_type = 'click' THEN array(k % 3) ELSE cast(array() as array<int>) END").alias("buttons"),
    )
    live = rows.where(~m.is_null_input(F.col("keys"), F.col("dx"), F.col("dy"), F.col("buttons")))
    flagged = live.select("*", *m.input_flags(F.col("keys")))

    def button(number: int):
        return F.array_contains("buttons", number).cast("int")

    return flagged.select(
        "event_id", "forward", "jump", "inventory", "sneak", F.round(m.camera(F.col("dx")), 6).alias("camera_x"),
        button(0).alias("attack"), button(1).alias("use_item"), button(2).alias("pick_item"),
    )


@query("rewrite_image_url", "B43", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '/tmp/' || conv_id || '.png' END AS image, text FROM conversations""")
def rewrite_image_url(t):
    parts = F.expr("""CASE WHEN turn % 2 = 0 THEN array(named_struct('type', 'text', 'text', text, 'image_url', cast(null as string)),
        named_struct('type', 'image_url', 'text', cast(null as string), 'image_url', 'file:///tmp/' || conv_id || '.png'))
        ELSE array(named_struct('type', 'text', 'text', text, 'image_url', cast(null as string))) END""")
    done = t.conversations.select("conv_id", "turn", m.rewrite_image_url(parts).alias("c"))
    return done.select("conv_id", "turn", F.get("c.image_url", F.lit(1)).alias("image"), F.get("c.text", F.lit(0)).alias("text"))


@query("parse_episode_name", "B51", """SELECT event_id, 'ep' || user_id || '_models[a,b]_mxFrm2000_nmFrm' || (event_id % 900) || '_seed' || user_id || '_term' || upper(left(event_type, 1)) || substring(event_type, 2) AS name,
  CAST(event_id % 900 AS INT) AS num_frames, true AS is_term, upper(left(event_type, 1)) || substring(event_type, 2) AS term_reason FROM events""")
def parse_episode_name(t):
    name = m.episode_name(
        F.expr("'ep' || user_id"), F.lit("a"), F.lit("b"), F.lit(2000), F.expr("event_id % 900"), F.col("user_id"), F.col("event_type")
    )
    named = t.events.select("event_id", name.alias("name"))
    parts = m.parse_episode_name(F.concat(F.lit("/data/"), F.col("name")))
    return named.select("event_id", "name", parts["num_frames"].alias("num_frames"), parts["is_term"].alias("is_term"), parts["term_reason"].alias("term_reason"))
