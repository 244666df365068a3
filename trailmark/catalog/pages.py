"""Queries: node trees, boxes, comments, tournaments and logs."""

from pyspark.sql import functions as F

from trailmark.catalog import views as v
from trailmark.catalog.registry import query
from trailmark.catalog.scoring import LOG
from trailmark.operators import boxes as b
from trailmark.operators import logs as lg
from trailmark.operators import trees as tr
from trailmark.operators.inventories import latest_by

# Events as the nodes of 20 trees: node j of a page hangs below node (j - 1) // 3.
NODES = """nodes AS (SELECT event_id % 20 AS page_id, event_id // 20 AS node_id, CASE WHEN event_id // 20 > 0 THEN (event_id // 20 - 1) // 3 END AS parent_id, event_id // 20 AS ord,
 CASE event_type WHEN 'error' THEN 'generic' WHEN 'view' THEN 'listitem' ELSE event_type END AS role, CASE WHEN event_type IN ('error', 'view') AND event_id % 2 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'n' || chr(39) || event_id ELSE 'n' || event_id END AS name,
 event_id % 7 = 0 AS focused, value, event_id % 11 = 3 AS is_text FROM events)"""


def nodes(t):
    return t.events.selectExpr(
        "event_id % 20 AS page_id", "event_id DIV 20 AS node_id", "CASE WHEN event_id DIV 20 > 0 THEN (event_id DIV 20 - 1) DIV 3 END AS parent_id",
        "event_id DIV 20 AS ord", "CASE event_type WHEN 'error' THEN 'generic' WHEN 'view' THEN 'listitem' ELSE event_type END AS role",
        "CASE WHEN event_type IN ('error', 'view') AND event_id % 2 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'n' || chr(39) || event_id ELSE 'n' || event_id END AS name",
        "filter(array(named_struct('name', 'level', 'value', if(event_id % 3 = 0, '2', null)), named_struct('name', 'focused', 'value', 'True')), p -> p.name = 'level' OR event_id % 7 = 0) AS properties",
        "event_id % 11 = 3 AS is_text",
        "CASE WHEN value < 3 THEN null ELSE array(value * 10, 100.0D, CASE WHEN event_type = 'signup' THEN 0.0D ELSE 50.0D END, 20.0D) END AS bound", "value",
    )


UP = """anc AS (SELECT page_id, node_id, parent_id AS up FROM nodes UNION ALL SELECT a.page_id, a.node_id, p.parent_id FROM anc a JOIN nodes p ON p.page_id = a.page_id AND p.node_id = a.up WHERE NOT (p.parent_id IS NULL OR {keep})),
near AS (SELECT a.page_id, a.node_id, a.up FROM anc a LEFT JOIN nodes p ON p.page_id = a.page_id AND p.node_id = a.up WHERE a.up IS NULL OR p.parent_id IS NULL OR {keep}),
paths AS (SELECT page_id, node_id, lpad('' || ord, 10, '0') AS path, 0 AS level FROM nodes WHERE parent_id IS NULL UNION ALL SELECT c.page_id, c.node_id, p.path || '/' || lpad('' || c.ord, 10, '0'), p.level + 1 FROM nodes c JOIN paths p ON p.page_id = c.page_id AND p.node_id = c.parent_id)"""
SHOWN = "p.value >= 3 AND p.role <> 'signup' AND p.value * 10 < 1280 AND (least(p.value * 10 + 50, 1280) - p.value * 10) * 20 / (50.0 * 20.0) >= 0.6"


@query("promote_children", "G1", f"""WITH RECURSIVE {NODES}, {UP.format(keep=SHOWN)}
SELECT page_id, node_id, up AS new_parent, row_number() OVER (PARTITION BY page_id ORDER BY path) AS position FROM near JOIN paths USING (page_id, node_id) JOIN nodes p USING (page_id, node_id) WHERE p.parent_id IS NULL OR ({SHOWN})""")
def promote_children(t):
    return tr.promote_children(nodes(t), tr.visible_node(1280, 720)).select("page_id", "node_id", "new_parent", "position")


@query("prune_tree", "G4", f"""WITH RECURSIVE {NODES}, {UP.format(keep="p.node_id % 3 <> 1")}
SELECT page_id, node_id, up AS new_parent, row_number() OVER (PARTITION BY page_id ORDER BY path) AS position FROM near JOIN paths USING (page_id, node_id) WHERE node_id = 0 OR node_id % 3 <> 1""")
def prune_tree(t):
    rows = nodes(t)
    return tr.prune_tree(rows, rows.where("node_id % 3 <> 1")).select("page_id", "node_id", "new_parent", "position")


WRAPPED = "node_id % 3 <> 1"


@query("prune_wrappers", "G4", f"""WITH RECURSIVE {NODES}, on_ AS (SELECT n.*, CASE WHEN n.parent_id IS NULL THEN true WHEN n.is_text THEN p.{WRAPPED} ELSE n.{WRAPPED} END AS on_, n.node_id % 5 <> 0 AS plain FROM nodes n LEFT JOIN nodes p ON p.page_id = n.page_id AND p.node_id = n.parent_id),
held AS (SELECT DISTINCT page_id, parent_id AS node_id, true AS holds FROM nodes WHERE is_text),
w AS (SELECT o.*, o.on_ AND plain AND NOT is_text AND parent_id IS NOT NULL AND holds IS NULL AS wrap FROM on_ o LEFT JOIN held USING (page_id, node_id)),
s AS (SELECT page_id, node_id, parent_id FROM w WHERE on_ AND NOT wrap UNION ALL SELECT w.page_id, w.node_id, w.parent_id FROM s JOIN w ON w.page_id = s.page_id AND w.node_id = s.parent_id),
full_ AS (SELECT DISTINCT page_id, node_id FROM s),
a1 AS (SELECT page_id, node_id, parent_id AS up FROM w WHERE on_ UNION ALL SELECT a.page_id, a.node_id, p.parent_id FROM a1 a JOIN w p ON p.page_id = a.page_id AND p.node_id = a.up WHERE NOT p.on_),
kids AS (SELECT a.page_id, a.up AS node_id, count(*) AS n FROM a1 a JOIN w p ON p.page_id = a.page_id AND p.node_id = a.up AND p.on_ JOIN full_ f ON f.page_id = a.page_id AND f.node_id = a.node_id GROUP BY 1, 2),
st AS (SELECT w.*, on_ AND NOT (wrap AND coalesce(n, 0) <= 1) AS stays FROM w LEFT JOIN kids USING (page_id, node_id)),
a2 AS (SELECT page_id, node_id, parent_id AS up FROM st WHERE stays UNION ALL SELECT a.page_id, a.node_id, p.parent_id FROM a2 a JOIN st p ON p.page_id = a.page_id AND p.node_id = a.up WHERE NOT p.stays),
paths AS (SELECT page_id, node_id, lpad('' || ord, 10, '0') AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT c.page_id, c.node_id, p.path || '/' || lpad('' || c.ord, 10, '0') FROM nodes c JOIN paths p ON p.page_id = c.page_id AND p.node_id = c.parent_id)
SELECT a.page_id, a.node_id, a.up AS new_parent, row_number() OVER (PARTITION BY a.page_id ORDER BY path) AS position FROM a2 a LEFT JOIN st p ON p.page_id = a.page_id AND p.node_id = a.up JOIN paths ON paths.page_id = a.page_id AND paths.node_id = a.node_id WHERE a.up IS NULL OR p.stays""")
def prune_wrappers(t):
    rows = nodes(t).select("page_id", "node_id", "parent_id", "ord", "is_text")
    pruned = tr.prune_tree(rows, rows.where(WRAPPED), text=F.col("is_text"), plain=F.expr("node_id % 5 <> 0"))
    return pruned.select("page_id", "node_id", "new_parent", "position")


@query("render_tree", "G2 M9", f"""WITH RECURSIVE {NODES}, f AS (SELECT *, NOT (name = '' AND ((NOT focused AND role IN ('generic', 'listitem')) OR (focused AND role = 'listitem'))) AS shown FROM nodes),
r AS (SELECT page_id, node_id, lpad('' || ord, 10, '0') AS path, 0 AS above, shown FROM f WHERE parent_id IS NULL
 UNION ALL SELECT c.page_id, c.node_id, r.path || '/' || lpad('' || c.ord, 10, '0'), r.above + CAST(r.shown AS INT), c.shown FROM f c JOIN r ON r.page_id = c.page_id AND r.node_id = c.parent_id)
SELECT page_id, node_id, row_number() OVER (PARTITION BY page_id ORDER BY path) AS position, repeat(chr(9), above) || '[' || node_id || '] ' || role || ' ' || CASE WHEN contains(name, chr(39)) THEN '"' || name || '"' ELSE chr(39) || name || chr(39) END || CASE WHEN focused THEN ' focused: True' ELSE '' END AS line
FROM r JOIN f USING (page_id, node_id) WHERE r.shown""")
def render_tree(t):
    return tr.render_tree(nodes(t))


@query("keep_neighbourhood", "G3", f"""WITH RECURSIVE {NODES}, k AS (SELECT page_id, node_id FROM nodes WHERE node_id % 37 = 20),
paths AS (SELECT page_id, node_id, lpad('' || ord, 10, '0') AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT c.page_id, c.node_id, p.path || '/' || lpad('' || c.ord, 10, '0') FROM nodes c JOIN paths p ON p.page_id = c.page_id AND p.node_id = c.parent_id),
a AS (SELECT page_id, node_id AS seed, node_id AS at_, 0 AS d FROM k UNION ALL SELECT a.page_id, seed, n.parent_id, d + 1 FROM a JOIN nodes n ON n.page_id = a.page_id AND n.node_id = a.at_ WHERE d < 2 AND n.parent_id IS NOT NULL),
c AS (SELECT page_id, node_id AS seed, node_id AS at_, 0 AS d FROM k UNION ALL SELECT c.page_id, seed, n.node_id, d + 1 FROM c JOIN nodes n ON n.page_id = c.page_id AND n.parent_id = c.at_ WHERE d < 2),
cr AS (SELECT c.page_id, at_, row_number() OVER (PARTITION BY c.page_id, seed ORDER BY path) AS n FROM c JOIN paths p ON p.page_id = c.page_id AND p.node_id = c.at_ WHERE d > 0),
ix AS (SELECT page_id, node_id, parent_id, row_number() OVER (PARTITION BY page_id, parent_id ORDER BY ord) AS i FROM nodes WHERE parent_id IS NOT NULL AND NOT is_text),
up AS (SELECT page_id, node_id, parent_id FROM nodes JOIN k USING (page_id, node_id) UNION ALL SELECT n.page_id, n.node_id, n.parent_id FROM up JOIN nodes n ON n.page_id = up.page_id AND n.node_id = up.parent_id),
sb AS (SELECT s.page_id, s.node_id FROM k JOIN ix m USING (page_id, node_id) JOIN ix s ON s.page_id = m.page_id AND s.parent_id = m.parent_id AND s.i BETWEEN m.i - 1 AND m.i + 1)
SELECT page_id, node_id FROM k UNION SELECT page_id, at_ FROM a UNION SELECT page_id, at_ FROM cr WHERE n <= 5 UNION SELECT page_id, node_id FROM sb UNION SELECT page_id, node_id FROM up""")
def keep_neighbourhood(t):
    rows = nodes(t)
    return tr.keep_neighbourhood(rows, rows.where("node_id % 37 = 20"), 1, 5, 1, keep_parent=True, text=F.col("is_text"))


COMMENTS = "cm AS (SELECT event_id % 20 AS post_id, event_id // 20 AS comment_id, CASE WHEN event_id // 20 > 0 THEN (event_id // 20 - 1) // 3 END AS parent_id, 'u' || (user_id % 10) AS username, event_type AS content, ts AS time FROM events)"


def comments(t):
    return t.events.selectExpr("event_id % 20 AS post_id", "event_id DIV 20 AS comment_id", "CASE WHEN event_id DIV 20 > 0 THEN (event_id DIV 20 - 1) DIV 3 END AS parent_id", "'u' || (user_id % 10) AS username", "event_type AS content", "ts AS time")


@query("comment_descendants", "G6", f"WITH RECURSIVE {COMMENTS}, l AS (SELECT post_id, comment_id, 0 AS level FROM cm WHERE parent_id IS NULL UNION ALL SELECT c.post_id, c.comment_id, level + 1 FROM cm c JOIN l ON l.post_id = c.post_id AND l.comment_id = c.parent_id) SELECT * FROM l")
def comment_descendants(t):
    return tr.comment_descendants(comments(t)).select("post_id", "comment_id", "level")


@query("parent_of_latest", "C13", f"WITH {COMMENTS}, n AS (SELECT post_id, username, arg_max(comment_id, (time, comment_id)) AS latest_id, arg_max(parent_id, (time, comment_id)) AS parent_id FROM cm WHERE parent_id IS NOT NULL GROUP BY 1, 2) SELECT n.post_id, n.username, latest_id, n.parent_id, p.username AS parent_username, p.content AS parent_content FROM n JOIN cm p ON p.post_id = n.post_id AND p.comment_id = n.parent_id")
def parent_of_latest(t):
    return tr.parent_of_latest(comments(t))


@query("latest_comment", "D33", f"WITH {COMMENTS} SELECT post_id, username, arg_max(comment_id, (time, comment_id)) AS comment_id FROM cm GROUP BY 1, 2")
def latest_comment(t):


    return latest_by(comments(t), ["post_id", "username"], ["time", "comment_id"]).select("post_id", "username", "comment_id")


@query("pairwise_tournament", "G7", f"""WITH {v.ACTIONS}, z AS (SELECT task_id, event_id, k, step_no - 1 AS pos, count(*) OVER (PARTITION BY task_id) AS n FROM actions),
best AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY k DESC, pos) = 1), rounds AS (SELECT unnest(range(0, 30)) AS r),
m AS (SELECT task_id, event_id, CAST(pos AS BIGINT) >> r AS p, (n + (1::BIGINT << r) - 1) >> r AS size FROM best, rounds)
SELECT task_id, event_id AS cand, count(*) FILTER (size > 1 AND NOT (p = size - 1 AND size % 2 = 1)) AS wins FROM m GROUP BY 1, 2""")
def pairwise_tournament(t):
    rows = v.actions(t).select("task_id", (F.col("step_no") - 1).alias("pos"), F.col("event_id").alias("cand"), F.col("k").alias("attr"))
    return tr.pairwise_tournament(rows, "task_id", lambda x, y: F.signum(x - y).cast("int"))


BOXES = """bx AS (SELECT l_suppkey AS page_id, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id, l_extendedprice / 50 - 100 AS "left", l_quantity * 30 - 100 AS top, l_discount * 500 + 5 AS width, l_tax * 500 + 5 AS height,
 l_returnflag = 'A' AS interactable, CASE l_returnflag WHEN 'R' THEN 'IMG' ELSE 'DIV' END AS element, l_linestatus AS alt, ' text ' || (l_partkey % 50) AS text_content FROM lineitem),
seen AS (SELECT *, "left" + width AS "right", top + height AS bottom FROM bx WHERE top + height >= 0 AND top <= 720 AND "left" + width >= 0 AND "left" <= 1280 AND width * height <= 0.8 * 1280 * 720)"""


def boxes(t):
    rows = t.lineitem.selectExpr(
        "l_suppkey AS page_id", "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id", "l_extendedprice / 50 - 100 AS left", "l_quantity * 30 - 100 AS top",
        "l_discount * 500 + 5 AS width", "l_tax * 500 + 5 AS height", "l_returnflag = 'A' AS interactable", "CASE l_returnflag WHEN 'R' THEN 'IMG' ELSE 'DIV' END AS element",
        "l_linestatus AS alt", "' text ' || (l_partkey % 50) AS text_content",
    )
    return rows.withColumn("right", F.col("left") + F.col("width")).withColumn("bottom", F.col("top") + F.col("height"))


@query("label_boxes", "G5 A12", f"""WITH {BOXES} SELECT page_id, id, row_number() OVER (PARTITION BY page_id ORDER BY id) AS label, round(("left" + "right") / 2, 6) AS center_x, round((top + bottom) / 2, 6) AS center_y FROM seen WHERE interactable""")
def label_boxes(t):
    out = b.label_boxes(boxes(t), 0, 0, 1280, 720)
    return out.select("page_id", "id", "label", F.round("center_x", 6).alias("center_x"), F.round("center_y", 6).alias("center_y"))


@query("box_text_lines", "G5", f"""WITH {BOXES}, c AS (SELECT page_id, id, interactable, element, CASE WHEN element = 'IMG' THEN alt ELSE '' END || trim(text_content) AS content FROM seen),
m AS (SELECT *, min(id) OVER (PARTITION BY page_id, content) AS head, sum(CAST(interactable AS INT)) OVER (PARTITION BY page_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS label FROM c)
SELECT page_id, id, CASE WHEN interactable THEN '[' || label || '] [' || element || '] [' ELSE '[] [StaticText] [' END || content || ']' AS line FROM m WHERE interactable OR id = head""")
def box_text_lines(t):
    return b.text_lines(boxes(t), 0, 0, 1280, 720)


LABELS = "lb AS (SELECT l_suppkey AS page_id, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id, l_extendedprice / 10 AS x1, l_quantity * 60 AS y1, l_extendedprice / 10 + 20 AS x2, l_quantity * 60 + 12 AS y2 FROM lineitem)"


@query("label_overlaps", "C11", f"WITH {LABELS} SELECT DISTINCT a.page_id, a.id FROM lb a JOIN lb b ON a.page_id = b.page_id AND b.id < a.id AND NOT (a.x2 < b.x1 + 4 OR a.x1 > b.x2 - 4 OR a.y1 > b.y2 - 4 OR a.y2 < b.y1 + 4)")
def label_overlaps(t):
    rows = t.lineitem.selectExpr("l_suppkey AS page_id", "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id", "l_extendedprice / 10 AS x1", "l_quantity * 60 AS y1", "l_extendedprice / 10 + 20 AS x2", "l_quantity * 60 + 12 AS y2")
    return b.label_overlaps(rows, 4, 20).select("page_id", "id")


def merged(t):
    logs = t.documents.select(F.col("doc_id").alias("file"), F.expr(LOG).alias("log"))
    return lg.merge_logs(logs, "file", "log", t.documents.where("doc_id % 4 <> 0").select(F.col("doc_id").cast("int").alias("task_id")))


@query("merge_logs", "E26", """WITH l AS (SELECT CAST(doc_id % 50 AS INT) AS task_id, max(doc_id) AS file FROM documents GROUP BY 1)
SELECT task_id, file, 2 + len(string_split(text, chr(10))) + CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END AS n_lines FROM l JOIN documents ON doc_id = file WHERE task_id % 4 <> 0""")
def merge_logs(t):
    return merged(t).select("task_id", "file", "n_lines")


@query("unfinished_ids", "E26 F9", "SELECT CAST(doc_id AS INT) AS task_id FROM documents WHERE NOT (doc_id < 50 AND doc_id % 4 <> 0)")
def unfinished_ids(t):
    return lg.unfinished_ids(t.documents.select(F.col("doc_id").cast("int").alias("task_id")), merged(t))


@query("error_runs", "E27", """WITH l AS (SELECT CAST(doc_id % 50 AS INT) AS task_id, max(doc_id) AS file FROM documents GROUP BY 1) SELECT task_id, CASE WHEN file % 2 = 0 THEN 2 ELSE 1 END AS errors FROM l WHERE task_id % 4 <> 0""")
def error_runs(t):
    logs = t.documents.select(F.col("doc_id").alias("file"), F.concat(F.expr(LOG), F.expr("CASE WHEN doc_id % 3 = 1 THEN '' ELSE chr(10) || '[Unhandled Error] x' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '[OpenAI Error] y' ELSE '' END END")).alias("log"))
    single = logs.withColumn("log", F.when(F.col("file") % 3 == 1, F.concat_ws("\n", F.expr("'[Config file]: /tmp/' || (file % 50) || '.json'"), F.lit("[Unhandled Error] x"), F.expr("CASE WHEN file % 2 = 0 THEN '[OpenAI Error] y' ELSE 'end' END"))).otherwise(F.col("log")))
    renders = t.documents.where("doc_id % 4 <> 0").select(F.col("doc_id").cast("int").alias("task_id"))
    return lg.error_runs(lg.merge_logs(single, "file", "log", renders))


@query("logged_out_pages", "E27", "SELECT page_id FROM pages WHERE contains(html, 'Username or email') OR contains(html, 'mentier')")
def logged_out_pages(t):
    return lg.logged_out_pages(t.pages, "html", (*lg.LOGGED_OUT_TEXTS, "mentier")).select("page_id")
