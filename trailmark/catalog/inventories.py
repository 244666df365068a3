"""Queries: inventories, recipes, newest rows."""

from pyspark.sql import functions as F

from trailmark.catalog import views as v
from trailmark.catalog.registry import query
from trailmark.operators import inventories as i
from trailmark.sources.readers import recipe_results

SLOTS = "slots AS (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 'none' ELSE 'item' || (l_partkey % 5) END AS type, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem)"


def slots(t):
    return t.lineitem.selectExpr("l_orderkey", "CASE WHEN l_linenumber = 7 THEN 'none' ELSE 'item' || (l_partkey % 5) END AS type", "CAST(l_quantity AS BIGINT) AS quantity")


@query("inventory_totals", "D27", f"WITH {SLOTS} SELECT l_orderkey, type, CAST(sum(quantity) AS BIGINT) AS quantity FROM slots WHERE type <> 'none' GROUP BY 1, 2")
def inventory_totals(t):
    return i.inventory_totals(slots(t), ["l_orderkey"])


@query("goal_satisfied", "D28", f"""WITH {SLOTS}, tot AS (SELECT l_orderkey, type, sum(quantity) AS q FROM slots WHERE type <> 'none' GROUP BY 1, 2), o AS (SELECT DISTINCT l_orderkey FROM lineitem),
b AS (SELECT o.l_orderkey, coalesce(max(q) FILTER (type IN ('item1', 'item2')), 0) AS tagged, coalesce(max(q) FILTER (type = 'item0'), 0) AS plain FROM o LEFT JOIN tot USING (l_orderkey) GROUP BY 1)
SELECT l_orderkey, tagged >= 20 AND plain >= 10 AS satisfied FROM b""")
def goal_satisfied(t):
    goals = t.lineitem.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.expr("array(named_struct('item', 'wood', 'n', 20), named_struct('item', 'item0', 'n', 10))")).alias("g")).select("l_orderkey", "g.*")
    tags = t.region.selectExpr("CASE WHEN r_regionkey IN (1, 2) THEN 'wood' ELSE 'stone' END AS tag", "'item' || r_regionkey AS item")
    return i.goal_satisfied(goals, slots(t), tags, ["l_orderkey"])


def recipes(t):
    raw = t.part.selectExpr(
        "'p' || p_partkey AS item",
        "CASE p_partkey % 3 WHEN 0 THEN 'minecraft:crafting_shaped' WHEN 1 THEN 'minecraft:crafting_shapeless' ELSE 'minecraft:smelting' END AS type",
        "CASE WHEN p_partkey % 3 = 0 THEN array('ABA', CASE WHEN p_size > 25 THEN 'BB' ELSE 'A ' END) END AS pattern",
        "CASE WHEN p_partkey % 3 = 0 THEN map('A', named_struct('item', 'minecraft:p' || (p_partkey + 1), 'tag', cast(null as string)), 'B', named_struct('item', cast(null as string), 'tag', 'minecraft:' || p_type)) END AS key",
        "CASE WHEN p_partkey % 3 = 1 THEN array(named_struct('item', 'minecraft:p' || (p_partkey + 2), 'tag', cast(null as string)), named_struct('item', 'minecraft:p' || (p_partkey + 2), 'tag', cast(null as string)), named_struct('item', cast(null as string), 'tag', 'minecraft:' || p_type)) END AS ingredients",
        "CASE WHEN p_partkey % 3 = 2 THEN 'minecraft:p' || p_partkey WHEN p_size > 25 THEN '{\"item\": \"minecraft:p' || p_partkey || '\", \"count\": 4}' ELSE '{\"item\": \"minecraft:p' || p_partkey || '\"}' END AS result",
    )
    return recipe_results(raw)


@query("explode_recipe", "C14 A9", """WITH p AS (SELECT *, CASE WHEN p_size > 25 THEN 4 ELSE 1 END AS c FROM part)
SELECT 'p' || p_partkey AS item, c AS result_count, 'p' || (p_partkey + 1) AS ingredient, false AS is_tag, CASE WHEN p_size > 25 THEN 2 ELSE 3 END AS amount, true AS usable FROM p WHERE p_partkey % 3 = 0
UNION ALL SELECT 'p' || p_partkey, c, p_type, true, CASE WHEN p_size > 25 THEN 3 ELSE 1 END, true FROM p WHERE p_partkey % 3 = 0
UNION ALL SELECT 'p' || p_partkey, c, 'p' || (p_partkey + 2), false, 2, true FROM p WHERE p_partkey % 3 = 1 UNION ALL SELECT 'p' || p_partkey, c, p_type, true, 1, true FROM p WHERE p_partkey % 3 = 1""")
def explode_recipe(t):
    return i.explode_recipe(recipes(t))


@query("lookup_recipe", "C15", """WITH w AS (SELECT 'p' || (p_partkey * 2) AS name FROM part UNION SELECT p_type FROM part), m AS (SELECT p_type AS tag, 'p' || p_partkey AS item FROM part WHERE p_size < 20),
r AS (SELECT 'p' || p_partkey AS item, CASE p_partkey % 3 WHEN 0 THEN 'minecraft:crafting_shaped' WHEN 1 THEN 'minecraft:crafting_shapeless' ELSE 'minecraft:smelting' END AS type FROM part),
x AS (SELECT name, coalesce(item, name) AS item, item IS NOT NULL AS from_tag FROM w LEFT JOIN m ON tag = name) SELECT name, x.item, from_tag, coalesce(type, 'raw') AS kind FROM x LEFT JOIN r ON r.item = x.item""")
def lookup_recipe(t):
    wanted = t.part.selectExpr("'p' || (p_partkey * 2) AS name").union(t.part.selectExpr("p_type AS name"))
    tags = t.part.where("p_size < 20").selectExpr("p_type AS tag", "'p' || p_partkey AS item")
    return i.lookup_recipe(wanted, tags, recipes(t))


@query("attribute_text", "D32", """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || ', ' || p_type ELSE p_type END AS text FROM part""")
def attribute_text(t):
    product = t.part.selectExpr("p_partkey", "array(named_struct('name', CASE WHEN p_size > 25 THEN 'Brand Name' ELSE 'Maker' END, 'value', p_brand), named_struct('name', 'Colour', 'value', p_name), named_struct('name', 'Item TYPE', 'value', p_type)) AS attributes")
    return i.joined_attribute(product, "p_partkey", "brand |OR| type")


@query("latest_by", "D33", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def latest_by(t):
    return i.latest_by(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("attach_element_text", "C16", f"""WITH {v.OBS_LINES}, n AS (SELECT page_id, regexp_extract(line, '^[[]([0-9]+)', 1) AS element_id, min(line) AS text FROM obs_lines GROUP BY 1, 2),
a AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN '' || (page_id % 40 + 1) END AS element_id FROM pages)
SELECT a.page_id, a.element_id, CASE WHEN a.element_id IS NULL THEN '' ELSE coalesce(text, 'no match found') END AS text FROM a LEFT JOIN n ON n.page_id = a.page_id AND n.element_id = a.element_id""")
def attach_element_text(t):
    lines = v.observations(t).select("page_id", F.explode(F.split("text_observation", "\n")).alias("text"))
    nodes = lines.withColumn("element_id", F.regexp_extract("text", r"^\[([0-9]+)", 1))
    actions = t.pages.selectExpr("page_id", "CASE WHEN page_id % 5 <> 0 THEN '' || (page_id % 40 + 1) END AS element_id")
    return i.attach_element_text(actions, nodes, ["page_id"])
