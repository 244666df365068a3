"""Queries: accessibility-tree text and links."""

from pyspark.sql import functions as F

from trailmark.catalog import views as v
from trailmark.catalog.registry import query
from trailmark.functions import observations as o
from trailmark.functions import urls
from trailmark.operators.navigation import first_nav_candidate, navigation_links
from trailmark.sources.readers import without_tabs

LINKS = f"""{v.OBS_LINES},
links AS (SELECT page_id, url, pos, regexp_extract(line, '(?i)^\\[([0-9]+)\\]\\s+link\\s+''([^'']+)''\\s*,\\s*url=''([^'']+)''', ['id', 'label', 'link']) AS m FROM obs_lines),
nav AS (SELECT page_id, pos, m.id AS id, m.label AS label, m.link AS link, url FROM links WHERE m.link <> ''
  AND (m.link LIKE 'http://%' OR m.link LIKE 'https://%') AND m.link <> url
  AND NOT (contains(m.link, '#') AND split_part(m.link, '#', 1) = split_part(url, '#', 1))
  AND NOT contains(lower(m.label), 'quick view'))"""
CLICK = "CASE page_id % 4 WHEN 0 THEN 'click(' || chr(39) || (page_id % 9 + 1) || chr(39) || ')' WHEN 1 THEN 'CLICK(\"' || (page_id % 7 + 1) || '\")' WHEN 2 THEN 'click(' || (page_id % 5) || ')' ELSE ' click(' || chr(39) || (page_id % 11 + 1) || '\") ' END"
CLICK_ID = "nullif(regexp_extract(trim(act), '(?i)^click\\([\"'']([0-9]+)[\"'']\\)$', 1), '')"
BY_ID = f"""{LINKS},
clicks AS (SELECT page_id, url, text_observation, {CLICK} AS act FROM obs),
ids AS (SELECT *, {CLICK_ID} AS id FROM clicks),
firsts AS (SELECT page_id, regexp_extract(line, '^\\[([0-9]+)\\]', 1) AS id, min(pos) AS pos FROM obs_lines GROUP BY 1, 2),
found AS (SELECT ids.page_id, ids.url, ids.act, ids.id, nullif(l.m.link, '') AS link
  FROM ids LEFT JOIN firsts f ON f.page_id = ids.page_id AND f.id = ids.id LEFT JOIN links l ON l.page_id = f.page_id AND l.pos = f.pos)"""


def with_click(t):
    return v.observations(t).withColumn("act", F.expr(CLICK))


@query("is_navigation_url", "B10", f"WITH {LINKS} SELECT page_id, pos - 1 AS pos, id AS element_id, link AS link_url FROM nav")
def is_navigation_url(t):
    return navigation_links(v.observations(t), ["page_id"]).select("page_id", F.col("pos").cast("long").alias("pos"), "element_id", "link_url")


@query("first_nav_candidate", "F4", f"""WITH {LINKS}
SELECT page_id, arg_min(id, ((NOT (link LIKE '%.html' OR contains(link, '/the'))), pos)) AS candidate_eid,
  arg_min(label, ((NOT (link LIKE '%.html' OR contains(link, '/the'))), pos)) AS candidate_label,
  arg_min(link, ((NOT (link LIKE '%.html' OR contains(link, '/the'))), pos)) AS candidate_url, count(*) AS num_candidates FROM nav GROUP BY page_id""")
def nav_candidate(t):
    return first_nav_candidate(v.observations(t), ["page_id"], ("/the",))


@query("parse_click_id", "B11", f"WITH c AS (SELECT page_id, {CLICK} AS act FROM pages) SELECT page_id, {CLICK_ID} AS id FROM c")
def parse_click_id(t):
    return t.pages.select("page_id", o.parse_click_id(F.expr(CLICK)).alias("id"))


@query("link_url_by_id", "B12", f"WITH {BY_ID} SELECT page_id, link FROM found")
def link_url_by_id(t):
    s = with_click(t)
    return s.select("page_id", o.link_url_by_id(F.col("text_observation"), o.parse_click_id(F.col("act"))).alias("link"))


@query("has_nav_rejected", "B13", f"WITH {BY_ID} SELECT page_id, coalesce(link LIKE 'http://%' OR link LIKE 'https://%', false) AS nav FROM found")
def has_nav_rejected(t):
    s = with_click(t)
    return s.select("page_id", o.has_nav_rejected(F.col("text_observation"), F.col("act")).alias("nav"))


@query("resolve_rejected_url", "B54", f"""WITH {BY_ID} SELECT page_id, 'page.goto("' || CASE WHEN link LIKE 'http%' OR link LIKE 'javascript:%' THEN link
  WHEN link LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || link END || '")' AS action FROM found""")
def resolve_rejected_url(t):
    s = with_click(t)
    return s.select("page_id", o.resolve_rejected_url(F.col("text_observation"), F.col("act"), F.col("url")).alias("action"))


@query("visible_elements", "B14", f"""WITH {v.OBS_LINES},
e AS (SELECT page_id, pos, regexp_extract(line, '(?i)\\[[0-9]+\\]\\s+(button|link|textbox|input|combobox|checkbox|radio|menuitem|option|tab|switch|image)\\s+''([^'']+)''', ['role', 'label']) AS m FROM obs_lines),
d AS (SELECT page_id, lower(m.role) || ': ' || trim(m.label) AS item, min(pos) AS pos FROM e WHERE m.role <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM d)
SELECT obs.page_id, coalesce(string_agg(item, ', ' ORDER BY pos), '') AS visible FROM obs LEFT JOIN r ON r.page_id = obs.page_id AND n <= 24 GROUP BY obs.page_id""")
def visible_elements(t):
    return v.observations(t).select("page_id", o.visible_elements(F.col("text_observation")).alias("visible"))


@query("element_context", "B15", f"""WITH {v.OBS_LINES}, hit AS (SELECT page_id, min(pos) AS hit_pos FROM obs_lines WHERE line LIKE '[' || (page_id % 9 + 1) || ']%' GROUP BY page_id)
SELECT obs.page_id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS context FROM obs LEFT JOIN hit USING (page_id)
  LEFT JOIN obs_lines l ON l.page_id = obs.page_id AND l.pos BETWEEN hit_pos - 2 AND hit_pos + 2 GROUP BY obs.page_id""")
def element_context(t):
    wanted = F.expr("'' || (page_id % 9 + 1)")
    return v.observations(t).select("page_id", o.element_context(F.col("text_observation"), wanted).alias("context"))


SIMPLE = f"""{v.OBS_LINES}, tr AS (SELECT page_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM obs_lines),
m AS (SELECT page_id, pos, line, regexp_extract(line, '^[[]([0-9]+)[]] (link|button|StaticText|textbox) (.*)$', ['id', 'role', 'rest']) AS g FROM tr),
q AS (SELECT page_id, pos, line, g, CASE WHEN g.role IN ('link', 'button') THEN regexp_extract(g.rest, '''([^'']*)''', 1)
  WHEN g.role = 'textbox' THEN regexp_replace(trim(split_part(g.rest, 'required:', 1)), '^[''"]+|[''"]+$', '', 'g') ELSE regexp_replace(g.rest, '^[''"]+|[''"]+$', '', 'g') END AS label
  FROM m WHERE g.role <> '' AND NOT contains(lower(line), 'generic')),
o AS (SELECT page_id, pos, '[' || g.id || '] ' || g.role || ' ''' || label || '''' || CASE WHEN g.role = 'link' THEN ', url=''' || regexp_extract(line, 'url=''([^'']*)''', 1) || ''''
  WHEN g.role = 'button' AND contains(line, 'expanded: True') THEN ', hasPopup=''dialog'', expanded=True, controls=''menu'''
  WHEN g.role = 'button' AND contains(line, 'expanded:') THEN ', expanded=False' WHEN contains(line, 'focused: True') THEN ', focused' ELSE '' END AS simple_line
  FROM q WHERE g.role = 'link' OR label <> '')"""


@query("simplify_observation", "B16", f"""WITH {SIMPLE} SELECT obs.page_id, coalesce(string_agg(o.simple_line, chr(10) ORDER BY pos), '') AS simple
FROM obs LEFT JOIN o USING (page_id) GROUP BY obs.page_id""")
def simplify_observation(t):
    return v.observations(t).select("page_id", o.simplify_observation(F.col("text_observation")).alias("simple"))


@query("clean_static_text", "B36", f"""WITH RECURSIVE {v.OBS_LINES},
li AS (SELECT page_id, pos, line, contains(lower(line), 'statictext') AS static, regexp_extract(line, '(?s)[[][0-9]+[]] StaticText .(.*).$', 1) AS inner_text FROM obs_lines),
f AS (SELECT page_id, 0::BIGINT AS pos, []::VARCHAR[] AS kept FROM obs
  UNION ALL SELECT f.page_id, li.pos, CASE WHEN NOT static OR (inner_text <> '' AND len(list_filter(kept[-3:], lambda s: contains(s, inner_text))) = 0) THEN list_append(kept, line) ELSE kept END
  FROM f JOIN li ON li.page_id = f.page_id AND li.pos = f.pos + 1)
SELECT page_id, array_to_string(arg_max(kept, pos), chr(10)) AS cleaned FROM f GROUP BY page_id""")
def clean_static_text(t):
    return v.observations(t).select("page_id", o.clean_static_text(F.col("text_observation")).alias("cleaned"))


@query("read_observations", "A13", f"WITH {v.OBSERVATIONS} SELECT page_id, url, replace(text_observation, chr(9), '') AS text_observation FROM obs")
def read_observations(t):
    tabbed = v.observations(t).withColumn("text_observation", F.regexp_replace("text_observation", r"\[", "\t["))
    return without_tabs(tabbed)


@query("extract_links", "G8", """WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS pos FROM pages)
SELECT page_id, pos, label, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([a-z]+):', 1) || ':' || href
  WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href WHEN href LIKE '#%' THEN split_part(url, '#', 1) || href ELSE href END AS link FROM a""")
def extract_links(t):
    pattern = '<a href="([^"]*)">([^<]*)</a>'
    pairs = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("href"),
        F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("label"),
    )
    flat = t.pages.select("page_id", "url", F.posexplode(pairs).alias("at", "p"))
    return flat.select(
        "page_id", (F.col("at") + 1).cast("long").alias("pos"), F.col("p.label").alias("label"),
        urls.resolve(F.col("url"), F.col("p.href")).alias("link"),
    )
