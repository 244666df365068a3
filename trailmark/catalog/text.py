"""Queries: scalar text, number and URL expressions."""

from pyspark.sql import functions as F

from trailmark.catalog import views as v
from trailmark.catalog.registry import query
from trailmark.functions import geometry, text, urls
from trailmark.functions import messages as m
from trailmark.operators.tasks import valid_samples as valid_sample_rows


@query("safe_int", "B1", """WITH s AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' ' || n_chars || ' ' WHEN 1 THEN n_chars || '.7'
  WHEN 2 THEN lang WHEN 3 THEN '-' || n_chars WHEN 4 THEN '1_000' ELSE NULL END AS x FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(trim(x), '[+-]?[0-9]+(_[0-9]+)*') THEN CAST(replace(trim(x), '_', '') AS BIGINT) ELSE 0 END AS value FROM s""")
def safe_int(t):
    x = F.expr("CASE doc_id % 6 WHEN 0 THEN ' ' || n_chars || ' ' WHEN 1 THEN n_chars || '.7' WHEN 2 THEN lang "
               "WHEN 3 THEN '-' || n_chars WHEN 4 THEN '1_000' ELSE NULL END")
    return t.documents.select("doc_id", text.safe_int(x).alias("value"))


@query("norm_domain", "B2", """SELECT doc_id, coalesce(nullif(trim(CASE doc_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE ' ' || source END), ''), 'unknown') AS domain FROM documents""")
def norm_domain(t):
    x = F.expr("CASE doc_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE ' ' || source END")
    return t.documents.select("doc_id", text.norm_domain(x).alias("domain"))


@query("rel_bin", "B3", """SELECT page_id, CASE WHEN page_id % 101 < 25 THEN 'Q1_0-25%' WHEN page_id % 101 < 50 THEN 'Q2_25-50%'
  WHEN page_id % 101 < 75 THEN 'Q3_50-75%' ELSE 'Q4_75-100%' END AS rel_bin FROM pages""")
def rel_bin(t):
    return t.pages.select("page_id", text.rel_bin((F.col("page_id") % 101) / 100).alias("rel_bin"))


@query("truncate", "B5", """SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 397) || '...' ELSE text END AS cut,
  CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS clipped FROM documents""")
def truncate(t):
    return t.documents.select("doc_id", text.truncate(F.col("text"), 400).alias("cut"), text.clip(F.col("text"), 200).alias("clipped"))


@query("summarize_page_state", "B5", r"""SELECT doc_id, 'Top accessibility snippet: ' || CASE WHEN length(s) > 500 THEN left(s, 497) || '...' ELSE s END AS state
FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)""")
def summarize_page_state(t):
    return t.documents.select("doc_id", text.summarize_page_state(F.col("text")).alias("state"))


@query("truncate_observation", "B55", "SELECT doc_id, left(text, 3840) AS cut FROM documents")
def truncate_observation(t):
    return t.documents.select("doc_id", text.truncate_observation(F.col("text"), 3840).alias("cut"))


@query("strip_non_ascii", "B35", r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]+', '', 'g') AS ascii FROM documents")
def strip_non_ascii(t):
    return t.documents.select("doc_id", text.strip_non_ascii(F.col("text")).alias("ascii"))


@query("clean_html", "B34", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?s)<!--.*?-->', '', 'g'), '(?s)<style.*?>.*?</style>', '', 'g'), '(?s)<script.*?>.*?</script>', '', 'g'), '\s+', ' ', 'g')) AS html FROM pages""")
def clean_html(t):
    return t.pages.select("page_id", text.clean_html(F.col("html")).alias("html"))


@query("segments", "B37", r"""SELECT conv_id, turn, len(regexp_extract_all(text, '\p{L}{1,7}')) + len(regexp_extract_all(text, '[^\p{L} \n]')) AS segments FROM conversations""")
def segments(t):
    return t.conversations.select("conv_id", "turn", text.segments(F.col("text")).cast("long").alias("segments"))


@query("token_estimate", "B38", r"""WITH s AS (SELECT conv_id, turn, replace(replace(replace(text, chr(10) || chr(10), chr(10)), '```', '`'), '##', '#') AS x FROM conversations),
w AS (SELECT conv_id, turn, unnest(regexp_split_to_array(x, '\s+')) AS word FROM s)
SELECT s.conv_id, s.turn, len(regexp_extract_all(any_value(x), '[^\p{L}\p{N} ]'))
  + CAST(sum(ceil(len(regexp_extract_all(word, '[\p{L}\p{N}]')) / 6.0)) AS BIGINT) AS tokens
FROM s JOIN w ON s.conv_id = w.conv_id AND s.turn = w.turn GROUP BY s.conv_id, s.turn""")
def token_estimate(t):
    return t.conversations.select("conv_id", "turn", text.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("context_limit_error", "B39 U4", """WITH s AS (SELECT doc_id, lower(text || CASE doc_id % 3 WHEN 0 THEN ' Prompt too Long' WHEN 1 THEN ' tokens' ELSE '' END) AS x FROM documents)
SELECT doc_id, (contains(x,'prompt') OR contains(x,'context') OR contains(x,'tokens')) AND (contains(x,'limit') OR contains(x,'exceed') OR contains(x,'max')
  OR contains(x,'long') OR contains(x,'much') OR contains(x,'many') OR contains(x,'reach') OR contains(x,'over') OR contains(x,'up') OR contains(x,'beyond')) AS hit FROM s""")
def context_limit_error(t):
    message = F.expr("text || CASE doc_id % 3 WHEN 0 THEN ' Prompt too Long' WHEN 1 THEN ' tokens' ELSE '' END")
    return t.documents.select("doc_id", text.context_limit_error(message).alias("hit"))


@query("normalise_status", "B40", f"""WITH {v.RUNS}, n AS (SELECT o_orderkey, replace(lower(status), '_', ' ') AS status FROM runs)
SELECT o_orderkey, status, CASE status WHEN 'completed' THEN 'Completed' WHEN 'agent context limit' THEN 'Context Limit Exceeded'
  WHEN 'agent validation failed' THEN 'Invalid Format' WHEN 'agent invalid action' THEN 'Invalid Action' ELSE 'Task Limit Exceeded' END AS label FROM n""")
def normalise_status(t):
    return v.runs(t).select("o_orderkey", m.normalise_status(F.col("status")).alias("status"), m.validation_label(F.col("status")).alias("label"))


BOX = "l_extendedprice / 100 - 50 AS x, l_quantity * 20 - 30 AS y, l_quantity * 3 + 1 AS w, l_tax * 1000 + 1 AS h"


@query("viewport_ratio", "B42", f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, {BOX} FROM lineitem),
r AS (SELECT *, greatest(0, least(x + w, 1280) - greatest(x, 0)) * greatest(0, least(y + h, 720) - greatest(y, 0)) AS inside FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, round(inside / (w * h), 6) AS ratio, inside / w * h AS compat_ratio,
       round(inside / (w * h), 9) >= 0.6 AS visible FROM r""")
def viewport_ratio(t):
    b = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", *BOX.split(", "))
    box = [F.col(c) for c in ("x", "y", "w", "h")]
    ratio = geometry.viewport_ratio(*box, 1280, 720)
    return b.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(ratio, 6).alias("ratio"),
        geometry.viewport_ratio(*box, 1280, 720, compat=True).alias("compat_ratio"),
        geometry.in_viewport(F.round(ratio, 9)).alias("visible"),
    )


@query("url_match", "B31", """WITH s AS (SELECT page_id, replace(url, 'example.com', 'localhost') AS url,
  CASE page_id % 3 WHEN 0 THEN 'http://none.example |OR| ' || replace(url, 'example.com', '127.0.0.1') || '/'
       WHEN 1 THEN '/en/ |OR| /fr/' ELSE url END AS refs, CASE page_id % 3 WHEN 1 THEN 'GOLD in PRED' ELSE 'EXACT' END AS rule FROM pages),
c AS (SELECT *, regexp_replace(replace(url, 'localhost', '127.0.0.1'), '/$', '') AS pred,
  list_transform(string_split(refs, ' |OR| '), lambda r: regexp_replace(replace(r, 'localhost', '127.0.0.1'), '/$', '')) AS opts FROM s)
SELECT page_id, CASE WHEN rule = 'EXACT' THEN CAST(list_contains(opts, pred) AS DOUBLE)
  ELSE CAST(len(list_filter(opts, lambda o: contains(pred, o))) > 0 AS DOUBLE) END AS score FROM c""")
def url_match(t):
    s = t.pages.selectExpr(
        "page_id", "replace(url, 'example.com', 'localhost') AS pred",
        "CASE page_id % 3 WHEN 0 THEN 'http://none.example |OR| ' || replace(url, 'example.com', '127.0.0.1') || '/' "
        "WHEN 1 THEN '/en/ |OR| /fr/' ELSE url END AS refs",
        "CASE page_id % 3 WHEN 1 THEN 'GOLD in PRED' ELSE 'EXACT' END AS rule",
    )
    return s.select("page_id", urls.url_match(F.col("pred"), F.col("refs"), F.col("rule")).alias("score"))


@query("map_url", "B32", """SELECT page_id, replace(replace('__SHOP__/' || page_id || ' and __MAP__', '__SHOP__', 'http://localhost:7770'), '__MAP__', 'http://localhost:3000') AS filled,
  replace(url, 'example.com', 'local.test') AS real, replace(replace(url, 'http://www.', 'http://m.'), 'https://www.', 'http://m.') AS local FROM pages""")
def map_url(t):
    marks = {"__SHOP__": "http://localhost:7770", "__MAP__": "http://localhost:3000"}
    return t.pages.select(
        "page_id",
        urls.replace_placeholders(F.expr("'__SHOP__/' || page_id || ' and __MAP__'"), marks).alias("filled"),
        urls.map_url(F.col("url"), {"example.com": "local.test"}, True).alias("real"),
        urls.map_url(F.col("url"), {"http://m.": "http://www."}, False).alias("local"),
    )


@query("post_url", "B33", """WITH s AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(replace(replace(url, '/en/', '/f/en/'), '/fr/', '/f/fr/'), '/es/', '/f/es/') ELSE url END AS u FROM pages),
p AS (SELECT page_id, u, string_split(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS parts FROM s)
SELECT page_id, CASE WHEN len(parts) >= 4 AND parts[2] = 'f' THEN regexp_extract(u, '^([a-z]+://[^/?#]*)', 1) || '/f/' || parts[3] || '/' || parts[4] || '/' ELSE u END AS post FROM p""")
def post_url(t):
    u = F.expr("CASE WHEN page_id % 2 = 0 THEN replace(replace(replace(url, '/en/', '/f/en/'), '/fr/', '/f/fr/'), '/es/', '/f/es/') ELSE url END")
    return t.pages.select("page_id", urls.post_url(u).alias("post"))


@query("increment_step", "E28", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN turn || 'b+1' ELSE '' || (turn + 1) END AS step_id FROM conversations""")
def increment_step(t):
    step = F.expr("CASE WHEN turn % 3 = 0 THEN turn || 'b' ELSE '' || turn END")
    return t.conversations.select("conv_id", "turn", text.increment_step(step).alias("step_id"))


@query("split_intent", "B56", """SELECT conv_id, turn, text AS goal, CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'Previous Discoveries: found ' || turn ELSE '' END AS discoveries FROM conversations""")
def split_intent(t):
    intent = F.expr("CASE WHEN turn % 2 = 0 THEN text || chr(10) || chr(10) || 'Previous Discoveries: found ' || turn ELSE text END")
    parts = text.split_intent(intent)
    return t.conversations.select("conv_id", "turn", parts["goal"].alias("goal"), parts["discoveries"].alias("discoveries"))


@query("thought_prompt_inputs", "B50", """SELECT conv_id, turn, 'Inputs:' || chr(10) || '- GOAL: ' || text || chr(10) || '- HISTORY: ' || CASE WHEN turn % 2 = 0 THEN role ELSE '' END || chr(10)
  || '- PAGE_STATE: ' || conv_id || chr(10) || '- VISIBLE_ELEMENTS: ' || chr(10) || chr(10) AS prompt FROM conversations""")
def thought_prompt_inputs(t):
    prompt = text.thought_prompt_inputs(
        F.col("text"), F.when(F.col("turn") % 2 == 0, F.col("role")), F.col("conv_id").cast("string"), F.lit(None).cast("string")
    )
    return t.conversations.select("conv_id", "turn", prompt.alias("prompt"))


@query("ordered_quantity", "B48", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(l_quantity AS INT) END AS qty FROM lineitem WHERE 'sku' || (l_suppkey % 5) IN ('sku1', 'sku3')""")
def ordered_quantity(t):
    wanted = F.split(F.lit("sku1 |OR| sku3"), r" \|OR\| ")
    label = F.expr("CASE WHEN l_linenumber % 3 = 0 THEN 'Ordered' ELSE 'Ordered' || CAST(l_quantity AS INT) END")
    hit = F.array_contains(wanted, F.expr("'sku' || (l_suppkey % 5)"))
    return t.lineitem.where(hit).select("l_orderkey", "l_linenumber", "l_partkey", m.ordered_quantity(label).alias("qty"))


@query("valid_samples", "B52", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount * 10 >= 0.2 AND l_returnflag <> 'R'""")
def valid_samples(t):
    samples = t.lineitem.withColumn("distance", F.col("l_discount") * 10).withColumn(
        "instruction", F.when(F.col("l_returnflag") == "R", "This is an invalid example").otherwise("fix it"))
    return valid_sample_rows(samples, 0.2).select("l_orderkey", "l_linenumber", "l_partkey")
