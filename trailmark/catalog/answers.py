"""Queries: answer checks and verdicts."""

from pyspark.sql import functions as F

from trailmark.catalog.registry import query
from trailmark.functions import answers as a
from trailmark.operators.answering import combine_scores, rouge1, score_answers

TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+(?:[/.,-][\p{{L}}\p{{N}}_]+)*|[^\p{{L}}\p{{N}}_\s]')"
WORD = "regexp_extract(text, '([A-Za-z]+)', 1)"
PHRASE = "regexp_extract(text, '([A-Za-z]+ [a-z]+)', 1)"
PAIRS = f"""refs AS (SELECT item_id, {WORD} AS word, {PHRASE} AS phrase, text AS reference FROM benchmark),
pairs AS (SELECT doc_id, text, word, phrase, reference FROM documents JOIN refs ON item_id = doc_id % (SELECT count(*) FROM benchmark))"""
QUOTED = "CASE item_id % 3 WHEN 0 THEN chr(39) || text || chr(39) WHEN 1 THEN '\"' || text || '\"' ELSE text || chr(39) END"


def pairs(t):
    refs = t.benchmark.selectExpr("item_id", f"{WORD} AS word", f"{PHRASE} AS phrase", "text AS reference")
    docs = t.documents.selectExpr("doc_id", "text", f"doc_id % {t.benchmark.count()} AS item_id")
    return docs.join(refs, "item_id")


@query("clean_answer", "B24", """SELECT item_id, lower(text || CASE item_id % 3 WHEN 2 THEN chr(39) ELSE '' END) AS answer FROM benchmark""")
def clean_answer(t):
    return t.benchmark.select("item_id", a.clean_answer(F.expr(QUOTED)).alias("answer"))


@query("exact_match", "B25", f"""WITH {PAIRS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE CAST(lower(text) = lower(reference) AS DOUBLE) END AS score FROM pairs""")
def exact_match(t):
    answer = F.expr("CASE WHEN doc_id % 2 = 0 THEN '\"' || reference || '\"' ELSE text END")
    return pairs(t).select("doc_id", a.exact_match(F.col("reference"), answer).alias("score"))


@query("must_include", "B26 U3", f"""WITH {PAIRS} SELECT doc_id, CAST(list_contains({TOKENS.format('lower(text)')}, lower(word)) OR list_contains(flatten(list_transform({TOKENS.format('lower(text)')}, lambda w: string_split(w, '/'))), lower(word)) AS DOUBLE) AS by_word,
 CAST(contains(lower(text), lower(phrase)) AS DOUBLE) AS by_phrase FROM pairs""")
def must_include(t):
    return pairs(t).select("doc_id", a.must_include(F.col("word"), F.col("text")).alias("by_word"), a.must_include(F.col("phrase"), F.col("text")).alias("by_phrase"))


@query("must_exclude", "B27", f"""WITH {PAIRS} SELECT doc_id, 1.0 - CAST(list_contains({TOKENS.format('lower(text)')}, lower(word)) AS DOUBLE) AS by_word, 1.0 - CAST(contains(lower(text), lower(phrase)) AS DOUBLE) AS by_phrase FROM pairs""")
def must_exclude(t):
    return pairs(t).select("doc_id", a.must_exclude(F.col("word"), F.col("text")).alias("by_word"), a.must_exclude(F.col("phrase"), F.col("text")).alias("by_phrase"))


@query("one_of", "B28", f"WITH {PAIRS} SELECT doc_id, CAST(contains(lower(text), lower(phrase)) OR contains(lower(text), 'quer') AS DOUBLE) AS score FROM pairs")
def one_of(t):
    return pairs(t).select("doc_id", a.one_of(F.array("phrase", F.lit("'Quer'")), a.clean_answer(F.col("text"))).alias("score"))


@query("str_to_int", "B29", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 1000 + 7 WHEN 1 THEN o_orderkey WHEN 2 THEN NULL ELSE -o_orderkey END AS value FROM orders""")
def str_to_int(t):
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_orderkey || ',007' WHEN 1 THEN '' || o_orderkey WHEN 2 THEN o_orderkey || ' items' ELSE '-' || o_orderkey END")
    return t.orders.select("o_orderkey", a.str_to_int(text).alias("value"))


@query("satisfies", "B30", """SELECT o_orderkey, o_totalprice >= 300000 - 1e-8 OR abs(o_totalprice - 112946.26) <= 1e-8 AS at_least, o_totalprice < 200000 + 1e-8 AS below,
  o_totalprice <= 100000 + 1e-8 OR o_totalprice > 400000 - 1e-8 AS outside FROM orders""")
def satisfies(t):
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", a.satisfies(price, F.lit(">= 300000 |OR| == 112946.26")).alias("at_least"),
        a.satisfies(price, F.lit("< 200000")).alias("below"), a.satisfies(price, F.lit("<= 100000 |OR| > 400000")).alias("outside"),
    )


@query("score_answers", "C9 D13", f"""WITH {PAIRS} SELECT doc_id,
 CASE WHEN (list_contains({TOKENS.format('lower(text)')}, lower(word)) OR list_contains({TOKENS.format('lower(text)')}, 'the')) AND (contains(lower(text), 'th e') OR contains(lower(text), 't h'))
   AND NOT list_contains({TOKENS.format('lower(text)')}, 'zzz') AND (contains(lower(text), lower(phrase)) OR contains(lower(text), 'er ')) THEN 1.0 ELSE 0.0 END AS score FROM pairs""")
def answers_scored(t):
    configs = t.benchmark.selectExpr(
        "item_id AS task_id",
        f"map('must_include', array({WORD} || ' |OR| the', 'th e |OR| t h'), 'must_exclude', array('zzz'), "
        f"'one_of', array({PHRASE}, 'er ')) AS reference_answers",
    )
    predictions = t.documents.selectExpr("doc_id", f"doc_id % {t.benchmark.count()} AS task_id", "text AS answer")
    return score_answers(predictions, configs).select("doc_id", "score")


@query("combine_scores", "D13", """WITH s AS (SELECT l_orderkey, l_linenumber % 3 AS clause, max(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.5 END) AS best FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, product(best) AS score FROM s GROUP BY 1""")
def scores_combined(t):
    s = t.lineitem.selectExpr("l_orderkey", "l_linenumber % 3 AS clause", "CASE WHEN l_quantity > 25 THEN 1.0D ELSE 0.5D END AS score")
    return combine_scores(s, ["l_orderkey"])


@query("rouge1", "D31", f"""WITH {PAIRS.replace("pairs AS (", "pairs AS MATERIALIZED (", 1)}, p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM pairs), pc AS (SELECT doc_id, w, count(*) AS n FROM p GROUP BY 1, 2),
r AS (SELECT doc_id, unnest(regexp_extract_all(lower(reference), '[a-z0-9]+')) AS w FROM pairs), rc AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY 1, 2),
o AS (SELECT pc.doc_id, sum(least(pc.n, rc.n)) AS shared FROM pc JOIN rc ON pc.doc_id = rc.doc_id AND pc.w = rc.w GROUP BY 1)
SELECT doc_id, coalesce(2.0 * shared::DOUBLE / (len(regexp_extract_all(lower(text), '[a-z0-9]+')) + len(regexp_extract_all(lower(reference), '[a-z0-9]+'))), 0.0) AS rouge1 FROM pairs LEFT JOIN o USING (doc_id)""")
def rouge(t):
    return rouge1(pairs(t).select("doc_id", "reference", F.col("text").alias("answer")), "doc_id")


@query("judge_verdict", "B44", """SELECT doc_id, CASE WHEN quality = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 0.0 END ELSE CASE WHEN toxic = 1 THEN 0.0 ELSE 1.0 END END AS fuzzy,
  CASE WHEN toxic = 1 THEN 0.0 ELSE 1.0 END AS unachievable FROM labels""")
def judge_verdict(t):
    fuzzy = F.expr("CASE WHEN quality = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'Partially correct.' ELSE 'unsure' END WHEN toxic = 1 THEN 'That is INCORRECT' ELSE 'It is Correct' END")
    same = F.expr("CASE WHEN toxic = 1 THEN 'Different reason' ELSE 'the SAME' END")
    return t.labels.select("doc_id", a.fuzzy_verdict(fuzzy).alias("fuzzy"), a.unachievable_verdict(same).alias("unachievable"))


@query("pairwise_vote", "B45", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN -1 ELSE 0 END AS vote FROM labels""")
def pairwise_vote(t):
    reply = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Response 2 is bad <Answer> Response 1 </Answer>' WHEN 1 THEN '<answer>response 2</answer>' WHEN 2 THEN 'I like Response 2' ELSE 'none' END")
    return t.labels.select("doc_id", a.pairwise_vote(reply).alias("vote"))


@query("parse_judgement", "B46", """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type = 'click' END AS is_reasonable, CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE event_type END END AS category,
  CASE WHEN event_id % 5 <> 0 THEN value END AS confidence, event_id % 5 = 0 AS parse_error, CASE WHEN event_id % 5 = 0 THEN 'not json ' || props END AS raw FROM events""")
def parse_judgement(t):
    reply = F.expr("""CASE WHEN event_id % 5 = 0 THEN 'not json ' || props WHEN event_id % 3 = 0 THEN '{"is_reasonable": ' || (event_type = 'click') || ', "confidence": ' || value || '}'
      ELSE '{"is_reasonable": ' || (event_type = 'click') || ', "category": "' || event_type || '", "confidence": ' || value || '}' END""")
    parts = a.parse_judgement(reply)
    return t.events.select("event_id", *[parts[n].alias(n) for n in ("is_reasonable", "category", "confidence", "parse_error", "raw")])
