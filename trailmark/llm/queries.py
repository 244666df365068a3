"""Registered queries: each operator applied to its whole table, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import (
    code_points, conversations, decontamination, exact_dedup, langid, licenses, neardup, packing, periodic_runs, quality, token_files,
    toxicity, url_rules,
)
from trailmark.llm.common import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), specials=True)


#: Words of a text as a list, in DuckDB; A-Z lower-cased.
_SQL_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op5_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k, least(10, len(w)) AS n
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) AS g(i) WHERE len(w) > 0),
hit AS (
  SELECT d.r, s.p, l.n, win.item
  FROM d, (SELECT DISTINCT n FROM win) AS l, unnest(generate_series(1, len(d.w) - l.n + 1)) AS s(p), win
  WHERE win.n = l.n AND array_to_string(d.w[s.p:s.p + l.n - 1], ' ') = win.k),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM hit, unnest(generate_series(p, p + n - 1)) AS x(q) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""")
def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontamination.contamination(decontamination.find_passages(docs, benchmark, keep=["doc_id"]))


@query("op6_token_files")
def write_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), specials=True)


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return code_points.quality_rules(table(spark, folder, "documents"), ["doc_id"])


@query("op8_near_duplicates")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), ["doc_id"])


@query("op10_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.predict_languages(docs, langid.learn(langid.learnable(docs)), ["doc_id"])
    held_out = (remainder("doc_id", 4) == 2).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


@query("op1_url_rules")
def judge_urls(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, folder, "pages"), table(spark, folder, "labels"), ["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _scored(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


@query("op2_quality_fm")
def score_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.learn(docs, labels, remainder("doc_id", 3) != 1)
    return _scored(quality.score_quality(docs, model, ["doc_id"]), 0.5)


@query("op3_toxicity_trees")
def score_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.learn(docs, labels, remainder("doc_id", 3) != 1)
    return _scored(model.score(docs, ["doc_id"]), 0.7)


def _license_sql() -> str:
    """Phrases and templates of the license scan, by comparing every phrase place and every block with every template."""
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in licenses.PHRASES.items())
    templates = ", ".join(
        "('{}', {!r}, {!r}::VARCHAR[], {!r}::VARCHAR[])".format(label, sorted(words), *licenses.telling(words))
        for label, words in licenses.template_words(licenses.TEMPLATES)
    )
    return rf"""
WITH p(label, words) AS (VALUES {phrases}), t(label, words, needed, barred) AS (VALUES {templates}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SQL_WORDS}, []) AS w,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
place AS (SELECT r, label, i - 1 AS start FROM d, p, unnest(generate_series(1, len(w) - len(words) + 1)) AS g(i)
  WHERE w[i] = words[1] AND w[i:i + len(words) - 1] = words),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY r),
block AS (SELECT DISTINCT r, list_distinct(regexp_extract_all(b, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS own
  FROM d, unnest(regexp_split_to_array(low, '[.!?]+(?:\s+|$)|\n\s*\n')) AS x(b)),
found AS (SELECT r, label, len(list_intersect(own, words)) / len(words)::DOUBLE AS share FROM block, t
  WHERE len(list_intersect(own, words)) >= ceil({licenses.THRESHOLD} * len(words) - 1e-9)
    AND list_has_all(own, needed) AND NOT list_has_any(own, barred)),
best AS (SELECT r, max(share) AS share FROM found GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM found UNION SELECT r, label FROM place) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)"""


@query("op9_license_scan", _license_sql())
def scan_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"), ["doc_id"])


@query("op11_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY low ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(low) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)
WINDOW same AS (PARTITION BY low)""")
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"), ["doc_id"])


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that their rows' checksums call for; nulls are one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_f")).where("_f <> 0")
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_f") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


@query("op12_conversation_repair")
def repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    found = conversations.audit_conversations(damaged(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def looped(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by its id's checksum, repeats some of its words from one place on."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    docs = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string"))).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    g, n = F.expr("_h div 10"), F.size("_w")
    docs = docs.withColumn("_g", g).withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.expr("(size(_w) - _a) div (3 + _g % 8)"))
    begin = F.expr("slice(_w, 1, int(_a))")
    rest = F.expr("transform(sequence(0, int(size(_w) - _a) - 1), i -> element_at(_w, int(_a + i % _p) + 1))")
    made = F.array_join(F.concat(begin, rest), " ")
    return docs.withColumn("text", F.when((F.col("_h") % 10 == 0) & (n > 0), made).otherwise(F.col("text"))).drop("_h", "_w", "_g", "_a", "_p")


@query("op13_periodic_runs")
def find_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(looped(table(spark, folder, "documents").select("doc_id", "text")), ["doc_id"])
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
