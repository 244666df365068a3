"""URL filters: fixed host and path rules, then association rules mined from labelled pages.

Labelled urls become sets of tokens (host labels, path segments with digits folded, the words of labels and segments that
consist of several, query keys) with the label as one more item. FP-growth finds the frequent sets; rules that lead to the bad label and reach the support and confidence are
kept. A rule is indexed under its rarest token, so a token set meets only rules of which it holds the rarest token, and
each one once; all tokens of the rule are then compared. Pages with equal token sets are matched once.

All steps are DataFrame operations. The rules and the matched sets are stored tables: Spark broadcasts them below its
size limit and shuffles them above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.plans.lineage import store

#: Host, beginning of the path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Shares: of the labelled pages that hold the rule's tokens and are bad; of those with the tokens that are bad.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
BAD = "label=bad"
RESULT = ("host", "path", "rule", "verdict", "confidence")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and the path's beginning, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, begin, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(begin)
        rule = F.when(fits, F.lit(domain + begin)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The url's distinct tokens, sorted; none for an empty host."""
    query = F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    fold = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "0")
    pieces = F.concat(F.split(host, r"\."), F.transform(F.split(path, "/"), F.lower))
    words = F.flatten(F.transform(F.filter(pieces, lambda x: x.rlike("[-_.0-9]")), lambda x: F.split(x, "[-_.0-9]+")))
    parts = F.concat(
        F.transform(words, lambda x: F.concat(F.lit("word="), x)),
        F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host="), x)),
        F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path="), fold(x))),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query="), fold(F.substring_index(x, "=", 1)))),
    )
    named = F.array_sort(F.array_distinct(F.filter(parts, lambda x: ~x.endswith("="))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(named)


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Rules (anchor, tokens, confidence, support) from rows (tokens, bad); stored, one row per rule.

    ``anchor`` is the rule's rarest token. A rule is left out where a part of it alone has at least its confidence.
    """
    item = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    rows = labelled.filter(F.size("tokens") > 0).select(F.concat("tokens", item).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    frequent = store(model.freqItemsets, "itemsets")
    rules = model.associationRules.filter(F.element_at("consequent", 1) == BAD)
    rules = store(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    part = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"), F.element_at("tokens", 1).alias("token"))
    held = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(part, "token")
    shorter = (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)
    covered = held.filter(shorter & (F.col("part_confidence") >= F.col("confidence"))).select("tokens").distinct()
    rules = rules.join(covered, "tokens", "left_anti")
    single = frequent.filter(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    rarest = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(single, "token")
    rarest = rarest.groupBy("tokens", "confidence", "support").agg(F.min(F.struct("freq", "token")).alias("rarest"))
    return store(rarest.select(F.col("rarest.token").alias("anchor"), "tokens", "confidence", "support"), "index")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, confidence) of every distinct token set that holds all tokens of a rule, with its best confidence."""
    sets = token_sets.select("tokens").distinct()
    held = sets.select("tokens", F.explode("tokens").alias("anchor"))
    found = held.join(rules.select("anchor", F.col("tokens").alias("needed"), "confidence"), "anchor")
    found = found.filter(F.size(F.array_except("needed", "tokens")) == 0)
    return store(found.groupBy("tokens").agg(F.max("confidence").alias("confidence")), "matched")


def page_document(path: Column) -> Column:
    """The number of the document that a page shows: the first number that is a path segment, without an ending."""
    return F.nullif(F.regexp_extract(path, r"/([0-9]+)(?:[/.]|$)", 1), F.lit("")).try_cast("bigint")


def judge_urls(
    pages: DataFrame, labels: DataFrame, keep: Sequence[str], rules: Sequence[tuple[str, str, str]] = RULES,
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, url: str = "url",
) -> DataFrame:
    """Columns ``keep`` of every row, host, path, rule, verdict and confidence.

    ``labels`` has (doc_id, quality, toxic); a document is bad with quality 0 or toxic 1, by any of its rows; rows
    without both labels are left out. A page is labelled by the document number in its path. Pages that no fixed rule
    decides are blocked where a mined rule matches, else allowed. Null urls and urls without ``://`` have an empty host
    and path and are allowed. Repeated rows and null ids keep their rows; without labels there are no mined rules. A kept
    column named like a result column is left out.
    """
    keep = [c for c in keep if c not in RESULT]
    held, address = [F.col(c).alias(f"_keep_{c}") for c in keep], F.col(url)
    rows = pages.select(*held, address.alias("_url")).withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    rows = rows.withColumn("tokens", url_tokens(F.col("_url"), F.col("_host"), F.col("_path")))
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")
    known = labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).select("doc_id", bad)
    known = known.groupBy("doc_id").agg(F.max("bad").alias("bad"))
    labelled = rows.select("tokens", page_document(F.col("_path")).alias("doc_id")).join(known, "doc_id")
    mined = mine_rules(store(labelled.select("tokens", "bad"), "labelled"), min_support, min_confidence)
    matched = match_rules(rows, mined)
    rule, verdict = rule_columns(F.col("_host"), F.col("_path"), rules)
    judged = rows.join(matched, "tokens", "left")
    own = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        *[F.col(f"_keep_{c}").alias(c) for c in keep], F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"),
        F.coalesce(verdict, own).alias("verdict"), "confidence",
    )
