"""Scores of answers against task configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import answers as a
from trailmark.functions.text import let
from trailmark.plans.lookups import attach


def _included(reference: Column, answer: Column) -> Column:
    return a.included(a.clean_answer(reference), answer)


def entry_score(approach: Column, values: Column, answer: Column, verdict: Column) -> Column:
    """Score of one ``approach -> references`` entry of a configuration."""
    first = F.get(values, F.lit(0))
    number = a.str_to_int(answer)
    in_range = F.coalesce(F.forall(values, lambda rule: a.satisfies(number, rule)), F.lit(False)).cast("double")
    included = F.array_min(F.transform(values, lambda clause: a.any_alternative(_included, clause, answer)))
    excluded = F.array_min(F.transform(values, lambda clause: a.excluded(a.clean_answer(clause), answer)))
    exact = a.exact_match(first, answer)
    return (
        F.when(approach == "exact_match", exact)
        .when(approach == "required_values", in_range)
        .when(approach == "must_include", included)
        .when(approach == "must_exclude", excluded)
        .when(approach == "one_of", a.one_of(values, answer))
        .when((approach == "fuzzy_match") & (first == "N/A") & (exact == 1.0), F.lit(1.0))
        .when(approach == "fuzzy_match", verdict)
        .otherwise(F.lit(1.0))
    )


def score_answers(predictions: DataFrame, configs: DataFrame) -> DataFrame:
    """Add ``score`` to predictions (task_id, answer, verdict).

    A configuration is one row with a map of references, so every prediction is scored inside its own row;
    the only shuffle is the lookup of the configuration.
    """
    joined = attach(predictions, configs.select("task_id", "reference_answers"), ["task_id"], "inner")
    answer = a.clean_answer(F.col("answer"))
    verdict = F.col("verdict") if "verdict" in predictions.columns else F.lit(None).cast("double")

    def total(cleaned: Column) -> Column:
        scores = F.transform(
            F.map_entries("reference_answers"), lambda e: entry_score(e["key"], e["value"], cleaned, verdict)
        )
        return F.aggregate(scores, F.lit(1.0), lambda acc, x: acc * x)

    return joined.withColumn("score", let(answer, total)).drop("reference_answers")


def combine_scores(scores: DataFrame, keys: list[str], clause: str = "clause", score: str = "score") -> DataFrame:
    """Best alternative of every clause, then the product over the clauses."""
    best = scores.groupBy(*keys, clause).agg(F.max(score).alias("_best"))
    return best.groupBy(*keys).agg(F.product("_best").alias("score"))


def rouge1(pairs: DataFrame, key: str) -> DataFrame:
    """Unigram F-measure of ``answer`` against ``reference`` for every ``key``."""

    def words(text: str) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))

    def often(array: str, word: Column) -> Column:
        return F.size(array) - F.size(F.array_remove(array, word))

    split = pairs.select(key, words("reference").alias("_ref"), words("answer").alias("_pred"))
    # Row by row: the words of both sides once, each with the smaller of its two counts.
    overlap = F.aggregate(
        F.array_intersect("_ref", "_pred"), F.lit(0), lambda n, w: n + F.least(often("_ref", w), often("_pred", w))
    )
    f1 = F.try_divide(2.0 * overlap, F.size("_ref") + F.size("_pred"))
    return split.select(key, F.coalesce(f1, F.lit(0.0)).alias("rouge1"))
