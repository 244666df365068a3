"""Inventories, recipes and product attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.plans.lookups import attach


def inventory_totals(slots: DataFrame, keys: list[str]) -> DataFrame:
    """Quantity per item; empty slots are skipped."""
    return slots.where(F.col("type") != "none").groupBy(*keys, "type").agg(F.sum("quantity").alias("quantity"))


def goal_satisfied(goals: DataFrame, slots: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """Whether every goal (item or tag, n) is met; of a tag the largest single member must reach n."""
    totals = inventory_totals(slots, keys)
    members = tags.select(F.col("tag").alias("item"), F.col("item").alias("type"))
    is_tag = goals.select("item").join(tags.select(F.col("tag").alias("item")).distinct(), "item", "left_semi").distinct()
    tagged = goals.join(is_tag, "item", "left_semi").join(members, "item").join(totals, [*keys, "type"], "left")
    plain = goals.join(is_tag, "item", "left_anti").join(
        totals.withColumnRenamed("type", "item"), [*keys, "item"], "left"
    )
    columns = [*keys, "item", "n", F.coalesce("quantity", F.lit(0)).alias("quantity")]
    best = tagged.select(*columns).unionByName(plain.select(*columns)).groupBy(*keys, "item", "n").agg(
        F.max("quantity").alias("_best")
    )
    return best.groupBy(*keys).agg(F.bool_and(F.col("_best") >= F.col("n")).alias("satisfied"))


def ingredient_name(item: Column, tag: Column) -> Column:
    return F.regexp_replace(F.coalesce(item, tag), "^minecraft:", "")


def explode_recipe(recipes: DataFrame) -> DataFrame:
    """Ingredients of shaped and shapeless recipes with the amount of each; a symbol without use gives none.

    ``usable`` is false when a key symbol does not occur in the pattern.
    """
    symbols = F.split(F.array_join("pattern", ""), "")
    shaped = recipes.where(F.col("pattern").isNotNull()).select(
        "item", "result_count", symbols.alias("_s"), F.explode("key").alias("_k", "_v")
    )
    counted = shaped.select(
        "item", "result_count", ingredient_name(F.col("_v.item"), F.col("_v.tag")).alias("ingredient"),
        F.col("_v.item").isNull().alias("is_tag"),
        F.size(F.filter("_s", lambda s: s == F.col("_k"))).cast("long").alias("_n"),
    )
    shapeless = recipes.where(F.col("pattern").isNull() & F.col("ingredients").isNotNull()).select(
        "item", "result_count", F.explode("ingredients").alias("_v")
    )
    single = shapeless.select(
        "item", "result_count", ingredient_name(F.col("_v.item"), F.col("_v.tag")).alias("ingredient"),
        F.col("_v.item").isNull().alias("is_tag"), F.lit(1).cast("long").alias("_n"),
    )
    return counted.unionByName(single).groupBy("item", "result_count", "ingredient", "is_tag").agg(
        F.sum("_n").alias("amount"), F.bool_and(F.col("_n") > 0).alias("usable")
    )


def lookup_recipe(wanted: DataFrame, tags: DataFrame, recipes: DataFrame) -> DataFrame:
    """Each wanted name as its tag members, or itself, with the recipe kind; items without one are raw."""
    names = wanted.select("name").distinct()
    member = tags.select(F.col("tag").alias("name"), "item")
    expanded = names.join(member, "name", "left")
    rows = expanded.select("name", F.coalesce("item", "name").alias("item"), F.col("item").isNotNull().alias("from_tag"))
    kinds = recipes.select("item", F.col("type").alias("_type"))
    return attach(rows, kinds, ["item"]).select(
        "name", "item", "from_tag", F.coalesce("_type", F.lit("raw")).alias("kind")
    )


def attribute_text(cells: DataFrame, terms: str, key: str, position: str) -> DataFrame:
    """Rows whose key holds one of the terms (split by `` |OR| ``), as (key, position, value).

    ``joined_attribute`` turns the rows of one product into text.
    """
    words = [w for w in terms.lower().split(" |or| ")]
    hit = F.lit(False)
    for word in words:
        hit = hit | F.lower("name").contains(word)
    return cells.where(hit).select(key, position, "value")


def joined_attribute(product: DataFrame, key: str, terms: str) -> DataFrame:
    """The same values joined in order, for attributes held as one array per product."""
    words = [w for w in terms.lower().split(" |or| ")]

    def wanted(cell: Column) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.lower(cell["name"]).contains(word)
        return hit

    values = F.transform(F.filter("attributes", wanted), lambda cell: cell["value"])
    return product.select(key, F.array_join(values, ", ").alias("text"))


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of every key."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return newest.select(*keys, "_r.*")


def attach_element_text(actions: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Actions with the text of their element, or a note that nothing matched."""
    note = F.lit("no match found")
    texts = nodes.groupBy(*keys, "element_id").agg(F.min("text").alias("text"))
    joined = actions.join(texts, [*keys, "element_id"], "left")
    return joined.withColumn("text", F.when(F.col("element_id").isNull(), F.lit("")).otherwise(F.coalesce("text", note)))
