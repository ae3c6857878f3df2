"""Categories by numeric range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_match(values: DataFrame, categories: DataFrame, value: str) -> DataFrame:
    """values with the first category, in its order, whose range holds the value: both ends inclusive, no upper end
    is open. The categories are a configuration of a few rows; a join by their range stays in the map tasks."""
    cats = categories.select(F.struct("ord", "category_id", "min_v", "max_v").alias("c")).agg(F.sort_array(F.collect_list("c")).alias("cats"))
    fits = F.filter("cats", lambda c: (F.col(value) >= c["min_v"]) & (c["max_v"].isNull() | (F.col(value) <= c["max_v"])))
    # one row; every value is compared with every range
    return values.join(F.broadcast(cats)).withColumn("matched", F.get(fits, F.lit(0))["category_id"]).drop("cats")


def with_categories(entities: DataFrame, categories: DataFrame) -> DataFrame:
    """entities with `cats`: their own category and those of every numeric fact. Computed inside the row."""
    cats = categories.select(F.struct("ord", "category_id", "min_v", "max_v").alias("c")).agg(F.sort_array(F.collect_list("c")).alias("_cats"))
    fits = lambda v: F.get(F.filter("_cats", lambda c: (v >= c["min_v"]) & (c["max_v"].isNull() | (v <= c["max_v"]))), F.lit(0))["category_id"]
    own, ranged = F.array("category_id"), F.coalesce(F.transform("numeric_facts", fits), F.array().cast("array<string>"))
    # one row; every value is compared with every range
    return entities.join(F.broadcast(cats)).withColumn("cats", F.array_compact(F.array_union(own, ranged))).drop("_cats")


def memberships(entities: DataFrame, categories: DataFrame) -> DataFrame:
    """(entity_id, category_id): the entity's own category and those of every numeric fact."""
    return with_categories(entities, categories).select("entity_id", F.explode("cats").alias("category_id"))


def narrowed(entities: DataFrame, low: float, high: float | None) -> DataFrame:
    """Numeric facts cut down to a range, all kept when none lies in it, in descending order."""
    inside = F.filter("numeric_facts", lambda v: (v >= low) & (F.lit(True) if high is None else v <= high))
    chosen = F.when(F.size(inside) > 0, inside).otherwise(F.col("numeric_facts"))
    return entities.withColumn("narrowed", F.sort_array(chosen, asc=False))


def in_scope(entities: DataFrame, low: float, high: float) -> DataFrame:
    """Entities without numeric facts, or with one in the range."""
    return entities.filter((F.size("numeric_facts") == 0) | F.exists("numeric_facts", lambda v: v.between(low, high)))
