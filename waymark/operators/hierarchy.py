"""Regions as an adjacency list: closures, roots and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def closure(regions: DataFrame) -> DataFrame:
    """(region_id, depth, anc): each region with itself and its ancestors. A parent that is no region is kept and ends the
    walk; a cycle ends where it meets itself. One recursive query, whose steps are joins on the parent: as many as the
    hierarchy is deep, not as it is large. The session's bound on the rows of a recursion is lifted."""
    spark = regions.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        """with recursive walk (region_id, path) max recursion level 1000000 as (
          select region_id, array(region_id) from {regions}
          union all
          select walk.region_id, concat(path, array(parent_region_id)) from walk join {regions} as up on up.region_id = element_at(path, -1)
          where parent_region_id is not null and not array_contains(path, parent_region_id))
        select region_id, size(path) - 1 as depth, element_at(path, -1) as anc from walk""",
        regions=regions.select("region_id", "parent_region_id"),
    )


def roots(regions: DataFrame) -> DataFrame:
    """(region_id, root): the last known ancestor."""
    known = closure(regions).join(regions.select(F.col("region_id").alias("anc")), "anc", "left_semi")
    return known.groupBy("region_id").agg(F.max_by("anc", "depth").alias("root"))


def nearest(regions: DataFrame, granularity: str) -> DataFrame:
    """(region_id, anc): the first ancestor of a granularity, null if there is none."""
    of = regions.select(F.col("region_id").alias("anc"), "granularity")
    hit = closure(regions).join(of, "anc").filter(F.col("granularity") == granularity)
    first = hit.groupBy("region_id").agg(F.min_by("anc", "depth").alias("anc"))
    return regions.select("region_id").join(first, "region_id", "left")


def counts(entities: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_id, n): entities of each region and of all below it, zero-filled. Entities are counted by region
    before they meet the closure."""
    own = entities.groupBy("region_id").agg(F.count("*").alias("k"))
    rolled = own.join(closure(regions), "region_id").groupBy(F.col("anc").alias("region_id")).agg(F.sum("k").alias("n"))
    return regions.select("region_id").join(rolled, "region_id", "left").select("region_id", F.coalesce("n", F.lit(0)).alias("n"))


def members(entities: DataFrame, regions: DataFrame, hub: Column | str) -> DataFrame:
    """Entities whose closure holds a region."""
    inside = closure(regions).filter(F.col("anc") == hub).select("region_id")
    return entities.join(inside, "region_id", "left_semi")


def by_range(categories: DataFrame, low: str, label: str) -> DataFrame:
    """categories, a configured list, with their place: the highest lower bound first, those without a range last."""
    return categories.withColumn("place", F.row_number().over(Window.orderBy(F.col(low).desc_nulls_last(), label)))
