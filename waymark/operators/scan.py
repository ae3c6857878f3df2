"""Prefix scans over an order, also where one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.sources.staged import written


def max_plus(rows: DataFrame, group: list[str], order: list[Column], arrival: Column, gap: Column, name: str) -> DataFrame:
    """rows with `name`: at = max(arrival, at of the row before + gap), row after row in each group.

    Every row is the function x -> max(arrival, x + gap); such functions compose to one of their own kind, so the recurrence
    is an associative scan. Rows are dealt to range partitions by group and order and written, so that the partitions are what they
    are. With G the running sum of gaps, at = G + the running maximum of (arrival - G): one window inside a part. A part's
    functions compose to a single one, its sum of gaps and its last at; those, one row for each part of a group, are scanned
    in the same way and give what goes into each part.

    Defined results: a null arrival waits for nothing but the row before, and is null in front of the first arrival; a null gap is 0;
    a null group is a group. Ties in the order have any order. Column names that begin with _mp are taken."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumns({"_mp_a": arrival.cast("long"), "_mp_g": F.coalesce(gap.cast("long"), F.lit(0))})
    dealt = keyed.repartitionByRange(n, *group, *order).withColumn("_mp_part", F.spark_partition_id())
    at = Window.partitionBy("_mp_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.withColumn("_mp_sum", F.sum("_mp_g").over(at)).withColumn("_mp_top", F.max(F.col("_mp_a") - F.col("_mp_sum")).over(at))
    inside = written(inside.drop("_mp_a", "_mp_g"), "scan")
    parts = inside.groupBy("_mp_part", *group).agg(F.max("_mp_sum").alias("_mp_all"), F.max("_mp_top").alias("_mp_high"))
    # gaps are no negative numbers, so a part's last sum is its largest
    upto = Window.partitionBy(*group).orderBy("_mp_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("_mp_sums", F.coalesce(F.sum("_mp_all").over(upto), F.lit(0)))
    before = before.withColumn("_mp_in", F.max(F.col("_mp_high") - F.col("_mp_sums")).over(upto) + F.col("_mp_sums"))
    keys = ["_mp_part", *group]
    same = [inside[k].eqNullSafe(before[k]) for k in keys]
    joined = inside.join(before.select(*keys, "_mp_in"), same).drop(*(before[k] for k in keys))
    return joined.withColumn(name, F.greatest("_mp_top", "_mp_in") + F.col("_mp_sum")).drop("_mp_part", "_mp_sum", "_mp_top", "_mp_in")
