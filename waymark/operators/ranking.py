"""Places in an order, also where one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.sources.staged import written


def placed(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows with `place`, their number from 1 within their group in an order, and `total`, the size of the group. Rows are
    dealt to range partitions by group and order, so that a large group is ranked by many tasks, and written, so that the
    partitions are what they are; the sizes of a group's parts, one row each, then give the offsets. Ties have any order."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id())
    at = Window.partitionBy("_part", *group).orderBy(*order)
    inside = written(dealt.withColumn("_in", F.row_number().over(at)), "ranked")
    sizes = inside.groupBy("_part", *group).agg(F.max("_in").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy(*group))})
    keys = ["_part", *group]
    same = [inside[k].eqNullSafe(offsets[k]) for k in keys]
    joined = inside.join(offsets.select(*keys, "_before", "total"), same).drop(*(offsets[k] for k in keys))
    return joined.withColumn("place", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")
