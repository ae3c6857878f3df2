"""Result-table analytics: reference curves, projections, split plans, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POWER = 1.06

# fixed values: yearly loss by age above and by years below the peak, classes by per cent
AFTER_PEAK = [(35.0, 50.0, 0.006), (50.0, 60.0, 0.009), (60.0, 70.0, 0.013), (70.0, 80.0, 0.018), (80.0, 120.0, 0.023)]
BEFORE_PEAK = [(0.0, 7.0, 0.003), (7.0, None, 0.01)]
AGE_CLASSES = [(80.0, "world"), (70.0, "national"), (60.0, "regional"), (50.0, "recreational")]


def standard(rows: DataFrame, knots: DataFrame) -> DataFrame:
    """rows with the reference time at their distance: between knots along straight lines of logarithms, outside them by
    the power law. The knots are a short configured list that becomes one array."""
    ks = sorted((r["d"], r["t"]) for r in knots.collect())
    x = F.col("distance")
    out = F.lit(ks[-1][1]) * F.pow(x / ks[-1][0], F.lit(POWER))
    for (d, t), (d2, t2) in zip(ks[-2::-1], ks[:0:-1], strict=True):
        share = (F.ln(x) - F.ln(F.lit(d))) / (F.ln(F.lit(d2)) - F.ln(F.lit(d)))
        out = F.when(x < d2, F.exp(F.ln(F.lit(t)) + share * (F.ln(F.lit(t2)) - F.ln(F.lit(t))))).otherwise(out)
    first = F.lit(ks[0][1]) * F.pow(x / ks[0][0], F.lit(POWER))
    return rows.withColumn("standard", F.when(x < ks[0][0], first).otherwise(out))


def percent_of_standard(rows: DataFrame, knots: DataFrame, bands: list[tuple[float, float | None, float]]) -> DataFrame:
    """rows with standard, the factor of their age band (one for ages in none) and percent = standard / (time x factor)."""
    age, factor = F.col("age"), F.lit(1.0)
    for low, high, value in bands:
        factor = F.when((age >= low) & (F.lit(True) if high is None else age < high), value).otherwise(factor)
    scored = standard(rows, knots).withColumn("factor", factor)
    return scored.withColumn("percent", 100 * F.col("standard") / (F.col("time") * F.col("factor")))


def weighted_splits(rows: DataFrame, key: str, every: float, most: int, skew: float) -> DataFrame:
    """(key, i, part, time, running): intervals of a distance `total`, whose times are weighted from slow to fast by skew and add up
    to `time` exactly; plans of more than `most` rows are rejected."""
    plan = splits(rows, key, every, most).join(rows, key)
    middle = (F.col("running") - F.col("part") / 2) / F.col("total")
    w = Window.partitionBy(key)
    share = F.col("part") * (1 + skew * (1 - 2 * middle))
    out = plan.withColumn("_w", share).withColumn("split", F.col("_w") / F.sum("_w").over(w) * F.col("time"))
    return out.withColumn("passed", F.sum("split").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).select(key, "i", "part", "split", "passed")


def projections(rows: DataFrame, targets: list[float], base: float) -> DataFrame:
    """Each result projected to each target by the power and the linear law."""
    each = rows.withColumn("target", F.explode(F.lit(targets)))
    ratio = F.col("target") / base
    return each.select(
        "o_orderkey", "target", F.round(F.col("time") * F.pow(ratio, F.lit(POWER)), 4).alias("power_law"), F.round(F.col("time") * F.col("target") / base, 4).alias("linear")
    )


def splits(rows: DataFrame, key: str, every: int, most: int) -> DataFrame:
    """(key, i, part, running): intervals that sum exactly to the total; plans of more than `most` rows are rejected."""
    n = F.ceil(F.col("total") / every).cast("int")
    plan = rows.filter((n > 0) & (n <= most)).withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    running = F.least(F.col("i") * every, F.col("total"))
    return plan.select(key, "i", (running - (F.col("i") - 1) * every).alias("part"), running.alias("running"))


def age_factor(age: Column) -> Column:
    """The part of an open-class result that an age lets expect: 1 from 25 to 35, falling by bands on both sides down to a floor."""
    older, younger = F.greatest(1 - banded(age, AFTER_PEAK), F.lit(0.15)), F.greatest(1 - banded(25 - age, BEFORE_PEAK), F.lit(0.1))
    return F.when(age > 35, older).when(age < 25, younger).otherwise(F.lit(1.0))


def tier(value: Column, classes: list[tuple[float, str]], rest: str) -> Column:
    """The class of the first threshold, from the highest down, that a value reaches."""
    out = F.lit(rest)
    for least, name in sorted(classes):
        out = F.when(value >= least, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def banded(x: Column, bands: list[tuple[float, float | None, float]]) -> Column:
    """Sum over bands of overlap times rate."""
    total = F.lit(0.0)
    for low, high, rate in bands:
        top = x if high is None else F.least(x, F.lit(high))
        total = total + F.greatest(top - low, F.lit(0.0)) * rate
    return total
