"""Candidates from crawled pages: the gates that reject them, in their fixed order, and the drafts of those that pass."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import slugify
from waymark.operators import linking, schema
from waymark.operators.lifecycle import first_reason
from waymark.operators.normalise import DESCRIPTION, DRAFT_SCORE, said
from waymark.sources.staged import written

#: Stands for a summary that is still to be written.
PENDING = "Summary pending."


def window_bounds(today: str, months: int) -> tuple[str, str]:
    """First and last day of a discovery window; a day that the last month doesn't have rolls on into the next one, as in
    JavaScript: a month after 31 January is 3 March."""
    start = date.fromisoformat(today)
    at = start.year * 12 + start.month - 1 + months
    return today, (date(at // 12, at % 12 + 1, 1) + timedelta(days=start.day - 1)).isoformat()


def in_window(day: Column, bounds: tuple[str, str]) -> Column:
    """Undated records, and those whose date lies within the bounds, compared as text."""
    return day.isNull() | day.between(*bounds)


def in_ranges(values: Column, ranges: Sequence[tuple[float, float | None]]) -> Column:
    """Whether any value lies in a range; records without values pass."""
    fits = lambda v: F.coalesce(*[F.when((v >= lo) & (F.lit(True) if hi is None else v <= hi), True) for lo, hi in ranges], F.lit(False)) if ranges else F.lit(True)
    return (F.coalesce(F.size(values), F.lit(0)) <= 0) | F.exists(values, fits)


def draft(candidates: DataFrame, as_of: str) -> DataFrame:
    """The record of each candidate (X16) with everything that isn't known yet at its default: 220 characters of description
    or a placeholder, the page it came from as its one source."""
    name = F.trim("name")
    about = F.when(F.coalesce("short_description", F.lit("")) != "", F.col("short_description")).otherwise(F.concat(name, F.lit(" -- details pending review.")))
    source = F.struct(
        F.when(F.coalesce("source_url", F.lit("")) != "", F.col("source_url")).otherwise(F.col("page_url")).alias("url"), F.col("domain").alias("label"),
        F.lit("aggregator").alias("type"), F.lit(as_of).alias("last_checked"),
    )
    return candidates.withColumns({
        "name": name, "short_description": F.substring(about, 1, DESCRIPTION), "ai_summary": F.lit(PENDING), "reliability_score": F.lit(DRAFT_SCORE),
        "tags": F.filter("tags", said), "source_mix": F.array(source), "last_updated": F.lit(as_of), "status": F.lit("draft"),
    })


def ledger(candidates: DataFrame, existing: DataFrame, categories: DataFrame, regions: DataFrame, bounds: tuple[str, str], ranges: Sequence[tuple[float, float | None]], as_of: str) -> DataFrame:
    """candidates with the ids of what they name and `reason`: the first gate that rejects, null for the accepted.

    candidates: key, ord, name, category_label, region_label, date, distance_km, country, start, end and the columns of draft();
    existing: entity_id, ord, slug, category_id, region_id, date, start, end. All gates are columns of one plan. An accepted slug
    blocks the later candidates of the run, whatever else is wrong with them."""
    c = candidates.withColumn("slug", slugify(F.col("name")))
    c = c.join(existing.select("slug").distinct().withColumn("taken", F.lit(True)), "slug", "left")
    c = linking.by_label(c, "category_label", categories, "category_id").withColumnRenamed("matched_id", "category_id")
    c = linking.by_label(c, "region_label", regions, "region_id").withColumnRenamed("matched_id", "region_id")
    facts = schema.issues(c, schema.FACTS["races"]).withColumnRenamed("issues", "fact_issues")
    asked = facts.select(F.col("key").alias("entity_id"), "region_id", "category_id", F.col("date").alias("date_s"), "start", "end")
    old = existing.withColumn("date_s", F.col("date"))
    exact = linking.exact_duplicates(asked.filter("date_s is not null"), old).select(F.col("entity_id").alias("key"), F.col("duplicate_of").alias("exact"))
    met = linking.interval_duplicates(asked.filter("start is not null"), old).select(F.col("entity_id").alias("key"), F.col("duplicate_of").alias("met"))
    made = draft(facts.withColumn("entity_id", F.col("slug")).join(exact, "key", "left").join(met, "key", "left"), as_of)
    checked = schema.issues(made, schema.ENTITY)
    reason = first_reason([
        ("name", ~said(F.col("name"))), ("slug", (F.col("slug") == "") | F.coalesce("taken", F.lit(False))), ("category", F.col("category_id").isNull()),
        ("region", F.col("region_id").isNull()), ("facts", F.size("fact_issues") > 0), ("window", ~in_window(F.col("date"), bounds)),
        ("scope", ~in_ranges(F.col("distance_km"), ranges)), ("duplicate", F.col("exact").isNotNull() | F.col("met").isNotNull()), ("schema", F.size("issues") > 0),
    ])
    judged = checked.withColumn("reason", reason).withColumn("duplicate_of", F.coalesce("exact", "met"))
    # read twice below, so it is computed and written once
    judged = written(judged.drop("taken", "fact_issues", "issues", "exact", "met"), "ledger")
    first = judged.filter("reason is null").groupBy("slug").agg(F.min("ord").alias("first_ord"))
    later = (F.col("ord") > F.col("first_ord")) & (F.coalesce("reason", F.lit("")) != "name")
    out = judged.join(first, "slug", "left").withColumn("reason", F.when(F.coalesce(later, F.lit(False)), "slug").otherwise(F.col("reason")))
    return out.drop("first_ord")
