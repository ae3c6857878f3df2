"""What pages list and say about records: orders of topics and months, related records, labels and phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.guides import published


def is_new(at: Column, now: Column, hours: int) -> Column:
    """Whether something happened in the last hours before now."""
    return at > now - F.make_dt_interval(hours=F.lit(hours))


def date_driven(entities: DataFrame, group: str, date: str) -> DataFrame:
    """(group, date_driven): whether all of a group's records have a date."""
    return entities.groupBy(group).agg(F.bool_and(F.col(date).isNotNull()).alias("date_driven"))


def topic_order(reviews: DataFrame) -> DataFrame:
    """(topic, place): topics in the order in which a newest-first list first shows them; reviews without one are general. reviews: topic,
    published_at and ord, which decides ties. One row for each topic is ordered."""
    newest = F.max(F.struct("published_at", (-F.col("ord")).alias("o"))).alias("m")
    first = reviews.groupBy(F.coalesce("topic", F.lit("general")).alias("topic")).agg(newest)
    return first.select("topic", F.row_number().over(Window.orderBy(F.desc("m.published_at"), F.desc("m.o"))).alias("place"))


def configured_order(rows: DataFrame, label: str, first: Sequence[str]) -> DataFrame:
    """rows, a configured list, with their place: labels that are listed in that order, then the others by name."""
    at = F.nullif(F.array_position(F.lit(list(first)), F.col(label)), F.lit(0))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(at.asc_nulls_last(), label)))


def featured(entities: DataFrame, k: int) -> DataFrame:
    """The k published entities of the highest score, ties by ord."""
    return entities.filter(published()).orderBy(F.desc("reliability_score"), "ord").limit(k)


def month_calendar(entities: DataFrame, date: str, as_of: str) -> DataFrame:
    """(month, n, place): months with their entities, those to come first. One row for each month is ordered."""
    months = entities.groupBy(F.substring(date, 1, 7).alias("month")).agg(F.count("*").alias("n"))
    return months.withColumn("place", F.row_number().over(Window.orderBy(F.col("month") < as_of[:7], "month")))


def guide_spans(listed: DataFrame, named: int = 3) -> DataFrame:
    """(guide_id, first_month, last_month, n_cities, cities): what a guide spans, its first cities by rank in words. listed: guide_id, rank, month, region_id."""
    cities = listed.groupBy("guide_id", "region_id").agg(F.min("rank").alias("r"))
    placed = cities.withColumn("rn", F.row_number().over(Window.partitionBy("guide_id").orderBy("r")))
    first = F.sort_array(F.collect_list(F.when(F.col("rn") <= named, F.struct("r", "region_id")))).alias("f")
    counted, names = placed.groupBy("guide_id").agg(F.count("*").alias("n_cities"), first), F.array_join("f.region_id", ", ")
    more = F.concat(names, F.lit(" and "), (F.col("n_cities") - named).cast("string"), F.lit(" other"))
    months = listed.groupBy("guide_id").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    phrase = F.when(F.col("n_cities") > named, more).otherwise(names)
    return months.join(counted, "guide_id").select("guide_id", "first_month", "last_month", "n_cities", phrase.alias("cities"))


def graduated(status: Column, n_sources: Column, least: int = 3) -> Column:
    """The status after a draft was checked: active with enough sources, else in need of review."""
    return F.when(status == "draft", F.when(n_sources >= least, "active").otherwise("needs_review")).otherwise(status)


def first_of_name(rows: DataFrame, source: str, name: str, order: str) -> DataFrame:
    """(order): the first row of each name within a source, whatever its case; rows without a name stay."""
    named = rows.filter(F.col(name).isNotNull()).groupBy(source, F.lower(name).alias("_k")).agg(F.min(order).alias(order)).select(order)
    return named.union(rows.filter(F.col(name).isNull()).select(order))


def redirected(reviews: DataFrame, entities: DataFrame) -> DataFrame:
    """(review_id, redirected): whether a review's page leads to that of its entity, which has one if it is published."""
    known = entities.filter(published()).select("entity_id").distinct()
    yes = reviews.join(known, "entity_id", "left_semi").select("review_id", F.lit(True).alias("redirected"))
    return yes.union(reviews.join(known, "entity_id", "left_anti").select("review_id", F.lit(False).alias("redirected")))


def related_guides(entities: DataFrame, guides: DataFrame) -> DataFrame:
    """(entity_id, guide_id): guides of an entity's category, and those that pin it. guides (guide_id, category_id, pins) are a
    configured list, so they are broadcast."""
    by_category = entities.join(F.broadcast(guides), "category_id").select("entity_id", "guide_id")
    pinned = guides.select("guide_id", F.explode("pins").alias("entity_id"))
    return by_category.union(entities.join(F.broadcast(pinned), "entity_id").select("entity_id", "guide_id")).distinct()


def review_links(reviews: DataFrame, entities: DataFrame) -> DataFrame:
    """(review_id, entity_id, href) of active reviews: the entity's page if it is published, else the review's own."""
    of = entities.select("entity_id", "slug", F.col("status").alias("_status"))
    href = F.when(published("_status"), F.concat(F.lit("/e/"), "slug")).otherwise(F.concat(F.lit("/reviews/"), "review_id"))
    return reviews.filter("status = 'active'").join(of, "entity_id").select("review_id", "entity_id", href.alias("href"))


def related_articles(articles: DataFrame, key: str, topic: str, k: int) -> DataFrame:
    """(key, other): for each article the k newest others, those of its topic first. Newer ones have larger keys; every article meets the first of its
    topic and of all, k + 1 each."""
    first = articles.withColumn("_rn", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc(key)))).filter(F.col("_rn") <= k + 1)
    same = articles.join(first.select(topic, F.col(key).alias("other")), topic).select(key, "other", F.lit(0).alias("_tier"))
    newest = articles.orderBy(F.desc(key)).limit(k + 1).agg(F.collect_list(key).alias("_others"))  # one row of k + 1
    rest = articles.join(F.broadcast(newest)).select(key, F.explode("_others").alias("other"), F.lit(1).alias("_tier"))
    once = same.union(rest).filter(F.col(key) != F.col("other")).groupBy(key, "other").agg(F.min("_tier").alias("_tier"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_tier", F.desc("other")))
    return once.withColumn("_rn", place).filter(F.col("_rn") <= k).select(key, "other")


def value_label(label: Column, value: Column) -> Column:
    """A range's label, with the value unless the label already holds its digits."""
    has = F.contains(F.regexp_replace(label, "[^0-9]", ""), F.format_string("%.0f", value))
    return F.when(has, label).otherwise(F.concat_ws(" ", label, F.format_string("%.1f", value)))


def why_listed(pros: Column, says: Column, summary: Column) -> Column:
    """The first pro that says something, else the first sentence of the summary, else the first pro. says: the pros that do."""
    sentence = F.element_at(F.split(F.concat(summary, F.lit(". And more.")), r"(?<=[.!?])\s+"), 1)
    return F.coalesce(F.get(says, F.lit(0)), F.regexp_replace(sentence, r"\.$", ""), F.get(pros, F.lit(0)))
