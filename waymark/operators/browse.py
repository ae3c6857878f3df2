"""What pages show: facets, chips, evidence for a score, lists in a chosen order, and queues of records to work on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.categories import with_categories
from waymark.operators.discovery import PENDING
from waymark.operators.hierarchy import closure

#: Sources in which participants speak.
PARTICIPANTS = ("review", "social")


def found(query: str, *columns: str) -> Column:
    """Whether any of the columns contains the words searched for, in whatever case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.strip().lower()))


def faceted(rows: DataFrame, text_columns: list[str], month: str = "", category: str = "", group: str = "", text: str = "") -> DataFrame:
    """(group_id, n): the groups that combined facets leave, with how many records each shows. A blank facet is no
    restriction; a group without a record is hidden. rows has group_id, month and category."""
    wanted = [F.col("month") == month if month else None, F.col("category") == category if category else None, F.col("group_id") == group if group else None]
    wanted.append(found(text, *text_columns) if text.strip() else None)
    fits = reduce(lambda a, b: a & b, [w for w in wanted if w is not None], F.lit(True))
    return rows.filter(fits).groupBy("group_id").agg(F.count("*").alias("n"))


def chips(entities: DataFrame, categories: DataFrame) -> DataFrame:
    """(entity_id, chip): what an entity is found under, its tags, the categories that it matches, and its region."""
    # one pass; what an entity repeats goes in its row, before anything is shuffled
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    each = with_categories(entities, categories).select("entity_id", F.explode(F.array_distinct(F.concat(tags, "cats", F.array("region_id")))).alias("chip"))
    return each.distinct()


def has_evidence(source_types: Column, n_quotes: Column, n_excerpts: Column) -> Column:
    """Whether a score may be shown: a source in which participants speak, a pull quote, or an excerpt of the entity."""
    heard = F.exists(source_types, lambda t: F.coalesce(t.isin(*PARTICIPANTS), F.lit(False)))
    return F.coalesce(heard, F.lit(False)) | (F.coalesce(n_quotes, F.lit(0)) > 0) | (F.coalesce(n_excerpts, F.lit(0)) > 0)


def needs_enrichment(summary: Column, *lists: Column) -> Column:
    """Whether a record still has its placeholder, or neither pros nor cons nor FAQs."""
    bare = [F.coalesce(F.size(x), F.lit(0)) <= 0 for x in lists]
    return F.coalesce(summary == PENDING, F.lit(False)) | reduce(lambda a, b: a & b, bare)


def thin(sections: Column, faqs: Column, sources: Column) -> Column:
    """Whether a review says too little."""
    few = lambda c, n: F.coalesce(c, F.lit(0)) <= n
    return few(sections, 2) | few(faqs, 1) | few(sources, 1)


def listed_reviews(reviews: DataFrame, sort: str, most: int) -> DataFrame:
    """(place, review_id): the first reviews, newest first, or by the whole part of their rating with missing ones as zero;
    ties stay newest first. reviews: review_id, published_at, last_updated, rating, ord."""
    stars = F.coalesce(F.floor("rating"), F.lit(0))
    newest = [F.desc(F.coalesce("published_at", "last_updated")), F.col("ord")]
    order = {"newest": newest, "rating-desc": [F.desc(stars), *newest], "rating-asc": [F.asc(stars), *newest]}[sort]
    top = reviews.orderBy(*order).limit(most)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "review_id")  # `most` rows


def review_queue(pool: DataFrame, as_of: str, most: int, region: str | None = None, regions: DataFrame | None = None, prefer: bool = False) -> DataFrame:
    """The first records to write or revise: of a region and those below it, those with material if there are any and that
    is asked for, upcoming ones by date, then the rest."""
    if region is not None:
        inside = closure(regions).filter(F.col("anc") == region).select("region_id")
        pool = pool.join(inside, "region_id", "left_semi")
    if prefer and not pool.filter("material >= 2").isEmpty():
        pool = pool.filter("material >= 2")
    ahead = F.col("date_s") >= as_of
    return pool.orderBy(F.when(ahead, 0).otherwise(1), F.when(ahead, F.col("date_s")), "ord").limit(most)


def guide_tallies(listed: DataFrame, copy: DataFrame) -> DataFrame:
    """(guide_id, n_reviewed, any_score, intro, pick): how many entries have a review, whether any may show a score, and the
    copy that is still about these entries. listed: guide_id, entity_id, reviewed, evidence; copy: guide_id, stale,
    intro, derived, pick. A stale guide shows its derived intro and no pick; a pick's score goes where none is shown."""
    from waymark.functions.text import strip_score

    tallies = listed.groupBy("guide_id").agg(
        F.count_if(F.coalesce("reviewed", F.lit(False))).alias("n_reviewed"), F.coalesce(F.bool_or("evidence"), F.lit(False)).alias("any_score")
    )
    pick = F.when(~F.col("stale"), F.when(F.col("any_score"), F.col("pick")).otherwise(strip_score(F.col("pick"))))
    return tallies.join(copy, "guide_id").select("guide_id", "n_reviewed", "any_score", F.when(F.col("stale"), F.col("derived")).otherwise(F.col("intro")).alias("intro"), pick.alias("pick"))


def guide_brief(listed: DataFrame, places: int = 20, entries: int = 14) -> DataFrame:
    """(guide_id, months, cities, sample): the months of a guide's entries with their number, its first distinct places, and its
    first entries as lines. listed: guide_id, rank, entity_id, name, month, city, country."""
    months = listed.filter("month is not null").groupBy("guide_id", "month").agg(F.count("*").alias("n"))
    spread = months.groupBy("guide_id").agg(F.sort_array(F.collect_list(F.concat_ws(": ", "month", F.col("n").cast("string")))).alias("months"))
    first = listed.filter("city is not null").groupBy("guide_id", "city").agg(F.min("rank").alias("r"))
    cities = first.withColumn("k", F.row_number().over(Window.partitionBy("guide_id").orderBy("r"))).filter(F.col("k") <= places)
    cities = cities.groupBy("guide_id").agg(F.sort_array(F.collect_list(F.struct("r", "city"))).alias("c"))
    place = F.concat_ws(", ", "city", "country")
    line = F.concat(F.col("name"), F.when(place != "", F.concat(F.lit(" - "), place)).otherwise(""), F.coalesce(F.concat(F.lit(", "), "month"), F.lit("")))
    sample = listed.filter(F.col("rank") <= entries).groupBy("guide_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("s"))
    out = sample.join(spread, "guide_id", "left").join(cities, "guide_id", "left")
    return out.select("guide_id", F.array_join("months", ", ").alias("months"), F.array_join("c.city", ", ").alias("cities"), F.array_join("s.line", "\n").alias("sample"))
