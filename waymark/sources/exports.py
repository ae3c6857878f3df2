"""Structured-data exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.guides import published, reviewable
from waymark.operators.hierarchy import counts


# fixed values
EVENT_TYPES = (
    "Event", "BusinessEvent", "ChildrensEvent", "ComedyEvent", "CourseInstance", "DanceEvent", "DeliveryEvent", "EducationEvent", "EventSeries", "ExhibitionEvent",
    "Festival", "FoodEvent", "Hackathon", "LiteraryEvent", "MusicEvent", "PublicationEvent", "SaleEvent", "ScreeningEvent", "SocialEvent", "SportsEvent", "TheaterEvent", "VisualArtsEvent",
)
CONTEXT = "https://schema.org"


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def _location() -> Column:
    """A place from venue, city and country, if any of them is known."""
    address = F.struct(F.lit("PostalAddress").alias("@type"), F.when(_filled("city"), F.col("city")).alias("addressLocality"), F.when(_filled("country"), F.col("country")).alias("addressCountry"))
    both = F.array_join(F.array_compact(F.array(*(F.when(_filled(c), F.col(c)) for c in ("city", "country")))), ", ")
    place = F.struct(F.lit("Place").alias("@type"), F.when(_filled("venue"), F.col("venue")).otherwise(both).alias("name"), address.alias("address"))
    return F.when(_filled("venue") | _filled("city") | _filled("country"), place)


def entity_json(entities: DataFrame, site: str, kind: str = "SportsEvent") -> DataFrame:
    """(entity_id, json): a schema.org record with those properties whose facts exist: date, place, organiser, price. entities:
    entity_id, slug, name, short_description, date, venue, city, country, organizer, price_range."""
    event, url = kind in EVENT_TYPES, F.concat(F.lit(f"{site}/e/"), "slug")
    only = lambda ok, text: F.when(ok, text) if event else F.lit(None).cast("string")
    place = _location()
    doc = F.struct(
        F.lit(CONTEXT).alias("@context"), F.lit(kind).alias("@type"), "name", F.col("short_description").alias("description"), url.alias("url"),
        F.when(_filled("date"), F.col("date")).alias("startDate"), only(F.lit(True), "https://schema.org/EventScheduled").alias("eventStatus"), place.alias("location"),
        only(place.isNotNull(), "https://schema.org/OfflineEventAttendanceMode").alias("eventAttendanceMode"),
        F.when(_filled("organizer"), F.struct(F.lit("Organization").alias("@type"), F.col("organizer").alias("name"))).alias("organizer"),
        F.when(_filled("price_range"), F.struct(F.lit("Offer").alias("@type"), F.col("price_range").alias("description"), url.alias("url"))).alias("offers"),
    )
    return entities.select("entity_id", F.to_json(doc).alias("json"))


def review_json(reviews: DataFrame, site: str, owner: str, kind: str = "SportsEvent") -> DataFrame:
    """(review_id, json): a review of its entity with author and publisher; the rating only where there is evidence for it.
    reviews: review_id, title, seo_title, verdict, last_updated, rating, evidence, and the entity's name, slug, date, venue, city, country."""
    who = F.struct(F.lit("Organization").alias("@type"), F.lit(owner).alias("name"))
    item = F.struct(F.lit(kind).alias("@type"), "name", F.concat(F.lit(f"{site}/e/"), "slug").alias("url"), F.when(_filled("date"), F.col("date")).alias("startDate"), _location().alias("location"))
    rating = F.struct(F.lit("Rating").alias("@type"), F.col("rating").alias("ratingValue"), F.lit(100).alias("bestRating"), F.lit(0).alias("worstRating"))
    title = F.coalesce("seo_title", F.concat("name", F.lit(" review")))
    doc = F.struct(
        F.lit(CONTEXT).alias("@context"), F.lit("Review").alias("@type"), F.concat(F.lit(f"{site}/reviews/"), "review_id").alias("url"), title.alias("name"), F.col("title").alias("headline"),
        F.col("last_updated").alias("datePublished"), F.col("last_updated").alias("dateModified"), who.withField("url", F.lit(site)).alias("author"), who.alias("publisher"),
        F.col("verdict").alias("reviewBody"), item.alias("itemReviewed"), F.when(F.col("evidence") & F.col("rating").isNotNull(), rating).alias("reviewRating"),
    )
    return reviews.select("review_id", F.to_json(doc).alias("json"))


def breadcrumb_json(rows: DataFrame, key: str, site: str) -> DataFrame:
    """(key, json): the trail of each record from (pos, label, href); the last crumb has no link."""
    item = F.struct("pos", "label", "href")
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    crumb = lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["label"].alias("name"), F.concat(F.lit(site), x["href"]).alias("item"))
    return lists.select(key, F.to_json(F.struct(F.lit(CONTEXT).alias("@context"), F.lit("BreadcrumbList").alias("@type"), F.transform("items", crumb).alias("itemListElement"))).alias("json"))


def article_json(articles: DataFrame, site: str, owner: str) -> DataFrame:
    """(article_id, json) from article_id, title, meta_description, dek, published_at and last_updated."""
    who = F.struct(F.lit("Organization").alias("@type"), F.lit(owner).alias("name"))
    doc = F.struct(
        F.lit(CONTEXT).alias("@context"), F.lit("Article").alias("@type"), F.concat(F.lit(f"{site}/articles/"), "article_id").alias("url"), F.col("title").alias("headline"),
        F.coalesce("meta_description", "dek").alias("description"), F.coalesce("published_at", "last_updated").alias("datePublished"), F.col("last_updated").alias("dateModified"),
        who.withField("url", F.lit(site)).alias("author"), who.alias("publisher"),
    )
    return articles.select("article_id", F.to_json(doc).alias("json"))


def faq_json(faqs: DataFrame) -> DataFrame:
    """(owner_id, json): an FAQ page of each record that has questions, in order."""
    answer = F.struct(F.lit("Answer").alias("@type"), F.col("answer").alias("text"))
    item = F.struct("pos", F.lit("Question").alias("@type"), F.col("question").alias("name"), answer.alias("acceptedAnswer"))
    lists = faqs.groupBy("owner_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    clean = F.transform("items", lambda i: i.dropFields("pos"))
    return lists.select("owner_id", F.to_json(F.struct(F.lit("FAQPage").alias("@type"), clean.alias("mainEntity"))).alias("json"))


def item_list_json(rows: DataFrame, key: str, order: str, name: str, url: str) -> DataFrame:
    """(key, json): an item list with positions from 1; an empty list gives no row."""
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, F.col(name).alias("name"), F.col(url).alias("url")))).alias("items"))
    numbered = F.transform("items", lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["name"].alias("name"), x["url"].alias("url")))
    return lists.select(key, F.to_json(F.struct(F.lit("ItemList").alias("@type"), numbered.alias("itemListElement"))).alias("json"))


#: Pages that every site has, and those of a feature.
STATIC = ("/", "/categories", "/regions", "/tools", "/about", "/privacy", "/terms", "/contact")
FEATURE_PAGES = {"guides": "/guides", "reviews": "/reviews", "gear": "/gear", "articles": "/articles", "travel": "/travel"}


#: Calculators that the site has.
TOOLS = ("pace-calculator", "race-time-predictor", "race-splits-calculator", "race-countdown-timer", "calories-burned-calculator", "heat-humidity-pace-calculator", "age-graded-calculator", "race-fueling-calculator")


def sitemap(
    entities: DataFrame, regions: DataFrame, reviews: DataFrame, categories: DataFrame, guides: DataFrame, articles: DataFrame, gear: DataFrame, features: set[str], tools: tuple[str, ...] = TOOLS
) -> DataFrame:
    """(path): static pages and tools; published categories, entities, and published regions that hold any below published ones; and for
    each feature that is on its index and its published pages. With merged reviews only those without an entity page are listed, the
    others redirect to it. entities: entity_id, slug, region_id, status; regions: region_id, parent_region_id, status; the others: slug,
    status (reviews: entity_id too)."""
    spark = entities.sparkSession
    path = lambda df, prefix, key="slug": df.select(F.concat(F.lit(prefix), F.col(key)).alias("path"))
    shown = entities.filter(published())
    fixed = [*STATIC, *(f"/tools/{t}" for t in tools), *(p for f, p in FEATURE_PAGES.items() if f in features)]
    parts = [spark.createDataFrame([(p,) for p in fixed], "path string"), path(categories.filter(published()), "/categories/"), path(shown, "/e/")]
    parts.append(path(counts(shown, regions.filter(published())).filter("n > 0"), "/regions/", "region_id"))
    if "guides" in features:
        parts.append(path(guides.filter(published()), "/guides/"))
    if "reviews" in features:
        good = reviews.filter(published())
        known = entities.filter(reviewable()).select("entity_id")
        alone = good.join(shown.select("entity_id"), "entity_id", "left_anti").join(known, "entity_id", "left_semi")
        parts.append(path(alone if "merged" in features else good.join(shown.select("entity_id"), "entity_id", "left_semi"), "/reviews/"))
    for name, pages in (("articles", articles), ("gear", gear)):
        if name in features:
            parts.append(path(pages.filter(published()), f"/{name}/"))
    return reduce(DataFrame.unionByName, parts)
