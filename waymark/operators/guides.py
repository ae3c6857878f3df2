"""Saved guides: filter specifications compiled into Columns, resolved, ranked and fingerprinted."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.facts import holds, sort_keys, values_of
from waymark.operators.categories import with_categories
from waymark.operators.fingerprint import long_fingerprints
from waymark.operators.hierarchy import closure
from waymark.operators.ranking import placed
from waymark.sources.staged import written

PUBLISHED = ("active", "needs_review")


def published(status: str = "status") -> Column:
    return F.coalesce(F.col(status).isin(*PUBLISHED), F.lit(False))


def reviewable(status: str = "status") -> Column:
    """Anything but a draft, a missing status included."""
    return ~F.col(status).eqNullSafe(F.lit("draft"))


#: Entities of a guide that are hashed in one row.
FEW = 1000
#: Rows that a task may hold for each guide; guides with a higher limit, or none, are ranked over range partitions.
TOP = 10_000


def resolve(entities: DataFrame, regions: DataFrame, categories: DataFrame, guides: Sequence[dict]) -> DataFrame:
    """One row (guide_id, rank, entity_id) per listed entity of every guide. A guide is a mapping with id and any of
    region_id, category_id, tags_any, facts [(field, op, value)], pins, sort_by, descending and limit. Pins are
    listed whatever the filters say and however often they match, after the matches where the sort ties.

    Facts are paths into the open facts, if entities have that VARIANT, or columns; an order is by a column, or by a path. Values keep their
    own types: numbers, texts and dates sort as such, mixed ones by type first, missing ones last.

    All guides share one scan: each is a Column, and an entity carries the numbers of the guides it matches; what a row of a guide is ranked by comes
    after that, from the keys of its order, which are made once for each entity and order. Matches are written once if guides without a bound read them as well."""
    if not guides:
        return entities.sparkSession.createDataFrame([], "guide_id string, rank int, entity_id string")
    rolled = closure(regions).groupBy("region_id").agg(F.collect_set("anc").alias("ancestors"))
    wide = with_categories(entities, categories).join(rolled, "region_id", "left")
    orders = dict.fromkeys((g["sort_by"], g.get("descending", True)) for g in guides if g.get("sort_by"))
    asked = [(f, op) for g in guides for f, op, _ in g.get("facts", ())]
    wide, values = values_of(wide, dict.fromkeys([*((f, False) for f, _ in asked), *((f, True) for f, _ in orders)]), {f for f, op in asked if op == "contains"})
    kinds = {"kind": "int", "number": "double", "up": "string", "down": "string"}
    keys = {o: {k: f"_s{i}_{k}" for k in kinds} for i, o in enumerate(orders)}
    wide = wide.withColumns({keys[o][k]: c.cast(kinds[k]) for o in orders for k, c in sort_keys(values[o[0], True], o[1]).items()})
    hits = []
    for i, g in enumerate(guides):
        c = published()
        if g.get("region_id"):
            c &= F.coalesce(F.array_contains("ancestors", g["region_id"]), F.lit(False))
        if g.get("category_id"):
            c &= F.coalesce(F.array_contains("cats", g["category_id"]), F.lit(False))
        if g.get("tags_any"):
            c &= F.arrays_overlap("tags", F.lit(list(g["tags_any"])))
        for field, op, value in g.get("facts", ()):
            c &= holds(values[field, False], op, value)
        # a pinned entity that doesn't match has the number below zero
        hit = F.when(c, i)
        hits.append(hit.when(F.col("entity_id").isin(list(g["pins"])), ~i) if g.get("pins") else hit)
    # the outer form, as an inner one filters by the list first, which is then made several times
    each = wide.select("entity_id", "ord", *(n for k in keys.values() for n in k.values()), F.explode_outer(F.array(*hits)).alias("_g")).filter("_g is not null")
    each = each.withColumns({"pinned": F.col("_g") < 0, "_g": F.when(F.col("_g") < 0, -1 - F.col("_g")).otherwise(F.col("_g"))})
    of = lambda made, kind: reduce(lambda w, x: w.when(F.col("_g").isin(x[0]), x[1]), made, F.when(F.lit(False), F.lit(None))).cast(kind)
    those = {o: [i for i, g in enumerate(guides) if g.get("sort_by") and (g["sort_by"], g.get("descending", True)) == o] for o in orders}
    pins = [([i], F.array_position(F.lit(list(g["pins"])), F.col("entity_id"))) for i, g in enumerate(guides) if g.get("pins")]
    each = each.select(
        F.get(F.lit([g["id"] for g in guides]), F.col("_g")).alias("guide_id"), "entity_id", "ord", "pinned", F.when(F.col("pinned"), of(pins, "bigint")).alias("pin"),
        F.get(F.lit([g.get("limit") or 0 for g in guides]), F.col("_g")).alias("limit"), *(of([(those[o], F.col(keys[o][k])) for o in orders], t).alias(k) for k, t in kinds.items()),
    )
    order = [*(F.col(k).asc_nulls_last() for k in ("kind", "number", "up")), F.col("down").desc_nulls_last(), F.asc("pinned"), F.asc("pin"), F.asc("ord")]
    # a bound that is known beforehand lets tasks drop all rows behind it before the shuffle
    limits = [g.get("limit") or 0 for g in guides]
    few, parts = [x for x in limits if 0 < x <= TOP], []
    if len(few) < len(limits):
        each = written(each, "matches")
    if few:
        top = each.filter(F.col("limit").between(1, TOP)).withColumn("rank", F.row_number().over(Window.partitionBy("guide_id").orderBy(*order)))
        parts.append(top.filter(F.col("rank") <= max(few)))
    if len(few) < len(limits):
        parts.append(placed(each.filter(~F.col("limit").between(1, TOP)), ["guide_id"], order).withColumn("rank", F.col("place").cast("int")))
    listed = [x.filter("limit = 0 or rank <= limit").select("guide_id", "rank", "entity_id") for x in parts]
    return reduce(DataFrame.unionByName, listed)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII string, as eight hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * 16777619) % (1 << 32)
    return F.lpad(F.lower(F.hex(F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), step))), 8, "0")


def fingerprints(listed: DataFrame) -> DataFrame:
    """(guide_id, n, fingerprint) of each guide's set of entities. Guides of up to FEW entities are hashed inside a row, larger ones in
    chunks that are composed."""
    listed = written(listed.select("guide_id", "entity_id"), "listed")
    sized = listed.groupBy("guide_id").agg(F.count("*").alias("n"))
    small = listed.join(sized.filter(F.col("n") <= FEW), "guide_id")
    ids = F.array_join(F.array_sort(F.collect_list("entity_id")), "|")
    hashed = small.groupBy("guide_id").agg(F.count("*").alias("n"), fnv1a(ids).alias("hash"))
    large = sized.filter(F.col("n") > FEW)
    if not large.isEmpty():
        hashed = hashed.unionByName(long_fingerprints(listed.join(large.select("guide_id"), "guide_id")))
    return hashed.select("guide_id", "n", F.concat(F.col("n").cast("string"), F.lit("-"), "hash").alias("fingerprint"))


def stale(stored: Column, current: Column) -> Column:
    """Whether copy was written for another set, or for none."""
    return (F.coalesce(stored, F.lit("")) == "") | ~stored.eqNullSafe(current)


def filter_key(category: Column, region: Column, tags: Column) -> Column:
    """What a guide covers."""
    return F.concat_ws("|", F.coalesce(category, F.lit("")), F.coalesce(region, F.lit("")), F.array_join(F.array_sort(tags), ","))


def uncovered(wanted: DataFrame, taken: DataFrame, covered: DataFrame) -> DataFrame:
    """wanted (slug, filter_key) without those whose slug is taken or whose coverage a guide has."""
    return wanted.join(taken, "slug", "left_anti").join(covered, "filter_key", "left_anti")


def refreshed(stored: DataFrame, rewritten: DataFrame, named: DataFrame) -> DataFrame:
    """stored guides (guide_id and any columns, intro and pick among them) with rewritten copy (guide_id, new_intro, new_pick); all
    other columns are carried. A pick stays out if it names none of the guide's entries (guide_id, named)."""
    kept = rewritten.join(named, "guide_id").filter(F.contains("new_pick", "named")).select("guide_id", F.lit(True).alias("_ok")).distinct()
    both = stored.join(rewritten, "guide_id").join(kept, "guide_id", "left")
    return both.withColumns({"intro": F.col("new_intro"), "pick": F.when(F.col("_ok"), F.col("new_pick"))}).drop("new_intro", "new_pick", "_ok")


def grid(entities: DataFrame, regions: DataFrame, categories: DataFrame) -> DataFrame:
    """(category_id, root, n): published entities of each category, over all (root null) and for each top region."""
    country = closure(regions).join(regions.filter("granularity = 'country'").select(F.col("region_id").alias("anc")), "anc", "left_semi")
    # an entity has one region and counts once in each of its categories, so sums of counts by region are exact
    each = with_categories(entities.filter(published()), categories).select("region_id", F.explode("cats").alias("category_id"))
    own = each.groupBy("region_id", "category_id").agg(F.count("*").alias("k"))
    rolled = own.join(country.select("region_id", F.col("anc").alias("root")), "region_id")
    found = rolled.rollup("category_id", "root").agg(F.sum("k").alias("n")).filter("category_id is not null")
    tops = regions.filter("granularity = 'country'").select(F.col("region_id").alias("root")).union(regions.limit(1).select(F.lit(None).cast("string")))
    dims = categories.select("category_id").join(tops)  # two lists of a few configured rows
    same = (dims["category_id"] == found["category_id"]) & dims["root"].eqNullSafe(found["root"])
    return dims.join(found, same, "left").select(dims["category_id"], dims["root"], F.coalesce("n", F.lit(0)).alias("n"))


def hub_stats(entities: DataFrame, regions: DataFrame, categories: DataFrame) -> DataFrame:
    """(region_id, n_entities, n_categories, n_regions) of each region and all below it. Entities are counted by region and
    category first; what meets the closure is one row for each."""
    up, own = closure(regions), entities.groupBy("region_id").agg(F.count("*").alias("k"))
    each = with_categories(entities, categories).select("region_id", F.explode("cats").alias("category_id")).distinct()
    sized = own.join(up, "region_id").groupBy("anc").agg(F.sum("k").alias("n_entities"), F.count("*").alias("n_regions"))
    named = each.join(up, "region_id").groupBy("anc").agg(F.count_distinct("category_id").alias("n_categories"))
    return sized.join(named, "anc").select(F.col("anc").alias("region_id"), "n_entities", "n_categories", "n_regions")
