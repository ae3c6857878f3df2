"""State of records from snapshot to snapshot, queues and run reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from waymark.operators import schema
from waymark.operators.guides import uncovered
from waymark.operators.ranking import placed
from waymark.operators.scan import max_plus
from waymark.sources.staged import written

#: Priority of source types; a type not listed comes before all of them.
SOURCE_PRIORITY = ["official", "news", "review", "social", "other"]


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def lapse(entities: DataFrame, as_of: str) -> DataFrame:
    """Published entities whose date has passed become archived; `outcome` says so."""
    gone = F.col("status").isin("active", "needs_review") & (F.length("date_s") >= 10) & (F.col("date_s") < as_of)
    return entities.withColumns({"status": F.when(gone, "archived").otherwise(F.col("status")), "outcome": F.when(gone, "archived").otherwise("kept")})


def verify(entities: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Applies fetch and verification outcomes (entity_id, fetched, advice, changed, confidence): a failed fetch costs 15
    points and sends an active record to review; archive advice or changed facts send it to review; an unchanged one
    gains 3 at high confidence and loses 5 at low. Nothing is promoted."""
    j = entities.join(outcomes, "entity_id", "left")
    failed = F.coalesce(~F.col("fetched"), F.lit(False))
    doubt = F.coalesce((F.col("advice") == "archive") | F.col("changed"), F.lit(False))
    step = (
        F.when(failed, -15)
        .when(F.col("fetched").isNull() | doubt, 0)
        .when(F.col("confidence") == "high", 3)
        .when(F.col("confidence") == "low", -5)
        .otherwise(0)
    )
    outcome = F.when(F.col("fetched").isNull(), "unchecked").when(failed, "unreachable").when(doubt, "needs_review").otherwise("verified")
    status = F.when((failed & (F.col("status") == "active")) | (doubt & (F.col("status") == "active")), "needs_review").otherwise(F.col("status"))
    return j.withColumns({"new_score": clamp(F.col("reliability_score") + step), "new_status": status, "outcome": outcome})


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, watched: list[str], listed: int = 60) -> DataFrame:
    """(change, key, place) of each difference of two snapshots, the first `listed` of each kind; place 0 holds the number
    of those not listed. Ranks are cut before the shuffle, so a change that most records share is a few rows a task."""
    a = before.select(F.col(key).alias("k"), F.struct("status", *watched).alias("old"))
    b = after.select(F.col(key).alias("k"), F.struct("status", *watched).alias("new"))
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("old.status").eqNullSafe("archived") & F.col("new.status").eqNullSafe("archived"), "archived")
        .when(F.col("old.status").eqNullSafe("archived") & ~F.col("new.status").eqNullSafe("archived"), "unarchived")
        .when(~F.col("old").eqNullSafe(F.col("new")), "edited")
    )
    rows = a.join(b, "k", "full").select(change.alias("change"), F.col("k").alias(key)).filter("change is not null")
    return first_listed(rows, key, listed)


def first_listed(rows: DataFrame, key: str, listed: int) -> DataFrame:
    """(change, key, place): the first `listed` of each change, and at place 0 how many more there are."""
    rows = written(rows, "changes")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("change").orderBy(key))).filter(F.col("place") <= listed)
    rest = rows.groupBy("change").agg((F.count("*") - listed).cast("int").alias("place")).filter("place > 0")
    more = rest.select("change", F.concat(F.col("place").cast("string"), F.lit(" more")).alias(key), F.lit(0).alias("place"))
    return ranked.unionByName(more)


def new_guides(before: DataFrame, after: DataFrame, listed: int = 60) -> DataFrame:
    """The guides (slug) that a snapshot before didn't hold, as changes of their own class."""
    new = after.select("slug").join(before.select("slug"), "slug", "left_anti").distinct()
    return first_listed(new.select(F.lit("new guide").alias("change"), "slug"), "slug", listed)


def preferred_source(sources: DataFrame) -> DataFrame:
    """(entity_id, pos, url, type) of the source to check next."""
    rank = F.array_position(F.lit(SOURCE_PRIORITY), F.col("type")) - 1
    best = F.min(F.struct(rank.alias("rank"), "pos", "url", "type")).alias("b")
    return sources.groupBy("entity_id").agg(best).select("entity_id", "b.pos", "b.url", "b.type")


def restamped(sources: DataFrame, checked: DataFrame, as_of: str) -> DataFrame:
    """sources with the date of the check on the one of each checked record that was looked at, its preferred source."""
    looked = preferred_source(sources).join(checked, "entity_id", "left_semi").select("entity_id", "pos", "url", F.lit(True).alias("_looked"))
    joined = sources.join(looked, ["entity_id", "pos", "url"], "left")
    return joined.withColumn("last_checked", F.when(F.col("_looked"), as_of).otherwise(F.col("last_checked"))).drop("_looked")


def recommend(entities: DataFrame, rated: DataFrame) -> DataFrame:
    """entities (slug, estimate) with score: the rating of the review with their slug, the last one if there are several, else their
    estimate, else -1."""
    last = rated.groupBy("slug").agg(F.max_by("rating", "ord").alias("_rating"))
    return entities.join(last, "slug", "left").withColumn("score", F.coalesce("_rating", "estimate", F.lit(-1))).drop("_rating")


def freshness(entities: DataFrame, sources: DataFrame, fallback: str) -> DataFrame:
    """(entity_id, checked): the newest check of its sources, else the record's own date."""
    newest = sources.groupBy("entity_id").agg(F.max("last_checked").alias("newest"))
    return entities.join(newest, "entity_id", "left").select("entity_id", F.coalesce("newest", fallback).alias("checked"))


def research_queue(entities: DataFrame, as_of: str, days: int, limit: int) -> DataFrame:
    """Published entities by date, undated first, without those researched lately."""
    age = F.abs(F.datediff(F.lit(as_of).cast("date"), F.try_to_date("researched")))
    old = F.coalesce(age >= days, F.lit(True))
    return entities.filter(F.col("status").isin("active", "needs_review") & old).orderBy(F.coalesce("date_s", F.lit("")), "ord").limit(limit)


def first_reason(gates: list[tuple[str, Column]]) -> Column:
    """The first gate that rejects, null if none does."""
    return F.coalesce(*(F.when(fails, name) for name, fails in gates))


def merged_facts(rows: DataFrame, fields: Sequence[schema.Field]) -> DataFrame:
    """rows (facts, a struct, and changes, a VARIANT of an object) with the changed facts over the old ones where the whole still keeps every
    rule of its schema, else with the old ones; `accepted` is null where nothing was to be changed, `changed` says whether a fact is another one.
    Names that the facts don't have are left out; a value of another type, or null, is no valid change."""
    kinds = {f.name: f.dataType for f in rows.schema["facts"].dataType}
    given = {n: F.try_variant_get("changes", f"$['{n}']", "variant") for n in kinds}
    typed = {n: F.try_variant_get("changes", f"$['{n}']", k.simpleString()) for n, k in kinds.items()}
    # a text is what JSON has in quotes, and a number what it has not
    is_text = {n: F.schema_of_variant(given[n]) == "STRING" for n in kinds}
    fits = [given[n].isNull() | (typed[n].isNotNull() & (is_text[n] if k.typeName() == "string" else ~is_text[n])) for n, k in kinds.items()]
    merged = F.struct(*(F.when(given[n].isNotNull(), typed[n]).otherwise(F.col(f"facts.{n}")).alias(n) for n in kinds))
    asked = F.size(F.coalesce(F.json_object_keys(F.to_json("changes")), F.array().cast("array<string>"))) > 0
    tried = rows.withColumns({"_merged": merged, "_fits": reduce(lambda a, b: a & b, fits)})
    valid = F.col("_fits") & (F.size(schema.record_issues(F.col("_merged"), fields, kinds)) == 0)
    judged = tried.withColumn("accepted", F.when(asked, valid))
    left = F.when(F.col("accepted"), F.col("_merged")).otherwise(F.col("facts"))
    return judged.withColumns({"facts": left, "changed": ~left.eqNullSafe(F.col("facts"))}).drop("_merged", "_fits")


def counters(runs: dict[str, DataFrame]) -> DataFrame:
    """(run, outcome, n): records of each run by their `outcome`."""
    counted = [rows.groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), "outcome", "n") for run, rows in runs.items()]
    return reduce(DataFrame.unionByName, counted)


def observed(rows: DataFrame, run: str, outcomes: Sequence[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """rows as a written table, and their counters (run, outcome, n) by `outcome`, counted while the table was written: the rows are computed once.
    Only outcomes that occur have a row; an outcome that is not in outcomes is counted as other."""
    return observed_runs(rows, {run: ("outcome", outcomes)}, tag)


def observed_runs(rows: DataFrame, runs: Mapping[str, tuple[str, Sequence[str]]], tag: str) -> tuple[DataFrame, DataFrame]:
    """The same for several runs over the same rows, each a column of outcomes and those it may have: one table holds what became of a
    row in all of them."""
    seen, names, metrics = Observation(), {}, []
    for i, (run, (column, outcomes)) in enumerate(runs.items()):
        of = F.col(column)
        counts = [(o, F.count_if(of.eqNullSafe(F.lit(o)))) for o in outcomes] + [("other", F.count_if(~F.coalesce(of.isin(*outcomes), F.lit(False))))]
        for j, (outcome, count) in enumerate(counts):
            names[f"n{i}_{j}"] = (run, outcome)
            metrics.append(count.alias(f"n{i}_{j}"))
    table = written(rows.observe(seen, *metrics), tag)
    got = [(*names[k], n) for k, n in seen.get.items() if n]
    return table, rows.sparkSession.createDataFrame(got, "run string, outcome string, n bigint")


def source_health(fetches: DataFrame) -> DataFrame:
    """Per host: fetches that went well, were unreachable or failed in extraction, and the first failure's reason."""
    bad = ~F.col("ok")
    return fetches.groupBy("host").agg(
        F.count_if("ok").alias("n_ok"),
        F.count_if(bad & (F.col("kind") == "source")).alias("n_unreachable"),
        F.count_if(bad & (F.col("kind") == "pipeline")).alias("n_extraction"),
        F.min_by("reason", F.when(bad, F.col("ord"))).alias("first_reason"),
    )


def pages_of(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """rows with place, page and total in one order over all of them, without a task that holds all."""
    return placed(rows, [], order).withColumn("page", F.ceil(F.col("place") / size))


def page_view(pages: DataFrame, wanted: DataFrame, group: str, size: int) -> DataFrame:
    """(group, wanted, page, line): what a list of pages_of, cut into groups, shows for each wanted page: the page next to it that there is, and
    the line above it. wanted: group, wanted; pages: group, total (rows of the group)."""
    sized = pages.groupBy(group).agg(F.max("total").alias("total"))
    at = wanted.join(sized, group, "left").withColumn("total", F.coalesce("total", F.lit(0)))
    last = F.greatest(F.lit(1), F.ceil(F.col("total") / size))
    page = F.greatest(F.lit(1), F.least(F.col("wanted"), last)).cast("long")
    first, text = (page - 1) * size + 1, lambda c: c.cast("string")
    ranged = F.concat(F.lit("Showing "), text(first), F.lit("-"), text(F.least(page * size, F.col("total"))), F.lit(" of "), text(F.col("total")), F.lit(" reviews"))
    short = F.concat(text(F.col("total")), F.when(F.col("total") == 1, " review").otherwise(" reviews"))
    line = F.when(F.col("total") == 0, "").when(F.col("total") <= size, short).otherwise(ranged)
    return at.select(group, "wanted", page.alias("page"), line.alias("line"))


def targets(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """wanted (place, key) in its order, each with whether there is such a record."""
    there = known.select(F.col(key).alias("_key")).distinct()
    return wanted.join(there, F.col(key) == F.col("_key"), "left").withColumn("known", F.col("_key").isNotNull()).drop("_key")


def material(*lists: str) -> Column:
    """How much is known of a record: the sizes of its lists of quotes, highlights and watch-outs; what is missing counts nothing."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.size(c), F.lit(0)) for c in lists)).cast("long")


def eligible(sized: DataFrame, taken: DataFrame, covered: DataFrame, least: int, most: int) -> DataFrame:
    """The largest pairs of at least `least` members that no guide covers, by filter_key, and whose slug is free; at most `most`."""
    return uncovered(sized.filter(F.col("n") >= least), taken, covered).orderBy(F.desc("n"), "slug").limit(most)


def releases(items: DataFrame, gap: int) -> DataFrame:
    """(host, item, arrival, released): an item goes when it has arrived and gap has passed since the latest release of its host; of one
    time the smaller item goes first, and a repeated item counts once. Times are longs of one unit."""
    once = items.select("host", "item", "arrival").distinct()
    return max_plus(once, ["host"], [F.asc("arrival"), F.asc("item")], F.col("arrival"), F.lit(gap), "released")
