"""Queries: guide summaries, review exports, normalised answers, remaining checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import categories, hierarchy, lifecycle, listing, quality, schema
from waymark.plans.guides import _CLOSURE, _LISTED, _ROOT, guide_ranking
from waymark.plans.registry import query
from waymark.sources.staged import written

#: Characters of a draft's description.
DESCRIPTION = 220


@query(
    "A10_guide_summaries",
    f"""with {_LISTED}, j as (select guide_id, rank, substr(date_s, 1, 7) as month, region_id from listed join v_entity using (entity_id)),
    c as (select guide_id, region_id, min(rank) as r from j group by all),
    p as (select guide_id, string_agg(region_id, ', ' order by r) filter (rn <= 3) as firsts, count(*) as n from (select *, row_number() over (partition by guide_id order by r) as rn from c) group by guide_id)
    select guide_id, min(month) as first_month, max(month) as last_month, any_value(n) as n_cities, case when any_value(n) > 3 then concat(any_value(firsts), ' and ', any_value(n) - 3, ' other') else any_value(firsts) end as cities
    from j join p using (guide_id) group by guide_id""",
)
def a10(v):
    """Months and cities of each guide."""
    months = v.v_entity.select("entity_id", "region_id", F.substring("date_s", 1, 7).alias("month"))
    # the listed entries are read three times, so they are resolved and written once
    return listing.guide_spans(written(guide_ranking(v).join(months, "entity_id"), "spans"))


@query("X9_value_labels", "select l_orderkey, l_linenumber, l_partkey, case when l_quantity <= 10 then concat('Small ', printf('%.1f', l_quantity)) when l_quantity <= 25 then concat('Middle ', printf('%.1f', l_quantity)) when l_quantity <= 45 then concat('Large ', printf('%.1f', l_quantity)) else concat('Extra ', printf('%.1f', l_quantity)) end as label from lineitem")
def x9(v):
    """The label of the first range that holds a value, with the value."""
    rows = categories.first_match(v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), v.v_category, "l_quantity")
    named = rows.join(v.v_category.select(F.col("category_id").alias("matched"), "label"), "matched", "left")
    return named.select("l_orderkey", "l_linenumber", "l_partkey", listing.value_label(F.col("label"), F.col("l_quantity")).alias("label"))


@query("X11_why_listed", "select entity_id, coalesce(list_filter(tags, lambda t: not starts_with(t, 'N'))[1], split_part(concat(name, '. And more.'), '. ', 1), tags[1]) as why from v_entity")
def x11(v):
    says = F.filter("tags", lambda t: ~t.startswith("N"))
    return v.v_entity.select("entity_id", listing.why_listed(F.col("tags"), says, F.col("name")).alias("why"))


@query("X13_normalised_sources", "select entity_id, pos, case when type in ('official', 'news', 'review', 'social') then type else 'other' end as type, url from v_source where pos > 0 and regexp_matches(url, '^[a-z]+://[^/]+')")
def x13(v):
    """The sources of X13: all well-formed ones with their whole urls, unknown types as other."""
    known = F.when(F.col("type").isin("official", "news", "review", "social"), F.col("type")).otherwise("other")
    formed = (F.col("pos") > 0) & F.try_parse_url("url", F.lit("HOST")).isNotNull()
    return v.v_source.filter(formed).select("entity_id", "pos", known.alias("type"), "url")


#: Answers by ord % 10: a valid date; a distance below 0; a deadline in words; an empty date; valid distances and an unknown name; a null; nothing;
#: a text for a number; the same date; a number for a text.
_CHANGES = """case ord % 10 when 0 then '{"date":"2001-01-01"}' when 1 then '{"distance_km":[5,-5]}' when 2 then '{"registration_deadline":"soon","date":"2002-02-02"}'
  when 3 then '{"date":""}' when 4 then '{"distance_km":[10,21.1],"unknown":1}' when 5 then '{"country":null}' when 6 then '{}' when 7 then '{"elevation_gain_m":"high"}'
  when 8 then concat('{"date":"', date_s, '"}') else '{"date":20010101}' end"""


@query(
    "X15_merged_facts",
    """select entity_id, case when ord % 10 = 0 then '2001-01-01' else date_s end as date,
      case when ord % 10 = 4 then '10.0, 21.1' else array_to_string(list_transform(numeric_facts, lambda x: x::decimal(18, 1)::varchar), ', ') end as distances, null::varchar as deadline,
      case when ord % 10 <> 6 then ord % 10 in (0, 4, 8) end as accepted, ord % 10 = 0 and date_s <> '2001-01-01' or ord % 10 = 4 as changed from v_entity""",
)
def x15(v):
    """Changed facts override the old ones where the whole keeps the declared schema; a rejected change leaves all as it was."""
    none = F.lit(None)
    facts = F.struct(
        F.col("date_s").alias("date"), F.col("numeric_facts").cast("array<double>").alias("distance_km"), none.cast("double").alias("elevation_gain_m"), none.cast("string").alias("registration_status"),
        none.cast("string").alias("registration_deadline"), none.cast("string").alias("city"), F.col("region_id").alias("country"),
    )
    rows = v.v_entity.select("entity_id", facts.alias("facts"), F.expr(f"parse_json({_CHANGES})").alias("changes"))
    out = lifecycle.merged_facts(rows, schema.FACTS["races"])
    distances = F.array_join(F.transform("facts.distance_km", lambda x: F.format_string("%.1f", x)), ", ")
    return out.select("entity_id", "facts.date", distances.alias("distances"), F.col("facts.registration_deadline").alias("deadline"), "accepted", "changed")


@query("U5_same_questions")
def u5(v):
    return quality.same_questions(v.v_faq)


@query("X5_scrubbed_faqs")
def x5(v):
    """FAQs that don't ask for a status, answers scrubbed."""
    lists = v.v_faq.groupBy("owner_id").agg(F.sort_array(F.collect_list(F.struct("pos", "question", "answer"))).alias("faqs"))
    return lists.select("owner_id", F.size("faqs").alias("n"), F.size(text.drop_status_faqs(F.col("faqs"))).alias("n_kept"))


@query("J3_root_of_region", f"with {_CLOSURE}, q as ({_ROOT}) select region_id, root, region_id <> root as nested from q")
def j3(v):
    return hierarchy.roots(v.v_region).select("region_id", "root", (F.col("region_id") != F.col("root")).alias("nested"))
