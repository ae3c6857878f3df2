"""Queries: filters, orders, queues, transitions, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import browse, lifecycle, listing, ranking
from waymark.operators.guides import filter_key
from waymark.plans.registry import query
from waymark.plans.views import AS_OF

PUB = "status in ('active', 'needs_review')"


@query("F7_search", "select entity_id from v_entity e join v_region r using (region_id) where contains(lower(concat_ws(' ', name, r.label, slug)), 'urgent')")
def f7(v):
    e = v.v_entity.join(v.v_region.select("region_id", "label"), "region_id")
    return e.filter(browse.found(" Urgent", "name", "label", "slug")).select("entity_id")


@query("F14_thin_reviews", "select review_id from v_review where n_sections <= 2 or n_faqs <= 1 or n_sources <= 1")
def f14(v):
    return v.v_review.filter(browse.thin(F.col("n_sections"), F.col("n_faqs"), F.col("n_sources"))).select("review_id")


@query("F16_new_flag", "select ord, ts > timestamp '2024-01-30 12:00:00' - interval 26 hours as is_new from v_fetch")
def f16(v):
    return v.v_fetch.select("ord", listing.is_new(F.col("ts"), F.expr("timestamp_ntz'2024-01-30 12:00:00'"), 26).alias("is_new"))


@query("F17_date_driven", "select region_id, count(*) > 0 and bool_and(date_s is not null) as date_driven from v_entity group by region_id")
def f17(v):
    return listing.date_driven(v.v_entity, "region_id", "date_s")


_PAST = f"case when date_s is null then 2 when date_s < '{AS_OF}' then 1 else 0 end"


@query(
    "W1_upcoming_order",
    f"select region_id, entity_id, row_number() over (partition by region_id order by {_PAST}, case when date_s >= '{AS_OF}' then date_s end, case when date_s < '{AS_OF}' then date_s end desc, name, ord) as place from v_entity",
)
def w1(v):
    d = F.col("date_s")
    past = F.when(d.isNull(), 2).when(d < AS_OF, 1).otherwise(0)
    rows = v.v_entity.select("region_id", "entity_id", "ord", "name", past.alias("k"), F.when(d >= AS_OF, d).alias("ahead"), F.when(d < AS_OF, d).alias("behind"))
    order = [F.asc("k"), F.asc("ahead"), F.desc_nulls_last("behind"), F.collate("name", "UNICODE").asc(), F.asc("ord")]
    return ranking.placed(rows, ["region_id"], order).select("region_id", "entity_id", "place")


@query("W7_pages", "select review_id, row_number() over (order by published_at desc, ord) as place, ceil(row_number() over (order by published_at desc, ord) / 24)::bigint as page, count(*) over () as total from v_review")
def w7(v):
    return lifecycle.pages_of(v.v_review.select("review_id", "published_at", "ord"), [F.desc("published_at"), F.asc("ord")], 24).select("review_id", "place", "page", "total")


@query(
    "W7_page_view",
    """with t as (select topic, count(*) as total from v_review group by topic), w as (select distinct topic, unnest([-3, 1, 2, 1000000])::int as wanted from v_review union all select 'none-such', 1),
    p as (select w.topic, wanted, coalesce(total, 0) as total, greatest(1, least(wanted, greatest(1, ceil(coalesce(total, 0) / 24)))) as page from w left join t using (topic))
    select topic, wanted, page::bigint as page, case when total = 0 then '' when total = 1 then '1 review' when total <= 24 then concat(total, ' reviews')
      else concat('Showing ', ((page - 1) * 24 + 1)::bigint, '-', least(page * 24, total)::bigint, ' of ', total, ' reviews') end as line from p""",
)
def w7_view(v):
    """Wanted pages of every topic, some before the first and behind the last."""
    pages = ranking.placed(v.v_review.select("topic", "review_id", "published_at", "ord"), ["topic"], [F.desc("published_at"), F.asc("ord")])
    wanted = v.v_review.select("topic").distinct().withColumn("wanted", F.explode(F.lit([-3, 1, 2, 1_000_000])))
    return lifecycle.page_view(pages, wanted.union(v.spark.createDataFrame([("none-such", 1)], "topic string, wanted int")), "topic", 24)


@query("W9_topic_groups", "with n as (select topic, min((published_at, -ord)) as x, max(published_at) as newest, max_by(ord, (published_at, -ord)) as first_ord from v_review group by topic) select coalesce(topic, 'general') as topic, row_number() over (order by newest desc, first_ord) as place from n")
def w9(v):
    return listing.topic_order(v.v_review)


@query("W10_configured_order", "select region_id, row_number() over (order by case label when 'EUROPE' then 1 when 'ASIA' then 2 else 99 end, label) as place from v_region where granularity = 'country'")
def w10(v):
    return listing.configured_order(v.v_region.filter("granularity = 'country'"), "label", ["EUROPE", "ASIA"]).select("region_id", "place")


@query("W11_preferred_source", "select entity_id, pos, url, type from v_source qualify row_number() over (partition by entity_id order by coalesce(list_position(['official', 'news', 'review', 'social', 'other'], type), 0), pos, url) = 1")
def w11(v):
    return lifecycle.preferred_source(v.v_source)


@query("W12_research_queue", f"select entity_id from v_entity where {PUB} and (ord % 3 = 0 or abs(date_diff('day', date '{AS_OF}', date_s::date)) >= 30) order by date_s, ord limit 40")
def w12(v):
    """W12 and F15: researched on its own date, or never where ord is a multiple of three."""
    e = v.v_entity.withColumn("researched", F.when(F.col("ord") % 3 != 0, F.col("date_s")))
    return lifecycle.research_queue(e, AS_OF, 30, 40).select("entity_id")


@query("W14_targets", "select turn as place, conv_id, concat('e', conv_id * 3) as entity_id, exists (select 1 from v_entity e where e.entity_id = concat('e', conv_id * 3)) as known from conversations")
def w14(v):
    """An explicit list, here one for each conversation, keeps its order; unknown ids are reported."""
    wanted = v.conversations.select(F.col("turn").alias("place"), "conv_id", F.concat(F.lit("e"), (F.col("conv_id") * 3).cast("string")).alias("entity_id"))
    return lifecycle.targets(wanted, v.v_entity, "entity_id")


@query(
    "W15_eligible_guides",
    """with k as (select category_id, region_id, concat('best-', category_id, '-', region_id) as slug, count_if(status <> 'archived')::bigint as n, count_if(status = 'archived') as old from v_entity group by all)
    select slug, category_id, region_id, n from k where n >= 5 and old < 20 and not (category_id = 'xl' and region_id in ('n1', 'n2')) order by n desc, slug limit 12""",
)
def w15(v):
    """Guides to be: pairs of five entities or more whose slug is free and whose coverage is new. Pairs with twenty archived entities have a guide."""
    none = F.array().cast("array<string>")
    shown = F.count_if(F.col("status") != "archived").alias("n")
    pairs = v.v_entity.groupBy("category_id", "region_id").agg(shown, F.count_if(F.col("status") == "archived").alias("old"))
    keyed = pairs.withColumns({"slug": F.concat_ws("-", F.lit("best"), "category_id", "region_id"), "filter_key": filter_key(F.col("category_id"), F.col("region_id"), none)})
    taken = v.v_region.filter("region_id in ('n1', 'n2')").select(F.concat(F.lit("best-xl-"), "region_id").alias("slug"))
    found = lifecycle.eligible(keyed.drop("old"), taken, keyed.filter("old >= 20").select("filter_key"), 5, 12)
    return found.select("slug", "category_id", "region_id", "n")


@query("A5_month_calendar", f"with m as (select substr(date_s, 1, 7) as month, count(*) as n from v_entity group by 1) select month, n, row_number() over (order by month < '{AS_OF[:7]}', month) as place from m")
def a5(v):
    return listing.month_calendar(v.v_entity, "date_s", AS_OF)


@query("A12_freshness", "select e.entity_id, coalesce(max(last_checked), any_value(date_s)) as checked from v_entity e left join v_source s on s.entity_id = e.entity_id group by e.entity_id")
def a12(v):
    return lifecycle.freshness(v.v_entity, v.v_source, "date_s")


@query(
    "A14_source_health",
    "select host, count_if(ok)::bigint as n_ok, count_if(kind = 'source')::bigint as n_unreachable, count_if(kind = 'pipeline')::bigint as n_extraction, arg_min(reason, ord) filter (not ok) as first_reason from v_fetch group by host",
)
def a14(v):
    return lifecycle.source_health(v.v_fetch)


@query("I1_lapse", f"select outcome, status, count(*) as n from (select case when {PUB} and date_s < '{AS_OF}' then 'archived' else 'kept' end as outcome, case when {PUB} and date_s < '{AS_OF}' then 'archived' else status end as status from v_entity) group by all")
def i1(v):
    """I1 and the counters of A15."""
    return lifecycle.lapse(v.v_entity, AS_OF).groupBy("outcome", "status").agg(F.count("*").alias("n"))


_OUT = "select concat('e', o_orderkey) as entity_id, o_orderkey % 4 <> 0 as fetched, case when o_orderkey % 7 = 0 then 'archive' end as advice, o_orderkey % 5 = 0 as changed, case o_orderkey % 3 when 0 then 'high' when 1 then 'low' else 'medium' end as confidence from orders where o_orderkey % 2 = 0"


@query(
    "I2_I3_verification",
    f"""with o as ({_OUT}), j as (select e.*, o.fetched, o.confidence, coalesce(o.advice = 'archive' or o.changed, false) as doubt from v_entity e left join o using (entity_id))
    select entity_id, greatest(0, least(100, reliability_score + case when fetched is not null and not fetched then -15 when fetched is null or doubt then 0 when confidence = 'high' then 3 when confidence = 'low' then -5 else 0 end)) as new_score,
      case when status = 'active' and (coalesce(not fetched, false) or doubt) then 'needs_review' else status end as new_status,
      case when fetched is null then 'unchecked' when not fetched then 'unreachable' when doubt then 'needs_review' else 'verified' end as outcome from j""",
)
def i2(v):
    k = F.col("o_orderkey")
    outcomes = v.orders.filter(k % 2 == 0).select(
        F.concat(F.lit("e"), k.cast("string")).alias("entity_id"), (k % 4 != 0).alias("fetched"), F.when(k % 7 == 0, "archive").alias("advice"),
        (k % 5 == 0).alias("changed"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "low").otherwise("medium").alias("confidence"),
    )
    return lifecycle.verify(v.v_entity, outcomes).select("entity_id", "new_score", "new_status", "outcome")


@query("I4_graduation", "select review_id, case when status = 'draft' then case when n_sources > 2 then 'active' else 'needs_review' end else status end as status from v_review")
def i4(v):
    return v.v_review.select("review_id", listing.graduated(F.col("status"), F.col("n_sources")).alias("status"))


@query(
    "I5_snapshot_diff",
    """with a as (select entity_id, status, reliability_score as s from v_entity where ord % 11 <> 0),
    b as (select entity_id, case when ord % 13 = 0 then 'archived' when ord % 17 = 0 then 'active' else status end as status, case when ord % 19 = 0 then 0 else reliability_score end as s from v_entity where ord % 23 <> 0),
    c as (select coalesce(a.entity_id, b.entity_id) as entity_id, case when a.entity_id is null then 'added' when b.entity_id is null then 'removed'
      when a.status <> 'archived' and b.status = 'archived' then 'archived' when a.status = 'archived' and b.status <> 'archived' then 'unarchived'
      when (a.status, a.s) is distinct from (b.status, b.s) then 'edited' end as change from a full join b on a.entity_id = b.entity_id),
    r as (select change, entity_id, row_number() over (partition by change order by entity_id)::int as place from c where change is not null)
    select change, entity_id, place from r where place <= 60 union all select change, concat(count(*) - 60, ' more'), 0 from r group by change having count(*) > 60""",
)
def i5(v):
    e, k = v.v_entity, F.col("ord")
    before = e.filter(k % 11 != 0).select("entity_id", "status", F.col("reliability_score").alias("s"))
    status = F.when(k % 13 == 0, "archived").when(k % 17 == 0, "active").otherwise(F.col("status"))
    after = e.filter(k % 23 != 0).select("entity_id", status.alias("status"), F.when(k % 19 == 0, 0).otherwise(F.col("reliability_score")).alias("s"))
    return lifecycle.snapshot_diff(before, after, "entity_id", ["s"])


@query(
    "I5_new_guides",
    """with g as (select distinct concat('best-', category_id, '-', region_id) as slug from v_entity where category_id <> 'mid'),
    r as (select slug, row_number() over (order by slug)::int as place from g)
    select 'new guide' as change, slug, place from r where place <= 60 union all select 'new guide', concat(count(*) - 60, ' more'), 0 from r having count(*) > 60""",
)
def i5_guides(v):
    """The report's class of new guides: those of a snapshot whose slug the one before doesn't hold."""
    slugs = v.v_entity.select("category_id", F.concat_ws("-", F.lit("best"), "category_id", "region_id").alias("slug")).distinct()
    return lifecycle.new_guides(slugs.filter("category_id = 'mid'"), slugs)


@query("I6_pacing_gate", "select host, max(ts) as latest, coalesce(max(ts) <= timestamp '2024-01-31 00:00:00' - interval 11 hours, true) as may_act from v_fetch where ok group by host")
def i6(v):
    gate = F.expr("max(ts) <= timestamp_ntz'2024-01-31 00:00:00' - interval 11 hours")
    return v.v_fetch.filter("ok").groupBy("host").agg(F.max("ts").alias("latest"), F.coalesce(gate, F.lit(True)).alias("may_act"))


@query(
    "I6_paced_releases",
    """with recursive q as (
      select ord as item, host, epoch_us(ts)::bigint as arrival, row_number() over (partition by host order by ts, ord) as k from v_fetch where ok),
    r as (
      select item, host, k, arrival, arrival as released from q where k = 1
      union all select q.item, q.host, q.k, q.arrival, greatest(q.arrival, r.released + 39600000000) from r join q on q.host = r.host and q.k = r.k + 1)
    select item, host, arrival, released from r""",
)
def i6_releases(v):
    """When each publication of a host may go, eleven hours after the one before; the stream form is streaming.pacing.releases."""
    items = v.v_fetch.filter("ok").select("host", F.col("ord").alias("item"), F.expr("unix_micros(cast(ts as timestamp))").alias("arrival"))
    return lifecycle.releases(items, 11 * 3_600_000_000)


@query("I7_daily_health", "select host, date_trunc('day', ts)::timestamp as day, count_if(ok)::bigint as n_ok, count(*) as n from v_fetch group by 1, 2")
def i7(v):
    return v.v_fetch.groupBy("host", F.window("ts", "1 day").alias("w")).agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n")).select("host", F.col("w.start").alias("day"), "n_ok", "n")


@query("S4_create_only", "select entity_id from v_entity where entity_id not in (select entity_id from v_review)")
def s4(v):
    return v.v_entity.select("entity_id").join(v.v_review.select("entity_id"), "entity_id", "left_anti")
