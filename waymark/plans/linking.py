"""Queries: resolution, related records, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import linking, listing
from waymark.operators.guides import published
from waymark.plans.guides import GUIDES
from waymark.plans.registry import query
from waymark.sources.staged import written


def _split(v):
    """Archived entities as candidates, the others as existing."""
    e = v.v_entity
    return e.filter("status = 'archived'"), e.filter("status <> 'archived'")


@query("J6_label_lookup", "select n_nationkey, r.region_id as matched_id from nation left join v_region r on lower(trim(r.label)) = lower(trim(concat('  ', lower(n_name), ' ')))")
def j6(v):
    raw = v.nation.select("n_nationkey", F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("raw"))
    return linking.by_label(raw, "raw", v.v_region, "region_id").select("n_nationkey", "matched_id")


@query("J7_new_slugs", "select entity_id, slug from v_entity where status = 'archived' and slug <> '' and slug not in (select slug from v_entity where status <> 'archived')")
def j7(v):
    return linking.new_slugs(*_split(v)).select("entity_id", "slug")


@query(
    "J8_exact_duplicates",
    "select c.entity_id, arg_min(x.entity_id, x.ord) as duplicate_of from v_entity c join v_entity x on c.region_id = x.region_id and c.category_id = x.category_id and c.date_s = x.date_s"
    " where c.status = 'archived' and x.status <> 'archived' group by c.entity_id",
)
def j8(v):
    return linking.exact_duplicates(*_split(v))


@query(
    "J9_interval_duplicates",
    "with d as (select *, date_s::date as s, date_s::date + (ord % 3)::int as t from v_entity)"
    " select c.entity_id, arg_min(x.entity_id, x.ord) as duplicate_of from d c join d x on c.region_id = x.region_id and c.s <= x.t and x.s <= c.t and (c.t > c.s or x.t > x.s)"
    " where c.status = 'archived' and x.status <> 'archived' and not exists (select 1 from d y where y.status <> 'archived' and y.region_id = c.region_id and y.category_id = c.category_id and y.date_s = c.date_s) group by c.entity_id",
)
def j9(v):
    """Only where there is no exact duplicate."""
    dated = lambda df: df.withColumn("start", F.to_date("date_s")).withColumn("end", F.date_add(F.to_date("date_s"), (F.col("ord") % 3).cast("int")))
    return linking.interval_duplicates(*map(dated, _split(v)), linking.exact_duplicates(*_split(v)))


_PINS = "pins as (select entity_id, unnest(['e1', 'e4', 'e2']) as other from v_entity where ord % 50 = 0)"
_TIERS = """best1 as (select * from pool qualify row_number() over (partition by category_id, region_id order by score desc nulls last, ord) <= {n}),
best2 as (select * from pool qualify row_number() over (partition by category_id order by score desc nulls last, ord) <= {n}),
best3 as (select * from pool qualify row_number() over (partition by region_id order by score desc nulls last, ord) <= {n}),
found as (
  select t.entity_id, b.other, b.score, b.ord, 1 as tier from target t join best1 b using (category_id, region_id) where t.entity_id <> b.e
  union all select t.entity_id, b.other, b.score, b.ord, 2 from target t join best2 b using (category_id) where t.entity_id <> b.e
  union all select t.entity_id, b.other, b.score, b.ord, 3 from target t join best3 b using (region_id) where t.entity_id <> b.e
  {pins}),
once as (select entity_id, other, min(tier) as tier, any_value(score) as score, any_value(ord) as ord from found group by all),
ranked as (select *, row_number() over (partition by entity_id order by tier, case when tier > 0 then score end desc nulls last, ord) as place from once)
select entity_id, other, place from ranked where place <= {k} or tier = 0"""


@query(
    "J10_related_entities",
    f"with pool as (select entity_id as other, entity_id as e, category_id, region_id, reliability_score as score, ord from v_entity where status <> 'archived'), target as (select * from pool, lateral (select e as entity_id)), {_PINS}, "
    + _TIERS.format(n=7, k=6, pins="union all select p.entity_id, b.other, b.score, b.ord, 0 from pins p join pool b using (other) where p.entity_id <> b.e and p.entity_id in (select entity_id from target)"),
)
def j10(v):
    # read seven times below, so it is derived and written once
    pool = written(v.v_entity.filter(published()).select("entity_id", "category_id", "region_id", "ord", F.col("reliability_score").alias("score")), "pool")
    pins = pool.filter("ord % 50 = 0").select("entity_id", F.explode(F.lit(["e1", "e4", "e2"])).alias("other"))
    return linking.related(pool, pool, [F.desc_nulls_last("score"), F.col("ord")], 6, pins=pins)


@query(
    "J11_related_reviews",
    "with pool as (select r.review_id as other, e.entity_id as e, category_id, region_id, -r.ord as score, r.ord from v_review r join v_entity e using (entity_id) where r.status = 'active'),"
    " target as (select entity_id, category_id, region_id from v_entity where status = 'needs_review'), " + _TIERS.format(n=10, k=4, pins=""),
)
def j11(v):
    reviews = v.v_review.filter("status = 'active'").select("review_id", "entity_id", F.col("ord").alias("ord"), (-F.col("ord")).alias("score"))
    pool = reviews.join(v.v_entity.select("entity_id", "category_id", "region_id"), "entity_id")
    return linking.related(v.v_entity.filter("status = 'needs_review'"), pool, [F.desc_nulls_last("score"), F.col("ord")], 4, key="review_id")


@query(
    "J12_related_guides",
    " union ".join(f"select entity_id, '{g['id']}' as guide_id from v_entity where category_id = '{g.get('category_id', '-')}' or list_contains({g.get('pins', [''])}, entity_id)" for g in GUIDES),
)
def j12(v):
    spec = v.spark.createDataFrame([(g["id"], g.get("category_id"), g.get("pins", [])) for g in GUIDES], "guide_id string, category_id string, pins array<string>")
    return listing.related_guides(v.v_entity, spec)


@query(
    "J13_successors",
    """with k as (select entity_id, ord, regexp_extract(slug, '^(.*)-\\d{4}$', 1) as series, right(slug, 4)::int as y from v_entity),
    ed as (select series, y, arg_min(entity_id, ord) as f, arg_max(entity_id, ord) as l from k group by all),
    nx as (select series, y, lead(y) over w as ny, lead(f) over w as nf, lead(l) over w as nl from ed window w as (partition by series order by y))
    select entity_id, case when ny - y <= 3 then nl else nf end as successor from k join nx using (series, y) where ny is not null""",
)
def j13(v):
    return linking.successors(v.v_entity)


@query("J14_review_entities", "select review_id, e.entity_id, case when e.status in ('active', 'needs_review') then concat('/e/', e.slug) else concat('/reviews/', review_id) end as href from v_review r join v_entity e using (entity_id) where r.status = 'active'")
def j14(v):
    return listing.review_links(v.v_review, v.v_entity)


_NAMES = """concat('Race ', cast(ord as string), case ord % 4 when 0 then concat(' (RC', cast(ord % 7 as string), ')') when 1 then ' (24th ed.) City'
  when 2 then ' (Air)' else ' (2nd Ed)' end)"""


@query(
    "J15_aliases",
    rf"""with n as (select e.entity_id, {_NAMES.replace("ord", "e.ord").replace("as string", "as varchar")} as name from v_entity e join v_review r using (entity_id) where r.status = 'active'),
    a as (select entity_id, unnest([name, regexp_extract(name, '\(([A-Z0-9]{{2,12}})\)', 1),
      trim(regexp_replace(regexp_replace(name, '(?i)\s*\(\d+(st|nd|rd|th)\s+ed\.?\)\s*', ' ', 'g'), '\s{{2,}}', ' ', 'g')), trim(regexp_replace(name, '\s*\([^)]*\)\s*$', ''))]) as alias from n)
    select distinct entity_id, alias from a where length(alias) >= 3""",
)
def j15(v):
    e = v.v_entity.join(v.v_review.filter("status = 'active'").select("entity_id"), "entity_id")
    return e.select("entity_id", F.explode(linking.aliases(F.expr(_NAMES))).alias("alias"))


@query(
    "J16_first_mentions",
    """with a as (select item_id as url, array_to_string(string_split(text, ' ')[1:3], ' ') as alias from benchmark where len(string_split(text, ' ')) >= 3),
    p as (select doc_id, unnest(string_split(text, chr(10))) as p, unnest(range(0, len(string_split(text, chr(10))))) as paragraph from documents),
    h as (select doc_id, url, paragraph, alias from p join a on contains(p, alias))
    select doc_id, url, paragraph::int as paragraph, alias from h qualify row_number() over (partition by doc_id, url order by paragraph, length(alias) desc, alias) = 1""",
)
def j16(v):
    words = F.split("text", " ")
    names = v.benchmark.filter(F.size(words) >= 3).select(F.col("item_id").alias("url"), F.array_join(F.slice(words, 1, 3), " ").alias("alias"), F.col("item_id").alias("ord"))
    return linking.first_mentions(v.documents, names)


_CITES = r"""c as (select distinct review_id, n_sources, trim(unnest(string_split(g, ',')))::int as n
  from (select review_id, n_sources, unnest(regexp_extract_all(body, '\[(\d+(?:\s*,\s*\d+)*)\]', 1)) as g from v_review))"""


@query("J17_unresolved_citations", f"with {_CITES} select review_id, n from c where n < 1 or n > n_sources")
def j17(v):
    return linking.unresolved(v.v_review)


@query("V12_uncited_sources", f"with {_CITES} select review_id, n::int as n from (select review_id, unnest(range(1, n_sources + 1)) as n from v_review) x where not exists (select 1 from c where c.review_id = x.review_id and c.n = x.n)")
def v12(v):
    return linking.uncited(v.v_review)


@query(
    "J20_related_articles",
    """with t as (select doc_id, lang from documents), a as (select * from t qualify row_number() over (partition by lang order by doc_id desc) <= 7),
    b as (select * from t order by doc_id desc limit 7),
    f as (select t.doc_id, a.doc_id as other, 0 as tier from t join a using (lang) union all select t.doc_id, b.doc_id, 1 from t, b),
    o as (select doc_id, other, min(tier) as tier from f where doc_id <> other group by all)
    select doc_id, other from o qualify row_number() over (partition by doc_id order by tier, other desc) <= 6""",
)
def j20(v):
    return listing.related_articles(v.documents.select("doc_id", "lang"), "doc_id", "lang", 6)


@query("U3_first_names", "select ord from (select ord, row_number() over (partition by host, lower(event_type) order by ord) as rn, event_type from (select event_id as ord, concat('h', user_id % 20) as host, nullif(event_type, 'error') as event_type from events)) where rn = 1 or event_type is null")
def u3(v):
    """The first of each name within a source; nameless rows stay."""
    rows = v.events.select(F.col("event_id").alias("ord"), F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("host"), F.nullif("event_type", F.lit("error")).alias("name"))
    return listing.first_of_name(rows, "host", "name", "ord")


@query("U6_redirected_reviews", "select review_id, entity_id in (select entity_id from v_entity where status <> 'archived') as redirected from v_review")
def u6(v):
    return listing.redirected(v.v_review, v.v_entity)


@query("I8_first_slugs", "select entity_id, slug from v_entity qualify row_number() over (partition by slug order by ord) = 1")
def i8(v):
    return v.v_entity.groupBy("slug").agg(F.min_by("entity_id", "ord").alias("entity_id")).select("entity_id", "slug")
