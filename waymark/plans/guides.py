"""Queries: hierarchy, categories, guides."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import categories, guides, hierarchy, listing
from waymark.plans.registry import query
from waymark.plans.views import AS_OF

#: Every key of a specification and every operator.
GUIDES = (
    {"id": "g01", "region_id": "r1", "sort_by": "reliability_score", "limit": 10},
    {"id": "g02", "category_id": "small", "sort_by": "reliability_score", "descending": False, "limit": 25},
    {"id": "g03", "tags_any": ["AF", "RF"], "facts": [("date_s", "gte", "1999-01-01")], "limit": 12},
    {"id": "g04", "region_id": "r2", "category_id": "large", "pins": ["e1", "e2", "e3"], "sort_by": "reliability_score", "limit": 15},
    {"id": "g05", "facts": [("name", "eq", "1-URGENT"), ("reliability_score", "gt", 95)], "sort_by": "reliability_score"},
    {"id": "g06", "facts": [("name", "neq", "1-URGENT"), ("reliability_score", "lte", 1)], "limit": 30},
    {"id": "g07", "facts": [("numeric_facts", "contains", 50.0), ("reliability_score", "lt", 5)], "limit": 30},
    {"id": "g08", "facts": [("name", "in", ["2-HIGH", "5-LOW"]), ("slug", "contains", "-1996")], "sort_by": "reliability_score", "limit": 20},
    {"id": "g09", "category_id": "none-such"},
    {"id": "g10", "region_id": "n3", "facts": [("date_s", "no-such-operator", 1)], "pins": ["e5"], "limit": 8},
)

_CLOSURE = """cl as (
  select region_id, region_id as anc, 0 as depth from v_region
  union all select region_id, parent_region_id, 1 from v_region where parent_region_id is not null
  union all select a.region_id, b.parent_region_id, 2 from v_region a join v_region b on a.parent_region_id = b.region_id
    where b.parent_region_id is not null)"""
_FIRST = """case when {v} between 1 and 10 then 'small' when {v} between 11 and 25 then 'mid' when {v} between 26 and 45 then 'large'
  when {v} >= 46 then 'xl' end"""
_MEMBER = f"""mem as (
  select entity_id, category_id from v_entity
  union select entity_id, c from (select entity_id, {_FIRST.format(v="v")} as c from (select entity_id, unnest(numeric_facts) as v from v_entity)) where c is not null)"""


@query("F1_published", "select entity_id, status from v_entity where status in ('active', 'needs_review')")
def f1(v):
    return v.v_entity.filter(guides.published()).select("entity_id", "status")


@query("F2_reviewable", "select review_id, status from v_review where status is distinct from 'draft'")
def f2(v):
    return v.v_review.filter(guides.reviewable()).select("review_id", "status")


@query("J1_region_closure", f"with {_CLOSURE} select region_id, anc, depth from cl")
def j1(v):
    return hierarchy.closure(v.v_region)


_ROOT = "select region_id, arg_max(anc, depth) as root from (select cl.region_id, anc, depth from cl join (select region_id as anc from v_region) using (anc)) group by region_id"


@query("J2_root", f"with {_CLOSURE} {_ROOT}")
def j2(v):
    return hierarchy.roots(v.v_region)


@query(
    "J3_country",
    f"with {_CLOSURE} select v.region_id, min(c.region_id) as anc from v_region v left join cl on cl.region_id = v.region_id"
    " left join (select region_id from v_region where granularity = 'country') c on c.region_id = cl.anc group by v.region_id",
)
def j3(v):
    return hierarchy.nearest(v.v_region, "country")


@query("J4_region_hub", f"with {_CLOSURE} select entity_id, v_entity.region_id from v_entity join cl using (region_id) where anc = 'r3'")
def j4(v):
    return hierarchy.members(v.v_entity, v.v_region, F.lit("r3")).select("entity_id", "region_id")


@query("F5_first_range", f"select entity_id, pos, l_quantity, {_FIRST.format(v='l_quantity')} as matched from (select concat('e', l_orderkey) as entity_id, l_linenumber as pos, l_quantity from lineitem)")
def f5(v):
    lines = v.lineitem.select(F.concat(F.lit("e"), "l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("pos"), "l_quantity")
    return categories.first_match(lines, v.v_category, "l_quantity")


@query("J5_category_membership", f"with {_MEMBER} select entity_id, category_id from mem")
def j5(v):
    return categories.memberships(v.v_entity, v.v_category)


@query("F6_lapsed", f"select entity_id, length(date_s) >= 10 and date_s < '{AS_OF}' as lapsed from v_entity")
def f6(v):
    return v.v_entity.select("entity_id", ((F.length("date_s") >= 10) & (F.col("date_s") < AS_OF)).alias("lapsed"))


@query("F12_scope", "select entity_id from v_entity where len(numeric_facts) = 0 or len(list_filter(numeric_facts, lambda x: x between 11 and 12)) > 0")
def f12(v):
    return categories.in_scope(v.v_entity, 11, 12).select("entity_id")


@query(
    "X8_narrowed_facts",
    "with n as (select entity_id, list_filter(numeric_facts, lambda x: x between 1 and 10) as k, numeric_facts from v_entity)"
    " select entity_id, list_reverse_sort(case when len(k) > 0 then k else numeric_facts end) as narrowed from n",
)
def x8(v):
    return categories.narrowed(v.v_entity, 1, 10).select("entity_id", "narrowed")


@query("A1_region_counts", f"with {_CLOSURE} select r.region_id, count(entity_id) as n from v_region r left join cl on cl.anc = r.region_id left join v_entity e on e.region_id = cl.region_id group by r.region_id")
def a1(v):
    return hierarchy.counts(v.v_entity, v.v_region)


@query("A2_regions_with_entities", f"with {_CLOSURE} select distinct anc as region_id from cl join v_entity using (region_id)")
def a2(v):
    return hierarchy.counts(v.v_entity, v.v_region).filter("n > 0").select("region_id")


@query("A3_category_counts", f"with {_MEMBER} select category_id, count(distinct entity_id) as n from mem group by category_id")
def a3(v):
    return categories.memberships(v.v_entity, v.v_category).groupBy("category_id").agg(F.count_distinct("entity_id").alias("n"))


@query("A4_hub_stats", f"with {_CLOSURE}, {_MEMBER} select anc as region_id, count(distinct entity_id) as n_entities, count(distinct mem.category_id) as n_categories, count(distinct cl.region_id) as n_regions from v_entity join cl using (region_id) join mem using (entity_id) group by anc")
def a4(v):
    return guides.hub_stats(v.v_entity, v.v_region, v.v_category)


@query("A6_facet_values", "select category_id, label from v_category where category_id in (select category_id from v_entity where region_id = 'n7')")
def a6(v):
    return v.v_category.join(v.v_entity.filter("region_id = 'n7'"), "category_id", "left_semi").select("category_id", "label")


@query(
    "A7_guide_grid",
    f"""with {_CLOSURE}, {_MEMBER}, c as (select cl.region_id, anc as root from cl join v_region r on r.region_id = cl.anc where granularity = 'country'),
    m as (select mem.category_id, root, entity_id from mem join v_entity e using (entity_id) join c on c.region_id = e.region_id where status <> 'archived'),
    t as (select region_id as root from v_region where granularity = 'country' union all select null)
    select v_category.category_id, t.root, (select count(distinct entity_id) from m where m.category_id = v_category.category_id and (t.root is null or m.root = t.root)) as n
    from v_category, t""",
)
def a7(v):
    return guides.grid(v.v_entity, v.v_region, v.v_category)


def _case(g: dict) -> str:
    c = ["status in ('active', 'needs_review')"]
    lit = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    if "region_id" in g:
        c.append(f"region_id in (select region_id from cl where anc = '{g['region_id']}')")
    if "category_id" in g:
        c.append(f"entity_id in (select entity_id from mem where category_id = '{g['category_id']}')")
    if "tags_any" in g:
        c.append(f"list_has_any(tags, {g['tags_any']})")
    ops = {"eq": "=", "neq": "is distinct from", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
    for f, op, x in g.get("facts", ()):
        if op in ops:
            c.append(f"{f} {ops[op]} {lit(x)}")
        elif op == "in":
            c.append(f"{f} in ({', '.join(map(lit, x))})")
        elif op == "contains":
            c.append(f"list_contains({f}, {x})" if f == "numeric_facts" else f"contains({f}, {lit(x)})")
    pins = g.get("pins", [])
    pin = f"coalesce(list_position({pins}, entity_id), 0)" if pins else "0"
    sort = f"{g['sort_by']}::double {'desc' if g.get('descending', True) else 'asc'} nulls last, " if "sort_by" in g else ""
    hit = " and ".join(f"coalesce({x}, false)" for x in c)
    return (
        f"select guide_id, rank, entity_id from (select '{g['id']}' as guide_id, entity_id, row_number() over (order by {sort}not hit, case when not hit then pin end, ord) as rank"
        f" from (select *, {hit} as hit, {pin} as pin from v_entity) where hit or pin > 0)" + (f" where rank <= {g['limit']}" if g.get("limit") else "")
    )


_LISTED = f"{_CLOSURE}, {_MEMBER}, listed as ({' union all '.join(_case(g) for g in GUIDES)})"


@query("guide_ranking", f"with {_LISTED} select guide_id, rank, entity_id from listed")
def guide_ranking(v):
    """F3, F4, U1, W3 and W16: every guide resolved and ranked in one job."""
    return guides.resolve(v.v_entity, v.v_region, v.v_category, GUIDES)


#: Orders by a date, a name, a path and mixed types; facts on paths, absent fields, lists, truth values and null.
FACT_GUIDES = (
    {"id": "f01", "sort_by": "date_s", "descending": False, "limit": 20},
    {"id": "f02", "facts": [("course.gain", "gt", 300)], "sort_by": "name"},
    {"id": "f03", "sort_by": "course.gain"},
    {"id": "f04", "facts": [("nothing.at.all", "neq", 5), ("night", "eq", True)], "sort_by": "date", "descending": False, "limit": 15},
    {"id": "f05", "facts": [("distance_km", "contains", 5)], "limit": 30},
    {"id": "f06", "facts": [("course.gain", "in", [10, "g3", None])]},
    {"id": "f07", "facts": [("distance_km.0", "lte", 3)], "sort_by": "reliability_score", "limit": 40},
    {"id": "f08", "facts": [("course.gain", "contains", "12")], "sort_by": "course.gain", "descending": False},
    {"id": "f09", "facts": [("course.gain", "lt", "g5")], "sort_by": "no.such.path", "limit": 25},
    {"id": "f10", "facts": [("date", "gte", "1997-01-01"), ("nothing", "lt", 7)], "pins": ["e7", "e1"]},
)
#: The kind of course.gain is that of ord % 5: number, text, absent, text that is a number, null.
_FACTS = """concat('{"date":"', date_s, '","distance_km":[', array_join(transform(numeric_facts, x -> cast(x as string)), ','), '],"night":',
  case when ord % 2 = 0 then 'true' else 'false' end, case ord % 5 when 0 then concat(',"course":{"gain":', cast(ord % 500 as string), '}')
    when 1 then concat(',"course":{"gain":"g', cast(ord % 7 as string), '"}') when 3 then concat(',"course":{"gain":"', cast(ord % 400 as string), '"}')
    when 4 then ',"course":{"gain":null}' else '' end, '}')"""


PUBLISHED = "status in ('active', 'needs_review')"


def _fact_sql() -> str:
    hits = {
        "f01": ("true", "date_s, ord", 20), "f02": ("ord % 5 = 0 and ord % 500 > 300 or ord % 5 = 3 and ord % 400 > 300", "name desc, ord", None),
        "f03": ("true", "case when gain_text is not null then 0 when gain_number is not null then 1 else 2 end, gain_text desc, gain_number desc, ord", None),
        "f04": ("ord % 2 = 0", "date_s, ord", 15), "f05": ("list_contains(numeric_facts, 5)", "ord", 30),
        "f06": ("gain_number = 10 or gain_text = 'g3' or ord % 5 = 4", "ord", None), "f07": ("numeric_facts[1] <= 3", "reliability_score desc, ord", 40),
        "f08": ("contains(gain_number::varchar, '12') or contains(gain_text, '12')", "gain_number nulls last, gain_text, ord", None),
        "f09": ("gain_text < 'g5'", "ord", 25),
    }
    parts = [
        f"select '{g}' as guide_id, entity_id, row_number() over (order by {order}) as rank, {limit or 'null'} as lim from f where {PUBLISHED} and coalesce({hit}, false)"
        for g, (hit, order, limit) in hits.items()
    ]
    pins = "select 'f10', entity_id, list_position(['e7', 'e1'], entity_id), null from f where entity_id in ('e7', 'e1')"
    return f"""with f as (select *, case when ord % 5 = 0 then ord % 500 end as gain_number,
      case ord % 5 when 1 then concat('g', ord % 7) when 3 then (ord % 400)::varchar end as gain_text from v_entity),
      r as ({' union all '.join(parts)} union all {pins})
    select guide_id, rank::int as rank, entity_id from r where lim is null or rank <= lim"""


@query("F4_W3_open_facts", _fact_sql())
def fact_guides(v):
    """Guides over entities whose facts are an open record."""
    entities = v.v_entity.withColumn("core_facts", F.expr(f"parse_json({_FACTS})"))
    return guides.resolve(entities, v.v_region, v.v_category, FACT_GUIDES)


@query(
    "A8_fingerprints",
    f"""with {_LISTED}, i as (select guide_id, count(*) as n, array_to_string(list_sort(list(entity_id)), '|') as s from listed group by guide_id),
    h as (select guide_id, n, list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::bigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) as h from i)
    select guide_id, n, concat(n, '-', lpad(lower(to_hex(h)), 8, '0')) as fingerprint from h""",
)
def a8(v):
    return guides.fingerprints(guide_ranking(v))


@query(
    "A8_unlimited_fingerprints",
    """with i as (select category_id as guide_id, count(*) as n, array_to_string(list_sort(list(entity_id)), '|') as s from v_entity group by category_id),
    h as (select guide_id, n, list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::bigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) as h from i)
    select guide_id, n, concat(n, '-', lpad(lower(to_hex(h)), 8, '0')) as fingerprint from h""",
)
def a8_unlimited(v):
    """The fingerprints of guides without limit, one for each category."""
    return guides.fingerprints(v.v_entity.select(F.col("category_id").alias("guide_id"), "entity_id"))


@query("A9_stale_copy", f"with {_LISTED} select guide_id, count(*) as n from listed group by guide_id having count(*) <> 10")
def a9(v):
    """Guides whose stored fingerprint (of ten entities) is another one; the hash is tested on known values."""
    now = guides.fingerprints(guide_ranking(v)).withColumn("stored", F.when(F.col("n") == 10, F.col("fingerprint")))
    return now.filter(guides.stale(F.col("stored"), F.col("fingerprint"))).select("guide_id", "n")


@query("W2_category_order", "with c as (select p_brand as label, nullif(min(p_size), 1) as min_v from part group by p_brand) select label, row_number() over (order by min_v desc nulls last, label) as place from c")
def w2(v):
    """Brands as categories, from their least size up; those that begin at one have no range."""
    c = v.part.groupBy(F.col("p_brand").alias("label")).agg(F.nullif(F.min("p_size"), F.lit(1)).alias("min_v"))
    return hierarchy.by_range(c, "min_v", "label").select("label", "place")


@query("W5_featured", "select entity_id, reliability_score from v_entity where status in ('active', 'needs_review') order by reliability_score desc, ord limit 6")
def w5(v):
    return listing.featured(v.v_entity, 6).select("entity_id", "reliability_score")


@query("W8_sibling_regions", f"with {_CLOSURE}, n as (select anc as region_id, count(*) as n from cl join v_entity using (region_id) group by anc) select region_id, n from n join v_region using (region_id) where granularity = 'country' and region_id <> 'r0' order by n desc, region_id limit 6")
def w8(v):
    found = hierarchy.counts(v.v_entity, v.v_region).join(v.v_region.filter("granularity = 'country' and region_id <> 'r0'").select("region_id"), "region_id")
    return found.filter("n > 0").orderBy(F.desc("n"), "region_id").limit(6)
