"""Queries: pages, texts, questions, quality rules, results, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import pages, text
from waymark.operators import crawl, quality, results
from waymark.plans.registry import query
from waymark.plans.views import AS_OF
from waymark.sources import exports


def _html_sql(html: str) -> str:
    """html_to_text in SQL; the hidden elements one by one, as RE2 has no back-references."""
    t = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript", "head"):
        t = f"regexp_replace({t}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    t = rf"(select array_to_string(list_transform(range(1, len(b) + 1), lambda i: concat(b[i], coalesce(chr(c[i]::int), ''))), '') from (select regexp_split_to_array(t, '&#\d+;') as b, regexp_extract_all(t, '&#(\d+);', 1) as c from (select {t} as t)))"
    for entity, char in pages.ENTITIES:
        t = f"replace({t}, '{entity.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    line = r"regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: {line}), lambda x: x <> ''), chr(10))"


@query("T1_html_text", f"select page_id, {_html_sql('html')} as text from pages")
def t1(v):
    return v.pages.select("page_id", pages.html_to_text(F.col("html")).alias("text"))


_HREF = r"""(?is)<a\s+[^>]*href=["'']([^"''#][^"'']*)["''][^>]*>(.*?)</a>"""


@query(
    "T2_links",
    rf"""with a as (select page_id, url, regexp_extract_all(html, '{_HREF}', 1) as h, regexp_extract_all(html, '{_HREF}', 2) as t from pages),
    l as (select page_id, url as base, unnest(h) as href, unnest(t) as inner_html, generate_subscripts(h, 1) as n from a),
    x as (select page_id, n, case when starts_with(href, '/') then concat(regexp_extract(base, '^(https?://[^/?#]+)', 1), href) else href end as url, trim(regexp_replace({_html_sql('inner_html')}, '\s+', ' ', 'g')) as text from l)
    select page_id, (row_number() over (partition by page_id order by n) - 1)::int as pos, url, text from x where text <> ''
    qualify regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:')""",
)
def t2(v):
    found = v.pages.select("page_id", "url", F.posexplode(pages.links(F.col("html"))).alias("pos", "a"))
    # links that neither are whole nor stand on a page with an address are left out
    return found.select("page_id", "pos", pages.absolute(F.col("a.href"), F.col("url")).alias("url"), "a.text").filter("url is not null")


def _cut(start: str) -> str:
    window = f"substr(text, {start} + 1, 6000)"
    back = f"strpos(reverse({window}), ' ')"
    return f"case when {start} + 6000 < length(text) and {back} > 0 and length({window}) - {back} > 5400 then {start} + length({window}) - {back} else least({start} + 6000, length(text)) end"


@query(
    "T3_chunks",
    f"""with recursive c as (
      select doc_id, text, 0 as chunk, 0 as start, {_cut("0")} as cut from documents where length(text) > 6000
      union all select doc_id, text, chunk + 1, s, {_cut("s")} from (select *, greatest(cut - 200, start + 1) as s from c where cut < length(text) and chunk < 7))
    select doc_id, chunk, substr(text, start + 1, cut - start) as text from c union all select doc_id, 0, text from documents where length(text) between 1 and 6000""",
)
def t3(v):
    return v.documents.select("doc_id", F.posexplode(pages.chunks(F.col("text"))).alias("chunk", "text"))


@query("T4_truncated", "select doc_id, case when length(text) > 1000 then concat(substr(text, 1, 1000), chr(10), '...[truncated]') else text end as text from documents")
def t4(v):
    return v.documents.select("doc_id", pages.truncate(F.col("text"), 1000).alias("text"))


@query(
    "T5_focus",
    """with p as (select doc_id, text, strpos(lower(text), 'idiot') as hit, greatest(strpos(lower(text), 'idiot') - 1 - 100, 0) as s from documents)
    select doc_id, case when length(text) <= 300 then text
      when hit > 0 then concat(case when s > 0 then concat('...[earlier content omitted]', chr(10)) else '' end, substr(text, s + 1, 300), case when s + 300 < length(text) then concat(chr(10), '...[truncated]') else '' end)
      else concat(substr(text, 1, 300), chr(10), '...[truncated]') end as text from p""",
)
def t5(v):
    return v.documents.select("doc_id", pages.focus(F.col("text"), F.lit("idiot"), 300).alias("text"))


@query("T7_crawl_gate", "select page_id, not (regexp_matches(url, '^https?://[^/]*\\.net/(es|fr)/') or (regexp_matches(url, '^https?://[^/]*\\.com/en/') and not regexp_matches(url, '^https?://[^/]*\\.com/en/1'))) as allowed from pages")
def t7(v):
    """T6 and T7: robots rules of each host, parsed and applied."""
    hosts = v.pages.select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).distinct()
    body = (
        F.when(F.col("host").endswith(".net"), "# rules\nUser-agent: *\nDisallow: /es/\nDisallow: /fr/ # both\nDisallow:")
        .when(F.col("host").endswith(".com"), "User-agent: *\nDisallow: /\n\nUser-agent: otherbot\nUser-agent: waymark\nDisallow: /en/\nAllow: /en/1\n")
    )
    rules = crawl.robots_rules(hosts.select("host", body.alias("robots")))
    return crawl.gate(v.pages.select("page_id", "url"), rules, "Waymark/1.0 (waymark)").select("page_id", "allowed")


@query("T8_fetch_plan", "select page_id, (row_number() over (partition by regexp_extract(url, '^https?://([^/?#]+)', 1) order by page_id) - 1) * 300 as at_ms from pages")
def t8(v):
    return crawl.fetch_times(v.pages.select("page_id", "url"), 300).select("page_id", "at_ms")


#: Requests of which a third name one host besides its own, against a gap of twenty minutes.
_HOST = "case when ord % 3 = 0 then 'h0' else host end"


@query(
    "T8_throttled_requests",
    f"""with recursive q as (
      select ord, {_HOST} as host, epoch_us(ts)::bigint as arrival, row_number() over (partition by {_HOST} order by ts, ord) as k from v_fetch),
    r as (
      select ord, host, k, arrival, arrival as at_us from q where k = 1
      union all select q.ord, q.host, q.k, q.arrival, greatest(q.arrival, r.at_us + 1200000000) from r join q on q.host = r.host and q.k = r.k + 1)
    select ord, host, arrival, at_us from r""",
)
def t8_throttled(v):
    requests = v.v_fetch.select("ord", F.expr(_HOST).alias("host"), "ts", F.expr("unix_micros(cast(ts as timestamp))").alias("arrival"))
    return crawl.throttled(requests, ["host"], [F.asc("ts"), F.asc("ord")], F.col("arrival"), 1_200_000_000, "at_us").select("ord", "host", "arrival", "at_us")


@query("T9_source_urls", "select page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) as host from pages")
def t9(v):
    bare = v.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("url"))
    whole = F.when(F.col("url").rlike("^https?://"), F.col("url")).otherwise(F.concat(F.lit("https://"), "url"))
    return bare.select("page_id", F.try_parse_url(whole, F.lit("HOST")).alias("host"))


@query("T10_answers", "select ord, case when ord % 4 <> 3 then (props::json->>'k')::int end as k from (select event_id as ord, props from events)")
def t10(v):
    found = v.v_response.select("ord", pages.answer_json(F.col("answer")).alias("json"))
    return found.select("ord", F.get_json_object("json", "$.k").cast("int").alias("k"))


@query("T12_slugs", "select doc_id, regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from documents")
def t12(v):
    return v.documents.select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("X1_dates", "select entity_id, substr(date_s, 1, 7) as month, strftime(date_s::date, '%B %Y') as label, (day(date_s::date))::varchar as day, upper(strftime(date_s::date, '%b')) as mon from v_entity")
def x1(v):
    d = F.col("date_s")
    return v.v_entity.select("entity_id", text.month_key(d).alias("month"), text.month_label(d).alias("label"), text.day_month(d)["day"].alias("day"), text.day_month(d)["month"].alias("mon"))


_STATUS = "['open', 'not_yet_announced', 'Sold Out', 'opens 1 Jul 2026', 'opens May 5, 1999', 'registration closed', 'TBA', '', 'opening soon']"


@query(
    "X3_availability",
    rf"""with a as (select entity_id, ({_STATUS})[(ord % 9)::int + 1] as said from v_entity),
    d as (select *, lower(said) as s, coalesce(try_strptime(regexp_extract(said, '\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}}'), '%d %b %Y'), try_strptime(regexp_extract(said, '[A-Z][a-z]{{2}} \d{{1,2}}, \d{{4}}'), '%b %d, %Y')) as day from a)
    select entity_id, case when trim(said) = '' then null when regexp_matches(s, 'closed|sold out|fully booked|ended|full house') then 'closed'
        when not regexp_matches(s, 'not yet|not_yet|tba|to be announced|closed|pending') and regexp_matches(s, '\bopen\b') then 'open'
        when regexp_matches(regexp_replace(s, '[_-]+', ' ', 'g'), 'not yet (open|announced|confirmed|available|live)|\bopening soon\b|\bcoming soon\b|\bopens\b|\bwill open\b') and not coalesce(day < '{AS_OF}'::timestamp, false) then 'not_yet_open' end as state,
      trim(said) = '' or regexp_matches(trim(s), '^(not[\s_-]*yet[\s_-]*announced|to[\s_-]*be[\s_-]*announced|tba|tbc|tbd|unknown|unconfirmed|none|n/?a)$') as unknown from d""",
)
def x3(v):
    """X2 and X3 over nine phrasings."""
    import ast

    said = F.get(F.lit(ast.literal_eval(_STATUS)), (F.col("ord") % 9).cast("int"))
    return v.v_entity.select("entity_id", text.availability(said, AS_OF).alias("state"), text.is_unknown(said).alias("unknown"))


@query("X4_scrubbed")
def x4(v):
    """Every text with a status sentence put behind its first sentence loses it again."""
    said = F.regexp_replace("text", r"^([^.!?]*[.!?])\s", "$1 Registration is open now. ")
    return v.documents.select("doc_id", text.scrub(said).alias("text"))


@query("X6_scores", r"select review_id, trim(regexp_replace(regexp_replace(body, '\s*\(\s*\d{1,3}\s*/\s*100\s*\)', '', 'g'), '\s{2,}', ' ', 'g')) as tail from v_review")
def x6(v):
    return v.v_review.select("review_id", text.strip_score(F.col("body")).alias("tail"))


@query("X7_artifacts", r"select review_id, regexp_matches(body, '</?cite[^>]*>') as had_tag, regexp_matches(body, '\[\d+-[^\]]*\]') as had_ref, regexp_matches(regexp_replace(regexp_replace(body, '(?i)</?cite[^>]*>', '', 'g'), '\s*\[\d+-[^\]]*\]', '', 'g'), '(?i)<cite|\[\d+-[^\]]*\]') as left_over from v_review")
def x7(v):
    clean = text.strip_artifacts(F.col("body"))
    return v.v_review.select(
        "review_id", F.col("body").rlike("(?i)</?cite[^>]*>").alias("had_tag"), F.col("body").rlike(text.CHUNK_REF).alias("had_ref"),
        (clean.rlike("(?i)<cite") | clean.rlike(text.CHUNK_REF)).alias("left_over"),
    )


@query("X10_fact_rows", "select entity_id, k as fact, v as value from (select entity_id, unnest(['Name', 'Category Id', 'Numeric Facts']) as k, unnest([name, category_id, array_to_string(list_transform(list_reverse_sort(numeric_facts), lambda x: x::bigint::varchar), ', ')]) as v from v_entity) where v <> ''")
def x10(v):
    numbers = F.array_join(F.transform(F.sort_array("numeric_facts", False), lambda x: x.cast("bigint").cast("string")), ", ")
    rows = {"Name": F.col("name"), "Category Id": F.col("category_id"), "Numeric Facts": numbers}
    facts = F.array(*(F.struct(F.lit(k).alias("fact"), c.alias("value")) for k, c in rows.items()))
    return v.v_entity.select("entity_id", F.inline(facts)).filter("value <> ''")


@query("X12_word_counts", r"select doc_id, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) as n from documents")
def x12(v):
    return v.documents.select("doc_id", text.word_count(F.col("text")).cast("long").alias("n"))


@query("V6_near_duplicate_questions")
def v6(v):
    return quality.near_duplicate_questions(v.v_faq)


@query("U4_merged_faqs")
def u4(v):
    merged = v.v_faq.groupBy("owner_id").agg(F.sort_array(F.collect_list(F.struct("pos", "question", "answer"))).alias("faqs"))
    return merged.select("owner_id", F.size("faqs").alias("n"), text.dedupe_faqs(F.col("faqs")).alias("faqs")).select("owner_id", "n", F.size("faqs").alias("n_kept"))


V_SQL = r"""select * from (
      select 'review' as collection, review_id as key, 'V11.cite' as rule, 'error' as severity from v_review where regexp_matches(body, '(?i)</?cite')
      union all select 'review', review_id, 'V11.ref', 'error' from v_review where regexp_matches(body, '\[\d+-\d+\]')
      union all select 'review', review_id, 'V10.entity', 'error' from v_review where entity_id not in (select entity_id from v_entity)
      union all select 'review', review_id, 'V13.year', 'warning' from v_review where not contains(body, '2024')
      union all select 'review', review_id, 'V5.check', 'warning' from v_review where regexp_matches(body, '(?i)(last )?verified on [^.]*?\d{4}')
      union all select 'faq', concat(owner_id, ':', pos), 'V7.answer', 'warning' from v_faq where len(list_filter(regexp_split_to_array(trim(answer), '\s+'), lambda x: x <> '')) not between 30 and 80
      union all select 'entity', entity_id, 'V2.slug', 'error' from v_entity qualify row_number() over (partition by slug order by ord) > 1
      union all select 'entity', entity_id, 'V1.tags', 'error' from v_entity where len(tags) > 2
      union all select 'entity', entity_id, 'V4.deadline', 'warning' from v_entity where status = 'active' and date_s < '1996-06-01'
      union all select 'source', concat(entity_id, ':', pos, ':', url), 'V14.page', 'warning' from v_source where not regexp_matches(url, '^https?://[^/?#]+/[^?#]*[^/?#]'))"""


@query("V_violations", V_SQL)
def violations(v):
    return quality.violations(v)


_KNOTS = "values (5.0, 30.0), (10.0, 62.0), (20.0, 130.0), (40.0, 275.0)"


@query(
    "C1_reference_curve",
    f"""with k as (select d, t, lead(d) over (order by d) as d2, lead(t) over (order by d) as t2 from ({_KNOTS}) as x(d, t)),
    l as (select l_orderkey, l_linenumber, l_partkey, l_quantity as q, l_extendedprice as p from lineitem)
    select l_orderkey, l_linenumber, l_partkey, round(case when q < 5 then 30.0 * pow(q / 5.0, 1.06) when q >= 40 then 275.0 * pow(q / 40.0, 1.06)
      else (select exp(ln(t) + (ln(q) - ln(d)) / (ln(d2) - ln(d)) * (ln(t2) - ln(t))) from k where q >= d and q < d2) end, 6) as standard from l""",
)
def c1(v):
    lines = v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("distance"))
    knots = v.spark.createDataFrame([(5.0, 30.0), (10.0, 62.0), (20.0, 130.0), (40.0, 275.0)], "d double, t double")
    return results.standard(lines, knots).select("l_orderkey", "l_linenumber", "l_partkey", F.round("standard", 6).alias("standard"))


@query("C2_projection", "select o_orderkey, target, round(o_totalprice * pow(target / 10.0, 1.06), 4) as power_law, round(o_totalprice * target / 10.0, 4) as linear from orders, (values (5.0::double), (21.1::double), (42.2::double)) t(target)")
def c2(v):
    return results.projections(v.orders.select("o_orderkey", F.col("o_totalprice").alias("time")), [5.0, 21.1, 42.2], 10.0)


@query("C3_split_plan", "with o as (select o_orderkey, 10 + o_orderkey % 30 as total from orders) select o_orderkey, i::int as i, least(5, total - (i - 1) * 5) as part, least(i * 5, total) as running from (select o_orderkey, total, unnest(range(1, ceil(total / 5.0)::int + 1)) as i from o)")
def c3(v):
    return results.splits(v.orders.select("o_orderkey", (10 + F.col("o_orderkey") % 30).alias("total")), "o_orderkey", 5, 120)


@query("C4_bands", "select l_orderkey, l_linenumber, l_partkey, least(l_quantity, 10) * 1.0 + greatest(least(l_quantity, 25) - 10, 0) * 2.0 + greatest(l_quantity - 25, 0) * 3.0 as load from lineitem")
def c4(v):
    bands = [(0.0, 10.0, 1.0), (10.0, 25.0, 2.0), (25.0, None, 3.0)]
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", results.banded(F.col("l_quantity"), bands).alias("load"))


_AGED = """case when a > 35 then greatest(1 - (case when a <= 50 then (a - 35) * 0.006 when a <= 60 then 0.09 + (a - 50) * 0.009 when a <= 70 then 0.18 + (a - 60) * 0.013
    when a <= 80 then 0.31 + (a - 70) * 0.018 else 0.49 + (least(a, 120) - 80) * 0.023 end), 0.15)
  when a < 25 then greatest(1 - least(25 - a, 7) * 0.003 - case when a < 18 then (18 - a) * 0.01 else 0 end, 0.1) else 1 end"""


@query(
    "C4_age_classes",
    f"""with r as (select l_orderkey, l_linenumber, l_partkey, (l_quantity * 2 + 3)::double as a, (l_orderkey % 1000) / 10.0::double as pct from lineitem),
    g as (select *, ({_AGED})::double as f from r)
    select l_orderkey, l_linenumber, l_partkey, round(f, 6) as factor, case when pct / f >= 80 then 'world' when pct / f >= 70 then 'national' when pct / f >= 60 then 'regional'
      when pct / f >= 50 then 'recreational' else 'developing' end as class from g""",
)
def c4_classes(v):
    """Factor by age, and class by the graded percentage, of every line."""
    rows = v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 2 + 3).cast("double").alias("age"), ((F.col("l_orderkey") % 1000) / 10.0).alias("pct"))
    factor = results.age_factor(F.col("age"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(factor, 6).alias("factor"), results.tier(F.col("pct") / factor, results.AGE_CLASSES, "developing").alias("class"))


@query("S7_faq_json", "select owner_id, count(*) as n, arg_min(question, pos) as first_question from v_faq group by owner_id")
def s7(v):
    doc = exports.faq_json(v.v_faq)
    return doc.select("owner_id", F.json_array_length(F.get_json_object("json", "$.mainEntity")).cast("long").alias("n"), F.get_json_object("json", "$.mainEntity[0].name").alias("first_question"))
