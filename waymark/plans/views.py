"""The directory's tables derived from the driver's, as one SQL text for Spark and DuckDB.

The dialects differ in a few functions only, which a text names in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from waymark.sources.staged import package_on_workers

AS_OF = "2000-01-01"
SPARK = {"set": "array_sort(collect_set({}))", "lpad": "lpad(cast({} as string), 2, '0')", "mod": "{}"}
DUCK = {"set": "list_sort(list(distinct {}))", "lpad": "lpad(cast({} as string), 2, '0')", "mod": "{}"}

#: What a line of an order says of a source.
SOURCE = """l_linenumber as pos,
        concat('https://s', cast(l_suppkey as string), '.example.org/p', cast(l_partkey as string)) as url,
        case l_linenumber when 1 then 'official' when 2 then 'news' when 3 then 'review' when 4 then 'social' when 5 then 'other' else 'blog' end as type,
        substr(cast(l_shipdate as string), 1, 10) as last_checked"""

VIEWS = {
    "v_region": """
      select 'root' as region_id, cast(null as string) as parent_region_id, 'world' as granularity, 'World' as label, 0 as ord
      union all select concat('r', cast(r_regionkey as string)), 'root', 'country', r_name, 1 + r_regionkey from region
      union all select concat('n', cast(n_nationkey as string)), concat('r', cast(n_regionkey as string)), 'city', n_name, 100 + n_nationkey from nation""",
    "v_category": """
      select * from (values ('small', 'Small', 1.0e0, 10.0e0, 1), ('mid', 'Middle', 11.0e0, 25.0e0, 2),
        ('large', 'Large', 26.0e0, 45.0e0, 3), ('xl', 'Extra', 46.0e0, cast(null as double), 4)) as t(category_id, label, min_v, max_v, ord)""",
    "v_entity": """
      select concat('e', cast(o_orderkey as string)) as entity_id,
        concat('c', cast(o_custkey as string), '-', substr(cast(o_orderdate as string), 1, 4)) as slug,
        o_orderpriority as name, substr(cast(o_orderdate as string), 1, 10) as date_s,
        case when mx <= 10 then 'small' when mx <= 25 then 'mid' when mx <= 45 then 'large' else 'xl' end as category_id,
        concat('n', cast(c_nationkey as string)) as region_id,
        case o_orderstatus when 'O' then 'active' when 'P' then 'needs_review' else 'archived' end as status,
        cast(floor(o_totalprice) as bigint) % 101 as reliability_score, numeric_facts, tags, o_orderkey as ord
      from orders join customer on o_custkey = c_custkey
      join (select l_orderkey, max(l_quantity) as mx, {set:l_quantity} as numeric_facts,
              {set:concat(l_returnflag, l_linestatus)} as tags from lineitem group by l_orderkey) as q on l_orderkey = o_orderkey""",
    "v_source": f"""
      select concat('e', cast(l_orderkey as string)) as entity_id, {SOURCE}
      from lineitem""",
    "v_review": """
      select concat('r', cast(d.doc_id as string)) as review_id, concat('e', cast(d.doc_id as string)) as entity_id, d.doc_id as ord,
        concat(text, case d.doc_id % 7 when 0 then ' [1]' when 1 then ' [2, 3]' when 2 then ' [16-8]' when 3 then ' [9]'
          when 4 then ' <cite index="1">x</cite>' when 5 then ' (85/100)' else ' Last verified on 2 May 2024.' end) as body,
        d.doc_id % 5 as n_sources, d.doc_id % 4 as n_sections, d.doc_id % 3 as n_faqs,
        case when quality is not null then quality * 60 + toxic * 20 end as rating, lang as topic,
        concat('2024-01-', lpad(cast(d.doc_id % 28 + 1 as string), 2, '0')) as published_at,
        case when d.doc_id % 6 = 0 then 'draft' else 'active' end as status
      from documents d left join labels l on d.doc_id = l.doc_id""",
    "v_faq": """
      select concat('c', cast(q.conv_id as string)) as owner_id, q.turn as pos, q.text as question, a.text as answer
      from conversations q join conversations a on q.conv_id = a.conv_id and a.turn = q.turn + 1
      where q.role = 'user' and a.role = 'assistant'""",
    "v_fetch": """
      select event_id as ord, concat('h', cast(user_id % 20 as string)) as host, ts, user_id,
        event_type <> 'error' as ok, case when event_type = 'error' then case when event_id % 3 = 0 then 'pipeline' else 'source' end end as kind,
        concat('reason ', cast(event_id % 5 as string)) as reason
      from events""",
    "v_reply": """
      select k as ord, concat('e', ks) as entity_id, concat('c', ks) as slug, o_orderpriority as name, concat('About ', o_orderstatus) as short_description,
        case when k % 29 = 0 then 'no answer' else concat('{',
          case when k % 5 = 0 then '"title":"  "' else concat('"title":" Guide ', ks, ' "') end,
          case k % 4 when 0 then concat(',"seo_title":"', repeat('long ', 18), '"') when 1 then ',"seo_title":" Short "' else '' end,
          case when k % 11 = 0 then '' else concat(',"verdict":"Good [16-8]  race <cite index=1>', ks, '</cite>"') end,
          case when k % 6 = 0 then ',"rating":"n/a"' else concat(',"rating":{"overall":', cast(k % 115 as string), ',"breakdown":[{"label":" A","score":3},{"label":"","score":4},{"label":"B"}]}') end,
          ',"sections":[{"heading":"H1 [1-2]","paragraphs":["First [1]."," ","<cite>x</cite>"]},{"heading":" ","paragraphs":["lost"]},{"heading":"H2","paragraphs":[" ",""]},{"heading":"H3"}',
          concat(',{"heading":"H4","paragraphs":["Cites [', cast(k % 5 as string), '] and [1, 9]."]}]'),
          case when k % 17 = 0 then '' else concat(',"sources":[{"n":1,"label":" A ","url":"https://a.org/x","type":"official","publisher":" P "},{"n":0,"label":"Z","url":"https://z.org/","type":"news"},',
            '{"n":2,"label":"B","url":"nowhere","type":"zine"},{"n":3,"label":"C","url":"https://c.org","type":"zine"},{"n":4,"label":"D","url":"https://d.org/', ks, '","type":"', case when k % 7 = 0 then 'social' else 'news' end, '"}]') end,
          case when k % 3 = 1 then '' else concat(',"pull_quotes":[{"quote":"Run ', repeat('far ', case when k % 3 = 0 then 30 else 3 end), '","attribution":"Ann","source_url":"https://a.org/q"},{"quote":"Two","attribution":" ","source_url":"https://a.org/q"},',
          '{"quote":" Three ","attribution":" Bob ","source_url":"https://b.org/q"},{"quote":"Four","attribution":"Cy","source_url":"https://c.org/q"},{"quote":"Five","attribution":"Di","source_url":"https://d.org/q"}]') end,
          concat(',"faqs":[{"question":" How far is it? ","answer":"', repeat('word ', cast(k % 90 as int)), '"},{"question":"What now?","answer":"Go."},{"question":"","answer":"None."}]'),
          concat(',"excerpt_quotes":[{"quote":"', repeat('so ', 150), '","attribution":" Eve ","source_url":"', case when k % 2 = 0 then 'https://e.org/' else 'bad' end, '"},{"quote":" ","attribution":"Flo","source_url":"https://f.org/"}]'),
          case when k % 7 = 0 then ',"highlights":[" "],"watchouts":null' else ',"highlights":["a"," b ","","c","d","e","f"],"watchouts":["1","2","3","4","5"]' end,
          case when k % 3 = 0 then '' else concat(',"sentiment_scores":{"overall":', cast(k % 101 as string), '},"research_confidence":"high"') end,
          case when k % 13 = 0 then '' else ',"ai_summary":"It is long."' end,
          concat(',"short_description":"', repeat('about ', case when k % 8 = 0 then 40 else 4 end), '"'),
          case when k % 9 = 0 then ',"pros":[]' else ',"pros":["good"]' end, case when k % 10 = 0 then ',"cons":"none"' else ',"cons":[]' end,
        '}') end as json
      from (select o_orderstatus, o_orderpriority, o_orderkey as k, cast(o_orderkey as string) as ks from orders) as o""",
    "v_listing": """
      select ord, entity_id, case when ord % 37 = 0 then upper(slug) else slug end as slug, case when ord % 41 = 0 then '' else name end as name, category_id, region_id,
        case when ord % 29 = 0 then repeat('about ', 40) else concat('About ', name) end as short_description, case when ord % 31 = 0 then cast(null as string) else 'It is long.' end as ai_summary,
        case when ord % 43 = 0 then 105 when ord % 47 = 0 then -1 else reliability_score end as reliability_score, tags,
        case when ord % 53 = 0 then 'live' else status end as status, case when ord % 59 = 0 then cast(null as string) else date_s end as last_updated,
        case when ord % 7 = 0 then 'nowhere' else concat('https://x.org/', entity_id) end as link, case when ord % 61 = 0 then '' else 'Sign up' end as link_label,
        date_s as date, case when ord % 4 = 0 then cast(null as string) when ord % 4 = 1 then concat('before ', date_s) else concat(substr(date_s, 1, 4), case when ord % 3 = 0 then '-05-20' else '-01-10' end) end as deadline,
        case ord % 5 when 0 then 'open' when 1 then 'Closed' when 2 then 'registration is OPEN now' when 3 then 'not yet open' else cast(null as string) end as availability,
        r.label as country, case when ord % 3 = 0 then cast(null as string) else n.label end as city, case when ord % 2 = 0 then concat('Org ', entity_id) end as organizer,
        case when ord % 6 = 0 then 'THB 800' end as price_range
      from v_entity join (select region_id, label, parent_region_id from v_region) as n using (region_id) join (select region_id as rid, label from v_region) as r on rid = n.parent_region_id""",
    "v_question": """
      select concat('o', race) as owner_id, cast(p_partkey % 4 as int) as pos,
        case p_partkey % 4 when 0 then concat('What is the entry fee for race ', race, '?')
          when 1 then concat(case when p_partkey % 3 = 0 then 'What is the time limit for race ' else 'What is the fee for the entry at race ' end, race, '?')
          when 2 then concat('How much is ', p_type, ' ', p_name, '?') else concat('What is the weather for ', p_type, ' of race ', race, '?') end as question,
        concat('Answer ', cast(p_partkey as string)) as answer
      from (select *, cast(cast(floor(p_partkey / 4) as bigint) as string) as race from part) as p""",
    "v_response": """
      select event_id as ord, concat('h', cast(user_id % 20 as string)) as source,
        case event_id % 4 when 0 then concat('Here it is: ```json', chr(10), props, chr(10), '``` done')
          when 1 then concat('The answer is ', props, ' as asked.') when 2 then props else substr(props, 1, length(props) - 1) end as answer
      from events""",
}

#: Views whose rows cost far more than those of the table they are made of: that is dealt out by its key first, so that a small file
#: occupies all cores.
DEALT = {"v_reply": {"orders": "o_orderkey"}, "v_entity": {"orders": "o_orderkey"}}


def _text(name: str, dialect: dict[str, str]) -> str:
    return re.sub(r"\{(\w+):([^{}]*)\}", lambda m: dialect[m[1]].format(m[2]), VIEWS[name])


class Views:
    """Derived tables of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        package_on_workers(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.table(name)
        sql = _text(name, SPARK).replace("{", "{{").replace("}", "}}")  # braces of a text, not of a table
        tables = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
        used = {t: getattr(self, t) for t in [*tables, *VIEWS] if re.search(rf"\b(from|join) {t}\b", sql)}
        for t, key in DEALT.get(name, {}).items():
            used[t] = used[t].repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)
        return self.spark.sql(re.sub(r"\b(from|join) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql), **used)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    while more := [v for v in VIEWS if v not in used and any(re.search(rf"\b{v}\b", VIEWS[u]) for u in used)]:
        used = [v for v in VIEWS if v in used or v in more]
    ctes = ",\n".join(f"{v} as ({_text(v, DUCK)})" for v in used)
    if not ctes:
        return sql
    body = sql.strip()
    if body.startswith("with recursive"):
        return f"with recursive {ctes},\n{body[14:]}"
    return f"with {ctes},\n{body[4:]}" if body.startswith("with") else f"with {ctes}\n{body}"
