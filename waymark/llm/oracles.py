"""DuckDB SQL for the queries that SQL can express."""

from waymark.llm.url_reputation import SUFFIXES

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
with base as (
  select doc_id, coalesce(text, '') as text, {_WORDS} as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents),
m as (
  select doc_id, ws, len(ws)::bigint as n_words,
    list_sum(list_transform(ws, lambda w: length(w)))::bigint as chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_capitals,
    len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines
  from base),
p as (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from base where len(ws) >= 8),
g as (select doc_id, i, array_to_string(ws[i:i+7], ' ') as w from p),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, w) > 1),
c as (select doc_id, least(8, coalesce(lead(i) over (partition by doc_id order by i) - i, 8)) as k from r),
s as (select doc_id, sum(k)::bigint as n_repeat_words from c group by doc_id),
f as (
  select m.doc_id, n_words, coalesce(chars, 0)::bigint as word_chars, n_symbols, n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, n_lines, n_capitals
  from m left join s using (doc_id)),
l as (select *, ((n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint
    + 4 * (100 * n_symbols > 10 * n_words)::bigint + 8 * (100 * n_dup_lines > 30 * n_lines)::bigint
    + 16 * (n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words))::bigint
    + 32 * (100 * n_capitals > 50 * word_chars)::bigint)::bigint as failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed,
  failed = 0 as kept, n_lines, n_capitals, failed, 'full-1' as policy
from l
"""

OP6 = r"""
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body)::bigint as payload_bytes, sha1(body) as h from p),
o as (select h, max(page_id) as original from d group by h),
b as (select d.*, original, list_transform(range(0, 8), lambda i: ('0x' || h[i * 5 + 1 : i * 5 + 5])::bigint) as g from d join o using (h))
select page_id, payload_bytes,
  array_to_string(list_transform(g, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> k) & 31)::int + 1, 1)), '')), '') as payload_digest,
  case when page_id = original then 'response' else 'revisit' end as record_type,
  case when page_id <> original then original end as refers_to
from b
"""


def _strength(level: str) -> str:
    return f"""
{level}_s as (
  select sum(bad) / sum(n) as m, count(*) as k, sum(n) as n, sum(n::double * n) as nn, sum(bad::double * bad / n) as s
  from {level}_c where n > 0),
{level}_k as (
  select coalesce(m, 0) as m, round(least(1000.0, greatest(2.0, case when n - nn / n > 0
      and (s - n * m * m - (k - 1) * m * (1 - m)) / (n - nn / n) > 0
    then m * (1 - m) / ((s - n * m * m - (k - 1) * m * (1 - m)) / (n - nn / n)) - 1 else 1000.0 end)), 6) as strength
  from {level}_s)"""


OP8 = rf"""
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
lab as (select doc_id, max(coalesce((quality = 0 or toxic = 1)::int, 0)) as bad from labels group by doc_id),
host_c as (
  select host, case when ip then '#address' else array_to_string(string_split(name, '.')[-k:], '.') end as suffix,
    case when ip then name else array_to_string(string_split(name, '.')[-k - 1:], '.') end as domain, count(bad) as n, coalesce(sum(bad), 0) as bad
  from (select *, case when array_to_string(string_split(name, '.')[-2:], '.') in ({", ".join(f"'{x}'" for x in SUFFIXES)}) then 2 else 1 end as k,
      regexp_matches(name, '^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$') as ip
    from (select *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') as name from u))
    left join lab on page_id = doc_id group by host, name, ip, k),
domain_c as (select suffix, domain, sum(n) as n, sum(bad) as bad from host_c group by all),
suffix_c as (select suffix, sum(n) as n, sum(bad) as bad from host_c group by all),
{_strength("host")}, {_strength("domain")}, {_strength("suffix")},
s1 as (select suffix, (bad + strength * m) / (n + strength) as m1 from suffix_c, suffix_k),
s2 as (select domain, (bad + strength * m1) / (n + strength) as m2 from domain_c join s1 using (suffix), domain_k),
s3 as (select host, n, bad, bad + strength * m2 as a, n - bad + strength * (1 - m2) as b from host_c join s2 using (domain), host_k),
rep as (select host, n, bad, round(a / (a + b), 6) as rate,
    round(a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 6) as bound from s3),
v as (
  select page_id, host, path, n, bad, rate, bound, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from u join rep using (host))
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
    when bound > 0.5 then 'block' else 'allow' end as verdict,
  n::bigint as host_labelled, bad::bigint as host_bad, rate, bound
from v
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP10 = rf"""
with d as (select doc_id, {_ALNUM} as ws from documents),
b as (select item_id, {_ALNUM} as ws from benchmark),
win as (
  select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') as g
  from (select item_id, ws, least(13, len(ws)) as k, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from b where len(ws) > 0)),
sizes as (select distinct k from win),
g as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') as g
  from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, sizes where len(ws) >= k)),
hit as (select doc_id, i, k, item_id from g join win using (k, g)),
cover as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids
  from (select distinct doc_id, item_id::varchar as x from hit) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join cover using (doc_id) left join items using (doc_id)
"""

OP4 = rf"""
with d as (select doc_id, {_WORDS} as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from d where len(ws) >= 35),
g as (select doc_id, i, array_to_string(ws[i:i + 34], ' ') as g from p),
rep as (select doc_id, i from g qualify count(*) over (partition by g) > 1),
cover as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(i, i + 35)) as p from rep) group by doc_id),
kept as (
  select doc_id, len(ws) as n, case when gone is null then ws else list_filter(ws, lambda w, i: not list_contains(gone, i)) end as ks
  from d left join cover using (doc_id))
select doc_id, n::bigint as n_words, (n - len(ks))::bigint as n_removed, sha256(array_to_string(ks, ' ')) as kept_sha256 from kept
"""

_LOWERED = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP5 = f"""
with recursive d as (select doc_id, {_LOWERED} as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
m as (select a as doc_id, min(b) as lo from r group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(lo, doc_id)) as component_id, doc_id <= coalesce(lo, doc_id) as kept
from d left join n using (doc_id) left join m using (doc_id)
"""

_TERMS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP11 = f"""
with d as (select row_number() over () as k, doc_id, {_TERMS} as ws from documents),
size as (select k, doc_id, len(ws)::bigint as n from d where len(ws) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as terms from size),
t as (select k, term, count(*)::bigint as tf from (select k, unnest(ws) as term from d) group by all),
i as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
w as (select term, floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * count(*) + 1)))::bigint as w from t, total group by term, docs),
s as (
  select item_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::bigint as score
  from i join w using (term) join t using (term) join size using (k), total group by all),
r as (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank
  from s join size using (k) where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 50
"""

OP12 = """
with q as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
    list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::bigint as score
  from q a join q b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, id as positive_id, score as positive_score from s
  where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (
  select anchor_id, positive_id, positive_score, id as negative_id, score as negative_score,
    row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank
  from p join s using (anchor_id)
  where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""

#: CRC-32 a byte at a time, the table of its 256 steps made by its rule.
OP13 = """
with recursive step as (
  select i as n, 0 as k, i::bigint as c from range(256) r(i)
  union all select n, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from step where k < 8),
crc as (select list(c order by n) as t from step where k = 8),
d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, '')))::bigint + 8 as size,
    ('0x' || md5(coalesce(text, ''))[:15])::bigint as g from documents),
h as (
  select r, hex(encode(text)) as x from d),
b as (
  select r, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::bigint) as bytes from h),
e as (
  select r, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8))) as text_crc32 from b, crc),
total as (select sum(size)::bigint as bytes, sum(size)::bigint // least(65536, greatest(96, sum(size)::bigint // 33554432)) as range_bytes from d),
o as (
  select *, sum(size) over w - size as start, row_number() over w as nth,
    sum(size) over (partition by g) as group_size from d window w as (order by g, doc_id nulls first, r)),
m as (
  select *, case when group_size <= least(bytes // 4800, range_bytes // 16) then 2 * min(start) over (partition by g) + group_size else 2 * start + size end as middle
  from o, total),
s as (select *, least(23, (middle * 24) // (2 * bytes))::int as shard from m)
select doc_id, size, text_crc32, 'bytes' as law, shard, (nth - min(nth) over (partition by shard))::bigint as slot, null::int as grown_shard
from s join e using (r)
"""

ORACLE = {
    "op1_quality_rules": OP1, "op4_substring_dedup": OP4, "op5_near_duplicates": OP5, "op6_warc_revisits": OP6, "op8_url_reputation": OP8,
    "op10_decontamination": OP10, "op11_ranked_search": OP11, "op12_hard_negatives": OP12, "op13_sharding": OP13,
}
