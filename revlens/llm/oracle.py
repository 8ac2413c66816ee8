"""SQL for the queries of this folder that SQL can express, for DuckDB."""

from __future__ import annotations

from revlens.llm.licenses import NOTICES, SPELLINGS
from revlens.llm.urls import SUSPECT

_WORDS = r"coalesce(len(regexp_extract_all({}, '[^\x20\x09-\x0D]+')), 0)"

URL_FILTER = r"""
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as n
  from pages),
rules(h, b, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit as (
  select n, arg_max(h || b, length(h || b) * 1000 + length(h)) as rule, arg_max(v, length(h || b) * 1000 + length(h)) as v
  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, b) group by n),
bad as (select distinct host as h from p where list_has_any(string_split_regex(host, '[.\-]'), [{words}])),
hit as (select n, arg_max(h || '/', length(h)) as listed from p join bad on (host = h or ends_with(host, '.' || h)) and starts_with(path, '/') group by n)
select page_id, host, path, rule, case when rule is null then listed end as listed,
  coalesce(v, case when listed is not null then 'block' else 'allow' end) as verdict
from p left join fit using (n) left join hit using (n)
""".replace("{words}", ", ".join(f"'{w}'" for w in SUSPECT))

#: With {docs}, the rows to mix: (source, size, shares of each row) as far as op2 and the last stage share them.
MIX = r"""
with d as (
  select doc_id, source, {words}::bigint as size,
    ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::varchar, ''), coalesce(text, ''))), 1, 15))::bigint as digest
  from {docs}),
s as (
  select source, sum(size)::bigint as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w
  from d group by source),
o as (
  select *, sum(source_size) over () as total,
    sum(3 * source_size) over (order by 3 * source_size / w, source nulls last rows unbounded preceding) - 3 * source_size as used,
    sum(w) over (order by 3 * source_size / w desc, source desc nulls first rows unbounded preceding) as open
  from s),
h as (select max((total - used) / open) filter (w * ((total - used) / open) < 3 * source_size) as share from o),
t as (select source, source_size, least((3 * source_size)::double, coalesce(w * share, 3 * source_size)) as target from s, h),
g as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as times from t),
x as (select source, digest, sum(size) as words from d where size > 0 group by source, digest),
y as (select *, sum(words) over (partition by source order by digest) as upto from x),
e as (
  select y.source, digest + (2 * (target - times * source_size - upto + words) > words)::bigint as threshold
  from y join g on y.source is not distinct from g.source
  where upto > target - times * source_size and upto - words <= target - times * source_size)
select doc_id, d.source, size, source_size, target, (times + (digest < coalesce(threshold, 0))::bigint) * size as taken
from d join g on d.source is not distinct from g.source left join e on e.source is not distinct from d.source
""".replace("{words}", _WORDS.format("text"))

WARC = r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
m as (select h, max(page_id) as most from p group by h)
select page_id, strlen(html) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, ((i // 4) * 5 + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), 'string_agg', '') as payload_digest,
  case when page_id is distinct from most and most is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from most then most end as refers_to
from p join m using (h)
"""


def _canonical(text: str) -> str:
    out = rf"lower(regexp_replace(coalesce({text}, ''), '(?im)^[ \t]*(?:[#*/;-]+[ \t]*)?(?:copyright\b|\(c\)|©)[^\n]*$', '', 'g'))"
    out = rf"' ' || regexp_replace(regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', ' ' || chr(10) || ' ', 'g') || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    out = rf"regexp_replace({out}, ' v (\d)', ' v\1', 'g')"
    return rf"regexp_replace(regexp_replace({out}, ' *\n *', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


LICENCES = r"""
with k as (select licence, regexp_replace({notice}, '[ \n]+', ' ', 'g') as canon from (values {notices}) as v(licence, notice)),
marks as (select distinct licence, canon from k where canon <> ''),
b as (select doc_id, {body} as body from documents),
u as (
  select doc_id, 0 as scope, body as unit from b
  union all select doc_id, 1, unnest(string_split_regex(body, '\n{2,}')) from b
  union all select doc_id, 2, unnest(string_split_regex(body, '\n+')) from b),
c as (
  select doc_id, licence, scope, count(*) as places from u join marks on regexp_replace(unit, '[ \n]+', ' ', 'g') = canon
  group by doc_id, licence, scope)
select doc_id, licence, ['text', 'paragraph', 'line'][min(scope) + 1] as scope, arg_min(places, scope) as places from c group by doc_id, licence
"""
LICENCES = LICENCES.replace("{notices}", ", ".join(f"('{a}', '{b}')" for a, b in NOTICES)).replace("{notice}", _canonical("notice")).replace("{body}", _canonical("text"))


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": URL_FILTER, "op2_mix_shares": MIX.replace("{docs}", "documents"), "op7_licence_scan": LICENCES, "op9_warc": WARC}
