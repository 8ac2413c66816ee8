"""SQL for the queries over texts, models, graphs and sources."""

from __future__ import annotations

from revlens.schema import STANCES, TOPICS
from revlens.workload import fixtures as fx
from revlens.workload.oracle import (
    ARTICLES, DAY, EVENT_REV, LABEL_EVENTS, LABEL_STATE, PLACES, USER_URL, report_sql,
)

_BLANKS = r"[\s\v\x{85}\p{Z}]+"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANKS}|{_BLANKS}$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_BLANKS}'), lambda w: w <> '')"


LINES = (
    "ln as (select doc_id, unnest(string_split(text, chr(10))) as line,"
    " unnest(range(len(string_split(text, chr(10))))) as k from documents)"
)
DOC_REV = (
    f"{LINES}, rev as (select doc_id as article, k as rev_seq, coalesce(lag(line, 2) over w || chr(10), '')"
    " || coalesce(lag(line) over w || chr(10), '') || line as text from ln window w as (partition by doc_id order by k))"
)
CHAT_REV = (
    "rev as (select conv_id as article, turn as rev_seq, coalesce(lag(text, 2) over w || chr(10), '')"
    " || coalesce(lag(text) over w || chr(10), '') || text as text from conversations window w as (partition by conv_id order by turn))"
)
API_REV = (
    "rev as (select 'https://en.wiki.example/wiki/T_' || conv_id as article, turn - max(turn) over (partition by conv_id) as rev_seq,"
    " conv_id * 1000 + turn as revid, case when turn % 3 <> 1 then role || '_' || conv_id else 'N/A' end as \"user\","
    " '2024-01-0' || (turn % 9 + 1) || 'T00:00:00Z' as \"timestamp\", text from conversations where conv_id % 10 <> 9)"
)
PAIRS = (
    "pairs as (select *, lag(text, 1, '') over (partition by article order by rev_seq) as previous, text as current from rev)"
)


def _sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?])\s+', '\1' || chr(10), 'g')"
    marked = rf"regexp_replace({marked}, '([。！？])', '\1' || chr(10), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _side(name: str, text: str) -> str:
    listed = _sentences(text)
    return (
        f"{name} as (select article, rev_seq, s, count(*) as n, min(i) as pos from (select article, rev_seq,"
        f" unnest({listed}) as s, unnest(range(len({listed}))) as i from pairs) group by 1, 2, 3)"
    )


# Sentence edits of the pairs: full outer join of the sentence counts of both texts, then
# the k-th inserted meets the k-th removed one.
EDITS = (
    f"{_side('news', 'current')}, {_side('olds', 'previous')},"
    " net as (select coalesce(a.article, b.article) as article, coalesce(a.rev_seq, b.rev_seq) as rev_seq, coalesce(a.s, b.s) as s,"
    " coalesce(a.n, 0) - coalesce(b.n, 0) as d, a.pos as new_pos, b.pos as old_pos from news a full outer join olds b"
    " on a.article = b.article and a.rev_seq = b.rev_seq and a.s = b.s),"
    " cp as (select article, rev_seq, s, d > 0 as ins, case when d > 0 then new_pos else old_pos end as pos,"
    " unnest(range(abs(d)::bigint)) as c from net where d <> 0),"
    " rk as (select *, row_number() over (partition by article, rev_seq, ins order by pos, s, c) as k from cp),"
    " met as (select article, rev_seq, k, max(case when ins then s end) as n, max(case when not ins then s end) as o from rk group by 1, 2, 3),"
    f" sim as (select *, n is not null and o is not null and len(list_intersect({_words('n')}, {_words('o')})) * 2"
    f" >= len(list_distinct(list_concat({_words('n')}, {_words('o')}))) as same from met),"
    " ed as (select article, rev_seq, k, 0 as part, 'Text:Sentence:Change' as change_type, n as diff_before, n as diff_after,"
    " 'Changed Sentence' as change_desc from sim where same"
    " union all select article, rev_seq, k, 0, 'Text:Sentence:Insert', '', n, 'Inserted Sentence' from sim where not same and n is not null"
    " union all select article, rev_seq, k, 1, 'Text:Sentence:Remove', o, '', 'Removed Sentence' from sim where not same and o is not null),"
    " edits as (select article, rev_seq, 2147483647 + row_number() over (partition by article, rev_seq order by k, part) as change_seq,"
    " change_type, diff_before, diff_after, change_desc from ed)"
)

_HINT = "case when diff_before <> '' and instr(previous, diff_before) > 0 then instr(previous, diff_before) - 1 end"
CONTEXT = (
    f"c0 as (select e.*, p.current, {_HINT} as hint, length(diff_after) as size, string_split(current, diff_after) as parts"
    " from edits e join pairs p using (article, rev_seq)),"
    " c1 as (select *, case when diff_after <> '' and len(parts) > 1 then list_transform(range(1, len(parts)),"
    " lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p)))::bigint + (i - 1) * size) else [] end as spots from c0),"
    " c2 as (select *, case when len(spots) = 0 then null when hint is null then spots[1]"
    " else list_sort(list_transform(spots, lambda p: {'d': abs(p - hint), 'p': p}))[1].p end as best from c1),"
    " ctx as (select *, case when best is not null then substr(current, greatest(best - size, 0) + 1,"
    " least(length(current), best + 2 * size) - greatest(best - size, 0))"
    f" when {_stripped('diff_after')} <> '' then diff_after else diff_before end as content from c2)"
)


def _score(prefix: str, text: str) -> str:
    digest = fx.DUCK_HASH.format(f"('{prefix}' || {text})")
    return f"case when trim({text}) = '' then 0.0 else {digest} end"


def _saved(source: str) -> str:
    """Walk the changes of each article in order, carrying the texts saved so far."""
    return (
        f"gated as (select * from (select *, {_score('s', 'clean_before')} as sb, {_score('s', 'clean_after')} as sa from {source})"
        " where abs(sa - sb) > 0.1 or sa > 0.3),"
        f" numbered as materialized (select *, md5(case when {_stripped('diff_after')} <> '' then diff_after else diff_before end) as t,"
        " row_number() over (partition by article order by rev_seq desc, change_seq) as rn from gated),"
        " walk as (select article, rn, true as saved, [md5(diff_before), md5(diff_after)] as seen from numbered where rn = 1"
        " union all select n.article, n.rn, not list_contains(w.seen, n.t), case when list_contains(w.seen, n.t) then w.seen"
        " else list_concat(w.seen, [md5(n.diff_before), md5(n.diff_after)]) end"
        " from walk w join numbered n on n.article = w.article and n.rn = w.rn + 1),"
        " saved as (select n.* from numbered n join (select article, rn from walk where saved) w using (article, rn))"
    )


def _plain_open(x: str) -> str:
    """The clean-up steps for texts without templates, before the last trim."""
    t = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    t = f"regexp_replace({t}, '(?is)<ref[^>/]*/>', '', 'g')"
    t = f"regexp_replace({t}, '(?is)<ref[^>]*>.*?</ref>', '', 'g')"
    t = rf"regexp_replace({t}, '\[\[[^\[\]|]*\|([^\[\]]*)\]\]', '\1', 'g')"
    t = rf"regexp_replace({t}, '\[\[([^\[\]|]*)\]\]', '\1', 'g')"
    t = rf"regexp_replace({t}, '\[[a-z]+://[^\s\]]+\s+([^\]]*)\]', '\1', 'g')"
    t = f"regexp_replace({t}, chr(39) || '{{2,5}}', '', 'g')"
    return f"regexp_replace({t}, '<[^<>]*>', '', 'g')"


def _plain(x: str) -> str:
    return _stripped(_plain_open(x))


_WIKI = (
    f"{LINES}, wl as (select doc_id as article, k as rev_seq, line, doc_id % 5 as kind, k::varchar as now, (k - 1)::varchar as old from ln)"
)


def _node(k: int, seq: int, kind: str, name: str, field: str, shape: str) -> str:
    """Expected edit of the wiki fixture; ``#`` stands for the line number."""
    before, after = shape.replace("#", "' || old || '"), shape.replace("#", "' || now || '")
    named = name.replace("#", "' || old || '")
    return (
        f"select article, rev_seq, {seq} as change_seq, 'Node:{kind}:{field}' as change_type, '{before}' as diff_before,"
        f" '{after}' as diff_after, '{kind} {named} changed {field}' as change_desc from wl where kind = {k} and rev_seq > 0"
    )


def _filled(source: str) -> str:
    def unit(axis: str, low: int) -> str:
        return f"('0x' || substr(md5(url || '|0|{axis}'), 1, 8))::bigint % 50001 + {low}"

    def degrees(u: str) -> str:
        return f"(({u}) // 100000)::varchar || '.' || lpad((({u}) % 100000)::varchar, 5, '0')"

    drawn = f"'POINT(' || {degrees(unit('lon', 12090000))} || ' ' || {degrees(unit('lat', 2450000))} || ')'"
    return f"select url, coalesce(upper(coord), {drawn}) as coord, coord is null as coord_is_synthetic from {source}"


def text_queries() -> dict[str, str]:
    out = {}
    scheme = "regexp_extract(url, '^([a-z]+)://', 1)"
    host = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
    out["url_parts"] = (
        f"select page_id, url_decode(regexp_extract(url, '([^/]*)$', 1)) as title, {host} as domain, split_part({host}, '.', 1) as lang,"
        f" {scheme} || '://' || {host} || '/w/api.php' as api_url from pages"
    )
    v4, v6 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", r"^\[?[0-9a-fA-F:]+(:[0-9a-fA-F]{1,4}){1,4}\]?$"
    out["user_is_ip"] = (
        f"with u as (select event_id, {fx.USERS.format('varchar')} as \"user\" from events) select event_id, \"user\","
        f" (regexp_matches(\"user\", '{v4}') or regexp_matches(\"user\", '{v6}'))::integer as is_ip from u"
    )
    out["coord_parse"] = (
        f"with {ARTICLES}, {PLACES} select url, upper(nullif(coord, '')) as coord, lon, lat from articles join places using (url)"
    )
    out["coord_fill"] = f"with {ARTICLES} {_filled('articles')}"
    out["revision_pairs"] = f"with {DOC_REV}, {PAIRS} select article, rev_seq, current, previous from pairs"
    out["sentence_edits"] = f"with {DOC_REV}, {PAIRS}, {EDITS} select * from edits"
    out["node_edits"] = f"with {_WIKI} " + " union all ".join(
        [
            _node(0, 0, "Template", "Infobox", "parameter", "[[Main|#]]"),
            _node(0, 1, "Template", "Infobox", "parameter", "#"),
            _node(0, 2, "Wikilink", "Main", "text", "#"),
            _node(1, 0, "Wikilink", "City", "text", "town #"),
            _node(2, 0, "Reference", "s", "content", "src #"),
            _node(3, 0, "Template", "Inner", "parameter", "#"),
            _node(3, 1, "Template", "Outer", "parameter", "#"),
            _node(4, 0, "Wikilink", "Only #", "title", "Only #"),
        ]
    )
    out["context_window"] = (
        f"with {CHAT_REV}, {PAIRS}, {EDITS}, {CONTEXT} select article, rev_seq, change_seq, change_type, diff_before, diff_after,"
        " change_desc, content from ctx"
    )
    out["changed_line"] = (
        f"with {EVENT_REV} select id, case when diff_after <> '' then nullif(list_position(list_transform(string_split(content, chr(10)),"
        " lambda x: contains(x, diff_after)), true), 0) - 1 end::integer as line from rev"
    )
    out["highlighted"] = (
        f"with {EVENT_REV} select id, case when diff_after = '' then content else replace(content, diff_after, '[+' || diff_after || '+]') end"
        " as marked from rev"
    )
    town, only = f"'town ' || now || ' ' || ({_plain_open('line')})", f"({_plain_open('line')}) || ' Only ' || now"
    out["plain_text"] = (
        f"with {_WIKI} select article, rev_seq, case kind when 1 then {_stripped(town)}"
        f" when 4 then {_stripped(only)} else {_plain('line')} end as plain from wl"
    )
    out["page_plain_text"] = f"select page_id, {_plain('html')} as plain from pages"
    digests = ", ".join(
        f"{fx.DUCK_HASH.format(f'({chr(39)}{x}{side}{chr(39)} || id)')} as {x}{side[0]}" for x in "pq" for side in ("before", "after")
    )
    probs = f"select id, diff_before, diff_after, {digests}, original_revid % 2 as odd from rev"

    def label(p: str, q: str) -> str:
        return (
            f"case when {p} > 0.5 and {p} >= {q} then case odd when 0 then 'Slightly Biased' else 'LABEL_1' end"
            f" when {q} > 0.5 and {q} > {p} then case odd when 0 then 'Highly Biased' else 'LABEL_2' end"
            " else case odd when 0 then 'Neutral' else 'LABEL_0' end end"
        )

    scored = (
        f"with {EVENT_REV}, p as ({probs}), sc as (select id,"
        " case when trim(diff_before) = '' then 0.0 else pb * 0.5 + qb end as sb,"
        f" case when trim(diff_before) = '' then 'Neutral' else {label('pb', 'qb')} end as lb,"
        " case when trim(diff_after) = '' then 0.0 else pa * 0.5 + qa end as sa,"
        f" case when trim(diff_after) = '' then 'Neutral' else {label('pa', 'qa')} end as la from p)"
    )
    out["bias_scored"] = (
        f"{scored} select id, round(sb, 7) as bias_score_before, lb as bias_label_before, round(sa, 7) as bias_score_after,"
        " la as bias_label_after from sc"
    )
    out["material_changes"] = f"{scored} select id, round(sa - sb, 7) as bias_delta from sc where abs(sa - sb) > 0.1 or sa > 0.3"
    out["delta_direction"] = (
        f"with {EVENT_REV} select id, case when bias_delta > 0.1 then 'up' when bias_delta < -0.1 then 'down' else 'flat' end as direction from rev"
    )
    numbered = "row_number() over (partition by article, rev_seq order by change_seq)"
    out["saved_changes"] = (
        f"with recursive {DOC_REV}, {PAIRS}, {EDITS}, src as (select *, diff_before as clean_before, diff_after as clean_after from edits),"
        f" {_saved('src')} select printf('%d-%04d', article * 1000000 + rev_seq, {numbered}) as id, article, rev_seq, change_type,"
        " diff_before, diff_after from saved"
    )
    level = "case when {0} > 0.5 then 'Highly Biased' else 'Neutral' end"

    def spread(prefix: str, names) -> str:
        return fx.pick(f"(('0x' || substr(md5('{prefix}' || content), 1, 8))::bigint % {len(names)})", names)

    out["enriched_changes"] = (
        f"with recursive {API_REV}, {PAIRS}, {EDITS}, {CONTEXT},"
        f" src as (select * from (select *, {_plain('diff_before')} as clean_before, {_plain('diff_after')} as clean_after from ctx)"
        f" where clean_before <> '' or clean_after <> ''), {_saved('src')}"
        f" select printf('%d-%04d', r.revid, {numbered}) as id, r.revid as original_revid, article as article_url, r.\"user\", r.\"timestamp\","
        " diff_before, diff_after, change_type, change_desc, round(sb, 6) as bias_score_before, round(sa, 6) as bias_score_after,"
        f" round(sa - sb, 6) as bias_delta, {level.format('sb')} as bias_label_before, {level.format('sa')} as bias_label_after,"
        f" {spread('t', TOPICS)} as ai_topic, {spread('c', STANCES)} as ai_political_stance, 0 as is_ip, null::varchar as manual_bias,"
        " null::varchar as manual_topic, content from saved join rev r using (article, rev_seq)"
    )
    out["api_revisions"] = f"with {API_REV} select * from rev"
    return out


_BAYES = (
    "ld as (select cast(quality as varchar) as label, doc_id, text from documents join labels using (doc_id)),"
    f" tk as (select label, token, count(*) as n from (select label, unnest({_words('lower(text)')}) as token from ld) group by 1, 2),"
    " vc as (select count(distinct token) as v from tk),"
    " cl as (select label, count(*) as docs, (select sum(n) from tk where tk.label = ld.label) as toks, (select count(*) from ld) as all_docs"
    " from ld group by label)"
)
_BAYES_SCORE = (
    f"{_BAYES}, dt as (select doc_id, token, count(*) as n from (select doc_id, unnest({_words('lower(text)')}) as token from documents) group by 1, 2),"
    " kn as (select dt.* from dt join (select distinct token from tk) using (token)),"
    " ll as (select k.doc_id, c.label, sum(k.n * ln((coalesce(t.n, 0) + 1) / (c.toks + v.v))) as s from kn k cross join cl c cross join vc v"
    " left join tk t on t.token = k.token and t.label = c.label group by 1, 2),"
    " sc as (select d.doc_id, c.label, ln(c.docs / c.all_docs) + coalesce(ll.s, 0.0) as s from documents d cross join cl c"
    " left join ll on ll.doc_id = d.doc_id and ll.label = c.label)"
)
_REACH = (
    "loc as (select 'C' || c_custkey as child, 'N' || c_nationkey as parent from customer where c_custkey % 3 <> 1"
    " union select 'N' || n_nationkey, 'R' || n_regionkey from nation"
    " union select 'R' || n_regionkey, 'N' || min(n_nationkey) from nation group by n_regionkey),"
    " reach as (select 'R' || r_regionkey as region, 'R' || r_regionkey as node from region where r_regionkey in (1, 2)"
    " union select region, child from reach join loc on parent = node)"
)
_REGION = (
    f"with recursive {_REACH}, nd as (select distinct node from reach),"
    " it as (select c_custkey as k, 'Point(' || (c_custkey % 180) || ' 24.5)' as coord from customer"
    " where c_custkey % 3 = 0 and 'C' || c_custkey in (select node from nd)"
    " union select c_custkey, null from customer where c_custkey % 3 = 1 and 'N' || c_nationkey in (select node from nd)),"
    " art as (select *, case when k % 2 = 0 then 'https://zh.wiki.example/wiki/C_' || k when k % 5 <> 0 then 'https://en.wiki.example/wiki/C_' || k end"
    " as article from it)"
)
_BINDINGS = (
    "b as (select 'https://en.wiki.example/wiki/C_' || (c_custkey % 1000) as url,"
    " case when c_custkey % 3 <> 0 then 'Point(' || (c_custkey % 180) || ' ' || (c_custkey % 90) || ')' end as coord from customer)"
)


def model_queries() -> dict[str, str]:
    out = {}
    out["nb_train"] = f"with {_BAYES} select token, label, round(ln(n + 1), 6) as weight from tk"
    out["nb_score"] = (
        f"with {_BAYES_SCORE} select doc_id, round(max(case when label = '1' then s end) - max(case when label = '0' then s end), 6) as log_odds"
        " from sc group by doc_id"
    )
    best = "bst as (select doc_id, max_by(label, s) as ai from sc group by 1)"
    cells = f"{best}, cells as (select ld.label as human, ai, count(*)::bigint as n from ld join bst using (doc_id) group by 1, 2)"
    out["quality_report"] = report_sql(_BAYES_SCORE, cells)
    out["zero_shot_topic"] = (
        "with xs as (select vec_id, label, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings),"
        " cen as (select label, i, avg(x) as x from xs group by 1, 2),"
        " nrm as (select label, sqrt(sum(x * x)) as d from cen group by 1),"
        " sim as (select xs.vec_id, xs.label as human, cen.label as ai, sum(xs.x * cen.x) / any_value(nrm.d) as s from xs join cen using (i)"
        " join nrm on nrm.label = cen.label group by 1, 2, 3),"
        " top as (select vec_id, human, ai, row_number() over (partition by vec_id order by s desc, ai) as rn from sim)"
        " select human, ai, count(*)::bigint as n from top where rn = 1 group by 1, 2"
    )
    out["region_closure"] = f"with recursive {_REACH} select * from reach"
    out["region_articles"] = (
        f"{_REGION} select 'C' || k as item, case when k % 4 = 0 then 'zh ' || k when k % 3 <> 2 then 'en ' || k else 'C' || k end as label,"
        " coord, article from art where article is not null"
    )
    out["discovered_articles"] = (
        f"{_REGION}, u as (select article as url, min(coord) as coord from art where article is not null group by 1) {_filled('u')}"
    )
    out["articles_refresh"] = f"with {_BINDINGS}, u as (select url, min(coord) as coord from b group by 1) {_filled('u')}"
    out["ingest_totals"] = f"with {_BINDINGS} select count(*)::bigint as bindings, count(distinct url)::bigint as urls from b"
    out["articles_upsert"] = (
        f"with {ARTICLES}, mv as (select {USER_URL} || case when user_id % 3 = 0 then '_new' else '' end as url, 'POINT(' || max(event_id) || ' 1)' as coord from events group by 1)"
        " select * from mv union all select url, coord from articles where url not in (select url from mv)"
    )
    out["first_articles"] = f"with {ARTICLES} select url, coord from articles order by url limit 50"

    def listed(names, column: str) -> str:
        rows = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
        return (
            f"with {EVENT_REV}, l(pos, label) as (values {rows}) select l.pos::integer as pos, l.label, count(rev.id)::bigint as n"
            f" from l left join rev on rev.{column} = l.label group by 1, 2"
        )

    out["topic_categories"] = listed(("view", "click", "purchase", "refund", "error"), "ai_topic")
    out["stance_categories"] = listed(STANCES, "ai_political_stance")
    return out


def stream_queries() -> dict[str, str]:
    """End states of the streams over the whole tables."""
    out = {}
    out["stream_daily_topics"] = (
        f"with {EVENT_REV} select cast({DAY} as varchar) as date, ai_topic as label, count(*)::bigint as n from rev"
        " where ai_topic <> '' group by 1, 2"
    )
    out["stream_histogram"] = (
        f"with {EVENT_REV} select least(greatest(trunc(bias_score_after * 5)::integer, 0), 4) as bin, count(*)::bigint as n from rev"
        " where bias_score_after is not null group by 1"
    )
    out["stream_label_state"] = f"with {LABEL_EVENTS}, {LABEL_STATE} select * from state"
    out["stream_first_seen"] = "select distinct user_id, event_type from events"
    out["stream_daily_window"] = (
        "select cast(cast(ts as date) as varchar) as date, event_type as label, count(*)::bigint as n from events group by cast(ts as date), event_type"
        " having cast(ts as date) + interval 1 day <= (select max(ts) from events) - interval 1 hour"
    )
    out["stream_ingest"] = (
        f"with recursive {EVENT_REV}, g as (select * from rev where abs(bias_score_after - bias_score_before) > 0.1 or bias_score_after > 0.3),"
        " numbered as materialized (select article_url as article, original_revid, diff_before, diff_after,"
        " case when trim(diff_after) <> '' then diff_after else diff_before end as t,"
        " row_number() over (partition by article_url order by original_revid) as rn from g),"
        " walk as (select article, rn, true as saved, [diff_before, diff_after] as seen from numbered where rn = 1"
        " union all select n.article, n.rn, not list_contains(w.seen, n.t), case when list_contains(w.seen, n.t) then w.seen"
        " else list_concat(w.seen, [n.diff_before, n.diff_after]) end from walk w join numbered n on n.article = w.article and n.rn = w.rn + 1)"
        " select original_revid || '-0001' as id, article, diff_before, diff_after from numbered join (select article, rn from walk where saved)"
        " using (article, rn)"
    )
    out["change_word_diff"] = (
        f"with {EVENT_REV}, w as (select id, diff_before, diff_after, event_type, split_part(coalesce(nullif(diff_before, ''), diff_after), ' ', 3) as k"
        " from rev join events on events.event_id = rev.original_revid)"
        " select id, case when diff_before = '' then 'i:new i:' || event_type || ' i:' || k"
        " when trim(diff_after) = '' then 'd:old d:' || event_type || ' d:' || k"
        " else 'd:old i:new e:' || event_type || ' e:' || k end as script from w"
    )
    return out
