"""The same results in plain SQL, written without looking at the operators' plans."""

from __future__ import annotations

from revlens.schema import STANCES
from revlens.workload import fixtures as fx

_COLS = fx.event_columns(fx.DUCK_HASH, fx.DUCK_ISO, "varchar")
USER_URL = fx.USER_URL.format(text="varchar")
EVENT_REV = (
    "rev as (select " + ", ".join(f'{e} as "{c}"' for c, e in _COLS.items())
    + f" from (select *, {fx.K_DUCK} as k from events))"
)
_LON = f"cast(120 + {fx.DUCK_HASH.format('(' + USER_URL + ')')} as varchar)"
_LAT = f"cast(24 + {fx.DUCK_HASH.format(chr(40) + repr('y') + ' || ' + USER_URL + ')')} as varchar)"
ARTICLES = (
    f"articles as (select {USER_URL} as url, {fx.COORD_CASE.format(lon=_LON, lat=_LAT)} as coord"
    " from (select distinct user_id from events where user_id % 29 <> 0))"
)
PLACES = (
    "places as (select url, case when ok then try_cast(parts[1] as double) end as lon,"
    " case when ok then try_cast(parts[2] as double) end as lat from ("
    "select url, parts, upper(coord) like 'POINT%' and len(parts) >= 2 as ok from ("
    "select url, coord, string_split(trim(replace(replace(replace(upper(coord), 'POINT', ''), '(', ''), ')', '')), ' ') as parts"
    " from articles)))"
)
LINE_REV = (
    f"rev as (select {fx.DUCK_ISO.format('l_shipdate')} as \"timestamp\", l_discount as bias_score_after from lineitem)"
)
DAY = 'try_cast(case when regexp_matches("timestamp", \'^\\d{4}-\\d{2}-\\d{2}\') then substr("timestamp", 1, 10) end as date)'
LABEL_EVENTS = (
    f"ev as (select cast(user_id as varchar) as id, {fx.pick('k % 6', STANCES)} as stance, event_type as topic,"
    f" event_id as event_seq, case when {fx.CLEARS} then 'clear' when event_id % 40 = 0 then 'skip' else 'label' end as kind"
    f" from (select *, {fx.K_DUCK} as k from events))"
)

# Trims the blanks that occur in the labels of the fixture.
_PAIR = {"topic": ("manual_topic", "ai_topic"), "stance": ("manual_bias", "ai_political_stance")}


def _cells(kind: str) -> str:
    human, ai = _PAIR[kind]
    return (
        f"cells as (select trim({human}) as human, trim({ai}) as ai, count(*)::bigint as n from rev"
        f" where (manual_topic is not null or manual_bias is not null) and {human} is not null and {human} <> ''"
        f" and {ai} is not null and {ai} <> '' group by 1, 2)"
    )


_UNIVERSE = "uni as (select human as label from cells union select ai from cells)"
_TOTALS = (
    "tot as (select u.label,"
    " coalesce((select sum(n) from cells where human = u.label), 0)::bigint as human_n,"
    " coalesce((select sum(n) from cells where ai = u.label), 0)::bigint as ai_n,"
    " coalesce((select sum(n) from cells where ai = u.label and human = u.label), 0)::bigint as hit"
    " from uni u)"
)
_METRICS = (
    "met as (select label, case when ai_n > 0 then hit / ai_n else 0.0 end::double as p,"
    " case when human_n > 0 then hit / human_n else 0.0 end::double as r, human_n as support, hit from tot),"
    " rep as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as f1 from met)"
)


def _confusion(base: str, cells: str) -> str:
    return (
        f"with {base}, {cells}, {_UNIVERSE} select h.label as human, a.label as ai, coalesce(c.n, 0)::bigint as n"
        " from uni h cross join uni a left join cells c on c.human = h.label and c.ai = a.label"
    )


def report_sql(base: str, cells: str) -> str:
    return (
        f"with {base}, {cells}, {_UNIVERSE}, {_TOTALS}, {_METRICS}"
        ' select label, round(p, 6) as "precision", round(r, 6) as recall, round(f1, 6) as f1, support from rep'
    )


def _summary(base: str, cells: str) -> str:
    return (
        f"with {base}, {cells}, {_UNIVERSE}, {_TOTALS}, {_METRICS}"
        " select round(sum(hit) / sum(support), 6) as accuracy, round(avg(p), 6) as macro_precision,"
        " round(avg(r), 6) as macro_recall, round(avg(f1), 6) as macro_f1,"
        " round(sum(f1 * support) / sum(support), 6) as weighted_f1, sum(support)::bigint as total from rep"
    )


def _distribution(base: str, cells: str) -> str:
    return (
        f"with {base}, {cells}, {_UNIVERSE}, {_TOTALS}"
        " select label, human_n as human_count, ai_n as ai_count, ai_n - human_n as diff from tot"
    )


def _mode(name: str, label: str, rows: str) -> str:
    return (
        f"{name} as (select article_url, label from (select *, row_number() over (partition by article_url order by n desc, seen, label) as rn from ("
        f"select article_url, {label} as label, count(*) as n, min(id) as seen from {rows} where {label} is not null group by 1, 2)) where rn = 1)"
    )


# Scores are never negative: the mean in whole millionths, rounded half up to four places.
_MEAN = (
    "((2 * sum(round(bias_score_after * 1000000)::bigint) + 100 * count(bias_score_after))"
    " // (200 * nullif(count(bias_score_after), 0)))::double / 10000"
)

_AGREEMENT = (
    f"with {EVENT_REV}, {ARTICLES}, {PLACES},"
    " lab as (select *, case when tb then trim(manual_topic) end as ht, case when tb then trim(ai_topic) end as mt,"
    " case when sb then trim(manual_bias) end as hs, case when sb then trim(ai_political_stance) end as ast from ("
    " select *, manual_topic is not null and manual_topic <> '' and ai_topic is not null and ai_topic <> '' as tb,"
    " manual_bias is not null and manual_bias <> '' and ai_political_stance is not null and ai_political_stance <> '' as sb"
    " from rev where manual_topic is not null or manual_bias is not null)),"
    + ", ".join(_mode(n, c, "lab") for n, c in (("m1", "ht"), ("m2", "mt"), ("m3", "hs"), ("m4", "ast")))
    + ", g as (select article_url, count(*) filter (ht = mt) as th, count(ht) as tn, count(*) filter (hs = ast) as sh,"
    f" count(hs) as sn, {_MEAN} as b from lab group by 1),"
    " agree as (select g.article_url, lon, lat,"
    " round(case when tn > 0 then th / tn else 0.0 end, 4) as topic_agreement, tn::bigint as topic_samples,"
    " round(case when sn > 0 then sh / sn else 0.0 end, 4) as stance_agreement, sn::bigint as stance_samples,"
    " coalesce(m1.label, 'N/A') as dominant_human_topic, coalesce(m2.label, 'N/A') as dominant_ai_topic,"
    " coalesce(m3.label, 'N/A') as dominant_human_stance, coalesce(m4.label, 'N/A') as dominant_ai_stance,"
    " coalesce(b, 0.0) as avg_bias_score"
    " from g left join places on places.url = g.article_url left join m1 using (article_url) left join m2 using (article_url)"
    " left join m3 using (article_url) left join m4 using (article_url))"
)

_OPEN = "manual_topic is null and manual_bias is null"
_SURVEY = (
    f"with {EVENT_REV}, {ARTICLES}, {PLACES}, op as (select *, nullif(ai_topic, '') as t, nullif(ai_political_stance, '') as s"
    f" from rev where {_OPEN}), {_mode('m1', 't', 'op')}, {_mode('m2', 's', 'op')},"
    " surv as (select g.article_url, lon, lat, revisions_analyzed, coalesce(m1.label, 'N/A') as dominant_ai_topic,"
    " coalesce(m2.label, 'N/A') as dominant_ai_stance, coalesce(b, 0.0) as avg_ai_bias from"
    f" (select article_url, count(*)::bigint as revisions_analyzed, {_MEAN} as b from op group by 1) g"
    " left join places on places.url = g.article_url left join m1 using (article_url) left join m2 using (article_url))"
)


def _counts(column: str, where: str, tail: str = "") -> str:
    return (
        f"with {EVENT_REV} select {column} as label, count(*)::bigint as n from rev"
        f" where {column} is not null and {column} <> '' and {where} group by 1 {tail}"
    )


_TOP = "order by n desc, label limit 10"


def _top(column: str) -> str:
    return (
        f"select label, case when length(label) > 10 then substr(label, 1, 10) || '..' else label end as chart_label, n"
        f" from ({_counts(column, 'true', _TOP)})"
    )


def _queue(order: str, where: str = "true") -> str:
    names = [c for c in _COLS if c not in ("manual_bias", "manual_topic")]
    listed = ", ".join(f'"{c}"' for c in names)
    shown = ", ".join('is_ip = 1 as is_ip' if c == "is_ip" else f'"{c}"' for c in names)
    filled = " and ".join(f'"{c}" is not null' for c in names)
    return (
        f"with {EVENT_REV} select {shown} from (select {listed} from rev where manual_bias is null and {where}"
        f" order by {order}, id limit 100) where {filled}"
    )


def _grid(column: str) -> str:
    return (
        f"with {EVENT_REV}, days as (select distinct {DAY} as d from rev where {DAY} is not null),"
        f" labs as (select distinct {column} as label from rev where {column} is not null and {column} <> ''),"
        f" c as (select {DAY} as d, {column} as label, count(*) as n from rev group by 1, 2)"
        " select cast(days.d as varchar) as date, labs.label, coalesce(c.n, 0)::bigint as n"
        " from days cross join labs left join c on c.d = days.d and c.label = labs.label"
    )


_MONTHS = (
    'm as (select substr("timestamp", 1, 7) as month, count(*)::bigint as revs, avg(bias_score_after) as s'
    ' from rev where length("timestamp") >= 7 group by 1)'
)


def _outliers(base: str) -> str:
    return (
        f"with {base}, {_MONTHS}, st as (select avg(revs) ra, stddev_pop(revs) rs, avg(s) sa, stddev_pop(s) ss from m),"
        " z as (select month, 'Activity' as k, revs::double as value, ra as mean, (revs - ra) / nullif(rs, 0) as z from m, st"
        " union all select month, 'Bias Score', s, sa, (s - sa) / nullif(ss, 0) from m, st)"
        " select month, case when z > 1.5 then 'High ' else 'Low ' end || k as reason, round(value, 6) as value,"
        " round(mean, 6) as mean, round(z, 6) as z from z where abs(z) > 1.5"
    )


_DAILY = f"select {DAY} as d, avg(bias_score_after) as s from rev group by 1"

LABEL_STATE = (
    "clr as (select coalesce(max(event_seq), -1) as c from ev where kind = 'clear'),"
    " state as (select id, case when kind = 'skip' then 'SKIPPED' else stance end as manual_bias,"
    " case when kind = 'skip' then 'SKIPPED' else topic end as manual_topic, event_seq from ("
    " select *, row_number() over (partition by id order by event_seq desc) as rn from ev, clr"
    " where kind <> 'clear' and event_seq > c) where rn = 1)"
)


def aggregate_queries() -> dict[str, str]:
    out = {}
    for kind in ("topic", "stance"):
        cells = _cells(kind)
        out[f"{kind}_confusion"] = _confusion(EVENT_REV, cells)
        out[f"{kind}_distribution_bias"] = _distribution(EVENT_REV, cells)
        out[f"{kind}_report"] = report_sql(EVENT_REV, cells)
        out[f"{kind}_report_summary"] = _summary(EVENT_REV, cells)
    out["article_agreement"] = f"{_AGREEMENT} select * from agree"
    out["single_article_agreement"] = f"{_AGREEMENT} select * from agree where article_url = (select min(article_url) from lab)"
    out["single_article_survey"] = f"{_SURVEY} select * from surv where article_url = (select min(article_url) from op)"
    out["survey_totals"] = (
        f"with {EVENT_REV} select count(*)::bigint as \"rows\", round(avg(bias_score_after), 6) as avg_score from rev where {_OPEN}"
    )
    out["survey_topics"] = _counts("ai_topic", _OPEN, _TOP)
    out["survey_stances"] = _counts("ai_political_stance", _OPEN)
    out["survey_articles"] = f"{_SURVEY} select * from surv"
    out["agreement_geojson"] = (
        f"{_AGREEMENT} select article_url as article, lon, lat, topic_agreement, topic_samples, stance_agreement, stance_samples,"
        " dominant_human_topic, dominant_ai_topic, dominant_human_stance, dominant_ai_stance, avg_bias_score"
        " from agree where lon is not null and lat is not null"
    )
    out["survey_geojson"] = (
        f"{_SURVEY} select article_url as article, lon, lat, revisions_analyzed, dominant_ai_topic, dominant_ai_stance, avg_ai_bias"
        " from surv where lon is not null and lat is not null"
    )
    out["facet_desc"] = (
        f"with {EVENT_REV} select label, n from (select change_desc as label, count(*)::bigint as n from rev"
        " where manual_bias is null group by 1 order by n desc, label nulls first limit 50) where label is not null and label <> ''"
    )
    out["facet_topic"] = _counts("ai_topic", "manual_bias is null")
    out["facet_stance"] = _counts("ai_political_stance", "manual_bias is null")
    out["review_queue_bias_desc"] = _queue("bias_score_after desc nulls last")
    out["review_queue_bias_asc"] = _queue("bias_score_after asc nulls first")
    out["review_queue_delta_desc"] = _queue("bias_delta desc nulls last")
    out["review_queue_delta_asc"] = _queue("bias_delta asc nulls first")
    out["review_queue_time_newest"] = _queue('"timestamp" desc nulls last')
    out["review_queue_time_oldest"] = _queue('"timestamp" asc nulls first')
    out["review_queue_random"] = _queue("md5(concat('7:', id::varchar))")
    out["review_queue_filtered"] = _queue(
        "bias_score_after desc nulls last",
        "change_desc = 'Inserted Sentence' and ai_topic = 'click' and ai_political_stance = 'Neutral'",
    )
    for sort, order in (("bias_asc", "bias_score_after asc nulls first"), ("delta_asc", "bias_delta asc nulls first")):
        out[f"review_queue_filtered_{sort}"] = _queue(order, "change_desc = 'Inserted Sentence' and ai_political_stance = 'Neutral'")
    out["topic_top10"] = _top("ai_topic")
    out["stance_top10"] = _top("ai_political_stance")
    out["bias_histogram"] = (
        f"with {EVENT_REV}, b as (select unnest(range(5))::integer as bin)"
        " select b.bin, case b.bin when 0 then '0-.2' when 1 then '.2-.4' when 2 then '.4-.6' when 3 then '.6-.8' else '.8-1' end as label,"
        " count(x.i)::bigint as n from b left join (select least(greatest(trunc(bias_score_after * 5)::integer, 0), 4) as i from rev"
        " where bias_score_after is not null) x on x.i = b.bin group by 1, 2"
    )
    out["score_range"] = (
        f"with {EVENT_REV}, d as ({_DAILY}), v as (select s from d where d is not null and s is not null)"
        " select round(coalesce(min(s), 0.0), 6) as min_value,"
        " round(case when count(*) = 0 then 1.0 when min(s) = max(s) then max(s) + 1 else max(s) end, 6) as max_value from v"
    )
    out["daily_bias"] = (
        f"with {EVENT_REV}, d as ({_DAILY}) select cast(d as varchar) as date, round(s, 6) as avg_score from d"
        " where d is not null and s is not null"
    )
    out["daily_activity"] = (
        f"with {EVENT_REV} select cast({DAY} as varchar) as date, count(*)::bigint as n from rev where {DAY} is not null group by 1"
    )
    out["daily_topic_grid"] = _grid("ai_topic")
    out["daily_stance_grid"] = _grid("ai_political_stance")
    out["segment_pairs"] = (
        f"with {EVENT_REV}, d as ({_DAILY}), v as (select d, s from d where d is not null and s is not null)"
        " select cast(d as varchar) as x1, round(s, 6) as y1, cast(x2 as varchar) as x2, round(y2, 6) as y2 from"
        " (select d, s, lead(d) over (order by d) as x2, lead(s) over (order by d) as y2 from v) where x2 is not null"
    )
    out["monthly_outliers"] = _outliers(LINE_REV)
    out["monthly_activity"] = f"with {LINE_REV}, {_MONTHS} select month, revs, round(s, 6) as avg_score from m"
    out["label_state"] = f"with {LABEL_EVENTS}, {LABEL_STATE} select * from state"
    out["labelled_revisions"] = (
        f"with {EVENT_REV}, {LABEL_EVENTS}, {LABEL_STATE} select rev.id, article_url, state.manual_bias, state.manual_topic"
        " from rev left join state on state.id = rev.id"
    )
    out["label_progress"] = (
        f'with {EVENT_REV} select count(*)::bigint as revisions, count(manual_bias)::bigint as scored from rev'
    )
    out["training_export"] = (
        f"with {EVENT_REV} select id, article_url, diff_before, diff_after, content, manual_bias, manual_topic from rev"
        " where manual_bias is not null and manual_bias <> 'SKIPPED'"
    )
    return out

