"""SQL for the queries over landed files and stored tables, for DuckDB."""

from __future__ import annotations

from revlens.workload.oracle import _MONTHS, ARTICLES, EVENT_REV, LABEL_EVENTS, LABEL_STATE, LINE_REV
from revlens.workload.oracle_text import model_queries

_SHOWN = (
    "st as (select avg(revs) ra, stddev_pop(revs) rs, avg(s) sa, stddev_pop(s) ss from m),"
    " z as (select month, 'Activity' as k, printf('%d revs', revs) as value_text, printf('(Mean: %.1f)', ra) as context, (revs - ra) / nullif(rs, 0) as z from m, st"
    " union all select month, 'Bias Score', printf('%.4f', s), printf('(Mean: %.4f)', sa), (s - sa) / nullif(ss, 0) from m, st)"
)


def _length(column: str) -> str:
    return f"case when trim({column}) <> '' then round(least(1.0::double, length({column}) / 64.0::double), 6) end"


def _blank(column: str) -> str:
    return f"case when trim({column}) <> '' then round((length({column}) - length(replace({column}, ' ', '')))::double / length({column}), 6) end"


def stored_queries() -> dict[str, str]:
    out = {}
    out["landed_articles"] = model_queries()["articles_refresh"]
    out["listed_topics"] = (
        f"with {EVENT_REV}, l as (select label, (row_number() over (order by label) - 1)::integer as pos from (select distinct ai_topic as label from rev where ai_topic is not null))"
        " select pos, label, count(rev.id)::bigint as n from l left join rev on rev.ai_topic = l.label group by 1, 2"
    )
    out["stored_articles"] = f"with {ARTICLES} select url, coord from articles where coord is not null"
    out["stored_changes"] = (
        f"with {EVENT_REV}, s as (select *, original_revid % 3 <> 0 as old, original_revid % 2 = 0 as again from rev)"
        " select id, round(case when again then 1 - bias_score_after else bias_score_after end, 6) as score,"
        " case when old then manual_bias end as manual_bias, case when old then manual_topic end as manual_topic,"
        " case when again then 'again' else content end as content,"
        " cast(try_cast(substr(\"timestamp\", 1, 10) as date) as varchar) as event_date, substr(\"timestamp\", 1, 7) as event_month from s where old or again"
    )
    out["written_labels"] = f"with {LABEL_EVENTS}, {LABEL_STATE} select * from state"
    out["short_timestamps"] = (
        f"with {EVENT_REV}, c as (select bias_score_after, case original_revid % 5 when 0 then null when 1 then substr(\"timestamp\", 1, 4)"
        " when 2 then substr(\"timestamp\", 1, 7) else \"timestamp\" end as ts from rev)"
        " select substr(ts, 1, 7) as month, count(*)::bigint as revs, round(avg(bias_score_after), 6) as avg_score from c where length(ts) >= 7 group by 1"
    )
    out["outlier_texts"] = (
        f"with {LINE_REV}, {_MONTHS}, {_SHOWN} select month, case when z > 1.5 then 'High ' else 'Low ' end || k as reason, value_text, context from z where abs(z) > 1.5"
    )
    out["parsed_days"] = (
        "select cast(try_strptime(case when l_orderkey % 7 = 0 then replace(strftime(l_shipdate, '%Y-%m-%d'), '-', '/') else strftime(l_shipdate, '%Y-%m-%d') end, '%Y-%m-%d')::date as varchar) as day,"
        " count(*)::bigint as n from lineitem group by 1"
    )
    out["function_scored"] = (
        f"with {EVENT_REV} select id, {_length('diff_before')} as before_long, {_blank('diff_before')} as before_blank,"
        f" {_length('diff_after')} as after_long, {_blank('diff_after')} as after_blank from rev"
    )
    return out
