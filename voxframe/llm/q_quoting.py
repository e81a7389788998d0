"""Query op5: all messages in reply order, without quotations.

The SQL states the same result, with a recursive query for the threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import quoting


def op5_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoting.linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op5_quoting": op5_quoting}


def sql(table: str = "conversations") -> str:
    marks, space = r"^[\x20\t]*>(?:[\x20\t]*>)*[\x20\t]?", r"[\s>]+"
    digest = lambda x: f"case when trim(regexp_replace(lower({x}), '{space}', ' ', 'g')) <> '' then md5(trim(regexp_replace(lower({x}), '{space}', ' ', 'g'))) end"
    return rf"""
with recursive messages as (select conv_id::bigint as conv_id, turn::bigint as turn, role, text, row_number() over () as m from {table}),
cut as (select m, conv_id, turn, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) as line, unnest(range(1, len(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) + 1)) as i from messages where text is not null),
split as (select *, length(regexp_replace(regexp_extract(line, '{marks}'), '[^>]', '', 'g')) as depth, substr(line, length(regexp_extract(line, '{marks}')) + 1) as body from cut),
cited as (select *, depth > 0 or (coalesce(lead(depth) over (partition by m order by i) > 0, false) and regexp_matches(body, '{quoting.ATTRIBUTION}')) as cited from split),
owned as (select m, regexp_replace(regexp_replace(coalesce(string_agg(body, chr(10) order by i) filter (not cited), ''), '\n(?:[\x20\t]*\n){{2,}}', chr(10) || chr(10), 'g'), '^(?:[\x20\t]*\n)+|(?:\n[\x20\t]*)+$', '', 'g') as own from cited group by m),
held as (select g.m, g.conv_id, g.turn, g.role, coalesce(o.own, '') as own from messages g left join owned o on g.m = o.m),
runs as (select *, sum(fresh) over (partition by m order by i) as q from (select *, case when lag(depth) over (partition by m order by i) = depth and lag(i) over (partition by m order by i) = i - 1 then 0 else 1 end as fresh from cited where depth > 0)),
quotes as (select m, conv_id, turn, q, any_value(depth) as depth, string_agg(body, chr(10) order by i) as body from runs group by m, conv_id, turn, q),
asked as (select m, conv_id, turn, q, depth, 0 as rank, {digest('body')} as key from quotes union all select m, conv_id, turn, q, depth, 1, {digest('p')} from (select *, unnest(string_split_regex(body, '\n[\x20\t]*\n')) as p from quotes) union all select m, conv_id, turn, q, depth, 2, {digest('body')} from runs),
offered as (select conv_id, turn as origin, {digest('own')} as key from held union all select conv_id, turn, {digest('l')} from (select conv_id, turn, unnest(string_split(own, chr(10))) as l from held) union all select conv_id, turn, {digest('p')} from (select conv_id, turn, unnest(string_split_regex(own, '\n[\x20\t]*\n')) as p from held)),
firsts as (select conv_id, key, min(origin) as origin from offered where key is not null group by conv_id, key),
found as (select a.conv_id, a.turn, a.q, a.depth, min((a.rank, -f.origin)) as best from asked a join firsts f on a.conv_id = f.conv_id and a.key = f.key and f.origin < a.turn group by all),
links as (select conv_id, turn, -(min((depth, best[2]))[2]) as reply_to, count(*) as n_linked from found group by conv_id, turn),
up as (select conv_id, turn, reply_to as thread, 1::bigint as depth from links union all select u.conv_id, u.turn, l.reply_to, u.depth + 1 from up u join links l on u.conv_id = l.conv_id and u.thread = l.turn),
roots as (select conv_id, turn, arg_max(thread, depth) as thread, max(depth) as depth from up group by conv_id, turn)
select h.conv_id, coalesce(r.thread, h.turn) as thread, h.turn, h.role, l.reply_to, coalesce(r.depth, 0) as depth, (select count(*) from quotes q where q.m = h.m) as n_quotes, coalesce(l.n_linked, 0) as n_linked, h.own as text,
 '<|' || coalesce(h.role, 'unknown') || '|>' || chr(10) || h.own || chr(10) || '<|end|>' || chr(10) as chat
from held h left join links l on h.conv_id = l.conv_id and h.turn = l.turn left join roots r on h.conv_id = r.conv_id and h.turn = r.turn"""


ORACLES = {"op5_quoting": sql()}
