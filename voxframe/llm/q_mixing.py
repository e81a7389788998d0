"""Query op4: how many words of each document the mix takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import mixing


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _filled(given: str, group: str, place: str, weight: str) -> str:
    """Shares of total by weight within a group, none over CAP times size: the SQL of mixing._filled."""
    w = f"partition by {group} " if group else ""
    return f"""(select *, case when level > most / weight then most else least(min_by(level, case when level <= most / weight then step end) over ({w}) * weight, most) end as share from
        (select *, (total - coalesce(sum(most) over before, 0::double)) / ((sum(weight) over ({w})) - coalesce(sum(weight) over before, 0::double)) as level, row_number() over ({w}order by most / weight, place) as step
         from (select *, {weight} as weight, {mixing.CAP}::double * size::double as most from (select *, row_number() over ({w}order by {place}) as place from {given}))
         window before as ({w}order by most / weight, place rows between unbounded preceding and 1 preceding)))"""


def sql(table: str = "documents") -> str:
    weights = f"[{', '.join(f'{w}::double' for w in mixing.WEIGHTS)}][((place - 1) % {len(mixing.WEIGHTS)} + 1)::int]"
    odds = "(({0}) / (1 - ({0})))"
    ratio = f"({odds.format('u')} / {odds.format('p')})"
    key = "struct_pack(a := rank, b := coalesce(doc_id, -9223372036854775807), c := size)"
    return f"""
with sized as materialized (select *, length(bin(size)) - 1 as class from (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
 (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))), 1, 13))::bigint::double + 0.5::double) / {1 << 52}::double as u from {table})),
classes as (select source, class, sum(size)::bigint as size from sized group by all),
sources as (select source, sum(size)::bigint as size, (sum(sum(size)) over ())::double as total from sized group by source),
aimed as (select source, size as source_size, share as target from {_filled('sources', '', 'encode(source) nulls last', weights)}),
given as (select c.*, source_size, target, target as total from classes c join aimed a on c.source is not distinct from a.source),
shared as (select *, floor(case when size > 0 then share / size else 0::double end)::bigint as sure, (case when size > 0 then share / size else 0::double end) - floor(case when size > 0 then share / size else 0::double end) as p
 from {_filled('given', 'source', 'class', f'greatest(size, 1)::double * ({mixing.LEAN}::double + class)')}),
allotted as (select *, target - (sum(sure * size) over (partition by source))::bigint as gap from shared),
ranked as materialized (select s.doc_id, s.source, s.size, source_size, target, sure, gap, p > 0 and s.size > 0 as op, case when p > 0 then {ratio} / ({ratio} + 1::double) else 1::double end as rank from sized s join allotted a on s.source is not distinct from a.source and s.class = a.class),
summed as (select *, sum(case when op then size else 0 end) over (partition by source order by rank, doc_id nulls first, size) as upto from ranked),
taken as materialized (select *, op and upto <= gap as more, gap - coalesce(max(case when op and upto <= gap then upto end) over (partition by source), 0) as room from summed),
closest as (select source, min_by({key}, struct_pack(a := abs(size - room), b := {key})) as pick from taken where op and not more and abs(size - room) < room group by source)
select t.doc_id, t.size, source_size, target, (t.size * (sure + case when more or coalesce(op and {key} = pick, false) then 1 else 0 end))::bigint as taken from taken t left join closest c on t.source is not distinct from c.source"""


QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": sql()}
