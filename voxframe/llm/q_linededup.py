"""Query op8: every document after the removal of repeated chunks of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import linededup as L


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = L.dedup(docs)
    return out.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), "chunks_removed", "lines_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def sql(table: str = "documents") -> str:
    return f"""
with lines as (select doc_id, i, t[i] as l, len(t) as n from (select doc_id, string_split(text, chr(10)) as t, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from {table} where text is not null)),
hashed as (select *, ('0x' || substr(md5(l), 1, 7))::bigint as h from lines),
rolled as (select *, (h * {L.NOW} + coalesce(lag(h) over (partition by doc_id order by i), 0) * {L.BEFORE}) % {L.PRIME} as r from hashed),
marked as (select *, i = n or (i > 1 and r < lag(r) over w and r <= lead(r) over w) as stops from rolled window w as (partition by doc_id order by i)),
numbered as (select *, coalesce(sum(stops::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from marked),
parts as (select doc_id, k, count(*) as lines, string_agg(l, chr(10) order by i) as chunk from numbered group by doc_id, k),
ranked as (select *, lines >= 2 and row_number() over (partition by case when lines >= 2 then chunk else doc_id::varchar || ' ' || k::varchar end, lines >= 2 order by doc_id, k) > 1 as gone from parts),
made as (select doc_id, coalesce(string_agg(chunk, chr(10) order by k) filter (not gone), '') as text, count(*) filter (gone) as chunks_removed, coalesce(sum(lines) filter (gone), 0)::bigint as lines_removed from ranked group by doc_id)
select d.doc_id, coalesce(len(string_split(m.text, chr(10))), 0)::bigint as n_lines, coalesce(chunks_removed, 0)::bigint as chunks_removed, coalesce(lines_removed, 0)::bigint as lines_removed, md5(coalesce(m.text, '')) as text_md5
from {table} d left join made m on d.doc_id = m.doc_id"""


QUERIES = {"op8_linededup": op8_linededup}
ORACLES = {"op8_linededup": sql()}
