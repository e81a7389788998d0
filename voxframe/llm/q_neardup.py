"""Query op3: components of near duplicates over all documents, on shingles of two words as its contract says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import neardup


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2).drop("class_id")


SQL = r"""
with recursive split as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as materialized (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) when len(w) = 1 then w else [] end) as s from split),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as materialized (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
edges as materialized (select a as u, b as v from links union select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.v from reach r join edges e on e.u = r.other)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, min(other) as component_id, d.doc_id = min(other) as kept from documents d join reach r on r.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id group by d.doc_id, n"""

QUERIES = {"op3_neardup": op3_neardup}
ORACLES = {"op3_neardup": SQL}
