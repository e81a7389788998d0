"""Query op2: removal of word windows that an earlier document has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import substrings


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive split as materialized (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select doc_id, pos, md5(array_to_string(w[pos:pos + 12], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 11)) as pos from split)),
marked as materialized (select *, min(doc_id) over (partition by h) as lo, max(doc_id) over (partition by h) as hi from win),
gone as (select distinct doc_id, pos + k as i from marked, (select unnest(range(0, 13)) as k) where lo < doc_id),
each as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from split),
kept as (select e.doc_id, string_agg(x, ' ' order by e.i) as t, count(*) as n from each e anti join gone g on g.doc_id = e.doc_id and g.i = e.i group by e.doc_id),
made as materialized (select s.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from split s left join kept k on k.doc_id = s.doc_id),
levels(size, doc_id, pos, h) as (
 select 13, doc_id, pos, h from marked where lo <> hi
 union all
 select 2 * size, doc_id, pos, h from (select *, min(doc_id) over (partition by h) as lo, max(doc_id) over (partition by h) as hi from (select a.size, a.doc_id, a.pos, md5(a.h || b.h) as h from levels a join levels b on b.doc_id = a.doc_id and b.pos = a.pos + a.size)) where lo <> hi),
longest as (select doc_id, max(size) as size from levels group by doc_id)
select d.doc_id, n_words, n_removed, kept_sha256, coalesce(l.size, 0)::bigint as longest_repeat from made d left join longest l on l.doc_id = d.doc_id"""

QUERIES = {"op2_substrings": op2_substrings}
ORACLES = {"op2_substrings": SQL}
