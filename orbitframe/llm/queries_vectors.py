"""Queries of the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitframe.llm.common import table
from orbitframe.llm.pq_dedup import near_duplicates
from orbitframe.llm.topk import top_k


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all other vectors for every vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 10
"""


def op9_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal label at cosine 0.98."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


OP9_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (
  select a, b from links
  union
  select r.a, l.b from reach r join links l on r.b = l.a),
n as (select a, count(*) as n from links group by a),
c as (select a, min(b) as c from reach group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(c, vec_id)) as component_id,
       vec_id = least(vec_id, coalesce(c, vec_id)) as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
"""

QUERIES = {"op4_topk": op4_topk, "op9_pq_dedup": op9_pq_dedup}
ORACLES = {"op4_topk": OP4_SQL, "op9_pq_dedup": OP9_SQL}
