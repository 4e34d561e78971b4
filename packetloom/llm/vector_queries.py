"""op5 and op13: nearest vectors, by graphs and exactly."""

from __future__ import annotations

from packetloom.llm import column_search, vamana
from packetloom.llm.tables import table
from packetloom.plans.registry import query


@query("op5_vamana")
def op5_vamana(spark, folder):
    return vamana.nearest(table(spark, folder, "embeddings"), every=20, answers=20)


EXACT_SQL = """
with v as (
  select distinct vec_id, [floor(64 * x::double) for x in embedding] as e from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
  from pairs)
select * from ranked where rank <= 20
"""


@query("op13_column_search", EXACT_SQL)
def op13_column_search(spark, folder):
    return column_search.exact_nearest(table(spark, folder, "embeddings"), every=20, answers=20, scale=64)
