"""op12: documents ranked for every benchmark item."""

from __future__ import annotations

from packetloom.llm import range_rank
from packetloom.llm.tables import table
from packetloom.plans.registry import query

_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term"""
SQL = rf"""
with rows as (select row_number() over () as r, doc_id, text from documents),
found as (select r, {_TERMS} from rows),
post as (select r, term, count(*) as tf from found group by r, term),
size as (select r, sum(tf)::bigint as n from post group by r),
whole as (select count(*) as n_docs, sum(n)::bigint as n_words from size),
weight as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from post, whole group by term, n_docs),
asked as (
  select item_id, term, count(*) as times
  from (select item_id, {_TERMS} from (select distinct item_id, text from benchmark)) group by item_id, term),
scores as (
  select item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words))))::bigint as score
  from asked join post using (term) join weight using (term) join size using (r), whole group by item_id, r),
ranked as (
  select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
  from scores join rows using (r) where score > 0 and doc_id is not null)
select * from ranked where rank <= 20
"""


@query("op12_range_rank", SQL)
def op12_range_rank(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    items = table(spark, folder, "benchmark").select("item_id", "text")
    return range_rank.ranked_documents(docs, items, answers=20)
