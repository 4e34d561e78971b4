"""op6: every page's url judged by rules and reputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.llm import url_reputation
from packetloom.llm.tables import table
from packetloom.plans.registry import query

# The rules of the query (host, path, action).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_LONG = ", ".join(f"'{x}'" for x in url_reputation.LONG_SUFFIXES)
SQL = rf"""
with parts as (
  select page_id, html,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path
  from pages),
counts as (
  select host, count(html) as n,
    coalesce(sum(regexp_matches(html,
      '[%#$*]{{3}}\s|&amp;&amp;&amp;|(?i:\b(?:idiots?|morons?|worthless)\b)')::int), 0)::double as bad,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') as bare
  from parts group by host),
named as (
  select *, case when regexp_matches(bare, '^[0-9.]+$|^\[') then bare
    else array_to_string(string_split(bare, '.')[(case when last in ({_LONG}) then -2 else -1 end):], '.') end as suffix,
    case when regexp_matches(bare, '^[0-9.]+$|^\[') then bare
    else array_to_string(string_split(bare, '.')[(case when last in ({_LONG}) then -3 else -2 end):], '.') end as domain
  from (select *, array_to_string(string_split(bare, '.')[-2:], '.') as last from counts)),
whole as (select (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) as mu from named),
s0 as (select suffix, sum(n) as n, sum(bad) as bad, any_value(mu) as mu from named, whole group by suffix),
sw as (select case when sum(n * mu * (1 - mu) * (n - 1)) > 0 then
  least(greatest(1 / greatest((sum(pow(bad - n * mu, 2)) - sum(n * mu * (1 - mu)))
  / sum(n * mu * (1 - mu) * (n - 1)), 1e-9) - 1, 1.0), 1e4) else 1.0 end as w from s0),
s1 as (select suffix, (bad + w * mu) / (n + w) as mean from s0, sw),
d0 as (select domain, suffix, sum(n) as n, sum(bad) as bad, any_value(mean) as mu
  from named join s1 using (suffix) group by domain, suffix),
dw as (select case when sum(n * mu * (1 - mu) * (n - 1)) > 0 then
  least(greatest(1 / greatest((sum(pow(bad - n * mu, 2)) - sum(n * mu * (1 - mu)))
  / sum(n * mu * (1 - mu) * (n - 1)), 1e-9) - 1, 1.0), 1e4) else 1.0 end as w from d0),
d1 as (select domain, suffix, (bad + w * mu) / (n + w) as mean from d0, dw),
h0 as (select host, n, bad, mean as mu from named join d1 using (domain, suffix)),
hw as (select case when sum(n * mu * (1 - mu) * (n - 1)) > 0 then
  least(greatest(1 / greatest((sum(pow(bad - n * mu, 2)) - sum(n * mu * (1 - mu)))
  / sum(n * mu * (1 - mu) * (n - 1)), 1e-9) - 1, 1.0), 1e4) else 1.0 end as w from h0),
h1 as (select host, (bad + w * mu) / (n + w) as mean, n + w as total from h0, hw),
h2 as (select host, greatest(0.0, mean - 1.28 * sqrt(mean * (1 - mean) / (total + 1))) as bound from h1),
rules(rhost, rpath, action) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit as (
  select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule,
    arg_max(action, length(rhost || rpath)) as action
  from parts join rules on (host = rhost or suffix(host, '.' || rhost)) and starts_with(path, rpath)
  group by page_id)
select page_id, host, path, rule,
  coalesce(action, case when bound >= 0.10 then 'block' else 'allow' end) as verdict
from parts join h2 using (host) left join fit using (page_id)"""


@query("op6_url_reputation", SQL)
def op6_url_reputation(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    labelled = pages.withColumn("outcome", url_reputation.page_outcome(F.col("html"))).drop("html")
    judged = url_reputation.judge(labelled, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")
