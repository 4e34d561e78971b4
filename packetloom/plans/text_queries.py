"""Queries over rule text, signatures, hosts and document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.net import decode_payload
from packetloom.operators import detect, limits, lookup
from packetloom.plans.registry import query
from packetloom.sources import intel as intel_source
from packetloom.sources import rules as rule_source
from packetloom.sources.packets import packet_heads, table
from packetloom.sources.signatures import signatures
from packetloom.plans.sql_parts import HEADS

# Rule lines written from the part table: eight shapes, of which the fifth, sixth
# and eighth are not rules (another action, a short head, a comment).
RULE_LINE = """
case p_partkey % 8
 when 2 then concat('  alert udp any any -> any any (msg:"', p_name, ' (x)"; content:"one"; content:"',
   p_type, '"; noalert; dsize:<', p_size, '; classtype:', p_brand, '; reference:url,example.org/',
   p_partkey, '; sid:', 9300000 + p_partkey, '; rev:1;)  ')
 when 3 then concat('alert ip any any -> any any (content:!"neg"; msg:"', p_name, ';tail"; sid:',
   9300000 + p_partkey, ';)')
 when 4 then concat('drop tcp any any -> any any (msg:"', p_name, '"; sid:', 9300000 + p_partkey, ';)')
 when 5 then concat('alert tcp any (msg:"', p_name, '"; sid:', 9300000 + p_partkey, ';)')
 when 6 then concat('alert dnp3 any any -> any any (msg:"', p_name, '"; \\\\')
 when 7 then if(p_size % 2 = 0, concat('# alert tcp ', p_name), '   ')
 else concat('alert TCP any any -> any 80 (msg:"', p_name, '"; flow:established,to_server; content:"',
   p_type, '"; dsize:>', p_size * 100, '; classtype:', p_brand, '; reference:cve,2020-', p_partkey,
   '; reference:url,example.org/', p_partkey, '; sid:', 9300000 + p_partkey, '; rev:1;)')
end"""

RULE_SQL = """
shaped as (select *, p_partkey % 8 as shape, (9300000 + p_partkey)::varchar as full_sid from part),
parsed as (
  select p_partkey, p_brand as rule_file, shape,
    case when shape = 2 then 'udp' when shape = 3 then 'ip' when shape = 6 then 'dnp3' else 'TCP' end as rule_proto,
    case when shape <> 6 then full_sid end as sid,
    case when shape = 2 then p_name || ' (x)' else p_name end as msg,
    case when shape = 3 then '!"neg' when shape <> 6 then p_type end as content,
    case when shape = 2 then '<' when shape in (0, 1) then '>' end as dsize_op,
    case when shape = 2 then p_size when shape in (0, 1) then p_size * 100 end as dsize_n,
    case when shape in (0, 1, 2) then p_brand end as classtype,
    shape = 2 as noalert
  from shaped where shape in (0, 1, 2, 3, 6))"""


def part_rule_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey", F.col("p_brand").alias("rule_file"), F.expr(RULE_LINE).alias("line")
    )


def part_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rule_source.parse_rules(rule_source.clean_lines(part_rule_lines(spark, folder)))


@query(
    "rule_catalog",
    f"with {RULE_SQL}"
    + """
select p_partkey, rule_proto, case when shape in (0, 1) then '80' else 'any' end as rule_dport,
  sid, msg, content, dsize_op, dsize_n, classtype, noalert,
  case shape when 2 then 7 when 3 then 3 when 6 then 1 else 8 end as n_options,
  case when shape in (0, 1, 2) then 'url,example.org/' || p_partkey end as last_reference
from parsed""",
)
def rule_catalog(spark, folder):
    return part_rules(spark, folder).select(
        "p_partkey",
        "rule_proto",
        "rule_dport",
        "sid",
        "msg",
        "content",
        "dsize_op",
        "dsize_n",
        "classtype",
        "noalert",
        F.size("options").alias("n_options"),
        F.col("options")["reference"].alias("last_reference"),
    )


@query(
    "rule_stats",
    f"with {RULE_SQL} select rule_file, count(*) as rules from parsed group by rule_file",
)
def rule_stats(spark, folder):
    return rule_source.rules_per_file(part_rules(spark, folder))


@query(
    "rule_defaults",
    f"with {RULE_SQL}"
    + """
select coalesce(sid, '0') as sid, coalesce(classtype, 'unknown') as rule_class, count(*) as rules
from parsed group by all""",
)
def rule_defaults(spark, folder):
    return (
        rule_source.rule_table(part_rules(spark, folder))
        .groupBy("sid", "rule_class")
        .agg(F.count(F.lit(1)).alias("rules"))
    )


@query(
    "action_routing",
    """
select case p_partkey % 8 when 4 then 'drop' else 'alert' end as action, count(*) as lines
from part where p_partkey % 8 <> 7 group by 1""",
)
def action_routing(spark, folder):
    lines = rule_source.clean_lines(part_rule_lines(spark, folder))
    return (
        rule_source.any_action(lines)
        .groupBy("action")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query(
    "noalert_filter",
    f"with {RULE_SQL}"
    + """
select p.rule_file, count(*) as counted, count(*) filter (not p.noalert) as emitted
from lineitem l join parsed p on p.sid = (9300000 + l.l_partkey)::varchar group by p.rule_file""",
)
def noalert_filter(spark, folder):
    """Order lines as hits of their part's rule: all are counted, some are emitted."""
    hits = (
        table(spark, folder, "lineitem")
        .groupBy((9300000 + F.col("l_partkey")).cast("string").alias("sid"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    named = hits.join(part_rules(spark, folder).select("sid", "rule_file", "noalert"), "sid")
    shown = F.when(~F.col("noalert"), F.col("n")).otherwise(0)
    return named.groupBy("rule_file").agg(
        F.sum("n").alias("counted"), F.sum(shown).alias("emitted")
    )


@query(
    "emitted_alerts",
    f"with {RULE_SQL}"
    + """
select l.l_orderkey, l.l_linenumber, p.sid
from lineitem l join parsed p on p.sid = (9300000 + l.l_partkey)::varchar where not p.noalert""",
)
def emitted_alerts(spark, folder):
    """The hits that are shown, as rows."""
    hits = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (9300000 + F.col("l_partkey")).cast("string").alias("sid")
    )
    named = hits.join(part_rules(spark, folder).select("sid", "noalert"), "sid")
    return limits.emitted(named).select("l_orderkey", "l_linenumber", "sid")


@query(
    "reference_enrichment",
    f"with {RULE_SQL}"
    + """,
refs as (
  select sid, 'cve' as ref_type, '2020-' || p_partkey as ref_id from parsed where shape in (0, 1)
  union all
  select sid, 'url', 'example.org/' || p_partkey from parsed where shape in (0, 1, 2)),
hits as (select (9300000 + l_partkey)::varchar as sid, count(*) as alerts from lineitem group by 1)
select sid, alerts, ref_type, ref_id from hits left join refs using (sid)""",
)
def reference_enrichment(spark, folder):
    """Alert counts per signature (order lines per part) with the rule's references."""
    alerts = (
        table(spark, folder, "lineitem")
        .groupBy((9300000 + F.col("l_partkey")).cast("string").alias("sid"))
        .agg(F.count(F.lit(1)).alias("alerts"))
    )
    refs = rule_source.references(part_rules(spark, folder), "sid")
    return lookup.with_references(alerts, refs)


def indicator_text(spark: SparkSession, folder: str) -> DataFrame:
    """Indicator list lines: sources and a range per user block, comments, blanks, hosts."""
    heads = packet_heads(spark, folder)
    ips = heads.select(
        F.explode(
            F.array(
                F.concat(F.lit(" "), "src_ip"),
                F.concat(F.substring_index("src_ip", ".", 3), F.lit(".0/24")),
                F.concat(F.lit("# seen "), "proto"),
                F.lit(""),
            )
        ).alias("line"),
        F.lit("ip").alias("kind"),
    )
    hosts = detect.url_hosts(table(spark, folder, "pages")).select(
        F.col("host").alias("line"), F.lit("domain").alias("kind")
    )
    return ips.unionByName(hosts)


HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"


@query(
    "intel_stats",
    f"with {HEADS}"
    + f""",
ips as (select distinct src_ip as i from heads),
nets as (select distinct regexp_replace(src_ip, '[.][0-9]+$', '') as i from heads),
hosts as (select distinct {HOST} as i from pages)
select 'ip' as kind, (select count(*) from ips) as indicators,
  (select count(*) from ips) + (select count(*) from nets)
    + (select count(distinct proto) from heads) + 1 as raw_lines
union all select 'cidr', (select count(*) from nets), 0
union all select 'domain', (select count(*) from hosts), (select count(*) from hosts)""",
)
def intel_stats(spark, folder):
    """Cleaned indicators per kind, next to the distinct raw lines with comments and blanks."""
    lines = indicator_text(spark, folder)
    clean = intel_source.indicator_counts(intel_source.indicators(lines))
    raw = intel_source.indicator_counts(intel_source.indicators(lines, keep_raw=True))
    return clean.join(raw.withColumnRenamed("indicators", "raw_lines"), "kind", "left").select(
        "kind", "indicators", F.coalesce("raw_lines", F.lit(0).cast("bigint")).alias("raw_lines")
    )


@query(
    "domain_intel",
    f"""
with hosts as (select page_id, {HOST} as host, url from pages),
bad as (select distinct host from hosts where url like 'http:%')
select page_id, host, case when host in (select host from bad) then 100 else 0 end as intel_score
from hosts""",
)
def domain_intel(spark, folder):
    """Hosts that were once fetched without TLS are the bad domains."""
    hosts = detect.url_hosts(table(spark, folder, "pages"))
    bad = (
        hosts.filter(F.col("url").startswith("http:"))
        .select(F.col("host").alias("indicator"), F.lit("domain").alias("kind"))
        .distinct()
    )
    return lookup.score_indicators(hosts, bad, ["host"], kind="domain").select(
        "page_id", "host", "intel_score"
    )


@query(
    "dns_tunnel",
    f"""
with hosts as (select distinct {HOST} as host from pages),
split as (select host, string_split(host, '.') as labels from hosts)
select labels[-2] || '.' || labels[-1] as parent, count(*) as hosts,
  max(list_max([length(x) for x in labels])) as longest_label
from split group by 1 having count(*) >= 2""",
)
def dns_tunnel(spark, folder):
    return detect.dns_tunnels(detect.url_hosts(table(spark, folder, "pages")), min_hosts=2)


SIGNATURE_TEXT = r"""
concat('rule part_', p_partkey, if(p_size % 3 = 0, '', concat(' : Kit ', replace(p_brand, '#', '_'))),
  '\n{\nmeta:\n   author = "', p_brand, '"\n   size = ', p_size,
  '\nstrings:\n   $string0 = "', p_name, '"\n\t$string1 = "', p_type, ' \\"x\\" <a href={}>"\n   $string2 = "',
  p_brand, ' (a;b)"\ncondition:\n   ',
  case p_partkey % 3 when 0 then '2 of them' when 1 then 'all of them' else 'any of them' end, '\n}\n')
"""


@query(
    "signature_catalog",
    """
select 'part_' || p_partkey as name, p_brand as author, p_size::varchar as size,
  case when p_size % 3 = 0 then '' else 'Kit,' || replace(p_brand, '#', '_') end as tags,
  case p_partkey % 3 when 0 then 2 when 1 then 3 else 1 end as k,
  p_name || '|' || p_type || ' "x" <a href={}>' || '|' || p_brand || ' (a;b)' as strings
from part""",
)
def signature_catalog(spark, folder):
    """Signature files, one per brand, written from the part table and read back as rows."""
    texts = table(spark, folder, "part").select(
        F.concat(
            F.lit("/* kit\n rule not_one { } */\n"), F.expr(SIGNATURE_TEXT)
        ).alias("text")
    )
    return signatures(texts).select(
        "name",
        F.col("meta")["author"].alias("author"),
        F.col("meta")["size"].alias("size"),
        F.concat_ws(",", "tags").alias("tags"),
        "k",
        F.concat_ws("|", "strings").alias("strings"),
    )


# String sets and patterns of the text scans.
SIGNATURE_VALUES = """
 ('s1', array('the', 'and', 'zzz'), 2), ('s2', array('license', 'copyright'), 1),
 ('s3', array('key', 'token', 'secret', 'password'), 2)
"""
PATTERNS = {
    "charset_head": r"<meta charset=\"[a-z0-9-]+\"><title>",
    "page_number": r"[0-9]{3,}\?page=[0-9]+",
    "script_tag": r"<script[^>]*>",
}
PERSONAL = (r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
# The same finds as the first pattern in time linear in the text: a find starts where
# a run of these characters starts or where the last find ended, and takes the run whole.
LINEAR_MAIL = r"(?:(?<![A-Za-z0-9._])|\G)[A-Za-z0-9._]++@[A-Za-z0-9.]+"


@query(
    "kofn_scan",
    """
with sigs as (select * from (values ('s1', ['the', 'and', 'zzz'], 2), ('s2', ['license', 'copyright'], 1),
  ('s3', ['key', 'token', 'secret', 'password'], 2)) t(name, strings, k)),
hits as (select doc_id, name, k, len([s for s in strings if contains(text, s)]) as found
  from documents, sigs)
select doc_id, name, found from hits where found >= k""",
)
def kofn_scan(spark, folder):
    sigs = spark.sql(f"SELECT * FROM VALUES {SIGNATURE_VALUES} AS t(name, strings, k)")
    return detect.scan_signatures(table(spark, folder, "documents"), sigs, key="doc_id")


@query(
    "regex_scan",
    " union all ".join(
        f"select page_id, '{name}' as name from pages where regexp_matches(html, '{p}')"
        for name, p in PATTERNS.items()
    ),
)
def regex_scan(spark, folder):
    return detect.scan_patterns(table(spark, folder, "pages"), PATTERNS, key="page_id", text="html")


@query(
    "sensitive_data",
    "select * from (select doc_id, "
    + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in PERSONAL)
    + " as hits from documents) where hits >= 1",
)
def sensitive_data(spark, folder):
    return detect.sensitive_records(
        table(spark, folder, "documents"),
        (LINEAR_MAIL, PERSONAL[1]),
        key="doc_id",
        min_hits=1,
    )


@query(
    "payload_decode",
    "select doc_id, md5(replace(text, chr(65533), '')) as digest from documents",
)
def payload_decode(spark, folder):
    """Texts as bytes with invalid bytes put in front and behind, decoded without them."""
    raw = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(decode_payload(raw).cast("binary")).alias("digest")
    )
