"""Small fixed catalogs that the registered queries apply to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rule catalog, indicators, services and event rules of the queries.
RULE_VALUES = """
 (1, 'tcp',  '9000001', 'tcp any',        'test-any',     cast(null as string), cast(null as string), cast(null as bigint)),
 (2, 'tcp',  '9000002', 'tcp big',        'test-size',    null,   '>', 4000),
 (3, 'udp',  '9000003', 'udp small',      'test-size',    null,   '<', 500),
 (4, 'tcp',  '9000004', 'content the',    'test-content', 'the',  null, null),
 (5, 'ip',   '9000005', 'generic ip big', 'test-size',    null,   '>', 6000),
 (6, 'http', '9000006', 'content+size',   null,           'http', '>', 1000)
"""
INTEL_VALUES = """
 ('10.0.0.50', 'ip'), ('192.168.1.100', 'ip'), ('185.220.101.1', 'ip'), ('45.146.164.0/24', 'cidr')
"""
SERVICE_VALUES = """
 (21, 'FTP', 'high'), (22, 'SSH', 'low'), (23, 'Telnet', 'critical'), (25, 'SMTP', 'medium'),
 (53, 'DNS', 'low'), (80, 'HTTP', 'medium'), (443, 'HTTPS', 'low')
"""
EVENT_RULE_VALUES = """
 ('9100001', 'error seen', 'error'), ('9100002', 'sign-up seen', 'signup'),
 ('9100003', 'second error rule', 'error'), ('9100004', 'never', 'no-such-event')
"""
HEAD_RULE_VALUES = """
 (1, 'tcp', '9200001', '$HOME_NET',          'any',          'any',                      '$WEB_PORTS'),
 (2, 'ip',  '9200002', '!10.0.0.0/26',       '1024:20000',   '45.146.164.0/24',          'any'),
 (3, 'udp', '9200003', 'any',                'any',          '[192.168.1.0/25,!192.168.1.100]', '![80,443]'),
 (4, 'tcp', '9200004', '[10.0.0.1,10.0.0.2]', '60000:',      '!$BAD_NET',                ':1023')
"""
VARIABLES = {
    "HOME_NET": "[10.0.0.0/27,10.0.0.64/27]",
    "BAD_NET": "45.146.164.0/24",
    "TLS_PORTS": "443",
    "WEB_PORTS": "[80,$TLS_PORTS,8000:8009]",
}


def values(spark: SparkSession, text: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({columns})")


def rules(spark: SparkSession) -> DataFrame:
    raw = values(
        spark,
        RULE_VALUES,
        "rule_key, rule_proto, sid, msg, classtype, content, dsize_op, dsize_n",
    )
    return raw.selectExpr(
        "cast(rule_key as bigint) as rule_key",
        "rule_proto",
        "sid",
        "msg",
        "coalesce(classtype, 'unknown') as rule_class",
        "content",
        "dsize_op",
        "dsize_n",
    )


def head_rules(spark: SparkSession) -> DataFrame:
    raw = values(
        spark,
        HEAD_RULE_VALUES,
        "rule_key, rule_proto, sid, rule_src, rule_sport, rule_dst, rule_dport",
    )
    return raw.selectExpr(
        "cast(rule_key as bigint) as rule_key",
        "rule_proto",
        "sid",
        "concat('head ', sid) as msg",
        "'test-head' as rule_class",
        "cast(null as string) as content",
        "cast(null as string) as dsize_op",
        "cast(null as bigint) as dsize_n",
        "rule_src",
        "rule_sport",
        "rule_dst",
        "rule_dport",
    )


def intel(spark: SparkSession) -> DataFrame:
    return values(spark, INTEL_VALUES, "indicator, kind")


def services(spark: SparkSession) -> DataFrame:
    return values(spark, SERVICE_VALUES, "port, service, risk")


def event_rules(spark: SparkSession) -> DataFrame:
    return values(spark, EVENT_RULE_VALUES, "sid, msg, event_name")
