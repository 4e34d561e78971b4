"""Schemas of the records that cross a source or sink boundary."""

from __future__ import annotations

from pyspark.sql import types as T

PACKETS = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("proto", T.StringType()),
        T.StructField("sport", T.IntegerType()),
        T.StructField("dport", T.IntegerType()),
        T.StructField("packet_size", T.IntegerType()),
        T.StructField("payload", T.StringType()),
    ]
)
# As files hold them: the payload is bytes.
PACKET_FILES = T.StructType(
    [T.StructField(f.name, T.BinaryType() if f.name == "payload" else f.dataType) for f in PACKETS]
)

# The JSON record of one alert, as it is logged and kept in ``raw_data``.
ALERT_JSON = T.StructType(
    [
        T.StructField("sid", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("sport", T.IntegerType()),
        T.StructField("dport", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("threat_score", T.IntegerType()),
        T.StructField("escalated", T.BooleanType()),
        T.StructField("packet_size", T.IntegerType()),
        T.StructField("rule_class", T.StringType()),
    ]
)

THREAT_INTEL = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("threat_type", T.StringType()),
        T.StructField("confidence", T.IntegerType()),
        T.StructField("source", T.StringType()),
    ]
)

# The given tables.
TABLES = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
        " l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
