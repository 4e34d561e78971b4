"""Indicator lists and the threat-intel table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import schema


def indicator_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"), F.lit(kind).alias("kind"))


def indicators(lines: DataFrame, *, keep_raw: bool = False) -> DataFrame:
    """Distinct ``(indicator, kind)``.

    Comments and blanks are left out unless ``keep_raw``, which keeps every
    trimmed line as an indicator. Address ranges get kind ``cidr`` when cleaned.
    """
    trimmed = lines.select(
        F.regexp_replace("line", r"^\s+|\s+$", "").alias("indicator"), "kind"
    )
    if keep_raw:
        return trimmed.distinct()
    clean = trimmed.filter((F.col("indicator") != "") & ~F.col("indicator").startswith("#"))
    is_range = (F.col("kind") == "ip") & F.col("indicator").contains("/")
    return clean.withColumn("kind", F.when(is_range, "cidr").otherwise(F.col("kind"))).distinct()


def load_indicators(
    spark: SparkSession, ip_path: str, domain_path: str, *, keep_raw: bool = False
) -> DataFrame:
    lines = indicator_lines(spark, ip_path, "ip").unionByName(
        indicator_lines(spark, domain_path, "domain")
    )
    return indicators(lines, keep_raw=keep_raw)


def indicator_counts(intel: DataFrame) -> DataFrame:
    return intel.groupBy("kind").agg(F.count(F.lit(1)).alias("indicators"))


def threat_intel_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored threat-intel records."""
    return spark.read.schema(schema.THREAT_INTEL).parquet(path).select(*schema.THREAT_INTEL.names)
