"""Alert records, JSON log lines and the alert table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import schema
from packetloom.functions.timing import utc_text

# Column defaults of the alert table for fields a record lacks.
TABLE_COLUMNS = (
    ("sid", "sid", "string", ""),
    ("msg", "msg", "string", ""),
    ("src", "src_ip", "string", ""),
    ("dst", "dst_ip", "string", ""),
    ("sport", "src_port", "int", 0),
    ("dport", "dst_port", "int", 0),
    ("proto", "protocol", "string", ""),
    ("threat_score", "threat_score", "int", 0),
    ("escalated", "escalated", "boolean", False),
    ("packet_size", "packet_size", "int", 0),
    ("rule_class", "rule_class", "string", ""),
)


def alert_json(fields: list[str]) -> Column:
    """The record as JSON text; present NULLs are written as null."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def alert_records(alerts: DataFrame) -> DataFrame:
    """Alerts under the field names of the JSON record, identity kept in front."""
    return alerts.select(
        "packet_id",
        "rule_key",
        "ts",
        "sid",
        "msg",
        F.col("src_ip").alias("src"),
        F.col("dst_ip").alias("dst"),
        "sport",
        "dport",
        F.col("protocol").alias("proto"),
        "threat_score",
        "escalated",
        "packet_size",
        "rule_class",
    )


def table_rows(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Alert records → table columns plus a raw JSON copy.

    A field the records do not have at all takes its default; a field that is
    present but NULL stays NULL.
    """
    present = [f for f, *_ in TABLE_COLUMNS if f in records.columns]
    columns = [
        (F.col(field) if field in present else F.lit(default)).cast(kind).alias(column)
        for field, column, kind, default in TABLE_COLUMNS
    ]
    return records.select(*keep, *columns, alert_json(present).alias("raw_data"))


def with_row_defaults(rows: DataFrame, *identity: str) -> DataFrame:
    """Add a row id, the 128-bit digest of the columns that identify the alert, and the ingest time."""
    key = F.md5(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}))
    return rows.select(key.alias("alert_id"), F.current_timestamp().alias("ingested_at"), "*")


def append_table(rows: DataFrame, path: str, day_of: str | None = None) -> None:
    """Append to the alert table, by day when a timestamp column is named."""
    if day_of is None:
        rows.write.mode("append").parquet(path)
        return
    dated = rows.withColumn("alert_day", F.to_date(day_of))
    dated.write.mode("append").partitionBy("alert_day").parquet(path)


def read_back(rows: DataFrame, raw: str = "raw_data", out: str = "record") -> DataFrame:
    """Parse the JSON copy; empty text gives a record without values."""
    text = F.when(F.coalesce(F.col(raw), F.lit("")) != "", F.col(raw)).otherwise("{}")
    return rows.withColumn(out, F.from_json(text, schema.ALERT_JSON))


def log_lines(
    records: DataFrame, fields: list[str], at: str, level: str = "INFO", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``time LEVEL {json}`` lines, the time in UTC."""
    stamp = utc_text(F.col(at), "yyyy-MM-dd HH:mm:ss,SSS")
    line = F.concat_ws(" ", stamp, F.lit(level), alert_json(fields))
    return records.select(*keep, line.alias("value"))


def write_log(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def replay(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Log lines → alert records; other lines are left out."""
    shape = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) (\w+) (\{.*\})$"
    return (
        lines.filter(F.col(line).rlike(shape))
        .select(
            *keep,
            F.regexp_extract(line, shape, 1).alias("logged_at"),
            F.regexp_extract(line, shape, 2).alias("level"),
            F.from_json(F.regexp_extract(line, shape, 3), schema.ALERT_JSON).alias("_r"),
        )
        .select(*keep, "logged_at", "level", "_r.*")
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return replay(spark.read.text(path))
