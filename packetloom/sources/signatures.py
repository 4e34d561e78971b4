"""Signature text (named sets of strings with a k-of-them condition) → table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One signature: from its head to the next head or the end of the text. The
# header starts a line; tags are optional.
_BLOCK = r"(?ms)^\s*(?:private\s+|global\s+)*rule\s+\w+.*?(?=^\s*(?:private\s+|global\s+)*rule\s+\w+|\z)"
_STRING = r'(?m)^\s*\$\w*\s*=\s*"((?:[^"\\]|\\.)*)"'
_META = r'(?m)^\s*(\w+)\s*=\s*("(?:[^"\\]|\\.)*"|\S+)\s*$'


def signature_files(spark: SparkSession, folder: str, pattern: str = "*.yar") -> DataFrame:
    return (
        spark.read.option("pathGlobFilter", pattern)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    )


def signatures(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per signature: name, tags, meta, strings and k.

    ``k of them`` gives k; ``any of them`` 1; ``all of them`` the number of
    strings. Regex signatures have no plain strings and k is NULL.
    """
    keep = [c for c in texts.columns if c != text]
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    blocks = texts.select(
        *keep, F.explode(F.regexp_extract_all(bare, F.lit(_BLOCK), F.lit(0))).alias("_b")
    )
    head = F.substring_index("_b", "{", 1)
    meta = F.regexp_extract("_b", r"(?s)meta:(.*?)(?:strings:|condition:)", 1)
    strings = F.regexp_extract("_b", r"(?s)strings:(.*?)condition:", 1)
    condition = F.regexp_extract("_b", r"(?s)condition:(.*)", 1)
    cut = blocks.select(
        *keep,
        F.regexp_extract(head, r"rule\s+(\w+)", 1).alias("name"),
        F.filter(
            F.split(F.trim(F.regexp_extract(head, r"(?s):(.*)", 1)), r"\s+"), lambda t: t != ""
        ).alias("tags"),
        F.regexp_extract_all(meta, F.lit(_META), F.lit(1)).alias("_k"),
        F.transform(
            F.regexp_extract_all(meta, F.lit(_META), F.lit(2)),
            lambda v: F.regexp_replace(v, r'^"|"$', ""),
        ).alias("_v"),
        F.transform(
            F.regexp_extract_all(strings, F.lit(_STRING), F.lit(1)),
            lambda s: F.regexp_replace(s, r'\\(["\\])', "$1"),
        ).alias("strings"),
        F.regexp_extract(condition, r"(\w+)\s+of\s+them", 1).alias("_of"),
    )
    names = F.array_distinct("_k")
    values = F.transform(
        names, lambda n: F.element_at(F.col("_v"), F.array_position("_k", n).cast("int"))
    )
    return cut.select(
        *keep,
        "name",
        "tags",
        F.map_from_arrays(names, values).alias("meta"),
        "strings",
        F.when(F.col("_of") == "any", 1)
        .when(F.col("_of") == "all", F.size("strings"))
        .otherwise(F.col("_of").try_cast("int"))
        .alias("k"),
    )
