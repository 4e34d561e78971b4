"""Rule text → rule table.

The text rules of this format, kept as they are: only lines that start with
``alert`` count; the head before the first ``(`` needs seven words; options are
cut at every ``;`` (inside quotes too); options without ``:`` are dropped; of a
repeated option the last one stays; one line is one rule.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD = ("action", "proto", "src", "sport", "direction", "dst", "dport")
# Options on a flow's variables. A rule may have several; all are kept, in order.
STATE_OPTIONS = ("flowbits", "flowint")
DEFAULT_MSG = "Suspicious traffic detected"
DEFAULT_SID = "0"
DEFAULT_CLASS = "unknown"


def rule_lines(spark: SparkSession, folder: str, pattern: str = "*.rules") -> DataFrame:
    """Trimmed lines of every file of a pattern directly in a folder, without
    blanks and comments; a missing folder gives no rows."""
    try:
        raw = spark.read.option("pathGlobFilter", pattern).text(folder)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], "rule_file string, line string")
    return clean_lines(
        raw.select(F.col("_metadata.file_name").alias("rule_file"), F.col("value").alias("line"))
    )


def clean_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    trimmed = _strip(F.col(line))
    return lines.withColumn(line, trimmed).filter(
        (F.col(line) != "") & ~F.col(line).startswith("#")
    )


def _strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def option_entries(line: Column) -> Column:
    """Options of a rule line as an array of (name, value), flags left out."""
    body = F.regexp_replace(F.substr(line, F.instr(line, "(") + 1), r"^\)+|\)+$", "")
    parts = F.filter(F.split(body, ";"), lambda o: F.instr(o, ":") > 0)
    return F.transform(
        parts,
        lambda o: F.struct(
            _strip(F.substring_index(o, ":", 1)).alias("name"),
            F.regexp_replace(
                _strip(F.substr(o, F.instr(o, ":") + 1)), r'^"+|"+$', ""
            ).alias("value"),
        ),
    )


def last_value(entries: Column, name: str) -> Column:
    """Value of an option, the last one where it is repeated; NULL where absent."""
    named = F.filter(entries, lambda e: e["name"] == name)
    return F.try_element_at(named, F.lit(-1))["value"]


def option_map(entries: Column) -> Column:
    """Entries as a map, last entry of a name winning.

    Done with arrays so that it does not depend on the session's policy for
    repeated map keys.
    """
    names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
    values = F.transform(
        names, lambda n: F.element_at(F.filter(entries, lambda e: e["name"] == n), -1)["value"]
    )
    return F.map_from_arrays(names, values)


def has_flag(line: Column, flag: str) -> Column:
    """Whether an option without value, such as ``noalert``, stands in the line."""
    body = F.substr(line, F.instr(line, "(") + 1)
    flags = F.transform(F.split(body, ";"), lambda o: _strip(F.regexp_replace(o, r"\)+$", "")))
    return F.array_contains(flags, flag)


def any_action(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with their first word as ``action``, for routing by action."""
    return lines.withColumn("action", F.substring_index(F.col(line), " ", 1))


def parse_rules(lines: DataFrame, line: str = "line") -> DataFrame:
    """Structured rules of the well-formed ``alert`` lines.

    A size option that starts with ``>`` or ``<`` but holds no whole number
    makes the rule unusable and drops it here; other forms never filter.
    """
    text = F.col(line)
    words = F.split(_strip(F.substring_index(text, "(", 1)), r"\s+")
    # Exploding one-element arrays keeps the filters further down from being pushed
    # below the parse and repeating it.
    shaped = (
        lines.filter(text.startswith("alert") & (F.instr(text, "(") > 0))
        .select("*", F.explode(F.array(words)).alias("_words"))
        .filter(F.size("_words") >= len(HEAD))
        .select("*", F.explode(F.array(option_entries(text))).alias("_entries"))
        .select("*", F.explode(F.array(last_value(F.col("_entries"), "dsize"))).alias("_dsize"))
    )
    entries = F.col("_entries")
    parsed = (
        shaped.withColumn("dsize_op", F.regexp_extract("_dsize", "^[<>]", 0))
        .withColumn("dsize_op", F.when(F.col("dsize_op") != "", F.col("dsize_op")))
        .withColumn(
            "dsize_n",
            F.when(
                F.col("dsize_op").isNotNull(), F.expr("try_cast(trim(substr(_dsize, 2)) as bigint)")
            ),
        )
        .filter(F.col("dsize_op").isNull() | F.col("dsize_n").isNotNull())
    )
    return parsed.select(
        *lines.columns,
        *[F.get("_words", F.lit(i)).alias(f"rule_{h}") for i, h in enumerate(HEAD)],
        option_map(entries).alias("options"),
        last_value(entries, "sid").alias("sid"),
        last_value(entries, "msg").alias("msg"),
        last_value(entries, "content").alias("content"),
        "dsize_op",
        "dsize_n",
        last_value(entries, "classtype").alias("classtype"),
        has_flag(text, "noalert").alias("noalert"),
        F.filter(entries, lambda e: e["name"].isin(*STATE_OPTIONS)).alias("state_options"),
    )


def rule_table(rules: DataFrame, file: str = "rule_file", line: str = "line") -> DataFrame:
    """The columns the matcher reads, defaults filled in, with a key per rule.

    Equal lines of one file stay separate rules: their copies are numbered.
    """
    copies = Window.partitionBy(file, line).orderBy(F.lit(0))
    return rules.withColumn("_copy", F.row_number().over(copies)).select(
        F.xxhash64(file, line, "_copy").alias("rule_key"),
        F.col("rule_proto"),
        F.coalesce("sid", F.lit(DEFAULT_SID)).alias("sid"),
        F.coalesce("msg", F.lit(DEFAULT_MSG)).alias("msg"),
        F.coalesce("classtype", F.lit(DEFAULT_CLASS)).alias("rule_class"),
        "content",
        "dsize_op",
        "dsize_n",
        *[f"rule_{h}" for h in ("src", "sport", "dst", "dport")],
        "noalert",
        "options",
        "state_options",
    )


def load_rules(spark: SparkSession, folder: str, pattern: str = "*.rules") -> DataFrame:
    return rule_table(parse_rules(rule_lines(spark, folder, pattern)))


def rules_per_file(rules: DataFrame, file: str = "rule_file") -> DataFrame:
    return rules.groupBy(file).agg(F.count(F.lit(1)).alias("rules"))


def references(rules: DataFrame, *keep: str) -> DataFrame:
    """One row per ``reference:type,id`` of a rule (a rule may name several)."""
    found = F.filter(option_entries(F.col("line")), lambda e: e["name"] == "reference")
    return rules.select(*keep, F.explode(found).alias("_ref")).select(
        *keep,
        _strip(F.substring_index("_ref.value", ",", 1)).alias("ref_type"),
        _strip(F.expr("substr(_ref.value, instr(_ref.value, ',') + 1)")).alias("ref_id"),
    )


def resolve_variables(variables: Mapping[str, str]) -> dict[str, str]:
    """Variables with the variables inside their values filled in, lists flattened."""

    def flat(value: str, seen: tuple[str, ...]) -> str:
        for name in sorted(variables, key=len, reverse=True):
            if f"${name}" in value:
                if name in seen:
                    raise ValueError(f"variable {name} refers to itself")
                value = value.replace(f"${name}", flat(variables[name], (*seen, name)))
        negated = value.startswith("!")
        if "[" in value and "!" not in value.lstrip("!"):
            value = "[" + value.lstrip("!").replace("[", "").replace("]", "") + "]"
            value = "!" + value if negated else value
        return value

    return {name: flat(value, (name,)) for name, value in variables.items()}
