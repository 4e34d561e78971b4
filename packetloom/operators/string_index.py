"""Which strings of a large catalog occur in texts: an equi-join on the strings' rarest grams.

Every string is listed under one run of three characters, the one that fewest strings of the
catalog share; shorter strings under themselves. A text has each of its runs once as join key,
so it meets only strings whose rarest run it has, and those are looked for in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Strings up to which texts travel with their grams; beyond, candidates fetch their texts.
CARRIED = 100_000
#: Distinct grams up to which texts are searched for just these.
FEW_GRAMS = 64


def grams(text: Column, length: int) -> Column:
    """All runs of ``length`` characters of a text, each once; the empty run is in every text."""
    if length == 0:
        return F.when(text.isNotNull(), F.array(F.lit("")))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), 1))


def listed_by_gram(strings: DataFrame, string: str) -> DataFrame:
    """Distinct non-null strings of a catalog with their ``_gram``."""
    each = strings.select(F.col(string).alias("_string")).where("_string is not null").distinct()
    size = F.char_length("_string")
    long, short = each.where(size >= GRAM), each.where(size < GRAM)
    cut = long.select("_string", F.explode(grams(F.col("_string"), GRAM)).alias("_gram"))
    shared = cut.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = cut.join(shared, "_gram").groupBy("_string").agg(F.min(F.struct("_n", "_gram")).alias("_b"))
    return rarest.select("_string", "_b._gram").unionByName(short.select("_string", F.col("_string").alias("_gram")))


def probes(text: Column, listed: DataFrame) -> Column | None:
    """The grams of a text that a catalog can list, each once; None for an empty catalog.

    Of a catalog with few grams only these are looked for, of others all runs are taken.
    """
    some = [r[0] for r in listed.select("_gram").distinct().limit(FEW_GRAMS + 1).collect()]
    if not some:
        return None
    if len(some) > FEW_GRAMS:
        lengths = [r[0] for r in listed.select(F.char_length("_gram")).distinct().collect()]  # four at most
        return F.flatten(F.array_compact(F.array(*[grams(text, n) for n in sorted(lengths)])))
    found = [grams(text, 0)] if "" in some else []
    for length in sorted({len(g) for g in some} - {0}):
        quoted = "|".join("\\Q" + g.replace("\\E", "\\E\\\\E\\Q") + "\\E" for g in some if len(g) == length)
        found.append(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({quoted}))"), 1)))
    return F.flatten(F.array_compact(F.array(*found)))


def occurring(
    texts: DataFrame, strings: DataFrame, *, text: str, string: str, on: Sequence[Column] = (), keys: Sequence[str] = ()
) -> DataFrame:
    """Texts joined with the rows of ``strings`` whose ``string`` they contain.

    ``on`` are further conditions over both sides. No column name may be on both sides. Texts
    go with their grams where Spark can broadcast the catalog; for larger ones candidates are
    found with ``keys`` alone, which must tell texts apart, and then fetch their texts.
    """
    listed = listed_by_gram(strings, string)
    met = probes(F.col(text), listed)
    if met is None:
        return texts.join(strings, F.lit(False))
    known = strings.join(listed, F.col(string) == F.col("_string")).drop("_string")
    found = F.contains(F.col(text), F.col(string))
    cut = F.explode(met).alias("_probe")
    condition = F.col("_probe") == F.col("_gram")
    for more in on:
        condition = condition & more
    if not keys or strings.count() <= CARRIED:
        return texts.select("*", cut).join(known, condition & found).drop("_probe", "_gram")
    narrow = [c for c in texts.columns if c != text]
    near = texts.select(*narrow, cut).join(known, condition).select(*keys, *strings.columns)
    named = near.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = found
    for k in keys:
        same = same & (F.col(k) == F.col(f"_of_{k}"))
    return texts.join(named, same).drop(*[f"_of_{k}" for k in keys])
