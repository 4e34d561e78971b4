"""The given tables, with the columns their files have, and columns put out of the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def set_apart(df: DataFrame, *kept: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but ``kept`` under names of their own, and the way back.

    Whatever an operator adds in between then replaces no column of the input.
    """
    names = [c if c in kept else f"__own_{i}" for i, c in enumerate(df.columns)]
    old = df.columns
    return df.toDF(*names), lambda out: out.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, old)])


def first_by_hash(df: DataFrame, group: str, of: list[str], n: int) -> DataFrame:
    """Of each group at most ``n`` rows that differ in ``of``: those that come first by hash.

    For few groups, the labels of a model. Rows beyond a bound on the hash, from the number of different ones in the group, go before
    any are brought together, and equal ones are merged in each task, so neither a group nor
    one row with a large share of the table meets in a task.
    """
    df = df.where(F.col(f"`{group}`").isNotNull()).withColumn("_hash", F.xxhash64(*of))
    sizes = df.groupBy(F.col(f"`{group}`").alias("_group")).agg(F.approx_count_distinct("_hash").alias("_size"))
    bound = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(2.0 * n + 200) / F.col("_size"))
    # one row per group, and a model has weights for each of its groups anyway
    bounds = F.broadcast(sizes.select("_group", bound.alias("_bound")))
    near = df.join(bounds, F.col(f"`{group}`") == F.col("_group"))
    near = near.where(F.col("_hash").cast("double") <= F.col("_bound")).drop("_group", "_bound")
    order = Window.partitionBy(group).orderBy("_hash", *of)
    once = near.dropDuplicates([group, *of])
    return once.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n", "_hash")
