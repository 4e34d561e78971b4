"""op7: what documents share with the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.llm import decontaminate
from packetloom.llm.tables import table
from packetloom.plans.registry import query


@query("op7_decontaminate")
def op7_decontaminate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    items = table(spark, folder, "benchmark").select("item_id", "text")
    found = decontaminate.find_benchmark(docs, items, window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
    )
