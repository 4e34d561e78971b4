"""op11: two tokenizers aligned over all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from packetloom.llm import pair_bitmaps
from packetloom.llm.tables import table
from packetloom.plans.registry import query


@query("op11_pair_bitmaps")
def op11_pair_bitmaps(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return pair_bitmaps.align(docs, *files).withColumnRenamed("groups", "groups_sha256")
