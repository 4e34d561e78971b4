"""op4 and op10: token ids in files of planes, and pieces with their source spans."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from packetloom.llm import piece_offsets, token_planes
from packetloom.llm.tables import table
from packetloom.plans.registry import query
from packetloom.session import scratch_path


@query("op4_token_planes")
def op4_token_planes(spark, folder):
    """Spark's crc32 of each document's ids as they are read back."""
    path = scratch_path(spark, "token-planes")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    token_planes.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_planes.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op10_piece_offsets")
def op10_piece_offsets(spark, folder):
    """Digests of ids and of the decoded text, and how many source bytes the pieces cover."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = piece_offsets.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("bytes_covered"),
    )
