"""op3: language-model scores of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from packetloom.llm import lattice_lm
from packetloom.llm.language_queries import remainder
from packetloom.llm.tables import table
from packetloom.plans.registry import query


@query("op3_lattice_lm")
def op3_lattice_lm(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = lattice_lm.score(docs, path, remainder("doc_id", 7) != 2)
    return found.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        "lattice_score",
    )
