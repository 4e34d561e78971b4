"""op9: the language of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.llm import langid_crf
from packetloom.llm.tables import table
from packetloom.plans.registry import query


def remainder(doc_id, by: int):
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


@query("op9_language_crf")
def op9_language_crf(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = langid_crf.fit(docs.where("not held_out"))
    found = langid_crf.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))
