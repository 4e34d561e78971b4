"""op8: secrets in documents after the forest has removed false positives."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.llm import secret_forest
from packetloom.llm.tables import table
from packetloom.plans.registry import query


@query("op8_secret_forest")
def op8_secret_forest(spark, folder):
    """Each finding with the digest of its value, so that the result holds no secret."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_forest.secrets(docs)
    return found.select("doc_id", "nth", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability")
