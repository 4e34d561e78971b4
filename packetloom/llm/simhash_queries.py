"""op2: SimHash fingerprints and their components."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.llm import simhash
from packetloom.llm.tables import table
from packetloom.plans.registry import query


@query("op2_simhash")
def op2_simhash(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=4, max_bits=4)
    text = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")
