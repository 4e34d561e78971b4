"""op1: quality scores from weak labels."""

from __future__ import annotations

from packetloom.llm import quality
from packetloom.llm.tables import table
from packetloom.plans.registry import query


@query("op1_quality")
def op1_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.fit(docs))
    return found.select("doc_id", "weak_label", "quality_score", "keep")
