"""The detection plan: match, correlate, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.correlate import HITS, WINDOW_SECONDS, apply_escalation, mark_escalated
from packetloom.operators.lookup import score_indicators
from packetloom.operators.match import match_packets
from packetloom.operators.rollup import severity_by
from packetloom.session import written
from packetloom.sources.packets import ipv4_only, with_text_payload


def detect(
    packets: DataFrame,
    rules: DataFrame,
    intel: DataFrame,
    *,
    window_seconds: float = WINDOW_SECONDS,
    hits: int = HITS,
    staged: bool = True,
) -> DataFrame:
    """Correlated alerts: ``intel_score`` is un-escalated, ``threat_score`` final.

    Correlation reads the alerts three times. Unless ``staged`` is off, the narrow
    alerts are written once, so the payloads are read and searched once only.
    """
    matched = match_packets(ipv4_only(with_text_payload(packets)), rules)
    if staged:
        matched = written(matched, "alerts")
    marked = mark_escalated(matched, window_seconds=window_seconds, hits=hits)
    scored = score_indicators(marked, intel)
    return apply_escalation(scored.withColumn("threat_score", F.col("intel_score")))


def severity_by_signature(alerts: DataFrame) -> DataFrame:
    return severity_by(alerts, "sid")
