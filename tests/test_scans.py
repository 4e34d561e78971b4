"""Counts and sessions read their source twice at most: once to find hot keys, once for the result."""

from __future__ import annotations

import io
import random
from contextlib import redirect_stdout
from datetime import datetime, timedelta

import pytest

from packetloom.operators import correlate, detect
from packetloom.sources.packets import packet_heads


def plan_of(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_one_scan_in_the_plan(spark, data):
    heads = packet_heads(spark, data)
    for df in (
        correlate.sliding_count(heads, "src_ip", tie=["packet_id"], window_seconds=3600),
        detect.sessions(heads, ["src_ip"], idle_seconds=3600),
    ):
        plan = plan_of(df)
        assert plan.count("Scan parquet") - plan.count("full-pieces") <= (1 if "Union" not in plan else 2)
        assert plan.count("SortMergeJoin") + plan.count("HashJoin") + plan.count("NestedLoop") == 0


@pytest.mark.parametrize("piece_rows", [15, 1_000_000])
@pytest.mark.parametrize("slot_seconds", [30, 100, 86_400])
def test_sliding_count_equals_plain_counting(spark, piece_rows, slot_seconds):
    rng, at, rows = random.Random(8), 0, []
    for i in range(400):
        at += rng.choice([0, 0, 1, 20, 59.999999, 60, 61])
        rows.append((i, rng.choice(["a", "a", "a", "b", None]), datetime(2024, 1, 1, 23, 0) + timedelta(seconds=at)))
    df = spark.createDataFrame(rows, "packet_id long, sid string, ts timestamp")
    got = correlate.sliding_count(df, tie=["packet_id"], slot_seconds=slot_seconds, piece_rows=piece_rows)
    want = {i: sum(s == k and (t - u).total_seconds() < 60 and (u, j) <= (t, i) for j, k, u in rows) for i, s, t in rows}
    assert {r.packet_id: r.in_window for r in got.collect()} == want
