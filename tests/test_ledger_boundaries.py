"""Boundaries of gaps, windows and ties."""

from __future__ import annotations

import pytest

from tallyspark.operators import ledger

SCHEMA = "fill_id long, condition_id string, side string, outcome string, size double, price double, timestamp_ms long"


def fills(spark, *rows):
    return spark.createDataFrame([(i, "m", side, outcome, 1.0, 0.5, t) for i, (side, outcome, t) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(("gap", "n"), [(3000, 1), (3001, 2)])
def test_gap_is_strict(spark, gap, n):
    assert ledger.episodes(fills(spark, ("BUY", "Up", 1000), ("BUY", "Up", 1000 + gap)), 3000).count() == n


def test_opposite_fill_does_not_split(spark):
    got = ledger.episodes(fills(spark, ("BUY", "Up", 1000), ("BUY", "Down", 2000), ("BUY", "Up", 3000)), 3000)
    assert sorted((r["outcome"], r["fills"]) for r in got.collect()) == [("Down", 1), ("Up", 2)]


@pytest.mark.parametrize(("after", "label"), [(0, 0), (1, 1), (30000, 1), (30001, 0)])
def test_label_window(spark, after, label):
    f = fills(spark, ("BUY", "Up", 1000), ("BUY", "Down", 2000), ("BUY", "Down", 2000 + after)) if after else fills(spark, ("BUY", "Up", 1000), ("BUY", "Down", 2000))
    opposite = ledger.first_opposite(ledger.episodes(f, 0), ledger.initial_direction(f))
    assert ledger.forward_label(f, opposite, 30000).first()["label"] == label


def test_same_time_is_ambiguous(spark):
    f = fills(spark, ("BUY", "Up", 1000), ("BUY", "Down", 1000))
    markets = spark.createDataFrame([("m", 0, 300000), ("n", 0, 1)], "condition_id string, market_start_ms long, market_end_ms long")
    got = {r["condition_id"]: r for r in ledger.event_ledger(f, markets, 3000, 30000, 0).collect()}
    assert got["m"]["exclude_reason"] == "SAME_SECOND_DIRECTION_AMBIGUITY" and got["m"]["initial"] is None and got["n"]["exclude_reason"] == "NO_BUY"


def test_anchors_rest(spark):
    rows = spark.createDataFrame([("k", t) for t in (0, 999, 1000, 1999, 2000, 2500)], "k string, t long")
    assert sorted(r["t"] for r in ledger.refractory_anchors(rows, "k", "t", 1000).collect()) == [0, 1000, 2000]


def test_unclosed_interval(spark):
    rows = spark.createDataFrame([("s", 1, "connected", 10), ("s", 2, "connection_error", 20), ("s", 3, "subscribed", 30)], "session_id string, seq long, event string, timestamp_ms long")
    assert ledger.connection_intervals(rows).first()["end_ms"] == 20 and ledger.connection_intervals(rows, False).first()["end_ms"] is None
