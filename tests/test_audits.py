"""Audits and summaries on small tables: nulls, empty groups, ties, boundaries."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import audits as A
from tallyspark.operators import summaries as M


def test_groups_that_cannot_be_compared(spark):
    rows = [(True, 1.0, 5.0, None, 1.0), (True, 1.0, 5.0, 2.0, 3.0), (False, 2.0, 5.0, None, 1.0), (None, 2.0, 5.0, None, 9.0)]
    df = spark.createDataFrame(rows, "g boolean, differ double, same double, empty double, free double")
    got = {r.variable: r for r in A.compared_groups(df, "g", ["differ", "same", "empty", "free"]).collect()}
    assert (got["differ"].smd, got["differ"].note, got["differ"].magnitude) == (None, "DIFFERENT_CONSTANTS", "undefined")
    assert (got["same"].smd, got["same"].note, got["same"].magnitude) == (0.0, "IDENTICAL_CONSTANTS", "small")
    assert (got["empty"].note, got["empty"].missing_1, got["empty"].missing_0, got["empty"].std_1) == ("EMPTY_GROUP", 1, 2, 0.0)
    assert got["free"].smd == pytest.approx((2 - 5) / math.sqrt((2 + 32) / 2)) and got["free"].magnitude == "material"
    assert A.compared_groups(df.limit(0), "g", ["same"]).count() == 0


def test_two_material_variables_warn(spark):
    df = spark.range(200).select((F.col("id") % 2 == 0).alias("g"), (F.col("id") % 2 + F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2 * 2 + F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 2 * 9 + F.col("id") % 3).cast("double").alias("late"))
    assert {r.status for r in A.selection_bias(df, "g", ["a", "b"], ["late"]).collect()} == {"WARN"}
    assert {(r.status, r.material_pre) for r in A.selection_bias(df, "g", ["a"], ["b", "late"]).collect()} == {("PASS", 1)}


def test_coverage_selection_without_a_group(spark):
    df = spark.createDataFrame([(True, 1, 2.0), (True, 0, 3.0)], "c boolean, y int, x double")
    assert A.coverage_selection(df, "c", "y", ["x"]).first().status == "NOT_COMPARABLE_NO_UNCOVERED"
    assert A.coverage_selection(df.withColumn("c", F.lit(False)), "c", "y", ["x"]).first().status == "NOT_COMPARABLE_NO_COVERED"
    both = df.unionByName(df.selectExpr("NOT c AS c", "y", "x"))
    assert A.coverage_selection(both, "c", "y", ["x"]).first().status == "REPORTED"


def test_drift_of_constant_missing_and_moved_features(spark):
    rows = [("w1", 1.0, 2.0, None), ("w1", 2.0, 2.0, None), ("w2", 1.0, 2.0, 1.0), ("w2", 2.0, 2.0, None), ("w3", 9.0, 3.0, None), ("w3", float("nan"), 2.0, None)]
    df = spark.createDataFrame(rows, "w string, moved double, flat double, gone double")
    got = {(r.feature, r.w): r for r in A.weekly_drift(df, "w", ["moved", "flat", "gone"]).collect()}
    assert got["moved", "w2"].psi == pytest.approx(0) and got["moved", "w2"].label == "LOW" and got["moved", "w3"].label == "MATERIAL"
    assert got["moved", "w3"].missing_rate == 0.5 and got["moved", "w3"]["count"] == 1
    assert got["flat", "w2"].psi == 0.0 and got["flat", "w3"].psi is None and got["flat", "w3"].label == "UNDEFINED"
    assert got["gone", "w2"].label == "UNDEFINED" and got["gone", "w2"].missing_drift == -0.5 and got["gone", "w2"].smd is None


def test_domains_are_exact(spark):
    fields = ["opp_best_bid", "opp_best_ask", "pm_obi_change_5s", "other_obi", "x_depth", "btc_start_price", "free"]
    rows = [
        (1, "1", "1.0", "2.0", "-1", "-0", "0.001", "nan"), (2, "1.00000000000000000000000000001", None, "-2.00000000000000000000000001", "1.1", "-1e-30", "-0.0", None),
        (3, " 0.5 ", "0.4", "1e2", "1e400", "inf", "abc", "x"), (4, None, None, None, None, None, None, None), (5, ".5", "5.", "+1", "1e-50", "0", "1e300", ""),
    ]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{f} string" for f in fields))
    got = sorted((r.id, r.field, r.reason) for r in A.domain_violations(df, "id", fields).collect())
    assert got == sorted([
        (2, "opp_best_bid", "OUT_OF_RANGE"), (2, "pm_obi_change_5s", "OUT_OF_RANGE"), (2, "other_obi", "OUT_OF_RANGE"), (2, "x_depth", "OUT_OF_RANGE"), (2, "btc_start_price", "OUT_OF_RANGE"),
        (3, "pm_obi_change_5s", "OUT_OF_RANGE"), (3, "other_obi", "OUT_OF_RANGE"), (3, "x_depth", "NONFINITE_VALUE"), (3, "btc_start_price", "INVALID_NUMERIC_VALUE"), (3, "crossed_book", "CROSSED_BOOK"), (5, "opp_best_ask", "OUT_OF_RANGE"),
    ])
    one = {(r.id, r.field) for r in A.domain_violations(df, "id", fields, 1).collect()}
    assert (1, "pm_obi_change_5s") in one and (2, "opp_best_bid") not in one and (3, "crossed_book") in one


def test_unknown_hard_flags_block(spark):
    rows = [(True, True, True, 0.9), (None, True, True, 0.9), (False, None, True, 0.1), (True, True, None, 0.1), (True, True, True, 0.1)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, model boolean, p double")
    verdict, why = A.gate({"A": F.col("a"), "B": F.col("b")}, F.col("model"), [(F.col("p") < 0.5, "LOW")])
    assert [tuple(r) for r in df.select(verdict, F.array_join(why, ";")).collect()] == [("ACCEPT", ""), ("BLOCKED", "A"), ("BLOCKED", "A;B"), ("BLOCKED", "MODEL_OUTPUT_UNAVAILABLE"), ("REJECT", "LOW")]


def test_policies_hold_from_their_boundary_on(spark):
    rows = [("c", "FULL_LIFECYCLE_MARKET", 0.99, 100, "fix"), ("c", "FULL_LIFECYCLE_MARKET", 0.99, 99, "fix"), ("c", "FULL_LIFECYCLE_MARKET", 0.99, 100, None), (None, "PARTIAL", None, 200, "fix"), ("c", None, 0.5, None, "fix")]
    df = spark.createDataFrame(rows, "version string, life string, cov double, started long, fix string")
    status, why, included = A.primary_decision(A.eligibility("version", "life", {"BOOK": "cov"}, "c"), "started", 100, "fix", "fix")
    early = "PRE_EFFECTIVE_POLICY_SESSION"
    assert [tuple(r) for r in df.select(status, F.array_join(why, ";"), included).collect()] == [
        ("ELIGIBLE", "", True), ("EXCLUDED", early, False), ("EXCLUDED", early, False), ("EXCLUDED", "COLLECTOR_VERSION_MISMATCH;PARTIAL_SESSION_MARKET;BOOK_COVERAGE_LT_99", False), ("EXCLUDED", early, False),
    ]


def test_null_is_a_group_of_its_own_set(spark):
    df = spark.createDataFrame([("s", "a", None, 1.0), ("s", "a", 1, 3.0), ("s", None, 1, 9.0)], "source string, x string, y int, d double")
    got = {(r.grouping, r.x, r.y): (r.n, r.p50, r.mad) for r in A.latency_by_sets(df, [["x"], ["y"], ["x", "y"], []], "d", [2]).collect()}
    assert got["x", "a", None] == (2, 2.0, 1.0) and got["x", None, None] == (1, 9.0, 0.0) and got["y", None, None] == (1, 1.0, 0.0)
    assert got["x+y", "a", None] == (1, 1.0, 0.0) and got["all", None, None] == (3, 3.0, 2.0) and len(got) == 8


def test_endpoints_take_the_first_of_equal_times(spark):
    windows = spark.createDataFrame([("k", 1000, 9000), ("k", 5000, 6000), ("e", 0, 1)], "k string, start_ms long, end_ms long")
    points = spark.createDataFrame([("k", 500, 2, 2.0), ("k", 500, 1, 1.0), ("k", 8000, 4, 4.0), ("k", 8000, 3, None)], "k string, ms long, seq long, p double")
    got = sorted(tuple(r) for r in M.endpoint_values(windows, points, "k", "ms", "p", "seq", 1000).collect())
    assert got == [("e", 0, 1, None, None), ("k", 1000, 9000, 1.0, 4.0), ("k", 5000, 6000, None, 1.0)]


LEVEL = "array<struct<price:double,size:double>>"


def test_down_books_are_mirrored(spark):
    rows = [("Up", 0.4, 0.5, 0.45, [(0.4, 3.0)], [(0.5, 1.0)], True), ("Down", 0.4, 0.5, 0.45, [(0.4, 3.0), (0.3, None)], [(0.5, 1.0)], True), ("Up", 0.4, 0.5, 0.45, None, [], True), ("Up", 0.4, 0.5, 0.45, [], [], False)]
    out = M.normalised_book(spark.createDataFrame(rows, f"outcome string, best_bid double, best_ask double, mid double, bids {LEVEL}, asks {LEVEL}, book_state_valid boolean")).collect()
    assert len(out) == 3 and (out[0].up_bid, out[0].bid_depth, out[0].obi) == (0.4, 3.0, 0.5)
    assert (out[1].up_bid, out[1].up_ask, round(out[1].up_mid, 9), out[1].bid_depth, out[1].ask_depth, out[1].obi) == (0.5, 0.6, 0.55, 1.0, 3.0, -0.5)
    assert out[2].obi is None and out[2].bid_depth == 0.0


def test_a_market_needs_both_feeds_at_both_ends(spark):
    markets = spark.createDataFrame([(1, 0, 100), (2, 100, 200)], "market long, start_ms long, end_ms long")
    iv = lambda rows: spark.createDataFrame(rows, "session string, lo_ms long, hi_ms long")
    got = {r.market: (r.lifecycle, r.book_start, r.tick_end) for r in M.market_lifecycle(markets, {"book": iv([("a", 0, 10), ("b", 90, 150), ("c", 100, 100)]), "tick": iv([("t", 0, 300)])}, "market").collect()}
    assert got == {1: ("FULL_LIFECYCLE_MARKET", 1, 1), 2: ("PARTIAL_SESSION_MARKET", 2, 1)}


def test_operations_of_an_empty_and_of_a_full_span(spark):
    rows = [("s", 1, 0, "connected"), ("s", 2, 100, "disconnected"), ("s", 3, 900, "connected"), ("t", 4, 950, "connected"), ("t", 5, 5000, "late")]
    df = spark.createDataFrame(rows, "session string, seq long, ms long, event string")
    r = M.operations_summary(df, 0, 1000, 250, 300).first()
    assert (r.expected_windows, r.discovered_windows, r.missed_windows, r.reconnects, r.records, r.gap_seconds, r.status) == (4, 2, 2, 1, 4, 0.8, "DATA_QUALITY_WARNING")
    r = M.operations_summary(df.limit(0), 0, 1000, 250, 300).first()
    assert (r.status, r.records, r.missed_windows) == ("NO_DATA", 0, 4)
