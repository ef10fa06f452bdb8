"""Timelines, endpoints, buckets, distributions and operations summaries of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import calendar_keys
from tallyspark.operators.audits import _finite, unpivoted
from tallyspark.operators.scans import DAY_MS, time_block, two_level
from tallyspark.operators.temporal_joins import asof_backward


def endpoint_values(windows: DataFrame, points: DataFrame, key: str, ms: str, value: str, seq: str, tolerance_ms: int) -> DataFrame:
    """window columns with start_value and end_value: the last point at or before each end of a window; of points with the same time the first one.

    windows: key, start_ms, end_ms. The start's value is dropped when it is older than tolerance_ms, the end's never.
    """
    firsts = points.where(F.col(value).isNotNull() & F.col(ms).isNotNull()).groupBy(key, ms).agg(F.min_by(value, seq).alias(value))
    both = windows.select("*", F.explode(F.array(F.lit("start"), F.lit("end"))).alias("_end")).withColumn("_ms", F.when(F.col("_end") == "start", F.col("start_ms")).otherwise(F.col("end_ms")))
    at = asof_backward(both, firsts.withColumnRenamed(ms, "_ms"), key, "_ms", [value])
    kept = F.when((F.col("_end") == "end") | (F.col("age_ms") <= tolerance_ms), F.col(value))
    pick = lambda name: F.max(F.when(F.col("_end") == name, kept)).alias(f"{name}_value")
    return at.groupBy(*windows.columns).agg(pick("start"), pick("end"))


def normalised_book(book: DataFrame) -> DataFrame:
    """Valid rows of book in terms of Up: bid, ask, mid, spread, depths of the given levels and their imbalance (null without depth).

    A Down row is mirrored: its prices count from 1 and its sides change places.
    book: outcome, best_bid, best_ask, mid, bids, asks (levels with size), book_state_valid; other columns stay.
    """
    depth = lambda c: F.aggregate(F.coalesce(F.col(c), F.array().cast(book.schema[c].dataType)), F.lit(0.0), lambda s, x: s + F.coalesce(x["size"], F.lit(0.0)))
    rows = book.where("book_state_valid").withColumn("_b", depth("bids")).withColumn("_a", depth("asks"))
    down = F.col("outcome") == "Down"
    turn = lambda up, other: F.when(down, other).otherwise(up)
    rows = rows.withColumns({"up_bid": turn(F.col("best_bid"), 1 - F.col("best_ask")), "up_ask": turn(F.col("best_ask"), 1 - F.col("best_bid")), "up_mid": turn(F.col("mid"), 1 - F.col("mid")), "bid_depth": turn(F.col("_b"), F.col("_a")), "ask_depth": turn(F.col("_a"), F.col("_b"))})
    whole = F.nullif(F.col("bid_depth") + F.col("ask_depth"), F.lit(0.0))
    return rows.withColumn("spread", F.col("up_ask") - F.col("up_bid")).withColumn("obi", (F.col("bid_depth") - F.col("ask_depth")) / whole).drop("_a", "_b", "bids", "asks", "best_bid", "best_ask", "mid")


def timeline(ticks: DataFrame, book: DataFrame, market: str, start_ms: Column | int, end_ms: Column | int) -> DataFrame:
    """Ticks and valid book rows of [start_ms, end_ms) of each market in one order: event, receive, source, line; place counts from 0.

    ticks: market, event_ms, receive_ms, line, price. book: market, event_ms, receive_ms, line and normalised_book()'s input.
    """
    a = ticks.select(market, "event_ms", "receive_ms", F.lit("BTC").alias("source"), "line", "price")
    b = normalised_book(book).select(market, "event_ms", "receive_ms", F.lit("PM").alias("source"), "line", "up_bid", "up_ask", "up_mid", "spread", "bid_depth", "ask_depth", "obi")
    bound = lambda x: x if isinstance(x, Column) else F.lit(x)
    both = a.unionByName(b, allowMissingColumns=True).where((F.col("event_ms") >= bound(start_ms)) & (F.col("event_ms") < bound(end_ms)))
    out = two_level(both, [market], time_block("event_ms"), ["event_ms", "receive_ms", "source", "line"], {"place": ("sum", F.lit(1))})
    return out.withColumn("place", F.col("place") - 1)


def ready_at(instants: DataFrame, intervals: DataFrame, key: str, at: str) -> DataFrame:
    """key, at, sessions: how many sessions have an interval that holds the instant. intervals: session, lo_ms, hi_ms; met by day."""
    day = lambda c: F.floor(F.col(c) / DAY_MS)
    spread = intervals.where("hi_ms >= lo_ms").select("*", F.explode(F.sequence(day("lo_ms"), day("hi_ms"))).alias("_day"))
    met = instants.select(key, at, day(at).alias("_day")).join(spread, "_day").where((F.col("lo_ms") <= F.col(at)) & (F.col("hi_ms") >= F.col(at)))
    found = met.groupBy(key, at).agg(F.count_distinct("session").alias("sessions"))
    return instants.select(key, at).join(found, [key, at], "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))


def market_lifecycle(markets: DataFrame, feeds: dict[str, DataFrame], key: str) -> DataFrame:
    """key, <feed>_start, <feed>_end (sessions that are connected there), lifecycle: FULL_LIFECYCLE_MARKET if every feed is ready at both ends.

    markets: key, start_ms, end_ms. Gaps between the ends don't matter here.
    """
    out = markets
    for name, intervals in feeds.items():
        for end in ("start", "end"):
            got = ready_at(markets.select(key, F.col(f"{end}_ms").alias("_at")), intervals, key, "_at").select(key, F.col("sessions").alias(f"{name}_{end}"))
            out = out.join(got, key)
    full = F.lit(True)
    for name in feeds:
        full = full & (F.col(f"{name}_start") > 0) & (F.col(f"{name}_end") > 0)
    return out.withColumn("lifecycle", F.when(full, "FULL_LIFECYCLE_MARKET").otherwise("PARTIAL_SESSION_MARKET"))


def temporal_buckets(rows: DataFrame, ms: str, least: int) -> DataFrame:
    """kind (day or week), bucket: markets, opposed, observable, positive, censored, rate, medians, and low_n for weeks with fewer than least markets.

    rows: ms, opposed, eligible, label, quantity, seconds; rows without a time are left out.
    """
    keys = calendar_keys(F.col(ms))
    spread = rows.where(F.col(ms).isNotNull()).withColumn("_k", F.explode(F.array(F.struct(F.lit("day").alias("kind"), keys["day"].alias("bucket")), F.struct(F.lit("week").alias("kind"), keys["iso_week"].alias("bucket")))))
    seen = F.col("opposed") & F.col("eligible")
    out = spread.groupBy("_k.kind", "_k.bucket").agg(
        F.count("*").alias("markets"), F.count_if("opposed").alias("opposed"), F.count_if(seen).alias("observable"), F.count_if(seen & (F.col("label") == 1)).alias("positive"), F.count_if(F.col("opposed") & ~F.coalesce(F.col("eligible"), F.lit(False))).alias("censored"),
        F.percentile("quantity", F.lit(0.5)).alias("median_quantity"), F.percentile("seconds", F.lit(0.5)).alias("median_seconds"),
    )
    return out.withColumn("rate", F.col("positive") / F.nullif("observable", F.lit(0))).withColumn("low_n", (F.col("kind") == "week") & (F.col("markets") < least))


def distribution_summary(rows: DataFrame, fields: list[str], groups: list[str]) -> DataFrame:
    """groups, feature, count, mean, std (of two values or more), p01, p05, median, p95, p99 of the finite values of every field; null groups stay."""
    long = unpivoted(rows, groups, fields).withColumn("value", _finite())
    p = [F.percentile("value", F.lit(s)).alias(n) for s, n in ((0.01, "p01"), (0.05, "p05"), (0.5, "median"), (0.95, "p95"), (0.99, "p99"))]
    return long.groupBy(*groups, F.col("variable").alias("feature")).agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), *p)


def provenance_failures(rows: DataFrame, public: list[str]) -> DataFrame:
    """Rows whose newest source is later than it may be: public sources by the cutoff, others (what is known by the prediction itself) by the prediction's time.

    rows: condition_id, feature, source_type, source_max_ms (null: nothing to check), cutoff_ms, prediction_ms.
    """
    limit = F.when(F.col("source_type").isin(*public), F.col("cutoff_ms")).otherwise(F.col("prediction_ms"))
    return rows.withColumn("limit_ms", limit).where("source_max_ms > limit_ms").select("condition_id", "feature", "source_type", "source_max_ms", "limit_ms")


def operations_summary(events: DataFrame, start_ms: int, end_ms: int, window_ms: int, gap_ms: int) -> DataFrame:
    """One row on [start_ms, end_ms]: windows expected, discovered and missed, sessions, records, connects, reconnects, disconnects, seconds in gaps, stale events, status.

    events: session, seq, ms, event, kind. A window is expected if it lies inside whole; it is discovered by any event in
    it. A session's first connect is none of the reconnects. A silence of a session beyond gap_ms is a gap.
    """
    own = events.where(F.col("ms").between(start_ms, end_ms))
    first = -(-start_ms // window_ms)
    expected = max(0, (end_ms - window_ms) // window_ms - first + 1)
    seen = own.select(F.floor(F.col("ms") / window_ms).alias("w")).distinct().where(F.col("w").between(first, first + expected - 1)).agg(F.count("*").alias("discovered_windows"))
    before = two_level(own, ["session"], time_block("ms"), ["ms", "seq"], {"_last": ("last", F.col("ms"))}, inclusive=False)
    gap = F.when(F.col("ms") - F.col("_last") > gap_ms, (F.col("ms") - F.col("_last")) / 1000.0)
    n = lambda *e: F.count_if(F.col("event").isin(*e))
    total = before.agg(
        F.count_distinct("session").alias("sessions"), F.count("*").alias("records"), n("connected").alias("connects"), n("disconnected", "connection_error").alias("disconnects"), n("stale_feed_detected").alias("stale_events"),
        F.coalesce(F.sum(gap), F.lit(0.0)).alias("gap_seconds"), F.count_distinct(F.when(F.col("event") == "connected", F.col("session"))).alias("_c"),
    )
    out = total.crossJoin(F.broadcast(seen)).withColumn("expected_windows", F.lit(expected).cast("long"))  # one row and one row
    out = out.withColumn("missed_windows", F.col("expected_windows") - F.col("discovered_windows")).withColumn("reconnects", F.greatest(F.col("connects") - F.col("_c"), F.lit(0)))
    status = F.when(F.col("records") == 0, "NO_DATA").when((F.col("missed_windows") > 0) | (F.col("gap_seconds") > 0), "DATA_QUALITY_WARNING").otherwise("PASS")
    return out.withColumn("status", status).drop("_c")
