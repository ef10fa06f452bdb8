"""Views over the given tables that carry the event-market schemas: fills, ticks, book rows, sessions, scores.

One second of the market data is one hour here, so that the given tables have events in every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000
WEEK = 604_800_000
#: Episode gap and label horizon on the scale of these views.
GAP, HORIZON = 12 * HOUR, 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp column without zone, whatever the session's zone."""
    d = f"({ts} - timestamp_ntz'1970-01-01 00:00:00')"
    return F.expr(f"extract(day from {d}) * 86400000L + extract(hour from {d}) * 3600000L + extract(minute from {d}) * 60000L + cast(floor(extract(second from {d}) * 1000) as bigint)")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ms, user_id, event_type, value, k."""
    return table(spark, sf_dir, "events").select("event_id", epoch_ms("ts").alias("ms"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def fills(spark: SparkSession, sf_dir: str, unit_ms: int = 1) -> DataFrame:
    """Fills: a market is a user in a week; unit_ms floors the times, to force ties."""
    e = events(spark, sf_dir)
    ms = (F.floor(F.col("ms") / unit_ms) * unit_ms).cast("long")
    week = F.floor(F.col("ms") / WEEK)
    up = F.col("event_type").isin("view", "signup") | ((F.col("event_type") == "purchase") & (F.col("k") % 2 == 0))
    return e.select(
        F.col("event_id").alias("fill_id"), F.concat_ws("-", "user_id", week).alias("condition_id"), F.when(F.col("event_type") == "purchase", "SELL").otherwise("BUY").alias("side"),
        F.when(up, "Up").otherwise("Down").alias("outcome"), F.col("value").alias("size"), ((F.col("k") % 100) / F.lit(100.0)).alias("price"), ms.alias("timestamp_ms"),
        F.concat(F.lit("w7d-"), (week * WEEK / 1000).cast("long")).alias("slug"), (week * WEEK).cast("long").alias("market_start_ms"), ((week + 1) * WEEK).cast("long").alias("market_end_ms"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade ticks, one instrument per user."""
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").cast("string").alias("condition_id"), F.col("ms").alias("exchange_ms"), (F.col("ms") + F.col("k")).alias("receive_ms"), (100 + F.col("value") / 10).alias("price"), F.col("value").alias("size"), (F.col("k") % 2 == 0).alias("buyer_is_maker"), F.col("event_id").alias("trade_id"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-of-book rows of views and clicks, one instrument per user, four levels a side."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    mid = (F.col("k") % 98 + 1) / F.lit(100.0)
    level = lambda sign: F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.struct((mid + sign * (i + 1) * F.lit(0.01)).alias("price"), (F.col("value") + i * F.col("k") % 7).alias("size")))
    return e.select(
        F.col("user_id").cast("string").alias("condition_id"), F.col("event_id").alias("seq"), F.col("ms").alias("receive_ms"), F.when(F.col("event_type") == "view", "Up").otherwise("Down").alias("outcome"), mid.alias("mid"),
        (mid - 0.01).alias("best_bid"), (mid + 0.01).alias("best_ask"), level(-1).alias("bids"), level(1).alias("asks"), (F.col("k") % 10 != 0).alias("book_state_valid"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session journals: a user's events as connection events."""
    e = events(spark, sf_dir)
    names = {"signup": "connected", "purchase": "disconnected", "error": "connection_error", "click": "subscribed", "view": "stale_feed_detected"}
    event = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), event.alias("event"), F.col("ms").alias("timestamp_ms"), F.col("k"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, period, y, p: orders as scored cases; period is the month."""
    o = table(spark, sf_dir, "orders")
    p = 1 / (1 + F.exp(-(F.col("o_totalprice") - 150000) / 100000))
    return o.select(F.col("o_orderkey").alias("id"), F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM").alias("period"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.round(p, 4).alias("p"))


#: The same views in SQL, as common table expressions of the oracles.
SQL = {
    "ev": "ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id, event_type, value, regexp_extract(props, '(-?[0-9]+)', 1)::INT AS k FROM events)",
    "fills": """fills AS (SELECT event_id AS fill_id, user_id || '-' || (ms // 604800000) AS condition_id, CASE WHEN event_type = 'purchase' THEN 'SELL' ELSE 'BUY' END AS side,
      CASE WHEN event_type IN ('view', 'signup') OR (event_type = 'purchase' AND k % 2 = 0) THEN 'Up' ELSE 'Down' END AS outcome, value AS size, (k % 100) / 100.0::DOUBLE AS price, ms AS timestamp_ms,
      'w7d-' || (ms // 604800000 * 604800) AS slug, ms // 604800000 * 604800000 AS market_start_ms, (ms // 604800000 + 1) * 604800000 AS market_end_ms FROM ev)""",
    "ticks": "ticks AS (SELECT user_id::VARCHAR AS condition_id, ms AS exchange_ms, ms + k AS receive_ms, 100 + value / 10 AS price, value AS size, k % 2 = 0 AS buyer_is_maker, event_id AS trade_id FROM ev)",
    "book": """book AS (SELECT user_id::VARCHAR AS condition_id, event_id AS seq, ms AS receive_ms, CASE WHEN event_type = 'view' THEN 'Up' ELSE 'Down' END AS outcome, (k % 98 + 1) / 100.0::DOUBLE AS mid,
      (k % 98 + 1) / 100.0::DOUBLE - 0.01 AS best_bid, (k % 98 + 1) / 100.0::DOUBLE + 0.01 AS best_ask, value, k, k % 10 <> 0 AS book_state_valid FROM ev WHERE event_type IN ('view', 'click'))""",
    "sessions": """sessions AS (SELECT user_id::VARCHAR AS session_id, event_id AS seq, ms AS timestamp_ms, k,
      CASE event_type WHEN 'signup' THEN 'connected' WHEN 'purchase' THEN 'disconnected' WHEN 'error' THEN 'connection_error' WHEN 'click' THEN 'subscribed' ELSE 'stale_feed_detected' END AS event FROM ev)""",
    "scores": "scores AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS period, (o_orderstatus = 'F')::INT AS y, round(1 / (1 + exp(-(o_totalprice - 150000) / 100000)), 4) AS p FROM orders)",
}


def with_sql(*names: str) -> str:
    """A WITH clause of the views named."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
