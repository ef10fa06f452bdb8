"""Registered queries of stateful streams over the given tables, run over several micro-batches with restarts between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import ledger
from tallyspark.plans.queries import ORACLES, register
from tallyspark.sources import files
from tallyspark.sources import fixtures as X
from tallyspark.sources.fixtures import GAP, HORIZON, HOUR, with_sql
from tallyspark.streaming import operators as T
from tallyspark.streaming import stateful as S

#: Parts in which a stream's source grows; the stream is started anew for each.
PARTS = 3


def grown(spark: SparkSession, rows: DataFrame, by: str, run: Callable[[DataFrame], None], parts: int = PARTS) -> None:
    """Let a file source grow part by part of rows (cut by the range of a column), and run a stream over it after each."""
    path = files.shared_path(spark, "source")
    low, high = rows.agg(F.min(by), F.max(by)).first()
    for i in range(parts):
        at = F.lit(0) if low is None else F.least(F.floor((F.col(by) - low) * parts / (high - low + 1)), F.lit(parts - 1))
        rows.where(at == i).write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path))


def _appended(spark: SparkSession, rows: DataFrame, by: str, out: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an appending stream has written when its source has grown to all of rows."""
    path, state = files.shared_path(spark, "stream"), files.shared_path(spark, "stream-state")
    schema = None

    def run(stream: DataFrame) -> None:
        nonlocal schema
        result = out(stream)
        schema = result.schema
        T.run_to_end(result, path, state)

    with S.state_store(spark):
        grown(spark, rows, by, run)
    return spark.read.schema(schema).parquet(path)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book messages, a token per user: signups are snapshots of four levels, views and clicks set bids and asks, purchases are trades."""
    e = X.events(spark, sf_dir)
    level = lambda side, price, size: F.struct(F.lit(side).alias("side"), price.cast("double").alias("price"), size.cast("double").alias("size"))
    k, value = F.col("k"), F.col("value")
    snapshot = F.array(level("bid", k % 5, value), level("bid", k % 5 + 3, value + 1), level("ask", 10 + k % 4, value), level("ask", 15 + k % 3, value + 2))
    one = lambda side, price: F.array(level(side, price, F.when(k % 4 == 0, 0.0).otherwise(value)))
    kind = F.when(F.col("event_type") == "signup", S.SNAPSHOT).when(F.col("event_type").isin("view", "click"), S.CHANGE).when(F.col("event_type") == "purchase", S.TRADE).otherwise("other")
    levels = F.when(kind == S.SNAPSHOT, snapshot).when(F.col("event_type") == "view", one("bid", k % 10)).when(F.col("event_type") == "click", one("ask", 10 + k % 10))
    return e.select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), levels.alias("levels"), (k / 100.0).alias("trade_price"), F.col("value").alias("trade_size"))


_SLOTS = "coalesce(array_to_string(list_transform(list_filter({}[1:3], lambda x: x.size > 0), lambda x: (x.price::INT)::VARCHAR || ':' || round(x.size, 4)::VARCHAR), ' '), '')"


@register("t01_stream_book", f"""{with_sql("ev")}, s AS (SELECT user_id, event_id AS seq, max(event_id) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS snap,
  max(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS bought FROM ev),
c AS (SELECT user_id, event_id AS at, 'bid' AS side, k % 10 AS price, CASE WHEN k % 4 = 0 THEN 0 ELSE value END AS size FROM ev WHERE event_type = 'view'
  UNION ALL SELECT user_id, event_id, 'ask', 10 + k % 10, CASE WHEN k % 4 = 0 THEN 0 ELSE value END FROM ev WHERE event_type = 'click'
  UNION ALL SELECT user_id, event_id, u.x.side, u.x.price, u.x.size FROM ev, LATERAL (SELECT unnest([{{'side': 'bid', 'price': k % 5, 'size': value}}, {{'side': 'bid', 'price': k % 5 + 3, 'size': value + 1}}, {{'side': 'ask', 'price': 10 + k % 4, 'size': value}}, {{'side': 'ask', 'price': 15 + k % 3, 'size': value + 2}}]) AS x) u WHERE event_type = 'signup'),
l AS (SELECT s.user_id, s.seq, c.side, c.price, arg_max(c.size, c.at) AS size FROM s JOIN c ON c.user_id = s.user_id AND c.at <= s.seq AND c.at >= coalesce(s.snap, -1) GROUP BY ALL),
b AS (SELECT user_id, seq, max(price) FILTER (side = 'bid' AND size > 0) AS best_bid, min(price) FILTER (side = 'ask' AND size > 0) AS best_ask,
  list(struct_pack(price := price, size := size) ORDER BY price DESC) FILTER (side = 'bid') AS bids, list(struct_pack(price := price, size := size) ORDER BY price) FILTER (side = 'ask') AS asks FROM l GROUP BY 1, 2)
SELECT s.user_id, s.seq, best_bid::DOUBLE AS best_bid, best_ask::DOUBLE AS best_ask, (best_bid + best_ask) / 2.0 AS mid, (best_ask - best_bid)::DOUBLE AS spread, {_SLOTS.format("bids")} AS bids, {_SLOTS.format("asks")} AS asks, e.k / 100.0::DOUBLE AS trade_price, e.value AS trade_size
FROM s LEFT JOIN b USING (user_id, seq) LEFT JOIN ev e ON e.event_id = s.bought""")  # fmt: skip
def stream_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book of each token after every message, kept as state over three runs of a stream."""
    out = _appended(spark, messages(spark, sf_dir), "seq", lambda m: S.reconstructed_book(m, "user_id"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["price"].cast("int").cast("string"), F.round(x["size"], 4).cast("string"))), " ")
    return out.withColumns({c: text(c) for c in ("bids", "asks")})


@register("t04_stream_sequence", f"{with_sql('ev')}, d AS (SELECT user_id, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS last_id, k AS id FROM ev) SELECT user_id, CASE WHEN id > last_id THEN 'GAP' ELSE 'NON_MONOTONE' END AS finding, last_id::BIGINT AS last_id, id::BIGINT AS id FROM d WHERE last_id IS NOT NULL AND id <> last_id + 1")
def stream_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that leave gaps or do not rise, per user, with the last id as state over three runs."""
    return _appended(spark, X.events(spark, sf_dir).select("user_id", "event_id", "k"), "event_id", lambda s: S.sequence_findings(s, "user_id", "k", "event_id"))


@register("t05_latency_percentiles", f"""{with_sql("ev")}, w AS (SELECT (ms // {24 * HOUR} - i) * {24 * HOUR} AS start_ms, k - 4 AS d FROM ev, range(3) t(i))
SELECT start_ms, count(*) AS n, quantile_disc(d, 0.5) AS median, quantile_disc(d, 0.95) AS p95, quantile_disc(d, 0.99) AS p99, max(d) AS most, round(avg((d < 0)::INT), 6) AS negative, CASE WHEN avg((d < 0)::INT) > 0.05 THEN 'CLOCK_SKEW_WARNING' ELSE 'OK' END AS status
FROM w GROUP BY 1 HAVING start_ms + {72 * HOUR} <= (SELECT max(ms) FROM ev)""")  # fmt: skip
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of receive delays over three-day windows that move by a day, and windows of a skewed clock."""
    rows = X.events(spark, sf_dir).select("ms", F.timestamp_millis("ms").alias("at"), (F.col("k") - 4).alias("delay"))
    out = _appended(spark, rows, "ms", lambda s: S.delay_percentiles(s, "at", "delay", "3 days", "1 day", "0 seconds"))
    return out.select(F.unix_millis("start").alias("start_ms"), "n", "median", "p95", "p99", "most", F.round("negative", 6).alias("negative"), "status")


@register("t06_stream_watchdog", f"""{with_sql("ev")}, l AS (SELECT user_id, ms AS last_ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS following FROM ev)
SELECT user_id, last_ms, last_ms + {48 * HOUR} + 1 AS stale_ms FROM l WHERE following - last_ms > {48 * HOUR} OR following IS NULL AND last_ms + {48 * HOUR} + 1 <= (SELECT max(ms) FROM ev)""")  # fmt: skip
def stream_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of more than two days per user, those without any later event too, by timers of a stream."""
    return _appended(spark, X.events(spark, sf_dir).select("event_id", "user_id", "ms"), "ms", lambda s: S.stale_feeds(s, "user_id", "ms", 48 * HOUR))


@register("t11_prospective_refresh", ORACLES["e07_event_ledger"])
def prospective_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event ledger refreshed by every micro-batch for the markets that it touches."""
    path, state, schema = files.shared_path(spark, "ledger"), files.shared_path(spark, "ledger-state"), None

    def derive(fills: DataFrame) -> DataFrame:
        nonlocal schema
        out = ledger.event_ledger(fills, fills.select("condition_id", "market_start_ms", "market_end_ms").distinct(), GAP, HORIZON, 0)
        schema = out.schema
        return out

    grown(spark, X.fills(spark, sf_dir), "timestamp_ms", lambda s: S.refreshed(s, "condition_id", derive, path, state, identity=["fill_id"]))
    return S.current(spark, path, schema or derive(X.fills(spark, sf_dir)).schema).drop("bucket", "version")
