"""Registered queries of timelines, endpoints, buckets, distributions, manifests and operations, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.scalars import error_class
from tallyspark.operators import ledger
from tallyspark.operators import summaries as M
from tallyspark.plans.audit_queries import _MARKETS, _markets
from tallyspark.plans.queries import r6, register
from tallyspark.sources import files
from tallyspark.sources import fixtures as X
from tallyspark.sources.fixtures import HORIZON, HOUR, WEEK, with_sql

DAY = 24 * HOUR
_WEEKS = f"w AS (SELECT DISTINCT user_id::VARCHAR AS condition_id, ms // {WEEK} * {WEEK} AS start_ms, ms // {WEEK} * {WEEK} + {WEEK} AS end_ms FROM ev)"


@register("j03_window_endpoints", f"""{with_sql("ev", "ticks")}, {_WEEKS}, t AS (SELECT condition_id, exchange_ms // {6 * HOUR} * {6 * HOUR} AS ms, trade_id, price FROM ticks)
SELECT w.condition_id, w.start_ms, w.end_ms, CASE WHEN w.start_ms - a.ms <= {2 * DAY} THEN a.price END AS start_value, z.price AS end_value
FROM w LEFT JOIN LATERAL (SELECT ms, price FROM t WHERE t.condition_id = w.condition_id AND t.ms <= w.start_ms ORDER BY ms DESC, trade_id LIMIT 1) a ON true LEFT JOIN LATERAL (SELECT ms, price FROM t WHERE t.condition_id = w.condition_id AND t.ms <= w.end_ms ORDER BY ms DESC, trade_id LIMIT 1) z ON true""")  # fmt: skip
def window_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices at the ends of each user's weeks; times are floored to six hours, so that they tie."""
    e = X.events(spark, sf_dir)
    start = F.floor(F.col("ms") / WEEK) * WEEK
    weeks = e.select(F.col("user_id").cast("string").alias("condition_id"), start.alias("start_ms"), (start + WEEK).alias("end_ms")).distinct()
    ticks = X.ticks(spark, sf_dir).select("condition_id", (F.floor(F.col("exchange_ms") / (6 * HOUR)) * 6 * HOUR).alias("ms"), "trade_id", "price")
    return M.endpoint_values(weeks, ticks, "condition_id", "ms", "price", "trade_id", 2 * DAY)


_UP = """n AS (SELECT condition_id, seq, receive_ms, outcome, value * 4 + (0 * k % 7 + 1 * k % 7 + 2 * k % 7 + 3 * k % 7) AS depth, mid, best_bid, best_ask FROM book WHERE book_state_valid),
u AS (SELECT condition_id, seq, receive_ms, outcome, CASE WHEN outcome = 'Down' THEN 1 - best_ask ELSE best_bid END AS up_bid, CASE WHEN outcome = 'Down' THEN 1 - best_bid ELSE best_ask END AS up_ask, CASE WHEN outcome = 'Down' THEN 1 - mid ELSE mid END AS up_mid, depth FROM n)"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book with asks of twice the bids' size, so that sides can be told apart."""
    b = X.book(spark, sf_dir)
    return b.withColumn("asks", F.transform("asks", lambda x: F.struct(x["price"].alias("price"), (x["size"] * 2).alias("size"))))


@register("p12_normalised_book", f"""{with_sql("ev", "book")}, {_UP} SELECT condition_id, seq, round(up_bid, 6) AS up_bid, round(up_ask, 6) AS up_ask, round(up_mid, 6) AS up_mid, round(up_ask - up_bid, 6) AS spread,
 round(CASE WHEN outcome = 'Down' THEN 2 * depth ELSE depth END, 6) AS bid_depth, round(CASE WHEN outcome = 'Down' THEN depth ELSE 2 * depth END, 6) AS ask_depth, CASE WHEN depth <> 0 THEN round(CASE WHEN outcome = 'Down' THEN 1 ELSE -1 END / 3.0, 6)::DOUBLE END AS obi FROM u""")
def normalised_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid book rows in terms of Up."""
    out = M.normalised_book(_book(spark, sf_dir))
    return out.select("condition_id", "seq", "up_bid", "up_ask", "up_mid", "spread", "bid_depth", "ask_depth", "obi").withColumns(r6("up_bid", "up_ask", "up_mid", "spread", "bid_depth", "ask_depth", "obi"))


@register("h01_timeline", f"""{with_sql("ev", "ticks", "book")}, {_UP}, b AS (SELECT min(ms) + {DAY} AS lo, max(ms) - {DAY} AS hi FROM ev),
x AS (SELECT condition_id, exchange_ms AS event_ms, receive_ms, 'BTC' AS source, trade_id AS line, price, NULL AS up_mid FROM ticks UNION ALL SELECT condition_id, receive_ms, receive_ms, 'PM', seq, NULL, up_mid FROM u)
SELECT condition_id, row_number() OVER (PARTITION BY condition_id ORDER BY event_ms, receive_ms, source, line) - 1 AS place, event_ms, source, line, price, round(up_mid, 6) AS up_mid FROM x, b WHERE event_ms >= lo AND event_ms < hi""")  # fmt: skip
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks and book rows of each market in one order, without the first and the last day."""
    lo, hi = X.events(spark, sf_dir).agg(F.min("ms"), F.max("ms")).first()
    ticks = X.ticks(spark, sf_dir).select("condition_id", F.col("exchange_ms").alias("event_ms"), "receive_ms", F.col("trade_id").alias("line"), "price")
    book = _book(spark, sf_dir).withColumn("event_ms", F.col("receive_ms")).withColumn("line", F.col("seq"))
    out = M.timeline(ticks, book, "condition_id", (lo or 0) + DAY, (hi or 0) - DAY)
    return out.select("condition_id", "place", "event_ms", "source", "line", "price", F.round("up_mid", 6).alias("up_mid"))


@register("h01_row_counts", f"{with_sql('ev', 'ticks', 'book')}, t AS (SELECT condition_id, count(*) AS ticks FROM ticks GROUP BY 1), b AS (SELECT condition_id, count(*) FILTER (book_state_valid) AS valid, count(*) FILTER (NOT book_state_valid) AS invalid FROM book GROUP BY 1) SELECT condition_id, ticks, coalesce(valid, 0) AS valid, coalesce(invalid, 0) AS invalid FROM t LEFT JOIN b USING (condition_id)")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks, valid and invalid book rows of each market."""
    t = X.ticks(spark, sf_dir).groupBy("condition_id").agg(F.count("*").alias("ticks"))
    b = X.book(spark, sf_dir).groupBy("condition_id").agg(F.count_if("book_state_valid").alias("valid"), F.count_if(~F.col("book_state_valid")).alias("invalid"))
    return t.join(b, "condition_id", "left").fillna(0, ["valid", "invalid"])


_FEEDS = f"""{with_sql("ev", "sessions")}, c AS (SELECT session_id, timestamp_ms AS lo, event, lead(timestamp_ms) OVER (PARTITION BY session_id ORDER BY timestamp_ms, seq) AS hi FROM sessions WHERE event IN ('connected', 'disconnected', 'connection_error')),
z AS (SELECT session_id, max(timestamp_ms) AS last FROM sessions GROUP BY 1), i AS (SELECT session_id, session_id::INT % 2 AS feed, lo, coalesce(hi, last) AS hi FROM c JOIN z USING (session_id) WHERE event = 'connected'),
m AS (SELECT DISTINCT timestamp_ms // {DAY} AS market, timestamp_ms // {DAY} * {DAY} AS s, timestamp_ms // {DAY} * {DAY} + {DAY} AS e FROM sessions)"""


@register("j14_feed_readiness", f"""{_FEEDS}, r AS (SELECT market, count(DISTINCT session_id) FILTER (feed = 0 AND lo <= s AND hi >= s) AS book_start, count(DISTINCT session_id) FILTER (feed = 0 AND lo <= e AND hi >= e) AS book_end, count(DISTINCT session_id) FILTER (feed = 1 AND lo <= s AND hi >= s) AS tick_start, count(DISTINCT session_id) FILTER (feed = 1 AND lo <= e AND hi >= e) AS tick_end FROM m, i GROUP BY 1)
SELECT m.market, m.s AS start_ms, m.e AS end_ms, book_start, book_end, tick_start, tick_end, CASE WHEN least(book_start, book_end, tick_start, tick_end) > 0 THEN 'FULL_LIFECYCLE_MARKET' ELSE 'PARTIAL_SESSION_MARKET' END AS lifecycle FROM m JOIN r USING (market)""")  # fmt: skip
def feed_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book and tick sessions that are connected at both ends of each day."""
    s = X.sessions(spark, sf_dir)
    days = s.select(F.floor(F.col("timestamp_ms") / DAY).alias("market")).distinct()
    markets = days.select("market", (F.col("market") * DAY).alias("start_ms"), ((F.col("market") + 1) * DAY).alias("end_ms"))
    iv = ledger.connection_intervals(s).select(F.col("session_id").alias("session"), F.col("start_ms").alias("lo_ms"), F.col("end_ms").alias("hi_ms"))
    feed = lambda n: iv.where(F.col("session").cast("int") % 2 == n)
    return M.market_lifecycle(markets, {"book": feed(0), "tick": feed(1)}, "market")


@register("i06_temporal_buckets", f"""{_MARKETS}, k AS (SELECT *, e >= to_ms + {HORIZON} AS eligible FROM (SELECT m.*, opp.t0_ms AS to_ms FROM m LEFT JOIN opp USING (condition_id))),
x AS (SELECT 'day' AS kind, strftime(make_timestamp(s * 1000), '%Y-%m-%d') AS bucket, * FROM k UNION ALL SELECT 'week', strftime(make_timestamp(s * 1000), '%G-W%V'), * FROM k)
SELECT kind, bucket, count(*) AS markets, count(*) FILTER (opposed) AS opposed, count(*) FILTER (opposed AND eligible) AS observable, count(*) FILTER (opposed AND eligible AND label = 1) AS positive, count(*) FILTER (opposed AND NOT eligible) AS censored,
 round(median(initial_qty), 6) AS median_quantity, round(median(start_to_initial_h * 3600), 6) AS median_seconds, round(count(*) FILTER (opposed AND eligible AND label = 1) / nullif(count(*) FILTER (opposed AND eligible), 0), 6) AS rate, kind = 'week' AND count(*) < 40 AS low_n FROM x GROUP BY 1, 2""")  # fmt: skip
def temporal_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets by day and by week of their start."""
    m = _markets(spark, sf_dir).withColumn("eligible", F.col("_e") >= F.col("t0_ms") + HORIZON)
    rows = m.select("_s", "opposed", "eligible", "label", F.col("initial_qty").alias("quantity"), (F.col("start_to_initial_h") * 3600).alias("seconds"))
    return M.temporal_buckets(rows, "_s", 40).withColumns(r6("median_quantity", "median_seconds", "rate"))


@register("i17_distribution_summary", f"""{with_sql("ev")}, l AS (SELECT event_type, k % 3 AS part, 'value' AS feature, value::DOUBLE AS v FROM ev UNION ALL SELECT event_type, k % 3, 'inverse', CASE WHEN k % 5 <> 0 THEN 1.0 / (k % 5) END FROM ev)
SELECT event_type, part, feature, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.05), 6) AS p05, round(median(v), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM l GROUP BY 1, 2, 3""")  # fmt: skip
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions of two features by kind of event and part; values that are not finite are left out."""
    e = X.events(spark, sf_dir).withColumn("part", F.col("k") % 3).withColumn("inverse", F.when(F.col("k") % 5 == 0, F.lit(float("inf"))).otherwise(1.0 / (F.col("k") % 5)))
    return M.distribution_summary(e, ["value", "inverse"], ["event_type", "part"]).withColumns(r6("mean", "std", "p01", "p05", "median", "p95", "p99"))


@register("g12_provenance_failures", f"""{with_sql("ev")}, p AS (SELECT event_id::VARCHAR AS condition_id, event_type AS feature, CASE WHEN k % 4 = 0 THEN 'truth' WHEN k % 4 = 1 THEN 'book' ELSE 'ticks' END AS source_type, CASE WHEN k % 10 <> 0 THEN ms + k % 7 * 1000 END AS source_max_ms, ms + 2000 AS cutoff_ms, ms + 4000 AS prediction_ms FROM ev)
SELECT condition_id, feature, source_type, source_max_ms, CASE WHEN source_type = 'truth' THEN prediction_ms ELSE cutoff_ms END AS limit_ms FROM p WHERE source_max_ms > CASE WHEN source_type = 'truth' THEN prediction_ms ELSE cutoff_ms END""")  # fmt: skip
def provenance_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources later than the cutoff, or than the prediction where they are known by it."""
    k = F.col("k")
    source = F.when(k % 4 == 0, "truth").when(k % 4 == 1, "book").otherwise("ticks")
    rows = X.events(spark, sf_dir).select(F.col("event_id").cast("string").alias("condition_id"), F.col("event_type").alias("feature"), source.alias("source_type"), F.when(k % 10 != 0, F.col("ms") + k % 7 * 1000).alias("source_max_ms"), (F.col("ms") + 2000).alias("cutoff_ms"), (F.col("ms") + 4000).alias("prediction_ms"))
    return M.provenance_failures(rows, ["ticks", "book"])


@register("f14_window_operations", f"""{with_sql("ev", "sessions")}, b AS (SELECT min(timestamp_ms) + {3 * HOUR} AS lo, max(timestamp_ms) - {5 * HOUR} AS hi FROM sessions), o AS (SELECT s.* FROM sessions s, b WHERE timestamp_ms BETWEEN lo AND hi),
w AS (SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM o WHERE o.timestamp_ms // {HOUR} = i)) AS seen FROM (SELECT unnest(range((lo + {HOUR} - 1) // {HOUR}, (hi - {HOUR}) // {HOUR} + 1)) AS i FROM b)),
l AS (SELECT *, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY timestamp_ms, seq) AS d FROM o),
t AS (SELECT count(DISTINCT session_id) AS sessions, count(*) AS records, count(*) FILTER (event = 'connected') AS connects, count(*) FILTER (event IN ('disconnected', 'connection_error')) AS disconnects, count(*) FILTER (event = 'stale_feed_detected') AS stale_events, round(coalesce(sum(d) FILTER (d > {48 * HOUR}), 0) / 1000.0, 3) AS gap_seconds, count(*) FILTER (event = 'connected') - count(DISTINCT session_id) FILTER (event = 'connected') AS reconnects FROM l)
SELECT t.*, seen AS discovered_windows, n AS expected_windows, n - seen AS missed_windows, CASE WHEN records = 0 THEN 'NO_DATA' WHEN n > seen OR gap_seconds > 0 THEN 'DATA_QUALITY_WARNING' ELSE 'PASS' END AS status FROM t, w""")  # fmt: skip
def window_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hours expected, discovered and missed, reconnects, records and seconds in gaps of the journals."""
    s = X.sessions(spark, sf_dir).select(F.col("session_id").alias("session"), "seq", F.col("timestamp_ms").alias("ms"), "event")
    lo, hi = s.agg(F.min("ms"), F.max("ms")).first()
    return M.operations_summary(s, (lo or 0) + 3 * HOUR, (hi or 0) - 5 * HOUR, HOUR, 48 * HOUR).withColumn("gap_seconds", F.round("gap_seconds", 3))


@register("s10_file_manifest", f"""{with_sql("ev")}, l AS (SELECT user_id % 5 AS session, event_id, ms, CASE WHEN event_id % 97 = 0 THEN '{{"event_id":' || event_id ELSE '{{"event_id":' || event_id || ',"ms":' || ms || '}}' END AS line FROM ev)
SELECT session::VARCHAR AS session, count(*) AS records, count(*) FILTER (event_id % 97 = 0) AS parse_errors, min(ms) FILTER (event_id % 97 <> 0) AS first_ms, max(ms) FILTER (event_id % 97 <> 0) AS last_ms, sha256(string_agg(line, chr(10) ORDER BY event_id) || chr(10)) AS sha256 FROM l GROUP BY 1""")  # fmt: skip
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file: its session (from its path), records, parse errors, times and digest; some lines are cut."""
    path = files.shared_path(spark, "manifest")
    whole = F.to_json(F.struct("event_id", "ms"))
    line = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit('{"event_id":'), F.col("event_id"))).otherwise(whole)
    rows = X.events(spark, sf_dir).select((F.col("user_id") % 5).alias("session"), "event_id", line.alias("value"))
    rows.repartition("session").sortWithinPartitions("session", "event_id").select("session", "value").write.partitionBy("session").text(path)
    m = files.manifest(spark, f"{path}/*", "ms")
    return m.select(F.regexp_extract("file", "session=([0-9]+)/", 1).alias("session"), "records", "parse_errors", "first_ms", "last_ms", "sha256")


@register("s12_foreign_rows", f"{with_sql('ev')} SELECT (user_id % 5)::VARCHAR AS file_session, count(*) AS records, count(*) FILTER (event_id % 50 = 0) AS foreign_rows FROM ev GROUP BY 1")
def foreign_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the file that they came from, and those whose own session is another one."""
    path = files.shared_path(spark, "sourced")
    rows = X.events(spark, sf_dir).withColumn("part", F.col("user_id") % 5).withColumn("session", F.when(F.col("event_id") % 50 == 0, F.col("part") + 1).otherwise(F.col("part")))
    one = F.to_json(F.struct(F.lit("events").alias("source"), F.lit("run").alias("sync_run_id"), F.lit(0).alias("fetched_at_ms"), F.struct("event_id", "session").alias("record")))
    rows.select("part", one.alias("value")).write.partitionBy("part").text(path)
    back = files.read_envelopes(spark, f"{path}/*", "event_id: bigint, session: bigint").withColumn("file_session", F.regexp_extract("file", "part=([0-9]+)/", 1))
    return back.groupBy("file_session").agg(F.count("*").alias("records"), F.count_if(F.col("session") != F.col("file_session").cast("long")).alias("foreign_rows"))


#: Words of network errors and their classes; the first rule that fits counts.
ERRORS = [("connectionrefused", "PROXY_CONNECTION_REFUSED"), ("proxyerror: timeout", "PROXY_TIMEOUT"), ("proxyerror", "PROXY_CONNECTION_REFUSED"), ("ping timeout", "PING_TIMEOUT"), ("connectionclosed", "REMOTE_CLOSE"), ("gaierror", "DNS"), ("name or service", "DNS"), ("ssl", "TLS"), ("certificate", "TLS"), ("timeout", "PROXY_TIMEOUT")]


@register("p23_error_classes", f"""{with_sql("ev")}, x AS (SELECT event_id, CASE k % 9 WHEN 0 THEN 'PROXY_CONNECTION_REFUSED' WHEN 1 THEN 'PROXY_TIMEOUT' WHEN 2 THEN 'PROXY_CONNECTION_REFUSED' WHEN 3 THEN 'PING_TIMEOUT' WHEN 4 THEN 'REMOTE_CLOSE' WHEN 5 THEN 'DNS' WHEN 6 THEN 'TLS' WHEN 7 THEN 'PROXY_TIMEOUT' ELSE 'OTHER' END AS reason FROM ev) SELECT reason, count(*) AS n, min(event_id) AS first_id FROM x GROUP BY 1""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error texts by the first rule that fits, whatever the case; most fit several."""
    texts = ["ConnectionRefusedError in ProxyError: timeout", "ProxyError: Timeout after ping timeout", "ProxyError(SSL)", "Ping Timeout; ConnectionClosed", "ConnectionClosed by SSL", "socket.gaierror: timeout", "bad CERTIFICATE, timeout", "read Timeout", "unknown"]
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("k") % 9 + 1).cast("int"))
    return X.events(spark, sf_dir).groupBy(error_class(text, ERRORS).alias("reason")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
