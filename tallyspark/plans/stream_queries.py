"""Registered queries of sources, sinks and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.scalars import calendar_keys
from tallyspark.operators import raw
from tallyspark.plans.queries import register
from tallyspark.sources import files
from tallyspark.sources import fixtures as X
from tallyspark.sources.fixtures import HOUR, with_sql
from tallyspark.streaming import operators as T


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with their time as a timestamp."""
    held = spark.read.parquet(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(held.schema)
    if held.inputFiles()[0].endswith("/events.parquet"):  # one file: its folder is the source
        rows = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        rows = reader.parquet(f"{sf_dir}/events.parquet")
    ms = X.epoch_ms("ts")
    return rows.select("event_id", "user_id", "event_type", ms.alias("ms"), F.timestamp_millis(ms).alias("at"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def _finished(spark: SparkSession, out: DataFrame) -> DataFrame:
    path = files.shared_path(spark, "stream")
    T.run_to_end(out, path, files.shared_path(spark, "stream-state"))
    return spark.read.schema(out.schema).parquet(path)


@register("t03_stream_gaps", f"{with_sql('ev')}, l AS (SELECT user_id, ms AS from_ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS to_ms FROM ev) SELECT * FROM l WHERE to_ms - from_ms > {24 * HOUR}")
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps above a day per user, found by a stateful stream."""
    return _finished(spark, T.detect_gaps(_stream(spark, sf_dir).select("user_id", "event_id", "ms"), "user_id", "event_id", "ms", 24 * HOUR))


@register("t08_stream_deduplicate", "SELECT count(DISTINCT (user_id, event_type)) AS identities FROM events")
def stream_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities kept by a de-duplicating stream whose watermark covers all."""
    out = T.deduplicate(_stream(spark, sf_dir).select("user_id", "event_type", "at"), ["user_id", "event_type"], "at", "400 days")
    return _finished(spark, out).agg(F.count("*").alias("identities"))


@register("t10_stream_coverage", f"{with_sql('ev')}, m AS (SELECT max(ms) AS top FROM ev) SELECT user_id, ms // 86400000 AS day, count(*) AS n FROM ev, m GROUP BY 1, 2 HAVING (ms // 86400000 + 1) * 86400000 <= max(top)")
def stream_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and day of the windows that the watermark has closed."""
    out = T.window_coverage(_stream(spark, sf_dir).select("user_id", "at"), "user_id", "at", "1 day", "0 seconds")
    return _finished(spark, out).select("user_id", F.floor(F.unix_millis("start") / 86_400_000).alias("day"), "n")


@register("t07_stream_storms", f"""{with_sql('ev')}, w AS (SELECT (ms // {HOUR} - i) * {HOUR} AS start_ms FROM ev, range(6) t(i) WHERE event_type = 'error')
SELECT start_ms, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 3 AND start_ms + {6 * HOUR} <= (SELECT max(ms) FROM ev WHERE event_type = 'error')""")  # fmt: skip
def stream_storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows with many errors."""
    out = T.storms(_stream(spark, sf_dir).where("event_type = 'error'").select("at"), "at", "6 hours", "1 hour", 3, "0 seconds")
    return _finished(spark, out).select(F.unix_millis("start").alias("start_ms"), "n")


@register("t05_stream_latency", f"{with_sql('ev')} SELECT ms // 86400000 AS day, count(*) AS n, round(avg(k), 6) AS mean, max(k) AS most FROM ev GROUP BY 1 HAVING (ms // 86400000 + 1) * 86400000 <= (SELECT max(ms) FROM ev)")
def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receive delays per day, as a stream."""
    out = T.latency(_stream(spark, sf_dir).select("at", "k"), "at", "k", "1 day", "0 seconds")
    return _finished(spark, out).select(F.floor(F.unix_millis("start") / 86_400_000).alias("day"), "n", F.round("mean", 6).alias("mean"), "most")


@register("t02_book_validity", f"""{with_sql('ev')}, g AS (SELECT *, sum((event_type = 'signup')::INT) OVER w AS g FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT user_id, event_id, ms, bool_or(event_type = 'view') OVER w AS a, bool_or(event_type = 'click') OVER w AS b, bool_or(k = 99) OVER w AS insane, max(ms) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM g WINDOW w AS (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT f.user_id, f.event_id, f.a, f.b, f.ms, f.top, bool_or(f.insane OR coalesce(f.ms < f.top, false)) OVER (PARTITION BY f.user_id, g.g ORDER BY f.event_id ROWS UNBOUNDED PRECEDING) AS bad FROM f JOIN g USING (event_id))
SELECT user_id, event_id AS seq, CASE WHEN bad THEN 'DESYNCED' WHEN NOT (a AND b) THEN 'UNINITIALIZED' WHEN ms - top > {24 * HOUR} THEN 'STALE' ELSE 'VALID' END AS status FROM s""")  # fmt: skip
def book_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's book, kept by a stateful stream; views and clicks are its two tokens, signups reconnect."""
    token = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(0)
    events = _stream(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), "ms", token.alias("token"), (F.col("k") / 100.0).alias("price"), (F.col("event_type") == "signup").alias("reset"))
    return _finished(spark, T.validity(events, "user_id", 24 * HOUR, 0.0, 0.985))


@register("t09_tick_stream", f"{with_sql('ev')} SELECT ms AS exchange_ms, k::DOUBLE AS price, event_id AS trade_id, user_id::VARCHAR AS session_id, k::BIGINT AS latency_ms FROM ev WHERE event_id % 5 <> 0")
def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trade messages parsed as a stream, with session and latency."""
    e = _stream(spark, sf_dir)
    body = F.to_json(F.struct(F.when(F.col("event_id") % 5 == 0, "depth").otherwise("trade").alias("e"), F.col("ms").alias("T"), F.col("k").cast("string").alias("p"), F.lit("1").alias("q"), F.col("event_id").alias("t")))
    ticks = raw.parse_ticks(e.select(F.col("user_id").cast("string").alias("session_id"), (F.col("ms") + F.col("k")).alias("receive_ms"), body.alias("text")), "text")
    return _finished(spark, ticks.select("exchange_ms", "price", "trade_id", "session_id", (F.col("receive_ms") - F.col("exchange_ms")).alias("latency_ms")))


@register("t11_periodic_refresh", f"{with_sql('ev')} SELECT user_id, count(*) AS events, min(ms) AS first_ms, max(ms) AS last_ms FROM ev GROUP BY 1")
def periodic_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived table kept up to date by micro-batches."""
    path = files.shared_path(spark, "derived")
    sums = lambda df: df.groupBy("user_id").agg(F.count("*").alias("events"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    T.refresh(_stream(spark, sf_dir).select("user_id", "ms"), sums, path, files.shared_path(spark, "derived-state"))
    return spark.read.parquet(path).groupBy("user_id").agg(F.sum("events").alias("events"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


@register("s09_dated_sink", f"{with_sql('ev')} SELECT strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS dt, count(*) AS n FROM ev GROUP BY 1")
def dated_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only stream into folders of UTC dates."""
    path = files.shared_path(spark, "dated")
    dated = _stream(spark, sf_dir).select("event_id", "ms", calendar_keys(F.col("ms"))["day"].alias("dt"))
    dated.writeStream.format("json").partitionBy("dt").outputMode("append").option("maxRecordsPerFile", 100_000).option("path", path).option("checkpointLocation", files.shared_path(spark, "dated-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, ms long, dt string").json(path).groupBy("dt").agg(F.count("*").alias("n"))


@register("s02_envelope_round_trip", "SELECT event_type AS source, event_id, user_id, value FROM events")
def envelope_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as NDJSON envelopes and read back with a declared schema."""
    path = files.shared_path(spark, "ndjson")
    e = X.table(spark, sf_dir, "events")
    e.select(F.col("event_type").alias("source"), F.lit("run").alias("sync_run_id"), F.lit(0).cast("long").alias("fetched_at_ms"), F.struct("event_id", "user_id", "value").alias("record")).write.json(path)
    return files.read_envelopes(spark, path, "event_id: bigint, user_id: bigint, value: double").select("source", "event_id", "user_id", "value")


@register("s03_page_scan", "SELECT event_id // 100 AS page, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS place, event_id FROM events WHERE (event_id // 100) % 7 <> 0")
def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 100 events as JSON bodies, every seventh with an error status."""
    e = X.table(spark, sf_dir, "events").withColumn("page", F.floor(F.col("event_id") / 100))
    pages = e.groupBy("page").agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_id")))).alias("body")).withColumn("status", F.when(F.col("page") % 7 == 0, 500).otherwise(200))
    return files.explode_pages(pages, "body", "status", "struct<event_id: bigint>").select("page", F.col("place").cast("long").alias("place"), "event_id")


@register("s07_parquet_round_trip", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitioned zstd Parquet, read back with a pruned partition filter."""
    path = files.shared_path(spark, "parquet")
    files.write_parquet(X.table(spark, sf_dir, "lineitem"), path, ["l_returnflag"])
    rows = spark.read.parquet(path).where(F.col("l_returnflag").isin("A", "R"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register("s08_csv_ledger", "SELECT o_orderkey, o_orderstatus FROM orders")
def csv_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV ledger with a header, read back."""
    path = files.shared_path(spark, "csv")
    files.write_csv(X.table(spark, sf_dir, "orders"), path, ["o_orderkey", "o_orderstatus"])
    return spark.read.option("header", True).schema("o_orderkey bigint, o_orderstatus string").csv(path)


@register("s10_manifest", f"{with_sql('ev')} SELECT count(*) AS records, 0::BIGINT AS parse_errors, min(ms) AS first_ms, max(ms) AS last_ms FROM ev")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the files that the events are written to, summed up."""
    path = files.shared_path(spark, "manifest")
    X.events(spark, sf_dir).select("event_id", "ms").write.json(path)
    m = files.manifest(spark, path, "ms").where("records is not null")
    return m.agg(F.sum("records").alias("records"), F.sum("parse_errors").alias("parse_errors"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


@register("s13_schema_profile", "SELECT 'k' AS field, count(*) AS n, true AS expected, 'OBSERVED' AS status FROM events UNION ALL SELECT 'v', 0, true, 'MISSING'")
def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the events' JSON against the expected ones."""
    return files.schema_profile(X.table(spark, sf_dir, "events"), "props", ["k", "v"])


@register("s14_publish_once", "SELECT 'first' AS attempt, 'PUBLISHED' AS outcome, count(*) AS n FROM region UNION ALL SELECT 'again', 'SAME', count(*) FROM region")
def publish_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishing the same content twice."""
    path = files.shared_path(spark, "publish")
    rows = X.table(spark, sf_dir, "region")
    found = [(a, files.publish_once(rows, path, ["r_regionkey"])) for a in ("first", "again")]
    return spark.createDataFrame(found, "attempt string, outcome string").crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
