"""Registered queries of raw parsing and file catalogues, each with an independent SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import raw
from tallyspark.plans.queries import EPISODES, HORIZON, _opposites, r6, register
from tallyspark.sources import files
from tallyspark.sources import fixtures as X
from tallyspark.sources.fixtures import HOUR, with_sql

EV = with_sql("ev")


@register("p01_normalised_fills", f"{with_sql('ev', 'fills')} SELECT fill_id, side, round(size, 6) AS size, round(price, 6) AS price, timestamp_ms FROM fills WHERE fill_id % 9 <> 0 UNION ALL SELECT fill_id, side, NULL, round(price, 6), timestamp_ms FROM fills WHERE fill_id % 9 = 0")
def normalised_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of text fields: numbers cast, sides in capitals, times in milliseconds; every ninth size is no number."""
    f = X.fills(spark, sf_dir)
    text = f.select("fill_id", F.lower("side").alias("side"), F.when(F.col("fill_id") % 9 == 0, "n/a").otherwise(F.col("size").cast("string")).alias("size"), F.col("price").cast("string").alias("price"), F.col("timestamp_ms").cast("string").alias("timestamp"))
    return text.select("fill_id", F.upper(F.trim("side")).alias("side"), F.col("size").try_cast("double").alias("size"), F.col("price").try_cast("double").alias("price"), S.parse_ms(F.col("timestamp")).alias("timestamp_ms")).withColumns(r6("size", "price"))


@register("p03_trade_identity", f"""{EV} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'id:' || event_id ELSE 'ck:' || sha256(coalesce(nullif(user_id::VARCHAR, '0'), '') || '|' || event_type || '|' || ms || '|' || coalesce(nullif((k % 4)::VARCHAR, '0'), '') || '||' || 'x' || '|' || (k % 2)) END AS identity FROM ev""")
def trade_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit ids, or hashes of seven fields in which 0 and empty text count as empty, but for the last."""
    e = X.events(spark, sf_dir)
    fields = [F.col("user_id"), F.col("event_type"), F.col("ms"), F.col("k") % 4, F.lit(""), F.lit("x")]
    return e.select("event_id", S.trade_identity(F.when(F.col("event_id") % 3 == 0, F.col("event_id")), fields, F.col("k") % 2).alias("identity"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as JSON messages; every fifth is of another kind, every seventh lacks the event time, every eleventh is cut off."""
    e = X.events(spark, sf_dir)
    kind = F.when(F.col("event_id") % 5 == 0, "depth").otherwise("trade")
    body = F.to_json(F.struct(kind.alias("e"), F.col("ms").alias("T"), F.when(F.col("event_id") % 7 != 0, F.col("ms") + F.col("k")).alias("E"), F.col("k").cast("string").alias("p"), (F.col("k") % 10).cast("string").alias("q"), F.col("event_id").alias("t"), (F.col("k") % 2 == 0).alias("m"), F.lit("X").alias("s")))
    return e.select(F.when(F.col("event_id") % 11 == 0, F.substring(body, 1, 9)).otherwise(body).alias("text"))


@register("p04_tick_messages", f"{EV} SELECT ms AS exchange_ms, CASE WHEN event_id % 7 = 0 THEN ms ELSE ms + k END AS event_ms, k::DOUBLE AS price, (k % 10)::DOUBLE AS size, event_id AS trade_id, k % 2 = 0 AS buyer_is_maker, 'X' AS symbol FROM ev WHERE event_id % 5 <> 0 AND event_id % 11 <> 0")
def tick_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of raw trade messages."""
    return raw.parse_ticks(_messages(spark, sf_dir), "text")


@register("p05_book_frames", f"""{EV}, f AS (SELECT user_id, min(ms) AS received, list(event_id ORDER BY event_id) AS ids FROM ev GROUP BY 1)
SELECT received, CASE WHEN len(ids) % 3 = 0 THEN 'book' ELSE 'price_change' END AS event_type, user_id::VARCHAR AS market, received AS timestamp_ms, sha256(received || '|' || user_id || '|' || received) AS frame_id,
 (CASE WHEN len(ids) % 3 = 0 THEN NULL ELSE p END)::BIGINT AS child, CASE WHEN len(ids) % 3 <> 0 THEN ids[p + 1] END AS id FROM f, LATERAL (SELECT unnest(range(CASE WHEN len(ids) % 3 = 0 THEN 1 ELSE len(ids) END)) AS p)""")  # fmt: skip
def book_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, arrays or single events, with a row for each price change."""
    e = X.events(spark, sf_dir)
    g = e.groupBy("user_id").agg(F.min("ms").alias("received"), F.array_sort(F.collect_list("event_id")).alias("ids"))
    plain = F.size("ids") % 3 == 0
    changes = F.when(~plain, F.transform("ids", lambda i: F.struct(i.alias("id"))))
    event = F.struct(F.when(plain, "book").otherwise("price_change").alias("event_type"), F.col("user_id").cast("string").alias("market"), F.col("received").cast("string").alias("timestamp"), changes.alias("price_changes"))
    frames = g.select("received", F.when(F.col("user_id") % 2 == 0, F.to_json(F.array(event))).otherwise(F.to_json(event)).alias("text"))
    rows = raw.explode_frames(frames, "text", "received", "struct<id: bigint>")
    return rows.select("received", "event_type", "market", "timestamp_ms", "frame_id", F.col("child").cast("long").alias("child"), F.col("change.id").alias("id"))


@register("p06_levels", f"{EV} SELECT event_id, CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END AS levels, k / 100.0::DOUBLE AS best, CASE WHEN k % 5 = 0 THEN 1.5 ELSE 1.5 + k END::DOUBLE AS size FROM ev")
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of text prices and sizes; every fifth second level is no number."""
    level = lambda p, s: F.struct(p.alias("price"), s.alias("size"))
    text = F.array(level((F.col("k") / 100).cast("string"), F.lit("1.5")), level(F.lit("0.5"), F.when(F.col("k") % 5 == 0, "bad").otherwise(F.col("k").cast("string"))))
    rows = X.events(spark, sf_dir).select("event_id", raw.parse_levels(text).alias("l"))
    return rows.select("event_id", F.size("l").alias("levels"), F.element_at("l", 1)["price"].alias("best"), F.aggregate("l", F.lit(0.0), lambda a, x: a + x["size"]).alias("size"))


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.book(spark, sf_dir)
    return b.select("*", F.concat(F.lit("v"), F.col("seq") % 5).alias("collector_version"), F.when(F.col("seq") % 13 == 0, "STALE").otherwise("VALID").alias("book_state_status")).withColumn("best_bid", F.when(F.col("seq") % 17 != 0, F.col("best_bid")))


@register("p11_valid_book_rows", f"{with_sql('ev', 'book')} SELECT outcome, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM book WHERE seq % 5 = 4 AND book_state_valid AND seq % 13 <> 0 AND seq % 17 <> 0 GROUP BY 1")
def valid_book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid book rows of one collector version."""
    return raw.valid_book_rows(_versioned(spark, sf_dir), "v4").groupBy("outcome").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@register("p16_version_filter", f"{with_sql('ev', 'book')} SELECT count(*) FILTER (seq % 5 = 4) AS kept, count(*) FILTER (seq % 5 <> 4) AS excluded FROM book")
def version_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one collector version, and how many others."""
    return raw.version_counts(_versioned(spark, sf_dir), "v4")


@register("p21_rotation_codes", f"""{EV}, m AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS signups, count(*) FILTER (event_type = 'click') AS clicks, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'view') AS views, max(ms) - min(ms) AS span FROM ev GROUP BY 1)
SELECT code, count(*) AS n FROM (SELECT CASE WHEN signups = 0 THEN 'DISCOVERY' WHEN clicks < 3 THEN 'SUBSCRIPTION' WHEN kinds < 4 THEN 'DUAL_TOKEN' WHEN views < 10 THEN 'SNAPSHOT' WHEN span > {600 * HOUR} THEN 'GAP' ELSE 'PASS' END AS code FROM m) GROUP BY 1""")  # fmt: skip
def rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each user's events fail."""
    kind = lambda t: F.count_if(F.col("event_type") == t)
    m = X.events(spark, sf_dir).groupBy("user_id").agg(kind("signup").alias("signups"), kind("click").alias("clicks"), F.count_distinct("event_type").alias("kinds"), kind("view").alias("views"), (F.max("ms") - F.min("ms")).alias("span"))
    code = raw.rotation_code(F.col("signups") > 0, F.col("clicks") >= 3, F.col("kinds") - 2, (F.col("views") / 5).cast("int"), F.col("span"), 600 * HOUR)
    return m.select(F.coalesce(code, F.lit("PASS")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@register("p24_row_digests", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS digest FROM customer""")
def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha256 of customers as canonical JSON."""
    c = X.table(spark, sf_dir, "customer")
    return c.select("c_custkey", S.row_digest(c, ["c_name", "c_nationkey", "c_custkey"]).alias("digest"))


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars of a user's events by day, written as JSON and read back."""
    e = X.events(spark, sf_dir).withColumn("day", F.floor(F.col("ms") / (24 * HOUR)))
    g = e.groupBy("user_id", "day").agg(F.min("ms").alias("first_timestamp_ms"), F.max("ms").alias("last_timestamp_ms"), F.count("*").alias("record_count"))
    name = F.concat_ws("/", "user_id", "day")
    g = g.select(
        name.alias("file"), F.when(F.col("day") % 11 != 0, F.col("user_id").cast("string")).alias("session_id"), "first_timestamp_ms", F.when(F.col("day") % 13 != 0, F.col("last_timestamp_ms")).alias("last_timestamp_ms"), "record_count",
        F.when(F.col("day") % 5 == 0, 1).otherwise(0).alias("parse_errors"), F.when(F.col("day") % 7 == 0, "BAD").otherwise("OK").alias("integrity_status"), F.sha2(name, 256).alias("sha256"),
    )
    path = files.shared_path(spark, "sidecars")
    g.write.json(path)
    return files.read_ndjson(spark, path, "file string, session_id string, first_timestamp_ms bigint, last_timestamp_ms bigint, record_count bigint, parse_errors int, integrity_status string, sha256 string")


CLOSED = f"closed AS (SELECT user_id || '/' || ms // {24 * HOUR} AS file, user_id::VARCHAR AS session_id, min(ms) AS first_timestamp_ms, max(ms) AS last_timestamp_ms, count(*) AS record_count FROM ev GROUP BY user_id, ms // {24 * HOUR} HAVING (ms // {24 * HOUR}) % 11 <> 0 AND (ms // {24 * HOUR}) % 13 <> 0 AND (ms // {24 * HOUR}) % 5 <> 0 AND (ms // {24 * HOUR}) % 7 <> 0)"


@register("s04_closed_files", f"{EV}, {CLOSED} SELECT *, sha256(file) AS sha256 FROM closed")
def closed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of usable closed files from their sidecars."""
    return raw.closed_files(_sidecars(spark, sf_dir))


@register("j08_files_for_windows", f"""{EV}, {CLOSED}, w AS (SELECT event_id, user_id::VARCHAR AS session_id, ms - {36 * HOUR} AS start_ms, ms AS end_ms FROM ev WHERE event_type = 'purchase'),
m AS (SELECT event_id, file, start_ms, last_timestamp_ms, first_timestamp_ms FROM w JOIN closed USING (session_id) WHERE first_timestamp_ms <= end_ms)
SELECT event_id, file, 'OVERLAP' AS role FROM m WHERE last_timestamp_ms >= start_ms UNION ALL SELECT event_id, arg_max(file, (last_timestamp_ms, first_timestamp_ms, file)), 'PREDECESSOR' FROM m WHERE last_timestamp_ms < start_ms GROUP BY 1""")  # fmt: skip
def files_for_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of 36 hours before each purchase, and the one before them."""
    w = X.events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", F.col("user_id").cast("string").alias("session_id"), (F.col("ms") - 36 * HOUR).alias("start_ms"), F.col("ms").alias("end_ms"))
    return raw.files_for_windows(raw.closed_files(_sidecars(spark, sf_dir)), w, "event_id")


@register("s05_session_journals", f"{with_sql('ev', 'sessions')} SELECT session_id, arg_min(event, seq) AS kind, count(*) AS entries, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms FROM sessions GROUP BY 1")
def session_journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session journals written as NDJSON and read back, a row each."""
    path = files.shared_path(spark, "journals")
    X.sessions(spark, sf_dir).write.json(path)
    return raw.sessions_of(files.read_ndjson(spark, path, "session_id string, seq bigint, event string, timestamp_ms bigint"), "session_id", "seq", "event", "timestamp_ms")


@register("s06_attempt_lines", """WITH c AS (SELECT conv_id, count(*) AS calls, sum(length(text)) AS tokens FROM conversations GROUP BY 1)
SELECT CASE WHEN conv_id % 11 = 0 THEN 'INCOMPLETE' WHEN conv_id % 7 = 0 THEN 'DUPLICATE_KEY' WHEN conv_id % 5 = 0 THEN 'OVERSIZE' ELSE 'OK' END AS status, count(*) AS lines,
 coalesce(sum(CASE WHEN conv_id % 11 <> 0 AND conv_id % 7 <> 0 AND conv_id % 5 <> 0 THEN calls END), 0)::BIGINT AS calls, coalesce(sum(CASE WHEN conv_id % 11 <> 0 AND conv_id % 7 <> 0 AND conv_id % 5 <> 0 THEN tokens END), 0)::BIGINT AS tokens FROM c GROUP BY 1""")  # fmt: skip
def attempt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an attempt log, some cut off, too long or with a key written twice; the calls of good ones."""
    t = X.table(spark, sf_dir, "conversations")
    call = F.struct(F.col("turn").cast("long").alias("turn"), F.char_length("text").cast("long").alias("tokens"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(call)).alias("model_calls"))
    body = F.to_json(F.struct("conv_id", "model_calls"))
    cid = F.col("conv_id")
    line = F.when(cid % 11 == 0, F.expr("substring(body, 1, length(body) - 1)")).when(cid % 7 == 0, F.concat(F.lit('{"conv_id":1,'), F.expr("substring(body, 2)"))).when(cid % 5 == 0, F.concat("body", F.repeat(F.lit(" "), F.lit(100000)))).otherwise(F.col("body"))
    lines = raw.attempt_lines(g.withColumn("body", body).select(line.alias("text")), "text", "conv_id bigint, model_calls array<struct<turn: bigint, tokens: bigint>>", 100000)
    calls = F.col("line.model_calls")
    tokens = F.aggregate(calls, F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return lines.groupBy("status").agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.array_size(calls)), F.lit(0)).alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))


@register("s15_market_metadata", f"{with_sql('ev', 'fills')} SELECT DISTINCT condition_id, CASE WHEN market_start_ms // 604800000 % 3 = 0 THEN 'other' ELSE slug END AS slug, market_start_ms, market_end_ms, 'Down=' || condition_id || '-d;Up=' || condition_id || '-u' AS tokens FROM fills")
def market_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata bodies with either form of tokens, slugs that name no time in every third week, and no end in every second."""
    m = X.fills(spark, sf_dir).select("condition_id", "slug", "market_start_ms", "market_end_ms").distinct()
    week = F.floor(F.col("market_start_ms") / X.WEEK)
    ids = F.array(F.concat("condition_id", F.lit("-d")), F.concat("condition_id", F.lit("-u")))
    names = F.array(F.lit("Down"), F.lit("Up"))
    zipped = F.zip_with(names, ids, lambda o, t: F.struct(o.alias("outcome"), t.alias("token_id")))
    body = F.to_json(F.struct(
        F.col("condition_id").alias("conditionId"), F.when(week % 3 == 0, "other").otherwise(F.col("slug")).alias("slug"), F.when(week % 3 == 0, F.col("market_start_ms")).otherwise(1).cast("string").alias("startDate"),
        F.when(week % 2 == 0, F.col("market_end_ms").cast("string")).alias("endDate"), F.when(week % 2 == 0, zipped).alias("tokens"), F.when(week % 2 == 1, ids).alias("clobTokenIds"), F.when(week % 2 == 1, names).alias("outcomes"),
    ))
    out = raw.market_metadata(m.select(body.alias("body")), "body", "w7d-", 604800)
    return out.withColumn("tokens", F.array_join(F.transform("tokens", lambda t: F.concat_ws("=", t["outcome"], t["token_id"])), ";"))


@register("s16_order_telemetry", """WITH e AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 6 = 0 AND l_linenumber = 2 THEN 1 ELSE l_linenumber END AS event FROM lineitem)
SELECT l_orderkey::VARCHAR AS intent_id, CASE WHEN bool_or(l_orderkey % 10 = 0) THEN 'BAD_FIELD' WHEN count(DISTINCT event) < count(*) THEN 'DUPLICATE_EVENT' ELSE 'OK' END AS status, count(*) AS events, round(CASE WHEN bool_or(l_orderkey % 10 = 0) THEN NULL ELSE sum(l_quantity) END, 2) AS filled FROM e GROUP BY 1, l_orderkey""")
def order_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order events as JSON lines grouped to intents; some quantities are no numbers, some event ids come twice."""
    li = X.table(spark, sf_dir, "lineitem")
    event = F.when((F.col("l_orderkey") % 6 == 0) & (F.col("l_linenumber") == 2), 1).otherwise(F.col("l_linenumber"))
    quantity = F.when(F.col("l_orderkey") % 10 != 0, F.col("l_quantity").cast("string")).otherwise("many")
    body = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("intent_id"), F.concat_ws("-", "l_orderkey", event).alias("event_id"), F.col("l_linenumber").alias("seq"), F.lit("FILL").alias("event_type"), quantity.alias("quantity")))
    return raw.order_telemetry(li.select(body.alias("text")), "text").select("intent_id", "status", F.size("events").cast("long").alias("events"), F.round("filled", 2).alias("filled"))


@register("s11_manifest_verification", """SELECT 'OK' AS status, 3::BIGINT AS files, 0::BIGINT AS parse_errors WHERE (SELECT count(*) FROM events) > 0
UNION ALL SELECT 'CORRUPT', 1, (SELECT count(*) FROM events WHERE event_id % 6 = 3) UNION ALL SELECT 'SHA_MISMATCH', 1, 0 UNION ALL SELECT 'MISSING_SIDECAR', 1, 0 UNION ALL SELECT 'MISSING_FILE', 1, 0""")
def manifest_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six files of events against a stored manifest that lacks one, names one that is not there and has one wrong hash; one file holds broken lines."""
    path = files.shared_path(spark, "verified")
    e = X.events(spark, sf_dir).withColumn("part", F.col("event_id") % 6)
    body = F.when(F.col("part") == 3, F.substring(F.to_json(F.struct("event_id", "ms")), 1, 8)).otherwise(F.to_json(F.struct("event_id", "ms")))
    e.select("part", body.alias("value")).repartition(6, "part").sortWithinPartitions("part").write.partitionBy("part").text(path)
    part = F.regexp_extract("file", "part=([0-9]+)", 1)
    found = files.manifest(spark, f"{path}/*", "ms").select(part.alias("file"), "sha256", "parse_errors")
    stored = found.where("file <> '4'").select("file", F.when(F.col("file") == "5", "0").otherwise(F.col("sha256")).alias("sha256")).unionByName(spark.createDataFrame([("9", "0")], "file string, sha256 string"))
    return raw.verify_manifest(stored, found)


@register("j10_events_in_forward_window", f"""{EPISODES} SELECT o.condition_id, count(b.fill_id) AS n, min(b.timestamp_ms) AS first_ms FROM opp o LEFT JOIN buys b ON b.condition_id = o.condition_id AND b.outcome = o.opposite AND b.timestamp_ms > o.t0_ms AND b.timestamp_ms <= o.t0_ms + {HORIZON} GROUP BY 1""")
def events_in_forward_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buys of the opposite direction within the horizon after t0."""
    f, opposite = _opposites(spark, sf_dir)
    anchors = opposite.select("condition_id", F.col("opposite").alias("outcome"), "t0_ms")
    buys = f.where(F.coalesce(S.buy_fill_code(F.col("timestamp_ms"), F.col("size"), F.col("price"), F.col("condition_id")), F.lit("VALID")) == "VALID").where("side = 'BUY'")
    return raw.first_in_window(anchors.withColumn("anchor", F.col("condition_id")), buys, ["condition_id", "outcome"], "anchor", "t0_ms", "timestamp_ms", HORIZON).withColumnRenamed("anchor", "condition_id")


@register("f09_source_status", f"""{EV}, f AS (SELECT user_id, ms // {24 * HOUR} AS day, count(*) AS n FROM ev GROUP BY ALL), s AS (SELECT user_id, CASE WHEN day = (SELECT max(ms) // {24 * HOUR} FROM ev) THEN 'ACTIVE' WHEN n % 5 = 0 THEN 'BAD' ELSE 'VERIFIED' END AS state FROM f)
SELECT user_id, CASE WHEN count(*) FILTER (state = 'ACTIVE') > 0 THEN 'PENDING' WHEN count(*) FILTER (state = 'BAD') = 0 THEN 'FINAL' ELSE 'NOT_CAPTURED' END AS status, count(*) FILTER (state = 'ACTIVE') AS active, count(*) FILTER (state = 'VERIFIED') AS verified, count(*) FILTER (state = 'BAD') AS other FROM s GROUP BY 1""")  # fmt: skip
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether each user's daily files are final, pending or not captured."""
    e = X.events(spark, sf_dir).withColumn("day", F.floor(F.col("ms") / (24 * HOUR)))
    last = e.agg(F.max("day").alias("last"))
    g = e.groupBy("user_id", "day").agg(F.count("*").alias("n")).crossJoin(F.broadcast(last))
    state = F.when(F.col("day") == F.col("last"), "ACTIVE").when(F.col("n") % 5 == 0, "BAD").otherwise("VERIFIED")
    return raw.source_status(g.select("user_id", F.col("day").cast("string").alias("file"), state.alias("state")), "user_id")
