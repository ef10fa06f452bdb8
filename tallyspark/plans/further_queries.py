"""Registered queries of smaller operators, written directly with DataFrame functions, each with an independent SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import coverage, features, ledger, stats
from tallyspark.operators.temporal_joins import asof_backward
from tallyspark.plans.more_queries import _MONTHS, GRID, STALE, STEP, _grid, _months
from tallyspark.plans.queries import EPISODES, FILLS, GAP, HORIZON, INTERVALS, MARKETS, ORACLES, CUTS, _cuts, _opposites, label_sql, r6, register
from tallyspark.sources import fixtures as X
from tallyspark.sources.fixtures import HOUR, with_sql

EV = with_sql("ev")


@register("p02_parse_times", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 0 THEN epoch_us(ts) // 1000000 * 1000 ELSE epoch_us(ts) // 1000 END AS ms FROM events")
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text: seconds, milliseconds, ISO-8601 or junk."""
    e = X.events(spark, sf_dir)
    iso = F.date_format(F.timestamp_millis("ms").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    iso = F.concat(F.to_json(F.struct(iso.alias("t"))).substr(7, 23), F.lit("Z"))
    text = F.when(F.col("event_id") % 4 == 0, F.floor(F.col("ms") / 1000).cast("string")).when(F.col("event_id") % 4 == 1, F.col("ms").cast("string")).when(F.col("event_id") % 4 == 2, iso).otherwise("never")
    return e.select("event_id", S.parse_ms(text).alias("ms"))


@register("p07_fill_codes", f"{FILLS} SELECT CASE WHEN fill_id % 5 = 0 THEN 'TIMESTAMP_INVALID' WHEN fill_id % 7 = 0 OR size <= 0 THEN 'FIELD_INCOMPLETE' ELSE 'VALID' END AS code, count(*) AS n FROM fills GROUP BY 1")
def fill_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity codes of damaged fills."""
    f = X.fills(spark, sf_dir).withColumn("t", F.when(F.col("fill_id") % 5 != 0, F.col("timestamp_ms"))).withColumn("p", F.when(F.col("fill_id") % 7 != 0, F.col("price")))
    return f.groupBy(F.coalesce(S.buy_fill_code(F.col("t"), F.col("size"), F.col("p"), F.col("condition_id")), F.lit("VALID")).alias("code")).agg(F.count("*").alias("n"))


@register("p18_cutoff_modes", f"{EV} SELECT event_id, mode, ms - gap AS cutoff_ms FROM ev, (VALUES ('cutoff_1', 1), ('cutoff_1000', 1000), ('cutoff_2000', 2000)) t(mode, gap) WHERE event_type = 'purchase'")
def cutoff_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cutoff mode."""
    modes = F.explode(F.array(*[F.struct(F.lit(f"cutoff_{g}").alias("mode"), F.lit(g).alias("gap")) for g in (1, 1000, 2000)]))
    return X.events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "ms", modes.alias("m")).select("event_id", F.col("m.mode").alias("mode"), (F.col("ms") - F.col("m.gap")).alias("cutoff_ms"))


@register("p19_fill_seconds", f"{EV} SELECT event_id, ms // 1000 * 1000 AS start_ms, ms // 1000 * 1000 + 999 AS end_ms, ms // 1000 * 1000 - 1 AS context_ms, ms // 1000 = (ms + k) // 1000 AS same_second FROM ev")
def fill_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second that holds a fill, and the cutoff before it."""
    second = F.floor(F.col("ms") / 1000) * 1000
    return X.events(spark, sf_dir).select("event_id", second.alias("start_ms"), (second + 999).alias("end_ms"), (second - 1).alias("context_ms"), (F.floor(F.col("ms") / 1000) == F.floor((F.col("ms") + F.col("k")) / 1000)).alias("same_second"))


@register("p26_allow_list", """SELECT CASE WHEN o_orderpriority NOT LIKE '1%' THEN 'priority' WHEN o_totalprice IS NULL OR o_totalprice < 50000 THEN 'price' WHEN count(*) OVER (PARTITION BY o_custkey) > 30 THEN 'repeated' ELSE 'kept' END AS reason, o_orderkey FROM orders""".replace("SELECT CASE", "WITH r AS (SELECT CASE", 1) + ") SELECT reason, count(*) AS n FROM r GROUP BY 1")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the first reason that drops a row."""
    repeated = F.count("*").over(Window.partitionBy("o_custkey")) > 30
    reason = F.when(~F.col("o_orderpriority").startswith("1"), "priority").when(F.col("o_totalprice").isNull() | (F.col("o_totalprice") < 50000), "price").when(repeated, "repeated").otherwise("kept")
    return X.table(spark, sf_dir, "orders").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register("p29_market_consistency", f"{FILLS}, {MARKETS}, o AS (SELECT condition_id, list_sort(list(DISTINCT outcome)) AS os, min(slug) AS slug FROM fills GROUP BY 1) SELECT o.condition_id, CASE WHEN os <> ['Down', 'Up'] THEN 'TOKENS' END AS violation, market_start_ms - 60000 AS subscribe_ms, market_end_ms + 60000 AS unsubscribe_ms FROM o JOIN markets USING (condition_id)")
def market_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug, window and tokens of each market, and its schedule."""
    f = X.fills(spark, sf_dir)
    m = f.groupBy("condition_id").agg(F.array_sort(F.collect_set("outcome")).alias("os"), F.min("slug").alias("slug"), F.min("market_start_ms").alias("a"), F.max("market_end_ms").alias("z"))
    start, end = S.slug_window(F.col("slug"), "w7d-", 604800)
    bad = F.when(start.isNull(), "SLUG").when((start != F.col("a")) | (end != F.col("z")), "WINDOW").when(F.col("os") != F.array(F.lit("Down"), F.lit("Up")), "TOKENS")
    return m.select("condition_id", bad.alias("violation"), (F.col("a") - 60000).alias("subscribe_ms"), (F.col("z") + 60000).alias("unsubscribe_ms"))


@register("e11_persistence", f"""{EPISODES}, {label_sql(0, HORIZON, "w0")}, {label_sql(HORIZON, HORIZON, "w1")}, {MARKETS}, j AS (SELECT market_start_ms AS week_ms, w0.label AS a, w1.label AS b FROM w0 JOIN w1 USING (condition_id) JOIN markets USING (condition_id))
SELECT week_ms, count(*) AS n, round(avg(a), 6) AS first_rate, round(avg(b), 6) AS second_rate FROM j GROUP BY 1""")  # fmt: skip
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of two neighbouring windows per week."""
    f, opposite = _opposites(spark, sf_dir)
    a = ledger.forward_label(f, opposite, HORIZON).select("condition_id", F.col("label").alias("a"))
    b = ledger.forward_label(f, opposite, HORIZON, HORIZON).select("condition_id", F.col("label").alias("b"))
    weeks = f.select("condition_id", F.col("market_start_ms").alias("week_ms")).distinct()
    return a.join(b, "condition_id").join(weeks, "condition_id").groupBy("week_ms").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("first_rate"), F.round(F.avg("b"), 6).alias("second_rate"))


@register("f14_operations_summary", f"{with_sql('ev', 'sessions')} SELECT count(DISTINCT session_id) AS sessions, count(*) AS records, count(*) FILTER (event = 'connected') AS connects, count(*) FILTER (event = 'connection_error') AS errors, CASE WHEN count(*) FILTER (event = 'connection_error') > count(*) FILTER (event = 'connected') THEN 'DEGRADED' ELSE 'OK' END AS status FROM sessions")
def operations_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """totals of the journals."""
    n = lambda e: F.count_if(F.col("event") == e)
    out = X.sessions(spark, sf_dir).agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("records"), n("connected").alias("connects"), n("connection_error").alias("errors"))
    return out.withColumn("status", F.when(F.col("errors") > F.col("connects"), "DEGRADED").otherwise("OK"))


@register("f17_covered_days", f"{EV}, d AS (SELECT ms // 86400000 AS d, count(*) AS n, count(DISTINCT event_type) AS kinds FROM ev GROUP BY 1) SELECT count(*) FILTER (n >= 5 AND kinds = 5) AS covered, count(*) AS days FROM d")
def covered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """days on which all kinds of events came."""
    d = X.events(spark, sf_dir).groupBy(F.floor(F.col("ms") / 86_400_000).alias("d")).agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))
    return d.agg(F.count_if((F.col("n") >= 5) & (F.col("kinds") == 5)).alias("covered"), F.count("*").alias("days"))


_WHY = "CASE WHEN l_quantity < {q} THEN 'quantity' END, CASE WHEN l_discount > {d} THEN 'discount' END"


@register("f13_policy_migration", f"WITH p AS (SELECT concat_ws(';', {_WHY.format(q=5, d=0.08)}) = '' AS v1, concat_ws(';', {_WHY.format(q=10, d=0.05)}) = '' AS v2 FROM lineitem) SELECT CASE WHEN v1 THEN 'ELIGIBLE' ELSE 'EXCLUDED' END || '->' || CASE WHEN v2 THEN 'ELIGIBLE' ELSE 'EXCLUDED' END AS transition, count(*) AS n FROM p GROUP BY 1")
def policy_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transitions between two policies of eligibility."""
    why = lambda q, d: F.size(S.reasons((F.col("l_quantity") < q, "quantity"), (F.col("l_discount") > d, "discount")))
    name = lambda c: F.when(c == 0, "ELIGIBLE").otherwise("EXCLUDED")
    return X.table(spark, sf_dir, "lineitem").select(F.concat(name(why(5, 0.08)), F.lit("->"), name(why(10, 0.05))).alias("transition")).groupBy("transition").agg(F.count("*").alias("n"))


@register("f19_boundary_inclusion", f"{INTERVALS} SELECT DISTINCT session_id FROM iv WHERE start_ms < 1705276800000 AND end_ms >= 1705276800000")
def boundary_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sessions that began before a boundary and reach over it."""
    return ledger.connection_intervals(X.sessions(spark, sf_dir)).where("start_ms < 1705276800000 and end_ms >= 1705276800000").select("session_id").distinct()


@register("f02_pre_cutoff_coverage", f"""{with_sql("ev", "ticks")}, d AS (SELECT condition_id, min(exchange_ms) AS start_ms FROM ticks GROUP BY 1) SELECT d.condition_id, round(nullif(count(DISTINCT (exchange_ms - start_ms) // {HOUR}) FILTER (exchange_ms > start_ms AND exchange_ms < start_ms + {48 * HOUR}), 0) / 48, 6) AS coverage FROM d JOIN ticks USING (condition_id) GROUP BY 1""")
def pre_cutoff_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coverage of two days after a feed's first tick, null without further ticks."""
    t = X.ticks(spark, sf_dir)
    w = t.groupBy("condition_id").agg(F.min("exchange_ms").alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 48 * HOUR)
    later = t.join(w, "condition_id").where("exchange_ms > start_ms and exchange_ms < end_ms").select("condition_id", "exchange_ms")
    return coverage.bucket_coverage(w, later, "condition_id", "exchange_ms", HOUR).select("condition_id", F.round(F.nullif("coverage", F.lit(0.0)), 6).alias("coverage"))


@register("g07_update_counts", f"{with_sql('ev', 'book')}, {CUTS} SELECT event_id, count(*) FILTER (receive_ms > cut_ms - {6 * HOUR}) AS n_short, count(*) AS n_long FROM cuts JOIN book USING (condition_id) WHERE receive_ms <= cut_ms AND receive_ms > cut_ms - {24 * HOUR} GROUP BY 1")
def update_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book updates in two windows before each purchase."""
    pairs = features.in_window(_cuts(spark, sf_dir), X.book(spark, sf_dir).select("condition_id", "receive_ms"), "condition_id", "cut_ms", "receive_ms", 24 * HOUR)
    return pairs.groupBy("event_id").agg(F.count_if(F.col("receive_ms") > F.col("cut_ms") - 6 * HOUR).alias("n_short"), F.count("*").alias("n_long"))


@register("g09_trader_state", f"""{EPISODES}, q AS (SELECT b.condition_id, sum(CASE WHEN b.outcome = initial THEN size ELSE 0 END) AS own, sum(CASE WHEN b.outcome <> initial THEN size ELSE 0 END) AS other, max(timestamp_ms) - min(timestamp_ms) AS elapsed FROM buys b JOIN init USING (condition_id) GROUP BY 1)
SELECT condition_id, round(own / nullif(own + other, 0), 6) AS share, round(own - other, 6) AS net, elapsed FROM q""")  # fmt: skip
def trader_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of a market's two sides."""
    f = X.fills(spark, sf_dir)
    b = ledger.valid_buys(f).join(ledger.initial_direction(f).select("condition_id", "initial"), "condition_id")
    own, other = F.sum(F.when(F.col("outcome") == F.col("initial"), F.col("size")).otherwise(0.0)), F.sum(F.when(F.col("outcome") != F.col("initial"), F.col("size")).otherwise(0.0))
    q = b.groupBy("condition_id").agg(own.alias("own"), other.alias("other"), (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("elapsed"))
    return q.select("condition_id", F.round(F.col("own") / F.nullif(F.col("own") + F.col("other"), F.lit(0.0)), 6).alias("share"), F.round(F.col("own") - F.col("other"), 6).alias("net"), "elapsed")


@register("g16_sanity_transitions", "SELECT CASE WHEN o_totalprice < 1000 OR o_totalprice > 300000 THEN 'BAD' ELSE 'OK' END || '->' || CASE WHEN o_totalprice < 1000 OR o_totalprice > 400000 THEN 'BAD' ELSE 'OK' END AS transition, count(*) AS n FROM orders GROUP BY 1")
def sanity_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of two sanity domains compared."""
    o = X.table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("decimal(18,6)").alias("v"))
    bad = lambda hi: F.when((F.col("v") < 1000) | (F.col("v") > hi), "BAD").otherwise("OK")
    return o.groupBy(F.concat(bad(300000), F.lit("->"), bad(400000)).alias("transition")).agg(F.count("*").alias("n"))


@register("h04_clock_basis", f"{with_sql('ev', 'ticks')}, b AS (SELECT 'exchange' AS basis, condition_id, exchange_ms AS t, price, trade_id FROM ticks UNION ALL SELECT 'receive', condition_id, receive_ms, price, trade_id FROM ticks), r AS (SELECT *, lag(price) OVER (PARTITION BY basis, condition_id ORDER BY t, trade_id) AS p FROM b) SELECT basis, count(*) AS n, round(sum(abs(price - p)), 4) AS moved FROM r WHERE p IS NOT NULL GROUP BY 1")
def clock_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same timeline by exchange and by receive time."""
    t = X.ticks(spark, sf_dir)
    both = t.select(F.lit("exchange").alias("basis"), "condition_id", F.col("exchange_ms").alias("t"), "price", "trade_id").unionByName(t.select(F.lit("receive").alias("basis"), "condition_id", F.col("receive_ms").alias("t"), "price", "trade_id"))
    before = F.lag("price").over(Window.partitionBy("basis", "condition_id").orderBy("t", "trade_id"))
    return both.withColumn("p", before).where("p is not null").groupBy("basis").agg(F.count("*").alias("n"), F.round(F.sum(F.abs(F.col("price") - F.col("p"))), 4).alias("moved"))


@register("h21_state_age", f"{GRID.replace('receive_ms FROM book b', 'receive_ms, receive_ms - k AS born FROM book b').replace('THEN b.mid END AS mid FROM', 'THEN b.mid END AS mid, g.ms - b.receive_ms AS age, g.ms - b.born AS info_age FROM')} SELECT count(*) AS n, round(avg(age), 3) AS age, round(avg(info_age), 3) AS info_age, count(*) FILTER (info_age > {12 * HOUR}) AS invalid FROM grid WHERE age IS NOT NULL")
def state_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of the available book state, and of what it tells."""
    e = X.events(spark, sf_dir)
    spans = e.groupBy(F.col("user_id").cast("string").alias("condition_id")).agg((F.floor(F.min("ms") / STEP) * STEP).alias("a"), (F.floor(F.max("ms") / STEP) * STEP).alias("z"))
    g = spans.where("z > a").select("condition_id", F.explode(F.sequence(F.col("a"), F.col("z") - 1, F.lit(STEP).cast("long"))).alias("ms"))
    b = e.where("event_type in ('view', 'click')").select(F.col("user_id").cast("string").alias("condition_id"), "ms", (F.col("ms") - F.col("k")).alias("born"), F.col("event_id").alias("seq"))
    out = asof_backward(g, b, "condition_id", "ms", ["born"], ["seq"]).where("age_ms is not null").withColumn("info", F.col("ms") - F.col("born"))
    return out.agg(F.count("*").alias("n"), F.round(F.avg("age_ms"), 3).alias("age"), F.round(F.avg("info"), 3).alias("info_age"), F.count_if(F.col("info") > 12 * HOUR).alias("invalid"))


@register("i08_rate_surface", f"{EPISODES}, {label_sql(0, HORIZON)}, {MARKETS}, j AS (SELECT market_start_ms AS week_ms, label, opposite_shares, market_end_ms >= t0_ms + {HORIZON} AS ok FROM lab JOIN markets USING (condition_id)) SELECT week_ms, count(*) AS markets, count(*) FILTER (NOT ok) AS censored, round(quantile_cont(opposite_shares, 0.5), 6) AS median_shares, coalesce(sum(label) FILTER (ok), 0)::BIGINT AS positives FROM j GROUP BY 1")
def rate_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly surface of counts, censoring and medians."""
    f, opposite = _opposites(spark, sf_dir)
    m = f.select("condition_id", "market_start_ms", "market_end_ms").distinct()
    j = ledger.forward_label(f, opposite, HORIZON).join(m, "condition_id").withColumn("ok", F.col("market_end_ms") >= F.col("t0_ms") + HORIZON)
    return j.groupBy(F.col("market_start_ms").alias("week_ms")).agg(F.count("*").alias("markets"), F.count_if(~F.col("ok")).alias("censored"), F.round(F.percentile("opposite_shares", F.lit(0.5)), 6).alias("median_shares"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("label"))), F.lit(0)).alias("positives"))


@register("i12_break_support", f"""WITH a AS ({ORACLES["i10_cusum_break"]}), b AS ({ORACLES["i11_split_break"]}), k AS (SELECT period, row_number() OVER (ORDER BY period) AS i FROM ({_MONTHS} SELECT period FROM m))
SELECT 'all' AS metric, break_at, split_at, CASE WHEN abs(x.i - y.i) <= 1 THEN 'SUPPORTED_BREAK' ELSE 'UNSUPPORTED' END AS support FROM a, b, k x, k y WHERE x.period = break_at AND y.period = split_at""")  # fmt: skip
def break_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both break methods agree within one period ."""
    m = _months(spark, sf_dir).withColumn("metric", F.lit("all")).withColumn("i", F.row_number().over(Window.partitionBy("metric").orderBy("period")))
    a = stats.cusum_break(m, "metric", "period", "rate").join(m.select("metric", F.col("period").alias("break_at"), F.col("i").alias("ia")), ["metric", "break_at"])
    b = stats.split_break(m, "metric", "period", "rate").join(m.select("metric", F.col("period").alias("split_at"), F.col("i").alias("ib")), ["metric", "split_at"])
    near = F.abs(F.col("ia") - F.col("ib")) <= 1
    return a.select("metric", "break_at", "ia").join(b.select("metric", "split_at", "ib"), "metric").select("metric", "break_at", "split_at", F.when(near, "SUPPORTED_BREAK").otherwise("UNSUPPORTED").alias("support"))


@register("i18_universe_placebo", f"{FILLS}, u AS (SELECT condition_id, outcome, slug, CASE WHEN starts_with(slug, 'w7d-1704') THEN 'reference' ELSE 'other' END AS universe FROM fills WHERE side = 'BUY'), g AS (SELECT universe, count(*) AS n, avg((outcome = 'Up')::INT) AS rate FROM u GROUP BY 1) SELECT universe, n, round(rate, 6) AS rate, round(rate - (SELECT rate FROM g WHERE universe = 'reference'), 6) AS delta FROM g")
def universe_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of universes against the reference one."""
    u = X.fills(spark, sf_dir).where("side = 'BUY'").withColumn("universe", F.when(F.col("slug").startswith("w7d-1704"), "reference").otherwise("other"))
    g = u.groupBy("universe").agg(F.count("*").alias("n"), F.avg((F.col("outcome") == "Up").cast("double")).alias("rate"))
    ref = F.max(F.when(F.col("universe") == "reference", F.col("rate"))).over(Window.partitionBy())
    return g.select("universe", "n", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - ref, 6).alias("delta"))


@register("k07_declared_coverage", "WITH d AS (SELECT o_custkey, count(*) AS declared FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), s AS (SELECT o_custkey, count(*) AS observed FROM orders GROUP BY 1) SELECT s.o_custkey, observed, coalesce(declared, 0) AS declared, CASE WHEN declared IS NULL THEN 'UNDECLARED' WHEN observed <> declared THEN 'COUNT_MISMATCH' ELSE 'COMPLETE' END AS status FROM s LEFT JOIN d USING (o_custkey)")
def declared_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed orders against declared counts."""
    o = X.table(spark, sf_dir, "orders")
    d = o.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("declared"))
    out = o.groupBy("o_custkey").agg(F.count("*").alias("observed")).join(d, "o_custkey", "left")
    status = F.when(F.col("declared").isNull(), "UNDECLARED").when(F.col("observed") != F.col("declared"), "COUNT_MISMATCH").otherwise("COMPLETE")
    return out.select("o_custkey", "observed", F.coalesce("declared", F.lit(0)).alias("declared"), status.alias("status"))


@register("k16_restarts", f"{with_sql('ev', 'sessions')}, r AS (SELECT k % 3 AS exit_code, timestamp_ms - max(CASE WHEN event = 'connected' THEN timestamp_ms END) OVER (PARTITION BY session_id ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS runtime, event FROM sessions) SELECT exit_code, count(*) AS n, round(quantile_cont(runtime, 0.5), 3) AS p50, count(*) FILTER (runtime < {HOUR}) AS short FROM r WHERE event = 'disconnected' GROUP BY 1")
def restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtimes since the last start, per exit code."""
    by = Window.partitionBy("session_id").orderBy("timestamp_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    r = X.sessions(spark, sf_dir).withColumn("runtime", F.col("timestamp_ms") - F.max(F.when(F.col("event") == "connected", F.col("timestamp_ms"))).over(by)).where("event = 'disconnected'")
    return r.groupBy((F.col("k") % 3).alias("exit_code")).agg(F.count("*").alias("n"), F.round(F.percentile("runtime", F.lit(0.5)), 3).alias("p50"), F.count_if(F.col("runtime") < HOUR).alias("short"))


@register("k18_timeline", f"{with_sql('ev', 'sessions')}, l AS (SELECT session_id, timestamp_ms, CASE event WHEN 'connected' THEN 'WS_CONNECT' WHEN 'disconnected' THEN 'WS_CLOSE' WHEN 'connection_error' THEN 'WS_ERROR' END AS label FROM sessions WHERE event IN ('connected', 'disconnected', 'connection_error') UNION ALL SELECT session_id, min(timestamp_ms), 'FILE_FIRST' FROM sessions GROUP BY 1 UNION ALL SELECT session_id, max(timestamp_ms), 'FILE_LAST' FROM sessions GROUP BY 1) SELECT * FROM l")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled events with first and last marks."""
    j = X.sessions(spark, sf_dir)
    names = F.create_map(*[F.lit(x) for kv in {"connected": "WS_CONNECT", "disconnected": "WS_CLOSE", "connection_error": "WS_ERROR"}.items() for x in kv])
    own = j.select("session_id", "timestamp_ms", names[F.col("event")].alias("label")).where("label is not null")
    ends = j.groupBy("session_id").agg(F.min("timestamp_ms").alias("FILE_FIRST"), F.max("timestamp_ms").alias("FILE_LAST"))
    return own.unionByName(ends.unpivot("session_id", ["FILE_FIRST", "FILE_LAST"], "label", "timestamp_ms").select("session_id", "timestamp_ms", "label"))


@register("c14_cohort_upsert", "WITH v AS (SELECT o_custkey, 1 AS version, max(o_totalprice) AS best FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey, 2, max(o_totalprice) FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY version DESC) AS rn FROM v) SELECT sha256(o_custkey || '|' || version) AS observation_id, o_custkey, version, best FROM r WHERE rn = 1")
def cohort_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: the latest version of each cohort member."""
    o = X.table(spark, sf_dir, "orders")
    one = lambda df, v: df.groupBy("o_custkey").agg(F.max("o_totalprice").alias("best")).withColumn("version", F.lit(v))
    rows = one(o.where("o_orderstatus = 'F'"), 1).unionByName(one(o, 2))
    last = rows.groupBy("o_custkey").agg(F.max(F.struct("version", "best")).alias("x")).select("o_custkey", "x.*")
    return last.withColumn("observation_id", F.sha2(F.concat_ws("|", "o_custkey", "version"), 256))


@register("c10_source_membership", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey IS NULL THEN 'SOURCE_MISSING' WHEN p_size < 10 THEN 'HASH_MISMATCH' ELSE 'MEMBER' END AS reason FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 3 <> 0")
def source_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part is indexed, missing or different."""
    p = X.table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_size", F.lit(True).alias("found"))
    out = X.table(spark, sf_dir, "lineitem").join(p, "l_partkey", "left")
    reason = F.when(F.col("found").isNull(), "SOURCE_MISSING").when(F.col("p_size") < 10, "HASH_MISMATCH").otherwise("MEMBER")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", reason.alias("reason"))


@register("t06_stale_feeds", f"{with_sql('ev', 'book')}, g AS (SELECT condition_id, lead(receive_ms) OVER (PARTITION BY condition_id ORDER BY receive_ms, seq) - receive_ms AS d FROM book) SELECT condition_id, count(*) AS alarms, max(d) AS longest_ms FROM g WHERE d > {36 * HOUR} GROUP BY 1")
def stale_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T06, batch twin: alarms of feeds that were silent for longer than 36 hours."""
    by = Window.partitionBy("condition_id").orderBy("receive_ms", "seq")
    g = X.book(spark, sf_dir).withColumn("d", F.lead("receive_ms").over(by) - F.col("receive_ms")).where(F.col("d") > 36 * HOUR)
    return g.groupBy("condition_id").agg(F.count("*").alias("alarms"), F.max("d").alias("longest_ms"))
