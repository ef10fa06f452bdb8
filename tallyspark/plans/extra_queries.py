"""Registered queries of the further operators, each with an independent SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import grid, ledger, logs, more, stats
from tallyspark.plans.more_queries import _FEATURES, _MONTHS, _MOVES, _grid, _months, cross_correlation
from tallyspark.plans.queries import EPISODES, FILLS, GAP, HORIZON, INTERVALS, MARKETS, _cuts, _opposites, label_sql, r6, register
from tallyspark.sources import fixtures as X
from tallyspark.sources.fixtures import HOUR, WEEK, with_sql

EV = with_sql("ev")


@register("j09_assign_windows", f"{EV} SELECT ms // {WEEK} * {WEEK} AS window_start_ms, count(*) AS n FROM ev GROUP BY 1")
def assign_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per regular window."""
    return more.assign_windows(X.events(spark, sf_dir), "ms", WEEK).groupBy("window_start_ms").agg(F.count("*").alias("n"))


@register("j12_calendar_comparison", """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, (o_orderstatus = 'F')::INT AS y, o_totalprice > 150000 AS a FROM orders),
g AS (SELECT period, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb, avg(y) FILTER (a) AS ra, avg(y) FILTER (NOT a) AS rb FROM o GROUP BY 1 HAVING count(*) FILTER (a) >= 5 AND count(*) FILTER (NOT a) >= 5)
SELECT count(*) AS periods, round(avg(ra - rb), 6) AS mean_delta, round(sum((ra - rb) * least(na, nb)) / sum(least(na, nb)), 6) AS weighted_delta, round((SELECT avg(y) FILTER (a) - avg(y) FILTER (NOT a) FROM o), 6) AS pooled_delta FROM g""")  # fmt: skip
def calendar_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of large and small orders in the same months."""
    o = X.table(spark, sf_dir, "orders").select(F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM").alias("period"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice")
    return more.calendar_comparison(o.where("o_totalprice > 150000"), o.where("o_totalprice <= 150000"), "period", "y", 5).withColumns(r6("mean_delta", "weighted_delta", "pooled_delta"))


@register("k13_markouts", f"""{with_sql("ev", "book")}, f AS (SELECT event_id, user_id::VARCHAR AS condition_id, ms, (k % 100) / 100.0::DOUBLE AS price, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS sg FROM ev WHERE event_type = 'purchase')
SELECT f.event_id, round(b.mid, 6) AS mid_before, round(sg * (a1.mid - price), 6) AS m1, round(sg * (a2.mid - price), 6) AS m2 FROM f
LEFT JOIN LATERAL (SELECT mid FROM book b WHERE b.condition_id = f.condition_id AND b.receive_ms <= f.ms ORDER BY receive_ms DESC, seq DESC LIMIT 1) b ON true
LEFT JOIN LATERAL (SELECT mid FROM book b WHERE b.condition_id = f.condition_id AND b.receive_ms >= f.ms + {HOUR} ORDER BY receive_ms, seq LIMIT 1) a1 ON true
LEFT JOIN LATERAL (SELECT mid FROM book b WHERE b.condition_id = f.condition_id AND b.receive_ms >= f.ms + {24 * HOUR} ORDER BY receive_ms, seq LIMIT 1) a2 ON true""")  # fmt: skip
def markouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mids before and after purchases."""
    f = X.events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", F.col("user_id").cast("string").alias("condition_id"), "ms", ((F.col("k") % 100) / 100.0).alias("price"), F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("sg"))
    b = X.book(spark, sf_dir).select("condition_id", F.col("receive_ms").alias("ms"), "mid")
    out = more.markouts(f, b, "condition_id", "event_id", "ms", "mid", "price", "sg", [HOUR, 24 * HOUR])
    return out.select("event_id", F.round("mid_before", 6).alias("mid_before"), F.round(f"markout_{HOUR}", 6).alias("m1"), F.round(f"markout_{24 * HOUR}", 6).alias("m2"))


@register("e13_lifecycle", f"""{INTERVALS}, w AS (SELECT DISTINCT timestamp_ms // 86400000 AS window_id FROM sessions),
s AS (SELECT window_id, count(iv.session_id) > 0 AS start_ready FROM w LEFT JOIN iv ON start_ms <= window_id * 86400000 AND end_ms >= window_id * 86400000 GROUP BY 1),
e AS (SELECT window_id, count(iv.session_id) > 0 AS end_ready FROM w LEFT JOIN iv ON start_ms <= window_id * 86400000 + {HOUR} AND end_ms >= window_id * 86400000 + {HOUR} GROUP BY 1)
SELECT *, CASE WHEN start_ready AND end_ready THEN 'FULL' WHEN start_ready OR end_ready THEN 'PARTIAL' ELSE 'NONE' END AS lifecycle FROM s JOIN e USING (window_id)""")  # fmt: skip
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a session is connected at both ends of each day's first hour."""
    days = X.events(spark, sf_dir).select(F.floor(F.col("ms") / (24 * HOUR)).alias("window_id")).distinct()
    windows = days.select("window_id", (F.col("window_id") * 24 * HOUR).alias("start_ms"), (F.col("window_id") * 24 * HOUR + HOUR).alias("end_ms"))
    iv = ledger.connection_intervals(X.sessions(spark, sf_dir)).select(F.col("start_ms").alias("lo_ms"), F.col("end_ms").alias("hi_ms"))
    return more.endpoint_readiness(windows, iv, "window_id", 24 * HOUR)


@register("e17_initial_quantity", f"{EPISODES}, r AS (SELECT condition_id, outcome, shares, row_number() OVER (PARTITION BY condition_id, outcome ORDER BY start_ms) AS rn FROM eps) SELECT condition_id, outcome, round(shares, 6) AS quantity FROM r WHERE rn = 1")
def initial_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the first episode per market and outcome."""
    eps = ledger.episodes(X.fills(spark, sf_dir), GAP)
    return eps.groupBy("condition_id", "outcome").agg(F.round(F.min_by("shares", "start_ms"), 6).alias("quantity"))


@register("e18_recovered_ends", f"{with_sql('ev', 'sessions')} SELECT session_id, 'disconnected' AS event, max(timestamp_ms) AS timestamp_ms FROM sessions GROUP BY 1 HAVING bool_or(event = 'connected') AND NOT bool_or(event = 'disconnected')")
def recovered_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of sessions that never ended."""
    return more.recovered_ends(X.sessions(spark, sf_dir))


@register("e09_directional_sensitivity", f"""{EPISODES}, {label_sql(0, HORIZON)}, i AS (SELECT o.condition_id, min(f.timestamp_ms) AS sell_ms FROM opp o JOIN init USING (condition_id) JOIN fills f ON f.condition_id = o.condition_id AND f.side = 'SELL' AND f.outcome = initial AND f.timestamp_ms > t0_ms AND f.timestamp_ms <= t0_ms + {HORIZON} GROUP BY 1)
SELECT count(*) AS markets, sum(label)::BIGINT AS plain, count(*) FILTER (label = 1 OR sell_ms IS NOT NULL) AS wide, count(*) FILTER (label = 0 AND sell_ms IS NOT NULL) AS upgraded FROM lab LEFT JOIN i USING (condition_id)""")  # fmt: skip
def directional_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that count a SELL of the initial side, too."""
    f, opposite = _opposites(spark, sf_dir)
    label = ledger.forward_label(f, opposite, HORIZON)
    start = ledger.initial_direction(f).select("condition_id", F.col("initial").alias("outcome"))
    sells = f.where("side = 'SELL'").select("condition_id", "outcome", "timestamp_ms")
    hit = opposite.select("condition_id", "t0_ms").join(start, "condition_id").join(sells, ["condition_id", "outcome"]).where((F.col("timestamp_ms") > F.col("t0_ms")) & (F.col("timestamp_ms") <= F.col("t0_ms") + HORIZON)).select("condition_id").distinct().withColumn("sold", F.lit(True))
    out = label.join(hit, "condition_id", "left").withColumn("sold", F.coalesce("sold", F.lit(False)))
    return out.agg(F.count("*").alias("markets"), F.sum("label").alias("plain"), F.count_if((F.col("label") == 1) | F.col("sold")).alias("wide"), F.count_if((F.col("label") == 0) & F.col("sold")).alias("upgraded"))


@register("f15_phase_counts", f"{with_sql('ev', 'sessions')} SELECT event, count(*) FILTER (timestamp_ms % 86400000 < {6 * HOUR}) AS inside, count(*) FILTER (timestamp_ms % 86400000 >= {6 * HOUR}) AS after FROM sessions GROUP BY 1")
def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in the first six hours of a day and after."""
    return more.phase_counts(X.sessions(spark, sf_dir), 24 * HOUR, 6 * HOUR, "timestamp_ms", "event")


@register("f16_session_bounds", f"{with_sql('ev', 'sessions')} SELECT session_id, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, max(timestamp_ms) - min(timestamp_ms) AS length_ms, bool_or(event = 'disconnected') AS ended FROM sessions GROUP BY 1")
def session_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: bounds and lengths of sessions."""
    return more.session_bounds(X.sessions(spark, sf_dir))


@register("f18_checkpoints", f"{EPISODES}, c AS (SELECT count(*) AS n FROM opp) SELECT n, concat_ws(',', CASE WHEN n >= 100 THEN '100' END, CASE WHEN n >= 500 THEN '500' END, CASE WHEN n >= 1000 THEN '1000' END, CASE WHEN n >= 5000 THEN '5000' END) AS due, CASE WHEN n < 100 THEN 100 WHEN n < 500 THEN 500 WHEN n < 1000 THEN 1000 WHEN n < 5000 THEN 5000 END AS next FROM c")
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """milestones of labelled markets."""
    return more.due_checkpoints(_opposites(spark, sf_dir)[1].agg(F.count("*").alias("n")), [100, 500, 1000, 5000])


@register("g01_log_returns", f"""{with_sql("ev", "ticks")}, c AS (SELECT event_id, user_id::VARCHAR AS condition_id, ms - 1 AS cut FROM ev WHERE event_type = 'purchase')
SELECT event_id, round(ln(a.price / b.price), 6) AS r1, round(ln(a.price / d.price), 6) AS r2 FROM c
LEFT JOIN LATERAL (SELECT price FROM ticks t WHERE t.condition_id = c.condition_id AND exchange_ms <= cut ORDER BY exchange_ms DESC, trade_id DESC LIMIT 1) a ON true
LEFT JOIN LATERAL (SELECT price FROM ticks t WHERE t.condition_id = c.condition_id AND exchange_ms <= cut - {6 * HOUR} ORDER BY exchange_ms DESC, trade_id DESC LIMIT 1) b ON true
LEFT JOIN LATERAL (SELECT price FROM ticks t WHERE t.condition_id = c.condition_id AND exchange_ms <= cut - {24 * HOUR} ORDER BY exchange_ms DESC, trade_id DESC LIMIT 1) d ON true""")  # fmt: skip
def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log returns before purchases."""
    ticks = X.ticks(spark, sf_dir).select("condition_id", F.col("exchange_ms").alias("ms"), "price", F.col("trade_id").alias("seq"))
    out = more.log_returns(_cuts(spark, sf_dir), ticks, "condition_id", "event_id", "cut_ms", [6 * HOUR, 24 * HOUR])
    return out.select("event_id", F.round(f"r_{6 * HOUR}", 6).alias("r1"), F.round(f"r_{24 * HOUR}", 6).alias("r2"))


@register("g08_validity_mode", f"{with_sql('ev', 'book')}, v AS (SELECT condition_id, seq, CASE WHEN condition_id::INT % 2 = 0 THEN book_state_valid END AS flag FROM book) SELECT condition_id, count(*) AS n FROM v WHERE condition_id::INT % 2 = 1 OR flag GROUP BY 1")
def validity_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept where only some instruments carry a validity flag."""
    rows = X.book(spark, sf_dir).withColumn("flag", F.when(F.col("condition_id").cast("int") % 2 == 0, F.col("book_state_valid")))
    return more.validity_mode(rows, "condition_id", "flag").groupBy("condition_id").agg(F.count("*").alias("n"))


@register("h22_backdating", f"{with_sql('ev', 'ticks')} SELECT CASE WHEN receive_ms < exchange_ms THEN 'AVAILABLE_BEFORE_RECEIVE' WHEN exchange_ms + 50 < receive_ms THEN 'USED_BEFORE_AVAILABLE' ELSE 'OK' END AS reason, count(*) AS n FROM ticks GROUP BY 1")
def backdating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks used before they were available."""
    return more.backdating(X.ticks(spark, sf_dir).withColumn("used", F.col("exchange_ms") + 50), "exchange_ms", "receive_ms", "used")


@register("h25_half_medians", f"{with_sql('ev', 'ticks')}, r AS (SELECT condition_id, price, row_number() OVER (PARTITION BY condition_id ORDER BY trade_id) AS i, count(*) OVER (PARTITION BY condition_id) AS n FROM ticks) SELECT condition_id, round(quantile_cont(price, 0.5) FILTER (i <= n // 2), 6) AS first_half, round(quantile_cont(price, 0.5) FILTER (i > n // 2), 6) AS second_half FROM r WHERE n >= 4 GROUP BY 1")
def half_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of both halves of a feed."""
    return more.half_medians(X.ticks(spark, sf_dir), "condition_id", "trade_id", "price").withColumns(r6("first_half", "second_half"))


@register("h14_market_summary", f"""{_MOVES}, p AS (SELECT condition_id, lag, round(corr, 6) AS corr, row_number() OVER (PARTITION BY condition_id ORDER BY abs(round(corr, 6)) DESC, abs(lag), lag) AS rn FROM c WHERE corr IS NOT NULL),
s AS (SELECT count(*) AS n, round(avg(lag), 6) AS mean_lag, round(quantile_cont(lag, 0.5), 6) AS median_lag, round(avg(abs(corr)), 6) AS mean_abs, count(*) FILTER (lag > 0) AS lead, count(*) FILTER (lag < 0) AS follow, count(*) FILTER (lag = 0) AS sync FROM p WHERE rn = 1)
SELECT *, CASE WHEN lead = greatest(lead, follow, sync) THEN 'LEAD' WHEN follow = greatest(lead, follow, sync) THEN 'FOLLOW' ELSE 'SYNC' END AS dominant FROM s""")  # fmt: skip
def market_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-market summary of lead-lag peaks."""
    peaks = grid.peak(cross_correlation(spark, sf_dir), "condition_id", "lag", "corr")
    return more.market_summary(peaks, "lag", "corr").withColumns(r6("mean_lag", "median_lag", "mean_abs"))


@register("h16_bucket_stability", f"""{_FEATURES}, p AS (SELECT shock, condition_id, count(*) AS n, avg(bp_4) AS m FROM fs WHERE bp_4 IS NOT NULL AND shock IS NOT NULL GROUP BY ALL)
SELECT shock, sum(n)::BIGINT AS n, count(*) AS keys, round(avg(m), 4) AS mean, count(*) FILTER (m > 0) AS positive, count(*) FILTER (m < 0) AS negative, round(greatest(count(*) FILTER (m > 0), count(*) FILTER (m < 0)) / count(*), 6) AS consistency FROM p GROUP BY 1""")  # fmt: skip
def bucket_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability of later changes per shock bucket."""
    f = grid.grid_features(_grid(spark, sf_dir), "condition_id", [1, 4], 4).where("shock is not null")
    return more.bucket_stability(f, "shock", "condition_id", "bp_4").withColumns({"mean": F.round("mean", 4), "consistency": F.round("consistency", 6)})


@register("i04_dataset_comparison", """WITH b AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)), a AS (SELECT count(*) AS n_a, avg((o_orderstatus = 'F')::INT) AS rate_a, quantile_cont(o_totalprice, 0.5) AS median_a FROM orders), x AS (SELECT count(*) AS n_b, avg((o_orderstatus = 'F')::INT) AS rate_b, quantile_cont(o_totalprice, 0.5) AS median_b FROM b)
SELECT n_a, round(rate_a, 6) AS rate_a, round(median_a, 4) AS median_a, n_b, round(rate_b, 6) AS rate_b, round(median_b, 4) AS median_b, round(abs(rate_a - rate_b) * 100, 6) AS delta_pp FROM a, x""")  # fmt: skip
def dataset_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders against those of customers in credit."""
    o = X.table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice")
    poor = X.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return more.dataset_comparison(o, poor, "o_custkey", "y", "o_totalprice").withColumns(r6("rate_a", "rate_b", "delta_pp") | {c: F.round(c, 4) for c in ("median_a", "median_b")})


@register("i14_baselines", f"{_MONTHS} SELECT period, round(rate, 6) AS rate, round(lag(rate) OVER w, 6) AS last, round(avg(rate) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS mean, round(avg(rate) OVER (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS rolling FROM m WINDOW w AS (ORDER BY period)")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts from earlier months."""
    return more.baselines(_months(spark, sf_dir), "period", "rate", 3).withColumns(r6("rate", "last", "mean", "rolling"))


@register("i14_ewma", f"{_MONTHS.replace('WITH', 'WITH RECURSIVE', 1)}, o AS (SELECT *, row_number() OVER (ORDER BY period) AS i FROM m), f AS (SELECT i, period, NULL::DOUBLE AS forecast, rate AS s FROM o WHERE i = 1 UNION ALL SELECT o.i, o.period, f.s, f.s + 0.1 * (o.rate - f.s) FROM f JOIN o ON o.i = f.i + 1) SELECT 'all' AS metric, period, round(forecast, 6) AS forecast FROM f")
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted forecasts."""
    return more.ewma(_months(spark, sf_dir).withColumn("metric", F.lit("all")), "metric", "period", "rate", 0.1).withColumns(r6("forecast"))


@register("i19_reconciliation", f"""{EPISODES}, {MARKETS}, p AS (SELECT condition_id, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'BUY' AND (size <= 0 OR price NOT BETWEEN 0 AND 1)) AS bad FROM fills GROUP BY 1),
j AS (SELECT p.*, coalesce(i.ambiguous, false) OR buys = 0 OR bad > 0 AS ex FROM p LEFT JOIN init i USING (condition_id)) SELECT count(*) AS rows, count(DISTINCT condition_id) AS keys, count(*) FILTER (NOT ex) AS clean, count(*) FILTER (ex) AS excluded, (SELECT count(DISTINCT condition_id) FROM fills) AS raw, true AS adds_up FROM j""")  # fmt: skip
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger against the raw markets."""
    f = X.fills(spark, sf_dir)
    led = ledger.event_ledger(f, f.select("condition_id", "market_start_ms", "market_end_ms").distinct(), GAP, HORIZON, 0)
    return more.reconciliation(led, f, "condition_id")


@register("i20_status_rollup", f"{_MONTHS}, s AS (SELECT left(period, 4) AS year, CASE WHEN n < 5 THEN 'FAIL' WHEN rate < 0.2 THEN 'WARN' ELSE 'PASS' END AS status FROM m) SELECT year, count(*) AS n, CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status FROM s GROUP BY 1")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst status per year."""
    s = _months(spark, sf_dir).select(F.substring("period", 1, 4).alias("year"), F.when(F.col("n") < 5, "FAIL").when(F.col("rate") < 0.2, "WARN").otherwise("PASS").alias("status"))
    return more.status_rollup(s, "year", "status")


@register("k10_fill_cancel_order", f"{EV}, c AS (SELECT user_id, min(ms) AS cms FROM ev WHERE event_type = 'error' GROUP BY 1) SELECT CASE WHEN ms = cms THEN 'AMBIGUOUS' WHEN ms < cms THEN 'BEFORE' ELSE 'AFTER' END AS position, count(*) AS n FROM ev JOIN c USING (user_id) WHERE event_type IN ('purchase', 'error') GROUP BY 1")
def fill_cancel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and errors against each user's first error."""
    e = X.events(spark, sf_dir)
    cancels = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("ms").alias("ms"))
    return more.fill_cancel_order(e.where("event_type in ('purchase', 'error')"), cancels, "user_id", "ms").groupBy("position").agg(F.count("*").alias("n"))


@register("k11_chain_verification", "SELECT user_id AS journal, count(*) AS records, 0::BIGINT AS gaps, 0::BIGINT AS broken, (min(event_id) % 9 = 0)::BIGINT AS forged FROM events GROUP BY 1")
def chain_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash chain per user; where the first event's id is divisible by 9 the first payload is changed afterwards."""
    e = X.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("journal")).agg(F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("_e"))
    kind = "array<struct<previous:string,payload:string,own:string>>"

    def link(a, x):
        own = F.sha2(F.concat_ws("|", F.coalesce(a["own"], F.lit("")), x["props"]), 256)
        return F.struct(own.alias("own"), F.array_append(a["out"], F.struct(a["own"].alias("previous"), x["props"].alias("payload"), own.alias("own"))).alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("own"), F.array().cast(kind).alias("out"))
    records = e.select("journal", F.element_at("_e", 1)["event_id"].alias("low"), F.posexplode(F.aggregate("_e", start, link)["out"]).alias("seq", "r")).select("journal", "low", "seq", "r.*")
    changed = (F.col("seq") == 0) & (F.col("low") % 9 == 0)
    records = records.withColumn("payload", F.when(changed, F.lit("changed")).otherwise(F.col("payload")))
    return logs.chain_verification(records, "journal", "seq", "payload", "previous", "own")


@register("k14_error_counts", f"""{with_sql("ev", "sessions")}, s AS (SELECT *, CASE WHEN event IN ('connected', 'disconnected') THEN event END AS mv FROM sessions),
l AS (SELECT *, last_value(mv IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM s)
SELECT CASE WHEN st = 'connected' THEN 'READ' ELSE 'CONNECT' END AS stage, CASE WHEN k % 3 = 0 THEN 'TIMEOUT' ELSE 'OTHER' END AS class, count(*) AS n FROM l WHERE event = 'connection_error' GROUP BY ALL""")  # fmt: skip
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by stage and class."""
    text = F.when(F.col("k") % 3 == 0, "Read TimeOut").otherwise("refused")
    return more.error_counts(X.sessions(spark, sf_dir), S.error_class(text, [("timeout", "TIMEOUT")]))


@register("t07_restart_storms", f"{EV}, r AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW) AS recent FROM ev) SELECT user_id, event_id, recent FROM r WHERE recent >= 5")
def restart_storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T07, batch twin: users with five events in a day."""
    return more.restart_storms(X.events(spark, sf_dir), "user_id", "ms", 24 * HOUR, 5).select("user_id", "event_id", "recent")


@register("t04_sequence_audit", f"{with_sql('ev', 'ticks')}, d AS (SELECT condition_id, trade_id - lag(trade_id) OVER (PARTITION BY condition_id ORDER BY receive_ms, trade_id) AS d FROM ticks) SELECT condition_id, count(*) AS rows, count(*) FILTER (d > 1) AS gaps, count(*) FILTER (d < 0) AS back FROM d GROUP BY 1")
def sequence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T04, batch twin: gaps and steps back of trade ids in arrival order."""
    return more.sequence_audit(X.ticks(spark, sf_dir), "condition_id", ["receive_ms", "trade_id"], "trade_id")


@register("t01_rebuilt_book", f"""{EV}, c AS (SELECT user_id, CASE WHEN event_type = 'view' THEN 'bid' ELSE 'ask' END AS side, CASE WHEN event_type = 'view' THEN k % 10 ELSE 10 + k % 10 END AS price, CASE WHEN k % 4 = 0 THEN 0 ELSE value END AS size, event_id FROM ev WHERE event_type IN ('view', 'click')),
l AS (SELECT user_id, side, price, arg_max(size, event_id) AS size FROM c GROUP BY ALL) SELECT user_id, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask, count(*) AS levels, (max(price) FILTER (side = 'bid') + min(price) FILTER (side = 'ask')) / 2 AS mid FROM l WHERE size > 0 GROUP BY 1""")  # fmt: skip
def rebuilt_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T01, batch twin: best prices from level changes."""
    e = X.events(spark, sf_dir).where("event_type in ('view', 'click')")
    bid = F.col("event_type") == "view"
    c = e.select("user_id", F.when(bid, "bid").otherwise("ask").alias("side"), F.when(bid, F.col("k") % 10).otherwise(10 + F.col("k") % 10).alias("price"), F.when(F.col("k") % 4 == 0, 0.0).otherwise(F.col("value")).alias("size"), "event_id")
    return more.rebuilt_book(c, "user_id", ["event_id"])


@register("c15_universes", f"{FILLS}, u AS (SELECT 'all' AS universe, 'w7d-' AS p UNION ALL SELECT 'early', 'w7d-170') SELECT universe, count(*) AS n FROM fills JOIN u ON starts_with(slug, p) GROUP BY 1")
def universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills per universe of slugs."""
    return more.universes(X.fills(spark, sf_dir), [("all", "w7d-"), ("early", "w7d-170")], "slug").groupBy("universe").agg(F.count("*").alias("n"))


@register("p25_pseudonymised", "SELECT sha256('salt' || o_custkey::VARCHAR) AS o_custkey, 0::BIGINT AS cut, -o_orderkey % 100 AS seen FROM orders")
def pseudonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: orders with hashed customers and shifted times."""
    o = X.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("cut"), (F.col("o_orderkey") - F.col("o_orderkey") % 100).alias("seen"), "o_orderpriority")
    return more.pseudonymised(o, "o_custkey", ["seen"], "cut", "salt", ["o_orderpriority"])


@register("p17_lag_classes", f"{with_sql('ev', 'ticks')} SELECT CASE WHEN abs(receive_ms - exchange_ms - 50) <= 20 THEN 'SYNCHRONOUS' WHEN receive_ms - exchange_ms > 50 THEN 'BTC_LEAD' ELSE 'PM_LEAD' END AS class, count(*) AS n FROM ticks GROUP BY 1")
def lag_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of centred delays."""
    t = X.ticks(spark, sf_dir).select(S.lag_class(F.col("receive_ms") - F.col("exchange_ms") - 50, 20).alias("class"))
    return t.groupBy("class").agg(F.count("*").alias("n"))


@register("i21_table_digest", "SELECT count(*) AS n FROM lineitem")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an order-free digest (hashes have no SQL twin)."""
    return stats.table_digest(X.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"]).select("n")
