"""Registered queries of feature rows, their provenance and audits, each with an independent SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import coverage, ledger
from tallyspark.operators import feature_rows as R
from tallyspark.operators.features import volume_flow
from tallyspark.operators.temporal_joins import asof_backward
from tallyspark.plans.queries import CUTS, DAYS, EPISODES, GAP, HORIZON, MARKETS, _cuts, _weeks, label_sql, r6, register
from tallyspark.plans.raw_queries import CLOSED, _sidecars
from tallyspark.operators import raw
from tallyspark.sources import files
from tallyspark.sources import fixtures as X
from tallyspark.sources.fixtures import HOUR, with_sql

DAY = 24 * HOUR


@register("g04_bounded_history", f"""{with_sql("ev", "ticks")}, {CUTS},
h AS (SELECT event_id, price, exchange_ms, trade_id, cut_ms FROM cuts JOIN ticks USING (condition_id) WHERE exchange_ms <= cut_ms),
p AS (SELECT event_id, arg_max(price, (exchange_ms, trade_id)) AS price, max(exchange_ms) AS t FROM h WHERE exchange_ms <= cut_ms - {48 * HOUR} GROUP BY 1),
w AS (SELECT event_id, arg_min(price, (exchange_ms, trade_id)) AS first_price, arg_max(price, (exchange_ms, trade_id)) AS last_price, count(*) AS n FROM h WHERE exchange_ms > cut_ms - {48 * HOUR} GROUP BY 1)
SELECT coalesce(w.event_id, p.event_id) AS event_id, round(ln(coalesce(last_price, p.price) / coalesce(p.price, first_price)), 6) AS log_return, coalesce(n, 0) + (p.event_id IS NOT NULL)::INT AS ticks FROM w FULL JOIN p USING (event_id)""")  # fmt: skip
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns over two days before each purchase from a bounded history and one predecessor."""
    h = R.bounded_history(_cuts(spark, sf_dir), X.ticks(spark, sf_dir), "condition_id", "event_id", "cut_ms", "exchange_ms", "trade_id", ["price"], 48 * HOUR)
    return R.window_return(h, "event_id", "exchange_ms", "trade_id", "price").withColumns(r6("log_return"))


def _lopsided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book rows whose ask sizes are 1 to 3 times those of the bids."""
    return X.book(spark, sf_dir).withColumn("asks", F.transform("asks", lambda a: F.struct(a["price"].alias("price"), (a["size"] * (1 + F.col("seq") % 3)).alias("size"))))


_FRAMES = f"""{with_sql("ev", "book")}, {CUTS}, o AS (SELECT unnest(['Up', 'Down']) AS outcome),
l AS (SELECT event_id, o.outcome, arg_max(struct_pack(m := mid, v := value, k := k, s := seq, t := receive_ms), (receive_ms, seq)) AS b, any_value(cut_ms) AS cut_ms FROM cuts, o, book WHERE book.condition_id = cuts.condition_id AND book.outcome = o.outcome AND book_state_valid AND receive_ms <= cut_ms GROUP BY 1, 2)"""


@register("g05_book_frames", f"""{_FRAMES} SELECT event_id, outcome, round(b.m, 6) AS mid, 0.02::DOUBLE AS spread, round(b.v, 6) AS bid_depth_1, round(3 * b.v + b.k % 7 + (2 * b.k) % 7, 6) AS bid_depth_3,
 round(b.v * (1 - (1 + b.s % 3)) / nullif(b.v * (2 + b.s % 3), 0), 6) AS obi_1, round(CASE WHEN 3 * b.v + b.k % 7 + (2 * b.k) % 7 > 0 THEN -(b.s % 3) / (2 + b.s % 3) END, 6) AS obi_3, cut_ms - b.t AS age_ms FROM l""")  # fmt: skip
def book_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last valid book of either outcome before each purchase."""
    f = R.frame_features(_cuts(spark, sf_dir), _lopsided(spark, sf_dir), "condition_id", "event_id", "cut_ms", [1, 3]).where("age_ms is not null")
    return f.select("event_id", "outcome", "mid", "spread", F.col("bid_depth_1"), "bid_depth_3", "obi_1", "obi_3", "age_ms").withColumns(r6("mid", "spread", "bid_depth_1", "bid_depth_3", "obi_1", "obi_3"))


@register("p13_depth_imbalance", f"{with_sql('ev', 'book')} SELECT seq, round(3 * value + k % 7 + (2 * k) % 7, 6) AS bid_depth, round(CASE WHEN 3 * value + k % 7 + (2 * k) % 7 > 0 THEN -(seq % 3) / (2 + seq % 3) END, 6) AS obi FROM book")
def depth_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of three levels and its imbalance, on lopsided books."""
    bid, ask = S.depth(F.col("bids"), 3), S.depth(F.col("asks"), 3)
    return _lopsided(spark, sf_dir).select("seq", F.round(bid, 6).alias("bid_depth"), F.round(S.imbalance(bid, ask), 6).alias("obi"))


_LAGS = [3 * HOUR, 12 * HOUR, 48 * HOUR]


@register("g06_book_changes", f"""{with_sql("ev", "book")}, {CUTS}, g AS (SELECT unnest([0, {", ".join(map(str, _LAGS))}])::BIGINT AS lag_ms),
m AS (SELECT event_id, lag_ms, arg_max(mid, (receive_ms, seq)) FILTER (receive_ms <= cut_ms - lag_ms AND book_state_valid) AS mid FROM cuts CROSS JOIN g LEFT JOIN book USING (condition_id) GROUP BY 1, 2)
SELECT a.event_id, a.lag_ms, round(b.mid - a.mid, 6) AS change FROM m a JOIN m b ON b.event_id = a.event_id AND b.lag_ms = 0 WHERE a.lag_ms > 0""")  # fmt: skip
def book_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the mid over some lags before each purchase."""
    return R.mid_changes(_cuts(spark, sf_dir), X.book(spark, sf_dir), "condition_id", "event_id", "cut_ms", _LAGS).withColumns(r6("change"))


_ROWS = f"""{EPISODES.replace("WITH ev", "WITH ev", 1)}, {X.SQL["ticks"]}, {X.SQL["book"]}, {label_sql(0, HORIZON)}, {MARKETS},
base AS (SELECT l.condition_id, split_part(l.condition_id, '-', 1) AS feed, l.t0_ms AS prediction_ts_ms, l.t0_ms - 1 AS feature_cutoff_ms, l.label, i.ambiguous, m.market_end_ms >= l.t0_ms + {HORIZON} AS horizon_eligible FROM lab l JOIN init i USING (condition_id) JOIN markets m USING (condition_id)),
flow AS (SELECT b.condition_id, count(*) AS n, sum(t.size) AS volume, sum(CASE WHEN t.buyer_is_maker THEN -t.size ELSE t.size END) AS flow FROM base b JOIN ticks t ON t.condition_id = b.feed AND t.exchange_ms <= feature_cutoff_ms AND t.exchange_ms > feature_cutoff_ms - {DAY} GROUP BY 1),
price AS (SELECT b.condition_id, arg_max(t.price, (t.exchange_ms, t.trade_id)) AS price, max(t.exchange_ms) AS tick_ms FROM base b JOIN ticks t ON t.condition_id = b.feed AND t.exchange_ms <= feature_cutoff_ms GROUP BY 1),
quote AS (SELECT b.condition_id, arg_max(k.mid, (k.receive_ms, k.seq)) AS mid, max(k.receive_ms) AS book_ms FROM base b JOIN book k ON k.condition_id = b.feed AND k.book_state_valid AND k.receive_ms <= feature_cutoff_ms GROUP BY 1),
rows AS (SELECT sha256(condition_id || '|' || prediction_ts_ms || '|cutoff_1') AS feature_row_id, condition_id, prediction_ts_ms, feature_cutoff_ms, 'cutoff_1' AS cutoff_mode, label, round(volume, 6) AS tick_volume, round(flow, 6) AS tick_flow, round(price, 6) AS last_price, round(mid, 6) AS last_mid, tick_ms, book_ms,
 concat_ws(';', CASE WHEN ambiguous THEN 'not_clean' END, CASE WHEN NOT horizon_eligible THEN 'censored' END, CASE WHEN volume IS NULL THEN 'tick_volume_missing' END, CASE WHEN mid IS NULL THEN 'last_mid_missing' END) AS model_ineligible_reason
 FROM base LEFT JOIN flow USING (condition_id) LEFT JOIN price USING (condition_id) LEFT JOIN quote USING (condition_id))"""


def _feature_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Feature rows, and the same with the times of their sources."""
    f = X.fills(spark, sf_dir)
    start = ledger.initial_direction(f)
    label = ledger.forward_label(f, ledger.first_opposite(ledger.episodes(f, GAP), start), HORIZON)
    markets = f.select("condition_id", "market_end_ms").distinct()
    base = label.join(start.select("condition_id", "ambiguous"), "condition_id").join(markets, "condition_id")
    base = base.select(
        "condition_id", F.split("condition_id", "-")[0].alias("feed"), F.col("t0_ms").alias("prediction_ts_ms"), (F.col("t0_ms") - 1).alias("feature_cutoff_ms"), "label",
        (~F.col("ambiguous")).alias("clean"), (F.col("market_end_ms") >= F.col("t0_ms") + HORIZON).alias("horizon_eligible"),
    )
    ticks = X.ticks(spark, sf_dir).withColumnRenamed("condition_id", "feed")
    flow = volume_flow(base, ticks, "feed", "condition_id", "feature_cutoff_ms", "exchange_ms", [DAY]).select("condition_id", "volume", "flow")
    cut = base.withColumn("at", F.col("feature_cutoff_ms"))
    cut = asof_backward(cut, ticks.select("feed", F.col("exchange_ms").alias("at"), "price", F.col("exchange_ms").alias("tick_ms"), "trade_id"), "feed", "at", ["price", "tick_ms"], ["trade_id"]).drop("age_ms")
    book = X.book(spark, sf_dir).where("book_state_valid").select(F.col("condition_id").alias("feed"), F.col("receive_ms").alias("at"), F.col("receive_ms").alias("book_ms"), "mid", "seq")
    cut = asof_backward(cut, book, "feed", "at", ["mid", "book_ms"], ["seq"]).drop("age_ms").join(flow, "condition_id", "left")
    cut = files.written(cut, "cut")  # read for the rows and again for their source times
    features = {"tick_volume": F.round("volume", 6), "tick_flow": F.round("flow", 6), "last_price": F.round("price", 6), "last_mid": F.round("mid", 6)}
    rows = R.assemble(cut, features, ["tick_volume", "last_mid"], "cutoff_1")
    return rows, rows.join(cut.select("condition_id", "tick_ms", "book_ms"), "condition_id")


@register("g10_feature_rows", f"{_ROWS} SELECT feature_row_id, condition_id, prediction_ts_ms, feature_cutoff_ms, cutoff_mode, label, tick_volume, tick_flow, last_price, last_mid, model_ineligible_reason = '' AS model_eligible, model_ineligible_reason FROM rows")
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of markets with a first opposite episode: flow and price of ticks, mid of books before t0."""
    return _feature_rows(spark, sf_dir)[0]


_PROVENANCE = f"""{_ROWS}, long AS (SELECT condition_id, prediction_ts_ms, feature_cutoff_ms, unnest([
 struct_pack(feature_name := 'tick_flow', source_type := 'ticks', t := tick_ms, v := tick_flow), struct_pack(feature_name := 'last_price', source_type := 'ticks', t := tick_ms, v := last_price), struct_pack(feature_name := 'last_mid', source_type := 'book', t := book_ms, v := last_mid)]) AS p FROM rows),
prov AS (SELECT condition_id, prediction_ts_ms, feature_cutoff_ms, p.feature_name, p.source_type, p.t AS source_timestamp_min_ms, p.t AS source_timestamp_max_ms, CASE WHEN p.v IS NULL THEN CASE WHEN p.t IS NULL THEN 'NO_SOURCE' ELSE 'NOT_DEFINED' END END AS missing_reason, 'v1' AS transform_version FROM long)"""


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feature_rows(spark, sf_dir)[1]
    return R.feature_provenance(rows, {"tick_flow": ("ticks", "tick_ms", "tick_ms"), "last_price": ("ticks", "tick_ms", "tick_ms"), "last_mid": ("book", "book_ms", "book_ms")}, "v1")


@register("g11_feature_provenance", f"{_PROVENANCE} SELECT * FROM prov")
def feature_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each feature of each feature row, with its source times."""
    return _provenance(spark, sf_dir)


@register("g18_lineage_audit", f"""{_PROVENANCE}, per AS (SELECT condition_id, bool_or(missing_reason = 'NO_SOURCE') AS no_source, min(prediction_ts_ms) AS p, bool_or(source_type = 'book' AND source_timestamp_max_ms > feature_cutoff_ms - {6 * HOUR}) AS late FROM prov GROUP BY 1)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN late THEN 'POINT_IN_TIME' WHEN p % 7 = 0 THEN 'TRUTH_TIMESTAMP' WHEN no_source THEN 'MISSING_SOURCE' ELSE 'PASS' END AS status FROM per) GROUP BY 1""")  # fmt: skip
def lineage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of the feature rows; books count as late within six hours, and every seventh truth time is off by one."""
    p = files.written(_provenance(spark, sf_dir), "provenance")  # read twice
    late = p.withColumn("source_timestamp_max_ms", F.when(F.col("source_type") == "book", F.col("source_timestamp_max_ms") + 6 * HOUR).otherwise(F.col("source_timestamp_max_ms")))
    truth = p.select("condition_id", (F.col("prediction_ts_ms") + (F.col("prediction_ts_ms") % 7 == 0).cast("long")).alias("t0_ms")).distinct()
    known = spark.createDataFrame([("ticks",), ("book",)], "source_type string")
    return R.lineage_audit(late, truth, known).groupBy("status").agg(F.count("*").alias("n"))


@register("g20_source_context", f"""{with_sql("ev")}, {CLOSED}, n AS (SELECT user_id, user_id || '/' || ms // {DAY} AS file FROM ev WHERE event_type = 'purchase' GROUP BY ALL)
SELECT n.user_id, string_agg(DISTINCT session_id, ',') AS sessions, count(*) FILTER (session_id IS NULL) AS unknown FROM n LEFT JOIN closed USING (file) GROUP BY 1""")  # fmt: skip
def source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the files that each user's purchases come from, and files that are not in the catalogue."""
    e = X.events(spark, sf_dir).where("event_type = 'purchase'")
    listed = e.groupBy("user_id").agg(F.array_join(F.collect_set(F.concat_ws("/", "user_id", F.floor(F.col("ms") / DAY))), ";").alias("source_file"))
    out = R.source_context(listed, raw.closed_files(_sidecars(spark, sf_dir)).withColumn("version", F.lit("v1")), "user_id")
    return out.select("user_id", F.nullif(F.array_join("sessions", ","), F.lit("")).alias("sessions"), "unknown")


@register("g21_evidence_flags", f"""{_ROWS} SELECT condition_id, tick_volume IS NOT NULL AND tick_volume >= 100 AS coverage, coalesce(book_ms <= feature_cutoff_ms, false) AS provenance, coalesce(last_mid BETWEEN 0.05 AND 0.95, false) AS sanity,
 concat_ws(',', CASE WHEN coalesce(tick_volume, 0) < 100 THEN 'coverage' END, CASE WHEN book_ms IS NULL THEN 'provenance' END, CASE WHEN NOT coalesce(last_mid BETWEEN 0.05 AND 0.95, false) THEN 'sanity' END) AS failures FROM rows""")  # fmt: skip
def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, provenance and sanity of each feature row, and the failures."""
    rows = _feature_rows(spark, sf_dir)[1]
    out = R.evidence_flags(rows, {"coverage": F.col("tick_volume") >= 100, "provenance": F.col("book_ms") <= F.col("feature_cutoff_ms"), "sanity": F.col("last_mid").between(0.05, 0.95)})
    return out.select("condition_id", "coverage", "provenance", "sanity", F.array_join("failures", ",").alias("failures"))


@register("m01_predictive_rows", f"""{_ROWS}, c AS (SELECT count(*) FILTER (label IS NULL) AS dropped_label, count(*) FILTER (label IS NOT NULL AND (tick_flow IS NULL OR last_mid IS NULL OR last_price IS NULL)) AS dropped_features FROM rows)
SELECT prediction_ts_ms, strftime(make_timestamp(prediction_ts_ms * 1000), '%G-W%V') AS iso_week, tick_flow, last_price, last_mid, label, c.* FROM rows, c WHERE label IS NOT NULL AND tick_flow IS NOT NULL AND last_mid IS NOT NULL AND last_price IS NOT NULL""")  # fmt: skip
def predictive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for models, and how many were dropped."""
    return R.predictive_rows(_feature_rows(spark, sf_dir)[0], ["tick_flow", "last_price", "last_mid"], "label", "prediction_ts_ms")


_TOKENS = f"""{with_sql("ev", "ticks", "book")}, {DAYS}, o AS (SELECT unnest(['Up', 'Down']) AS outcome),
tok AS (SELECT d.condition_id, d.start_ms, b.outcome, count(DISTINCT least((receive_ms - start_ms) // {6 * HOUR}, 27)) / 28 AS coverage FROM days d JOIN book b ON b.condition_id = d.condition_id AND receive_ms BETWEEN start_ms AND end_ms GROUP BY ALL)"""


@register("f05_market_coverage", f"""{_TOKENS}, w AS (SELECT condition_id, start_ms, min(coverage) AS c, count(*) AS n FROM tok GROUP BY ALL),
t AS (SELECT d.condition_id, d.start_ms, count(DISTINCT least((exchange_ms - start_ms) // {6 * HOUR}, 27)) / 28 AS tick FROM days d LEFT JOIN ticks t ON t.condition_id = d.condition_id AND exchange_ms BETWEEN start_ms AND end_ms GROUP BY ALL)
SELECT t.condition_id, t.start_ms, round(CASE WHEN coalesce(n, 0) < 2 THEN 0 ELSE c END, 6) AS book_coverage, round(tick, 6) AS tick, coalesce(n, 0) > 0 AS book_expected FROM t LEFT JOIN w USING (condition_id, start_ms)""")  # fmt: skip
def market_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weekly coverage of the weaker token's book and of the ticks."""
    weeks = _weeks(spark, sf_dir)
    book = X.book(spark, sf_dir).withColumn("token", F.concat_ws("|", "condition_id", "outcome"))
    windows = weeks.withColumn("outcome", F.explode(F.array(F.lit("Up"), F.lit("Down")))).withColumn("token", F.concat_ws("|", "condition_id", "outcome"))
    per = coverage.bucket_coverage(windows, book, "token", "receive_ms", 6 * HOUR).where("filled > 0").select(F.split("token", r"\|")[0].alias("condition_id"), "start_ms", "coverage")
    ticks = coverage.bucket_coverage(weeks, X.ticks(spark, sf_dir), "condition_id", "exchange_ms", 6 * HOUR)
    return R.market_coverage(weeks, per, ticks, "condition_id").withColumns(r6("book_coverage", "tick"))


@register("f06_coverage_report", f"""{with_sql("ev", "ticks")}, {DAYS}, c AS (SELECT d.condition_id, d.start_ms, count(DISTINCT least((exchange_ms - start_ms) // {6 * HOUR}, 27)) AS filled FROM days d LEFT JOIN ticks t ON t.condition_id = d.condition_id AND exchange_ms BETWEEN start_ms AND end_ms GROUP BY ALL),
p AS (SELECT condition_id, start_ms, exchange_ms AS t FROM ticks JOIN days USING (condition_id) WHERE exchange_ms BETWEEN start_ms AND end_ms UNION ALL SELECT condition_id, start_ms, start_ms FROM days UNION ALL SELECT condition_id, start_ms, end_ms FROM days),
l AS (SELECT condition_id, start_ms, t AS a, lead(t) OVER (PARTITION BY condition_id, start_ms ORDER BY t) AS z FROM p),
g AS (SELECT condition_id, start_ms, count(*) AS gaps, max(z - a) AS m, string_agg(a || '-' || z, ';' ORDER BY a, z) AS gap_list FROM l WHERE z - a > {DAY} GROUP BY ALL)
SELECT c.condition_id, c.start_ms, filled, coalesce(gaps, 0) AS gaps, coalesce(m, 0) AS max_gap_ms, gap_list FROM c LEFT JOIN g USING (condition_id, start_ms)""")  # fmt: skip
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weekly coverage of each feed with its gaps above a day."""
    weeks, ticks = _weeks(spark, sf_dir), X.ticks(spark, sf_dir)
    c = coverage.bucket_coverage(weeks, ticks, "condition_id", "exchange_ms", 6 * HOUR).select("condition_id", "start_ms", "filled")
    out = R.coverage_report(c, coverage.gaps(weeks, ticks, "condition_id", "exchange_ms", DAY), ["condition_id", "start_ms"])
    return out.withColumn("gap_list", F.array_join(F.transform("gap_list", lambda g: F.concat_ws("-", g["from_ms"], g["to_ms"])), ";"))


@register("e08_prospective_build", f"""{EPISODES}, {label_sql(0, HORIZON)}, {MARKETS}, c AS (SELECT condition_id, count(*) AS fills FROM fills GROUP BY 1)
SELECT condition_id, label, fills, CASE WHEN fills < 5 THEN 'COVERAGE_INELIGIBLE' ELSE 'BUILT' END AS selection FROM c LEFT JOIN lab USING (condition_id) JOIN markets USING (condition_id) WHERE market_start_ms >= (SELECT quantile_disc(market_start_ms, 0.5) FROM markets)""")  # fmt: skip
def prospective_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of the markets that are new since the last build (the later half); markets with few fills are recorded as such."""
    f = X.fills(spark, sf_dir)
    old = f.select("condition_id", "market_start_ms").distinct()
    since = old.groupBy("market_start_ms").count()
    total = old.count()
    edge = since.selectExpr("market_start_ms", "sum(count) OVER (ORDER BY market_start_ms) AS upto").where(F.col("upto") >= total * 0.5).agg(F.min("market_start_ms").alias("edge"))
    return ledger.prospective_rows(f.crossJoin(F.broadcast(edge)).where("market_start_ms >= edge").drop("edge"), GAP, HORIZON, 5)
