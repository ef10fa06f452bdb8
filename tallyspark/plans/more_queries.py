"""Registered queries of grids, statistics, evaluation, logs and scalar functions, each with an independent SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import evaluation, grid, ledger, logs, stats
from tallyspark.plans.queries import INTERVALS, r6, register
from tallyspark.sources import files
from tallyspark.sources import fixtures as X
from tallyspark.sources.fixtures import HOUR, with_sql

STEP, STALE = 6 * HOUR, 48 * HOUR
GRID = f"""{with_sql("ev", "ticks", "book")}, spans AS (SELECT user_id::VARCHAR AS condition_id, min(ms) // {STEP} * {STEP} AS start_ms, max(ms) // {STEP} * {STEP} AS end_ms FROM ev GROUP BY 1),
g0 AS (SELECT condition_id, i, start_ms + i * {STEP} AS ms FROM spans, LATERAL (SELECT unnest(range((end_ms - start_ms + {STEP} - 1) // {STEP})) AS i)),
grid AS (SELECT g.condition_id, g.i, g.ms, t.price, CASE WHEN g.ms - b.receive_ms <= {STALE} THEN b.mid END AS mid FROM g0 g
  LEFT JOIN LATERAL (SELECT price FROM ticks t WHERE t.condition_id = g.condition_id AND t.exchange_ms <= g.ms ORDER BY exchange_ms DESC, trade_id DESC LIMIT 1) t ON true
  LEFT JOIN LATERAL (SELECT mid, receive_ms FROM book b WHERE b.condition_id = g.condition_id AND b.receive_ms <= g.ms ORDER BY receive_ms DESC, seq DESC LIMIT 1) b ON true)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.events(spark, sf_dir)
    spans = e.groupBy(F.col("user_id").cast("string").alias("condition_id")).agg((F.floor(F.min("ms") / STEP) * STEP).alias("start_ms"), (F.floor(F.max("ms") / STEP) * STEP).alias("end_ms"))
    ticks = X.ticks(spark, sf_dir).select("condition_id", F.col("exchange_ms").alias("ms"), "price", F.col("trade_id").alias("seq"))
    return grid.build_grid(spans, ticks, X.book(spark, sf_dir).withColumnRenamed("receive_ms", "ms"), "condition_id", STEP, STALE)


@register("h02_grid", f"{GRID} SELECT condition_id, i, ms, round(price, 6) AS price, round(mid, 6) AS mid FROM grid")
def build_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular grid with as-of prices and bounded as-of mids."""
    return _grid(spark, sf_dir).select("condition_id", F.col("i").cast("long").alias("i"), "ms", "price", "mid").withColumns(r6("price", "mid"))


_FEATURES = f"""{GRID}, f AS (SELECT *, (price / lag(price, 1) OVER w - 1) * 10000 AS bp_1, (price / lag(price, 4) OVER w - 1) * 10000 AS bp_4,
 CASE WHEN count(price) OVER (PARTITION BY condition_id ORDER BY i ROWS 3 PRECEDING) = 4 THEN stddev_samp(price) OVER (PARTITION BY condition_id ORDER BY i ROWS 3 PRECEDING) END AS rolling_std FROM grid WINDOW w AS (PARTITION BY condition_id ORDER BY i)),
fs AS (SELECT *, CASE WHEN abs(bp_1) < 1 THEN '0-1' WHEN abs(bp_1) < 2 THEN '1-2' WHEN abs(bp_1) < 5 THEN '2-5' WHEN abs(bp_1) < 10 THEN '5-10' WHEN bp_1 IS NOT NULL THEN '>10' END AS shock FROM f)"""


@register("h03_grid_features", f"{_FEATURES} SELECT condition_id, i, round(bp_1, 4) AS bp_1, round(bp_4, 4) AS bp_4, round(rolling_std, 4) AS rolling_std, shock FROM fs")
def grid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes, rolling deviation and shock buckets on the grid."""
    f = grid.grid_features(_grid(spark, sf_dir), "condition_id", [1, 4], 4)
    return f.select("condition_id", F.col("i").cast("long").alias("i"), *[F.round(c, 4).alias(c) for c in ("bp_1", "bp_4", "rolling_std")], "shock")


@register("h05_response_curve", f"""{_FEATURES}, s AS (SELECT condition_id, i, shock, sign(bp_1) AS sg, mid AS m0, h AS horizon FROM fs, (VALUES (1), (2), (4)) v(h) WHERE abs(bp_1) >= 1),
r AS (SELECT shock, horizon, sg * (l.mid - m0) AS resp FROM s JOIN grid l ON l.condition_id = s.condition_id AND l.i = s.i + horizon)
SELECT shock, horizon, count(*) AS n, round(avg(resp), 6) AS mean, round(median(resp), 6) AS median FROM r WHERE resp IS NOT NULL GROUP BY ALL""")  # fmt: skip
def response_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response of the mid to shocks of the price."""
    f = grid.grid_features(_grid(spark, sf_dir), "condition_id", [1], 4)
    return grid.response_curve(f, "condition_id", "bp_1", [1, 2, 4]).withColumns(r6("mean", "median"))


_MOVES = f"""{GRID}, m AS (SELECT condition_id, i, price / lag(price) OVER w - 1 AS dx, mid - lag(mid) OVER w AS dy FROM grid WINDOW w AS (PARTITION BY condition_id ORDER BY i)),
x AS (SELECT a.condition_id, lag, a.dx, b.dy FROM m a, (VALUES (-2), (-1), (0), (1), (2)) v(lag), m b WHERE b.condition_id = a.condition_id AND b.i = a.i + lag AND a.dx IS NOT NULL AND b.dy IS NOT NULL),
c AS (SELECT condition_id, lag, count(*) AS n, CASE WHEN count(*) > 2 AND stddev_pop(dx) > 0 AND stddev_pop(dy) > 0 THEN corr(dx, dy) END AS corr FROM x GROUP BY ALL)"""


@register("h07_cross_correlation", f"{_MOVES} SELECT condition_id, lag, n, round(corr, 6) AS corr FROM c")
def cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-correlation of price and mid changes over lags."""
    return grid.cross_correlation(_grid(spark, sf_dir), "condition_id", [-2, -1, 0, 1, 2]).withColumn("corr", F.when(~F.isnan("corr"), F.round("corr", 6)))


@register("h09_peak", f"{_MOVES}, p AS (SELECT condition_id, lag, round(corr, 6) AS corr, row_number() OVER (PARTITION BY condition_id ORDER BY abs(round(corr, 6)) DESC, abs(lag), lag) AS rn FROM c WHERE corr IS NOT NULL) SELECT condition_id, lag, corr FROM p WHERE rn = 1")
def peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of the strongest correlation."""
    return grid.peak(cross_correlation(spark, sf_dir), "condition_id", "lag", "corr")


@register("h08_lagged_regression", f"""{GRID}, m AS (SELECT condition_id, i, price / lag(price) OVER w - 1 AS x, lead(mid, 2) OVER w - mid AS y FROM grid WINDOW w AS (PARTITION BY condition_id ORDER BY i)),
j AS (SELECT lag, a.x, b.y FROM m a, (VALUES (0), (1), (2)) v(lag), m b WHERE b.condition_id = a.condition_id AND b.i = a.i + lag AND a.x IS NOT NULL AND b.y IS NOT NULL)
SELECT lag, count(*) AS n, round(regr_slope(y, x), 4) AS beta, round(regr_intercept(y, x), 4) AS alpha, round(regr_r2(y, x), 4) AS r2 FROM j GROUP BY 1""")  # fmt: skip
def lagged_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression of the mid's change on earlier price changes."""
    return grid.lagged_regression(_grid(spark, sf_dir), "condition_id", [0, 1, 2], 2).withColumns({c: F.round(c, 4) for c in ("beta", "alpha", "r2")})


@register("h17_latency_statistics", f"""{with_sql("ev", "ticks")}, d AS (SELECT buyer_is_maker, (receive_ms - exchange_ms)::DOUBLE AS x FROM ticks), m AS (SELECT buyer_is_maker, quantile_cont(x, 0.5) AS md FROM d GROUP BY 1)
SELECT buyer_is_maker, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.99), 6) AS p99, max(x) AS most, round(quantile_cont(abs(x - md), 0.5), 6) AS mad,
 round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(avg((x > 50)::INT), 6) AS above_50 FROM d JOIN m USING (buyer_is_maker) GROUP BY 1""")  # fmt: skip
def latency_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the receive delay by a dimension."""
    rows = X.ticks(spark, sf_dir).select("buyer_is_maker", (F.col("receive_ms") - F.col("exchange_ms")).cast("double").alias("delay"))
    return grid.latency_statistics(rows, ["buyer_is_maker"], "delay", [50]).withColumns(r6("p50", "p90", "p99", "mad", "iqr", "above_50"))


@register("h27_grid_quality", f"{GRID} SELECT {STEP} AS step_ms, count(*) AS n, round(avg((mid IS NOT NULL)::INT), 6) AS valid_rate, round(avg((price IS NULL)::INT), 6) AS missing_rate FROM grid")
def grid_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the grid."""
    return grid.grid_quality(_grid(spark, sf_dir), STEP).withColumns(r6("valid_rate", "missing_rate"))


@register("i01_describe", """WITH l AS (SELECT l_returnflag, 'l_quantity' AS variable, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem)
SELECT l_returnflag, variable, count(v) AS n, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(coalesce(stddev_samp(v), 0), 6) AS std, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75 FROM l GROUP BY ALL""")  # fmt: skip
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped summary of variables."""
    return stats.describe(X.table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount"]).withColumns(r6("mean", "median", "std", "p25", "p75"))


@register("i02_standardised_difference", """WITH l AS (SELECT o_orderstatus = 'F' AS g, 'o_totalprice' AS variable, o_totalprice AS v FROM orders UNION ALL SELECT o_orderstatus = 'F', 'o_custkey', o_custkey FROM orders),
s AS (SELECT variable, avg(v) FILTER (g) AS m1, avg(v) FILTER (NOT g) AS m0, sqrt((coalesce(var_samp(v) FILTER (g), 0) + coalesce(var_samp(v) FILTER (NOT g), 0)) / 2) AS sd FROM l GROUP BY 1), d AS (SELECT *, CASE WHEN sd > 0 THEN (m1 - m0) / sd WHEN m1 = m0 THEN 0 END AS smd FROM s)
SELECT variable, round(m1, 4) AS m1, round(m0, 4) AS m0, round(smd, 6) AS smd, CASE WHEN abs(smd) >= 0.5 THEN 'LARGE' WHEN abs(smd) >= 0.2 THEN 'MODERATE' WHEN smd IS NOT NULL THEN 'SMALL' END AS magnitude FROM d""")  # fmt: skip
def standardised_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised mean differences of two groups."""
    rows = X.table(spark, sf_dir, "orders").withColumn("g", F.col("o_orderstatus") == "F")
    out = stats.standardised_difference(rows, "g", ["o_totalprice", "o_custkey"])
    return out.withColumns({"m1": F.round("m1", 4), "m0": F.round("m0", 4), "smd": F.round("smd", 6)})


@register("i05_concentration", """WITH c AS (SELECT 'l_returnflag' AS dimension, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2)
SELECT *, round(n / sum(n) OVER (PARTITION BY dimension), 6) AS share FROM c""")  # fmt: skip
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by several dimensions in one pass."""
    return stats.concentration(X.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]).withColumns(r6("share"))


_MONTHS = f"{with_sql('scores')}, m AS (SELECT period, count(*) AS n, avg(y) AS rate FROM scores GROUP BY 1)"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scores(spark, sf_dir).groupBy("period").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))


@register("i07_week_over_week", f"{_MONTHS} SELECT period, n, round(rate, 6) AS rate, round(rate - lag(rate) OVER (ORDER BY period), 6) AS delta, round(avg(rate) OVER (), 6) AS mean, round(stddev_pop(rate) OVER (), 6) AS std, abs(rate - avg(rate) OVER ()) > 2 * stddev_pop(rate) OVER () AS extreme FROM m")
def week_over_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per period with changes and extremes."""
    return stats.week_over_week(_months(spark, sf_dir), "period", "rate").withColumns(r6("rate", "delta", "mean", "std"))


@register("i10_cusum_break", f"""{_MONTHS}, z AS (SELECT period, (rate - avg(rate) OVER ()) / nullif(stddev_pop(rate) OVER (), 0) AS z, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS c FROM m),
s AS (SELECT *, sum(z) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING) AS cs FROM z), b AS (SELECT *, row_number() OVER (ORDER BY round(abs(cs), 9) DESC, period) AS rn FROM s WHERE i >= 2 AND i <= c - 2)
SELECT 'all' AS metric, period AS break_at, round(cs, 6) AS cusum, abs(cs) >= greatest(1.5, sqrt(c)) AS found FROM b WHERE rn = 1""")  # fmt: skip
def cusum_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Break by cumulative z scores."""
    return stats.cusum_break(_months(spark, sf_dir).withColumn("metric", F.lit("all")), "metric", "period", "rate").withColumns(r6("cusum"))


@register("i11_split_break", f"""{_MONTHS}, z AS (SELECT period, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS c, stddev_pop(rate) OVER () AS sd, avg(rate) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, avg(rate) OVER (ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM m),
s AS (SELECT *, abs(b - a) / nullif(sd, 0) AS score FROM z WHERE i > 2 AND i <= c - 1), r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, period) AS rn FROM s)
SELECT 'all' AS metric, period AS split_at, round(score, 6) AS score, score >= 1 AS found FROM r WHERE rn = 1""")  # fmt: skip
def split_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Break by the best split."""
    return stats.split_break(_months(spark, sf_dir).withColumn("metric", F.lit("all")), "metric", "period", "rate").withColumns(r6("score"))


@register("i15_stability_index", """WITH o AS (SELECT strftime(o_orderdate, '%Y') AS period, o_totalprice AS v FROM orders), f AS (SELECT min(period) AS p FROM o),
e AS (SELECT list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM o, f WHERE period = p),
b AS (SELECT period, len(list_filter(edges, lambda x: x < v)) AS bin FROM o, e), a AS (SELECT period, bin, count(*) AS n FROM b GROUP BY ALL),
x AS (SELECT p.period, t.bin, coalesce(a.n, 0) AS a, coalesce(z.n, 0) AS e FROM (SELECT DISTINCT period FROM b) p CROSS JOIN (SELECT unnest(range(len(edges) + 1)) AS bin FROM e) t LEFT JOIN a ON a.period = p.period AND a.bin = t.bin LEFT JOIN (SELECT bin, n FROM a, f WHERE period = p) z ON z.bin = t.bin),
s AS (SELECT period, greatest(a / sum(a) OVER (PARTITION BY period), 1e-6) AS pa, greatest(e / sum(e) OVER (PARTITION BY period), 1e-6) AS pe FROM x), q AS (SELECT period, sum((pa - pe) * ln(pa / pe)) AS psi FROM s GROUP BY 1)
SELECT period, round(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'MAJOR' WHEN psi >= 0.1 THEN 'MODERATE' ELSE 'STABLE' END AS drift FROM q""")  # fmt: skip
def stability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability of order prices against the first year."""
    o = X.table(spark, sf_dir, "orders").select(F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy").alias("period"), "o_totalprice")
    first = o.agg(F.min("period").alias("p0"))
    rows = o.crossJoin(F.broadcast(first))
    out = stats.stability_index(rows, "period", "o_totalprice", F.col("period") == F.col("p0"))
    return out.select("period", F.round("psi", 6).alias("psi"), stats.drift_label(F.col("psi")).alias("drift"))


_SCORES = with_sql("scores")
_AUC = "s AS (SELECT {by} p, sum(y) AS pos, count(*) AS n FROM scores GROUP BY ALL), k AS (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS r FROM s), a AS (SELECT {by} sum(n)::BIGINT AS n, sum(pos)::BIGINT AS positives, (sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * (sum(n) - sum(pos)), 0) AS auc FROM k {group})"
_AUC_BY = _AUC.format(by="period,", part="PARTITION BY period", group="GROUP BY period")


@register("m02_auc", f"{_SCORES}, {_AUC_BY} SELECT period, n, positives, round(auc, 6) AS auc FROM a")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank AUC per period."""
    return evaluation.auc(X.scores(spark, sf_dir), ["period"], "y", "p").withColumns(r6("auc"))


@register("m03_conditional_auc", f"{_SCORES}, {_AUC_BY}, {_AUC.format(by='', part='', group='').replace('s AS', 's0 AS', 1).replace('k AS', 'k0 AS').replace('FROM s)', 'FROM s0)').replace(', a AS', ', a0 AS').replace('FROM k ', 'FROM k0 ')} SELECT count(*) AS periods, round(avg(auc), 6) AS macro, round(sum(auc * n) / sum(n), 6) AS weighted, round((SELECT auc FROM a0), 6) AS pooled FROM a WHERE auc IS NOT NULL")
def conditional_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the periods' AUCs and the pooled one."""
    return evaluation.conditional_auc(X.scores(spark, sf_dir), "period", "y", "p").withColumns(r6("macro", "weighted", "pooled"))


@register("m04_calibration", f"{_SCORES} SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM scores GROUP BY 1")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration bins."""
    return evaluation.calibration(X.scores(spark, sf_dir), "y", "p").withColumns(r6("mean_p", "rate"))


@register("m04_calibration_error", f"{_SCORES}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS r FROM scores GROUP BY 1) SELECT round(sum(n * abs(mp - r)) / sum(n), 6) AS ece FROM b")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error."""
    return evaluation.calibration_error(evaluation.calibration(X.scores(spark, sf_dir), "y", "p")).withColumns(r6("ece"))


@register("m05_losses", f"{_SCORES}, c AS (SELECT period, y, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM scores) SELECT period, count(*) AS n, round(avg((q - y) ** 2), 6) AS brier, round(avg(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS log_loss FROM c GROUP BY 1")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and log loss per period."""
    return evaluation.losses(X.scores(spark, sf_dir), ["period"], "y", "p").withColumns(r6("brier", "log_loss"))


@register("m06_walk_forward_baseline", f"""{_SCORES}, g AS (SELECT period, count(*) AS n, sum(y) AS pos FROM scores GROUP BY 1),
f AS (SELECT *, count(*) OVER w AS train_periods, sum(n) OVER w AS train_n, sum(pos) OVER w / sum(n) OVER w AS rate FROM g WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT period, train_periods, train_n::BIGINT AS train_n, n, round(rate, 6) AS rate, round((pos * (1 - rate) ** 2 + (n - pos) * rate ** 2) / n, 6) AS brier FROM f WHERE train_periods >= 4 AND n >= 10""")  # fmt: skip
def walk_forward_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding folds with the training rate as score."""
    return evaluation.walk_forward_baseline(X.scores(spark, sf_dir), "period", "y", 4, 10).withColumns(r6("rate", "brier"))


@register("m09_label_shuffle", f"{_SCORES} SELECT period, count(*) AS n, sum(y)::BIGINT AS positives, sum(y)::BIGINT AS shuffled_positives FROM scores GROUP BY 1")
def label_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels permuted inside periods keep the periods' rates."""
    mixed = evaluation.shuffled_labels(X.scores(spark, sf_dir), "id", "period", "y", F.lit(7))
    return mixed.groupBy("period").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.sum("shuffled").alias("shuffled_positives"))


def shuffle_sql(rows: str, shuffles: int) -> str:
    """CTEs up to auc (shuffle, period, auc): labels of rows (id, period, y, p) permuted inside their periods, and the AUC of each."""
    return f"""sp AS (SELECT *, t.i AS shuffle FROM {rows}, range({shuffles}) t(i)),
rk AS (SELECT *, row_number() OVER (PARTITION BY shuffle, period ORDER BY md5(id || ':' || shuffle || ':row')) AS a, row_number() OVER (PARTITION BY shuffle, period ORDER BY md5(id || ':' || shuffle || ':label')) AS b FROM sp),
mx AS (SELECT x.shuffle, x.period, x.p, z.y FROM rk x JOIN rk z ON x.shuffle = z.shuffle AND x.period = z.period AND x.a = z.b),
ds AS (SELECT shuffle, period, p, sum(y) AS pos, count(*) AS n FROM mx GROUP BY ALL), dr AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY shuffle, period ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS r FROM ds),
auc AS (SELECT shuffle, period, (sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * (sum(n) - sum(pos)), 0) AS auc FROM dr GROUP BY ALL), sh AS (SELECT shuffle, avg(auc) AS auc FROM auc GROUP BY 1)"""


SHUFFLED = "count(*) AS shuffles, round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.95), 6) AS p95, round(max(auc), 6) AS most FROM sh"


@register("m10_shuffle_control", f"{_SCORES}, {shuffle_sql('scores', 20)} SELECT {SHUFFLED}")
def shuffle_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro AUC under shuffles of the labels inside their periods."""
    return evaluation.shuffle_control(X.scores(spark, sf_dir), "id", "period", "y", "p", 20).withColumns(r6("mean", "p95", "most"))


@register("m15_threshold_policy", f"{_SCORES}, {_AUC_BY} SELECT period, CASE WHEN auc >= 0.45 AND n <= 2000 THEN 'PASS' ELSE 'FAIL' END AS status, concat_ws(',', CASE WHEN auc IS NULL THEN 'auc_missing' END, CASE WHEN auc < 0.45 THEN 'auc_low' END, CASE WHEN n > 2000 THEN 'n_high' END) AS reasons FROM a")
def threshold_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold policy over the periods' AUCs."""
    return evaluation.threshold_policy(evaluation.auc(X.scores(spark, sf_dir), ["period"], "y", "p"), "period", {"auc": 0.45}, {"n": 2000})


@register("m16_sufficiency", f"{with_sql('ev')} SELECT count(*) AS n, round((max(ms) - min(ms)) / 86400000, 6) AS days, count(*) >= 1000 AND (max(ms) - min(ms)) / 86400000 >= 14 AS enough FROM ev")
def sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enough rows over enough days."""
    return evaluation.sufficiency(X.events(spark, sf_dir), "ms", 1000, 14).withColumns(r6("days"))


def _executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = X.table(spark, sf_dir, "lineitem"), X.table(spark, sf_dir, "part")
    rows = lines.join(parts.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    return rows.select("l_orderkey", F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.when(F.col("l_returnflag") == "R", "maker").otherwise("taker").alias("liquidity"), F.col("p_retailprice").alias("reference"))


_COSTS = """WITH x AS (SELECT l_orderkey, l_quantity AS qty, l_extendedprice / l_quantity AS price, CASE WHEN l_returnflag = 'R' THEN 'maker' ELSE 'taker' END AS liquidity, p_retailprice AS reference FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT l_orderkey, sum(qty) AS filled, sum(qty * price) AS notional, sum(CASE WHEN liquidity = 'taker' THEN qty * price * 0.001 ELSE 0 END) AS fees, sum(CASE WHEN liquidity = 'maker' THEN qty * price * 0.0002 ELSE 0 END) AS rebates, sum(qty * (price - reference)) AS slippage, avg(reference) AS mark FROM x GROUP BY 1)"""


@register("k01_execution_costs", f"{_COSTS} SELECT l_orderkey, filled, round(notional, 6) AS notional, round(fees, 6) AS fees, round(rebates, 6) AS rebates, round(slippage, 6) AS slippage, 0::BIGINT AS unknown_liquidity, round(notional / nullif(filled, 0), 6) AS vwap, round(fees - rebates + slippage, 6) AS cost FROM c")
def execution_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution costs per order."""
    return logs.execution_costs(_executions(spark, sf_dir), "l_orderkey", 0.0002, 0.001).withColumns({c: F.round(c, 6) for c in ("notional", "fees", "rebates", "slippage", "vwap", "cost")})


@register("k02_mark_to_market", f"{_COSTS} SELECT l_orderkey, round((mark - notional / nullif(filled, 0)) * filled - fees + rebates, 6) AS pnl FROM c")
def mark_to_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mark-to-market per order."""
    x = _executions(spark, sf_dir)
    marks = x.groupBy("l_orderkey").agg(F.avg("reference").alias("mark"))
    return logs.mark_to_market(logs.execution_costs(x, "l_orderkey", 0.0002, 0.001), marks, "l_orderkey").withColumn("pnl", F.round("pnl", 6))


@register("k03_book_sweep", f"""{with_sql("ev", "book")}, l AS (SELECT seq, value * 2.5 AS qty, i, mid + (i + 1) * 0.01 AS price, value + (i * k) % 7 AS size FROM book, (VALUES (0), (1), (2), (3)) t(i)),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l), t AS (SELECT *, least(size, greatest(qty - before, 0)) AS taken FROM b)
SELECT seq, round(sum(taken), 4) AS filled, round(sum(taken * price) / nullif(sum(taken), 0), 4) AS price, round(max(qty) - sum(taken), 4) AS rest FROM t GROUP BY 1""")  # fmt: skip
def book_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a large order takes from the ask levels."""
    rows = X.book(spark, sf_dir).select("seq", "asks", (F.get("asks", F.lit(0))["size"] * 2.5).alias("qty"))
    return logs.book_sweep(rows, "seq", "asks", "qty").withColumns({c: F.round(c, 4) for c in ("filled", "price", "rest")})


@register("k04_queue_fill", """WITH q AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS traded FROM q), f AS (SELECT l_orderkey, l_linenumber, least(40.0, greatest(traded - 20.0, 0)) AS filled FROM t)
SELECT l_orderkey, l_linenumber, filled, filled - coalesce(lag(filled) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS step FROM f""")  # fmt: skip
def queue_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill of an order for 40 behind a queue of 20."""
    lines = X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"))
    rows = lines.select("l_orderkey", "l_linenumber", "l_quantity", F.lit(20.0).alias("ahead"), F.lit(40.0).alias("qty"))
    return logs.queue_fill(rows, "l_orderkey", "l_linenumber", "l_quantity", "ahead", "qty")


@register("k05_order_audit", """WITH e AS (SELECT l_orderkey, l_linenumber AS seq, l_quantity, sum(l_quantity) OVER w AS cum, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS ordered, CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS broken FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, count(*) AS events, CASE WHEN max(broken) = 1 THEN 'CONFLICT' ELSE 'OBSERVED_TERMINAL' END AS status, CASE WHEN max(broken) = 1 THEN 'CUMULATIVE_MISMATCH' END AS reason FROM e GROUP BY 1""")  # fmt: skip
def order_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of order events, every 50th order damaged on purpose."""
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey")
    q = F.col("l_quantity").cast("decimal(18,4)")
    total = F.sum(q).over(by.orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, 0))
    lines = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    e = files.dealt(lines, lines.count(), "l_orderkey").select("l_orderkey", F.col("l_linenumber").alias("seq"), F.col("l_linenumber").alias("ts_ms"), q.alias("fill_qty"), (total + F.when(F.col("l_orderkey") % 50 == 0, 1).otherwise(0)).alias("cumulative"), F.sum(q).over(by).alias("ordered"))
    return logs.order_audit(e.withColumn("remaining", F.col("ordered") - F.col("cumulative")), "l_orderkey", "seq")


@register("k08_average_cost", f"""{with_sql("ev", "fills").replace("WITH", "WITH RECURSIVE", 1)}, o AS (SELECT condition_id || outcome AS k, side, size AS qty, price, row_number() OVER (PARTITION BY condition_id || outcome ORDER BY timestamp_ms, fill_id) AS i FROM fills),
f AS (SELECT k, 0 AS i, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS pnl, 0 AS bad FROM o WHERE i = 1 UNION ALL
 SELECT f.k, o.i, CASE WHEN side = 'BUY' THEN pos + qty WHEN qty <= pos + 1e-9 THEN greatest(pos - qty, 0) ELSE pos END,
  CASE WHEN side = 'BUY' THEN cost + qty * price WHEN qty <= pos + 1e-9 THEN (CASE WHEN pos > 0 THEN cost / pos ELSE 0 END) * greatest(pos - qty, 0) ELSE cost END,
  CASE WHEN side <> 'BUY' AND qty <= pos + 1e-9 THEN pnl + qty * (price - CASE WHEN pos > 0 THEN cost / pos ELSE 0 END) ELSE pnl END, CASE WHEN side <> 'BUY' AND qty > pos + 1e-9 THEN bad + 1 ELSE bad END FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
SELECT k AS account, round(arg_max(pos, i), 4) AS pos, round(arg_max(cost, i), 4) AS cost, round(arg_max(pnl, i), 4) AS pnl, arg_max(bad, i) AS bad FROM f GROUP BY 1""")  # fmt: skip
def average_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-cost positions and realised profit."""
    f = X.fills(spark, sf_dir).select(F.concat("condition_id", "outcome").alias("account"), "timestamp_ms", "fill_id", "side", F.col("size").alias("qty"), "price")
    return logs.average_cost_ledger(f, "account", ["timestamp_ms", "fill_id"]).withColumns({c: F.round(c, 4) for c in ("pos", "cost", "pnl")})


@register("k12_attempt_summary", """WITH a AS (SELECT conv_id, turn, role, length(text) AS tokens, (length(text) / 1000000)::DECIMAL(38, 18) AS cost FROM conversations), r AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, tokens) AS rn, count(*) OVER p AS n, sum(tokens) OVER p AS t, sum(cost) OVER p AS c FROM a WINDOW p AS (PARTITION BY conv_id))
SELECT role, count(*) AS keys, sum(n)::BIGINT AS attempts, sum(t)::BIGINT AS tokens, round(sum(c)::DOUBLE, 6) AS cost FROM r WHERE rn = 1 GROUP BY 1""")  # fmt: skip
def attempt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest attempts per key with exact costs."""
    a = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length("text").alias("tokens")).withColumn("cost", (F.col("tokens").cast("decimal(18,0)") / 1000000).cast("decimal(30,12)"))
    return logs.attempt_summary(a, "conv_id", "turn", "role").withColumn("cost", F.round(F.col("cost").cast("double"), 6))


@register("k15_connection_lifetimes", f"{INTERVALS} SELECT count(*) AS n, round(quantile_cont((end_ms - start_ms)::DOUBLE, 0.1), 3) AS p10, round(quantile_cont((end_ms - start_ms)::DOUBLE, 0.5), 3) AS p50, round(quantile_cont((end_ms - start_ms)::DOUBLE, 0.9), 3) AS p90 FROM iv")
def connection_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetimes of connections."""
    return logs.connection_lifetimes(ledger.connection_intervals(X.sessions(spark, sf_dir))).withColumns({c: F.round(c, 3) for c in ("p10", "p50", "p90")})


@register("k17_feed_health", f"{with_sql('ev', 'book')} SELECT condition_id, count(receive_ms) AS records, max(receive_ms) AS last_ms, 1706659200000 - max(receive_ms) AS age_ms, CASE WHEN 1706659200000 - max(receive_ms) > {48 * HOUR} THEN 'STALE' ELSE 'HEALTHY' END AS health FROM book GROUP BY 1")
def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every feed at the end of January."""
    return logs.feed_health(X.book(spark, sf_dir), "condition_id", "receive_ms", 1706659200000, 48 * HOUR)


@register("p08_slug_window", f"{with_sql('ev', 'fills')} SELECT DISTINCT slug, market_start_ms AS start_ms, market_end_ms AS end_ms FROM fills")
def slug_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows named by slugs."""
    start, end = S.slug_window(F.col("slug"), "w7d-", 604800)
    return X.fills(spark, sf_dir).select("slug", start.alias("start_ms"), end.alias("end_ms")).distinct()


@register("p09_calendar_keys", f"{with_sql('ev')} SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS day, hour(make_timestamp(ms * 1000))::INT AS hour, strftime(make_timestamp(ms * 1000), '%G-W%V') AS iso_week FROM ev")
def calendar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar keys of events."""
    keys = S.calendar_keys(F.col("ms"))
    return X.events(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in keys.items()])


@register("p10_up_price", f"{with_sql('ev', 'fills')} SELECT fill_id, round(CASE WHEN outcome = 'Down' THEN 1 - price ELSE price END, 6) AS up_price, CASE WHEN (outcome = 'Up') = (side = 'BUY') THEN 1 ELSE -1 END AS direction FROM fills")
def up_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: prices and directions in Up terms."""
    return X.fills(spark, sf_dir).select("fill_id", F.round(S.up_price(F.col("outcome"), F.col("price")), 6).alias("up_price"), S.direction(F.col("outcome"), F.col("side")).alias("direction"))


@register("p15_right_closed", "SELECT l_orderkey, l_linenumber, greatest(ceil(l_discount / 0.02 - 1e-9)::INT - 1, 0) AS bucket FROM lineitem")
def right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-closed buckets of the discount in hundredths."""
    cents = F.round(F.col("l_discount") * 100).cast("int")
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.right_closed(cents, 0, 2, 5).alias("bucket"))


@register("p22_reasons", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 200000 THEN 'LARGE' END, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'URGENT' END) AS reasons FROM orders")
def reason_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason lists of orders."""
    why = S.reasons((F.col("o_totalprice") > 200000, "LARGE"), (F.col("o_orderstatus") == "F", "CLOSED"), (F.col("o_orderpriority").startswith("1"), "URGENT"))
    return X.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(why, ",").alias("reasons"))


@register("p27_expected_keys", f"""{with_sql("ev")}, w AS (SELECT min(ms) // 3600000 AS a, max(ms) // 3600000 AS b FROM ev) SELECT 'h-' || h AS slug, h NOT IN (SELECT ms // 3600000 FROM ev) AS missing FROM w, LATERAL (SELECT unnest(range(a, b + 1)) AS h)""")
def expected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected hourly keys, and whether an event fell into them."""
    hours = X.events(spark, sf_dir).select(F.floor(F.col("ms") / HOUR).alias("h"))
    wanted = hours.agg(F.min("h").alias("a"), F.max("h").alias("b")).select(F.explode(F.sequence("a", "b")).alias("h"))
    return wanted.join(hours.distinct().withColumn("seen", F.lit(True)), "h", "left").select(F.concat(F.lit("h-"), "h").alias("slug"), F.col("seen").isNull().alias("missing"))


@register("p28_phrase_scan", "SELECT doc_id, phrase FROM documents, (VALUES ('license'), ('the of'), ('und der')) t(phrase) WHERE contains(lower(text), phrase)")
def phrase_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a phrase, whatever the case."""
    phrases = ["license", "the of", "und der"]
    found = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower("text"), p))
    return X.table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("phrase"))
