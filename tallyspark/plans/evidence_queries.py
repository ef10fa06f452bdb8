"""Registered queries of evidence across markets, publications, regimes and orders, each with an independent SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.operators import evidence as V
from tallyspark.operators import grid
from tallyspark.plans.more_queries import _MOVES, cross_correlation
from tallyspark.plans.queries import r6, register
from tallyspark.sources import files
from tallyspark.sources import fixtures as X
from tallyspark.sources.fixtures import HOUR, with_sql

EV = with_sql("ev")
_DIRS = f"""{EV}, d AS (SELECT user_id, CASE WHEN avg(k) > 49.5 THEN 'BTC' ELSE 'PM' END AS a, CASE WHEN count(*) FILTER (k % 3 = 0) * 3 > count(*) THEN 'BTC' ELSE 'PM' END AS b, CASE WHEN count(*) % 5 = 0 THEN NULL WHEN count(*) % 2 = 0 THEN 'BTC' ELSE 'SYNC' END AS c FROM ev GROUP BY 1)"""


def _directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three directions for each user, as three methods would give."""
    g = X.events(spark, sf_dir).groupBy("user_id").agg(F.avg("k").alias("m"), F.count_if(F.col("k") % 3 == 0).alias("t"), F.count("*").alias("n"))
    c = F.when(F.col("n") % 5 == 0, F.lit(None).cast("string")).when(F.col("n") % 2 == 0, "BTC").otherwise("SYNC")
    return g.select("user_id", F.when(F.col("m") > 49.5, "BTC").otherwise("PM").alias("a"), F.when(F.col("t") * 3 > F.col("n"), "BTC").otherwise("PM").alias("b"), c.alias("c"))


@register("h10_vote_agreement", f"{_DIRS}, v AS (SELECT user_id, unnest([a, b, c]) AS w FROM d), n AS (SELECT user_id, w, count(*) AS votes FROM v WHERE w IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, w) AS rn FROM n) SELECT user_id, w AS winner, votes, votes >= 2 AS consistent FROM r WHERE rn = 1")
def vote_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction that most of three methods give."""
    return V.vote_agreement(_directions(spark, sf_dir), "user_id", ["a", "b", "c"])


@register("h23_agreement_matrix", f"""{_DIRS}, m AS (SELECT 'a' AS a, 'b' AS b, a = b AS same FROM d UNION ALL SELECT 'a', 'c', a = c FROM d UNION ALL SELECT 'b', 'c', b = c FROM d UNION ALL SELECT 'all', 'all', a = b AND a = c FROM d),
n AS (SELECT a, b, count(*) FILTER (same) AS agree, count(*) FILTER (NOT same) AS disagree FROM m GROUP BY ALL) SELECT *, CASE WHEN agree >= 0.4 * (agree + disagree) THEN 'STABLE' ELSE 'UNSTABLE' END AS status FROM n""")  # fmt: skip
def agreement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each two methods agree."""
    return V.agreement_matrix(_directions(spark, sf_dir), ["a", "b", "c"], 0.4)


@register("h11_dependence_sensitivity", """WITH m AS (SELECT l_linenumber, l_orderkey, l_discount + CASE WHEN l_orderkey % 3 = 0 AND l_linenumber > 3 THEN -0.1 ELSE 0 END - 0.05 AS v FROM lineitem), a AS (SELECT l_linenumber, count(*) AS n, round(avg(v), 6) AS m FROM m GROUP BY 1), b AS (SELECT l_linenumber, count(*) AS n, round(avg(v), 6) AS m FROM m WHERE l_orderkey % 3 = 0 GROUP BY 1)
SELECT l_linenumber, a.m * b.m < 0 AS flip, round(coalesce(abs(a.m - b.m) / nullif(greatest(abs(a.m), abs(b.m)), 0), 0), 4) AS change, a.m * b.m < 0 OR coalesce(abs(a.m - b.m) / nullif(greatest(abs(a.m), abs(b.m)), 0), 0) > 0.5 AS sensitive FROM a JOIN b USING (l_linenumber) WHERE a.n >= 10 AND b.n >= 10""")
def dependence_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines against every third order's, of which some are shifted."""
    m = X.table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_discount") + F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") > 3), -0.1).otherwise(0.0) - 0.05)
    mean = lambda df: df.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))
    return V.dependence_sensitivity(mean(m), mean(m.where("l_orderkey % 3 = 0")), "l_linenumber").withColumn("change", F.round("change", 4))


_PEAKS = f"""{_MOVES}, cc AS (SELECT condition_id, lag, round(corr, 6) AS corr FROM c WHERE corr IS NOT NULL), pk AS (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY abs(corr) DESC, abs(lag), lag) AS rn FROM cc), p1 AS (SELECT condition_id, lag, corr FROM pk WHERE rn = 1)"""


@register("h12_clock_basis", f"""{_PEAKS}, pk2 AS (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY abs(corr) DESC, abs(lag), lag) AS rn FROM cc WHERE lag BETWEEN -1 AND 1), p2 AS (SELECT condition_id, lag FROM pk2 WHERE rn = 1),
dl AS (SELECT user_id::VARCHAR AS condition_id, quantile_cont(k::DOUBLE, 0.5) AS p50, quantile_cont(k::DOUBLE, 0.99) AS p99 FROM ev GROUP BY 1)
SELECT condition_id, CASE WHEN p1.lag IS NULL OR p2.lag IS NULL THEN 'UNKNOWN' WHEN sign(p1.lag) = sign(p2.lag) THEN 'CONSISTENT' ELSE 'UNSTABLE' END AS status, round(p99 - p50, 6) AS drift, round(p99 - p50, 6) > 48 AS warning FROM dl LEFT JOIN p1 USING (condition_id) LEFT JOIN p2 USING (condition_id)""")  # fmt: skip
def clock_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the peaks over wide and narrow lags have one sign, and the drift of the delays."""
    curve = cross_correlation(spark, sf_dir)
    delays = X.events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("condition_id")).agg(F.percentile("k", F.lit(0.5)).alias("p50"), F.round(F.percentile("k", F.lit(0.99)), 6).alias("p99"))
    first, second = (grid.peak(c, "condition_id", "lag", "corr") for c in (curve, curve.where("lag between -1 and 1")))
    return V.clock_basis(first, second, delays, "condition_id", "lag", 48).withColumns(r6("drift"))


@register("h13_lead_lag_rows", f"""{_PEAKS}, wd AS (SELECT condition_id, {", ".join(f"max(corr) FILTER (lag = {x}) AS s{i}" for i, x in enumerate((-2, -1, 0, 1, 2)))} FROM cc GROUP BY 1)
SELECT condition_id, lag AS peak_lag, corr AS peak_corr, {", ".join(f"round(abs(s{i}) / nullif(abs(corr), 0), 6) AS share_{i}" for i in range(5))} FROM p1 JOIN wd USING (condition_id)""")  # fmt: skip
def lead_lag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide row for each market: its peak and the other lags as shares of it."""
    curve = cross_correlation(spark, sf_dir)
    return V.lead_lag_row(curve, grid.peak(curve, "condition_id", "lag", "corr"), "condition_id", [-2, -1, 0, 1, 2]).withColumns(r6(*[f"share_{i}" for i in range(5)]))


@register("h24_resolution_levels", f"""{_PEAKS}, sp AS (SELECT user_id::VARCHAR AS condition_id, max(k) * {HOUR} // 20 AS s1, count(*) * {HOUR} // 10 AS s2 FROM ev GROUP BY 1)
SELECT condition_id, greatest(s1, s2) AS bound_ms, CASE WHEN lag IS NULL THEN 'UNKNOWN' WHEN abs(lag) * {6 * HOUR} > greatest(s1, s2) THEN 'RESOLVED' WHEN 2 * abs(lag) * {6 * HOUR} > greatest(s1, s2) THEN 'DIRECTIONAL' ELSE 'NOT_RESOLVED' END AS level FROM sp LEFT JOIN p1 USING (condition_id)""")  # fmt: skip
def resolution_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each market's lag can mean within the spread of its clocks."""
    spread = X.events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("condition_id")).agg(F.floor(F.max("k") * HOUR / 20).alias("s1"), F.floor(F.count("*") * HOUR / 10).alias("s2"))
    peaks = grid.peak(cross_correlation(spark, sf_dir), "condition_id", "lag", "corr").select("condition_id", (F.col("lag") * 6 * HOUR).alias("lag_ms"))
    return V.resolution_levels(spread.join(peaks, "condition_id", "left"), "condition_id", "lag_ms", ["s1", "s2"])


@register("h15_market_bootstrap", f"""{EV}, v AS (SELECT user_id, avg(k) - 49.5 AS v FROM ev GROUP BY 1), i AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, v FROM v), n AS (SELECT count(*) AS n FROM v),
d AS (SELECT b, ((b * 1103515245 + d * 12345 + b * d * 40503) % 2147483647 % n)::BIGINT AS i FROM range(200) t(b), n, LATERAL (SELECT unnest(range(n)) AS d)), m AS (SELECT b, avg(v) AS m FROM d JOIN i USING (i) GROUP BY 1)
SELECT (SELECT n FROM n) AS n, round((SELECT avg(v) FROM v), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg((m > 0)::INT), 6) AS positive FROM m""")  # fmt: skip
def market_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bootstrap over users of their mean delay."""
    v = X.events(spark, sf_dir).groupBy("user_id").agg((F.avg("k") - 49.5).alias("v"))
    return V.market_bootstrap(v, "user_id", "v", 200).withColumns(r6("mean", "low", "high", "positive"))


@register("h20_source_ordering", f"""{EV}, s AS (SELECT event_type AS source, CASE WHEN count(*) FILTER (k % 2 = 1) * 2 > count(*) THEN 1 ELSE 1000 END AS g, max(k) >= 99 AS t FROM ev GROUP BY 1)
SELECT a.source AS a, b.source AS b, CASE WHEN NOT a.t OR NOT b.t THEN 'NO' WHEN a.g = 1 AND b.g = 1 THEN 'YES' ELSE 'LIMITED' END AS ordering FROM s a JOIN s b ON a.source < b.source""")  # fmt: skip
def source_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of events can be ordered against each other, from a registry that the events give."""
    g = X.events(spark, sf_dir).groupBy(F.col("event_type").alias("source")).agg(F.when(F.count_if(F.col("k") % 2 == 1) * 2 > F.count("*"), 1).otherwise(1000).alias("granularity_ms"), (F.max("k") >= 99).alias("trusted"))
    return V.source_ordering(g)


@register("i13_online_regimes", f"""{EV.replace("WITH", "WITH RECURSIVE", 1)}, e AS (SELECT event_type AS u, event_id, ms, (k < CASE WHEN ms // {240 * HOUR} % 2 = 0 THEN 30 ELSE 70 END)::INT AS y FROM ev),
o AS (SELECT u, ms, avg(y) OVER (PARTITION BY u ORDER BY ms, event_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS rate, row_number() OVER (PARTITION BY u ORDER BY ms, event_id) - 1 AS seen, row_number() OVER (PARTITION BY u, ms ORDER BY event_id) AS k FROM e),
p AS (SELECT u, ms, rate, seen, row_number() OVER (PARTITION BY u ORDER BY ms) AS i FROM o WHERE k = 1),
r AS (SELECT u, i, ms, seen, rate, NULL::DOUBLE AS anchor, 0 AS regime FROM p WHERE i = 1 UNION ALL SELECT p.u, p.i, p.ms, p.seen, p.rate,
  CASE WHEN p.seen < 20 THEN NULL WHEN r.anchor IS NULL OR abs(p.rate - r.anchor) >= 0.15 - 1e-12 THEN p.rate ELSE r.anchor END, CASE WHEN p.seen >= 20 AND r.anchor IS NOT NULL AND abs(p.rate - r.anchor) >= 0.15 - 1e-12 THEN r.regime + 1 ELSE r.regime END FROM r JOIN p ON p.u = r.u AND p.i = r.i + 1)
SELECT u AS universe, regime, count(*) AS n, min(ms) AS first_ms FROM r GROUP BY ALL""")  # fmt: skip
def online_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes of a label whose rate moves every ten days, from what was known before each time."""
    e = X.events(spark, sf_dir)
    y = (F.col("k") < F.when(F.floor(F.col("ms") / (240 * HOUR)) % 2 == 0, 30).otherwise(70)).cast("int")
    out = V.online_regimes(e.select(F.col("event_type").alias("universe"), "ms", "event_id", y.alias("y")), "universe", "ms", "y", 40, 20, 0.15, "event_id")
    return out.groupBy("universe", "regime").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"))


@register("i22_frozen_values", "SELECT * FROM (VALUES ('nations', 'FROZEN_VALUE_CHANGED', 'CRITICAL'), ('suppliers', 'NOT_FROZEN', 'CRITICAL')) t(name, finding, severity) WHERE (SELECT count(*) FROM region) = 5 AND (SELECT count(*) FROM nation) = 25")
def frozen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the fixed tables against frozen ones, of which one is wrong and one was never frozen."""
    sizes = [X.table(spark, sf_dir, t).agg(F.lit(f"{t}s").alias("name"), F.count("*").cast("string").alias("value")) for t in ("region", "nation", "supplier")]
    frozen = spark.createDataFrame([("regions", "5"), ("nations", "24")], "name string, value string")
    return V.frozen_findings(frozen, sizes[0].unionByName(sizes[1]).unionByName(sizes[2]))


@register("c08_publication_resolution", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'NEW' WHEN c_custkey % 7 <> 0 THEN 'EXACT_OVERLAP' WHEN c_custkey % 5 = 0 THEN 'UNRESOLVED' WHEN c_custkey % 2 = 0 THEN 'CORRECTED' ELSE 'REPLAYED' END AS status FROM customer) GROUP BY 1""")
def publication_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new table of customers against an old one and the resolutions of their conflicts; some have none or two."""
    c = X.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    new = c.withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")))
    kind = F.when(F.col("c_custkey") % 2 == 0, "CORRECTED").otherwise("REPLAYED")
    resolutions = c.where("c_custkey % 7 = 0 and c_custkey % 5 <> 0").select("c_custkey", kind.alias("resolution")).unionByName(c.where("c_custkey % 70 = 0").select("c_custkey", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("resolution")))
    return V.resolve_publication(c.where("c_custkey % 3 <> 0"), new, resolutions, "c_custkey", ["c_custkey", "c_name", "c_nationkey"]).groupBy("status").agg(F.count("*").alias("n"))


@register("c09_forensic_resolutions", "SELECT event_id AS key, CASE WHEN event_id % 4 = 0 THEN 'UNCOVERED' WHEN event_type = 'view' THEN 'LATE' WHEN event_type = 'click' THEN 'RETRY' ELSE 'UNMAPPED' END AS resolution FROM events WHERE event_id % 3 = 0")
def forensic_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts and their roots from two text logs."""
    e = X.table(spark, sf_dir, "events")
    paths = files.shared_path(spark, "conflicts"), files.shared_path(spark, "roots")
    e.select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("CONFLICT "), F.to_json(F.struct(F.col("event_id").alias("key"))))).otherwise("noise").alias("value")).write.text(paths[0])
    e.where("event_id % 4 <> 0").select(F.concat(F.lit("ROOT "), F.to_json(F.struct(F.col("event_id").alias("key"), F.col("event_type").alias("root")))).alias("value")).write.text(paths[1])
    return V.forensic_resolutions(spark.read.text(paths[0]), spark.read.text(paths[1]), "value", {"view": "LATE", "click": "RETRY"})


@register("c11_provenance_rebind", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'a' WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS source_file, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 2 = 1 THEN sha256('new') ELSE sha256('old') END AS source_sha256,
 CASE WHEN o_orderkey % 3 = 0 THEN 'first' WHEN o_orderkey % 2 = 1 THEN 'old' END AS previous_file, CASE WHEN o_orderkey % 4 <> 0 THEN 'v2' END AS source_version FROM orders""")
def provenance_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: orders bound to their files anew; some have no new file, some keep it, some were moved before."""
    o = X.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "a").otherwise("old").alias("source_file"), F.when(F.col("o_orderkey") % 3 == 0, "first").alias("previous_file"))
    name = F.when(F.col("o_orderkey") % 2 == 1, "new").otherwise("old")
    sources = o.where("o_orderkey % 4 <> 0").select("o_orderkey", name.alias("file"), F.sha2(name, 256).alias("sha256"))
    return V.rebind_provenance(o, sources, "o_orderkey", "v2")


@register("k06_venue_evidence", """WITH e AS (SELECT l_orderkey // 40 AS run, l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS n FROM lineitem)
SELECT run, count(*) AS events, concat_ws(',', CASE WHEN bool_or(l_orderkey % 200 = 3 AND n = 2) THEN 'DUPLICATE_ID' END, CASE WHEN bool_or(l_orderkey % 240 = 6 AND n = 2) THEN 'RECEIVE_TIME_BACK' END, CASE WHEN bool_or(l_orderkey % 300 = 1) THEN 'VENUE_TIME_MISSING' END, CASE WHEN bool_or(l_orderkey % 320 = 2) THEN 'ID_MISSING' END, CASE WHEN bool_or(l_orderkey % 280 = 5 AND n = 1) THEN 'ACCOUNTING_MISMATCH' END) AS reasons FROM e GROUP BY 1""")
def venue_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order events of runs of forty orders, damaged in five ways."""
    li = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    li = files.dealt(li, li.count(), "l_orderkey")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice")
    li = li.withColumn("n", F.row_number().over(by)).withColumn("total", F.sum("l_quantity").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    key, n, total = F.col("l_orderkey"), F.col("n"), F.col("total")
    events = li.select(
        F.floor(key / 40).alias("run"), key.alias("order"), n.alias("seq"), F.when(key % 320 != 2, F.concat_ws("-", key, F.when((key % 200 == 3) & (n == 2), 1).otherwise(n))).alias("event_id"), F.when(key % 300 != 1, n * 1000).alias("venue_ts_ms"),
        F.when((key % 240 == 6) & (n == 2), 1).otherwise(n * 1000).alias("receive_ms"), F.col("l_quantity").alias("quantity"), (total + F.when((key % 280 == 5) & (n == 1), 1.0).otherwise(0.0)).alias("cumulative"),
    )
    return V.venue_evidence(events, "run", "order").withColumn("reasons", F.array_join("reasons", ","))


@register("k09_order_screen", """WITH d AS (SELECT o_orderkey, o_custkey, o_totalprice, datediff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000 AS now_ms, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gross FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 50 = 0 THEN 'KILL_SWITCH' END, CASE WHEN o_orderkey % 11 = 0 THEN 'FUTURE_DATA' END, CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0 THEN 'STALE_DATA' END, CASE WHEN o_totalprice > 300000 THEN 'NOTIONAL' END,
 CASE WHEN o_totalprice > 250000 + o_custkey THEN 'CASH' END, CASE WHEN o_orderkey % 100 > 90 THEN 'POSITION' END, CASE WHEN gross + o_totalprice > 1500000 THEN 'MARKET_EXPOSURE' END, CASE WHEN gross + o_totalprice > 2500000 THEN 'GROSS_EXPOSURE' END, CASE WHEN o_orderkey % 17 > 15 THEN 'DAILY_LOSS' END) AS reasons FROM d""")
def order_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why limits refuse an order, given the customer's exposure before it."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    key = F.col("o_orderkey")
    now = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    gross = F.coalesce(F.sum("o_totalprice").over(before), F.lit(0.0))
    o = X.table(spark, sf_dir, "orders").select(
        key, "o_custkey", now.alias("now_ms"), (now + F.when(key % 11 == 0, 5).when(key % 13 == 0, -90000).otherwise(-10)).alias("data_ms"), F.col("o_totalprice").alias("notional"), (250000.0 + F.col("o_custkey")).alias("cash"),
        (key % 100).alias("position"), gross.alias("market_exposure"), gross.alias("gross_exposure"), (key % 17).alias("day_loss"),
    )
    limits = {"stale_ms": 60000, "notional": 300000, "position": 90, "market": 1500000, "gross": 2500000, "day_loss": 15}
    return V.order_screen(o, limits, F.col("o_custkey") % 50 == 0).select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))
