"""Registered queries of the event-market operators over the given tables, each with an independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import coverage, dedupe, evaluation, features, grid, ledger, logs, stats
from tallyspark.operators import temporal_joins as joins
from tallyspark.operators.matching import nearest_earlier
from tallyspark.sources import fixtures as X
from tallyspark.sources.fixtures import GAP, HORIZON, HOUR, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query, and its SQL if it has any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r6(*names: str) -> dict:
    """Columns rounded to six digits, to compare with SQL."""
    return {n: F.round(n, 6) for n in names}


FILLS = with_sql("ev", "fills")
EPISODES = f"""{FILLS},
buys AS (SELECT * FROM fills WHERE side = 'BUY' AND timestamp_ms > 0 AND size > 0 AND price BETWEEN 0 AND 1 AND condition_id IS NOT NULL),
marked AS (SELECT *, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER w <= {GAP} THEN 0 ELSE 1 END AS new FROM buys WINDOW w AS (PARTITION BY condition_id, outcome ORDER BY timestamp_ms, fill_id)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY condition_id, outcome ORDER BY timestamp_ms, fill_id ROWS UNBOUNDED PRECEDING) AS episode FROM marked),
eps AS (SELECT condition_id, outcome, episode, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, sum(size) AS shares, sum(size * price) AS dollars, count(*) AS fills FROM numbered GROUP BY ALL),
firsts AS (SELECT condition_id, outcome, min(timestamp_ms) AS t FROM buys GROUP BY ALL),
init AS (SELECT condition_id, arg_min(outcome, (t, outcome)) AS initial, min(t) AS first_ms, count(*) AS outcomes, count(*) > 1 AND min(t) = max(t) AS ambiguous FROM firsts GROUP BY 1),
opp AS (SELECT condition_id, outcome AS opposite, start_ms AS opposite_start_ms, end_ms AS t0_ms, shares AS opposite_shares
        FROM (SELECT e.*, row_number() OVER (PARTITION BY e.condition_id ORDER BY start_ms, e.outcome) AS rn FROM eps e JOIN init USING (condition_id) WHERE e.outcome <> initial) WHERE rn = 1)"""


def label_sql(start: int, width: int, name: str = "lab") -> str:
    return f"""{name} AS (SELECT o.*, h.hit_ms, (h.hit_ms IS NOT NULL)::INT AS label FROM opp o LEFT JOIN (SELECT o.condition_id, min(b.timestamp_ms) AS hit_ms FROM opp o JOIN buys b ON b.condition_id = o.condition_id
  AND b.outcome = o.opposite AND b.timestamp_ms > t0_ms + {start} AND b.timestamp_ms <= t0_ms + {start} + {width} GROUP BY 1) h USING (condition_id))"""


WILSON_SQL = """greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0) AS low,
 least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1) AS high"""
MARKETS = "markets AS (SELECT DISTINCT condition_id, market_start_ms, market_end_ms FROM fills)"


def _opposites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = X.fills(spark, sf_dir)
    return f, ledger.first_opposite(ledger.episodes(f, GAP), ledger.initial_direction(f))


@register("e05_weekly_label_rate", f"""{EPISODES}, {label_sql(0, HORIZON)},
rows AS (SELECT l.*, strftime(make_timestamp(m.market_start_ms * 1000), '%G-W%V') AS iso_week, m.market_end_ms >= t0_ms + {HORIZON} AS eligible FROM lab l JOIN (SELECT DISTINCT condition_id, market_start_ms, market_end_ms FROM fills) m USING (condition_id)),
g AS (SELECT iso_week, count(*) AS markets, count(*) FILTER (eligible) AS n, coalesce(sum(label) FILTER (eligible), 0) AS positives FROM rows GROUP BY 1),
q AS (SELECT *, positives / nullif(n, 0)::DOUBLE AS p, 1.959963984540054 AS z FROM g)
SELECT iso_week, markets, n, positives, round(p, 6) AS rate, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT *, {WILSON_SQL} FROM q)""")  # fmt: skip
def weekly_label_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of the forward-window label per ISO week with its Wilson interval."""
    f, opposite = _opposites(spark, sf_dir)
    markets = f.select("condition_id", "market_start_ms", "market_end_ms").distinct()
    rows = ledger.forward_label(f, opposite, HORIZON).join(markets, "condition_id")
    rows = rows.withColumn("iso_week", S.calendar_keys(F.col("market_start_ms"))["iso_week"]).withColumn("eligible", F.col("market_end_ms") >= F.col("t0_ms") + HORIZON)
    g = rows.groupBy("iso_week").agg(F.count("*").alias("markets"), F.count_if("eligible").alias("n"), F.coalesce(F.sum(F.when(F.col("eligible"), F.col("label"))), F.lit(0)).alias("positives"))
    low, high = S.wilson(F.col("positives"), F.col("n"))
    return g.select("iso_week", "markets", "n", "positives", F.round(F.col("positives") / F.nullif("n", F.lit(0)), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("e01_episodes", f"{EPISODES} SELECT condition_id, outcome, episode::BIGINT AS episode, start_ms, end_ms, round(shares, 6) AS shares, round(dollars, 6) AS dollars, round(dollars / nullif(shares, 0), 6) AS vwap, fills FROM eps")
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap sessionisation of BUY fills."""
    return ledger.episodes(X.fills(spark, sf_dir), GAP).drop("fill_ids").withColumns(r6("shares", "dollars", "vwap"))


@register("e02_initial_direction", f"{EPISODES.replace('ms AS timestamp_ms,', f'ms // {24 * HOUR} * {24 * HOUR} AS timestamp_ms,', 1)} SELECT condition_id, initial, first_ms, outcomes, ambiguous FROM init")
def initial_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial direction with ties, on times floored to the day."""
    return ledger.initial_direction(X.fills(spark, sf_dir, 24 * HOUR))


@register("e03_first_opposite", f"{EPISODES} SELECT condition_id, opposite, opposite_start_ms, t0_ms, round(opposite_shares, 6) AS opposite_shares FROM opp")
def first_opposite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First opposite episode."""
    return _opposites(spark, sf_dir)[1].withColumns(r6("opposite_shares"))


@register("e04_quantity_before", f"{EPISODES} SELECT b.condition_id, b.outcome, round(sum(size), 6) AS quantity FROM buys b LEFT JOIN opp o USING (condition_id) WHERE o.opposite_start_ms IS NULL OR b.timestamp_ms < o.opposite_start_ms GROUP BY ALL")
def quantity_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUY size before the first opposite episode."""
    return ledger.quantity_before(*_opposites(spark, sf_dir)).withColumns(r6("quantity"))


@register("e07_event_ledger", f"""{EPISODES}, {label_sql(0, HORIZON)}, {MARKETS},
per AS (SELECT condition_id, count(*) FILTER (side = 'BUY') AS buys, count(*) AS fills, count(*) FILTER (side = 'BUY' AND (size <= 0 OR price NOT BETWEEN 0 AND 1)) AS bad,
        min(timestamp_ms) FILTER (side = 'BUY') AS low_ms, max(timestamp_ms) FILTER (side = 'BUY') AS high_ms FROM fills GROUP BY 1),
j AS (SELECT p.*, m.market_start_ms, m.market_end_ms, i.initial, i.first_ms, i.ambiguous, l.opposite, l.opposite_start_ms, l.t0_ms, l.label,
      CASE WHEN p.buys = 0 THEN 0 WHEN p.bad > 0 THEN 2 WHEN i.ambiguous THEN 4 WHEN p.low_ms < m.market_start_ms OR p.high_ms > m.market_end_ms THEN 6 ELSE 7 END AS stage
      FROM per p LEFT JOIN markets m USING (condition_id) LEFT JOIN init i USING (condition_id) LEFT JOIN lab l USING (condition_id))
SELECT condition_id, fills, buys, CASE WHEN stage > 4 THEN initial END AS initial, CASE WHEN stage > 4 THEN first_ms END AS first_ms, CASE WHEN stage > 6 THEN opposite END AS opposite,
 CASE WHEN stage > 6 THEN opposite_start_ms END AS opposite_start_ms, CASE WHEN stage > 6 THEN t0_ms END AS t0_ms, CASE WHEN stage > 6 THEN label END AS label,
 CASE WHEN stage > 6 THEN coalesce(market_end_ms >= t0_ms + {HORIZON}, false) END AS horizon_eligible, stage = 7 AS clean,
 CASE stage WHEN 0 THEN 'NO_BUY' WHEN 2 THEN 'FIELD_INCOMPLETE' WHEN 4 THEN 'SAME_SECOND_DIRECTION_AMBIGUITY' WHEN 6 THEN 'TIME_INCONSISTENT' END AS exclude_reason FROM j""")  # fmt: skip
def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per market, with the reason if it is excluded."""
    f = X.fills(spark, sf_dir)
    return ledger.event_ledger(f, f.select("condition_id", "market_start_ms", "market_end_ms").distinct(), GAP, HORIZON, 0)


@register("e10_window_placebo", f"""{EPISODES}, {label_sql(0, HORIZON, "w0")}, {label_sql(HORIZON, HORIZON, "w1")}, {label_sql(2 * HORIZON, HORIZON, "w2")},
a AS (SELECT 0 AS w, * FROM w0 UNION ALL SELECT 1, * FROM w1 UNION ALL SELECT 2, * FROM w2), {MARKETS}
SELECT w AS window_no, count(*) AS markets, count(*) FILTER (m.market_end_ms >= t0_ms + (w + 1) * {HORIZON}) AS eligible, coalesce(sum(label) FILTER (m.market_end_ms >= t0_ms + (w + 1) * {HORIZON}), 0)::BIGINT AS positives FROM a JOIN markets m USING (condition_id) GROUP BY 1""")  # fmt: skip
def window_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label in three neighbouring windows."""
    f, opposite = _opposites(spark, sf_dir)
    ends = f.select("condition_id", "market_end_ms").distinct()
    out = None
    for w in range(3):
        part = ledger.forward_label(f, opposite, HORIZON, w * HORIZON).withColumn("window_no", F.lit(w)).withColumn("need_ms", F.col("t0_ms") + (w + 1) * HORIZON)
        out = part if out is None else out.unionByName(part)
    ok = F.col("market_end_ms") >= F.col("need_ms")
    return out.join(ends, "condition_id").groupBy("window_no").agg(F.count("*").alias("markets"), F.count_if(ok).alias("eligible"), F.coalesce(F.sum(F.when(ok, F.col("label"))), F.lit(0)).alias("positives"))


_INTERVALS = """{w}, moves AS (SELECT session_id, event, timestamp_ms AS start_ms, lead(timestamp_ms) OVER (PARTITION BY session_id ORDER BY timestamp_ms, seq) AS next_ms FROM sessions WHERE event IN ({names})),
ends AS (SELECT session_id, max(timestamp_ms) AS last_ms FROM sessions GROUP BY 1), iv AS (SELECT session_id, start_ms, {end} AS end_ms FROM moves JOIN ends USING (session_id) WHERE event = 'connected')"""
INTERVALS = _INTERVALS.format(w=with_sql("ev", "sessions"), names="'connected', 'disconnected', 'session_end', 'connection_error'", end="coalesce(next_ms, last_ms)")
OPEN_INTERVALS = _INTERVALS.format(w=with_sql("ev", "sessions"), names="'connected', 'disconnected', 'session_end'", end="next_ms")


@register("e12_connection_intervals", f"{INTERVALS} SELECT * FROM iv")
def connection_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection intervals, errors close them."""
    return ledger.connection_intervals(X.sessions(spark, sf_dir))


@register("e12_open_intervals", f"{OPEN_INTERVALS} SELECT * FROM iv")
def open_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12, other version: errors do not close, open intervals have no end."""
    return ledger.connection_intervals(X.sessions(spark, sf_dir), error_closes=False)


@register("e14_running_inventory", f"""{FILLS}, s AS (SELECT *, CASE WHEN side = 'BUY' THEN size ELSE -size END AS q FROM fills),
r AS (SELECT condition_id, fill_id, sum(CASE WHEN outcome = 'Up' THEN q ELSE 0 END) OVER w AS up, sum(CASE WHEN outcome = 'Down' THEN q ELSE 0 END) OVER w AS down FROM s WINDOW w AS (PARTITION BY condition_id ORDER BY timestamp_ms, fill_id ROWS UNBOUNDED PRECEDING))
SELECT condition_id, fill_id, round(up, 6) AS up, round(down, 6) AS down, round(up - down, 6) AS net, round(greatest(least(up, down), 0), 6) AS pairable FROM r""")  # fmt: skip
def running_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running inventory."""
    return ledger.running_inventory(X.fills(spark, sf_dir)).withColumns(r6("up", "down", "net", "pairable"))


@register("e15_pair_economics", f"""{EPISODES}, a AS (SELECT condition_id, sum(CASE WHEN outcome = 'Up' THEN size ELSE 0 END) AS u, sum(CASE WHEN outcome = 'Down' THEN size ELSE 0 END) AS d, sum(CASE WHEN outcome = 'Up' THEN size * price ELSE 0 END) AS uu, sum(CASE WHEN outcome = 'Down' THEN size * price ELSE 0 END) AS dd FROM buys GROUP BY 1)
SELECT condition_id, round(u, 6) AS up_qty, round(d, 6) AS down_qty, round(uu / nullif(u, 0), 6) AS up_vwap, round(dd / nullif(d, 0), 6) AS down_vwap, round(least(u, d), 6) AS pairable, round(uu / nullif(u, 0) + dd / nullif(d, 0), 6) AS pair_cost, round(1 - uu / nullif(u, 0) - dd / nullif(d, 0), 6) AS edge FROM a""")  # fmt: skip
def pair_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair economics."""
    return ledger.pair_economics(X.fills(spark, sf_dir)).withColumns(r6("up_qty", "down_qty", "up_vwap", "down_vwap", "pairable", "pair_cost", "edge"))


@register("e16_refractory_anchors", f"""{with_sql("ev").replace("WITH", "WITH RECURSIVE", 1)},
a AS (SELECT user_id, min(ms) AS ms FROM ev GROUP BY 1 UNION ALL SELECT a.user_id, (SELECT min(e.ms) FROM ev e WHERE e.user_id = a.user_id AND e.ms >= a.ms + {6 * HOUR}) FROM a WHERE a.ms IS NOT NULL)
SELECT user_id, ms FROM a WHERE ms IS NOT NULL""")  # fmt: skip
def refractory_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy anchors with a rest of six hours."""
    return ledger.refractory_anchors(X.events(spark, sf_dir), "user_id", "ms", 6 * HOUR)


@register("c01_first_by_identity", f"{FILLS}, r AS (SELECT condition_id, outcome, fill_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY condition_id, outcome) AS occurrences FROM fills WINDOW w AS (PARTITION BY condition_id, outcome ORDER BY timestamp_ms, fill_id)) SELECT condition_id, outcome, fill_id, occurrences FROM r WHERE rn = 1")
def first_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fill of each market and outcome."""
    return dedupe.first_by_identity(X.fills(spark, sf_dir), ["condition_id", "outcome"], ["timestamp_ms", "fill_id"]).select("condition_id", "outcome", "fill_id", "occurrences")


@register("c02_new_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose key the orders do not know."""
    known = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return dedupe.new_keys(X.table(spark, sf_dir, "customer").select("c_custkey"), known, "c_custkey")


@register("c03_page_collisions", "SELECT event_id // 100 AS page, user_id, count(*) AS occurrences, min(event_id) AS first, count(*) - 1 AS excess FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def page_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen several times in a page of 100 events."""
    e = X.table(spark, sf_dir, "events").withColumn("page", F.floor(F.col("event_id") / 100))
    return dedupe.page_collisions(e, "page", "user_id", "event_id")


@register("c04_set_differences", "SELECT DISTINCT p_partkey AS k, 'left_only' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) UNION ALL SELECT DISTINCT l_partkey, 'right_only' FROM lineitem WHERE l_quantity > 40 AND l_partkey NOT IN (SELECT p_partkey FROM part)")
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without large lines, and the reverse."""
    lines = X.table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("k"))
    return dedupe.set_differences(X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), lines, "k")


@register("c05_multiset_label", "WITH t AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'view') SELECT event_id, user_id, CASE WHEN rn <= coalesce(n, 0) THEN 'TAKER' ELSE 'MAKER_INFERRED' END AS role FROM r LEFT JOIN t USING (user_id)")
def multiset_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many views of a user as there are purchases count as takers."""
    e = X.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return dedupe.multiset_label(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'purchase'"), ["user_id"], "event_id").select("event_id", "user_id", "role")


_LATER = "later AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 11 <> 0 UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey FROM supplier WHERE s_suppkey % 13 = 0)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = X.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    moved = s.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 7 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")))
    return s, moved.where("s_suppkey % 11 <> 0").unionByName(s.where("s_suppkey % 13 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000))


@register("c06_additive_merge", f"WITH {_LATER} SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.s_suppkey IS NULL THEN 'NEW' WHEN b.s_suppkey IS NULL THEN 'KEPT' WHEN (a.s_name, a.s_nationkey) IS NOT DISTINCT FROM (b.s_name, b.s_nationkey) THEN 'SAME' ELSE 'CONFLICT' END AS status FROM supplier a FULL JOIN later b ON a.s_suppkey = b.s_suppkey")
def additive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive merge with conflicts."""
    return dedupe.additive_merge(*_snapshots(spark, sf_dir), "s_suppkey", ["s_name", "s_nationkey"])


@register("c07_snapshot_invariance", f"WITH {_LATER} SELECT a.s_suppkey, CASE WHEN b.s_suppkey IS NULL THEN 'MISSING' ELSE 'CHANGED' END AS status, CASE WHEN b.s_suppkey IS NULL THEN '' ELSE 's_nationkey' END AS changed FROM supplier a LEFT JOIN later b ON a.s_suppkey = b.s_suppkey WHERE b.s_suppkey IS NULL OR a.s_nationkey <> b.s_nationkey")
def snapshot_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and changed rows of a snapshot."""
    return dedupe.snapshot_invariance(*_snapshots(spark, sf_dir), "s_suppkey", ["s_name", "s_nationkey"])


@register("c12_count_contract", "SELECT rows, count(*) AS keys FROM (SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1) GROUP BY 1")
def count_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of lines per order."""
    return dedupe.count_contract(X.table(spark, sf_dir, "lineitem"), "l_orderkey")


@register("c13_id_conflicts", "SELECT l_orderkey, count(*) AS n, count(DISTINCT (l_returnflag, l_linestatus)) AS payloads, CASE WHEN count(DISTINCT (l_returnflag, l_linestatus)) > 1 THEN 'CONFLICT' ELSE 'DUPLICATE' END AS kind FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def id_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines repeat or differ in their flags."""
    return dedupe.id_conflicts(X.table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


@register("i23_multiset_differences", f"WITH {_LATER}, a AS (SELECT s_suppkey, s_nationkey FROM supplier), b AS (SELECT s_suppkey, s_nationkey FROM later) SELECT *, 'left_only' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right_only' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def multiset_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two snapshots that differ."""
    a, b = _snapshots(spark, sf_dir)
    return dedupe.multiset_differences(a.drop("s_name"), b.drop("s_name"))


TB = with_sql("ev", "ticks", "book")


def _asof(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = X.events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", F.col("user_id").cast("string").alias("condition_id"), "ms")
    return left, X.book(spark, sf_dir).withColumnRenamed("receive_ms", "ms")


@register("j01_asof_backward", f"{TB} SELECT l.event_id, r.mid, l.ms - r.receive_ms AS age_ms FROM (SELECT event_id, user_id::VARCHAR AS condition_id, ms FROM ev WHERE event_type = 'purchase') l LEFT JOIN LATERAL (SELECT mid, receive_ms FROM book b WHERE b.condition_id = l.condition_id AND b.receive_ms <= l.ms ORDER BY receive_ms DESC, seq DESC LIMIT 1) r ON true")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last book row at or before each purchase."""
    left, right = _asof(spark, sf_dir)
    return joins.asof_backward(left, right, "condition_id", "ms", ["mid"], ["seq"]).select("event_id", "mid", "age_ms")


@register("j02_asof_stale", f"{TB} SELECT l.event_id, CASE WHEN l.ms - r.receive_ms <= {HOUR} THEN r.mid END AS mid, l.ms - r.receive_ms AS age_ms FROM (SELECT event_id, user_id::VARCHAR AS condition_id, ms FROM ev WHERE event_type = 'purchase') l LEFT JOIN LATERAL (SELECT mid, receive_ms FROM book b WHERE b.condition_id = l.condition_id AND b.receive_ms <= l.ms ORDER BY receive_ms DESC, seq DESC LIMIT 1) r ON true")
def asof_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As J01 with a bound on age."""
    left, right = _asof(spark, sf_dir)
    return joins.asof_backward(left, right, "condition_id", "ms", ["mid"], ["seq"], HOUR).select("event_id", "mid", "age_ms")


@register("j04_at_targets", f"{TB}, t AS (SELECT event_id, user_id::VARCHAR AS condition_id, ms, lag_ms FROM ev, (VALUES (0), ({HOUR}), ({5 * HOUR})) v(lag_ms) WHERE event_type = 'purchase') SELECT t.event_id, t.lag_ms::BIGINT AS lag_ms, CASE WHEN t.ms - t.lag_ms - r.receive_ms <= {12 * HOUR} THEN r.mid END AS mid FROM t LEFT JOIN LATERAL (SELECT mid, receive_ms FROM book b WHERE b.condition_id = t.condition_id AND b.receive_ms <= t.ms - t.lag_ms ORDER BY receive_ms DESC, seq DESC LIMIT 1) r ON true")
def at_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book values at several times before each purchase."""
    left, right = _asof(spark, sf_dir)
    return joins.at_targets(left, right, "condition_id", "ms", "mid", [0, HOUR, 5 * HOUR], "seq", 12 * HOUR).select("event_id", "lag_ms", "mid")


@register("j05_asof_forward", f"{TB} SELECT l.event_id, r.receive_ms AS found_ms FROM (SELECT event_id, user_id::VARCHAR AS condition_id, ms FROM ev WHERE event_type = 'purchase') l LEFT JOIN LATERAL (SELECT min(receive_ms) AS receive_ms FROM book b WHERE b.condition_id = l.condition_id AND b.receive_ms >= l.ms + {HOUR}) r ON true")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first book row an hour or more after each purchase."""
    left, right = _asof(spark, sf_dir)
    return joins.asof_forward(left, right, "condition_id", "ms", ["mid"], HOUR).select("event_id", "found_ms")


@register("j07_interval_matches", f"""{INTERVALS.replace("ev AS", "w AS (SELECT d AS window_id, d * 86400000 AS start_ms, d * 86400000 + 3600000 AS end_ms FROM (SELECT DISTINCT epoch_us(ts) // 86400000000 AS d FROM events)), ev AS", 1)}
SELECT w.window_id, count(DISTINCT iv.session_id) AS matches, CASE count(DISTINCT iv.session_id) WHEN 0 THEN 'MISSING' WHEN 1 THEN 'ELIGIBLE' ELSE 'AMBIGUOUS' END AS match
FROM w LEFT JOIN iv ON iv.start_ms <= w.end_ms AND iv.end_ms >= w.start_ms GROUP BY 1""")  # fmt: skip
def interval_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose connection meets the first hour of each day."""
    days = X.events(spark, sf_dir).select(F.floor(F.col("ms") / (24 * HOUR)).alias("window_id")).distinct()
    windows = days.select("window_id", (F.col("window_id") * 24 * HOUR).alias("start_ms"), (F.col("window_id") * 24 * HOUR + HOUR).alias("end_ms"))
    iv = ledger.connection_intervals(X.sessions(spark, sf_dir)).select(F.col("session_id").alias("owner"), F.col("start_ms").alias("lo_ms"), F.col("end_ms").alias("hi_ms"))
    return joins.interval_matches(windows, iv, "window_id", 24 * HOUR)


_FOUR = "value, k, ms % 3600000 / 60000.0::DOUBLE AS minute, (604800000 - ms % 604800000) / 3600000.0::DOUBLE AS hours_left"


@register("j11_matched_controls", f"""{with_sql("ev")}, x AS (SELECT event_id, user_id, event_type, ms, {_FOUR} FROM ev),
c AS (SELECT a.event_id AS "case", b.event_id AS control, round(abs(a.value - b.value) + abs(a.k - b.k) + abs(a.minute - b.minute) + abs(a.hours_left - b.hours_left), 9) AS distance FROM x a JOIN x b ON a.user_id = b.user_id AND b.ms < a.ms WHERE a.event_type = 'purchase' AND b.event_type = 'view'),
r AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY distance, control) AS rank FROM c) SELECT * FROM r WHERE rank <= 5""")  # fmt: skip
def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all earlier views of the user the five that are nearest to each purchase by four features."""
    e = X.events(spark, sf_dir).withColumn("minute", F.col("ms") % 3600000 / 60000).withColumn("hours_left", (604800000 - F.col("ms") % 604800000) / 3600000)
    return nearest_earlier(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", "ms", ["value", "k", "minute", "hours_left"], "event_id", "event_id", 5)


DAYS = f"days AS (SELECT DISTINCT user_id::VARCHAR AS condition_id, ms // {168 * HOUR} * {168 * HOUR} AS start_ms, ms // {168 * HOUR} * {168 * HOUR} + {168 * HOUR} AS end_ms FROM ev)"


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed's weeks with an event."""
    start = (F.floor(F.col("ms") / (168 * HOUR)) * (168 * HOUR)).cast("long")
    return X.events(spark, sf_dir).select(F.col("user_id").cast("string").alias("condition_id"), start.alias("start_ms"), (start + 168 * HOUR).alias("end_ms")).distinct()


@register("f01_bucket_coverage", f"""{with_sql("ev", "ticks")}, {DAYS} SELECT condition_id, start_ms, 28::BIGINT AS buckets, count(DISTINCT least((exchange_ms - start_ms) // {6 * HOUR}, 27)) FILTER (exchange_ms BETWEEN start_ms AND end_ms) AS filled, round(count(DISTINCT least((exchange_ms - start_ms) // {6 * HOUR}, 27)) FILTER (exchange_ms BETWEEN start_ms AND end_ms) / 28, 6) AS coverage
FROM days LEFT JOIN ticks USING (condition_id) GROUP BY 1, 2""")  # fmt: skip
def bucket_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """six-hour buckets of every week with a tick."""
    return coverage.bucket_coverage(_weeks(spark, sf_dir), X.ticks(spark, sf_dir), "condition_id", "exchange_ms", 6 * HOUR).withColumns(r6("coverage"))


@register("f03_state_coverage", f"""{with_sql("ev", "ticks")}, {DAYS},
p AS (SELECT condition_id, exchange_ms AS lo, exchange_ms + {8 * HOUR} AS hi FROM ticks),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY condition_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM p),
i AS (SELECT condition_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY condition_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY condition_id, g),
b AS (SELECT condition_id, start_ms, start_ms + n * {2 * HOUR} AS a, start_ms + (n + 1) * {2 * HOUR} AS z FROM days, range(84) t(n))
SELECT b.condition_id, b.start_ms, 84::BIGINT AS buckets, count(i.lo) AS whole, round(count(i.lo) / 84, 6) AS coverage FROM b LEFT JOIN i ON i.condition_id = b.condition_id AND i.lo <= b.a AND i.hi >= b.z GROUP BY 1, 2""")  # fmt: skip
def state_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two-hour buckets wholly inside the merged times of ticks that hold for eight hours."""
    return coverage.state_coverage(_weeks(spark, sf_dir), X.ticks(spark, sf_dir), "condition_id", "exchange_ms", 8 * HOUR, 2 * HOUR).withColumns(r6("coverage"))


@register("f04_gaps", f"""{with_sql("ev", "ticks")}, {DAYS}, p AS (SELECT condition_id, start_ms, exchange_ms AS t FROM ticks JOIN days USING (condition_id) WHERE exchange_ms BETWEEN start_ms AND end_ms UNION ALL SELECT condition_id, start_ms, start_ms FROM days UNION ALL SELECT condition_id, start_ms, end_ms FROM days),
l AS (SELECT condition_id, start_ms, t AS from_ms, lead(t) OVER (PARTITION BY condition_id, start_ms ORDER BY t) AS to_ms FROM p) SELECT * FROM l WHERE to_ms - from_ms > {24 * HOUR}""")  # fmt: skip
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gaps above a day in every week."""
    return coverage.gaps(_weeks(spark, sf_dir), X.ticks(spark, sf_dir), "condition_id", "exchange_ms", 24 * HOUR)


@register("f07_coverage_gate", f"""{with_sql("ev", "ticks")}, {DAYS}, c AS (SELECT condition_id, start_ms, count(DISTINCT least((exchange_ms - start_ms) // {6 * HOUR}, 27)) FILTER (exchange_ms BETWEEN start_ms AND end_ms) AS filled FROM days LEFT JOIN ticks USING (condition_id) GROUP BY 1, 2)
SELECT condition_id, start_ms, CASE WHEN filled / 28 < 0.3 THEN 'tick_below' ELSE '' END AS reasons, filled >= 0.3::DECIMAL(18, 6) * 28 AS passes FROM c""")  # fmt: skip
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coverage gates, by doubles and by decimals."""
    c = coverage.bucket_coverage(_weeks(spark, sf_dir), X.ticks(spark, sf_dir), "condition_id", "exchange_ms", 6 * HOUR)
    return c.select("condition_id", "start_ms", coverage.coverage_gate({"tick": F.col("coverage")}, 0.3).alias("reasons"), coverage.exact_gate(F.col("filled"), F.col("buckets"), "0.3").alias("passes"))


@register("f10_percentile_summary", "WITH s AS (SELECT (l_quantity / 50)::DOUBLE AS c FROM lineitem) SELECT count(c) AS n, min(c) AS least, max(c) AS most, round(quantile_cont(c, 0.01), 6) AS p010, round(quantile_cont(c, 0.5), 6) AS p500, round(quantile_cont(c, 0.95), 6) AS p950, round(avg((c >= 0.99)::INT), 6) AS share_99, round(avg((c >= 0.999)::INT), 6) AS share_999 FROM s")
def percentile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """percentile summary of a coverage-like share."""
    rows = X.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("c"))
    return coverage.percentile_summary(rows, "c", [0.01, 0.5, 0.95]).withColumns(r6("p010", "p500", "p950", "share_99", "share_999"))


CUTS = "cuts AS (SELECT event_id, user_id::VARCHAR AS condition_id, ms - 1 AS cut_ms FROM ev WHERE event_type = 'purchase')"


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", F.col("user_id").cast("string").alias("condition_id"), (F.col("ms") - 1).alias("cut_ms"))


@register("g03_volume_flow", f"""{with_sql("ev", "ticks")}, {CUTS}, w AS (SELECT unnest([{6 * HOUR}, {24 * HOUR}])::BIGINT AS window_ms)
SELECT event_id, window_ms, count(*) AS n, round(sum(size), 6) AS volume, round(sum(CASE WHEN buyer_is_maker THEN -size ELSE size END), 6) AS flow FROM cuts JOIN ticks USING (condition_id), w WHERE exchange_ms <= cut_ms AND exchange_ms > cut_ms - window_ms GROUP BY ALL""")  # fmt: skip
def volume_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, volume and signed flow in windows before each purchase."""
    return features.volume_flow(_cuts(spark, sf_dir), X.ticks(spark, sf_dir), "condition_id", "event_id", "cut_ms", "exchange_ms", [6 * HOUR, 24 * HOUR]).withColumns(r6("volume", "flow"))


@register("g02_realised_volatility", f"""{with_sql("ev", "ticks")}, {CUTS}, p AS (SELECT event_id, ln(price) - lag(ln(price)) OVER (PARTITION BY event_id ORDER BY exchange_ms, trade_id) AS r FROM cuts JOIN ticks USING (condition_id) WHERE exchange_ms <= cut_ms AND exchange_ms > cut_ms - {48 * HOUR})
SELECT event_id, round(sqrt(sum(r * r)), 6) AS volatility, count(r) AS returns FROM p GROUP BY 1""")  # fmt: skip
def realised_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised volatility of two days before each purchase."""
    return features.realised_volatility(_cuts(spark, sf_dir), X.ticks(spark, sf_dir), "condition_id", "event_id", "cut_ms", "exchange_ms", "price", "trade_id", 48 * HOUR).withColumns(r6("volatility"))


@register("g13_point_in_time", f"""{with_sql("ev")}, g AS (SELECT unnest([0, 20, 60])::BIGINT AS gap_ms) SELECT gap_ms, 'NOT_BEFORE_CUTOFF' AS reason, count(*) AS n FROM ev, g WHERE ms >= ms + k - gap_ms GROUP BY 1""")
def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are not before a cutoff less a gap."""
    return features.point_in_time_failures(X.events(spark, sf_dir).withColumn("cut_ms", F.col("ms") + F.col("k")), "ms", "cut_ms", [0, 20, 60])


@register("g14_order_violations", f"""{with_sql("ev", "ticks")}, l AS (SELECT condition_id, trade_id, lag(receive_ms) OVER (PARTITION BY condition_id ORDER BY trade_id) AS before_ms, receive_ms FROM ticks) SELECT * FROM l WHERE receive_ms < before_ms""")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receive times that go back in the order of trades."""
    return features.order_violations(X.ticks(spark, sf_dir), "condition_id", "trade_id", "receive_ms")


@register("g15_sanity", "SELECT o_orderkey AS row, 'o_totalprice' AS field, o_totalprice AS value FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 400000 UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::DOUBLE FROM orders WHERE o_custkey < 10")
def sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside their domain."""
    return features.sanity_violations(X.table(spark, sf_dir, "orders"), "o_orderkey", {"o_totalprice": (1000, 400000), "o_custkey": (10, None)})


@register("g19_missingness", """SELECT 'quality' AS field, count(*) AS n, count(*) - count(l.quality) AS missing, round(avg((l.quality IS NULL)::INT), 6) AS rate FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'lang', count(*), count(*) - count(d.lang), round(avg((d.lang IS NULL)::INT), 6) FROM documents d LEFT JOIN labels l USING (doc_id)""")  # fmt: skip
def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing labels and languages."""
    rows = X.table(spark, sf_dir, "documents").select("doc_id", "lang").join(X.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return features.missingness(rows, ["quality", "lang"]).withColumns(r6("rate"))
