"""Registered queries of audits: selection, drift, domains, eligibility, gates and latency, with SQL twins written from their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.scalars import calendar_keys
from tallyspark.operators import audits as A
from tallyspark.operators import ledger
from tallyspark.plans.queries import EPISODES, label_sql, r6, register
from tallyspark.sources import fixtures as X
from tallyspark.sources.fixtures import GAP, HORIZON, HOUR, WEEK, with_sql

DAY = 24 * HOUR
BEFORE = ["initial_qty", "market_start_h", "market_end_h", "initial_first_h", "start_to_initial_h", "remaining_at_initial_h"]
WHOLE = ["n_buy_fills", "n_sell_fills", "total_buy_qty", "total_sell_qty", "total_fill_count"]
SIX = ["label", "initial_qty", "first_opp_qty", "initial_to_opp_h", "to_expiry_h", "regime"]


def _markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per market: what its fills say before and after the first opposite episode."""
    f = X.fills(spark, sf_dir)
    eps, init = ledger.episodes(f, GAP), ledger.initial_direction(f)
    opp = ledger.first_opposite(eps, init)
    lab = ledger.forward_label(f, opp, HORIZON).select("condition_id", "label")
    side = lambda s, c: F.sum(F.when(F.col("side") == s, c).otherwise(0.0))
    per = f.groupBy("condition_id").agg(
        F.count_if(F.col("side") == "BUY").alias("n_buy_fills"), F.count_if(F.col("side") == "SELL").alias("n_sell_fills"), side("BUY", F.col("size")).alias("total_buy_qty"), side("SELL", F.col("size")).alias("total_sell_qty"),
        F.count("*").alias("total_fill_count"), F.count_distinct(F.floor(F.col("timestamp_ms") / DAY)).alias("days"), F.min("market_start_ms").alias("_s"), F.min("market_end_ms").alias("_e"),
    )
    first = eps.join(init.select("condition_id", "initial"), "condition_id").where("outcome = initial").groupBy("condition_id").agg(F.min_by("shares", "start_ms").alias("initial_qty"))
    rows = per.join(init.select("condition_id", "first_ms"), "condition_id", "left").join(first, "condition_id", "left").join(opp.select("condition_id", "opposite_start_ms", "t0_ms", F.col("opposite_shares").alias("first_opp_qty")), "condition_id", "left").join(lab, "condition_id", "left")
    h = lambda c: c / HOUR
    return rows.withColumns({
        "market_start_h": h(F.col("_s")), "market_end_h": h(F.col("_e")), "initial_first_h": h(F.col("first_ms")), "start_to_initial_h": h(F.col("first_ms") - F.col("_s")), "remaining_at_initial_h": h(F.col("_e") - F.col("first_ms")),
        "initial_to_opp_h": h(F.col("opposite_start_ms") - F.col("first_ms")), "to_expiry_h": h(F.col("_e") - F.col("t0_ms")), "regime": F.floor(F.col("_s") / WEEK) % 3, "opposed": F.col("t0_ms").isNotNull(), "covered": F.col("days") >= 3,
    })


_MARKETS = f"""{EPISODES}, {label_sql(0, HORIZON)},
per AS (SELECT condition_id, count(*) FILTER (side = 'BUY') AS n_buy_fills, count(*) FILTER (side = 'SELL') AS n_sell_fills, coalesce(sum(size) FILTER (side = 'BUY'), 0) AS total_buy_qty, coalesce(sum(size) FILTER (side = 'SELL'), 0) AS total_sell_qty,
  count(*) AS total_fill_count, count(DISTINCT timestamp_ms // {DAY}) AS days, min(market_start_ms) AS s, min(market_end_ms) AS e FROM fills GROUP BY 1),
first AS (SELECT condition_id, arg_min(shares, start_ms) AS initial_qty FROM eps JOIN init USING (condition_id) WHERE outcome = initial GROUP BY 1),
m AS (SELECT per.*, initial_qty, s / {HOUR}.0::DOUBLE AS market_start_h, e / {HOUR}.0::DOUBLE AS market_end_h, first_ms / {HOUR}.0::DOUBLE AS initial_first_h, (first_ms - s) / {HOUR}.0::DOUBLE AS start_to_initial_h, (e - first_ms) / {HOUR}.0::DOUBLE AS remaining_at_initial_h,
  (opp.opposite_start_ms - first_ms) / {HOUR}.0::DOUBLE AS initial_to_opp_h, (e - opp.t0_ms) / {HOUR}.0::DOUBLE AS to_expiry_h, opp.opposite_shares AS first_opp_qty, s // {WEEK} % 3 AS regime, opp.t0_ms IS NOT NULL AS opposed, days >= 3 AS covered, lab.label
  FROM per LEFT JOIN init USING (condition_id) LEFT JOIN first USING (condition_id) LEFT JOIN opp USING (condition_id) LEFT JOIN lab USING (condition_id))"""


def _long(fields: list[str], flag: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS variable, {flag} AS g, {f}::DOUBLE AS v FROM m" for f in fields)


_SMD = "CASE WHEN n1 = 0 OR n0 = 0 THEN NULL WHEN v1 + v0 = 0 THEN CASE WHEN m1 = m0 THEN 0.0 END ELSE (m1 - m0) / sqrt((v1 + v0) / 2) END"
_NOTE = "CASE WHEN n1 = 0 OR n0 = 0 THEN 'EMPTY_GROUP' WHEN v1 + v0 = 0 THEN CASE WHEN m1 = m0 THEN 'IDENTICAL_CONSTANTS' ELSE 'DIFFERENT_CONSTANTS' END END"
_STATS = ", ".join(f"count(v) FILTER ({g}) AS n{i}, count(*) FILTER (({g}) AND v IS NULL) AS missing_{i}, avg(v) FILTER ({g}) AS m{i}, median(v) FILTER ({g}) AS median_{i}, coalesce(var_samp(v) FILTER ({g}), 0) AS v{i}, quantile_cont(v, 0.25) FILTER ({g}) AS p25_{i}, quantile_cont(v, 0.75) FILTER ({g}) AS p75_{i}" for i, g in ((1, "g"), (0, "NOT g")))


@register("i03_selection_bias", f"""{_MARKETS}, l AS ({_long(BEFORE + WHOLE, "opposed")}), a AS (SELECT variable, {_STATS} FROM l GROUP BY 1), s AS (SELECT *, {_SMD} AS smd, {_NOTE} AS note FROM a),
k AS (SELECT *, CASE WHEN smd IS NULL THEN 'undefined' WHEN abs(smd) < 0.1 THEN 'small' WHEN abs(smd) <= 0.2 THEN 'noticeable' ELSE 'material' END AS magnitude, variable IN ({", ".join(f"'{v}'" for v in BEFORE)}) AS pre FROM s)
SELECT variable, {", ".join(f"n{i} AS n_{i}, missing_{i}, round(m{i}, 4) AS mean_{i}, round(median_{i}, 4) AS median_{i}, CASE WHEN n{i} > 0 THEN round(sqrt(v{i}), 4) END AS std_{i}, round(p25_{i}, 4) AS p25_{i}, round(p75_{i}, 4) AS p75_{i}" for i in (1, 0))}, round(smd, 6) AS smd, note, magnitude, pre,
  (SELECT count(*) FROM k WHERE pre AND magnitude = 'material') AS material_pre, CASE WHEN (SELECT count(*) FROM k WHERE pre AND magnitude = 'material') >= 2 THEN 'WARN' ELSE 'PASS' END AS status FROM k""")  # fmt: skip
def selection_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets with an opposite episode against those without, by eleven variables."""
    out = A.selection_bias(_markets(spark, sf_dir), "opposed", BEFORE, WHOLE)
    return out.withColumns({f"{s}_{g}": F.round(f"{s}_{g}", 4) for s in ("mean", "median", "std", "p25", "p75") for g in "10"} | r6("smd"))


@register("f11_coverage_selection", f"""{_MARKETS.replace("LEFT JOIN opp", "JOIN opp").replace("LEFT JOIN lab", "JOIN lab")}, l AS ({_long(SIX, "covered")}), a AS (SELECT variable, {_STATS} FROM l GROUP BY 1),
r AS (SELECT avg(label) FILTER (covered) AS c, avg(label) FILTER (NOT covered) AS u FROM m)
SELECT variable, n1 AS covered_n, n0 AS uncovered_n, round({_SMD}, 6) AS smd, {_NOTE} AS note, round(c, 6) AS covered_rate, round(u, 6) AS uncovered_rate, round((c - u) * 100, 6) AS delta_pp,
  CASE WHEN c IS NULL THEN 'NOT_COMPARABLE_NO_COVERED' WHEN u IS NULL THEN 'NOT_COMPARABLE_NO_UNCOVERED' WHEN abs(c - u) * 100 >= 5 THEN 'COVERAGE_SELECTION_WARNING' ELSE 'REPORTED' END AS status FROM a, r""")  # fmt: skip
def coverage_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled markets with fills on three days or more against the others."""
    out = A.coverage_selection(_markets(spark, sf_dir).where("opposed"), "covered", "label", SIX)
    return out.withColumns(r6("smd", "covered_rate", "uncovered_rate", "delta_pp"))


_DRIFT = f"""{with_sql("ev")}, r AS (SELECT strftime(make_timestamp(ms * 1000), '%G-W%V') AS week, value::DOUBLE AS a, k::DOUBLE AS b, CASE WHEN k % 9 <> 0 THEN k * k END::DOUBLE AS c, 7.0::DOUBLE AS d FROM ev),
l AS (SELECT week, 'value' AS feature, a AS v FROM r UNION ALL SELECT week, 'k', b FROM r UNION ALL SELECT week, 'square', c FROM r UNION ALL SELECT week, 'constant', d FROM r),
p AS (SELECT feature, week, count(v) AS n, avg(v) AS mean, median(v) AS median, coalesce(stddev_samp(v), 0) AS std, var_pop(v) AS var, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, avg((v IS NULL)::INT) AS missing FROM l GROUP BY ALL),
f AS (SELECT min(week) AS week FROM l), e AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM l JOIN f USING (week) WHERE v IS NOT NULL GROUP BY 1),
b AS (SELECT l.feature, l.week, len(list_filter(edges[2:len(edges) - 1], lambda x: x <= v)) AS bin, count(*) AS k FROM l JOIN e USING (feature) WHERE v IS NOT NULL GROUP BY ALL),
g AS (SELECT p.feature, p.week, p.n, len(edges) AS m, u.bin FROM p JOIN e USING (feature), LATERAL (SELECT unnest(range(greatest(len(edges) - 1, 1))) AS bin) u),
s AS (SELECT g.feature, g.week, sum((greatest(coalesce(b.k, 0) / g.n, 1e-6) - greatest(coalesce(b0.k, 0) / p0.n, 1e-6)) * ln(greatest(coalesce(b.k, 0) / g.n, 1e-6) / greatest(coalesce(b0.k, 0) / p0.n, 1e-6))) AS psi
  FROM g, f LEFT JOIN b ON b.feature = g.feature AND b.week = g.week AND b.bin = g.bin LEFT JOIN b b0 ON b0.feature = g.feature AND b0.week = f.week AND b0.bin = g.bin JOIN p p0 ON p0.feature = g.feature AND p0.week = f.week GROUP BY ALL)
SELECT p.feature, p.week, p.n AS count, round(p.mean, 6) AS mean, round(p.median, 6) AS median, round(p.std, 6) AS std, round(p.p25, 6) AS p25, round(p.p75, 6) AS p75, round(CASE WHEN p.var + q.var > 0 THEN (p.mean - q.mean) / sqrt((p.var + q.var) / 2) ELSE 0 END, 6) AS smd, round(psi, 6) AS psi,
  CASE WHEN psi < 0.1 THEN 'LOW' WHEN psi <= 0.25 THEN 'NOTICEABLE' ELSE 'MATERIAL' END AS label, round(p.missing, 6) AS missing_rate, round(p.missing - q.missing, 6) AS missing_drift
FROM p JOIN s USING (feature, week), f JOIN p q ON q.feature = p.feature AND q.week = f.week""".replace("FROM g, f LEFT", "FROM g CROSS JOIN f LEFT").replace("USING (feature, week), f JOIN p q", "USING (feature, week) CROSS JOIN f JOIN p q")


@register("i16_weekly_drift", _DRIFT)
def weekly_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: features of events by week against the first week."""
    e = X.events(spark, sf_dir).withColumn("week", calendar_keys(F.col("ms"))["iso_week"]).withColumn("square", F.when(F.col("k") % 9 != 0, F.col("k") * F.col("k"))).withColumn("constant", F.lit(7.0))
    out = A.weekly_drift(e, "week", ["value", "k", "square", "constant"])
    return out.withColumns(r6("mean", "median", "std", "p25", "p75", "smd", "psi", "missing_rate", "missing_drift"))


#: Text of governed fields by remainders of an event's k: (field, divisor, texts, text otherwise).
_TEXTS = [
    ("opp_best_bid", 10, {0: "0.95", 1: "1.0000000000000000001", 2: "-0.01"}, "0.40"), ("opp_best_ask", 10, {0: "0.90", 3: "nan"}, "0.50"),
    ("pm_obi_change_1s", 7, {0: "1.5", 1: "-2.00000000000000000000000001", 2: "NaN", 3: "abc", 4: "2"}, "-0.3"), ("pm_obi_top3", 5, {0: "1.0000000001", 1: "-1"}, "0.2"),
    ("btc_last_price", 11, {0: "0.000", 1: "-5", 2: "1e3"}, "65000.5"), ("pm_bid_depth_top3", 13, {0: "-0.0", 1: "-1", 2: "Infinity", 3: "1e60"}, "12"),
]
_FOUND = """(2, 'opp_best_bid', 10, 1, 'OUT_OF_RANGE'), (2, 'opp_best_bid', 10, 2, 'OUT_OF_RANGE'), (1, 'opp_best_bid', 10, 2, 'OUT_OF_RANGE'), (2, 'opp_best_ask', 10, 3, 'NONFINITE_VALUE'),
 (1, 'crossed_book', 10, 0, 'CROSSED_BOOK'), (2, 'crossed_book', 10, 0, 'CROSSED_BOOK'), (1, 'crossed_book', 10, 1, 'CROSSED_BOOK'), (2, 'crossed_book', 10, 1, 'CROSSED_BOOK'),
 (1, 'pm_obi_change_1s', 7, 0, 'OUT_OF_RANGE'), (1, 'pm_obi_change_1s', 7, 1, 'OUT_OF_RANGE'), (1, 'pm_obi_change_1s', 7, 4, 'OUT_OF_RANGE'), (2, 'pm_obi_change_1s', 7, 1, 'OUT_OF_RANGE'), (2, 'pm_obi_change_1s', 7, 2, 'NONFINITE_VALUE'), (2, 'pm_obi_change_1s', 7, 3, 'INVALID_NUMERIC_VALUE'),
 (1, 'pm_obi_top3', 5, 0, 'OUT_OF_RANGE'), (2, 'pm_obi_top3', 5, 0, 'OUT_OF_RANGE'), (1, 'btc_last_price', 11, 0, 'OUT_OF_RANGE'), (2, 'btc_last_price', 11, 0, 'OUT_OF_RANGE'), (1, 'btc_last_price', 11, 1, 'OUT_OF_RANGE'), (2, 'btc_last_price', 11, 1, 'OUT_OF_RANGE'),
 (1, 'pm_bid_depth_top3', 13, 1, 'OUT_OF_RANGE'), (2, 'pm_bid_depth_top3', 13, 1, 'OUT_OF_RANGE'), (2, 'pm_bid_depth_top3', 13, 2, 'NONFINITE_VALUE')"""
#: The violations that the rules give for these texts, by version and remainder. An ask of nan is not compared in version 2, nor crosses in version 1.
_BAD = f"x(version, field, d, r, reason) AS (VALUES {_FOUND}), bad AS (SELECT event_id, version, field, reason FROM ev JOIN x ON ev.k % x.d = x.r)"


def _governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.events(spark, sf_dir)
    for name, divisor, texts, other in _TEXTS:
        c = F.lit(other)
        for r, t in texts.items():
            c = F.when(F.col("k") % divisor == r, t).otherwise(c)
        e = e.withColumn(name, c)
    return e


@register("g16_domain_violations", f"{with_sql('ev')}, {_BAD} SELECT event_id, field, reason FROM bad WHERE version = 2")
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of governed fields, as text, that are out of their domains."""
    return A.domain_violations(_governed(spark, sf_dir), "event_id", [t[0] for t in _TEXTS])


@register("g17_audit_comparison", f"""{with_sql("ev")}, {_BAD}, c AS (SELECT event_id, ms FROM ev WHERE event_type = 'view'), b AS (SELECT bad.* FROM bad JOIN c USING (event_id)),
s AS (SELECT c.event_id, ms, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.event_id = c.event_id AND version = 1) THEN 'DATA_SANITY_WARNING' ELSE 'PASS' END AS v1, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.event_id = c.event_id AND version = 2) THEN 'DATA_SANITY_WARNING' ELSE 'PASS' END AS v2 FROM c)
SELECT 'transition' AS section, v1 || ' -> ' || v2 AS name, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'date', strftime(make_timestamp(ms * 1000), '%Y-%m-%d'), count(*) FROM s GROUP BY ALL UNION ALL SELECT 'v' || version || '_field', field, count(*) FROM b GROUP BY ALL""")  # fmt: skip
def audit_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two versions of the audit over views: transitions, violated fields, dates."""
    return A.audit_comparison(_governed(spark, sf_dir), "event_id", [t[0] for t in _TEXTS], F.col("event_type") == "view", calendar_keys(F.col("ms"))["day"])


@register("k19_judgements", """WITH j AS (SELECT doc_id, n_chars, l.toxic, l.quality, d.source, n_chars % 100 / 100.0 AS confidence, lang FROM documents d LEFT JOIN labels l USING (doc_id)),
b AS (SELECT *, concat_ws(';', CASE WHEN n_chars >= 200 THEN NULL ELSE 'COVERAGE_INVALID_OR_UNKNOWN' END, CASE WHEN source <> 'src7' THEN NULL ELSE 'PROVENANCE_INVALID_OR_UNKNOWN' END, CASE WHEN toxic = 0 THEN NULL ELSE 'SANITY_INVALID_OR_UNKNOWN' END) AS hard,
  concat_ws(';', CASE WHEN confidence < 0.6 THEN 'INSUFFICIENT_SUPPORT' END, CASE WHEN quality = 0 THEN 'LOW_CANDIDATE_QUALITY' END, CASE WHEN n_chars > 3000 THEN 'EXECUTION_RISK' END) AS soft FROM j)
SELECT doc_id, CASE WHEN hard <> '' OR lang IS NULL THEN 'BLOCKED' WHEN soft <> '' THEN 'REJECT' ELSE 'ACCEPT' END AS verdict, CASE WHEN hard <> '' THEN hard WHEN lang IS NULL THEN 'MODEL_OUTPUT_UNAVAILABLE' ELSE soft END AS reasons FROM b""")
def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard flags that are not true block, unknown ones too; then threshold reasons reject; else accept."""
    rows = X.table(spark, sf_dir, "documents").join(X.table(spark, sf_dir, "labels"), "doc_id", "left")
    hard = {"COVERAGE_INVALID_OR_UNKNOWN": F.col("n_chars") >= 200, "PROVENANCE_INVALID_OR_UNKNOWN": F.col("source") != "src7", "SANITY_INVALID_OR_UNKNOWN": F.col("toxic") == 0}
    soft = [(F.col("n_chars") % 100 < 60, "INSUFFICIENT_SUPPORT"), (F.col("quality") == 0, "LOW_CANDIDATE_QUALITY"), (F.col("n_chars") > 3000, "EXECUTION_RISK")]
    verdict, why = A.gate(hard, F.col("lang").isNotNull(), soft)
    return rows.select("doc_id", verdict.alias("verdict"), F.array_join(why, ";").alias("reasons"))


_POLICY = f"""{with_sql("ev", "fills")}, m AS (SELECT condition_id, min(market_start_ms) AS s, min(market_end_ms) AS e, min(timestamp_ms) AS a, max(timestamp_ms) AS z, count(DISTINCT timestamp_ms // {DAY}) / 3.0 AS tick, nullif(count(DISTINCT timestamp_ms // {DAY}) FILTER (side = 'BUY'), 0) / 2.0 AS book,
  split_part(condition_id, '-', 1)::INT AS u FROM fills GROUP BY 1),
r AS (SELECT condition_id, s, 'v' || (CASE WHEN u % 9 = 0 THEN 3 ELSE 4 END) AS collector, CASE WHEN u % 8 <> 0 THEN CASE WHEN u % 5 = 0 THEN 'fix0' ELSE 'fix1' END END AS fix, CASE WHEN a - s <= {2 * DAY} AND e - z <= {2 * DAY} THEN 'F' ELSE 'P' END AS old, CASE WHEN a - s <= {3 * DAY} AND e - z <= {3 * DAY} THEN 'F' ELSE 'P' END AS new, coalesce(tick, 0) AS tick, coalesce(book, 0) AS book, (SELECT quantile_disc(s, 0.5) FROM m) AS mid FROM m),
w AS (SELECT *, CASE WHEN collector = 'v4' THEN NULL ELSE 'COLLECTOR_VERSION_MISMATCH' END AS c, CASE WHEN tick < 0.99 THEN 'BTC_COVERAGE_LT_99' END AS t, CASE WHEN book < 0.99 THEN 'BOOK_COVERAGE_LT_99' END AS b FROM r),
y AS (SELECT *, concat_ws(';', c, CASE WHEN old <> 'F' THEN 'PARTIAL_SESSION_MARKET' END, t, b) AS why1, concat_ws(';', c, CASE WHEN new <> 'F' THEN 'PARTIAL_SESSION_MARKET' END, t, b) AS why2, s >= mid AND fix IS NOT DISTINCT FROM 'fix1' AS after FROM w)
SELECT condition_id, CASE WHEN why1 = '' THEN 'ELIGIBLE' ELSE 'EXCLUDED' END AS v1_status, why1 AS v1_reasons, CASE WHEN why2 = '' THEN 'ELIGIBLE' ELSE 'EXCLUDED' END AS v2_status, why2 AS v2_reasons,
  CASE WHEN after AND why2 = '' THEN 'ELIGIBLE' ELSE 'EXCLUDED' END AS primary_status, CASE WHEN after THEN why2 ELSE 'PRE_EFFECTIVE_POLICY_SESSION' END AS primary_reasons, after AND why2 = '' AS included FROM y"""


@register("f12_eligibility", _POLICY)
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """markets under two policies, with reasons, and under the second one from its boundary on."""
    m = X.fills(spark, sf_dir).groupBy("condition_id").agg(
        F.min("market_start_ms").alias("s"), F.min("market_end_ms").alias("e"), F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("z"), (F.count_distinct(F.floor(F.col("timestamp_ms") / DAY)) / 3).alias("tick"),
        (F.nullif(F.count_distinct(F.when(F.col("side") == "BUY", F.floor(F.col("timestamp_ms") / DAY))), F.lit(0)) / 2).alias("book"),
    )
    u = F.split("condition_id", "-")[0].cast("int")
    full = lambda d: F.when((F.col("a") - F.col("s") <= d * DAY) & (F.col("e") - F.col("z") <= d * DAY), "FULL_LIFECYCLE_MARKET").otherwise("PARTIAL")
    m = m.withColumns({"collector": F.when(u % 9 == 0, "v3").otherwise("v4"), "fix": F.when(u % 8 != 0, F.when(u % 5 == 0, "fix0").otherwise("fix1")), "old": full(2), "new": full(3)})
    middle = m.agg(F.percentile_approx("s", 0.5, 1_000_000)).first()[0] or 0
    why = {v: A.eligibility("collector", life, {"BTC": "tick", "BOOK": "book"}, "v4") for v, life in (("v1", "old"), ("v2", "new"))}
    status, own, included = A.primary_decision(why["v2"], "s", middle, "fix", "fix1")
    each = [x for v, w in why.items() for x in (F.when(F.size(w) == 0, "ELIGIBLE").otherwise("EXCLUDED").alias(f"{v}_status"), F.array_join(w, ";").alias(f"{v}_reasons"))]
    return m.select("condition_id", *each, status.alias("primary_status"), F.array_join(own, ";").alias("primary_reasons"), included.alias("included"))


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade ticks with their own times, and book rows that carry the time of their frame only."""
    t = X.ticks(spark, sf_dir).select(F.lit("BTC").alias("source"), F.col("exchange_ms").alias("source_event_ms"), F.lit(None).cast("long").alias("frame_ms"), "receive_ms", F.lit(False).alias("has_state"), F.lit("trade").alias("event_type"), F.when(F.col("trade_id") % 6 != 0, F.col("condition_id").cast("long") % 3).alias("session"))
    b = X.book(spark, sf_dir).select(F.when(F.col("seq") % 50 == 0, "OTHER").otherwise("PM").alias("source"), F.lit(None).cast("long").alias("source_event_ms"), (F.col("receive_ms") - F.round(F.col("mid") * 1000).cast("long")).alias("frame_ms"), "receive_ms", F.lit(True).alias("has_state"), F.when(F.col("outcome") == "Up", "view").otherwise("click").alias("event_type"), F.when(F.col("seq") % 6 != 0, F.col("condition_id").cast("long") % 3).alias("session"))
    return t.unionByName(b)


_REGISTRY = [("BTC", "SOURCE_EVENT_TIME", "HIGH", "EVENT_LEVEL"), ("PM", "SOURCE_FRAME_TIME", "MEDIUM", "FRAME_LEVEL")]
_TIMES = f"""{with_sql("ev", "ticks", "book")}, x AS (SELECT 'BTC' AS source, receive_ms - exchange_ms AS d, NULL AS age, 'trade' AS event_type, CASE WHEN trade_id % 6 <> 0 THEN condition_id::BIGINT % 3 END AS session FROM ticks
 UNION ALL SELECT CASE WHEN seq % 50 = 0 THEN 'OTHER' ELSE 'PM' END, round(mid * 1000)::BIGINT, round(mid * 1000)::BIGINT, CASE WHEN outcome = 'Up' THEN 'view' ELSE 'click' END, CASE WHEN seq % 6 <> 0 THEN condition_id::BIGINT % 3 END FROM book)"""


@register("h18_latency_rows", f"""{_TIMES} SELECT source, event_type, session, d AS receive_minus_source_ms, age AS state_age_ms, CASE source WHEN 'BTC' THEN 'SOURCE_EVENT_TIME' WHEN 'PM' THEN 'SOURCE_FRAME_TIME' ELSE 'UNKNOWN' END AS timestamp_class,
  CASE source WHEN 'BTC' THEN 'HIGH' WHEN 'PM' THEN 'MEDIUM' ELSE 'UNKNOWN' END AS timestamp_trust, CASE source WHEN 'BTC' THEN 'EVENT_LEVEL' WHEN 'PM' THEN 'FRAME_LEVEL' ELSE 'UNKNOWN' END AS timestamp_granularity FROM x""")
def latency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay, state age and the clock's class of every tick and book row."""
    registry = spark.createDataFrame(_REGISTRY, "source string, timestamp_class string, timestamp_trust string, timestamp_granularity string")
    out = A.latency_rows(_timeline(spark, sf_dir), registry)
    return out.select("source", "event_type", "session", "receive_minus_source_ms", "state_age_ms", "timestamp_class", "timestamp_trust", "timestamp_granularity")


SETS = [["event_type"], ["session"], ["event_type", "session"], []]
_SETS = " UNION ALL ".join(f"SELECT '{'+'.join(s) or 'all'}' AS grouping, {'event_type' if 'event_type' in s else 'NULL'}::VARCHAR AS event_type, {'session' if 'session' in s else 'NULL'}::VARCHAR AS session, source, d FROM x" for s in SETS)


@register("h19_latency_by_sets", f"""{_TIMES}, g AS ({_SETS}), m AS (SELECT *, median(d) OVER (PARTITION BY grouping, event_type, session, source) AS mid FROM g)
SELECT grouping, event_type, session, source, count(*) AS n, median(d) AS p50, quantile_cont(d, 0.9) AS p90, quantile_cont(d, 0.99) AS p99, max(d) AS most, median(abs(d - mid)) AS mad, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS iqr, avg((d > 50)::INT) AS above_50, avg((d > 500)::INT) AS above_500 FROM m GROUP BY 1, 2, 3, 4""")  # fmt: skip
def latency_by_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays by event type, by session, by both and in all, each per source; rows without a session are a group."""
    rows = _timeline(spark, sf_dir).withColumn("d", F.col("receive_ms") - F.coalesce("source_event_ms", "frame_ms"))
    return A.latency_by_sets(rows, SETS, "d", [50, 500])
