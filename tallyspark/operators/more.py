"""Further operators of the ledger, coverage, features, audits and logs, each a composition of DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.temporal_joins import asof_backward, asof_forward


def assign_windows(rows: DataFrame, ms: str, width_ms: int) -> DataFrame:
    """Rows with the start of the regular window [start, start + width) that holds them."""
    return rows.withColumn("window_start_ms", (F.floor(F.col(ms) / width_ms) * width_ms).cast("long"))


def calendar_comparison(a: DataFrame, b: DataFrame, period: str, y: str, least: int) -> DataFrame:
    """Rates of two tables in the periods where both have `least` rows: mean and weighted difference, and the pooled one."""
    rate = lambda df, s: df.groupBy(period).agg(F.count("*").alias(f"n_{s}"), F.avg(y).alias(f"rate_{s}"))
    both = rate(a, "a").join(rate(b, "b"), period).where((F.col("n_a") >= least) & (F.col("n_b") >= least))
    delta, weight = F.col("rate_a") - F.col("rate_b"), F.least("n_a", "n_b")
    matched = both.agg(F.count("*").alias("periods"), F.avg(delta).alias("mean_delta"), (F.sum(delta * weight) / F.sum(weight)).alias("weighted_delta"))
    pooled = a.agg(F.avg(y).alias("pa")).crossJoin(b.agg(F.avg(y).alias("pb"))).select((F.col("pa") - F.col("pb")).alias("pooled_delta"))
    return matched.crossJoin(pooled)


def markouts(fills: DataFrame, grid: DataFrame, key: str, fill_id: str, ms: str, mid: str, price: str, sign: str, horizons_ms: list[int]) -> DataFrame:
    """The mid before each fill, and signed mids after each horizon less the fill's price."""
    out = asof_backward(fills, grid, key, ms, [mid]).withColumnRenamed(mid, "mid_before").drop("age_ms")
    for h in horizons_ms:
        out = asof_forward(out, grid, key, ms, [mid], h).withColumn(f"markout_{h}", F.col(sign) * (F.col(mid) - F.col(price))).drop(mid, "found_ms")
    return out.select(fill_id, "mid_before", *[f"markout_{h}" for h in horizons_ms])


def endpoint_readiness(windows: DataFrame, intervals: DataFrame, window_id: str, bucket_ms: int) -> DataFrame:
    """Whether some interval [lo_ms, hi_ms] holds the start, and the end, of each window: FULL, PARTIAL or NONE."""
    ends = windows.select(window_id, F.explode(F.array(F.struct(F.lit("start").alias("which"), F.col("start_ms").alias("t")), F.struct(F.lit("end").alias("which"), F.col("end_ms").alias("t")))).alias("x")).select(window_id, "x.*").withColumn("_b", F.floor(F.col("t") / bucket_ms))
    held = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo_ms") / bucket_ms), F.floor(F.col("hi_ms") / bucket_ms))))
    met = ends.join(held, "_b").where("lo_ms <= t and t <= hi_ms").select(window_id, "which").distinct().groupBy(window_id).agg(F.count_if(F.col("which") == "start").alias("s"), F.count_if(F.col("which") == "end").alias("e"))
    out = windows.select(window_id).join(met, window_id, "left").select(window_id, (F.coalesce("s", F.lit(0)) > 0).alias("start_ready"), (F.coalesce("e", F.lit(0)) > 0).alias("end_ready"))
    return out.withColumn("lifecycle", F.when(F.col("start_ready") & F.col("end_ready"), "FULL").when(F.col("start_ready") | F.col("end_ready"), "PARTIAL").otherwise("NONE"))


def session_bounds(journal: DataFrame) -> DataFrame:
    """First and last time of each session, its length, and whether it has an end event."""
    return journal.groupBy("session_id").agg(F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("length_ms"), F.bool_or(F.col("event") == "disconnected").alias("ended"))


def recovered_ends(journal: DataFrame) -> DataFrame:
    """An end event at the last time of every session that connected and never ended."""
    out = journal.groupBy("session_id").agg(F.max("timestamp_ms").alias("timestamp_ms"), F.bool_or(F.col("event") == "connected").alias("c"), F.bool_or(F.col("event") == "disconnected").alias("d"))
    return out.where("c and not d").select("session_id", F.lit("disconnected").alias("event"), "timestamp_ms")


def phase_counts(events: DataFrame, width_ms: int, inner_ms: int, ms: str, kind: str) -> DataFrame:
    """events per kind in the first part of the regular window that holds them, and after it."""
    at = F.pmod(F.col(ms), F.lit(width_ms))
    return events.groupBy(kind).agg(F.count_if(at < inner_ms).alias("inside"), F.count_if(at >= inner_ms).alias("after"))


def due_checkpoints(n: DataFrame, milestones: list[int]) -> DataFrame:
    """milestones that a count (column n) has reached, and the next one."""
    reached = F.array(*[F.lit(m) for m in milestones])
    out = n.withColumn("due", F.filter(reached, lambda m: m <= F.col("n")))
    return out.select("n", F.array_join(F.col("due").cast("array<string>"), ",").alias("due"), F.get(F.filter(reached, lambda m: m > F.col("n")), F.lit(0)).alias("next"))


def log_returns(cuts: DataFrame, ticks: DataFrame, key: str, cut_id: str, cut: str, lags_ms: list[int]) -> DataFrame:
    """ln(price at the cut / price lag earlier) for each lag."""
    now = asof_backward(cuts.withColumnRenamed(cut, "ms"), ticks, key, "ms", ["price"], ["seq"]).withColumnRenamed("price", "p0").drop("age_ms")
    for lag in lags_ms:
        now = asof_backward(now.withColumn("ms", F.col("ms") - lag), ticks, key, "ms", ["price"], ["seq"]).withColumn(f"r_{lag}", F.log(F.col("p0") / F.col("price"))).withColumn("ms", F.col("ms") + lag).drop("price", "age_ms")
    return now.select(cut_id, *[f"r_{lag}" for lag in lags_ms])


def validity_mode(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """Keys with any flag keep only rows whose flag is true; other keys keep all."""
    any_flag = F.max(F.col(flag).isNotNull()).over(Window.partitionBy(key))
    return rows.withColumn("_any", any_flag).where(~F.col("_any") | F.col(flag)).drop("_any")


def backdating(rows: DataFrame, received: str, available: str, used: str) -> DataFrame:
    """How many rows were available before they were received, or used before they were available."""
    reason = F.when(F.col(available) < F.col(received), "AVAILABLE_BEFORE_RECEIVE").when(F.col(used) < F.col(available), "USED_BEFORE_AVAILABLE").otherwise("OK")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def half_medians(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Medians of the first and the second half of a key's rows, from four rows on."""
    part = Window.partitionBy(key)
    out = rows.withColumn("_i", F.row_number().over(part.orderBy(order))).withColumn("_n", F.count("*").over(part)).where("_n >= 4")
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    return out.groupBy(key).agg(F.percentile(F.when(first, F.col(value)), F.lit(0.5)).alias("first_half"), F.percentile(F.when(~first, F.col(value)), F.lit(0.5)).alias("second_half"))


def market_summary(peaks: DataFrame, lag: str, corr: str) -> DataFrame:
    """Equal-weight summary of the keys' lags, with counts of directions and the dominant one."""
    side = F.when(F.col(lag) > 0, "LEAD").when(F.col(lag) < 0, "FOLLOW").otherwise("SYNC")
    out = peaks.withColumn("side", side).agg(F.count("*").alias("n"), F.avg(lag).alias("mean_lag"), F.percentile(lag, F.lit(0.5)).alias("median_lag"), F.avg(F.abs(corr)).alias("mean_abs"), *[F.count_if(F.col("side") == s).alias(s.lower()) for s in ("LEAD", "FOLLOW", "SYNC")])
    top = F.greatest("lead", "follow", "sync")
    return out.withColumn("dominant", F.when(F.col("lead") == top, "LEAD").when(F.col("follow") == top, "FOLLOW").otherwise("SYNC"))


def bucket_stability(rows: DataFrame, bucket: str, key: str, value: str) -> DataFrame:
    """Per bucket the number of rows and keys, the mean of the keys' means, and how far their signs agree."""
    per = rows.where(F.col(value).isNotNull()).groupBy(bucket, key).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    out = per.groupBy(bucket).agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.avg("m").alias("mean"), F.count_if(F.col("m") > 0).alias("positive"), F.count_if(F.col("m") < 0).alias("negative"))
    return out.withColumn("consistency", F.greatest("positive", "negative") / F.col("keys"))


def dataset_comparison(rows: DataFrame, drop: DataFrame, key: str, y: str, value: str) -> DataFrame:
    """All rows (A) against those whose key is not in drop (B): counts, rates, medians and the difference in points."""
    b = rows.join(drop.select(key).distinct(), key, "left_anti").withColumn("dataset", F.lit("B"))
    both = rows.select(*b.drop("dataset").columns).withColumn("dataset", F.lit("A")).unionByName(b)
    out = both.groupBy("dataset").agg(F.count("*").alias("n"), F.avg(y).alias("rate"), F.percentile(value, F.lit(0.5)).alias("median"))
    return out.groupBy().agg(*[F.max(F.when(F.col("dataset") == d, F.col(c))).alias(f"{c}_{d.lower()}") for d in "AB" for c in ("n", "rate", "median")]).withColumn("delta_pp", F.abs(F.col("rate_a") - F.col("rate_b")) * 100)


def baselines(rates: DataFrame, period: str, value: str, span: int) -> DataFrame:
    """Forecasts of each period's value from earlier ones: the last, the mean of all, the rolling mean of span."""
    by = Window.orderBy(period)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    return rates.select(period, value, F.lag(value).over(by).alias("last"), F.avg(value).over(before).alias("mean"), F.avg(value).over(by.rowsBetween(-span, -1)).alias("rolling"))


def ewma(rates: DataFrame, group: str, period: str, value: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean of a group's earlier values, an ordered fold per group."""
    items = F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).cast("double").alias("v"))))
    start = F.struct(F.lit(None).cast("double").alias("m"), F.array().cast("array<struct<p:string,f:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        after = F.when(a["m"].isNull(), x["v"]).otherwise(a["m"] + alpha * (x["v"] - a["m"]))
        return F.struct(after.alias("m"), F.array_append(a["out"], F.struct(x["p"].cast("string").alias("p"), a["m"].alias("f"))).alias("out"))

    return rates.groupBy(group).agg(items.alias("_x")).select(group, F.explode(F.aggregate("_x", start, step)["out"]).alias("r")).select(group, F.col("r.p").alias(period), F.col("r.f").alias("forecast"))


def reconciliation(ledger: DataFrame, raw_keys: DataFrame, key: str) -> DataFrame:
    """Totals of a ledger against the raw keys, and whether they add up."""
    l = ledger.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if("clean").alias("clean"), F.count_if(F.col("exclude_reason").isNotNull()).alias("excluded"))
    out = l.crossJoin(raw_keys.agg(F.count_distinct(key).alias("raw")))
    return out.withColumn("adds_up", (F.col("raw") == F.col("keys")) & (F.col("rows") == F.col("keys")) & (F.col("clean") + F.col("excluded") == F.col("rows")))


def status_rollup(findings: DataFrame, group: str, status: str) -> DataFrame:
    """The worst status of each group: FAIL before WARN before PASS."""
    rank = F.when(F.col(status) == "FAIL", 2).when(F.col(status) == "WARN", 1).otherwise(0)
    return findings.groupBy(group).agg(F.max(rank).alias("r"), F.count("*").alias("n")).select(group, "n", F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.col("r") + 1).alias("status"))


def fill_cancel_order(fills: DataFrame, cancels: DataFrame, order: str, ms: str, tolerance: float = 1e-12) -> DataFrame:
    """Whether each fill came before, after or within tolerance of its order's cancel."""
    c = cancels.select(order, F.col(ms).alias("_c"))
    d = F.col(ms) - F.col("_c")
    return fills.join(c, order).withColumn("position", F.when(F.abs(d) <= tolerance, "AMBIGUOUS").when(d < 0, "BEFORE").otherwise("AFTER")).drop("_c")


def error_counts(journal: DataFrame, classes: Column) -> DataFrame:
    """Errors per session state and class: READ after a connect, else CONNECT."""
    by = Window.partitionBy("session_id").orderBy("timestamp_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    moves = F.when(F.col("event").isin("connected", "disconnected"), F.col("event"))
    stage = F.when(F.last(moves, True).over(by) == "connected", "READ").otherwise("CONNECT")
    out = journal.withColumn("stage", stage).where("event = 'connection_error'").withColumn("class", classes)
    return out.groupBy("stage", "class").agg(F.count("*").alias("n"))


def restart_storms(events: DataFrame, key: str, ms: str, width_ms: int, least: int) -> DataFrame:
    """T07, batch: rows at which a key has `least` rows or more in the last width_ms."""
    by = Window.partitionBy(key).orderBy(ms).rangeBetween(-width_ms, 0)
    return events.withColumn("recent", F.count("*").over(by)).where(F.col("recent") >= least)


def sequence_audit(rows: DataFrame, key: str, order: list[str], seq: str) -> DataFrame:
    """T04, batch: per key gaps and steps back of a sequence number in arrival order."""
    before = F.lag(seq).over(Window.partitionBy(key).orderBy(*order))
    out = rows.withColumn("_d", F.col(seq) - before)
    return out.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(F.col("_d") > 1).alias("gaps"), F.count_if(F.col("_d") < 0).alias("back"))


def rebuilt_book(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """T01, batch: best bid and ask per key after all changes, from the last size of every price level.

    changes: key, side (bid or ask), price, size, and the order columns; a size of 0 removes the level.
    """
    last = changes.groupBy(key, "side", "price").agg(F.max_by("size", F.struct(*order)).alias("size")).where("size > 0")
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    out = last.groupBy(key).agg(F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"), F.count("*").alias("levels"))
    return out.withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)


def universes(rows: DataFrame, table: list[tuple[str, str]], slug: str) -> DataFrame:
    """Rows stacked under the name of every universe whose prefix their slug has; a bounded table of universes."""
    names = rows.sparkSession.createDataFrame(table, "universe string, _prefix string")
    return rows.join(F.broadcast(names), F.col(slug).startswith(F.col("_prefix"))).drop("_prefix")


def pseudonymised(rows: DataFrame, id_: str, times: list[str], cutoff: str, salt: str, drop: list[str]) -> DataFrame:
    """P25: ids hashed with a salt, the cutoff moved to 0 and other times by as much, named columns dropped."""
    shift = F.col(cutoff)
    out = rows.withColumns({t: F.col(t) - shift for t in times if t != cutoff}).withColumn(cutoff, F.lit(0).cast("long"))
    return out.withColumn(id_, F.sha2(F.concat(F.lit(salt), F.col(id_).cast("string")), 256)).drop(*drop)
