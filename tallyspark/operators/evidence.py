"""Lead-lag evidence across markets, publication resolution, regimes and order checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.scans import anchored_regimes, recent_rate, two_level
from tallyspark.sources.files import dealt, written


def vote_agreement(rows: DataFrame, key: str, views: list[str]) -> DataFrame:
    """key, winner, votes, consistent: the most frequent of the views' directions (ties: the first by name); consistent from two votes on."""
    votes = rows.select(key, F.explode(F.array(*views)).alias("winner")).where("winner is not null").groupBy(key, "winner").agg(F.count("*").alias("votes"))
    best = votes.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("v"), "winner")).alias("b"))
    return best.select(key, F.col("b.winner").alias("winner"), (-F.col("b.v")).alias("votes"), (F.col("b.v") <= -2).alias("consistent"))


def dependence_sensitivity(overlapping: DataFrame, refractory: DataFrame, key: str, least: int = 10, most: float = 0.5) -> DataFrame:
    """key, flip, change, sensitive: whether the mean of independent observations tells another story than that of all.

    Both tables: key, n, mean. Only keys with `least` observations in both count.
    """
    both = overlapping.select(key, F.col("n").alias("n_a"), F.col("mean").alias("a")).join(refractory.select(key, F.col("n").alias("n_b"), F.col("mean").alias("b")), key)
    change = F.abs(F.col("a") - F.col("b")) / F.nullif(F.greatest(F.abs("a"), F.abs("b")), F.lit(0.0))
    out = both.where((F.col("n_a") >= least) & (F.col("n_b") >= least)).select(key, (F.signum("a") * F.signum("b") < 0).alias("flip"), F.coalesce(change, F.lit(0.0)).alias("change"))
    return out.withColumn("sensitive", F.col("flip") | (F.col("change") > most))


def clock_basis(first: DataFrame, second: DataFrame, delays: DataFrame, key: str, lag: str, most_drift: float) -> DataFrame:
    """key, status, drift, warning: CONSISTENT if both clocks' peaks have one sign, UNSTABLE if not, UNKNOWN without one; drift = p99 - p50 of delays."""
    both = delays.join(first.select(key, F.col(lag).alias("_a")), key, "left").join(second.select(key, F.col(lag).alias("_b")), key, "left")
    status = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "UNKNOWN").when(F.signum("_a") == F.signum("_b"), "CONSISTENT").otherwise("UNSTABLE")
    drift = F.col("p99") - F.col("p50")
    return both.select(key, status.alias("status"), drift.alias("drift"), (drift > most_drift).alias("warning"))


def lead_lag_row(curve: DataFrame, peaks: DataFrame, key: str, lags: list[int]) -> DataFrame:
    """One wide row per market: its peak, and each lag's correlation as a share of the peak's."""
    wide = curve.groupBy(key).pivot("lag", lags).agg(F.first("corr"))
    out = peaks.join(wide, key)
    return out.select(key, F.col("lag").alias("peak_lag"), F.col("corr").alias("peak_corr"), *[(F.abs(F.col(f"`{x}`")) / F.nullif(F.abs("corr"), F.lit(0.0))).alias(f"share_{i}") for i, x in enumerate(lags)])


def market_bootstrap(rows: DataFrame, key: str, value: str, replicates: int, least: int = 10) -> DataFrame:
    """n, mean, low, high, positive: markets resampled with replacement; the 2.5 and 97.5 percentiles of the means and the share of positive ones.

    Draw i of replicate b takes market (b * 1103515245 + i * 12345 + b * i * 40503) mod 2147483647 mod n, a rule that needs no state.
    Fewer than `least` markets give nulls. One row per market goes in, numbered in stretches of the key; draws are a range
    of replicates x n numbers, whose size Spark knows, so that it broadcasts no side that is too large for it.
    """
    markets = rows.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"))
    markets = written(markets.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "markets")
    n = markets.count()
    if n < least:
        return markets.agg(F.lit(n).cast("long").alias("n"), F.avg("_v").alias("mean"), *[F.lit(None).cast("double").alias(c) for c in ("low", "high", "positive")])
    numbered = two_level(markets, [], F.col("_part"), [key], {"_n": ("sum", F.lit(1))}).select((F.col("_n") - 1).alias("_i"), "_v")
    draws = rows.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).alias("_b"), (F.col("id") % n).alias("_d"))
    at = (F.col("_b") * 1103515245 + F.col("_d") * 12345 + F.col("_b") * F.col("_d") * 40503) % 2147483647 % n
    means = draws.select("_b", at.alias("_i")).join(numbered, "_i").groupBy("_b").agg(F.avg("_v").alias("m"))
    p = lambda s: F.percentile("m", F.lit(s))
    out = means.agg(p(0.025).alias("low"), p(0.975).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("positive"))
    return markets.agg(F.count("*").alias("n"), F.avg("_v").alias("mean")).crossJoin(F.broadcast(out))


def source_ordering(sources: DataFrame) -> DataFrame:
    """a, b, ordering of each two sources: YES for trusted clocks of one granularity in ms, LIMITED for trusted ones otherwise, else NO.

    sources: source, granularity_ms, trusted; a registry of few rows.
    """
    a = sources.select(F.col("source").alias("a"), F.col("granularity_ms").alias("ga"), F.col("trusted").alias("ta"))
    b = F.broadcast(sources.select(F.col("source").alias("b"), F.col("granularity_ms").alias("gb"), F.col("trusted").alias("tb")))
    both = a.join(b, F.col("a") < F.col("b"))
    return both.select("a", "b", F.when(~F.col("ta") | ~F.col("tb"), "NO").when((F.col("ga") == 1) & (F.col("gb") == 1), "YES").otherwise("LIMITED").alias("ordering"))


def agreement_matrix(rows: DataFrame, views: list[str], least: float = 0.8) -> DataFrame:
    """a, b, agree, disagree, status of each two views over the rows that have both; STABLE from `least` agreement on; a = b = all for all views."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) == F.col(b)).alias("same")) for i, a in enumerate(views) for b in views[i + 1 :]]
    every = F.col(views[0]) == F.col(views[1])
    for v in views[2:]:
        every = every & (F.col(views[0]) == F.col(v))
    cells.append(F.struct(F.lit("all").alias("a"), F.lit("all").alias("b"), every.alias("same")))
    out = rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("a", "b").agg(F.count_if("same").alias("agree"), F.count_if(~F.col("same")).alias("disagree"))
    return out.withColumn("status", F.when(F.col("agree") >= least * (F.col("agree") + F.col("disagree")), "STABLE").otherwise("UNSTABLE"))


def resolution_levels(rows: DataFrame, key: str, lag_ms: str, spreads: list[str]) -> DataFrame:
    """key, bound_ms, level: the largest spread bounds what a lag can mean: RESOLVED above it, DIRECTIONAL above half, else NOT_RESOLVED."""
    bound = F.greatest(*[F.coalesce(s, F.lit(0)) for s in spreads]) if len(spreads) > 1 else F.coalesce(spreads[0], F.lit(0))
    size = F.abs(F.col(lag_ms))
    return rows.select(key, bound.alias("bound_ms"), F.when(size.isNull(), "UNKNOWN").when(size > bound, "RESOLVED").when(2 * size > bound, "DIRECTIONAL").otherwise("NOT_RESOLVED").alias("level"))


def online_regimes(rows: DataFrame, universe: str, ms: str, label: str, past: int, after: int, step: float, seq: str, block: int = 1 << 16) -> DataFrame:
    """universe, ms, seen, rate, regime: the regime number rises when the rate of the last `past` earlier labels moves by `step` from its anchor.

    Equal times share what was known before them. The anchor is the rate when `after` labels were seen, then that of each step.
    Rates and steps are found in blocks of rows, so that one universe is spread over tasks.
    """
    known = recent_rate(rows, universe, ms, seq, label, past, max(block, past))
    return anchored_regimes(known, universe, ms, after, step)


def frozen_findings(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """name, finding, severity: definitions (name, value) that are not as they were frozen."""
    gone = frozen.exceptAll(current).select("name", F.lit("FROZEN_VALUE_CHANGED").alias("finding"))
    new = current.join(frozen.select("name"), "name", "left_anti").select("name", F.lit("NOT_FROZEN").alias("finding"))
    return gone.unionByName(new).withColumn("severity", F.lit("CRITICAL"))


def resolve_publication(old: DataFrame, new: DataFrame, resolutions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, status: NEW, EXACT_OVERLAP, or for a conflict the class of its one resolution; without exactly one it is UNRESOLVED.

    resolutions: key, resolution.
    """
    digest = lambda df: F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)  # noqa: E731, ARG005
    a = old.select(key, digest(old).alias("_old"))
    one = resolutions.groupBy(key).agg(F.count("*").alias("_k"), F.min("resolution").alias("_r"))
    both = new.select(key, digest(new).alias("_new")).join(a, key, "left").join(one, key, "left")
    status = F.when(F.col("_old").isNull(), "NEW").when(F.col("_old") == F.col("_new"), "EXACT_OVERLAP").when(F.col("_k") == 1, F.col("_r")).otherwise("UNRESOLVED")
    return both.select(key, status.alias("status"))


def forensic_resolutions(conflicts: DataFrame, roots: DataFrame, text: str, classes: dict[str, str]) -> DataFrame:
    """key, resolution from two logs of lines `CONFLICT {json}` and `ROOT {json}`: the root's class by the map, UNMAPPED for others, UNCOVERED without a root."""
    read = lambda log, word, schema: log.where(F.col(text).startswith(f"{word} ")).select(F.from_json(F.substring(text, len(word) + 2, 1 << 20), schema).alias("j")).select("j.*")
    names = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    both = read(conflicts, "CONFLICT", "key bigint").distinct().join(read(roots, "ROOT", "key bigint, root string").distinct(), "key", "left")
    return both.select("key", F.when(F.col("root").isNull(), "UNCOVERED").otherwise(F.coalesce(F.try_element_at(names, "root"), F.lit("UNMAPPED"))).alias("resolution"))


def rebind_provenance(rows: DataFrame, sources: DataFrame, key: str, version: str) -> DataFrame:
    """rows (key, source_file, previous_file) bound to the files of sources (key, file, sha256); the file before the first rebind is kept."""
    both = rows.join(sources.select(key, F.col("file").alias("_f"), F.col("sha256").alias("_h")), key, "left")
    moved = F.col("_f").isNotNull() & ~F.col("_f").eqNullSafe(F.col("source_file"))
    previous = F.when(moved & F.col("previous_file").isNull(), F.col("source_file")).otherwise(F.col("previous_file"))
    return both.select(key, F.coalesce("_f", "source_file").alias("source_file"), F.col("_h").alias("source_sha256"), previous.alias("previous_file"), F.when(F.col("_f").isNotNull(), version).alias("source_version"))


def venue_evidence(events: DataFrame, run: str, order: str) -> DataFrame:
    """run, events, reasons: what speaks against a run's order events.

    events: run, order, seq, event_id, venue_ts_ms, receive_ms, quantity, cumulative.
    """
    by = Window.partitionBy(order).orderBy("seq")
    marked = events.withColumn("_back", F.col("receive_ms") < F.lag("receive_ms").over(by)).withColumn("_sum", F.sum("quantity").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.select(run, "event_id", "_back", F.col("venue_ts_ms").isNull().alias("_no_ts"), (F.abs(F.col("_sum") - F.col("cumulative")) > 1e-9).alias("_off"))
    # dealt by run once, in tasks of bounded rows: ids are counted where their run is summed up
    each = dealt(marked, events.count(), run).groupBy(run, "event_id").agg(F.count("*").alias("_n"), *[F.max(c).alias(c) for c in ("_back", "_no_ts", "_off")])
    per = each.groupBy(run).agg(
        F.sum("_n").alias("events"), F.max(F.col("event_id").isNotNull() & (F.col("_n") > 1)).alias("_dup"), F.max("_back").alias("back"), F.max("_no_ts").alias("no_ts"), F.max(F.col("event_id").isNull()).alias("no_id"), F.max("_off").alias("sums"),
    )
    names = {"_dup": "DUPLICATE_ID", "back": "RECEIVE_TIME_BACK", "no_ts": "VENUE_TIME_MISSING", "no_id": "ID_MISSING", "sums": "ACCOUNTING_MISMATCH"}
    return per.select(run, "events", F.array_compact(F.array(*[F.when(F.col(c), n) for c, n in names.items()])).alias("reasons"))


def order_screen(orders: DataFrame, limits: dict[str, float], kill: Column) -> DataFrame:
    """orders with the reasons why limits refuse them, an empty array if none do.

    orders: order_id, now_ms, data_ms, notional, cash, position, market_exposure, gross_exposure, day_loss.
    """
    tests = [
        (kill, "KILL_SWITCH"), (F.col("data_ms") > F.col("now_ms"), "FUTURE_DATA"), (F.col("now_ms") - F.col("data_ms") > limits["stale_ms"], "STALE_DATA"), (F.col("notional") > limits["notional"], "NOTIONAL"),
        (F.col("notional") > F.col("cash"), "CASH"), (F.abs("position") > limits["position"], "POSITION"), (F.col("market_exposure") + F.col("notional") > limits["market"], "MARKET_EXPOSURE"),
        (F.col("gross_exposure") + F.col("notional") > limits["gross"], "GROSS_EXPOSURE"), (F.col("day_loss") > limits["day_loss"], "DAILY_LOSS"),
    ]
    return orders.withColumn("reasons", F.array_compact(F.array(*[F.when(c, n) for c, n in tests])))


def validity_states(frames: Iterator[pd.DataFrame], state: tuple | None, stale_ms: int, least: float, most: float) -> tuple[list[tuple], tuple | None]:
    """(seq, status) of a connection's events in order, and the state kept: time, tokens seen, whether desynchronised."""
    last, seen, bad = state if state is not None else (None, 0, False)
    out = []
    rows = pd.concat(list(frames)).sort_values("seq")
    for seq, ms, token, price, reset in zip(rows["seq"].tolist(), rows["ms"].tolist(), rows["token"].tolist(), rows["price"].tolist(), rows["reset"].tolist(), strict=True):
        if reset:
            seen, bad, last = 0, False, None
        seen |= int(token)
        bad = bad or (last is not None and ms < last) or not least <= price <= most
        stale = last is not None and ms - last > stale_ms
        out.append((seq, "DESYNCED" if bad else "UNINITIALIZED" if seen != 3 else "STALE" if stale else "VALID"))
        last = ms if last is None else max(last, ms)
    return out, (last, seen, bad)
