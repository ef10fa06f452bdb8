"""Sessionisation of fills into episodes, first opposite episodes, forward-window labels and the event ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import buy_fill_code
from tallyspark.operators.scans import time_block, two_level


def valid_buys(fills: DataFrame) -> DataFrame:
    """BUY fills that can be used."""
    code = buy_fill_code(F.col("timestamp_ms"), F.col("size"), F.col("price"), F.col("condition_id"))
    return fills.where((F.col("side") == "BUY") & code.isNull())


def episodes(fills: DataFrame, gap_ms: int) -> DataFrame:
    """Episodes of valid BUY fills per market and outcome: a gap above gap_ms starts a new one."""
    by = Window.partitionBy("condition_id", "outcome").orderBy("timestamp_ms", "fill_id")
    new = F.coalesce((F.col("timestamp_ms") - F.lag("timestamp_ms").over(by) > gap_ms).cast("int"), F.lit(1))
    marked = valid_buys(fills).withColumn("new", new)
    marked = marked.withColumn("episode", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("timestamp_ms", "fill_id"))), lambda x: x["fill_id"])
    out = marked.groupBy("condition_id", "outcome", "episode").agg(
        F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.sum("size").alias("shares"), F.sum(F.col("size") * F.col("price")).alias("dollars"), F.count("*").alias("fills"), ids.alias("fill_ids")
    )
    return out.withColumn("vwap", F.col("dollars") / F.nullif("shares", F.lit(0.0)))


def initial_direction(fills: DataFrame) -> DataFrame:
    """Per market the outcome bought first; AMBIGUOUS where two outcomes start at the same time."""
    firsts = valid_buys(fills).groupBy("condition_id", "outcome").agg(F.min("timestamp_ms").alias("t"))
    out = firsts.groupBy("condition_id").agg(F.min_by("outcome", F.struct("t", "outcome")).alias("initial"), F.min("t").alias("first_ms"), F.count("*").alias("outcomes"), F.sort_array(F.collect_list("t")).alias("ts"))
    tie = (F.col("outcomes") > 1) & (F.get("ts", F.lit(0)) == F.get("ts", F.lit(1)))
    return out.select("condition_id", "initial", "first_ms", "outcomes", F.coalesce(tie, F.lit(False)).alias("ambiguous"))


def first_opposite(eps: DataFrame, initial: DataFrame) -> DataFrame:
    """Per market the earliest episode that is not of the initial direction."""
    both = eps.join(initial.select("condition_id", "initial"), "condition_id").where(F.col("outcome") != F.col("initial"))
    first = F.min_by(F.struct("outcome", "start_ms", "end_ms", "shares"), F.struct("start_ms", "outcome"))
    return both.groupBy("condition_id").agg(first.alias("o")).select("condition_id", F.col("o.outcome").alias("opposite"), F.col("o.start_ms").alias("opposite_start_ms"), F.col("o.end_ms").alias("t0_ms"), F.col("o.shares").alias("opposite_shares"))


def quantity_before(fills: DataFrame, opposite: DataFrame) -> DataFrame:
    """BUY size per market and outcome before the first opposite episode; all of it where there is none."""
    cut = opposite.select("condition_id", "opposite_start_ms")
    kept = valid_buys(fills).join(cut, "condition_id", "left").where(F.col("opposite_start_ms").isNull() | (F.col("timestamp_ms") < F.col("opposite_start_ms")))
    return kept.groupBy("condition_id", "outcome").agg(F.sum("size").alias("quantity"))


def forward_label(fills: DataFrame, opposite: DataFrame, horizon_ms: int, from_ms: int = 0) -> DataFrame:
    """label 1 if a BUY in the opposite direction lies in (t0 + from_ms, t0 + from_ms + horizon_ms], with its first time."""
    buys = valid_buys(fills).select("condition_id", F.col("outcome").alias("opposite"), "timestamp_ms")
    inside = (F.col("timestamp_ms") > F.col("t0_ms") + from_ms) & (F.col("timestamp_ms") <= F.col("t0_ms") + from_ms + horizon_ms)
    hits = opposite.join(buys, ["condition_id", "opposite"]).where(inside).groupBy("condition_id").agg(F.min("timestamp_ms").alias("hit_ms"))
    return opposite.join(hits, "condition_id", "left").withColumn("label", F.col("hit_ms").isNotNull().cast("int"))


def event_ledger(fills: DataFrame, markets: DataFrame, gap_ms: int, horizon_ms: int, tolerance_ms: int) -> DataFrame:
    """One row per market of fills or markets, with the first rule that excludes it.

    Rules in order: no BUY, bad time, bad field, more than two outcomes, same-time tie, no metadata,
    fills outside the market's window and tolerance. Columns found before the failing rule stay filled.
    markets: condition_id, market_start_ms, market_end_ms.
    """
    code = buy_fill_code(F.col("timestamp_ms"), F.col("size"), F.col("price"), F.col("condition_id"))
    buy = F.col("side") == "BUY"
    per = fills.groupBy("condition_id").agg(
        F.count_if(buy).alias("buys"), F.count("*").alias("fills"), F.count_if(buy & (code == "TIMESTAMP_INVALID")).alias("bad_time"), F.count_if(buy & (code == "FIELD_INCOMPLETE")).alias("bad_field"),
        F.min(F.when(buy, F.col("timestamp_ms"))).alias("low_ms"), F.max(F.when(buy, F.col("timestamp_ms"))).alias("high_ms"),
    )
    start = initial_direction(fills)
    opposite = first_opposite(episodes(fills, gap_ms), start)
    label = forward_label(fills, opposite, horizon_ms)
    all_ = per.join(markets, "condition_id", "full_outer").join(start, "condition_id", "left").join(label, "condition_id", "left")
    outside = (F.col("low_ms") < F.col("market_start_ms") - tolerance_ms) | (F.col("high_ms") > F.col("market_end_ms") + tolerance_ms)
    rules = [
        (F.coalesce("buys", F.lit(0)) == 0, "NO_BUY"), (F.col("bad_time") > 0, "TIMESTAMP_INVALID"), (F.col("bad_field") > 0, "FIELD_INCOMPLETE"), (F.col("outcomes") > 2, "TOO_MANY_OUTCOMES"),
        (F.col("ambiguous"), "SAME_SECOND_DIRECTION_AMBIGUITY"), (F.col("market_start_ms").isNull(), "MARKET_METADATA_MISSING"), (outside, "TIME_INCONSISTENT"),
    ]
    reason, stage = F.lit(None).cast("string"), F.lit(len(rules))
    for i, (bad, name) in reversed(list(enumerate(rules))):
        bad = F.coalesce(bad, F.lit(False))
        reason, stage = F.when(bad, name).otherwise(reason), F.when(bad, i).otherwise(stage)
    all_ = all_.withColumn("exclude_reason", reason).withColumn("stage", stage)
    after = lambda k, c: F.when(F.col("stage") > k, F.col(c)).alias(c)
    eligible = F.coalesce(F.col("market_end_ms") >= F.col("t0_ms") + horizon_ms, F.lit(False))
    return all_.select(
        "condition_id", F.coalesce("fills", F.lit(0)).alias("fills"), F.coalesce("buys", F.lit(0)).alias("buys"), after(4, "initial"), after(4, "first_ms"), after(6, "opposite"), after(6, "opposite_start_ms"), after(6, "t0_ms"),
        after(6, "label"), F.when(F.col("stage") > 6, eligible).alias("horizon_eligible"), F.col("exclude_reason").isNull().alias("clean"), "exclude_reason",
    )


def prospective_rows(fills: DataFrame, gap_ms: int, horizon_ms: int, least_fills: int) -> DataFrame:
    """condition_id, label, fills, selection of the markets in fills: BUILT, or COVERAGE_INELIGIBLE for fewer fills than least_fills.

    The same functions as the full ledger on the fills of new markets: markets are whole, so nothing is stitched.
    """
    per = fills.groupBy("condition_id").agg(F.count("*").alias("fills"))
    label = forward_label(fills, first_opposite(episodes(fills, gap_ms), initial_direction(fills)), horizon_ms)
    selection = F.when(F.col("fills") < least_fills, "COVERAGE_INELIGIBLE").otherwise("BUILT")
    return per.join(label.select("condition_id", "label"), "condition_id", "left").select("condition_id", "label", "fills", selection.alias("selection"))


def connection_intervals(journal: DataFrame, error_closes: bool = True) -> DataFrame:
    """Intervals from connected to the next state change of a session; an open one ends at the last event, or nowhere.

    With error_closes an error closes the interval and an open one ends at the session's last event;
    without it an error does not close and an open one has a null end.
    """
    closing = ["connected", "disconnected", "session_end"] + (["connection_error"] if error_closes else [])
    last = journal.groupBy("session_id").agg(F.max("timestamp_ms").alias("last_ms"))
    by = Window.partitionBy("session_id").orderBy("timestamp_ms", "seq")
    moves = journal.where(F.col("event").isin(closing)).withColumn("end_ms", F.lead("timestamp_ms").over(by)).where("event = 'connected'")
    out = moves.join(last, "session_id")
    end = F.coalesce("end_ms", "last_ms") if error_closes else F.col("end_ms")
    return out.select("session_id", F.col("timestamp_ms").alias("start_ms"), end.alias("end_ms"))


def running_inventory(fills: DataFrame) -> DataFrame:
    """Running signed size per outcome, net, absolute and pairable inventory after each fill of a market."""
    signed = F.when(F.col("side") == "BUY", F.col("size")).otherwise(-F.col("size"))
    held = lambda o: ("sum", F.when(F.col("outcome") == o, signed).otherwise(0.0))
    out = two_level(fills, ["condition_id"], time_block("timestamp_ms"), ["timestamp_ms", "fill_id"], {"up": held("Up"), "down": held("Down")})
    return out.select("condition_id", "fill_id", "up", "down", (F.col("up") - F.col("down")).alias("net"), F.greatest(F.least("up", "down"), F.lit(0.0)).alias("pairable"))


def pair_economics(fills: DataFrame) -> DataFrame:
    """BUY quantity and vwap per outcome, the quantity that pairs up, and the cost of a pair."""
    buys = valid_buys(fills)
    q = lambda o: F.sum(F.when(F.col("outcome") == o, F.col("size")).otherwise(0.0))
    d = lambda o: F.sum(F.when(F.col("outcome") == o, F.col("size") * F.col("price")).otherwise(0.0))
    out = buys.groupBy("condition_id").agg(q("Up").alias("up_qty"), q("Down").alias("down_qty"), d("Up").alias("up_usd"), d("Down").alias("down_usd"))
    out = out.withColumn("up_vwap", F.col("up_usd") / F.nullif("up_qty", F.lit(0.0))).withColumn("down_vwap", F.col("down_usd") / F.nullif("down_qty", F.lit(0.0)))
    return out.select("condition_id", "up_qty", "down_qty", "up_vwap", "down_vwap", F.least("up_qty", "down_qty").alias("pairable"), (F.col("up_vwap") + F.col("down_vwap")).alias("pair_cost"), (1 - F.col("up_vwap") - F.col("down_vwap")).alias("edge"))


def refractory_anchors(points: DataFrame, key: str, ms: str, rest_ms: int) -> DataFrame:
    """Greedy anchors: a point is kept if it lies rest_ms or more after the last one kept. One key's points are folded together."""
    keep = lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= rest_ms), F.array_append(a, x)).otherwise(a)
    folded = points.groupBy(key).agg(F.array_sort(F.collect_list(ms)).alias("_all"))
    return folded.select(key, F.explode(F.aggregate("_all", F.array().cast("array<long>"), keep)).alias(ms))
