"""Batch analytics of execution and attempt logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.scans import average_cost


def execution_costs(fills: DataFrame, order: str, maker_rate: float, taker_rate: float) -> DataFrame:
    """Per order: filled quantity, vwap, notional, fees, rebates and slippage against the reference price.

    fills: order, qty, price, liquidity (maker or taker), reference.
    """
    notional = F.col("qty") * F.col("price")
    out = fills.groupBy(order).agg(
        F.sum("qty").alias("filled"), F.sum(notional).alias("notional"), F.sum(F.when(F.col("liquidity") == "taker", notional * taker_rate).otherwise(0.0)).alias("fees"), F.sum(F.when(F.col("liquidity") == "maker", notional * maker_rate).otherwise(0.0)).alias("rebates"),
        F.sum(F.col("qty") * (F.col("price") - F.col("reference"))).alias("slippage"), F.count_if(~F.col("liquidity").isin("maker", "taker")).alias("unknown_liquidity"),
    )
    return out.withColumn("vwap", F.col("notional") / F.nullif("filled", F.lit(0.0))).withColumn("cost", F.col("fees") - F.col("rebates") + F.col("slippage"))


def mark_to_market(costs: DataFrame, marks: DataFrame, order: str) -> DataFrame:
    """(mark - vwap) * filled minus net fees per order."""
    return costs.join(marks, order).select(order, ((F.col("mark") - F.col("vwap")) * F.col("filled") - F.col("fees") + F.col("rebates")).alias("pnl"))


def book_sweep(rows: DataFrame, row_id: str, levels: str, qty: str) -> DataFrame:
    """What an order of qty takes from the levels of a book, best first: filled, average price, what remains."""
    long = rows.select(row_id, qty, F.posexplode(levels).alias("i", "level"))
    before = F.coalesce(F.sum("level.size").over(Window.partitionBy(row_id).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    taken = F.least(F.col("level.size"), F.greatest(F.col(qty) - before, F.lit(0.0)))
    out = long.withColumn("_t", taken).groupBy(row_id, qty).agg(F.sum("_t").alias("filled"), F.sum(F.col("_t") * F.col("level.price")).alias("_n"))
    return out.select(row_id, "filled", (F.col("_n") / F.nullif("filled", F.lit(0.0))).alias("price"), (F.col(qty) - F.col("filled")).alias("rest"))


def queue_fill(trades: DataFrame, order: str, seq: str, traded: str, ahead: str, qty: str) -> DataFrame:
    """Fill of a resting order after each trade at its price: trades use up the queue ahead first."""
    by = Window.partitionBy(order).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    done = F.least(F.col(qty), F.greatest(F.sum(traded).over(by) - F.col(ahead), F.lit(0.0)))
    out = trades.withColumn("filled", done)
    step = F.col("filled") - F.coalesce(F.lag("filled").over(Window.partitionBy(order).orderBy(seq)), F.lit(0.0))
    return out.withColumn("step", step).select(order, seq, "filled", "step")


def order_audit(events: DataFrame, order: str, seq: str) -> DataFrame:
    """Per order the first breach: time order, cumulative and remaining quantity, overfill; else OBSERVED_TERMINAL or UNRESOLVED.

    events: order, seq, ts_ms, fill_qty, cumulative, remaining, ordered - exact decimals.
    """
    by = Window.partitionBy(order).orderBy(seq)
    total = F.sum("fill_qty").over(by.rowsBetween(Window.unboundedPreceding, 0))
    reason = F.when(F.col("ts_ms") < F.lag("ts_ms").over(by), "TIME_ORDER").when(F.col("cumulative") != total, "CUMULATIVE_MISMATCH").when(F.col("cumulative") > F.col("ordered"), "OVERFILL").when(F.col("remaining") != F.col("ordered") - F.col("cumulative"), "REMAINING_MISMATCH")
    marked = events.withColumn("_reason", reason)
    out = marked.groupBy(order).agg(F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col(seq))).alias("reason"), F.max_by("remaining", seq).alias("left"), F.count("*").alias("events"))
    status = F.when(F.col("reason").isNotNull(), "CONFLICT").when(F.col("left") == 0, "OBSERVED_TERMINAL").otherwise("UNRESOLVED")
    return out.select(order, "events", status.alias("status"), "reason")


def average_cost_ledger(fills: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per key the final position, cost and realised profit by average cost; selling more than is held is a violation and is left out.

    fills: key, side, qty, price; order[0] is the time in ms.
    """
    return average_cost(fills, key, order)


def chain_verification(records: DataFrame, journal: str, seq: str, payload: str, previous: str, own: str) -> DataFrame:
    """Per journal: records, gaps in the sequence, broken links, hashes that are not sha256(previous|payload)."""
    by = Window.partitionBy(journal).orderBy(seq)
    before, at = F.lag(own).over(by), F.lag(seq).over(by)
    marked = records.withColumn("_gap", (F.col(seq) != at + 1).cast("int")).withColumn("_broken", (~F.col(previous).eqNullSafe(before)).cast("int"))
    marked = marked.withColumn("_forged", (F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), payload), 256) != F.col(own)).cast("int"))
    return marked.groupBy(journal).agg(F.count("*").alias("records"), F.sum(F.coalesce("_gap", F.lit(0))).alias("gaps"), F.sum("_broken").alias("broken"), F.sum("_forged").alias("forged"))


def attempt_summary(attempts: DataFrame, key: str, attempt: str, status: str) -> DataFrame:
    """Per status of the latest attempt of each key: keys, their attempts, token sum and exact cost."""
    by = Window.partitionBy(key)
    last = attempts.withColumn("_rn", F.row_number().over(by.orderBy(F.desc(attempt)))).withColumn("_n", F.count("*").over(by)).withColumn("_tokens", F.sum("tokens").over(by)).withColumn("_cost", F.sum("cost").over(by))
    return last.where("_rn = 1").groupBy(status).agg(F.count("*").alias("keys"), F.sum("_n").alias("attempts"), F.sum("_tokens").alias("tokens"), F.sum("_cost").alias("cost"))


def connection_lifetimes(intervals: DataFrame) -> DataFrame:
    """Number and p10, p50, p90 of the lengths of connection intervals."""
    life = (F.col("end_ms") - F.col("start_ms")).cast("double")
    return intervals.agg(F.count("*").alias("n"), *[F.percentile(life, F.lit(s)).alias(f"p{int(s * 100)}") for s in (0.1, 0.5, 0.9)])


def feed_health(rows: DataFrame, key: str, ms: str, now_ms: int, stale_ms: int) -> DataFrame:
    """Records, last time, age and state of every feed at now_ms."""
    out = rows.groupBy(key).agg(F.count(ms).alias("records"), F.max(ms).alias("last_ms")).withColumn("age_ms", F.lit(now_ms) - F.col("last_ms"))
    return out.withColumn("health", F.when(F.col("last_ms").isNull(), "NO_DATA").when(F.col("age_ms") > stale_ms, "STALE").otherwise("HEALTHY"))
