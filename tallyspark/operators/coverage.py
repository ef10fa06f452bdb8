"""Coverage of time windows by observations: buckets, bounded states, gaps, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.scans import time_block, two_level


#: Windows and points of a key meet by the day.
NEAR_MS = 86_400_000


def inside_windows(windows: DataFrame, points: DataFrame, key: str, ms: str) -> DataFrame:
    """key, start_ms, end_ms, t of the points in each window's [start, end], joined on (key, day)."""
    day = lambda c: F.floor(F.col(c) / NEAR_MS)
    w = windows.select(key, "start_ms", "end_ms", F.explode(F.sequence(day("start_ms"), F.greatest(day("start_ms"), day("end_ms")))).alias("_day"))
    met = w.join(points.select(key, F.col(ms).alias("t"), day(ms).alias("_day")), [key, "_day"])
    return met.where("t >= start_ms and t <= end_ms").drop("_day")


def bucket_coverage(windows: DataFrame, points: DataFrame, key: str, ms: str, bucket_ms: int) -> DataFrame:
    """Share of a window's buckets with a point in [start, end]; the end goes to the last bucket.

    Null for an empty window, 0.0 without points.
    """
    n = F.ceil((F.col("end_ms") - F.col("start_ms")) / bucket_ms).cast("long")
    at = F.least(F.floor((F.col("t") - F.col("start_ms")) / bucket_ms), n - 1).alias("_at")
    filled = inside_windows(windows, points, key, ms).select(key, "start_ms", "end_ms", at).distinct().groupBy(key, "start_ms", "end_ms").agg(F.count("*").alias("filled"))
    out = windows.select(key, "start_ms", "end_ms").distinct().join(filled, [key, "start_ms", "end_ms"], "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    return out.select(key, "start_ms", n.alias("buckets"), "filled", (F.col("filled") / F.nullif(n, F.lit(0))).alias("coverage"))


def merged_intervals(intervals: DataFrame, key: str) -> DataFrame:
    """Overlapping or touching [lo_ms, hi_ms] of a key merged."""
    order = ["lo_ms", "hi_ms"]
    marked = two_level(intervals.select(key, *order), [key], time_block("lo_ms"), order, {"_before": ("max", F.col("hi_ms"))}, inclusive=False)
    new = F.when(F.col("_before").isNull() | (F.col("lo_ms") > F.col("_before")), F.col("lo_ms"))
    marked = two_level(marked, [key], time_block("lo_ms"), order, {"_island": ("last", new)})
    return marked.groupBy(key, "_island").agg(F.min("lo_ms").alias("lo_ms"), F.max("hi_ms").alias("hi_ms")).drop("_island")


def state_coverage(windows: DataFrame, points: DataFrame, key: str, ms: str, hold_ms: int, bucket_ms: int) -> DataFrame:
    """Share of a window's buckets that lie wholly inside the merged times for which observations hold."""
    held = merged_intervals(points.select(key, F.col(ms).alias("lo_ms"), (F.col(ms) + hold_ms).alias("hi_ms")), key)
    n = F.floor((F.col("end_ms") - F.col("start_ms")) / bucket_ms)
    day = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / NEAR_MS), F.greatest(F.floor(F.col(lo) / NEAR_MS), F.floor(F.col(hi) / NEAR_MS)))).alias("_day")
    met = windows.select(key, "start_ms", "end_ms", day("start_ms", "end_ms")).join(held.select(key, "lo_ms", "hi_ms", day("lo_ms", "hi_ms")), [key, "_day"]).drop("_day").distinct()
    met = windows.select(key, "start_ms", "end_ms").distinct().join(met, [key, "start_ms", "end_ms"], "left")
    first = F.ceil((F.greatest("lo_ms", "start_ms") - F.col("start_ms")) / bucket_ms)
    last = F.floor((F.least("hi_ms", "end_ms") - F.col("start_ms")) / bucket_ms)
    whole = F.greatest(F.least(last, n) - first, F.lit(0))
    out = met.groupBy(key, "start_ms", "end_ms").agg(F.sum(F.coalesce(whole, F.lit(0))).cast("long").alias("whole"))
    return out.select(key, "start_ms", n.alias("buckets"), "whole", (F.col("whole") / F.nullif(n, F.lit(0))).alias("coverage"))


def gaps(windows: DataFrame, points: DataFrame, key: str, ms: str, threshold_ms: int) -> DataFrame:
    """key, start_ms, from_ms, to_ms: gaps above the threshold inside each window, the leading and the trailing one included; all of an empty window."""
    edges = windows.select(key, "start_ms", "end_ms", F.explode(F.array("start_ms", "end_ms")).alias("t"))
    by = Window.partitionBy(key, "start_ms", "end_ms").orderBy("t")
    out = inside_windows(windows, points, key, ms).unionByName(edges).withColumn("to_ms", F.lead("t").over(by))
    return out.where(F.col("to_ms") - F.col("t") > threshold_ms).select(key, "start_ms", F.col("t").alias("from_ms"), "to_ms")


def coverage_gate(named: dict[str, Column], least: float = 0.99) -> Column:
    """Reasons, joined by ;, why coverages are not enough: missing, not finite, below."""
    parts = []
    for name, c in named.items():
        low = F.when(c.isNull(), f"{name}_missing").when(F.isnan(c) | (F.abs(c) == float("inf")), f"{name}_not_finite").when(c < least, f"{name}_below")
        parts.append(low)
    return F.concat_ws(";", *parts)


def exact_gate(filled: Column, total: Column, least: str = "0.99") -> Column:
    """filled >= least * total in decimals."""
    return filled.cast("decimal(18,0)") >= F.lit(least).cast("decimal(18,6)") * total.cast("decimal(18,0)")


def percentile_summary(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """count, least, greatest, exact percentiles and the shares of rows at or above .99 and .999."""
    p = [F.percentile(column, F.lit(s)).alias(f"p{round(s * 1000):03d}") for s in shares]
    return rows.agg(F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("most"), *p, F.avg((F.col(column) >= 0.99).cast("double")).alias("share_99"), F.avg((F.col(column) >= 0.999).cast("double")).alias("share_999"))
