"""As-of, interval and window joins, written as windows, equi-joins on time buckets and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.scans import time_block, two_level


def asof_backward(left: DataFrame, right: DataFrame, key: str, ms: str, values: list[str], order: list[str] | None = None, stale_ms: int | None = None) -> DataFrame:
    """left with the values of the last row of right at or before its time (ties: the last by order), and age_ms.

    Both sides are united: no range join. A key's last values are carried over days, then found inside days, so that
    a key with many rows is spread over tasks. Beyond stale_ms values are null.
    """
    order = order or []
    packed = F.struct(F.col(ms).alias("at"), *values)
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType))
    b = right.select(key, ms, F.lit(0).alias("_side"), packed.alias("_v"), *[F.col(o).alias(f"_o_{o}") for o in order])
    both = a.unionByName(b, allowMissingColumns=True)
    out = two_level(both, [key], time_block(ms), [ms, "_side", *[f"_o_{o}" for o in order]], {"_last": ("last", F.col("_v"))})
    out = out.where("_side = 1").withColumn("age_ms", F.col(ms) - F.col("_last.at"))
    fresh = F.lit(True) if stale_ms is None else F.col("age_ms") <= stale_ms
    return out.select(*left.columns, *[F.when(fresh, F.col(f"_last.{v}")).alias(v) for v in values], "age_ms")


def asof_forward(left: DataFrame, right: DataFrame, key: str, ms: str, values: list[str], horizon_ms: int) -> DataFrame:
    """left with the values of the first row of right at or after its time plus horizon_ms."""
    packed = F.struct(F.col(ms).alias("at"), *values)
    a = left.withColumn("_at", F.col(ms) + horizon_ms).withColumn("_side", F.lit(0)).withColumn("_v", F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType))
    b = right.select(key, F.col(ms).alias("_at"), F.lit(1).alias("_side"), packed.alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_back", -F.col("_at")).withColumn("_turn", -F.col("_side"))
    out = two_level(both, [key], time_block("_back"), ["_back", "_turn"], {"_next": ("last", F.col("_v"))}).where("_side = 0")
    return out.select(*left.columns, F.col("_next.at").alias("found_ms"), *[F.col(f"_next.{v}").alias(v) for v in values])


def at_targets(left: DataFrame, right: DataFrame, key: str, ms: str, value: str, lags_ms: list[int], seq: str, tolerance_ms: int | None = None) -> DataFrame:
    """left with one row per lag: the last value of right at or before its time minus the lag (ties: the last by seq)."""
    targets = left.withColumn("lag_ms", F.explode(F.array(*[F.lit(x).cast("long") for x in lags_ms]))).withColumn("_own", F.col(ms)).withColumn(ms, F.col(ms) - F.col("lag_ms"))
    out = asof_backward(targets, right, key, ms, [value], [seq], tolerance_ms)
    return out.withColumn(ms, F.col("_own")).drop("_own")


def overlaps(lo: Column, hi: Column, start: Column, end: Column) -> Column:
    """Whether [lo, hi] and [start, end] meet; a null hi has no end."""
    return (lo <= end) & (hi.isNull() | (hi >= start))


def interval_matches(windows: DataFrame, intervals: DataFrame, window_id: str, bucket_ms: int) -> DataFrame:
    """window_id, matches, match: how many owners' intervals meet each window: MISSING, ELIGIBLE or AMBIGUOUS.

    windows: window_id, start_ms, end_ms; intervals: owner, lo_ms, hi_ms. Both sides are dealt into time
    buckets and joined on them, so that only intervals near a window are compared with it.
    """
    cut = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket_ms), F.floor(F.col(hi) / bucket_ms)))
    last = intervals.agg(F.greatest(F.max("hi_ms"), F.max("lo_ms")).alias("m")).first()["m"]
    w = windows.withColumn("_b", cut("start_ms", "end_ms"))
    i = intervals.withColumn("_hi", F.coalesce("hi_ms", F.greatest(F.lit(last), F.col("lo_ms")))).where("_hi >= lo_ms").withColumn("_b", cut("lo_ms", "_hi"))
    met = w.join(i, "_b").where(overlaps(F.col("lo_ms"), F.col("hi_ms"), F.col("start_ms"), F.col("end_ms")))
    found = met.groupBy(window_id).agg(F.count_distinct("owner").alias("matches"))
    out = windows.select(window_id).join(found, window_id, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumn("match", F.when(F.col("matches") == 0, "MISSING").when(F.col("matches") == 1, "ELIGIBLE").otherwise("AMBIGUOUS"))
