"""Point-in-time features of ticks and books, and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_window(cuts: DataFrame, ticks: DataFrame, key: str, cut: str, ms: str, widest_ms: int) -> DataFrame:
    """Pairs of a cut and the ticks in (cut - widest_ms, cut], joined on time buckets of that width."""
    a = cuts.withColumn("_b", F.explode(F.array(F.floor(F.col(cut) / widest_ms), F.floor(F.col(cut) / widest_ms) - 1)))
    b = ticks.withColumn("_b", F.floor(F.col(ms) / widest_ms))
    return a.join(b, [key, "_b"]).where((F.col(ms) <= F.col(cut)) & (F.col(ms) > F.col(cut) - widest_ms)).drop("_b")


def volume_flow(cuts: DataFrame, ticks: DataFrame, key: str, cut_id: str, cut: str, ms: str, windows_ms: list[int]) -> DataFrame:
    """Per cut and window: count, volume and signed flow; flow only if every tick names its maker; null without ticks."""
    pairs = in_window(cuts, ticks, key, cut, ms, max(windows_ms))
    spread = pairs.withColumn("window_ms", F.explode(F.array(*[F.lit(w).cast("long") for w in windows_ms]))).where(F.col(ms) > F.col(cut) - F.col("window_ms"))
    sign = F.when(F.col("buyer_is_maker"), -1.0).otherwise(1.0)
    out = spread.groupBy(cut_id, "window_ms").agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.sum(F.col("size") * sign).alias("flow"), F.count_if(F.col("buyer_is_maker").isNull()).alias("_open"))
    return out.withColumn("flow", F.when(F.col("_open") == 0, F.col("flow"))).drop("_open")


def realised_volatility(cuts: DataFrame, ticks: DataFrame, key: str, cut_id: str, cut: str, ms: str, price: str, seq: str, window_ms: int) -> DataFrame:
    """Square root of the sum of squared log returns between neighbouring ticks inside the window."""
    by = Window.partitionBy(cut_id).orderBy(ms, seq)
    pairs = in_window(cuts, ticks, key, cut, ms, window_ms).withColumn("_r", F.log(price) - F.lag(F.log(price)).over(by))
    return pairs.groupBy(cut_id).agg(F.sqrt(F.sum(F.col("_r") * F.col("_r"))).alias("volatility"), F.count("_r").alias("returns"))


def point_in_time_failures(rows: DataFrame, source_ms: str, cutoff_ms: str, gaps_ms: list[int]) -> DataFrame:
    """Rows per gap whose source is not before the cutoff minus the gap; an unknown source fails."""
    spread = rows.withColumn("gap_ms", F.explode(F.array(*[F.lit(g).cast("long") for g in gaps_ms])))
    bad = F.when(F.col(source_ms).isNull(), "SOURCE_MISSING").when(F.col(source_ms) >= F.col(cutoff_ms) - F.col("gap_ms"), "NOT_BEFORE_CUTOFF")
    return spread.withColumn("reason", bad).where("reason is not null").groupBy("gap_ms", "reason").agg(F.count("*").alias("n"))


def order_violations(rows: DataFrame, key: str, seq: str, ms: str) -> DataFrame:
    """Rows, in the order of seq, whose time goes back."""
    by = Window.partitionBy(key).orderBy(seq)
    return rows.withColumn("before_ms", F.lag(ms).over(by)).where(F.col(ms) < F.col("before_ms")).select(key, seq, "before_ms", ms)


def sanity_violations(rows: DataFrame, row_id: str, domains: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """row, field, value of values outside their field's closed domain."""
    long = rows.select(F.col(row_id).alias("row"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi")) for f, (lo, hi) in domains.items()])).alias("x"))
    out = long.select("row", "x.*").where(F.isnan("value") | (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    return out.select("row", "field", "value")


def missingness(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Per field the number and share of nulls."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNull().cast("int").alias("missing")) for f in fields])).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"), F.avg("missing").alias("rate"))
