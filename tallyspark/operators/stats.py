"""Descriptive statistics, standardised differences, breaks, stability indexes and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def melt(rows: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """keep, variable, value: one row per field."""
    return rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("variable"), F.col(f).cast("double").alias("value")) for f in fields])).alias("x")).select(*keep, "x.variable", "x.value")


def describe(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Per group and field: n, missing, mean, median, sample std (0.0 for one value), quartiles (linear)."""
    p = lambda s: F.percentile("value", F.lit(s))
    std = F.when(F.count("value") > 0, F.coalesce(F.stddev_samp("value"), F.lit(0.0)))
    return melt(rows, by, fields).groupBy(*by, "variable").agg(F.count("value").alias("n"), (F.count("*") - F.count("value")).alias("missing"), F.avg("value").alias("mean"), p(0.5).alias("median"), std.alias("std"), p(0.25).alias("p25"), p(0.75).alias("p75"))


def standardised_difference(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Per field (m1 - m0) / sqrt((v1 + v0) / 2) of the rows with group true and false, sample variances.

    0.0 for equal constants, null for unequal ones or an empty group.
    """
    long = melt(rows, [group], fields)
    m = lambda g: F.avg(F.when(F.col(group) == g, F.col("value")))
    v = lambda g: F.coalesce(F.var_samp(F.when(F.col(group) == g, F.col("value"))), F.lit(0.0))
    out = long.groupBy("variable").agg(m(True).alias("m1"), m(False).alias("m0"), v(True).alias("v1"), v(False).alias("v0"))
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    smd = F.when(pooled > 0, (F.col("m1") - F.col("m0")) / F.nullif(pooled, F.lit(0.0))).when(F.col("m1") == F.col("m0"), 0.0)
    size = F.when(F.abs(smd) >= 0.5, "LARGE").when(F.abs(smd) >= 0.2, "MODERATE").when(smd.isNotNull(), "SMALL")
    return out.select("variable", "m1", "m0", smd.alias("smd"), size.alias("magnitude"))


def concentration(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts of every value of every dimension in one pass (grouping sets), with its share."""
    sets = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x")).select("x.*")
    out = sets.groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dimension")))


def week_over_week(rates: DataFrame, period: str, rate: str) -> DataFrame:
    """rates with the change to the period before, the mean, the population std, and whether a rate is beyond two of it."""
    by = Window.orderBy(period)
    whole = Window.partitionBy()
    out = rates.withColumn("delta", F.col(rate) - F.lag(rate).over(by)).withColumn("mean", F.avg(rate).over(whole)).withColumn("std", F.stddev_pop(rate).over(whole))
    return out.withColumn("extreme", F.abs(F.col(rate) - F.col("mean")) > 2 * F.col("std"))


def cusum_break(rates: DataFrame, group: str, period: str, value: str, least: int = 2) -> DataFrame:
    """Per group the period where the absolute running sum of z scores is largest, inside segments of least periods."""
    part = Window.partitionBy(group)
    z = (F.col(value) - F.avg(value).over(part)) / F.nullif(F.stddev_pop(value).over(part), F.lit(0.0))
    out = rates.withColumn("_z", z).withColumn("_n", F.count("*").over(part)).withColumn("_i", F.row_number().over(part.orderBy(period)))
    out = out.withColumn("cusum", F.sum("_z").over(part.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)))
    inner = out.where((F.col("_i") >= least) & (F.col("_i") <= F.col("_n") - least))
    best = F.min_by(F.struct(period, "cusum", "_n"), F.struct(-F.round(F.abs("cusum"), 9), F.col(period)))
    out = inner.groupBy(group).agg(best.alias("b"))
    return out.select(group, F.col(f"b.{period}").alias("break_at"), F.col("b.cusum").alias("cusum"), (F.abs("b.cusum") >= F.greatest(F.lit(1.5), F.sqrt("b._n"))).alias("found"))


def split_break(rates: DataFrame, group: str, period: str, value: str, least: int = 2) -> DataFrame:
    """Per group the split with the largest difference of means before and after, in population stds."""
    part = Window.partitionBy(group)
    by = part.orderBy(period)
    out = rates.withColumn("_n", F.count("*").over(part)).withColumn("_i", F.row_number().over(by)).withColumn("_sd", F.stddev_pop(value).over(part))
    out = out.withColumn("_a", F.avg(value).over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_b", F.avg(value).over(by.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("score", F.abs(F.col("_b") - F.col("_a")) / F.nullif("_sd", F.lit(0.0))).where((F.col("_i") > least) & (F.col("_i") <= F.col("_n") - least + 1))
    best = F.min_by(F.struct(period, "score"), F.struct(-F.round("score", 9), F.col(period)))
    return out.groupBy(group).agg(best.alias("b")).select(group, F.col(f"b.{period}").alias("split_at"), F.col("b.score").alias("score"), (F.col("b.score") >= 1).alias("found"))


def stability_index(rows: DataFrame, period: str, value: str, first: Column, bins: int = 10) -> DataFrame:
    """PSI of every period against the rows that first names: unique quantile edges of these, open ends, shares from 1e-6 on."""
    shares = [i / bins for i in range(1, bins)]
    edges = rows.where(first).agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(s) for s in shares]))).alias("edges"))
    placed = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(value))))
    base = placed.where(first).groupBy("bin").agg(F.count("*").alias("e"))
    seen = placed.groupBy(period, "bin").agg(F.count("*").alias("a"))
    all_bins = edges.select(F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    frame = seen.select(period).distinct().crossJoin(F.broadcast(all_bins)).join(seen, [period, "bin"], "left").join(F.broadcast(base), "bin", "left").fillna(0, ["a", "e"])
    part = Window.partitionBy(period)
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(part), F.lit(1e-6))
    out = frame.withColumn("pa", share("a")).withColumn("pe", share("e"))
    return out.groupBy(period).agg(F.sum((F.col("pa") - F.col("pe")) * F.log(F.col("pa") / F.col("pe"))).alias("psi"))


def drift_label(psi: Column) -> Column:
    return F.when(psi >= 0.25, "MAJOR").when(psi >= 0.1, "MODERATE").when(psi.isNotNull(), "STABLE")


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """An order-free digest of a table: number of rows and the sum of their hashes."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64(*columns), F.lit(1 << 40))).cast("decimal(38,0)").alias("digest"))
