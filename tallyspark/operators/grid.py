"""Regular grids over event streams and lead-lag measures on them.

A grid's steps and lags are exploded, which the planner's sizes leave out: joins of them are hinted to merge, never to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import left_closed
from tallyspark.operators.temporal_joins import asof_backward

SHOCK_CUTS, SHOCK_NAMES = [0.0, 1.0, 2.0, 5.0, 10.0], ["0-1", "1-2", "2-5", "5-10", ">10"]


def build_grid(spans: DataFrame, ticks: DataFrame, book: DataFrame, key: str, step_ms: int, stale_ms: int) -> DataFrame:
    """One row per step of each span [start_ms, end_ms): the last tick price, and the last book mid that is not stale.

    ticks: key, ms, price, seq; book: key, ms, mid, seq. i numbers the steps of a span.
    """
    steps = F.posexplode(F.sequence(F.col("start_ms"), F.col("end_ms") - 1, F.lit(step_ms).cast("long")))
    grid = spans.where("end_ms > start_ms").select(key, steps.alias("i", "ms"))
    grid = asof_backward(grid, ticks, key, "ms", ["price"], ["seq"]).drop("age_ms")
    return asof_backward(grid, book, key, "ms", ["mid"], ["seq"], stale_ms).withColumnRenamed("age_ms", "book_age_ms")


def grid_features(grid: DataFrame, key: str, lags: list[int], rolling: int) -> DataFrame:
    """Change of the price in basis points over lags of steps, its shock bucket, and the sample std of a full rolling window."""
    by = Window.partitionBy(key).orderBy("i")
    out = grid
    for k in lags:
        out = out.withColumn(f"bp_{k}", (F.col("price") / F.lag("price", k).over(by) - 1) * 10000)
    span = by.rowsBetween(1 - rolling, 0)
    std = F.when(F.count("price").over(span) == rolling, F.stddev_samp("price").over(span))
    return out.withColumn("rolling_std", std).withColumn("shock", left_closed(F.abs(F.col(f"bp_{lags[0]}")), SHOCK_CUTS, SHOCK_NAMES))


def response_curve(features: DataFrame, key: str, shock_bp: str, horizons: list[int], least_bp: float = 1.0) -> DataFrame:
    """Signed change of the mid after shocks, per shock bucket and horizon in steps: n, mean, median."""
    shocks = features.where(F.abs(F.col(shock_bp)) >= least_bp).select(key, "i", "shock", F.signum(shock_bp).alias("sign"), F.col("mid").alias("mid0"))
    shocks = shocks.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("j", F.col("i") + F.col("horizon"))
    later = features.select(key, F.col("i").alias("j"), F.col("mid").alias("mid1"))
    met = shocks.join(later.hint("merge"), [key, "j"]).withColumn("response", F.col("sign") * (F.col("mid1") - F.col("mid0"))).where("response is not null")
    return met.groupBy("shock", "horizon").agg(F.count("*").alias("n"), F.avg("response").alias("mean"), F.percentile("response", F.lit(0.5)).alias("median"))


def cross_correlation(features: DataFrame, key: str, lags: list[int]) -> DataFrame:
    """Correlation of the price's change with the mid's change lag steps later, per key and lag; null for two pairs or fewer, or where one side never changes.

    A lag is a frame of one step, so that no lag is exploded or joined; a key's sums stay where its window was.
    """
    by = Window.partitionBy(key).orderBy("i")
    moves = features.select(key, "i", (F.col("price") / F.lag("price", 1).over(by) - 1).alias("dx"), (F.col("mid") - F.lag("mid", 1).over(by)).alias("dy"))
    later = moves.select(key, "dx", *[F.first("dy").over(by.rangeBetween(x, x)).alias(f"_y{k}") for k, x in enumerate(lags)])
    sums = []
    for k in range(len(lags)):
        y, x = F.when(F.col("dx").isNotNull(), F.col(f"_y{k}")), F.when(F.col(f"_y{k}").isNotNull(), F.col("dx"))
        # corr() divides by zero where a side is constant; least and greatest tell that without rounding
        varies = (F.count(y) > 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        sums += [F.count(y).alias(f"_n{k}"), F.when(varies, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).alias(f"_c{k}")]
    each = F.inline(F.array(*[F.struct(F.lit(x).alias("lag"), F.col(f"_n{k}").alias("n"), F.col(f"_c{k}").alias("corr")) for k, x in enumerate(lags)]))
    return later.groupBy(key).agg(*sums).select(key, each).where("n > 0")


def lagged_regression(features: DataFrame, key: str, lags: list[int], horizon: int) -> DataFrame:
    """OLS of the mid's change over a horizon on the price's change lag steps before, per lag over all keys."""
    by = Window.partitionBy(key).orderBy("i")
    x = features.select(key, "i", (F.col("price") / F.lag("price", 1).over(by) - 1).alias("x"), (F.lead("mid", horizon).over(by) - F.col("mid")).alias("y"))
    left = x.select(key, "x", F.explode(F.array(*[F.lit(v) for v in lags])).alias("lag"), "i").withColumn("j", F.col("i") + F.col("lag"))
    met = left.join(x.select(key, F.col("i").alias("j"), "y").hint("merge"), [key, "j"]).where("x is not null and y is not null")
    return met.groupBy("lag").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.regr_r2("y", "x").alias("r2"))


def peak(rows: DataFrame, key: str, lag: str, value: str) -> DataFrame:
    """The lag of the largest absolute value per key; ties go to the smaller absolute lag, then the smaller lag."""
    best = F.min_by(F.struct(lag, value), F.struct(-F.abs(F.col(value)), F.abs(F.col(lag)), F.col(lag)))
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(best.alias("b")).select(key, f"b.{lag}", f"b.{value}")


def latency_statistics(rows: DataFrame, by: list[str], delay: str, limits: list[int]) -> DataFrame:
    """Percentiles, median absolute deviation, interquartile range and shares above limits of a delay per group."""
    middle = rows.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(F.percentile(delay, F.lit(0.5)).alias("_m"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    both = rows.join(middle, same) if by else rows.crossJoin(F.broadcast(middle))
    p = lambda s: F.percentile(delay, F.lit(s))
    shares = [F.avg((F.col(delay) > x).cast("double")).alias(f"above_{x}") for x in limits]
    return both.groupBy(*by).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max(delay).alias("most"), F.percentile(F.abs(F.col(delay) - F.col("_m")), F.lit(0.5)).alias("mad"), (p(0.75) - p(0.25)).alias("iqr"), *shares)


def grid_quality(grid: DataFrame, step_ms: int) -> DataFrame:
    """Rows, share of rows with a mid, share without a price."""
    return grid.agg(F.lit(step_ms).alias("step_ms"), F.count("*").alias("n"), F.avg(F.col("mid").isNotNull().cast("double")).alias("valid_rate"), F.avg(F.col("price").isNull().cast("double")).alias("missing_rate"))
