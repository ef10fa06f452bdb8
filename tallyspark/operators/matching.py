"""Nearest earlier rows of the same key by L1 distance, exactly, with blocks that bounds rule out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.scans import time_block, two_level

#: Levels of a feature in the order that puts like rows into one block: 2 to the power of this.
LEVEL_BITS = 4


def _levels(rows: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """Bounds of the levels of each feature, a few numbers; only the order of rows depends on them."""
    n = 1 << LEVEL_BITS
    got = rows.agg(*[F.percentile_approx(f, [i / n for i in range(1, n)], 1000).alias(f) for f in features]).first()
    return {f: sorted(set(got[f] or [])) for f in features}


def _place(features: list[str], levels: dict[str, list[float]]) -> Column:
    """A number whose first bits are the first bits of all features' levels, and so on (a Z-order)."""
    at = {f: reduce(lambda a, b: a + b, [(F.col(f) >= b).cast("long") for b in levels[f]], F.lit(0).cast("long")) for f in features}
    bits = [F.shiftleft(F.shiftright(at[f], b).bitwiseAND(F.lit(1)), b * len(features) + i) for b in range(LEVEL_BITS) for i, f in enumerate(features)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _blocks(rows: DataFrame, key: str, ms: str, features: list[str], levels: dict[str, list[float]], id_: str, size: int) -> DataFrame:
    """rows with _block: about `size` rows of a key with like features, those of the same level by time."""
    placed = rows.withColumn("_z", _place(features, levels))
    counted = two_level(placed, [key], F.struct(F.col("_z").alias("z"), time_block(ms).alias("d")), ["_z", ms, id_], {"_n": ("sum", F.lit(1))})
    return counted.withColumn("_block", F.floor((F.col("_n") - 1) / size)).drop("_z", "_n")


def nearest_earlier(cases: DataFrame, pool: DataFrame, key: str, ms: str, features: list[str], case_id: str, pool_id: str, n: int, size: int = 512, cases_size: int = 64) -> DataFrame:
    """case, control, distance, rank: for each case the n rows of pool with the same key and an earlier time that are nearest by L1 distance; ties go to the smaller id.

    Null features count as 0, as rows without key or time match nothing. Cases and pool are dealt into blocks of like
    rows. For a block of cases, the blocks of the pool that are wholly earlier bound the n-th distance from above;
    a block whose least possible distance is larger holds no match and is left out. What is left is joined by block,
    and each case keeps its best n rows of every block before blocks meet.
    """
    zero = lambda df: df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    a = zero(cases.select(F.col(case_id).alias("case"), key, F.col(ms).alias("_t"), *features)).where(F.col(key).isNotNull() & F.col("_t").isNotNull())
    b = zero(pool.select(F.col(pool_id).alias("control"), key, F.col(ms).alias("_t"), *features)).where(F.col(key).isNotNull() & F.col("_t").isNotNull())
    levels = _levels(b, features)
    a = _blocks(a, key, "_t", features, levels, "case", cases_size).withColumnRenamed("_block", "_g")
    b = _blocks(b, key, "_t", features, levels, "control", size)
    box = lambda p: [x for f in features for x in (F.min(f).alias(f"_{p}lo_{f}"), F.max(f).alias(f"_{p}hi_{f}"))] + [F.min("_t").alias(f"_{p}t0"), F.max("_t").alias(f"_{p}t1")]
    ga, gb = a.groupBy(key, "_g").agg(*box("a")), b.groupBy(key, "_block").agg(F.count("*").alias("_m"), *box("b"))
    zero_, c = F.lit(0.0), F.col
    low = reduce(lambda x, y: x + y, [F.greatest(c(f"_alo_{f}") - c(f"_bhi_{f}"), c(f"_blo_{f}") - c(f"_ahi_{f}"), zero_) for f in features])
    high = reduce(lambda x, y: x + y, [F.greatest(c(f"_ahi_{f}") - c(f"_blo_{f}"), c(f"_bhi_{f}") - c(f"_alo_{f}")) for f in features])
    met = ga.join(gb, key).where("_bt0 < _at1").select(key, "_g", "_block", "_m", low.alias("_low"), F.when(c("_bt1") < c("_at0"), high).alias("_high"))
    by = Window.partitionBy(key, "_g").orderBy(F.asc_nulls_last("_high"), "_block").rowsBetween(Window.unboundedPreceding, 0)
    enough = F.min(F.when(c("_upto") >= n, c("_high"))).over(Window.partitionBy(key, "_g"))
    met = met.withColumn("_upto", F.sum("_m").over(by)).withColumn("_cut", enough).where(c("_cut").isNull() | (c("_low") <= c("_cut") + 1e-9)).select(key, "_g", "_block")
    right = b.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), "control", F.col("_t").alias("_u"), *[F.col(f).alias(f"_p_{f}") for f in features])
    pairs = a.join(met, [key, "_g"]).join(right, (c(key) == c("_k")) & (c("_block") == c("_b"))).where("_u < _t")
    distance = reduce(lambda x, y: x + y, [F.abs(c(f) - c(f"_p_{f}")) for f in features])
    pairs = pairs.select("case", "_block", "control", F.round(distance, 9).alias("distance"))
    best = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "control"))).where(F.col("rank") <= n)
    return best(best(pairs, "case", "_block"), "case").select("case", "control", "distance", "rank")
