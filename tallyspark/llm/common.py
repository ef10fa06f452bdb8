"""Helpers shared by the corpus operators: shared storage, size-checked joins, skew-safe prefix sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.files import shared_path

#: Separators of words: space and the control characters 9 to 13; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast up to this many rows of keys; beyond that the join shuffles.
BROADCAST_ROWS = 2_000_000


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def semi_join_sized(df: DataFrame, keys: DataFrame, on: str, n_keys: int) -> DataFrame:
    """Rows of df whose key is in keys: a broadcast while n_keys is small, a shuffled semi join beyond."""
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys, on, "left_semi")


def bucket_count(rows: int) -> int:
    """Buckets for two-level prefix sums: about the square root of the rows, so neither level grows large."""
    return max(16, math.isqrt(max(rows, 1)))


def prefix_sums(df: DataFrame, key: list[str], order: list[str], sizes: list[str], buckets: Column) -> DataFrame:
    """Exclusive running sums of sizes per key, named before_<size>, without bringing one key's rows together.

    Rows of a key are ordered by (bucket, *order). Sums inside a (key, bucket) and sums over a
    key's bucket totals are two windows, so that a key with a third of all rows is split by bucket.
    """
    df = df.withColumn("_bucket", buckets)
    part = df.groupBy(*key, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sizes])
    over = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*key, "_bucket", *[F.coalesce(F.sum(f"_t_{s}").over(over), F.lit(0)).alias(f"_o_{s}") for s in sizes])
    inner = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", *[F.coalesce(F.sum(s).over(inner), F.lit(0)).alias(f"_i_{s}") for s in sizes])
    same = F.lit(True)
    part = part.withColumnsRenamed({k: f"_k_{k}" for k in key} | {"_bucket": "_k_bucket"})
    for k in key:
        same = same & df[k].eqNullSafe(part[f"_k_{k}"])
    out = df.join(part, same & (df["_bucket"] == part["_k_bucket"]))
    out = out.withColumns({f"before_{s}": (F.col(f"_i_{s}") + F.col(f"_o_{s}")).cast("long") for s in sizes})
    return out.drop("_bucket", "_k_bucket", *[f"_k_{k}" for k in key], *[f"_{p}_{s}" for s in sizes for p in "io"])
