"""De-duplication, set operations, additive merges and conflict checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import row_digest


def first_by_identity(rows: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """The first row of each identity, with the number of its rows."""
    by = Window.partitionBy(*identity)
    return rows.withColumn("_rn", F.row_number().over(by.orderBy(*order))).withColumn("occurrences", F.count("*").over(by)).where("_rn = 1").drop("_rn")


def new_keys(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet."""
    return rows.join(known.select(key), key, "left_anti")


def page_collisions(rows: DataFrame, page: str, identity: str, order: str) -> DataFrame:
    """Identities with several rows in one page."""
    out = rows.groupBy(page, identity).agg(F.count("*").alias("occurrences"), F.min(order).alias("first"))
    return out.where("occurrences > 1").withColumn("excess", F.col("occurrences") - 1)


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side that the other lacks, with the side."""
    a = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("left_only"))
    b = right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("right_only"))
    return a.unionByName(b)


def multiset_label(rows: DataFrame, takers: DataFrame, key: list[str], order: str) -> DataFrame:
    """TAKER for as many rows of a key, in order, as takers has of it; MAKER_INFERRED for the rest."""
    n = takers.groupBy(*key).agg(F.count("*").alias("_takers"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    out = rows.withColumn("_place", place).join(n, key, "left")
    return out.withColumn("role", F.when(F.col("_place") <= F.coalesce("_takers", F.lit(0)), "TAKER").otherwise("MAKER_INFERRED")).drop("_place", "_takers")


def additive_merge(base: DataFrame, update: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, status: NEW, SAME, CONFLICT or KEPT, by digests of the columns."""
    a = base.select(key, row_digest(base, columns).alias("old"))
    b = update.select(key, row_digest(update, columns).alias("new"))
    status = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "KEPT").when(F.col("old") == F.col("new"), "SAME").otherwise("CONFLICT")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def snapshot_invariance(base: DataFrame, later: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of base that later lacks or that changed, with the changed columns; nulls are equal to nulls."""
    b = later.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_found"))
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]))
    out = base.join(b, key, "left").withColumn("changed", F.when(F.col("_found"), changed).otherwise(F.array().cast("array<string>")))
    status = F.when(F.col("_found").isNull(), "MISSING").when(F.size("changed") > 0, "CHANGED")
    return out.select(key, status.alias("status"), F.array_join("changed", ",").alias("changed")).where("status is not null")


def id_conflicts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per repeated id: DUPLICATE if all payloads are equal, else CONFLICT."""
    out = rows.select(key, row_digest(rows, columns).alias("digest")).groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("digest").alias("payloads"))
    return out.where("n > 1").withColumn("kind", F.when(F.col("payloads") > 1, "CONFLICT").otherwise("DUPLICATE"))


def count_contract(rows: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return rows.groupBy(key).agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("keys"))


def multiset_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with the side; missing columns are null."""
    names = list(dict.fromkeys(left.columns + right.columns))
    fill = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names])
    a, b = fill(left), fill(right)
    return a.exceptAll(b).withColumn("side", F.lit("left_only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right_only")))
