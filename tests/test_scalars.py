from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_times(spark):
    rows = spark.createDataFrame([("1700000000",), ("1700000000123",), ("2024-01-01T00:00:00Z",), ("2024-01-01 00:00:00",), ("12",), ("x",), (None,), ("2024-01-01T01:00:00+01:00",)], "t string")
    got = [r[0] for r in rows.select(S.parse_ms(F.col("t"))).collect()]
    assert got == [1700000000000, 1700000000123, 1704067200000, 1704067200000, None, None, None, 1704067200000]


def test_identity_and_codes(spark):
    lit = F.lit
    r = one(spark, a=S.trade_identity(lit("7"), [lit("x")]), b=S.trade_identity(lit(None).cast("string"), [lit("x"), lit(None)]), c=S.trade_identity(lit(""), [lit("x"), lit("")]))
    assert r["a"] == "id:7" and r["b"] == r["c"] and r["b"].startswith("ck:")
    bad = S.buy_fill_code(lit(None).cast("long"), lit(None).cast("double"), lit(0.5), lit("m"))
    r = one(spark, a=bad, b=S.buy_fill_code(lit(1), lit(0.0), lit(0.5), lit("m")), c=S.buy_fill_code(lit(1), lit(1.0), lit(1.0), lit("m")))
    assert (r["a"], r["b"], r["c"]) == ("TIMESTAMP_INVALID", "FIELD_INCOMPLETE", None)


def test_buckets_and_classes(spark):
    lit = F.lit
    left = lambda v: S.left_closed(lit(v).cast("double"), [0, 1, 2], ["a", "b", "c"])
    r = one(spark, a=left(0), b=left(1), c=left(5), d=left(None), e=left(-1))
    assert list(r.values()) == ["a", "b", "c", None, None]
    r = one(spark, a=S.right_closed(lit(0), 0, 60, 5), b=S.right_closed(lit(60), 0, 60, 5), c=S.right_closed(lit(61), 0, 60, 5), d=S.right_closed(lit(301), 0, 60, 5))
    assert list(r.values()) == [0, 0, 1, None]
    r = one(spark, a=S.lag_class(lit(100)), b=S.lag_class(lit(101)), c=S.lag_class(lit(-101)), d=S.error_class(lit("Read TIMEOUT"), [("timeout", "T"), ("read", "R")]), e=S.error_class(lit("?"), []))
    assert list(r.values()) == ["SYNCHRONOUS", "BTC_LEAD", "PM_LEAD", "T", "OTHER"]
    start, end = S.slug_window(F.lit("m-1700000100"), "m-", 300)
    r = one(spark, a=start, b=end, c=S.slug_window(F.lit("m-1700000101"), "m-", 300)[0], d=S.imbalance(F.lit(0.0), F.lit(0.0)))
    assert list(r.values()) == [1700000100000, 1700000400000, None, None]
