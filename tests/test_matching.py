"""Nearest earlier rows and permutations against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import matching, models


@pytest.mark.parametrize(("size", "cases_size"), [(512, 64), (8, 4), (16, 1)])
def test_nearest_earlier_rows_are_exact(spark, size, cases_size):
    rng = random.Random(size)
    make = lambda n, start: [(start + i, rng.choice("aaab"), rng.randrange(500), rng.choice([None, *(rng.gauss(0, 5) for _ in range(9))]), float(rng.randrange(4))) for i in range(n)]
    cases, pool = make(60, 0), make(500, 1000)
    cases.append((99, None, 400, 1.0, 1.0))
    frame = lambda rows: spark.createDataFrame(rows, "id long, k string, ms long, x double, y double")
    got = sorted(tuple(r) for r in matching.nearest_earlier(frame(cases), frame(pool), "k", "ms", ["x", "y"], "id", "id", 5, size, cases_size).collect())
    want = []
    for c in cases:
        near = sorted((round(abs((c[3] or 0) - (p[3] or 0)) + abs(c[4] - p[4]), 9), p[0]) for p in pool if p[1] == c[1] and p[2] < c[2])[:5]
        want += [(c[0], p, d, i + 1) for i, (d, p) in enumerate(near)]
    assert got == sorted(want)


def test_bounds_rule_blocks_out(spark):
    pool = spark.range(4000).select("id", F.lit("k").alias("k"), F.col("id").alias("ms"), ((F.col("id") * 7919) % 4000).cast("double").alias("x"))
    cases = spark.range(50).select("id", F.lit("k").alias("k"), F.lit(10_000).alias("ms"), (F.col("id") * 79 + 50.4).alias("x"))
    out = matching.nearest_earlier(cases, pool, "k", "ms", ["x"], "id", "id", 3, 64, 4)
    plan = out._jdf.queryExecution()
    rows = out.collect()
    assert len(rows) == 150 and all(abs(r.distance - [0.4, 0.6, 1.4][r["rank"] - 1]) < 1e-9 for r in rows)
    made = [int(line.split(":")[1].replace(",", "").split()[0]) for line in str(plan.executedPlan().treeString()).splitlines() if "number of output rows:" in line]
    assert not made or max(made) < 50 * 4000
    levels = matching._levels(pool, ["x"])
    blocks = matching._blocks(pool, "k", "ms", ["x"], levels, "id", 64)
    assert blocks.groupBy("_block").count().agg(F.max("count")).first()[0] == 64
    spans = blocks.groupBy("_block").agg((F.max("x") - F.min("x")).alias("s")).agg(F.avg("s")).first()[0]
    assert spans < 400  # like rows share a block


def test_permutations_keep_every_rate(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), int(rng.random() < 0.3)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, s string, y int")
    out = models.permuted_labels(df, "id", "y", 4, ["s"]).collect()
    assert len(out) == 2000 and len({(r.id, r["shuffle"]) for r in out}) == 2000
    want = Counter((s, y) for _, s, y in rows)
    for k in range(4):
        own = [r for r in out if r["shuffle"] == k]
        assert Counter((r.s, r.label) for r in own) == want
        assert sum(r.label != rows[r.id][2] for r in own) > 50
    whole = models.permuted_labels(df, "id", "y", 2).collect()
    assert all(Counter(r.label for r in whole if r["shuffle"] == k) == Counter(y for *_, y in rows) for k in range(2))


def test_folds_are_stretches_of_each_class(spark):
    rows = [(i, i % 3 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, y boolean").withColumn("g", F.lit(1))
    got = {r.id: r.fold for r in models.stratified_folds(df, ["g"], "y", "id", 5, 16).collect()}
    for y in (True, False):
        ids = [i for i, v in rows if v == y]
        assert [got[i] for i in ids] == [k * 5 // len(ids) for k in range(len(ids))]


def test_summary_of_shuffles(spark):
    df = spark.createDataFrame([(-1, 0.9)] + [(i, 0.5) for i in range(10)], "shuffle int, auc double")
    r = models.shuffle_summary(df).first()
    assert (r.shuffles, r.auc_mean, r.auc_max, r.status) == (10, 0.5, 0.5, "PASS")
    assert models.shuffle_summary(df.withColumn("auc", F.lit(0.6))).first().status == "FAIL"
