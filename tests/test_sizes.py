"""Plans at size: what an explode makes many is never broadcast, and places are counted in blocks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyspark.operators import evaluation, evidence, grid


def broadcasts(df) -> list[int]:
    """Rows of every broadcast of df, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [round(float(n)) for n in re.findall(r"BroadcastQueryStage.*rowCount=([0-9.E+]+)", plan)]


def test_bootstrap_broadcasts_no_draws(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 7 - 2.5).alias("v"))
    out = evidence.market_bootstrap(rows, "id", "v", 50)
    assert max(broadcasts(out), default=0) <= 3000
    draws = [[(b * 1103515245 + i * 12345 + b * i * 40503) % 2147483647 % 3000 % 7 - 2.5 for i in range(3000)] for b in range(50)]
    means = sorted(sum(d) / 3000 for d in draws)
    r = out.first()
    assert r["n"] == 3000 and means[0] <= r["low"] <= means[2] and means[-3] <= r["high"] <= means[-1] and r["positive"] == sum(m > 0 for m in means) / 50
    assert evidence.market_bootstrap(rows.where("id < 9"), "id", "v", 50).first()["low"] is None


def test_grid_steps_are_not_broadcast(spark):
    spans = spark.range(40).select(F.col("id").cast("string").alias("k"), F.lit(0).cast("long").alias("start_ms"), F.lit(500).cast("long").alias("end_ms"))
    ticks = spark.range(4000).select((F.col("id") % 40).cast("string").alias("k"), (F.col("id") % 500).alias("ms"), (100 + F.col("id") % 9).cast("double").alias("price"), F.col("id").alias("seq"))
    steps = grid.build_grid(spans, ticks, ticks.withColumnRenamed("price", "mid"), "k", 1, 1000)
    out = grid.cross_correlation(steps, "k", [-1, 0, 1])
    assert max(broadcasts(out), default=0) <= 40
    assert out.count() == 120


def test_permuted_labels_are_not_broadcast_and_blocks_do_not_matter(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("s"), "id", (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") / 3000).alias("p"))
    whole = evaluation.permuted_labels(rows, "id", "y", 4, ["s"])
    assert max(broadcasts(whole), default=0) < 3000
    got = {tuple(r) for r in whole.select("id", "s", "shuffle", "label").collect()}
    assert len(got) == 12000 and {(r[0], r[1]) for r in got} == {(r["id"], r["s"]) for r in rows.collect()}
    assert got == {tuple(r) for r in evaluation.permuted_labels(rows, "id", "y", 4, ["s"], block=8).select("id", "s", "shuffle", "label").collect()}
    assert sum(r[3] for r in got if r[2] == 2 and r[1] is None) == rows.where("s is null and y = 1").count()
    assert evaluation.permuted_labels(rows.where("id < 0"), "id", "y", 2, ["s"]).count() == 0
    assert evaluation.permuted_labels(rows, "id", "y", 2, keep=["p"]).where("p = id / 3000").count() == 6000


def test_tasks_rise_with_rows(spark):
    from tallyspark.sources.files import dealt

    rows = spark.range(3000)
    assert dealt(rows, 3000, "id").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    assert dealt(rows, 3000, "id", per_task=100).rdd.getNumPartitions() == 30


def shuffled_bytes(spark) -> int:
    """What tasks have written for shuffles since the session began."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_shuffle_control_deals_no_row_once_a_shuffle(spark):
    rows = spark.range(40_000).select("id", (F.col("id") % 40).cast("string").alias("s"), (F.col("id") % 7 < 2).cast("int").alias("y"), (F.col("id") * 37 % 1000 / 1000).alias("p"))
    used = []
    for k in (4, 16):
        start = shuffled_bytes(spark)
        assert evaluation.shuffle_control(rows, "id", "s", "y", "p", k).first()["shuffles"] == k
        used.append(shuffled_bytes(spark) - start)
    assert used[1] < 2 * used[0], used


def test_permuted_sums_are_those_of_permuted_labels(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("s"), F.when(F.col("id") != 8, F.col("id")).alias("id"), (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 50 / 2).alias("p"))
    labels = evaluation.permuted_labels(rows, "id", "y", 5, ["s"], ["p"])
    want = {tuple(r) for r in labels.groupBy("s", "shuffle").agg(F.count("*"), F.sum("label").cast("double"), F.sum(F.col("label") * F.col("p"))).collect()}
    columns = ["s", "shuffle", "n", "labels", "total"]
    for settings in ({}, {"whole": 0}, {"whole": 0, "block": 8, "step": 1}, {"whole": 999, "block": 100, "step": 7000}):
        assert {tuple(r) for r in evaluation.permuted_sums(rows, "id", "y", "p", 5, ["s"], **settings).select(*columns).collect()} == want, settings
    assert evaluation.permuted_sums(rows.where("id < 0"), "id", "y", "p", 5, ["s"]).count() == 0


def test_equal_hashes_beyond_64_bits_go_by_the_rest():
    import numpy as np
    import pyarrow as pa

    def batch(hashes, row, v):
        n = len(hashes)
        return pa.record_batch([pa.array(np.zeros(n, "i8")), pa.array(np.full(n, row)), pa.array(hashes, pa.binary()), pa.array(v), pa.array(np.zeros(n, "i8"))], ["g", "row", "h", "v", "start"])

    one, two = b"\x80" + b"\0" * 7 + b"\x02" + b"\0" * 7, b"\x80" + b"\0" * 7 + b"\x01" + b"\0" * 7
    out = list(evaluation.met_places(iter([batch([one, two], True, [5.0, 3.0]), batch([b"\1" * 16, b"\2" * 16], False, [1.0, 0.0])]), 16, 2))
    assert [r for b in out for r in b.to_pylist()] == [{"of": 0, "place": -1, "row": True, "v": 3.0}]
    assert list(evaluation.whole_sums(iter([]), 2, 1)) == []


def test_shuffle_control_leaves_out_rows_without_a_period(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("s"), F.when(F.col("id") % 5 != 0, (F.col("id") % 4 == 0).cast("int")).alias("y"), F.when(F.col("id") % 11 != 0, F.col("id") % 50 / 2).alias("p"))
    got = evaluation.shuffle_control(rows, "id", "s", "y", "p", 3).first()
    mixed = evaluation.permuted_labels(rows.where("s is not null"), "id", "y", 3, ["s"], ["p"])
    want = evaluation.auc(mixed.withColumn("p", F.coalesce("p", F.lit(99.0))), ["shuffle", "s"], "label", "p").groupBy("shuffle").agg(F.avg("auc").alias("a")).agg(F.avg("a"), F.max("a")).first()
    assert abs(got["mean"] - want[0]) < 1e-12 and abs(got["most"] - want[1]) < 1e-12
