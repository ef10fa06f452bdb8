"""Two-level running values against plain loops: small blocks, hot keys, ties and null keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import coverage, scans
from tallyspark.operators.evidence import online_regimes
from tallyspark.operators.temporal_joins import asof_backward, asof_forward


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values(spark, inclusive):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(300), i, rng.choice([None, rng.randrange(100)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ms long, i long, x long")
    kinds = {n: (n, F.col("x")) for n in ("sum", "max", "last")}
    got = {r.i: (r["sum"], r["max"], r["last"]) for r in scans.two_level(df, ["k"], scans.time_block("ms", 7), ["ms", "i"], kinds, inclusive).collect()}
    for k in ("a", "b", None):
        seen = []
        for _, _, i, x in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if inclusive and x is not None:
                seen.append(x)
            assert got[i] == ((sum(seen), max(seen), seen[-1]) if seen else (None,) * 3)
            if not inclusive and x is not None:
                seen.append(x)


def test_one_key_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(3000).select(F.lit("hot").alias("k"), (F.col("id") * 1_000_000 + 5).alias("ms"))
        right = spark.range(3000).select(F.lit("hot").alias("k"), (F.col("id") * 1_000_000).alias("ms"), F.col("id").alias("v"))
        for out in (asof_backward(left, right, "k", "ms", ["v"]), asof_forward(left, right, "k", "ms", ["v"], -5)):
            assert out.where("v * 1000000 + 5 = ms").count() == 3000
            assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        held = coverage.merged_intervals(right.select("k", F.col("ms").alias("lo_ms"), (F.col("ms") + F.when(F.col("v") % 500 == 499, 10).otherwise(1_000_000)).alias("hi_ms")), "k")
        assert sorted(tuple(r)[1:] for r in held.select("k", "lo_ms", "hi_ms").collect()) == [(i * 500_000_000, (i * 500 + 499) * 1_000_000 + 10) for i in range(6)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def plain_ledger(fills):
    pos = cost = pnl = 0.0
    bad = 0
    for _, _, side, qty, price in fills:
        average = cost / pos if pos > 0 else 0.0
        if side == "BUY":
            pos, cost = pos + qty, cost + qty * price
        elif qty <= pos + 1e-9:
            pos = max(pos - qty, 0.0)
            pnl, cost = pnl + qty * (price - average), average * pos
        else:
            bad += 1
    return pos, cost, pnl, bad


def test_average_cost_by_blocks_equals_the_fold(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for k in ("clean", "sold out", "bad", "buys", "hot"):
        held, own = 0.0, []
        for i in range(600 if k == "hot" else 80):
            qty, price = rng.randrange(1, 20) / 2, rng.randrange(1, 99) / 100
            sell = k != "buys" and rng.random() < 0.5 and (k == "bad" or qty <= held)
            if k == "sold out" and held and rng.random() < 0.2:
                sell, qty = True, held
            own.append((rng.randrange(40) + i * 10, i, "SELL" if sell else "BUY", qty, price))
            held += -qty if sell else qty
        own.sort()
        if k != "bad":  # order may have changed: keep only what leaves no violation
            kept, held = [], 0.0
            for f in own:
                if f[2] == "BUY" or f[3] <= held:
                    kept.append(f)
                    held += f[3] if f[2] == "BUY" else -f[3]
            own = kept
        want[k] = plain_ledger(own)
        rows += [(k, *f) for f in own]
    df = spark.createDataFrame(rows, "k string, ms long, seq long, side string, qty double, price double")
    marked = {r.k for r in scans.settled_positions(df, "k", ["ms", "seq"], 50).where("clean").select("k").distinct().collect()}
    assert marked == set(want) - {"bad"} and want["bad"][3] > 0
    for block in (50, 700, 10**9):
        got = {r.k: (r.pos, r.cost, r.pnl, r.bad) for r in scans.average_cost(df, "k", ["ms", "seq"], block).collect()}
        assert set(got) == set(want)
        for k, r in got.items():
            assert r == pytest.approx(want[k], abs=1e-9), (k, block)


def plain_regimes(rows, past, after, step):
    out, known, anchor, regime = {}, [], None, 0
    for ms in sorted({r[0] for r in rows}):
        seen = [y for _, y in known if y is not None]
        last = [y for _, y in known[-past:] if y is not None]
        if len(seen) >= after:
            rate = sum(last) / len(last)
            if anchor is None:
                anchor = rate
            elif abs(rate - anchor) >= step - 1e-12:
                anchor, regime = rate, regime + 1
        out[ms] = (len(seen), regime)
        known += [(r[0], r[2]) for r in sorted(rows) if r[0] == ms]
        known = [(a, b) for a, b in known]
    return out


@pytest.mark.parametrize("block", [10, 37, 100_000])
def test_regimes_by_blocks_equal_the_fold(spark, block):
    rng = random.Random(6)
    rows = []
    for u in ("a", "b", "few"):
        for i in range(5 if u == "few" else 400):
            p = 0.2 if i // 90 % 2 else 0.8
            rows.append((u, rng.randrange(300) + i * (u == "a"), i, rng.choice([None] + 9 * [int(rng.random() < p)])))
    df = spark.createDataFrame(rows, "u string, ms long, seq long, y int")
    got = {(r.u, r.ms): (r.seen, r.regime) for r in online_regimes(df, "u", "ms", "y", 10, 6, 0.3, "seq", block).collect()}
    for u in ("a", "b", "few"):
        want = plain_regimes([r[1:] for r in rows if r[0] == u], 10, 6, 0.3)
        assert {ms: v for (w, ms), v in got.items() if w == u} == want
    assert max(r for _, r in got.values()) > 3
