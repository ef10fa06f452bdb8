from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm.mixing import mix, permuted, water_fill
from tallyspark.llm.sharding import ring, settle, shard_rows
from tallyspark.llm.topk import exact_topk, gathered, heads


def test_permutations_and_targets():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    t = water_fill([100, 0, 10, 1000], [1, 2, 3, 1])
    assert abs(sum(t) - 1110) < 1e-6 and t[1] == 0 and t[2] == 30 and t[0] == 300 and abs(t[3] - 780) < 1e-6


def test_mix(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, "w " * (i * 13 % 200)) for i in range(300)] + [(5, "a", "x y"), (None, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS row", "2 AS s", "3 AS block")
    found = [mix(df, lambda i, _: 1.0 + i % 3, block=16) for _ in range(2)]
    spans = [sorted(map(tuple, f[2].select("shard", "slot", "s", "pass", "block", "start", "words").collect())) for f in found]
    assert spans[0] == spans[1]
    size = {r["row"]: r for r in found[0][0].collect()}
    taken, cells = defaultdict(int), defaultdict(set)
    for r in found[0][2].collect():
        taken[r["row"]] += r["words"]
        assert 0 <= r["start"] and r["start"] + r["words"] <= size[r["row"]]["size"]
        key = (r["row"], r["pass"])
        span = set(range(r["start"], r["start"] + r["words"]))
        assert not cells[key] & span
        cells[key] |= span
    assert all(n <= 3 * size[k]["size"] for k, n in taken.items())
    for s in found[0][1].collect():
        got = sum(n for k, n in taken.items() if size[k]["s"] == s["s"])
        assert abs(got - s["target"]) <= 40
    empty = mix(df.where("false"), lambda i, _: 1.0)
    assert empty[0].count() == empty[2].count() == 0


def test_small_sources_are_not_left_out(spark):
    df = spark.createDataFrame([(1, "a", "w " * 7), (2, "b", "w " * 2), (3, "c", "w " * 9000)], "doc_id long, source string, text string")
    rows, sources, spans = mix(df, lambda i, _: [1.0, 2.0, 1.0][i])
    taken = {r["s"]: r["n"] for r in spans.groupBy("s").agg(F.sum("words").alias("n")).collect()}
    for s in sources.collect():
        assert abs(taken[s["s"]] - s["target"]) <= max(1, s["target"] / 8)


def test_shards(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(500)] + [(None, None), (7, "t7")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS slot", "2 AS _lo", "3 AS shard", "4 AS _arc", "5 AS before_one", "6 AS lo", "7 AS row")
    out = shard_rows(df, F.col("text"), ["doc_id", "text"], shards=24)
    assert sorted(out.columns) == sorted(df.columns)
    out = out.collect()
    assert {(r["_lo"], r["_arc"], r["before_one"], r["lo"], r["row"]) for r in out} == {(2, 4, 5, 6, 7)}
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert len(out) == 502 and {len(v) for v in by.values()} <= {20, 21} and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shard_rows(df.where("false"), F.col("text"), ["doc_id", "text"]).count() == 0


def test_bounded_loads_move_little():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**62, 20000) * 2

    def shards_of(n, factor):
        places, owner = ring(n, 128)
        arc = np.searchsorted(places, keys) % len(places)
        parts = settle(np.bincount(arc, minlength=len(owner)), owner, np.full(n, int(np.ceil(factor * len(keys) / n))))
        rank = np.empty(len(keys), int)
        for a in np.unique(arc):
            rank[arc == a] = np.arange((arc == a).sum())
        out = np.full(len(keys), -1)
        for a, lo, hi, s in parts:
            out[(arc == a) & (rank >= lo) & (rank < hi)] = s
        return out

    a, b = shards_of(24, 1.25), shards_of(25, 1.25)
    assert np.bincount(a).max() <= np.ceil(1.25 * 20000 / 24) and (a != b).mean() < 0.1


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(300)]
    rows += [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [1.0, 2.0]), (None, [1.0] * 8), (304, rows[3][1]), (305, rows[3][1]), (350, []), (400, [1e30] * 8), (401, [-1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS cutoff")
    got = [tuple(r) for r in exact_topk(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect()]
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in ok:
        if q % 50 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), c) for c, b in ok if c != q)
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:5])]
    assert [g for g in got if g[0] != 400] == [w for w in sorted(want) if w[0] != 400]
    assert exact_topk(df.where("false"), lambda i: i % 50 == 0).count() == 0


def test_the_uniform_threshold_drops_most_candidates():
    """Lists give few entries of cutoff / m or more, the answers among them; their scores are exact."""
    rng = np.random.default_rng(2)
    q, c = np.floor(256 * rng.normal(0, 1, (80, 64))), np.floor(256 * rng.normal(0, 1, (4000, 64)))
    scores = q @ c.T
    cut = np.sort(scores, axis=1)[:, -6]
    for m, most in ((1, 0.0016), (2, 0.05), (4, 0.3)):
        got, entries = gathered(q, c, cut, m)
        for i, (places, known) in enumerate(got):
            want = np.flatnonzero(scores[i] >= cut[i])
            assert sorted(places.tolist()) == want.tolist() and (np.sort(known) == np.sort(scores[i, want])).all()
        assert 6 * len(q) <= entries < most * scores.size
    assert gathered(q, c, np.full(len(q), 1e12), 4)[1] == 0
    low = gathered(q, c, np.full(len(q), -1e12), 2)
    assert low[1] == scores.size and all((known == scores[i]).all() for i, (_, known) in enumerate(low[0]))


def test_heads_of_lists_give_a_safe_cutoff():
    rng = np.random.default_rng(3)
    q, c = np.floor(256 * rng.normal(0, 1, (30, 16))), np.floor(256 * rng.normal(0, 1, (500, 16)))
    parts = [q[:, :8] @ c[:, :8].T, q[:, 8:] @ c[:, 8:].T]
    for i, places in enumerate(heads(parts, 20)):
        assert 20 <= len(places) <= 40
        assert np.sort((parts[0] + parts[1])[i, places])[-5] <= np.sort((parts[0] + parts[1])[i])[-5]
    assert [len(p) for p in heads([x[:, :3] for x in parts], 20)] == [3] * 30
