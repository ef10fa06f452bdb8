"""Fits against plain numpy, and cases that the given tables do not hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyspark.operators import coverage, evaluation, evidence, models, raw


def irls(x, y, ridge=1.0, steps=8):
    x = np.column_stack([np.ones(len(x)), x])
    b, pen = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pen + 1e-9 * np.eye(len(b)), x.T @ (y - p) - pen @ b)
    return b


def sample(n=400, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + a - 2 * b)))).astype(int)
    return [(i, i % 8, int(y[i]), float(a[i]), float(b[i]) if i % 10 else None) for i in range(n)]


def test_fits_equal_plain_numpy(spark):
    rows = [r for r in sample() if r[4] is not None]
    df = spark.createDataFrame(rows, "id long, period long, y int, a double, b double").withColumn("g", F.col("period") % 2)
    for r in models.fit_logistic(df, ["g"], ["a", "b"], "y").collect():
        own = [x for x in rows if x[1] % 2 == r["g"]]
        want = irls(np.array([x[3:5] for x in own]), np.array([x[2] for x in own]))
        assert np.allclose(r["coefficients"], want, atol=1e-8)
    assert models.fit_logistic(df.where("y = 1"), ["g"], ["a"], "y").count() == 0


def test_walk_forward_equals_plain_numpy(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "id long, period long, y int, a double, b double")
    predictions, coefficients = models.walk_forward(df, "period", "y", {"M0": [], "M1": ["a", "b"]}, 3, 10)
    got = {(r["fold"], r["model"], r["feature"]): r["coefficient"] for r in coefficients.collect()}
    assert {k[0] for k in got} == {3, 4, 5, 6, 7}
    for fold in (3, 7):
        train = [r for r in rows if r[1] < fold]
        middle = np.median([r[4] for r in train if r[4] is not None])
        x = []
        for j in (3, 4):
            v = np.array([r[j] for r in train if r[j] is not None])
            x += [[((r[j] if r[j] is not None else middle) - v.mean()) / v.std() for r in train], [float(r[j] is None) for r in train]]
        want = irls(np.array(x).T, np.array([r[2] for r in train]))
        assert np.allclose([got[(fold, "M1", f)] for f in ("intercept", "z_a", "m_a", "z_b", "m_b")], want, atol=1e-6)
        rate = np.mean([r[2] for r in train])
        assert all(abs(r["probability"] - rate) < 1e-6 for r in predictions.where(f"fold = {fold} and model = 'M0'").collect())
    better = {r["model"]: r["delta_brier"] for r in models.attribution(models.fold_metrics(predictions), "M0").collect()}
    assert better["M1"] < -0.05


def test_shuffled_labels_lose_what_was_learned(spark):
    df = spark.createDataFrame(sample(), "id long, period long, y int, a double, b double")
    got = {r["shuffle"]: r["auc"] for r in models.shuffle_refit(df, "id", "y", ["a", "b"], 4).collect()}
    assert got[-1] > 0.8 and all(abs(v - 0.5) < 0.15 for k, v in got.items() if k >= 0)


def test_labels_move_inside_their_period(spark):
    df = spark.createDataFrame(sample(), "id long, period long, y int, a double, b double")
    out = evaluation.shuffled_labels(df, "id", "period", "y", F.lit(3)).collect()
    assert any(r["y"] != r["shuffled"] for r in out)
    for p in range(8):
        assert sum(r["y"] for r in out if r["period"] == p) == sum(r["shuffled"] for r in out if r["period"] == p)


def test_gaps_stay_inside_their_window(spark):
    windows = spark.createDataFrame([("k", 0, 10), ("k", 100, 110), ("e", 0, 50)], "key string, start_ms long, end_ms long")
    points = spark.createDataFrame([("k", 5), ("k", 105), ("k", 60)], "key string, ms long")
    got = sorted(map(tuple, coverage.gaps(windows, points, "key", "ms", 20).collect()))
    assert got == [("e", 0, 0, 50)]
    cover = {(r["key"], r["start_ms"]): r["filled"] for r in coverage.bucket_coverage(windows, points, "key", "ms", 5).collect()}
    assert cover == {("k", 0): 1, ("k", 100): 1, ("e", 0): 0}


def test_validity_state(spark):
    import pandas as pd

    frame = lambda rows: iter([pd.DataFrame(rows, columns=["seq", "ms", "token", "price", "reset"])])
    out, state = evidence.validity_states(frame([(1, 10, 1, 0.5, False), (2, 20, 2, 0.5, False), (3, 200, 1, 0.5, False)]), None, 100, 0, 1)
    assert [s for _, s in out] == ["UNINITIALIZED", "VALID", "STALE"]
    out, state = evidence.validity_states(frame([(4, 150, 1, 0.5, False), (5, 210, 1, 0.5, False), (6, 1, 1, 0.5, True), (7, 2, 2, 0.5, False), (8, 3, 2, 1.5, False)]), state, 100, 0, 1)
    assert [s for _, s in out] == ["DESYNCED", "DESYNCED", "UNINITIALIZED", "VALID", "DESYNCED"]


def test_windows_without_files_and_metadata_without_end(spark):
    files = spark.createDataFrame([("a", "s", 0, 10), ("b", "s", 20, 30)], "file string, session_id string, first_timestamp_ms long, last_timestamp_ms long")
    windows = spark.createDataFrame([(1, "s", 12, 15), (2, "s", 25, 40), (3, "t", 0, 5)], "w long, session_id string, start_ms long, end_ms long")
    assert sorted(map(tuple, raw.files_for_windows(files, windows, "w").collect())) == [(1, "a", "PREDECESSOR"), (2, "a", "PREDECESSOR"), (2, "b", "OVERLAP")]
    body = spark.createDataFrame([('{"conditionId":"c","slug":"w-600000000","clobTokenIds":["1","2"],"outcomes":["Up","Down"]}',), ("broken",)], "body string")
    got = raw.market_metadata(body, "body", "w-", 100).collect()
    assert got[0]["market_start_ms"] == 600000000000 and got[0]["market_end_ms"] == 600000100000 and got[0]["tokens"][1]["token_id"] == "2" and got[1]["condition_id"] is None


def test_medians_are_exact_and_read_from_the_middle(spark):
    for n in (1, 2, 3, 4, 4999, 20000):
        values = [((i * 7919) % 10007) / 7 for i in range(n)]
        kept = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)] + [(0, None)], "_t int, v double")
        counts = {g: sum(i % 3 < g for i in range(n)) for g in (1, 2, 3)}
        got = models.exact_medians(kept, [1, 2, 3], "v", counts)
        assert all(abs(got[g] - np.median([v for i, v in enumerate(values) if i % 3 < g])) < 1e-9 for g in (1, 2, 3))


def test_folds_read_rows_once_for_all_models(spark, monkeypatch):
    def forbidden(*_, **__):
        raise AssertionError("a model's rows were written or fitted on their own")

    monkeypatch.setattr(models, "fit_logistic", forbidden)
    df = spark.createDataFrame(sample(), "id long, period long, y int, a double, b double")
    assert models.walk_forward(df, "period", "y", {"M0": [], "M1": ["a"], "M2": ["a", "b"]}, 3, 10)[1].count() == 5 * (1 + 3 + 5)
    predictions, coefficients = models.walk_forward(df.where("period < 3"), "period", "y", {"M1": ["a"]}, 3, 10)
    assert predictions.count() == coefficients.count() == 0
