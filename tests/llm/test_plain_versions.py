"""The language network and the ring against plain loops."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import language_id as L
from tallyspark.llm.sharding import ring, shard_rows


def plain_probabilities(model, text):
    """Mean over windows of the softmax over the largest response of each filter, byte by byte."""
    raw = text.encode()
    total, windows = [0.0] * len(model.languages), range(0, len(raw), L.WINDOW)
    for start in windows:
        b = [raw[i] if i < len(raw) else 0 for i in range(start, start + L.WINDOW + max(L.WIDTHS) - 1)]
        x = []
        for width, conv in zip(L.WIDTHS, model.conv, strict=True):
            for f in range(L.FILTERS):
                x.append(max(0.0, max(sum(float(conv[j][b[t + j]][f]) for j in range(width)) for t in range(L.WINDOW))))
        z = [float(model.bias[k]) + sum(v * float(model.out[i][k]) for i, v in enumerate(x)) for k in range(len(model.languages))]
        e = [math.exp(v - max(z)) for v in z]
        total = [t + v / sum(e) for t, v in zip(total, e, strict=True)]
    return [t / len(windows) for t in total]


def test_predictions_equal_a_plain_network(spark):
    model = L.ByteCNN(["de", "en", "fr"], 3)
    rng = np.random.default_rng(1)
    windows = rng.integers(97, 123, (90, L.WINDOW + 3)).astype(np.uint8)
    model.fit(windows, np.arange(90) % 3, 0)
    texts = ["und der die", "Été à la plage " * 30, "x" * 300, "the end", "ß" * 128 + "tail"]
    got = {r.text: (r.lang_pred, r.score) for r in L.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    for t in texts:
        p = plain_probabilities(model, t)
        assert got[t][0] == model.languages[int(np.argmax(p))] and abs(got[t][1] - max(p)) < 1e-4, t


def test_rows_take_the_shards_of_a_plain_ring(spark):
    """Row by row: each goes to its arc's shard while that has room, the others clockwise to the next with room."""
    shards, nodes = 5, 6
    df = spark.range(233).select("id", (F.col("id") % 90).alias("k"))
    places, owner = ring(shards, nodes)
    at = {r.id: r.p for r in df.select("id", F.shiftrightunsigned(F.xxhash64("k", F.lit("ring")), 1).alias("p")).collect()}
    arc = {i: bisect_left(places.tolist(), p) % len(places) for i, p in at.items()}
    for factor in (1.0, 1.3):
        room = [233 // shards + (s < 233 % shards) if factor <= 1 else math.ceil(factor * 233 / shards) for s in range(shards)]
        want, rest = Counter(), []
        for a in range(len(places)):
            for i in sorted(i for i in arc if arc[i] == a):
                if room[owner[a]]:
                    room[owner[a]] -= 1
                    want[a, int(owner[a])] += 1
                else:
                    rest.append(a)
        for a in rest:
            s = next(int(owner[(a + d) % len(places)]) for d in range(1, len(places) + 1) if room[owner[(a + d) % len(places)]])
            room[s] -= 1
            want[a, s] += 1
        out = shard_rows(df, F.col("k"), ["id"], shards, nodes, factor).collect()
        assert Counter((arc[r.id], r.shard) for r in out) == want
        for s in range(shards):
            assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(n for (_, t), n in want.items() if t == s)))
