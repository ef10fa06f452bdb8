from __future__ import annotations

import random
import re

from tallyspark.llm import jaccard_join as J
from tallyspark.llm.components import connected_components, extended_components
from tallyspark.llm.jaccard_join import jaccard_join

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    ws = WORDS.findall((t or "").lower())
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min(ids[find(i)]) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def result(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "1 AS component", "'x' AS set_id", "2 AS token", "3 AS n")
    got = jaccard_join(df)[0].collect()
    least = {}
    for r in got:
        if r["component"] is not None:
            least[r["component"]] = min(least.get(r["component"], r["doc_id"]), r["doc_id"])
    return sorted((r["doc_id"], r["n_shingles"], least.get(r["component"], r["doc_id"])) for r in got)


def test_families_chains_copies_and_edges(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three")]
    n = 6
    for _ in range(8):  # families of near copies, some of them chains of drifting copies
        t = [rng.choice(words) for _ in range(rng.choice([20, 60, 150]))]
        for k in range(7):
            rows.append((n, " ".join(t)))
            n += 1
            if k % 3:
                t = t[:]
                t[rng.randrange(len(t))] = rng.choice(words)
    for _ in range(12):  # unrelated documents with a common passage
        rows.append((n, " ".join([rng.choice(words) for _ in range(rng.randrange(5, 60))] + passage)))
        n += 1
    rows += [rows[10], (9999, rows[10][1])]
    assert result(spark, rows, extra=True) == sorted(brute(rows))


def test_empty_table(spark):
    assert result(spark, []) == []


def test_one_large_family_of_drifting_copies(spark, monkeypatch):
    """Answers are right, and the pairs that are tested do not grow with the family's square."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for n in range(300):  # many of them too far from the base to be linked, and from one another
        t = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 5, 7, 9])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((n if n % 50 else None, " ".join(t)))
    tested = []
    meet = J._meet
    monkeypatch.setattr(J, "_meet", lambda pairs, *a, **k: tested.append(pairs.count()) or meet(pairs, *a, **k))
    found = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS row"))[0].collect()
    want = brute([(i, t) for i, (_, t) in enumerate(rows)])
    size = lambda ids: sorted(ids.count(i) for i in set(ids))
    assert len(found) == 300 and size([r["component"] for r in found]) == size([w[2] for w in want])
    assert sum(tested) <= 4 * 300


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (-5, 200)]
    more = [(40, 100), (300, 301), (300, 301)]
    df = lambda rows: spark.createDataFrame(rows, "a long, b long")
    whole = lambda labels: sorted(sorted(r["id"] for r in labels.collect() if r["component"] == c) for c in {r["component"] for r in labels.collect()})
    labels = connected_components(df(links))
    assert {r["component"] for r in labels.collect() if 0 <= r["id"] <= 40} == {r["component"] for r in labels.where("id = 3").collect()}
    assert whole(extended_components(labels, df(more))) == whole(connected_components(df([x for x in links if None not in x] + more)))
    assert connected_components(df([])).count() == 0
