"""Exact top-k inner products by a three-phase uniform threshold over slices of the vectors.

A score is the sum of partial scores over m slices of the components; each slice gives a query a list of
candidates by partial score. Phase 1: of one block of candidates, the query's home, the heads of its m lists
are gathered and their scores summed up; the k-th best is a cutoff t that no answer falls below. Phase 2: t
goes with the query to all blocks, and every list gives its entries of t/m or more: the largest part of a
score is at least its mean, so each answer is in one list at least. A block is skipped where the norms of a
slice cannot reach t/m. Phase 3: of what was gathered the parts in other lists are added, so that scores are
exact; the rest is never summed up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and candidates that meet in one task, and queries scored at once.
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
AT_ONCE = 64
#: Entries of a list's head, times k.
LIST = 4


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id long, vector array<double> of floor(scale * x); vectors null or holding null, NaN or infinity are left out."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(finite)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _slices(q: np.ndarray, c: np.ndarray, m: int) -> list[np.ndarray]:
    """Partial scores of all pairs per slice; exact: beyond 2**53 as Python integers."""
    big = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1]) >= 2.0**53
    out = []
    for a, b in zip(np.array_split(np.arange(q.shape[1]), m), np.array_split(np.arange(q.shape[1]), m), strict=True):
        if big:
            to_int = np.frompyfunc(int, 1, 1)
            out.append(to_int(q[:, a]).dot(to_int(c[:, b]).T) if len(a) else np.zeros((len(q), len(c)), object))
        else:
            out.append(q[:, a] @ c[:, b].T)
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -score)) if score.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i])), int)
    return order[:k]


def _saturated(x) -> int:
    return max(-(2**63), min(2**63 - 1, int(x)))


def heads(parts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Per query the places of the candidates that are among the first `length` of some slice's list."""
    length = min(length, parts[0].shape[1])
    if not length:
        return [np.zeros(0, np.int64)] * len(parts[0])
    tops = [np.argpartition(-p, length - 1, axis=1)[:, :length] for p in parts]
    return [np.unique(np.concatenate([t[i] for t in tops])) for i in range(len(parts[0]))]


def gathered(q: np.ndarray, c: np.ndarray, cut: np.ndarray, m: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """(places, exact scores) per query of the candidates that reach its cutoff, and how many entries the lists gave for them.

    q, c: integers as doubles whose inner products are exact; bounds allow for the rounding of norms.
    """
    cols = np.array_split(np.arange(q.shape[1]), m)
    reach = np.stack([np.linalg.norm(q[:, a], axis=1) * np.linalg.norm(c[:, a], axis=1).max(initial=0.0) for a in cols], axis=1)
    may = reach * (1 + 1e-9) * m + m >= cut[:, None]  # slices that can hold a part of cut / m
    parts, given = {}, np.zeros((len(q), len(c)), bool)
    for s, a in enumerate(cols):
        rows = np.flatnonzero(may[:, s])
        if len(rows):
            parts[s] = np.full((len(q), len(c)), np.nan)
            parts[s][rows] = q[rows][:, a] @ c[:, a].T
            given[rows] |= parts[s][rows] * m + m >= cut[rows, None]
    out, entries = [], 0
    for i in range(len(q)):
        places = np.flatnonzero(given[i])
        entries += len(places)
        total = np.zeros(len(places))
        for s, a in enumerate(cols):
            known = parts[s][i, places] if s in parts and may[i, s] else c[places][:, a] @ q[i, a]
            total += known
        keep = total >= cut[i]
        out.append((places[keep], total[keep]))
    return out, entries


def _phase(k: int, m: int, first: bool):
    """Scores of a block of queries and one of candidates: heads of lists in the first phase, then all that reach the cutoff."""

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        width = max([len(v) for v in queries["q_vector"]] + [len(v) for v in candidates["vector"]], default=0)
        if len(queries) and len(candidates):
            ids, q_ids = candidates["vec_id"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64)
            c, q = _matrix(candidates["vector"], width), _matrix(queries["q_vector"], width)
            cuts = queries["cutoff"].to_numpy(dtype=object)
            small = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, width) < 2.0**53
            known = np.array([x is not None and not pd.isna(x) for x in cuts])
            for i in range(0, len(q), AT_ONCE):
                n = min(AT_ONCE, len(q) - i)
                if small and not first and known[i : i + n].all():
                    got, _ = gathered(q[i : i + n], c, np.array([float(x) for x in cuts[i : i + n]]), m)
                else:
                    parts = _slices(q[i : i + n], c, m)
                    # a query's own row may be at the head of each list
                    some = heads(parts, LIST * k + 1) if first and small else [np.arange(len(ids))] * n
                    got = [(p, sum((x[r, p] for x in parts[1:]), parts[0][r, p])) for r, p in enumerate(some)]
                for r, (some, score) in enumerate(got):
                    own = ids[some] == q_ids[i + r]
                    some, score = some[~own], score[~own]
                    if len(some) > 4 * k and score.dtype != object:  # all that reach the k-th best, ties with it
                        least = np.partition(score, len(score) - k)[len(score) - k]
                        some, score = some[score >= least], score[score >= least]
                    for j in _best(score, ids[some], k):
                        out.append((int(q_ids[i + r]), int(ids[some[j]]), _saturated(score[j])))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def exact_topk(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, slices: int = 2, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id long, rank int, vec_id long, score long: each query's k best rows by integer inner product.

    is_query: a condition on the vec_id column. A query's candidates are all rows with other ids; ties
    go to smaller ids. Vectors that are null or hold null, NaN or infinite components take no part, nor
    do rows with a null id. Vectors of other lengths are filled up with zeros. Rows with an equal id are
    candidates each; as a query the id has its smallest vector. Scores outside of long saturate. Fewer
    candidates than k give fewer rows; an empty table gives none. Other columns are ignored.
    """
    rows = quantised(vectors, vec_id, embedding, scale)
    queries = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vector").alias("q_vector")).withColumnRenamed("vec_id", "query_id")
    n = rows.count()
    n_queries = queries.count()
    q_blocks, c_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    c_blocks = max(c_blocks, min(24, -(-n // 512)))
    cand = rows.withColumn("c_block", F.pmod(F.xxhash64("vec_id"), F.lit(c_blocks)).cast("int"))
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def meet(q: DataFrame, c: DataFrame, first: bool) -> DataFrame:
        met = q.groupBy("qb", "cb").cogroup(c.groupBy("q_block", "c_block")).applyInPandas(_phase(k, slices, first), "query_id long, vec_id long, score long")
        return met.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)

    home = queries.select("*", F.lit(None).cast("long").alias("cutoff"), F.lit(0).alias("qb"), F.pmod(F.xxhash64("query_id", F.lit("home")), F.lit(c_blocks)).cast("int").alias("cb"))
    first = meet(home, cand.withColumn("q_block", F.lit(0)), True).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("cutoff")).where(F.col("n") == k)
    everywhere = queries.join(first.select("query_id", "cutoff"), "query_id", "left").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
    everywhere = everywhere.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    second = meet(everywhere, cand.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))), False)
    return second.select("query_id", "rank", "vec_id", "score")
