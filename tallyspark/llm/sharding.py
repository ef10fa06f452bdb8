"""Consistent-hash ring with virtual nodes and bounded loads.

A key goes to the first virtual node clockwise from its place on the ring; keys that overflow a full
shard continue clockwise to the next shard with room. How much of each arc overflows, and whereto, is
settled on arc totals (their number is fixed by the ring, not by the data); rows then find their
shard by their rank inside the arc.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bucket_count, materialize, prefix_sums


def ring(shards: int, virtual_nodes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places (63 bits, ascending) and shards of all virtual nodes; a shard's nodes depend on its number alone."""
    places = sorted((int.from_bytes(blake2b(f"{seed}:{s}:{v}".encode(), digest_size=8).digest(), "little") >> 1, s) for s in range(shards) for v in range(virtual_nodes))
    return np.array([p for p, _ in places], np.int64), np.array([s for _, s in places], np.int64)


def settle(demand: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard) for ranks of each arc: own shard first, in ring order; the rest clockwise to free room."""
    free, parts, rest = room.astype(np.int64).copy(), [], []
    for arc, (n, s) in enumerate(zip(demand.tolist(), owner.tolist(), strict=True)):
        k = min(n, int(free[s]))
        free[s] -= k
        if k:
            parts.append((arc, 0, k, s))
        if n > k:
            rest.append((arc, k, n))
    for arc, lo, hi in rest:
        at = arc
        while lo < hi:
            at = (at + 1) % len(owner)
            s = int(owner[at])
            k = min(hi - lo, int(free[s]))
            if k:
                parts.append((arc, lo, lo + k, s))
                free[s] -= k
                lo += k
    return parts


def shard_rows(docs: DataFrame, key: Column, order: list[str], shards: int = 24, virtual_nodes: int = 128, load_factor: float = 1.0, seed: int = 0) -> DataFrame:
    """docs with shard int and slot long (0.. without gaps inside each shard).

    No shard holds more than ceil(load_factor * rows / shards) rows; at a load factor of 1 the counts
    of shards are at most one apart. Rows with equal keys stand at one place of the ring: they share a
    shard unless it is full. A larger load factor moves fewer rows when shards are added.

    A null key is a key of its own. order names columns that fix the order of rows inside an arc;
    repeated rows are told apart by nothing and take neighbouring slots. An empty table gives no rows.
    Columns of docs named shard or slot are replaced; all others stay as they are.
    """
    places, owner = ring(shards, virtual_nodes, seed)
    spread = docs.sparkSession.sparkContext.broadcast(places)

    @F.pandas_udf("int")
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(spread.value, place.to_numpy(np.int64)) % len(spread.value)).astype("int32")

    place = F.shiftrightunsigned(F.xxhash64(key, F.lit("ring")), 1)
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    order = F.struct(*order)
    rows = docs.select(row.alias("row"), arc_of(place).alias("arc"), order.alias("order"), F.xxhash64(key, F.lit("part")).alias("part"), F.lit(1).cast("long").alias("one"))
    rows = materialize(rows, "ring-rows")
    found = rows.groupBy("arc").count().collect()  # one row per virtual node at most
    demand = np.zeros(len(owner), np.int64)
    for r in found:
        demand[r["arc"]] = r["count"]
    n = int(demand.sum())
    if load_factor <= 1:
        room = np.full(shards, n // shards)
        room[: n % shards] += 1
    else:
        room = np.full(shards, -int(-load_factor * n // shards))
    base, table = np.zeros(shards, np.int64), []
    for arc, lo, hi, s in settle(demand, owner, room):
        table.append((arc, lo, hi, s, int(base[s])))
        base[s] += hi - lo
    parts = docs.sparkSession.createDataFrame(table, "a int, lo long, hi long, shard int, base long")
    b = bucket_count(n)
    buckets = F.pmod("part", F.lit(64)) * b + F.pmod(F.xxhash64("order"), F.lit(b))
    ranked = prefix_sums(rows, ["arc"], ["order"], ["one"], buckets)
    out = ranked.join(F.broadcast(parts), (F.col("arc") == F.col("a")) & (F.col("before_one") >= F.col("lo")) & (F.col("before_one") < F.col("hi")))
    kept = [F.col("row")[c].alias(c) for c in names if c not in ("shard", "slot")]
    return out.select(*kept, "shard", (F.col("base") + F.col("before_one") - F.col("lo")).alias("slot"))
