"""Mixing sources to target weights by blocks of words.

Each source's documents form one stream of words that is cut into blocks of fixed length. Each output
shard draws multinomial counts of slots per source; a source's slots, numbered over all shards, are
mapped through pseudorandom permutations of its block indexes (one per pass), and blocks are joined by
index. After the draw, slots above a source's quota fall away and missing ones are added, so a
source's total meets its target to within a block. Small sources have shorter blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bucket_count, materialize, prefix_sums, word_count

#: Slots of one output shard.
SHARD_SLOTS = 4096


def water_fill(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Targets that share sum(sizes) by weight, none above most times its size; the excess is reshared by weight."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    open_ = {i for i, (s, w) in enumerate(zip(sizes, weights, strict=True)) if s > 0 and w > 0}
    left = total
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        full = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = most * sizes[i]
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in open_ or i in full)
        open_ -= full
    return targets


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 applied to index: four Feistel rounds, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            h = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((h >> np.uint64(32)) & mask)
        return (a << np.uint64(half)) | b

    x = once(index.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def mix(docs: DataFrame, weight: Callable[[int, str | None], float], size: Column | None = None, most: float = 3.0, block: int = 256, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, spans) of a mix as large as the input.

    block: words of a block, at most; a source with few words, or a small target, has blocks of a sixteenth of these.

    docs: doc_id long, source string, text string (or the column expression size, in words). weight
    gives a source's weight from its index, sources being in code point order with null last.
    rows: row long (names an input row), doc_id, source, size, and row_key if docs has it. sources: source, s int, source_size,
    target, block. spans: shard, slot, s, pass, block, row, start, words - the words [start, start + words) of
    a row that a slot of the mix holds. A block is used once in each pass, and passes are at most
    ceil(most), so no row gives more than ceil(most) times its size.

    Null source is a source of its own. Null and empty texts have size 0 and no spans. Repeated rows
    and ties in doc_id are rows of their own. An empty table gives empty results. The same input and
    seed give the same mix. Sources are gathered on the driver as one row each.
    """
    spark = docs.sparkSession
    words = word_count(F.col("text")) if size is None else size
    own = [c for c in ("row_key",) if c in docs.columns]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64("text").alias("tie"), *own)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    found = sorted(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [r["size"] for r in found]
    targets = water_fill(sizes, [weight(i, r["source"]) for i, r in enumerate(found)], most)
    lengths = [max(1, min(block, int(min(s, t) / 16))) for s, t in zip(sizes, targets, strict=True)]
    blocks = [-(-s // n) for s, n in zip(sizes, lengths, strict=True)]
    quota = []
    for s, t, n, length in zip(sizes, targets, blocks, lengths, strict=True):
        turns = int(t // s) if s else 0
        quota.append(min(turns * n + round((t - turns * s) / length), int(most) * n) if s else 0)
    n_rows = sum(r["n"] for r in found)
    sources = spark.createDataFrame([(r["source"], i, *x) for i, (r, *x) in enumerate(zip(found, sizes, targets, lengths, strict=True))], "source string, s int, source_size long, target double, block long")
    index = F.broadcast(sources.select(F.col("source").alias("_source"), "s", F.col("block").alias("length")))
    rows = rows.join(index, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")

    # The streams: words before each row in its source, then the blocks that a row reaches into.
    b = bucket_count(n_rows)
    placed = prefix_sums(rows.where("size > 0"), ["s"], ["doc_id", "tie", "row"], ["size"], F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.lit(b)))
    reach = F.explode(F.sequence(F.floor(F.col("before_size") / F.col("length")), F.floor((F.col("before_size") + F.col("size") - 1) / F.col("length"))))
    pieces = placed.select("s", "row", "before_size", "size", "length", reach.alias("block"))
    start = F.greatest(F.col("block") * F.col("length"), F.col("before_size"))
    end = F.least((F.col("block") + 1) * F.col("length"), F.col("before_size") + F.col("size"))
    pieces = pieces.select("s", "block", "row", (start - F.col("before_size")).alias("start"), (end - start).alias("words"))

    # The slots: a multinomial draw per shard, then quotas.
    total = sum(quota)
    shards = -(-total // SHARD_SLOTS)
    share = np.array(quota, float) / max(total, 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            for h in ids["id"]:
                n = min(SHARD_SLOTS, total - int(h) * SHARD_SLOTS)
                got = np.random.Generator(np.random.PCG64([seed, int(h)])).multinomial(n, share)
                yield pd.DataFrame({"shard": int(h), "s": np.arange(len(got)), "drawn": got})

    drawn = spark.range(shards).mapInPandas(draw, "shard long, s int, drawn long") if total else spark.createDataFrame([], "shard long, s int, drawn long")
    drawn = materialize(drawn, "drawn")
    width = bucket_count(shards)
    counted = prefix_sums(drawn, ["s"], ["shard"], ["drawn"], F.floor(F.col("shard") / width))
    sums = {r["s"]: r["n"] for r in drawn.groupBy("s").agg(F.sum("drawn").alias("n")).collect()}
    missing = [(h, i, int(sums.get(i, 0)), quota[i] - int(sums.get(i, 0))) for i in range(len(quota)) for h in [shards] if quota[i] > sums.get(i, 0)]
    quotas = F.array(*[F.lit(q).cast("long") for q in quota]) if quota else F.array().cast("array<long>")
    n_take = F.least(F.col("drawn"), F.element_at(quotas, F.col("s") + 1) - F.col("before_drawn")) if quota else F.lit(0).cast("long")
    given = counted.select("shard", "s", F.col("before_drawn").alias("first"), n_take.alias("n")).where("n > 0")
    extra = spark.createDataFrame(missing, "shard long, s int, first long, n long")
    # Slots that quotas add are dealt out over all shards in runs.
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(16).cast("long")))
    extra = extra.select("s", "first", "n", run.alias("at")).select(F.pmod(F.xxhash64("s", "at"), F.lit(max(shards, 1))).alias("shard"), "s", (F.col("first") + F.col("at")).alias("first"), F.least(F.lit(16).cast("long"), F.col("n") - F.col("at")).alias("n"))
    given = given.unionByName(extra)

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for given in batches:
            for shard, s, first, n in given.itertuples(index=False):
                j = np.arange(first, first + n)
                turn, i = j // blocks[s], j % blocks[s]
                at = np.empty(len(j), np.int64)
                for t in np.unique(turn):
                    at[turn == t] = permuted(i[turn == t], blocks[s], seed * 1_000_003 + s * 101 + int(t))
                yield pd.DataFrame({"shard": shard, "slot": j, "s": s, "pass": turn, "block": at})

    placed_slots = given.repartition("shard", "s", "first").mapInPandas(slots, "shard long, slot long, s int, pass int, block long")
    # Both sides grow with the data, though the planner sees the slots' small input only: never a broadcast.
    spans = placed_slots.hint("merge").join(pieces, ["s", "block"]).select("shard", "slot", "s", "pass", "block", "row", "start", "words")
    return rows.select("row", "doc_id", "source", "s", "size", *own), sources, spans
