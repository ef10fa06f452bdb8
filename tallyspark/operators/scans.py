"""Running values per key in two levels, so that a key with a third of all rows is spread over many tasks.

A key's rows are cut into blocks (of time, or of row numbers). Each block is summed up, the sums are
carried from block to block in one small window per key, and inside a block one window adds the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyspark.sources.files import written

#: Length of a time block unless told otherwise.
DAY_MS = 86_400_000


def two_level(rows: DataFrame, key: list[str], block: Column, order: list[str], values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """rows with running values per key in the order of (block, *order); block must not fall as order rises.

    values: name -> (kind, column); kind is sum, max or last (the last value that is not null). Without
    inclusive a row's own value is left out. Null keys are one key.
    """
    # one struct as the key: nulls in it are equal, and the join leaves rows dealt out as the window needs them
    rows = rows.withColumn("_scan_key", F.struct(*key, block.alias("_block"))).withColumns({f"_x_{n}": c for n, (_, c) in values.items()})
    at = F.struct(*order)
    whole = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))}
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(b, a)}
    blocks = rows.groupBy("_scan_key").agg(*[whole[kind](f"_x_{n}").alias(f"_b_{n}") for n, (kind, _) in values.items()])
    past = Window.partitionBy(*[F.col("_scan_key")[k] for k in key]).orderBy(F.col("_scan_key")["_block"]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_scan_key").alias("_scan_of"), *[over[kind](f"_b_{n}").over(past).alias(f"_c_{n}") for n, (kind, _) in values.items()])
    inside = Window.partitionBy("_scan_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    # rows that come from an explode look small to the planner; without the hint it may broadcast all of them
    out = rows.join(blocks.hint("merge"), F.col("_scan_key") == F.col("_scan_of")).withColumns({n: both[kind](F.col(f"_c_{n}"), over[kind](f"_x_{n}").over(inside)) for n, (kind, _) in values.items()})
    return out.drop("_scan_key", "_scan_of", *[f"_{p}_{n}" for n in values for p in "xc"])


def time_block(ms: str | Column, block_ms: int = DAY_MS) -> Column:
    return F.floor((F.col(ms) if isinstance(ms, str) else ms) / block_ms)


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """(key, its rows as dicts), streamed; the rows of a key follow one another."""

    def rows():
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                yield from b.slice(k, 1024).to_pylist()

    return groupby(rows(), key=lambda r: r[key])


def settled_positions(fills: DataFrame, key: str, order: list[str], block_ms: int = DAY_MS) -> DataFrame:
    """fills with before (the position that a fill meets, if no sale is left out) and clean (no sale of its key exceeds what is held)."""
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    rows = two_level(fills, [key], time_block(order[0], block_ms), order, {"_after": ("sum", signed)}).withColumn("before", F.col("_after") - signed)
    rows = written(rows, "positions")  # read for the lowest positions, and for each way to settle them
    low = rows.groupBy(F.col(key).alias("_k")).agg((F.min("_after") >= -1e-9).alias("clean"))
    return rows.join(low, F.col(key).eqNullSafe(F.col("_k"))).drop("_k", "_after")


def average_cost(fills: DataFrame, key: str, order: list[str], block_ms: int = DAY_MS) -> DataFrame:
    """Per key the final position, cost and realised profit by average cost, and bad: sales of more than is held, which are left out.

    fills: key, side (BUY or not), qty, price; order[0] is a time in ms. Positions are prefix sums. With them every fill
    maps the cost before it by an affine map, and so does a block of fills: blocks are composed first, then the
    blocks of a key. Where a sale is left out, later positions depend on it one by one: such a key is streamed
    through one task, which keeps four numbers.
    """
    rows = settled_positions(fills.select(key, *order, "side", "qty", "price"), key, order, block_ms)
    # cost after = a * cost before + b; profit = u + v * cost before
    unit = F.struct(*[F.lit(x).alias(n) for n, x in (("a", 1.0), ("b", 0.0), ("u", 0.0), ("v", 0.0))])

    def step(s, f):
        held = F.greatest(f["before"], F.lit(0.0))
        part = F.when(held > 0, f["qty"] / held).otherwise(0.0)
        rest = F.when(held > 0, F.greatest(held - f["qty"], F.lit(0.0)) / held).otherwise(0.0)
        sold = F.struct((s["a"] * rest).alias("a"), (s["b"] * rest).alias("b"), (s["u"] + f["qty"] * f["price"] - part * s["b"]).alias("u"), (s["v"] - part * s["a"]).alias("v"))
        return F.when(f["side"] == "BUY", F.struct(s["a"].alias("a"), (s["b"] + f["qty"] * f["price"]).alias("b"), s["u"].alias("u"), s["v"].alias("v"))).otherwise(sold)

    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    block = rows.where("clean").withColumn("_block", time_block(order[0], block_ms)).groupBy(key, "_block")
    maps = block.agg(F.array_sort(F.collect_list(F.struct(*order, "side", "qty", "price", "before"))).alias("_f"), F.sum(signed).alias("net"))
    maps = maps.select(key, "_block", "net", F.aggregate("_f", unit, step).alias("m"))
    none = F.struct(F.lit(0.0).alias("cost"), F.lit(0.0).alias("pnl"))
    joined = lambda s, x: F.struct((x["m"]["a"] * s["cost"] + x["m"]["b"]).alias("cost"), (s["pnl"] + x["m"]["u"] + x["m"]["v"] * s["cost"]).alias("pnl"))
    totals = maps.groupBy(key).agg(F.sum("net").alias("net"), F.array_sort(F.collect_list(F.struct("_block", "m"))).alias("_m")).withColumn("r", F.aggregate("_m", none, joined))
    clean = totals.select(key, F.greatest("net", F.lit(0.0)).alias("pos"), F.col("r.cost").alias("cost"), F.col("r.pnl").alias("pnl"), F.lit(0).alias("bad"))
    kind = rows.schema[key].dataType
    schema = f"{key} {kind.simpleString()}, pos double, cost double, pnl double, bad int"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, fills in _by_key(batches, key):
            pos = cost = pnl = 0.0
            bad = 0
            for f in fills:
                average = cost / pos if pos > 0 else 0.0
                if f["side"] == "BUY":
                    pos, cost = pos + f["qty"], cost + f["qty"] * f["price"]
                elif f["qty"] <= pos + 1e-9:
                    pos = max(pos - f["qty"], 0.0)
                    pnl, cost = pnl + f["qty"] * (f["price"] - average), average * pos
                else:
                    bad += 1
            yield pa.RecordBatch.from_pydict({key: [k], "pos": [pos], "cost": [cost], "pnl": [pnl], "bad": pa.array([bad], pa.int32())})

    other = rows.where("not clean").select(key, *order, "side", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
    return clean.unionByName(other.repartition(key).sortWithinPartitions(key, *order).mapInArrow(fold, schema))


def recent_rate(rows: DataFrame, key: str, ms: str, seq: str, label: str, past: int, size: int) -> DataFrame:
    """key, ms, seen, rate, cut of every time: labels known before it and the mean of the last `past` earlier rows.

    cut numbers blocks of `size` rows of a key; each block also gets the last `past` rows of the one before.
    """
    counted = two_level(rows.select(key, ms, seq, label), [key], time_block(ms), [ms, seq], {"_n": ("sum", F.lit(1)), "_known": ("sum", F.col(label).isNotNull().cast("long"))}, inclusive=True)
    counted = counted.withColumn("_n", F.col("_n") - 1).withColumn("_known", F.col("_known") - F.col(label).isNotNull().cast("long"))
    cut = F.floor(F.col("_n") / size)
    twice = F.when(F.col("_n") % size >= size - past, F.array(F.struct(cut.alias("cut"), F.lit(False).alias("copy")), F.struct((cut + 1).alias("cut"), F.lit(True).alias("copy"))))
    dealt = counted.withColumn("_in", F.explode(F.coalesce(twice, F.array(F.struct(cut.alias("cut"), F.lit(False).alias("copy")))))).select("*", "_in.cut", "_in.copy")
    by = Window.partitionBy(key, "cut").orderBy("_n").rowsBetween(-past, -1)
    each = dealt.withColumn("rate", F.avg(label).over(by)).where("not copy")
    return each.groupBy(key, ms).agg(F.min_by("_known", "_n").alias("seen"), F.min_by("rate", "_n").alias("rate"), F.min("cut").alias("cut"))


def _first(far: np.ndarray) -> int | None:
    k = int(far.argmax()) if len(far) else 0
    return k if len(far) and far[k] else None


class _Steps:
    """Steps of an anchored rate inside one block: from a place on, each next place is the first whose rate is `step` from that of the last."""

    def __init__(self, rates: np.ndarray, step: float):
        self.rates, self.step, self.ends = rates, step - 1e-12, {}

    def after(self, anchor: float, start: int) -> int | None:
        k = _first(np.abs(self.rates[start:] - anchor) >= self.step)
        return None if k is None else start + k

    def end(self, place: int) -> tuple[int, float]:
        """Steps that follow an anchor at a place, and the last anchor."""
        walked = []
        while place not in self.ends:
            walked.append(place)
            following = self.after(self.rates[place], place + 1)
            if following is None:
                self.ends[place] = 0, float(self.rates[place])
            else:
                place = following
        n, last = self.ends[place]
        for p in reversed([w for w in walked if w not in self.ends]):
            n += 1
            self.ends[p] = n, last
        return self.ends[walked[0] if walked else place]


_RECORD = "array<struct<at:int,rate:double,steps:bigint,last:double>>"


def anchored_regimes(known: DataFrame, key: str, ms: str, after: int, step: float) -> DataFrame:
    """known (key, ms, seen, rate, cut) with regime: it rises when the rate moves by step from its anchor, which then is that rate.

    The first anchor is the rate when `after` labels were seen. A block of rows does not know the anchor that it meets,
    but only the highest and lowest rates so far in it can be the first step away from it; the block tells, for each of
    them, how many steps follow and the last anchor. These summaries are carried through a key, and the blocks then
    number their own rows.
    """

    def live(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ms)
        return part[(part["seen"] >= after).to_numpy()]

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        rates = live(part)["rate"].to_numpy(float)
        steps = _Steps(rates, step)
        records = {}
        for name, sign in (("high", 1), ("low", -1)):
            top = np.maximum.accumulate(sign * rates)
            at = np.flatnonzero(np.concatenate([[True], top[1:] > top[:-1]])) if len(rates) else []
            records[name] = [{"at": int(p), "rate": float(rates[p]), "steps": steps.end(int(p))[0], "last": steps.end(int(p))[1]} for p in at]
        return pd.DataFrame({key: [part[key].iloc[0]], "cut": [part["cut"].iloc[0]], "high": [records["high"]], "low": [records["low"]]})

    kind = known.schema[key].dataType
    blocks = known.groupBy(key, "cut").applyInPandas(summary, f"{key} {kind.simpleString()}, cut long, high {_RECORD}, low {_RECORD}")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("_k", to_arrow_type(kind)), ("_cut", pa.int64()), ("_anchor", pa.float64()), ("_regime", pa.int64())])
        for k, parts in _by_key(batches, key):
            anchor, regime, out = None, 0, []
            for b in parts:
                out.append({"_k": k, "_cut": b["cut"], "_anchor": anchor, "_regime": regime})
                if b["high"] and anchor is None:
                    anchor, regime = b["high"][0]["last"], regime + b["high"][0]["steps"]
                elif b["high"]:
                    up = next((r for r in b["high"] if r["rate"] - anchor >= step - 1e-12), None)
                    down = next((r for r in b["low"] if anchor - r["rate"] >= step - 1e-12), None)
                    first = min((r for r in (up, down) if r), key=lambda r: r["at"], default=None)
                    if first:
                        anchor, regime = first["last"], regime + 1 + first["steps"]
            yield pa.RecordBatch.from_pylist(out, kinds)

    met = blocks.repartition(key).sortWithinPartitions(key, "cut").mapInArrow(carry, f"_k {kind.simpleString()}, _cut long, _anchor double, _regime long")
    rows = known.join(met, F.col(key).eqNullSafe(F.col("_k")) & (F.col("cut") == F.col("_cut"))).drop("_k", "_cut")

    def number(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ms)
        anchor, regime = part["_anchor"].iloc[0], int(part["_regime"].iloc[0])
        rates, seen = part["rate"].to_numpy(float), (part["seen"] >= after).to_numpy()
        out = np.full(len(part), regime, np.int64)
        start = _first(seen)
        if start is not None:
            steps = _Steps(rates, step)
            if pd.isna(anchor):
                anchor, start = rates[start], start + 1
            while (at := steps.after(anchor, start)) is not None:
                out[at:] += 1
                anchor, start = rates[at], at + 1
        return part.drop(columns=["_anchor", "_regime"]).assign(regime=out)

    return rows.groupBy(key, "cut").applyInPandas(number, ", ".join(f"{n} {t}" for n, t in known.dtypes) + ", regime long").drop("cut")
