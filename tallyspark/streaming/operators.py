"""Streaming operators: de-duplication, coverage, storms, latency and gap detection, as Structured Streaming transformations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicate(stream: DataFrame, identity: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each identity inside the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(identity)


def window_coverage(stream: DataFrame, key: str, ts: str, width: str, late: str) -> DataFrame:
    """Rows per key and tumbling window that had any."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def storms(stream: DataFrame, ts: str, width: str, slide: str, least: int, late: str) -> DataFrame:
    """Sliding windows with `least` rows or more."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n"))
    return out.where(F.col("n") >= least).select(F.col("w.start").alias("start"), "n")


def latency(stream: DataFrame, ts: str, delay: str, width: str, late: str) -> DataFrame:
    """Delays per window: number, mean, largest, and whether more than one in twenty is negative (a skewed clock)."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"))
    out = out.agg(F.count("*").alias("n"), F.avg(delay).alias("mean"), F.max(delay).alias("most"), F.avg((F.col(delay) < 0).cast("double")).alias("negative"))
    return out.select(F.col("w.start").alias("start"), "n", "mean", "most", (F.col("negative") > 0.05).alias("skewed"))


def detect_gaps(stream: DataFrame, key: str, seq: str, ms: str, threshold_ms: int) -> DataFrame:
    """key, from_ms, to_ms of times further apart than the threshold, by the last time kept as state per key.

    Rows of a micro-batch are sorted by (ms, seq); a row older than the state is not back-dated.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([ms, seq])
        out = []
        for t in rows[ms].tolist():
            if last is not None and t - last > threshold_ms:
                out.append((k[0], last, t))
            last = t if last is None else max(last, t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "from_ms", "to_ms"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, from_ms long, to_ms long", "last long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(out: DataFrame, path: str, checkpoint: str) -> None:
    """Write what a stream yields for all that its source holds now."""
    out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def validity(stream: DataFrame, key: str, stale_ms: int, least: float, most: float) -> DataFrame:
    """key, seq, status of a book's events: UNINITIALIZED until both tokens were seen, DESYNCED from a step back in time or a price out of bounds on, STALE after a long silence, else VALID.

    stream: key, seq, ms, token (1 and 2 for the two), price, reset (a reconnect, which starts anew). The state of a
    connection is its last time, the tokens seen and whether it is desynchronised.
    """
    from tallyspark.operators.evidence import validity_states

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, kept = validity_states(frames, state.get if state.exists else None, stale_ms, least, most)
        last, seen, bad = kept
        state.update((last if last is not None else -1, int(seen), bool(bad)))
        yield pd.DataFrame([(k[0], *r) for r in rows], columns=[key, "seq", "status"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq long, status string", "last long, seen int, bad boolean", "append", GroupStateTimeout.NoTimeout)


def refresh(stream: DataFrame, derive, path: str, checkpoint: str) -> None:
    """Keep a derived table of partial sums: every micro-batch adds derive(batch) under its own number, so a batch that runs again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        derive(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
