"""Evaluation of scores over time: ranks, calibration, losses, shuffles, walk-forward, gates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import md5
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.operators.scans import two_level
from tallyspark.sources.files import written

#: Most blocks of hashes whose numbers of rows are broadcast.
BROADCAST_BLOCKS = 200_000
#: The setting by which a query's shuffle files are deleted when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def auc(rows: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Rank AUC per group with ties averaged; null unless both classes are there.

    Equal scores are summed up first, so ranks are windows over distinct scores.
    """
    seen = rows.groupBy(*by, p).agg(F.sum(y).alias("_pos"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = seen.withColumn("_rank", before + (F.col("_n") + 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_pos").alias("positives"), F.sum(F.col("_pos") * F.col("_rank")).alias("_s"))
    other = F.col("n") - F.col("positives")
    area = (F.col("_s") - F.col("positives") * (F.col("positives") + 1) / 2) / F.nullif(F.col("positives") * other, F.lit(0))
    return out.select(*by, "n", "positives", area.alias("auc"))


def conditional_auc(rows: DataFrame, period: str, y: str, p: str) -> DataFrame:
    """Mean of the periods' AUCs, plain and weighted by n, and the pooled AUC."""
    per = auc(rows, [period], y, p).where("auc is not null")
    pooled = auc(rows, [], y, p).select(F.col("auc").alias("pooled"))
    means = per.agg(F.count("*").alias("periods"), F.avg("auc").alias("macro"), (F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("weighted"))
    return means.crossJoin(pooled)


def calibration(rows: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Equal bins of p, the last one closed: n, mean of p, event rate."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def losses(rows: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Brier score and log loss per group, p kept within [1e-6, 1 - 1e-6]."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((q - F.col(y)) * (q - F.col(y))).alias("brier"), F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))


def shuffled_labels(rows: DataFrame, id_: str, period: str, y: str, seed: Column) -> DataFrame:
    """rows with shuffled: labels permuted inside each period by a hash of id and seed; rates stay."""
    place = F.row_number().over(Window.partitionBy(period).orderBy(id_))
    draw = F.row_number().over(Window.partitionBy(period).orderBy(F.xxhash64(id_, seed), id_))
    a = rows.withColumn("_n", place)
    b = rows.withColumn("_n", draw).select(period, "_n", F.col(y).alias("shuffled"))
    return a.join(b, [period, "_n"]).drop("_n")


def numbered_strata(rows: DataFrame, strata: list[str]) -> tuple[DataFrame, Row]:
    """(_s, _k_<stratum>: numbers of the strata from 1 on), and how many strata there are and rows in the largest."""
    sized = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    sized = written((sized.repartitionByRange(*strata) if strata else sized).withColumn("_part", F.spark_partition_id()), "strata")
    size = sized.agg(F.count("*").alias("strata"), F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    return two_level(sized, [], F.col("_part"), strata or ["_n"], {"_s": ("sum", F.lit(1))}).select("_s", *[F.col(c).alias(f"_k_{c}") for c in strata]), size


def permuted_labels(rows: DataFrame, id_: str, y: str, shuffles: int, strata: list[str] | None = None, keep: list[str] | None = None, block: int = 1 << 16) -> DataFrame:
    """id_, strata, shuffle, keep, label: in each shuffle the labels of a stratum are dealt to its rows anew, so that every rate stays as it is.

    Rows and labels are put in two orders, by md5(id:shuffle:row) and md5(id:shuffle:label); places are joined. Places are
    counted in blocks of hashes with `block` rows at most (about, a sixteenth at least), so no task orders a whole stratum.
    """
    strata, keep = strata or [], keep or []
    numbers, size = numbered_strata(rows, strata)
    digits = next(d for d in range(33) if (size["most"] or 0) <= block * 16**d)
    few = size["strata"] * shuffles * 16**digits <= BROADCAST_BLOCKS
    small = lambda df: F.broadcast(df) if few else df.hint("merge")
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))

    def placed(what: str, columns: list[Column]) -> DataFrame:
        """The columns with _place: groups are blocks of a shuffle of a stratum, counted through, so a place is one number."""
        own = rows.select(*columns, F.col(id_).alias("_id"), *[c for c in strata if what == "label"])
        own = own.join(small(numbers), same).drop(*[f"_k_{c}" for c in strata]) if strata else own.withColumn("_s", F.lit(1))
        spread = own.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
        hashed = spread.withColumn("_m", F.md5(F.concat_ws(":", F.col("_id").cast("string"), F.col("shuffle").cast("string"), F.lit(what)).cast("binary")))
        first = F.conv(F.substring("_m", 1, digits), 16, 10).cast("long") if digits else F.lit(0)
        dealt = hashed.withColumns({"_g": (F.col("_s") * shuffles + F.col("shuffle")) * 16**digits + first, "_h": F.unhex("_m")}).drop("_m", "_id", "_s")
        if what == "label":
            dealt = dealt.select("_g", "_h", "label")
        blocks = written(dealt.groupBy("_g").agg(F.count("*").alias("_n")), "blocks")
        blocks = two_level(blocks, [], F.floor(F.col("_g") / block), ["_g"], {"_before": ("sum", F.col("_n"))}).select(F.col("_g").alias("_of"), (F.col("_before") - F.col("_n")).alias("_before"))
        inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_g").orderBy("_h"))).drop("_h")
        return inside.join(small(blocks), F.col("_g") == F.col("_of")).withColumn("_place", F.col("_before") + F.col("_at")).drop("_g", "_of", "_before", "_at")

    labels = placed("label", [F.col(y).alias("label")]).withColumnRenamed("_place", "_to")
    # both sides are exploded, so the planner takes them for small: never broadcast them
    met = placed("row", [F.col(c) for c in dict.fromkeys([id_, *strata, *keep])]).join(labels.hint("merge"), F.col("_place") == F.col("_to"))
    return met.select(*dict.fromkeys([id_, *keep, "shuffle", *strata]), "label")


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, each query's shuffle files are deleted when it ends."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def mid_ranks(rows: DataFrame, by: list[str], p: str) -> DataFrame:
    """rows with _rank: the place of p in its group, equal ones averaged, null last. Distinct values are counted in stretches, so no task orders a whole group."""
    seen = rows.groupBy(*by, p).agg(F.count("*").alias("_n")).withColumn("_last", F.col(p).isNull())
    seen = written(seen.repartitionByRange(*by, "_last", p).withColumn("_part", F.spark_partition_id()), "values")
    upto = two_level(seen, by, F.col("_part"), ["_last", p], {"_upto": ("sum", F.col("_n"))})
    ranks = upto.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, p]], (F.col("_upto") - (F.col("_n") - 1) / 2).alias("_rank"))
    same = F.lit(True)
    for c in [*by, p]:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(ranks, same).drop(*[f"_k_{c}" for c in [*by, p]])


def hash_order(heads: pa.ChunkedArray, group: np.ndarray, tail: bytes, value: np.ndarray) -> np.ndarray:
    """The order of rows by (group, md5 of head and tail); equal hashes (equal ids) go by value."""
    high, low, k = np.empty(len(group), "u8"), np.empty(len(group), "u8"), 0
    for chunk in heads.chunks:
        for i in range(0, len(chunk), 1 << 15):
            part = chunk.slice(i, 1 << 15)
            at = np.frombuffer(part.buffers()[1], "i4")[part.offset : part.offset + len(part) + 1]
            text, cuts = part.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes(), (at - at[0]).tolist()
            found = np.frombuffer(b"".join([md5(text[x:y] + tail, usedforsecurity=False).digest() for x, y in pairwise(cuts)]), ">u8").reshape(-1, 2)
            high[k : k + len(part)], low[k : k + len(part)] = found[:, 0], found[:, 1]
            k += len(part)
    order = np.argsort(high) if group[0] == group[-1] and np.all(group == group[0]) else np.lexsort((high, group))
    if np.any((high[order[1:]] == high[order[:-1]]) & (group[order[1:]] == group[order[:-1]])):
        order = np.lexsort((value, low, high, group))
    return order


def whole_sums(batches: Iterator[pa.RecordBatch], shuffles: int, copies: int) -> Iterator[pa.RecordBatch]:
    """Sums of value times label by stratum and shuffle, of strata that are here whole; copy c has the shuffles c, c + copies and so on."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    del batches
    for c in range(copies):
        own = table.filter(pc.equal(table["copy"], c)) if copies > 1 else table
        if not own.num_rows:
            continue
        heads = own["head"].cast(pa.binary())
        s, value, label = (own[x].to_numpy() for x in ("s", "v", "y"))
        if c == copies - 1:
            del table
        del own
        names, group = np.unique(s, return_inverse=True)
        at = np.sort(group)
        for k in range(c, shuffles, copies):
            by_row = value[hash_order(heads, group, f"{k}:row".encode(), value)]
            by_row *= label[hash_order(heads, group, f"{k}:label".encode(), label)]
            yield pa.record_batch([pa.array(names * shuffles + k), pa.array(np.bincount(at, weights=by_row, minlength=len(names)))], ["of", "v"])


def met_places(batches: Iterator[pa.RecordBatch], span: int, most: int) -> Iterator[pa.RecordBatch]:
    """Sums of value times label by group and shuffle (place -1) of places whose row and label are both here; what has no partner here goes out by place."""
    parts = []
    for b in batches:
        start, end = b.column("h").offset * 16, (b.column("h").offset + b.num_rows) * 16
        h = np.frombuffer(b.column("h").buffers()[2], dtype=">u8", count=end // 8)[start // 8 :].reshape(-1, 2)
        parts.append([*[b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "row", "v", "start")], h[:, 0].astype("u8"), h[:, 1].astype("u8")])
    if not parts:
        return
    g, row, v, start, high, low = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    own = np.unique(g // span)

    def places(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group and shuffle, place (as one rising number over all groups here) and value, in the order of the hashes."""
        at = np.flatnonzero(side)
        o = at[np.lexsort((high[at], g[at]))]
        if np.any((g[o[1:]] == g[o[:-1]]) & (high[o[1:]] == high[o[:-1]])):
            o = at[np.lexsort((v[at], low[at], high[at], g[at]))]
        n = np.arange(len(o))
        first = np.r_[True, g[o[1:]] != g[o[:-1]]] if len(o) else np.zeros(0, bool)
        of = np.searchsorted(own, g[o] // span)
        return of, of * (most + 1) + start[o] + n - np.maximum.accumulate(np.where(first, n, 0)), v[o]

    (of, at, value), (label_of, label_at, label) = places(row), places(~row)
    j = np.searchsorted(label_at, at)
    met = np.r_[label_at, -1][j] == at
    alone = np.ones(len(label), bool)
    alone[j[met]] = False
    alone &= label != 0
    sums = np.bincount(of[met], weights=value[met] * label[j[met]], minlength=len(own))
    rows = [(own, np.full(len(own), -1), np.ones(len(own), bool), sums)]
    rows += [(own[k[w]], x[w] % (most + 1), np.full(w.sum(), is_row), y[w]) for k, x, w, is_row, y in ((of, at, ~met, True, value), (label_of, label_at, alone, False, label))]
    for k, x, is_row, y in rows:
        for i in range(0, len(k), 1 << 16):
            yield pa.record_batch([pa.array(c[i : i + (1 << 16)]) for c in (k, x.astype("i8"), is_row, y)], ["of", "place", "row", "v"])


def permuted_sums(rows: DataFrame, id_: str, y: str, value: str, shuffles: int, strata: list[str], whole: int = 10_000_000, block: int = 1 << 20, step: int = 1 << 26) -> DataFrame:
    """strata, shuffle, n, labels, total: the labels of permuted_labels() times the values of the rows they are dealt to, summed up per stratum.

    Strata of up to `whole` rows go to tasks as they are, where each shuffle hashes and orders them in turn; they are copied
    for some of the shuffles each only where there are fewer strata than tasks. With a larger stratum rows are dealt by
    blocks of hashes (`summed_by_blocks`), so no task holds a whole one.
    """
    numbers, size = numbered_strata(rows, strata)
    spark, n, same = rows.sparkSession, size["rows"] or 0, F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    small = F.broadcast(numbers) if size["strata"] <= BROADCAST_BLOCKS else numbers.hint("merge")
    # the head of what is hashed: the id and a colon
    own = rows.join(small, same).select(F.col("_s").alias("s"), F.concat_ws(":", F.col(id_).cast("string"), F.lit("")).alias("head"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("v"))
    with shuffles_deleted(spark):
        kept = written(own, "ranked")
        if (size["most"] or 0) > whole:
            total = summed_by_blocks(kept, size, shuffles, block, step)
        else:
            cores = spark.sparkContext.defaultParallelism
            copies = max(1, min(shuffles, -(-2 * cores // max(size["strata"], 1))))
            tasks = max(1, min(size["strata"] * copies, max(2 * cores, -(-n * copies >> 20))))
            each = kept.select("s", F.col("head").cast("binary").alias("head"), "y", "v", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
            dealt = each.repartitionById(tasks, ((F.col("s") * copies + F.col("copy")) % tasks).cast("int"))
            total = written(dealt.mapInArrow(lambda batches: whole_sums(batches, shuffles, copies), "of long, v double"), "sums").groupBy("of").agg(F.sum("v").alias("total"))
    total = total.select(F.floor(F.col("of") / shuffles).alias("_s"), (F.col("of") % shuffles).cast("int").alias("shuffle"), "total")
    each = kept.groupBy(F.col("s").alias("_s")).agg(F.count("*").alias("n"), F.sum("y").alias("labels")).join(numbers, "_s")
    return total.join(each, "_s").select(*[F.col(f"_k_{c}").alias(c) for c in strata], "shuffle", "n", "labels", "total")


def summed_by_blocks(kept: DataFrame, size: Row, shuffles: int, block: int, step: int) -> DataFrame:
    """of (stratum number * shuffles + shuffle), total: the sums of permuted_sums() without a whole stratum in a task.

    A row is dealt once a shuffle for its place and once for its label's, by stratum and first digits of the hash, in blocks
    of `block` rows at most (about). Blocks of rows and labels begin at places a little apart: what has no partner in its
    block, few rows, is joined by place at the end. Shuffles go in steps of `step` dealt rows (one at least), whose files
    are deleted when a step has ended, so disk grows with the rows, not with the shuffles.
    """
    most, n, cores = size["most"] or 0, size["rows"] or 0, kept.sparkSession.sparkContext.defaultParallelism
    digits = next(d for d in range(1, 33) if most <= block * 16**d)
    span = 16**digits
    groups = size["strata"] * shuffles * span

    def dealt(first: int, last: int) -> DataFrame:
        sides = F.inline(F.array(F.struct(F.lit("row").alias("what"), F.col("v")), F.struct(F.lit("label").alias("what"), F.col("y").alias("v"))))
        each = kept.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("shuffle")).select("s", "head", "shuffle", sides.alias("what", "w"))
        each = each.withColumn("_m", F.md5(F.concat("head", F.col("shuffle").cast("string"), F.lit(":"), "what").cast("binary")))
        return each.select(((F.col("s") * shuffles + F.col("shuffle")) * span + F.conv(F.substring("_m", 1, digits), 16, 10).cast("long")).alias("g"), (F.col("what") == "row").alias("row"), F.unhex("_m").alias("h"), F.col("w").alias("v"))

    counts = written(dealt(0, shuffles - 1).groupBy("g").agg(F.count_if("row").alias("_rows"), F.count_if(~F.col("row")).alias("_labels")), "counts")
    upto = two_level(counts.withColumn("_of", F.floor(F.col("g") / span)), ["_of"], F.floor(F.col("g") / block), ["g"], {"_r": ("sum", F.col("_rows")), "_l": ("sum", F.col("_labels"))})
    starts = written(upto.select(F.col("g").alias("_g"), (F.col("_r") - F.col("_rows")).alias("_r"), (F.col("_l") - F.col("_labels")).alias("_l")), "starts")
    starts = F.broadcast(starts) if groups <= BROADCAST_BLOCKS else starts.hint("merge")
    at_once, out = max(1, step // max(n, 1)), None
    for first in range(0, shuffles, at_once):
        k = min(at_once, shuffles - first)
        tasks = max(2 * cores, -(-2 * n * k >> 19))
        own = dealt(first, first + k - 1).repartitionById(tasks, (F.col("g") % tasks).cast("int")).join(starts, F.col("g") == F.col("_g"))
        own = own.select("g", "row", "h", "v", F.when(F.col("row"), F.col("_r")).otherwise(F.col("_l")).alias("start"))
        part = written(own.mapInArrow(lambda batches: met_places(batches, span, most), "of long, place long, row boolean, v double"), "met")
        out = part if out is None else out.unionByName(part)
    pairs = out.where("place >= 0").groupBy("of", "place").agg(F.sum(F.when(F.col("row"), F.col("v"))).alias("a"), F.sum(F.when(~F.col("row"), F.col("v"))).alias("b"))
    both = out.where("place < 0").select("of", "v").unionByName(pairs.select("of", (F.col("a") * F.col("b")).alias("v")))
    return both.groupBy("of").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))


def shuffle_control(rows: DataFrame, id_: str, period: str, y: str, p: str, shuffles: int) -> DataFrame:
    """Mean, 95th percentile and maximum of the macro AUC under within-period shuffles of the labels; rows without a period are left out.

    A score's rank in its period is the same in every shuffle, so only sums of ranks over the labels are shuffled.
    """
    own = rows.where(F.col(period).isNotNull()).select(F.col(id_).alias("_id"), F.col(period).alias("_period"), F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("_y"), F.col(p).alias("_p"))
    sums = permuted_sums(mid_ranks(own, ["_period"], "_p"), "_id", "_y", "_rank", shuffles, ["_period"])
    area = (F.col("total") - F.col("labels") * (F.col("labels") + 1) / 2) / F.nullif(F.col("labels") * (F.col("n") - F.col("labels")), F.lit(0.0))
    per = sums.withColumn("auc", area).groupBy("shuffle").agg(F.avg("auc").alias("auc"))
    return per.agg(F.count("*").alias("shuffles"), F.avg("auc").alias("mean"), F.percentile("auc", F.lit(0.95)).alias("p95"), F.max("auc").alias("most"))


def walk_forward_baseline(rows: DataFrame, period: str, y: str, least_train: int, least_rows: int) -> DataFrame:
    """Expanding folds: the rate of all earlier periods scores each period that has least_train before it."""
    per = rows.groupBy(period).agg(F.count("*").alias("n"), F.sum(y).alias("positives"))
    by = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    out = per.withColumn("train_periods", F.count("*").over(by)).withColumn("train_n", F.sum("n").over(by)).withColumn("rate", F.sum("positives").over(by) / F.sum("n").over(by))
    out = out.where((F.col("train_periods") >= least_train) & (F.col("n") >= least_rows))
    brier = (F.col("positives") * (1 - F.col("rate")) ** 2 + (F.col("n") - F.col("positives")) * F.col("rate") ** 2) / F.col("n")
    return out.select(period, "train_periods", "train_n", "n", "rate", brier.alias("brier"))


def sufficiency(rows: DataFrame, ms: str, least_rows: int, least_days: float) -> DataFrame:
    """Rows, calendar span in days, and whether both reach their minima."""
    out = rows.agg(F.count("*").alias("n"), ((F.max(ms) - F.min(ms)) / 86_400_000).alias("days"))
    return out.withColumn("enough", (F.col("n") >= least_rows) & (F.coalesce("days", F.lit(0.0)) >= least_days))


def threshold_policy(results: DataFrame, name: str, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """name, status, reasons: PASS unless a metric is missing, below its minimum or above its maximum."""
    tests = [(F.col(c).isNull(), f"{c}_missing") for c in [*least, *most]] + [(F.col(c) < v, f"{c}_low") for c, v in least.items()] + [(F.col(c) > v, f"{c}_high") for c, v in most.items()]
    why = F.array_compact(F.array(*[F.when(c, t) for c, t in tests]))
    return results.select(name, F.when(F.size(why) == 0, "PASS").otherwise("FAIL").alias("status"), F.array_join(why, ",").alias("reasons"))
