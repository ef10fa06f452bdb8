"""Feature rows before a prediction: book frames, bounded tick history, assembly, provenance and the audits of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators.features import in_window
from tallyspark.operators.temporal_joins import asof_backward, at_targets


def bounded_history(cuts: DataFrame, ticks: DataFrame, key: str, cut_id: str, cut: str, ms: str, seq: str, values: list[str], back_ms: int) -> DataFrame:
    """The ticks that features of back_ms need: those in (cut - back_ms, cut], and the one before them.

    Returns cut_id, ms, seq, values: the tick history of each cut, without a scan of what lies further back than
    the predecessor.
    """
    inside = in_window(cuts, ticks, key, cut, ms, back_ms).select(cut_id, ms, seq, *values)
    edge = cuts.select(cut_id, key, (F.col(cut) - back_ms).alias(ms))
    named = [c for c in (seq, *values)]
    before = asof_backward(edge, ticks.select(key, ms, *named, F.col(ms).alias("_at")), key, ms, [*named, "_at"], [seq]).where("age_ms is not null")
    return inside.unionByName(before.select(cut_id, F.col("_at").alias(ms), seq, *values))


def window_return(history: DataFrame, cut_id: str, ms: str, seq: str, price: str) -> DataFrame:
    """cut_id, log_return between the first and the last price of each history, and its ticks."""
    at = F.struct(ms, seq)
    return history.groupBy(cut_id).agg(F.log(F.max_by(price, at) / F.min_by(price, at)).alias("log_return"), F.count("*").alias("ticks"))


def frame_features(cuts: DataFrame, book: DataFrame, key: str, cut_id: str, cut: str, levels: list[int]) -> DataFrame:
    """Per cut and outcome the last valid book row: bid, ask, mid, spread, and depth and imbalance of some levels, with age_ms.

    book: key, outcome, receive_ms, seq, best_bid, best_ask, mid, bids, asks, book_state_valid.
    """
    rows = book.where("book_state_valid").withColumn("_key", F.struct(key, "outcome"))
    frames = cuts.select(cut_id, key, F.col(cut).alias("receive_ms"), F.explode(F.array(F.lit("Up"), F.lit("Down"))).alias("outcome")).withColumn("_key", F.struct(key, "outcome"))
    kept = ["best_bid", "best_ask", "mid", "bids", "asks"]
    last = asof_backward(frames, rows.select("_key", "receive_ms", "seq", *kept), "_key", "receive_ms", kept, ["seq"])
    depths = [S.depth(F.col(side), n).alias(f"{side[:3]}_depth_{n}") for n in levels for side in ("bids", "asks")]
    obi = [S.imbalance(S.depth(F.col("bids"), n), S.depth(F.col("asks"), n)).alias(f"obi_{n}") for n in levels]
    return last.select(cut_id, "outcome", "best_bid", "best_ask", "mid", (F.col("best_ask") - F.col("best_bid")).alias("spread"), *depths, *obi, "age_ms")


def mid_changes(cuts: DataFrame, book: DataFrame, key: str, cut_id: str, cut: str, lags_ms: list[int]) -> DataFrame:
    """cut_id, lag_ms, change: the mid at the cut less the mid at each lag before it; null if either is not known."""
    both = at_targets(cuts.select(cut_id, key, F.col(cut).alias("receive_ms")), book.where("book_state_valid").select(key, "receive_ms", "seq", "mid"), key, "receive_ms", "mid", [0, *lags_ms], "seq")
    now = F.max(F.when(F.col("lag_ms") == 0, F.col("mid"))).over(Window.partitionBy(cut_id))
    return both.withColumn("change", now - F.col("mid")).where("lag_ms > 0").select(cut_id, "lag_ms", "change")


def assemble(rows: DataFrame, features: dict[str, Column], needed: list[str], mode: str) -> DataFrame:
    """Feature rows: id sha256(condition|prediction time|mode), the features, and whether a model may use them, with the reasons.

    rows: condition_id, prediction_ts_ms, feature_cutoff_ms, label, clean, horizon_eligible and what features read.
    """
    out = rows.withColumns(features)
    why = F.array_compact(F.array(F.when(~F.coalesce("clean", F.lit(False)), "not_clean"), F.when(~F.coalesce("horizon_eligible", F.lit(False)), "censored"), *[F.when(F.col(c).isNull(), f"{c}_missing") for c in needed]))
    row_id = F.sha2(F.concat_ws("|", "condition_id", F.col("prediction_ts_ms").cast("string"), F.lit(mode)), 256)
    return out.select(row_id.alias("feature_row_id"), "condition_id", "prediction_ts_ms", "feature_cutoff_ms", F.lit(mode).alias("cutoff_mode"), "label", *features, (F.size(why) == 0).alias("model_eligible"), F.array_join(why, ";").alias("model_ineligible_reason"))


def feature_provenance(rows: DataFrame, sources: dict[str, tuple[str, str, str]], version: str) -> DataFrame:
    """One row per feature row and feature: source type, first and last source time, and why it is missing.

    sources: feature -> (source type, column of the first source time, column of the last).
    """
    entry = lambda f, kind, lo, hi: F.struct(F.lit(f).alias("feature_name"), F.lit(kind).alias("source_type"), F.col(lo).alias("source_timestamp_min_ms"), F.col(hi).alias("source_timestamp_max_ms"), F.when(F.col(f).isNull(), F.when(F.col(hi).isNull(), "NO_SOURCE").otherwise("NOT_DEFINED")).alias("missing_reason"))
    long = rows.select("condition_id", "prediction_ts_ms", "feature_cutoff_ms", F.explode(F.array(*[entry(f, *s) for f, s in sources.items()])).alias("p"))
    return long.select("condition_id", "prediction_ts_ms", "feature_cutoff_ms", "p.*", F.lit(version).alias("transform_version"))


def lineage_audit(provenance: DataFrame, truth_ms: DataFrame, known_sources: DataFrame) -> DataFrame:
    """condition_id, status: the first of POINT_IN_TIME, TRUTH_TIMESTAMP, MISSING_FILE, MISSING_SOURCE that a row fails, else PASS.

    truth_ms: condition_id, t0_ms. known_sources: source_type of the files that exist.
    """
    seen = provenance.join(known_sources.select("source_type", F.lit(True).alias("_known")), "source_type", "left")
    per = seen.groupBy("condition_id").agg(
        F.max(F.col("source_timestamp_max_ms") > F.col("feature_cutoff_ms")).alias("late"), F.min("prediction_ts_ms").alias("prediction"),
        F.max(F.col("_known").isNull()).alias("no_file"), F.max(F.col("missing_reason") == "NO_SOURCE").alias("no_source"),
    )
    both = per.join(truth_ms, "condition_id", "left")
    hit = lambda c: F.coalesce(c, F.lit(False))
    status = F.when(hit(F.col("late")), "POINT_IN_TIME").when(~F.coalesce(F.col("t0_ms") == F.col("prediction"), F.lit(False)), "TRUTH_TIMESTAMP").when(hit(F.col("no_file")), "MISSING_FILE").when(hit(F.col("no_source")), "MISSING_SOURCE").otherwise("PASS")
    return both.select("condition_id", status.alias("status"))


def source_context(provenance: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """Per group the sessions and versions of the files that its source_file lists (;-separated) name, and the files not found."""
    named = provenance.select(by, F.explode(F.array_distinct(F.split("source_file", ";"))).alias("file")).where("file <> ''").distinct()
    met = named.join(files.select("file", "session_id", "version"), "file", "left")
    return met.groupBy(by).agg(F.array_sort(F.collect_set("session_id")).alias("sessions"), F.array_sort(F.collect_set("version")).alias("versions"), F.count_if(F.col("session_id").isNull()).alias("unknown"))


def evidence_flags(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """rows with a boolean per test (unknown fails) and the names of those that fail."""
    flags = {name: F.coalesce(c, F.lit(False)) for name, c in tests.items()}
    out = rows.withColumns(flags)
    return out.withColumn("failures", F.array_compact(F.array(*[F.when(~F.col(n), n) for n in flags])))


def predictive_rows(rows: DataFrame, features: list[str], label: str, ms: str) -> DataFrame:
    """Rows with a label and all features, with the ISO week of their time; dropped_* columns count the rest on each row."""
    whole = F.col(label).isNotNull()
    for f in features:
        whole = whole & F.col(f).isNotNull()
    counts = rows.agg(F.count_if(F.col(label).isNull()).alias("dropped_label"), F.count_if(F.col(label).isNotNull() & ~whole).alias("dropped_features"))
    kept = rows.where(whole).select(ms, S.calendar_keys(F.col(ms))["iso_week"].alias("iso_week"), *features, label)
    return kept.crossJoin(F.broadcast(counts))


def market_coverage(windows: DataFrame, per_token: DataFrame, ticks: DataFrame, key: str) -> DataFrame:
    """Per market window the weakest token's coverage, the tick coverage, and which of them was expected.

    per_token: key, start_ms, outcome, coverage; ticks: key, start_ms, coverage. A token without rows has 0.
    """
    weakest = per_token.groupBy(key, "start_ms").agg(F.min("coverage").alias("book"), F.count("*").alias("tokens"))
    out = windows.select(key, "start_ms").join(weakest, [key, "start_ms"], "left").join(ticks.select(key, "start_ms", F.col("coverage").alias("tick")), [key, "start_ms"], "left")
    book = F.when(F.coalesce("tokens", F.lit(0)) < 2, 0.0).otherwise(F.col("book"))
    return out.select(key, "start_ms", book.alias("book_coverage"), "tick", (F.coalesce("tokens", F.lit(0)) > 0).alias("book_expected"))


def coverage_report(coverage: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """coverage with the number, the longest and the list of gaps of each window."""
    per = gaps.groupBy(*keys).agg(F.count("*").alias("gaps"), F.max(F.col("to_ms") - F.col("from_ms")).alias("max_gap_ms"), F.array_sort(F.collect_list(F.struct("from_ms", "to_ms"))).alias("gap_list"))
    out = coverage.join(per, keys, "left")
    return out.withColumn("gaps", F.coalesce("gaps", F.lit(0))).withColumn("max_gap_ms", F.coalesce("max_gap_ms", F.lit(0)))
