"""Audits over whole tables: selection of covered rows, drift by week, domains of values, eligibility, gates, latency breakdowns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import reasons
from tallyspark.operators.grid import latency_statistics

#: Absolute standardised differences from which a difference is noticeable, and above which it is material.
NOTICEABLE, MATERIAL = 0.10, 0.20


def unpivoted(rows: DataFrame, keep: list[str], fields: list[str], kind: str = "double") -> DataFrame:
    """keep, variable, value: a row per field; nulls stay."""
    one = [F.struct(F.lit(f).alias("variable"), F.col(f).cast(kind).alias("value")) for f in fields]
    return rows.select(*keep, F.explode(F.array(*one)).alias("_v")).select(*keep, "_v.variable", "_v.value")


def _finite(c: str = "value") -> Column:
    return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))


def _group_stats(flag: Column, name: str) -> list[Column]:
    v = F.when(flag, F.col("value"))
    p = lambda s: F.percentile(v, F.lit(s))
    return [
        F.count(v).alias(f"n_{name}"), F.count_if(flag & F.col("value").isNull()).alias(f"missing_{name}"), F.avg(v).alias(f"mean_{name}"), p(0.5).alias(f"median_{name}"),
        F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v)).alias(f"std_{name}"), p(0.25).alias(f"p25_{name}"), p(0.75).alias(f"p75_{name}"),
    ]


def compared_groups(rows: DataFrame, flag: str, fields: list[str]) -> DataFrame:
    """variable and, for rows with flag (1) and without (0), n, missing, mean, median, std, p25, p75; smd (pooled sample deviation), note, magnitude.

    Two constant groups with one value differ by 0; with two values, or where a group is empty, smd is null and note says why. A null flag is no flag.
    """
    own = F.coalesce(F.col(flag), F.lit(False))
    out = unpivoted(rows.withColumn("_flag", own), ["_flag"], fields).groupBy("variable").agg(*_group_stats(F.col("_flag"), "1"), *_group_stats(~F.col("_flag"), "0"))
    pooled = (F.col("std_1") * F.col("std_1") + F.col("std_0") * F.col("std_0")) / 2
    empty, flat, same = (F.col("n_1") == 0) | (F.col("n_0") == 0), pooled == 0, F.col("mean_1") == F.col("mean_0")
    smd = F.when(empty, F.lit(None)).when(flat & same, F.lit(0.0)).when(flat, F.lit(None)).otherwise((F.col("mean_1") - F.col("mean_0")) / F.sqrt(F.nullif(pooled, F.lit(0.0))))
    note = F.when(empty, "EMPTY_GROUP").when(flat & same, "IDENTICAL_CONSTANTS").when(flat, "DIFFERENT_CONSTANTS")
    size = F.abs("smd")
    magnitude = F.when(F.col("smd").isNull(), "undefined").when(size < NOTICEABLE, "small").when(size <= MATERIAL, "noticeable").otherwise("material")
    return out.withColumn("smd", smd.cast("double")).withColumn("note", note).withColumn("magnitude", magnitude)


def selection_bias(rows: DataFrame, flag: str, before: list[str], whole: list[str], least: int = 2) -> DataFrame:
    """compared_groups() of both lists, with pre (the variable is known before the flag), material_pre and status.

    WARN when `least` variables of `before` or more are material; those of `whole` are reported only.
    """
    out = compared_groups(rows, flag, [*before, *whole]).withColumn("pre", F.col("variable").isin(*before))
    total = out.agg(F.count_if(F.col("pre") & (F.col("magnitude") == "material")).alias("material_pre"))
    return out.crossJoin(F.broadcast(total)).withColumn("status", F.when(F.col("material_pre") >= least, "WARN").otherwise("PASS"))  # one row joins one per variable


def coverage_selection(rows: DataFrame, flag: str, label: str, fields: list[str], warn_pp: float = 5.0) -> DataFrame:
    """variable, covered_n, uncovered_n, smd, note; the label's rates of both groups, their difference in percentage points and status.

    A difference of warn_pp or more is a COVERAGE_SELECTION_WARNING; without a group the rates are NOT_COMPARABLE.
    """
    own = F.coalesce(F.col(flag), F.lit(False))
    rates = rows.agg(F.count_if(own).alias("_a"), F.count_if(~own).alias("_b"), F.avg(F.when(own, F.col(label).cast("double"))).alias("covered_rate"), F.avg(F.when(~own, F.col(label).cast("double"))).alias("uncovered_rate"))
    delta = (F.col("covered_rate") - F.col("uncovered_rate")) * 100
    status = F.when(F.col("_a") == 0, "NOT_COMPARABLE_NO_COVERED").when(F.col("_b") == 0, "NOT_COMPARABLE_NO_UNCOVERED").when(F.abs("delta_pp") >= warn_pp, "COVERAGE_SELECTION_WARNING").otherwise("REPORTED")
    rates = rates.withColumn("delta_pp", delta).withColumn("status", status).drop("_a", "_b")
    out = compared_groups(rows, flag, fields).select("variable", F.col("n_1").alias("covered_n"), F.col("n_0").alias("uncovered_n"), "smd", "note")
    return out.crossJoin(F.broadcast(rates))  # one row joins one per variable


def weekly_drift(rows: DataFrame, week: str, fields: list[str], bins: int = 10) -> DataFrame:
    """feature, week, count, mean, median, std, p25, p75, smd and psi against the first week, label, missing_rate and its change.

    smd is pooled by population variances, from the first week to the other. psi has the first week's quantiles as edges
    (distinct ones; outer bins are open) and shares of at least 1e-6; LOW below .1, NOTICEABLE up to .25, else MATERIAL.
    """
    long = unpivoted(rows.where(F.col(week).isNotNull()), [week], fields).withColumn("value", _finite())
    per = long.groupBy(F.col("variable").alias("feature"), week).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.when(F.count("value") == 1, F.lit(0.0)).otherwise(F.stddev_samp("value")).alias("std"),
        F.percentile("value", F.lit(0.25)).alias("p25"), F.percentile("value", F.lit(0.75)).alias("p75"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"), F.var_pop("value").alias("_var"),
        F.percentile("value", F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("_q"),
    )
    start = per.agg(F.min(week).alias("_first"))
    first = per.crossJoin(F.broadcast(start)).where(F.col(week) == F.col("_first"))  # one row
    first = first.select(F.col("feature").alias("_f"), F.col("count").alias("_n"), F.col("mean").alias("_mean"), F.col("_var").alias("_v"), F.col("missing_rate").alias("_missing"), F.array_distinct("_q").alias("_edges"), F.col("_first"))
    binned = long.join(F.broadcast(first.select("_f", "_edges")), F.col("variable") == F.col("_f")).where("value is not null")
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    at = F.when(F.size("_edges") > 1, F.size(F.filter(inner, lambda e: e <= F.col("value")))).when(F.col("value") == F.col("_edges")[0], 0).otherwise(-1)
    shares = binned.groupBy("variable", week, at.alias("bin")).agg(F.count("*").alias("k"))
    # every bin of the first week's edges, in every week: features x weeks x bins
    grid = per.select("feature", week, F.col("count").alias("_m")).join(F.broadcast(first), F.col("feature") == F.col("_f")).select("feature", week, "_m", "_n", "_first", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_edges") - 2, F.lit(0)))).alias("bin"), F.size("_edges").alias("_e"))
    own = shares.select(F.col("variable").alias("_f"), F.col(week).alias("_w"), F.col("bin").alias("_b"), "k")
    both = grid.join(own, (F.col("feature") == F.col("_f")) & (F.col(week) == F.col("_w")) & (F.col("bin") == F.col("_b")), "left").drop("_f", "_w", "_b")
    base = own.select("_f", "_w", "_b", F.col("k").alias("k0"))
    both = both.join(base, (F.col("feature") == F.col("_f")) & (F.col("_first") == F.col("_w")) & (F.col("bin") == F.col("_b")), "left")
    share = lambda k, n: F.greatest(F.coalesce(k, F.lit(0)) / n, F.lit(1e-6))
    a, e = share(F.col("k"), F.col("_m")), share(F.col("k0"), F.col("_n"))
    one = F.when(F.coalesce(F.sum("k"), F.lit(0)) == F.max("_m"), F.lit(0.0))
    psi = both.where("_m > 0 and _n > 0").groupBy("feature", week).agg(F.when(F.max("_e") > 1, F.sum((a - e) * F.log(a / e))).otherwise(one).alias("psi"))
    out = per.join(psi, ["feature", week], "left").join(F.broadcast(first), F.col("feature") == F.col("_f"))
    spread = F.sqrt((F.col("_v") + F.col("_var")) / 2)
    out = out.withColumn("smd", F.when(spread > 0, (F.col("mean") - F.col("_mean")) / spread).when(F.col("mean") == F.col("_mean"), 0.0))
    label = F.when(F.col("psi").isNull(), "UNDEFINED").when(F.col("psi") < 0.1, "LOW").when(F.col("psi") <= 0.25, "NOTICEABLE").otherwise("MATERIAL")
    return out.select("feature", week, "count", "mean", "median", "std", "p25", "p75", "smd", "psi", label.alias("label"), "missing_rate", (F.col("missing_rate") - F.col("_missing")).alias("missing_drift"))


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PRICES, COINS, CHANGES = ["opp_best_bid", "opp_best_ask", "opp_mid"], ["btc_start_price", "btc_last_price", "btc_cutoff_price"], ["pm_obi_change_1s", "pm_obi_change_5s"]


def governed(fields: list[str]) -> list[str]:
    """Fields whose values the audits look at."""
    return [f for f in fields if f in PRICES + COINS or "obi" in f or "depth" in f]


def domain_violations(rows: DataFrame, id_: str, fields: list[str], version: int = 2) -> DataFrame:
    """id_, field, reason of the values (text) that are out of their domains; nulls are not looked at.

    Prices lie in [0, 1], coin prices above 0, depths at 0 or above, imbalances in [-1, 1]; a bid above its ask is a
    CROSSED_BOOK. Version 2 lets changes of imbalances lie in [-2, 2], reports text that is no number or not finite, and
    compares decimals, so that no rounding admits a value; version 1 passes over what is no number and compares doubles.
    """
    long = unpivoted(rows, [id_], governed(fields), "string").where("value is not null").withColumnRenamed("variable", "field")
    text = F.trim("value")
    number = text.rlike(_NUMBER)
    name = F.col("field")
    inside = F.lit(version == 2) & name.isin(*CHANGES)
    top = F.when(name.isin(*PRICES), 1).when(name.contains("obi"), F.when(inside, 2).otherwise(1))
    low = F.when(name.isin(*PRICES), 0).otherwise(-top)
    negative, zero = text.startswith("-"), ~F.regexp_replace(text, "[eE].*$", "").rlike("[1-9]")
    if version == 2:
        exact = F.expr("try_cast(trim(value) AS decimal(38,36))")  # null beyond 99, which no bound reaches
        bound = lambda c: c.cast("decimal(38,36)")  # noqa: E731  with another type digits would be rounded off
        off = F.when(top.isNotNull(), exact.isNull() | (exact > bound(top)) | (exact < bound(low))).otherwise(F.lit(False))
        off = off | (name.isin(*COINS) & (negative | zero)) | (name.contains("depth") & negative & ~zero)
        reason = F.when(F.lower(text).rlike("^[+-]?(nan|inf|infinity)$"), "NONFINITE_VALUE").when(~number, "INVALID_NUMERIC_VALUE").when(off, "OUT_OF_RANGE")
    else:
        v = F.when(number, F.expr("try_cast(trim(value) AS double)"))
        off = ((v > top) | (v < low)) | (name.isin(*COINS) & (v <= 0)) | (name.contains("depth") & (v < 0))
        reason = F.when(off, "OUT_OF_RANGE")
    found = long.select(id_, "field", reason.alias("reason")).where("reason is not null")
    crossed = (F.expr("try_cast(trim(opp_best_bid) AS decimal(38,36))") > F.expr("try_cast(trim(opp_best_ask) AS decimal(38,36))")) if version == 2 else F.expr("try_cast(opp_best_bid AS double) > try_cast(opp_best_ask AS double)")
    return found.unionByName(rows.where(crossed).select(id_, F.lit("crossed_book").alias("field"), F.lit("CROSSED_BOOK").alias("reason")))


def audit_comparison(rows: DataFrame, id_: str, fields: list[str], candidate: Column, date: Column) -> DataFrame:
    """section, name, n over the candidate rows: transitions from version 1's status to version 2's, violated fields of both versions, and rows by date."""
    own = rows.where(candidate).withColumn("_date", date)
    bad = {v: domain_violations(own, id_, fields, v) for v in (1, 2)}
    status = lambda v: bad[v].select(id_).distinct().withColumn(f"_v{v}", F.lit("DATA_SANITY_WARNING"))
    both = own.select(id_, "_date").join(status(1), id_, "left").join(status(2), id_, "left")
    name = F.concat(F.coalesce("_v1", F.lit("PASS")), F.lit(" -> "), F.coalesce("_v2", F.lit("PASS")))
    counted = lambda df, section, c: df.groupBy(F.lit(section).alias("section"), c.alias("name")).agg(F.count("*").alias("n"))
    out = [counted(both, "transition", name), counted(both, "date", F.col("_date")), *[counted(bad[v], f"v{v}_field", F.col("field")) for v in (1, 2)]]
    return reduce(DataFrame.unionByName, out)


def gate(hard: dict[str, Column], available: Column, soft: list[tuple[Column, str]]) -> tuple[Column, Column]:
    """(verdict, reasons): BLOCKED with the names of all hard flags that are not exactly true, or for want of a model's output; else REJECT with the reasons that hold; else ACCEPT."""
    blocked = reasons(*[(~F.coalesce(flag, F.lit(False)), name) for name, flag in hard.items()])
    lacking = ~F.coalesce(available, F.lit(False))
    rejected = reasons(*soft)
    verdict = F.when((F.size(blocked) > 0) | lacking, "BLOCKED").when(F.size(rejected) > 0, "REJECT").otherwise("ACCEPT")
    why = F.when(F.size(blocked) > 0, blocked).when(lacking, F.array(F.lit("MODEL_OUTPUT_UNAVAILABLE"))).otherwise(rejected)
    return verdict, why


def eligibility(version: str, lifecycle: str, coverages: dict[str, str], collector: str, least: float = 0.99) -> Column:
    """Reasons why a row is not eligible: another collector version, not the full lifecycle, a coverage below least (null is none)."""
    low = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) < least, f"{name}_COVERAGE_LT_{round(least * 100)}") for name, c in coverages.items()]
    differs = lambda c, v: ~F.col(c).eqNullSafe(F.lit(v))
    return reasons((differs(version, collector), "COLLECTOR_VERSION_MISMATCH"), (differs(lifecycle, "FULL_LIFECYCLE_MARKET"), "PARTIAL_SESSION_MARKET"), *low)


def primary_decision(why: Column, started_ms: str, effective_ms: int, fix: str, needed: str) -> tuple[Column, Column, Column]:
    """(status, reasons, included) under a policy in force from a time on, for sessions that began then or later with the needed fix; earlier ones are excluded whatever they are."""
    after = (F.coalesce(F.col(started_ms), F.lit(-1)) >= effective_ms) & F.col(fix).eqNullSafe(F.lit(needed))
    own = F.when(after, why).otherwise(F.array(F.lit("PRE_EFFECTIVE_POLICY_SESSION")))
    return F.when(F.size(own) == 0, "ELIGIBLE").otherwise("EXCLUDED"), own, F.size(own) == 0


def latency_rows(timeline: DataFrame, registry: DataFrame) -> DataFrame:
    """timeline with receive_minus_source_ms, state_age_ms (rows that carry state only), and the class, trust and granularity of its source's clock.

    timeline: source, source_event_ms (null without an event time), frame_ms, receive_ms, has_state. registry: source,
    timestamp_class, timestamp_trust, timestamp_granularity; a few rows. A source that it lacks is UNKNOWN.
    """
    known = F.broadcast(registry)
    out = timeline.join(known, "source", "left")
    out = out.withColumn("receive_minus_source_ms", F.col("receive_ms") - F.coalesce("source_event_ms", "frame_ms")).withColumn("state_age_ms", F.when(F.col("has_state"), F.col("receive_ms") - F.col("frame_ms")))
    return out.withColumns({c: F.coalesce(c, F.lit("UNKNOWN")) for c in ("timestamp_class", "timestamp_trust", "timestamp_granularity")})


def latency_by_sets(rows: DataFrame, sets: list[list[str]], delay: str, limits: list[int]) -> DataFrame:
    """latency_statistics() of every grouping set of columns, each with the source: grouping (its columns, joined by +), the columns as text (null where not grouped, or where the value is null), source.

    Nulls are a group of their own, apart from those of other sets.
    """
    dims = list(dict.fromkeys(c for s in sets for c in s))
    one = [F.struct(F.lit("+".join(s) or "all").alias("grouping"), *[(F.col(d).cast("string") if d in s else F.lit(None).cast("string")).alias(d) for d in dims]) for s in sets]
    spread = rows.select(F.explode(F.array(*one)).alias("_s"), "source", delay).select("_s.*", "source", delay)
    return latency_statistics(spread, ["grouping", *dims, "source"], delay, limits)
