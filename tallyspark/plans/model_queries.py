"""Registered queries of models over time. Iterative fits have no SQL twin; tests compare them with plain numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import models as M
from tallyspark.operators.evaluation import shuffle_control
from tallyspark.plans.more_queries import SHUFFLED, shuffle_sql
from tallyspark.plans.queries import r6, register
from tallyspark.sources import fixtures as X
from tallyspark.sources.fixtures import with_sql

GROUPS = {"M0": [], "M1": ["price"], "M2": ["price", "day"], "M3": ["price", "day", "customer"]}
FACTORS = {"price": ["price"], "gap": ["gap"], "price_x_gap": ["price", "gap"]}


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year: whether one is urgent, from its price, day and customer; the gap is missing in every ninth."""
    o = X.table(spark, sf_dir, "orders")
    day = F.dayofyear("o_orderdate").cast("double")
    noise = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return o.select(
        F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), ((F.col("o_totalprice") > 200000) | noise).cast("int").alias("y"), (F.col("o_totalprice") / 1000).alias("price"), day.alias("day"),
        (F.col("o_custkey") % 97).cast("double").alias("customer"), F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_orderkey") % 31).cast("double")).alias("gap"),
    )


def _walk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return M.walk_forward(_rows(spark, sf_dir), "year", "y", GROUPS, 3, 30)


@register("m06_walk_forward_models")
def walk_forward_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses and AUC of nested logistic models in expanding folds."""
    return M.fold_metrics(_walk(spark, sf_dir)[0])


@register("m07_group_coefficients")
def group_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of every feature group and fold, with median imputation and missing indicators."""
    return _walk(spark, sf_dir)[1]


@register("m08_attribution")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature group adds to M1, and the least stable coefficient of each."""
    predictions, coefficients = _walk(spark, sf_dir)
    stable = M.coefficient_stability(coefficients).groupBy("model").agg(F.min("sign_share").alias("least_sign_share"))
    return M.attribution(M.fold_metrics(predictions), "M1").join(stable, "model")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "labels").join(X.table(spark, sf_dir, "documents").select("doc_id", "lang", F.log1p("n_chars").alias("size")), "doc_id").where("quality is not null")


@register("m11_shuffle_refit")
def shuffle_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out AUC of labels of documents by their length, as they are and permuted inside each language."""
    return M.shuffle_refit(_graded(spark, sf_dir), "doc_id", "quality", ["size"], 5, strata=["lang"])


@register("m11_global_shuffle")
def global_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of permutations over all documents, a diagnostic."""
    return M.shuffle_summary(M.shuffle_refit(_graded(spark, sf_dir), "doc_id", "quality", ["size"], 5))


@register("m11_permuted_labels", """WITH s AS (SELECT o_orderkey AS id, o_orderpriority AS stratum, (o_orderstatus = 'F')::INT AS y, i AS shuffle FROM orders, range(3) t(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY shuffle, stratum ORDER BY md5(id || ':' || shuffle || ':row')) AS a, row_number() OVER (PARTITION BY shuffle, stratum ORDER BY md5(id || ':' || shuffle || ':label')) AS b FROM s)
SELECT x.id, x.stratum, x.shuffle::INTEGER AS shuffle, y.y AS label FROM r x JOIN r y ON x.shuffle = y.shuffle AND x.stratum = y.stratum AND x.a = y.b""")
def permuted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of orders permuted three times inside their priorities."""
    o = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("stratum"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return M.permuted_labels(o, "id", "y", 3, ["stratum"]).select("id", "stratum", "shuffle", "label")


@register("m12_factors")
def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of one input or a product, each evaluated in expanding folds."""
    return M.evaluate_factors(_rows(spark, sf_dir), "year", "y", FACTORS, 3, 30)


_ORDERS = """o AS (SELECT o_orderkey AS id, year(o_orderdate) AS period, (o_totalprice > 200000 OR o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS y, o_totalprice / 1000 AS price, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 31)::DOUBLE END AS gap FROM orders)"""
_NULLS = " UNION ALL ".join(f"SELECT '{n}' AS factor, * FROM (WITH {_ORDERS}, f AS (SELECT id, period, y, {' * '.join(c)} AS p FROM o WHERE {' * '.join(c)} IS NOT NULL), {shuffle_sql('f', 10)} SELECT {SHUFFLED})" for n, c in FACTORS.items())


@register("m13_factor_null_control", _NULLS)
def factor_null_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of stored factor scores under labels shuffled inside each period."""
    rows = _rows(spark, sf_dir)
    out = None
    for name, inputs in FACTORS.items():
        own = rows.withColumn("p", M.factor_value(inputs)).where("p is not null")
        row = shuffle_control(own, "id", "year", "y", "p", 10).withColumn("factor", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.withColumns(r6("mean", "p95", "most"))


@register("m14_baseline_evidence", f"""{with_sql("scores")}, per AS (SELECT period, count(*) AS n, sum(y) AS pos FROM scores GROUP BY 1), past AS (SELECT a.period, count(*) AS k, sum(b.pos) / sum(b.n) AS rate FROM per a JOIN per b ON b.period < a.period GROUP BY 1 HAVING count(*) >= 4),
s AS (SELECT s.period, y, greatest(1e-6, least(1 - 1e-6, p)) AS p, greatest(1e-6, least(1 - 1e-6, rate)) AS q FROM scores s JOIN past USING (period)),
d AS (SELECT period, avg((p - y) * (p - y)) - avg((q - y) * (q - y)) AS b, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) - avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END) AS l FROM s GROUP BY 1)
SELECT count(*) AS folds, round(avg(b), 6) AS delta_brier, round(avg(l), 6) AS delta_log_loss, round(avg((b < 0)::INT), 6) AS share_improved FROM d""")  # fmt: skip
def baseline_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of orders against the rate of all earlier months."""
    return M.baseline_evidence(X.scores(spark, sf_dir), "period", "y", "p", 4).withColumns(r6("delta_brier", "delta_log_loss", "share_improved"))
