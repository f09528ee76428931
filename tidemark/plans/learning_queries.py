"""Selection, split, metric and model queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import first_reason, money
from tidemark.operators import datasets, metrics, models, simulation
from tidemark.plans.roles import ctes, role

ASOF = "1997-03-03 00:00:00"
FOLDS = {"train": 400, "validation": 60, "test": 60, "step": 300, "gap": 5}


def asof():
    return F.lit(ASOF).cast("timestamp_ntz")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "samples")


def selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = datasets.training_selection(samples(spark, sf), asof())
    return rows.groupBy(F.coalesce("reason", F.lit("selected")).alias("reason")).agg(F.count("*").alias("n"))


def scoped(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf).withColumn("reasons", datasets.learning_reasons(asof()))
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def folds(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return datasets.fold_plans(samples(spark, sf), kind=kind, **FOLDS)

    return run


def purged(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf)
    assigned = datasets.assign(rows, datasets.fold_plans(rows, kind="expanding", **FOLDS))
    return datasets.partition_counts(assigned)


def freeze(spark: SparkSession, sf: str) -> DataFrame:
    items = samples(spark, sf).select("sample_id", F.date_format("decision_date", "yyyy-MM-dd").alias("decision_text"), "sample_status")
    return datasets.frozen(items, ["sample_id"], ["decision_text", "sample_status"])


def orphaned(spark: SparkSession, sf: str) -> DataFrame:
    children = role(spark, sf, "versions").select("artifact_id", "version_id").distinct()
    return datasets.orphans(children, role(spark, sf, "links").where("status = 'success'"), ["artifact_id"])


def latest_vintage(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.latest(role(spark, sf, "receipts"), ["request_id"], "received_at", ["receipt_id"])


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "outcomes").where("mature")
    return rows.withColumns(metrics.scores(F.col("actual"), F.col("predicted"), F.col("probability")))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def row_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.row_weighted(_outcomes(spark, sf)))


def equal_date(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.equal_date_weighted(_outcomes(spark, sf)))


def ic(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.rank_ic(role(spark, sf, "outcomes").where("mature")))


def bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.calibration(role(spark, sf, "outcomes").where("mature")))


def _quantiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "outcomes").where("mature")
    return rows.withColumn("quantiles", F.create_map(F.lit("0.1"), F.col("predicted") - 0.1, F.lit("0.5"), F.col("predicted"), F.lit("0.9"), F.col("predicted") + 0.1))


def pinball(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.pinball(_quantiles(spark, sf)))


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.interval_coverage(_quantiles(spark, sf)))


def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "outcomes").select(F.concat(F.lit("p"), F.col("sample_id") % 5000).alias("prediction_id"), (F.col("sample_id") % 7000).alias("sample"), F.lit(5).alias("horizon"))
    return metrics.unique_only(rows, ["sample", "horizon"]).groupBy("duplicate").agg(F.count("*").alias("n"))


def missing(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "outcomes")
    predicted = rows.where("sample_id % 6 <> 0").select("sample_id")
    return rows.select("sample_id", "decision_date").join(predicted, "sample_id", "left_anti").groupBy("decision_date").agg(F.count("*").alias("n_missing"))


def overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf).withColumn("reasons", datasets.learning_reasons(asof())).select("sample_id", F.explode("reasons").alias("reason"))
    return metrics.reason_overlap(rows, ["sample_id"], "reason")


def readiness(spark: SparkSession, sf: str) -> DataFrame:
    """At least 100 samples over 180 days for each security."""
    ready = datasets.training_selection(samples(spark, sf), asof()).where("reason is null")
    out = ready.groupBy("security").agg(F.count("*").alias("n"), F.datediff(F.max("decision_date"), F.min("decision_date")).alias("days"))
    return out.withColumn("status", first_reason((F.col("n") < 100, "too_few_samples"), (F.col("days") < 180, "too_few_days")))


NAMES = ["x1", "x2"]


def _table(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "learning")


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.preprocess_stats(_table(spark, sf), NAMES), 6)


def constants(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf)
    return rounded(t.agg(F.avg("y").alias("mean"), ((F.count_if(F.col("y") > 0) + 1) / (F.count("*") + 2)).alias("frequency")))


def fitted(model: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = _table(spark, sf)
        predict = models.fit(t.where("id % 4 <> 0"), NAMES, "y", model)
        return rounded(predict(t.where("id % 4 = 0")).select("id", "prediction"), 6)

    return run


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.when(F.col("l_linenumber") % 2 == 0, "sell").otherwise("buy").alias("side")
    )
    costs = {"commission_bps": "5", "half_spread_bps": "2.5", "slippage_bps": "1.5", "sell_tax_bps": "3", "commission_fixed": "0.35", "other_fixed": "0.01"}
    reference = (F.col("cents").cast("decimal(16,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,6)")
    q = simulation.quote(reference, F.col("quantity"), F.col("side"), costs)
    out = orders.select("side", *[v.alias(k) for k, v in q.items()])
    return out.groupBy("side").agg(F.count("*").alias("n"), *[F.sum(c).cast("string").alias(c) for c in ("notional", "commission", "tax", "cash_change")])


def cents(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_partkey") * 5).cast("decimal(20,0)").alias("m"))
    return items.select(money(F.col("m") / F.lit(1000).cast("decimal(4,0)")).alias("amount")).groupBy().agg(F.sum("amount").cast("decimal(30,2)").cast("string").alias("total"), F.count("*").alias("n"))


def falls(spark: SparkSession, sf: str) -> DataFrame:
    nav = role(spark, sf, "bars").select("security", "trading_date", "close")
    return rounded(simulation.drawdown(nav, ["security"], "trading_date", "close"))


def turnovers(spark: SparkSession, sf: str) -> DataFrame:
    nav = role(spark, sf, "bars").select("security", F.col("close").alias("nav"))
    fills = role(spark, sf, "bars").where("volume % 2 = 0").select("security", F.col("open").alias("notional"))
    return rounded(simulation.turnover(fills, nav, ["security"]), 6)


_S = ctes("samples")
_A = f"TIMESTAMP '{ASOF}'"
_PICK = f"""CASE WHEN sample_status <> 'ready' THEN 'feature_sample_not_ready' WHEN feature_ready_at IS NULL OR feature_ready_at > intended_entry_at THEN 'feature_not_ready_before_entry'
 WHEN decision_at > {_A} OR feature_ready_at > {_A} THEN 'feature_after_training_asof' WHEN label_status <> 'ready' THEN 'label_not_ready'
 WHEN label_available_at IS NULL OR label_available_at > {_A} THEN 'label_after_training_asof' WHEN rights_available_at > {_A} THEN 'learning_rights_after_training_asof'
 WHEN NOT learning_ready THEN 'learning_rights_or_strict_pit_requirements_unmet' END"""
_ALL = f"""list_filter([CASE WHEN sample_status <> 'ready' THEN 'feature_sample_not_ready' END, CASE WHEN feature_ready_at IS NULL THEN 'feature_clock_missing' END,
 CASE WHEN feature_ready_at > intended_entry_at THEN 'feature_not_ready_before_entry' END, CASE WHEN decision_at > {_A} THEN 'decision_after_asof' END, CASE WHEN label_status <> 'ready' THEN 'label_not_ready' END,
 CASE WHEN label_available_at > {_A} THEN 'label_after_asof' END, CASE WHEN rights_available_at > {_A} THEN 'rights_after_asof' END], lambda x: x IS NOT NULL)"""


def _fold_sql(kind: str) -> str:
    n, v, t, step, gap = (FOLDS[k] for k in ("train", "validation", "test", "step", "gap"))
    first = "(SELECT min(d) FROM dates)" if kind == "expanding" else "a.d"
    return f"""
, dates AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT decision_date AS d FROM samples))
, plans AS (
  SELECT {first} AS train_from, b.d AS train_to, c.d AS validation_from, e.d AS validation_to, f.d AS test_from, g.d AS test_to, (x.i - {n}) // {step} AS fold, CAST(c.d AS TIMESTAMP) AS training_asof
  FROM dates x JOIN dates a ON a.i = x.i - {n} JOIN dates b ON b.i = x.i - 1 JOIN dates c ON c.i = x.i + {gap} JOIN dates e ON e.i = x.i + {gap + v - 1} JOIN dates f ON f.i = x.i + {2 * gap + v} JOIN dates g ON g.i = x.i + {2 * gap + v + t - 1}
  WHERE x.i >= {n} AND (x.i - {n}) % {step} = 0)"""


_O = ctes("outcomes") + ", m AS (SELECT *, CASE WHEN actual > 0 THEN 1 ELSE 0 END AS up, least(1 - 1e-15, greatest(1e-15, probability)) AS pr FROM outcomes WHERE mature)"
_SCORES = """, s AS (SELECT decision_date, abs(predicted - actual) AS mae, (predicted - actual) * (predicted - actual) AS mse, CASE WHEN (predicted > 0) = (actual > 0) THEN 1.0::DOUBLE ELSE 0.0 END AS direction_accuracy,
 (probability - up) * (probability - up) AS brier, -(up * ln(pr) + (1 - up) * ln(1 - pr)) AS binary_log_loss FROM m)"""
_MEANS = ", ".join(f"round(avg({n}), 9) AS {n}" for n in metrics.NAMES)
_L = ctes("learning")
_RIDGE = """
, t AS (SELECT * FROM learning WHERE id % 4 <> 0), md AS (SELECT median(x1) AS m1, median(x2) AS m2 FROM t)
, g AS (SELECT y, coalesce(x1, m1) AS x1, coalesce(x2, m2) AS x2 FROM t, md)
, p AS (SELECT avg(x1) AS a1, avg(x2) AS a2, stddev_pop(x1) AS d1, stddev_pop(x2) AS d2, avg(y) AS ay, count(*) AS n FROM g)
, z AS (SELECT (x1 - a1) / d1 AS z1, (x2 - a2) / d2 AS z2, y - ay AS y FROM g, p)
, s AS (SELECT sum(z1 * z1) + 1 AS s11, sum(z2 * z2) + 1 AS s22, sum(z1 * z2) AS s12, sum(z1 * y) AS b1, sum(z2 * y) AS b2 FROM z)
, w AS (SELECT (s22 * b1 - s12 * b2) / (s11 * s22 - s12 * s12) AS w1, (s11 * b2 - s12 * b1) / (s11 * s22 - s12 * s12) AS w2 FROM s)
SELECT id, round(ay + w1 * (coalesce(x1, m1) - a1) / d1 + w2 * (coalesce(x2, m2) - a2) / d2, 6) AS prediction FROM learning, md, p, w WHERE id % 4 = 0"""

QUERIES = {
    "training_selection": (selection, _S + f"\nSELECT coalesce({_PICK}, 'selected') AS reason, count(*) AS n FROM samples GROUP BY 1"),
    "learning_reasons": (scoped, _S + f"\nSELECT reason, count(*) AS n FROM (SELECT unnest({_ALL}) AS reason FROM samples) GROUP BY 1"),
    "fold_plan_expanding": (folds("expanding"), _S + _fold_sql("expanding") + "\nSELECT * FROM plans"),
    "fold_plan_rolling": (folds("rolling"), _S + _fold_sql("rolling") + "\nSELECT * FROM plans"),
    "purged_partitions": (
        purged,
        _S
        + _fold_sql("expanding")
        + """
, j AS (SELECT s.*, p.*, CASE WHEN decision_date BETWEEN train_from AND train_to THEN 'train' WHEN decision_date BETWEEN validation_from AND validation_to THEN 'validation' WHEN decision_date BETWEEN test_from AND test_to THEN 'test' END AS partition
        FROM samples s JOIN plans p ON s.decision_date BETWEEN p.train_from AND p.test_to
), k AS (SELECT *, min(decision_at) FILTER (partition = 'validation') OVER (PARTITION BY fold) AS fv, min(decision_at) FILTER (partition = 'test') OVER (PARTITION BY fold) AS ft FROM j WHERE partition IS NOT NULL
), r AS (SELECT fold, partition, (partition = 'train' AND (NOT coalesce(label_available_at <= training_asof, false) OR intended_exit_at IS NULL OR intended_exit_at >= fv)) OR (partition = 'validation' AND (intended_exit_at IS NULL OR intended_exit_at >= ft))
          OR (partition = 'test' AND intended_exit_at IS NULL) AS gone FROM k)
SELECT fold, partition, count(*) FILTER (NOT gone) AS n_members, count(*) FILTER (gone) AS n_excluded, CASE WHEN count(*) FILTER (NOT gone) >= 1 THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS status FROM r GROUP BY 1, 2""",
    ),
    "dataset_freeze": (freeze, _S + "\nSELECT sample_id, sha256('=' || sample_id || '|=' || strftime(decision_date, '%Y-%m-%d') || '|=' || sample_status) AS content_sha256 FROM samples"),
    "audit_orphans": (orphaned, ctes("versions", "links") + "\nSELECT DISTINCT artifact_id, version_id FROM versions v WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.artifact_id = v.artifact_id AND l.status = 'success')"),
    "latest_vintage": (latest_vintage, ctes("receipts") + "\nSELECT request_id, arg_max(receipt_id, (received_at, receipt_id)) AS receipt_id, max(received_at) AS received_at, arg_max(status, (received_at, receipt_id)) AS status FROM receipts GROUP BY 1"),
    "metrics_row_weighted": (row_weighted, _O + _SCORES + f"\nSELECT count(*) AS n, {_MEANS} FROM s"),
    "metrics_equal_date": (equal_date, _O + _SCORES + ", d AS (SELECT decision_date, " + ", ".join(f"avg({n}) AS {n}" for n in metrics.NAMES) + f" FROM s GROUP BY 1)\nSELECT count(*) AS n_dates, {_MEANS} FROM d"),
    "rank_ic_by_date": (
        ic,
        _O
        + """
, r AS (SELECT decision_date, security, rank() OVER (PARTITION BY decision_date ORDER BY predicted) + (count(*) OVER (PARTITION BY decision_date, predicted) - 1) / 2.0 AS x,
               rank() OVER (PARTITION BY decision_date ORDER BY actual) + (count(*) OVER (PARTITION BY decision_date, actual) - 1) / 2.0 AS y FROM m
), g AS (SELECT decision_date, count(*) AS n, count(DISTINCT security) AS s, stddev_pop(x) AS sx, stddev_pop(y) AS sy, covar_pop(x, y) AS c FROM r GROUP BY 1
), w AS (SELECT *, CASE WHEN s < n THEN 'duplicate_security_on_decision_date' WHEN n < 2 THEN 'fewer_than_two_securities' WHEN sx = 0 OR sy = 0 THEN 'constant_predictions_or_targets' END AS reason FROM g)
SELECT decision_date, n, CASE WHEN reason IS NULL THEN round(c / (sx * sy), 9) END AS rank_ic, reason FROM w""",
    ),
    "calibration_bins": (
        bins,
        _O
        + """
, b AS (SELECT CAST(least(9, floor(probability * 10)) AS INTEGER) AS bin, probability, up FROM m)
SELECT CAST(i.range AS INTEGER) AS bin, count(b.bin) AS n, round(avg(probability), 9) AS mean_probability, round(avg(up), 9) AS up_frequency FROM range(10) i LEFT JOIN b ON b.bin = i.range GROUP BY 1""",
    ),
    "pinball_loss": (
        pinball,
        _O
        + """
, q AS (SELECT actual, unnest([0.1::DOUBLE, 0.5, 0.9]) AS q, unnest([predicted - 0.1, predicted, predicted + 0.1]) AS v FROM m)
SELECT q, count(*) AS n, round(avg(greatest(q * (actual - v), (q - 1) * (actual - v))), 9) AS pinball_loss FROM q GROUP BY 1""",
    ),
    "interval_coverage": (coverage, _O + "\nSELECT 0.1::DOUBLE AS low, 0.9::DOUBLE AS high, count(*) AS n, round(avg(CASE WHEN actual BETWEEN predicted - 0.1 AND predicted + 0.1 THEN 1.0 ELSE 0.0 END), 9) AS coverage FROM m"),
    "prediction_duplicates": (
        duplicates,
        ctes("outcomes") + "\n, d AS (SELECT count(*) OVER (PARTITION BY sample_id % 7000) > 1 OR count(*) OVER (PARTITION BY sample_id % 5000) > 1 AS duplicate FROM outcomes)\nSELECT duplicate, count(*) AS n FROM d GROUP BY 1",
    ),
    "prediction_missing": (missing, ctes("outcomes") + "\nSELECT decision_date, count(*) AS n_missing FROM outcomes WHERE sample_id % 6 = 0 GROUP BY 1"),
    "reason_overlap": (
        overlap,
        _S + f"\n, r AS (SELECT sample_id, unnest({_ALL}) AS reason FROM samples)\nSELECT a.reason AS first, b.reason AS second, count(*) AS n_samples FROM r a JOIN r b ON a.sample_id = b.sample_id AND a.reason <= b.reason GROUP BY 1, 2",
    ),
    "readiness": (
        readiness,
        _S
        + f"""
, r AS (SELECT security, count(*) AS n, CAST(date_diff('day', min(decision_date), max(decision_date)) AS INTEGER) AS days FROM samples WHERE {_PICK} IS NULL GROUP BY 1)
SELECT *, CASE WHEN n < 100 THEN 'too_few_samples' WHEN days < 180 THEN 'too_few_days' END AS status FROM r""",
    ),
    "preprocess_stats": (
        stats,
        _L
        + "".join(f"\n, s{k} AS (SELECT '{x}' AS feature, count(*) AS n, count(*) FILTER ({x} IS NULL) AS n_missing, (SELECT median({x}) FROM learning) AS median, avg(coalesce({x}, (SELECT median({x}) FROM learning))) AS mean, stddev_pop(coalesce({x}, (SELECT median({x}) FROM learning))) AS std FROM learning)" for k, x in enumerate(NAMES))
        + "\nSELECT feature, n, n_missing, round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std, false AS constant FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1)",
    ),
    "mean_frequency_baseline": (constants, _L + "\nSELECT round(avg(y), 9) AS mean, round((count(*) FILTER (y > 0) + 1) / (count(*) + 2), 9) AS frequency FROM learning"),
    "ridge_fit": (fitted("ridge"), _L + _RIDGE),
    "logistic_fit": (fitted("logistic"), None),
    "tree_fit": (fitted("tree"), None),
    "cost_quote": (
        quotes,
        """
WITH o AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'sell' ELSE 'buy' END AS side, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS HUGEINT) AS c FROM lineitem
), p AS (SELECT side, q, CASE WHEN side = 'buy' THEN c * 10004 ELSE c * 9996 END AS micro FROM o
), n AS (SELECT side, round_even(CAST(CAST(micro AS DECIMAL(30, 0)) * q AS DECIMAL(34, 0)) / 1, 0) AS raw, micro * q AS units FROM p
), k AS (SELECT side, (units // 10000) + CASE WHEN units % 10000 > 5000 OR (units % 10000 = 5000 AND (units // 10000) % 2 = 1) THEN 1 ELSE 0 END AS cents FROM n
), f AS (SELECT side, cents, cents * 5 AS fee, cents * 3 AS tx FROM k
), g AS (SELECT side, cents, (fee // 10000) + CASE WHEN fee % 10000 > 5000 OR (fee % 10000 = 5000 AND ((fee // 10000) + 35) % 2 = 1) THEN 1 ELSE 0 END + 35 AS commission,
         CASE WHEN side = 'sell' THEN (tx // 10000) + CASE WHEN tx % 10000 > 5000 OR (tx % 10000 = 5000 AND (tx // 10000) % 2 = 1) THEN 1 ELSE 0 END ELSE 0 END AS tax FROM f)
SELECT side, count(*) AS n, CAST(CAST(sum(cents) AS DECIMAL(36, 2)) / 100 AS DECIMAL(36, 2))::VARCHAR AS notional, CAST(CAST(sum(commission) AS DECIMAL(36, 2)) / 100 AS DECIMAL(36, 2))::VARCHAR AS commission,
       CAST(CAST(sum(tax) AS DECIMAL(36, 2)) / 100 AS DECIMAL(36, 2))::VARCHAR AS tax,
       CAST(CAST(sum(CASE WHEN side = 'buy' THEN -(cents + commission + tax + 1) ELSE cents - commission - tax - 1 END) AS DECIMAL(36, 2)) / 100 AS DECIMAL(36, 2))::VARCHAR AS cash_change
FROM g GROUP BY 1""".replace("round_even(CAST(CAST(micro AS DECIMAL(30, 0)) * q AS DECIMAL(34, 0)) / 1, 0) AS raw, ", ""),
    ),
    "money_half_even": (
        cents,
        """
WITH m AS (SELECT CAST(l_partkey AS HUGEINT) * 5 AS m FROM lineitem), c AS (SELECT (m // 10) + CASE WHEN m % 10 > 5 OR (m % 10 = 5 AND (m // 10) % 2 = 1) THEN 1 ELSE 0 END AS c FROM m)
SELECT CAST(CAST(sum(c) AS DECIMAL(36, 2)) / 100 AS DECIMAL(30, 2))::VARCHAR AS total, count(*) AS n FROM c""",
    ),
    "drawdown": (falls, ctes("bars") + "\n, p AS (SELECT security, close, max(close) OVER (PARTITION BY security ORDER BY trading_date) AS peak FROM bars)\nSELECT security, round(max((peak - close) / peak), 9) AS max_drawdown FROM p GROUP BY 1"),
    "turnover": (turnovers, ctes("bars") + "\nSELECT security, round(coalesce(sum(open) FILTER (volume % 2 = 0), 0) / avg(close), 6) AS turnover FROM bars GROUP BY 1"),
}
