"""Checks of predictions and metrics of them against outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import all_reasons, finite, first_reason

EPSILON = 1e-15
NAMES = ("mae", "mse", "direction_accuracy", "brier", "binary_log_loss")


#: Fields that a prediction has to have; of outputs one may be null.
REQUIRED = ("prediction_id", "sample_id", "model_or_signal_id", "model_version", "training_asof", "generated_at", "decision_at", "intended_entry_at", "horizon", "dataset_snapshot_id", "dataset_content_sha256", "feature_version_id", "feature_snapshot_id", "mode", "prediction_version", "generation_kind")
PREDICTION_VERSION = "1"
TASKS, TARGETS, MODES = ("regression", "classification", "legacy_joint"), ("price_return", "cash_total_return"), ("strict", "research", "synthetic")


def quantile_pairs() -> Column:
    """``predicted_quantiles`` as pairs (q, v) in order of the level; levels that are no numbers are null."""
    return F.array_sort(F.transform(F.map_entries("predicted_quantiles"), lambda e: F.struct(e["key"].try_cast("double").alias("q"), e["value"].alias("v"))))


def prediction_reasons(dataset_id: str, dataset_hash: str, mode: str, *, oracle_test: bool = False) -> Column:
    """All faults of a prediction beside its dataset row (columns row_*, null if there is none) and the numbers
    _ids, _bodies and _pairs of predictions that share its id, that differ under it, and that share its sample and horizon."""
    if mode not in MODES:
        raise ValueError(f"mode has to be one of {MODES}")
    task, pairs, has = F.coalesce("output_task", F.lit("legacy_joint")), quantile_pairs(), F.col("predicted_quantiles").isNotNull()
    unfit = (F.size(pairs) == 0) | (F.size(F.array_distinct(F.transform(pairs, lambda p: p["q"]))) < F.size(pairs)) | F.exists(pairs, lambda p: ~(F.coalesce((p["q"] > 0) & (p["q"] < 1), F.lit(False)) & finite(p["v"])))
    crossed = F.exists(F.transform(pairs, lambda p, i: (i > 0) & (F.get(pairs, i - 1)["v"] > p["v"])), lambda x: F.coalesce(x, F.lit(False)))
    probability = finite(F.col("probability_up")) & F.col("probability_up").between(0, 1)
    operational, replay = F.col("generation_kind") == "operational", F.col("generation_kind") == "replay"
    effective = effective_clock()
    known = F.col("row_feature_version_id").isNotNull()
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return all_reasons(
        (any_null(REQUIRED), "missing_prediction_field"),
        ((F.col("_ids") > 1) & (F.col("_bodies") == 1), "duplicate_prediction_id"),
        (F.col("_bodies") > 1, "conflicting_prediction_id"),
        (F.col("_pairs") > 1, "duplicate_sample_horizon_prediction"),
        (~known, "prediction_sample_not_in_dataset"),
        (no((F.col("dataset_snapshot_id") == dataset_id) & (F.col("dataset_content_sha256") == dataset_hash)), "prediction_dataset_mismatch"),
        (no((F.col("mode") == mode) & (F.col("prediction_version") == PREDICTION_VERSION)), "prediction_mode_or_version_mismatch"),
        (~task.isin(*TASKS), "invalid_output_task"),
        (~F.coalesce("target_id", F.lit(TARGETS[0])).isin(*TARGETS), "invalid_target_id"),
        ((task != "classification") & ~finite(F.col("predicted_return")), "invalid_predicted_return"),
        ((task == "classification") & F.col("predicted_return").isNotNull(), "classification_return_must_be_null"),
        ((task == "regression") & F.col("probability_up").isNotNull(), "regression_probability_must_be_null"),
        ((task != "regression") & no(probability), "probability_out_of_range"),
        (has & unfit, "invalid_quantiles"),
        (has & ~unfit & crossed, "crossed_quantiles"),
        (no((F.col("training_asof") <= F.col("decision_at")) & (F.col("decision_at") < F.col("intended_entry_at")) & F.col("generated_at").isNotNull()), "prediction_time_order"),
        (operational & (mode == "synthetic"), "synthetic_cannot_claim_operational_generation"),
        (replay & F.col("simulated_generated_at").isNull(), "replay_decision_clock_required"),
        (replay & (mode == "strict"), "strict_requires_operational_predictions"),
        (no(operational | replay), "unknown_generation_kind"),
        (known & no((F.col("decision_at") == F.col("row_decision_at")) & (F.col("intended_entry_at") == F.col("row_intended_entry_at")) & (F.col("feature_version_id") == F.col("row_feature_version_id")) & (F.col("feature_snapshot_id") == F.col("row_feature_snapshot_id"))), "prediction_feature_or_schedule_mismatch"),
        (known & (F.col("row_feature_ready_at").isNull() | (F.col("row_feature_ready_at") > effective)), "prediction_before_feature_ready"),
        (F.coalesce("oracle", F.lit(False)) & F.lit(not oracle_test), "oracle_accuracy_test_only"),
    )


def any_null(names: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.col(n).isNull() for n in names]), lambda x: x)


def effective_clock() -> Column:
    """When a prediction counts as made: its own clock if operational, the simulated one in a replay."""
    return F.when(F.col("generation_kind") == "operational", F.col("generated_at")).when(F.col("generation_kind") == "replay", F.col("simulated_generated_at"))


def validated(predictions: DataFrame, dataset: DataFrame, dataset_id: str, dataset_hash: str, mode: str, *, oracle_test: bool = False) -> DataFrame:
    """Predictions with reasons (none: accepted) and tradable (made between decision and entry).

    Every member of a group that shares an id, or a sample and horizon, is unusable, whichever came first.
    dataset: sample_id, horizon and the feature's clocks and ids.
    """
    facts = ("decision_at", "intended_entry_at", "feature_ready_at", "feature_version_id", "feature_snapshot_id")
    rows = dataset.select("sample_id", "horizon", *[F.col(c).alias(f"row_{c}") for c in facts])
    names = [F.col(c).cast("string") if t.startswith("map") else F.col(c) for c, t in predictions.dtypes]
    body = F.xxhash64(*names)
    ids = predictions.withColumn("_body", body).groupBy("prediction_id").agg(F.count("*").alias("_ids"), F.count_distinct("_body").alias("_bodies"))
    pairs = predictions.groupBy("sample_id", "horizon").agg(F.count("*").alias("_pairs"))
    joined = predictions.join(ids, "prediction_id", "left").join(pairs, ["sample_id", "horizon"], "left").join(rows, ["sample_id", "horizon"], "left")
    reasons = prediction_reasons(dataset_id, dataset_hash, mode, oracle_test=oracle_test)
    tradable = F.coalesce((F.col("decision_at") <= effective_clock()) & (effective_clock() < F.col("intended_entry_at")), F.lit(True))
    return joined.withColumns({"reasons": F.array_sort(reasons), "tradable": tradable}).select(*predictions.columns, "reasons", "tradable")


def prediction_status(checked: DataFrame, dataset: DataFrame) -> DataFrame:
    """One row: n_accepted, n_rejected, n_missing and status INVALID, PARTIAL or OK."""
    accepted = checked.where(F.size("reasons") == 0).select("sample_id", "horizon")
    counts = checked.agg(F.count_if(F.size("reasons") == 0).alias("n_accepted"), F.count_if(F.size("reasons") > 0).alias("n_rejected"))
    missing = dataset.select("sample_id", "horizon").join(accepted, ["sample_id", "horizon"], "left_anti").agg(F.count("*").alias("n_missing"))
    both = counts.crossJoin(missing)  # one row each
    return both.withColumn("status", F.when(F.col("n_rejected") > 0, "INVALID").when(F.col("n_missing") > 0, "PARTIAL").otherwise("OK"))


def evaluation_rows(dataset: DataFrame, accepted: DataFrame, asof: Column, mode: str, *, horizon: int, oracle_test: bool = False) -> DataFrame:
    """Dataset rows of a horizon with their prediction, the value of its target (actual) and the reasons why they
    do not count towards a metric."""
    outputs = ("prediction_id", "predicted_return", "probability_up", "predicted_quantiles", "target_id", "oracle")
    side = accepted.select("sample_id", "horizon", *[F.col(c).alias(f"p_{c}") for c in outputs])
    rows = dataset.where(F.col("horizon") == horizon).join(side, ["sample_id", "horizon"], "left")
    target = F.coalesce("p_target_id", F.lit(TARGETS[0]))
    actual = F.when(target == "cash_total_return", F.col("cash_total_return")).when(target == "price_return", F.col("price_return"))
    found = F.col("p_prediction_id").isNotNull()
    reasons = all_reasons(
        (F.col("sample_status") != "ready", "feature_sample_not_ready"),
        (F.col("label_status") != "ready", "label_not_ready"),
        (F.lit(mode == "strict") & ~F.coalesce("learning_allowed", F.lit(False)), "learning_rights_or_strict_pit_requirements_unmet"),
        (~found, "missing_prediction"),
        (F.col("label_available_at").isNull() | (F.col("label_available_at") > asof), "immature_label"),
        (F.lit(mode == "strict") & (F.col("rights_available_at") > asof), "learning_rights_after_evaluation_asof"),
        ((target == "cash_total_return") & ~F.coalesce(F.col("cash_total_return_status") == "ready", F.lit(False)), "total_return_not_ready"),
        (~finite(actual), "missing_or_invalid_target"),
        (F.coalesce("p_oracle", F.lit(False)) & F.lit(not oracle_test), "oracle_not_general_performance"),
    )
    return rows.withColumns({"actual": actual, "reasons": reasons})


def evaluate(rows: DataFrame, *, date: str = "decision_date", security: str = "security") -> dict[str, DataFrame]:
    """metrics (name, n, value, equal_date_value, reason), by_date, rank_ic, exclusions, calibration, pinball and
    coverage of ``evaluation_rows``."""
    good = rows.where(F.size("reasons") == 0).select(date, security, "actual", F.col("p_predicted_return").alias("predicted"), F.col("p_probability_up").alias("probability"), F.col("p_predicted_quantiles").alias("quantiles"))
    scored = good.withColumns(scores(F.col("actual"), F.col("predicted"), F.col("probability")))
    dated = by_date(scored, date)
    total = scored.agg(F.count("*").alias("n"), F.count("predicted").alias("n_mae"), F.count("probability").alias("n_brier"), *[safe_mean(F.col(n)).alias(n) for n in NAMES])
    equal = dated.agg(*[safe_mean(F.col(n)).alias(f"e_{n}") for n in NAMES])
    both = total.crossJoin(equal)  # one row each
    needs = {"mae": "n_mae", "mse": "n_mae", "brier": "n_brier", "binary_log_loss": "n_brier"}

    def one(name: str) -> Column:
        absent = F.col(needs[name]) == 0 if name in needs else F.lit(False)
        reason = first_reason((F.col("n") == 0, "no_mature_eligible_predictions"), (absent, "output_not_provided"), (F.col(name).isNull(), "numeric_overflow_or_partial_output"))
        return F.struct(F.lit(name).alias("name"), F.col("n"), F.col(name).alias("value"), F.col(f"e_{name}").alias("equal_date_value"), reason.alias("reason"))

    return {
        "metrics": both.select(F.inline(F.array(*map(one, NAMES)))),
        "by_date": dated,
        "rank_ic": rank_ic(good.where("predicted is not null"), date, security=security),
        "exclusions": rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
        "calibration": calibration(good),
        "pinball": pinball(good.where("quantiles is not null")),
        "coverage": interval_coverage(good.where("quantiles is not null")),
    }


def unique_only(predictions: DataFrame, key: list[str]) -> DataFrame:
    """Adds duplicate: true for every row whose key or id occurs more than once, the first one included."""
    many = (F.count("*").over(Window.partitionBy(*key)) > 1) | (F.count("*").over(Window.partitionBy("prediction_id")) > 1)
    return predictions.withColumn("duplicate", many)


def scores(actual: Column, predicted: Column, probability: Column) -> dict[str, Column]:
    """Per-row values; zero returns are not up."""
    up = (actual > 0).cast("double")
    p = F.least(F.lit(1 - EPSILON), F.greatest(F.lit(EPSILON), probability))
    error = predicted - actual
    return {
        "mae": F.abs(error),
        "mse": error * error,
        "direction_accuracy": F.when(F.coalesce(predicted > 0, probability > 0.5) == (actual > 0), 1.0).otherwise(0.0),
        "brier": (probability - up) * (probability - up),
        "binary_log_loss": -(up * F.ln(p) + (1 - up) * F.log1p(-p)),
    }


def safe_mean(value: Column) -> Column:
    """Mean that is null if any value is null or not finite, and does not overflow."""
    top = F.max(F.abs(value))
    whole = (F.count_if(finite(value)) == F.count("*")) & (F.count("*") > 0)
    return F.when(whole & (top < 1e290), F.avg(value)).when(whole, F.avg(value / 1e20) * 1e20)


def row_weighted(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), *[safe_mean(F.col(n)).alias(n) for n in NAMES])


def by_date(scored: DataFrame, date: str = "decision_date") -> DataFrame:
    return scored.groupBy(date).agg(F.count("*").alias("n"), *[safe_mean(F.col(n)).alias(n) for n in NAMES])


def equal_date_weighted(scored: DataFrame, date: str = "decision_date") -> DataFrame:
    return by_date(scored, date).agg(F.count("*").alias("n_dates"), *[safe_mean(F.col(n)).alias(n) for n in NAMES])


def rank_ic(rows: DataFrame, date: str = "decision_date", *, security: str = "security") -> DataFrame:
    """Rank correlation by average ranks on each date; null with a reason where it is undefined."""

    def average_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(date).orderBy(c)) + (F.count("*").over(Window.partitionBy(date, c)) - 1) / 2

    ranked = rows.select(date, security, average_rank("predicted").alias("x"), average_rank("actual").alias("y"))
    out = ranked.groupBy(date).agg(F.count("*").alias("n"), F.count_distinct(security).alias("_s"), F.stddev_pop("x").alias("_x"), F.stddev_pop("y").alias("_y"), F.covar_pop("x", "y").alias("_c"))
    reason = F.when(F.col("_s") < F.col("n"), "duplicate_security_on_decision_date").when(F.col("n") < 2, "fewer_than_two_securities").when((F.col("_x") == 0) | (F.col("_y") == 0), "constant_predictions_or_targets")
    return out.select(date, "n", F.when(reason.isNull(), F.try_divide(F.col("_c"), F.col("_x") * F.col("_y"))).alias("rank_ic"), reason.alias("reason"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Ten equal bins of probability, empty ones included."""
    found = rows.where("probability is not null").select(F.least(F.lit(bins - 1), F.floor(F.col("probability") * bins)).cast("int").alias("bin"), "probability", (F.col("actual") > 0).cast("double").alias("up"))
    sums = found.groupBy("bin").agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.avg("up").alias("up_frequency"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(sums, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def pinball(rows: DataFrame) -> DataFrame:
    """Mean quantile loss for each quantile of ``quantiles`` (map of level text to value)."""
    each = rows.select("actual", F.explode("quantiles").alias("level", "value")).withColumn("q", F.col("level").cast("double"))
    error = F.col("actual") - F.col("value")
    return each.groupBy("q").agg(F.count("*").alias("n"), F.avg(F.greatest(F.col("q") * error, (F.col("q") - 1) * error)).alias("pinball_loss"))


def interval_coverage(rows: DataFrame) -> DataFrame:
    """How often outcomes lie between the lowest and the highest quantile."""
    pairs = F.array_sort(F.transform(F.map_entries("quantiles"), lambda e: F.struct(e["key"].cast("double").alias("q"), e["value"].alias("v"))))
    ends = rows.where(F.size("quantiles") >= 2).select("actual", F.get(pairs, 0).alias("lo"), F.get(pairs, F.size(pairs) - 1).alias("hi"))
    return ends.groupBy(F.col("lo.q").alias("low"), F.col("hi.q").alias("high")).agg(F.count("*").alias("n"), F.avg(F.col("actual").between(F.col("lo.v"), F.col("hi.v")).cast("double")).alias("coverage"))


def reason_overlap(rows: DataFrame, sample: list[str], category: str) -> DataFrame:
    """Samples that two categories share, for each pair of categories (first <= second).

    Pairs are made within a sample's own few categories, never across samples.
    """
    sets = rows.groupBy(*sample).agg(F.array_sort(F.collect_set(category)).alias("c"))
    one = sets.select(*sample, "c", F.explode("c").alias("first")).select("first", F.explode("c").alias("second")).where("first <= second")
    return one.groupBy("first", "second").agg(F.count("*").alias("n_samples"))
