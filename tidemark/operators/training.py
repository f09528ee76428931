"""Training and inference rows, targets, saved models and runs of folds by models."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import all_reasons, digest, finite, first_reason
from tidemark.operators import models
from tidemark.sources import store

#: Reasons for which a feature may be missing and imputed; any other one rejects the row.
TRANSIENT = ("missing_session_or_collection_failure", "insufficient_history_or_prelisting_unverified", "lookback_outside_calendar", "temporary_missing")
#: Models of each task.
OF_TASK = {"regression": ("zero", "mean", "ridge", "tree"), "classification": ("frequency", "logistic", "tree")}


def projection_reason(names: list[str]) -> Column:
    """Why a row's features (columns n and n_reason) cannot be used, by the first faulty feature in order."""
    faults = []
    for n in names:
        why, value = F.col(f"{n}_reason"), F.col(n)
        faults.append(
            F.when(why.startswith("invalid"), F.lit(f"invalid_feature:{n}"))
            .when(why.isNotNull() & ~why.isin(*TRANSIENT), F.concat(F.lit(f"required_feature_contract_unmet:{n}:"), why))
            .when(why.isNotNull() & value.isNotNull(), F.lit(f"unavailable_feature_has_value:{n}"))
            .when(value.isNotNull() & ~finite(value), F.lit(f"nonfinite_or_invalid_feature:{n}"))
        )
    return F.coalesce(*faults, F.lit(None).cast("string"))


def target_value(target_id: str, task: str) -> Column:
    """The target: its value, or 1 for above zero. Cash returns never fall back to price returns."""
    value = F.col(target_id).cast("double")
    return value if task == "regression" else F.when(value.isNotNull(), (value > 0).cast("double"))


def training_rows(rows: DataFrame, names: list[str], asof: Column, *, target_id: str = "price_return", task: str = "regression", mode: str = "research") -> DataFrame:
    """Rows with reason (null: it teaches) and target. A row has to have a label mature at ``asof``, permission to
    learn by then unless all is synthetic, a finite target and usable features."""
    reason = first_reason(
        (~F.coalesce((F.col("label_status") == "ready") & (F.col("label_available_at") <= asof), F.lit(False)), "label_not_mature_at_training_asof"),
        (F.lit(mode != "synthetic") & ~F.coalesce("learning_allowed", F.lit(False)), "model_training_permission_not_granted"),
        (F.lit(mode != "synthetic") & (F.col("rights_available_at") > asof), "learning_rights_not_available_at_training_asof"),
        (F.lit(target_id == "cash_total_return") & ~F.coalesce(F.col("cash_total_return_status") == "ready", F.lit(False)), "total_return_not_ready_no_price_fallback"),
        (~finite(F.col(target_id)), "target_missing_or_nonfinite"),
    )
    return rows.withColumns({"reason": F.coalesce(reason, projection_reason(names)), "target": target_value(target_id, task)})


def class_policy(rows: DataFrame, policy: str) -> float | None:
    """What to do where only one class teaches: None if there are both; under ``constant`` the smoothed frequency."""
    if policy not in ("error", "constant"):
        raise ValueError("one-class policy has to be error or constant")
    n, up = rows.agg(F.count("*"), F.count_if(F.col("target") > 0)).first()
    if 0 < up < n:
        return None
    if policy == "error":
        raise ValueError("only one class to learn from")
    return (up + 1) / (n + 2)


def fitted(rows: DataFrame, names: list[str], *, model: str, task: str, one_class: str = "error", minimum: int = 8) -> dict:
    """Parameters of a model fitted to ``target`` of the rows, as plain values that JSON can hold."""
    if model not in OF_TASK.get(task, ()):
        raise ValueError(f"{task} has the models {OF_TASK.get(task, ())}")
    if rows.count() < minimum:
        raise ValueError("too few training rows")
    smoothed = class_policy(rows, one_class) if task == "classification" and model != "frequency" else None
    return {"task": task, "features": names, "model": model} | (models.constant(smoothed) if smoothed is not None else models.parameters(rows, names, "target", model, task))


def predicted(rows: DataFrame, saved: dict) -> DataFrame:
    """Adds prediction by a model's saved parameters: a return, or a probability of up."""
    return rows.withColumn("prediction", models.expression(saved))


def infer(rows: DataFrame, saved: dict, training_asof: Column, *, model_id: str, horizon: int = 5) -> DataFrame:
    """Predictions for rows from their features and schedule alone; rows that cannot have one keep their reason.

    No column of a label is read, so none can leak.
    """
    names = saved["features"]
    slim = rows.select("sample_id", "feature_version_id", "feature_snapshot_id", "sample_status", "decision_at", "intended_entry_at", *names, *[f"{n}_reason" for n in names])
    reason = first_reason((training_asof > F.col("decision_at"), "model_logical_asof_after_decision"), (F.col("sample_status") != "ready", "prediction_feature_not_ready"))
    out = predicted(slim.withColumn("reason", F.coalesce(reason, projection_reason(names))), saved)
    value = F.when(F.col("reason").isNull(), F.col("prediction"))
    up = saved["task"] == "classification"
    return out.select(
        digest(F.lit(model_id), F.col("sample_id"), F.lit(str(horizon))).alias("prediction_id"), "sample_id", F.lit(horizon).alias("horizon"), "feature_version_id", "feature_snapshot_id", "decision_at", "intended_entry_at",
        training_asof.alias("training_asof"), F.lit(saved["task"]).alias("output_task"), (F.lit(None).cast("double") if up else value).alias("predicted_return"), (value if up else F.lit(None).cast("double")).alias("probability_up"), "reason",
    )


def save_model(spark: SparkSession, saved: dict, path: str) -> None:
    """One JSON text under ``path``; parameters are a few numbers."""
    body = json.dumps(saved, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").select("value").coalesce(1).write.mode("errorifexists").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    saved = json.loads("".join(r["value"] for r in spark.read.text(path).collect()))
    if missing := {"task", "features", "model", "kind"} - set(saved):
        raise ValueError(f"the saved model lacks {sorted(missing)}")
    return saved


def run(assigned: DataFrame, names: list[str], plans: list[tuple[str, str]], *, target_id: str = "price_return", mode: str = "research", minimum: int = 8) -> list[dict]:
    """Every model (task, name) on every fold: fold, model, task and parameters, or the reason why there are none.

    ``assigned``: rows with fold, partition, reasons and training_asof as datasets.assign gives them. Folds and
    models are few; each fit is a Spark job.
    """
    out = []
    folds = [r["fold"] for r in assigned.select("fold").distinct().orderBy("fold").collect()]
    for fold in folds:
        own = assigned.where((F.col("fold") == fold) & (F.col("partition") == "train") & (F.size("reasons") == 0))
        for task, model in plans:
            rows = training_rows(own, names, F.col("training_asof"), target_id=target_id, task=task, mode=mode).where("reason is null")
            entry = {"fold": fold, "task": task, "model": model}
            try:
                out.append(entry | {"parameters": fitted(rows, names, model=model, task=task, one_class="constant", minimum=minimum), "reason": None})
            except ValueError as fault:
                out.append(entry | {"parameters": None, "reason": str(fault)})
    return out


ENVELOPE = "run_id string, fold bigint, task string, model string, dataset_sha256 string, settings string, status string, reason string, parameters string, engine_sha256 string"


def record_runs(spark: SparkSession, found: list[dict], root: str, *, dataset: str, settings: dict) -> DataFrame:
    """Append the envelopes of ``run``: what each fit was of (digest of the frozen dataset, settings, versions of this library
    and of Spark) and what it gave. A run id is the digest of the first; the same run with another outcome is a conflict.
    Settings are checked before (contracts.checked_training)."""
    told = json.dumps(settings, sort_keys=True)
    rows = []
    for entry in found:
        id_ = sha256(json.dumps([dataset, told, entry["fold"], entry["task"], entry["model"], store.engine_version()]).encode()).hexdigest()
        given = None if entry["parameters"] is None else json.dumps(entry["parameters"], sort_keys=True)
        rows.append((id_, entry["fold"], entry["task"], entry["model"], dataset, told, "OK" if given else "BLOCKED", entry["reason"], given, store.engine_version()))
    envelopes = spark.createDataFrame(rows, ENVELOPE)
    store.append(envelopes, root, ["run_id"], content=["parameters", "reason"])
    return envelopes


def row_reasons(names: list[str]) -> Column:
    """All faulty features of a row, for reports."""
    return all_reasons(*[(F.col(f"{n}_reason").isNotNull() & ~F.col(f"{n}_reason").isin(*TRANSIENT), f"required_feature_contract_unmet:{n}") for n in names])
