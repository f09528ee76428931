"""Dataset builds: samples with sealed features, labels, learning gates, counters, checks of stored datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import digest, first_reason
from tidemark.operators.labels import HORIZONS


def scheduled(specs: DataFrame, plan: DataFrame, simulation_at: Column) -> DataFrame:
    """Sample specs (series columns, decision_date, feature_ready_at, feature_cutoff) with their schedule and
    spec_reason, the first fault that makes a sample invalid. Plans have a row for each session and are small."""
    planned = specs.join(F.broadcast(plan.select("decision_date", "decision_at", "intended_entry_at")), "decision_date", "left")
    reason = first_reason(
        (F.col("decision_date").isNull(), "date_required"),
        (F.col("decision_at").isNull(), "decision_date_not_a_session"),
        (F.col("decision_at") > simulation_at, "decision_after_simulation_asof"),
        (F.col("feature_cutoff").isNull(), "timestamp_required"),
        (F.col("feature_cutoff") > F.col("decision_at"), "feature_cutoff_or_decision_contract_invalid"),
        (F.col("feature_ready_at").isNull(), "explicit_feature_ready_basis_required"),
        (F.col("feature_ready_at") < F.col("feature_cutoff"), "feature_ready_before_input_availability"),
    )
    return planned.withColumn("spec_reason", reason)


def sealed_features(samples: DataFrame, features: DataFrame, series: list[str], required: list[str], *, verified: Column | None = None) -> DataFrame:
    """Each sample with the payload of its features, taken before any label is looked at.

    sample_id, sample_status (ready, blocked or invalid), sample_reasons, research_calculable,
    historical_pit_eligible, execution_status, feature_version_id (digest of the payload) and the features.
    """
    own = [F.col(n) for n in required] + [F.col(f"{n}_reason") for n in required]
    side = features.select(*series, F.col("trading_date").alias("decision_date"), F.lit(True).alias("_found"), *own)
    rows = samples.join(side, [*series, "decision_date"], "left")
    valid = F.col("spec_reason").isNull()
    unmet = F.array_distinct(F.array_compact(F.array(*[F.col(f"{n}_reason") for n in required])))
    absent = F.when(F.col("_found").isNull(), F.array(F.lit("missing_session_or_collection_failure"))).otherwise(unmet)
    reasons = F.when(valid, absent).otherwise(F.array("spec_reason"))
    status = F.when(~valid, "invalid").when(F.size(reasons) == 0, "ready").otherwise("blocked")
    execution = F.when(~valid, "invalid").when(F.col("feature_ready_at") < F.col("intended_entry_at"), "ready").otherwise("feature_not_ready_before_entry")
    ready = F.col("sample_status") == "ready"
    rows = rows.withColumns({"sample_reasons": reasons, "sample_status": status, "execution_status": execution, "sample_id": digest(*[F.col(c) for c in series], F.col("decision_date"), F.col("feature_cutoff"))})
    rows = rows.withColumns({"research_calculable": ready, "historical_pit_eligible": ready & (verified if verified is not None else F.lit(False))})
    payload = digest(F.col("sample_id"), F.col("sample_status"), F.array_join("sample_reasons", ","), *[F.col(n) for n in required])
    return rows.withColumn("feature_version_id", payload).drop("_found")


def labelled(samples: DataFrame, labels: DataFrame, series: list[str], rights: Column, *, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """A row for each sample and horizon. Invalid samples keep three invalid labels with their reason; others
    take the label of their series and date, and one that is missing altogether is blocked.

    learning_ready: rights to learn, an eligible ready sample that was ready to act on, and a ready label.
    """
    wanted = samples.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    facts = labels.select(*series, "decision_date", "horizon", F.col("status").alias("_status"), F.col("reason").alias("_reason"))
    rows = wanted.join(facts, [*series, "decision_date", "horizon"], "left")
    valid = F.col("sample_status") != "invalid"
    status = F.when(~valid, "invalid").otherwise(F.coalesce("_status", F.lit("blocked")))
    reason = F.when(~valid, F.get("sample_reasons", 0)).when(F.col("_status").isNull(), "label_missing").otherwise(F.col("_reason"))
    rows = rows.withColumns({"label_status": status, "label_reason": reason}).drop("_status", "_reason")
    ready = rights & F.col("historical_pit_eligible") & (F.col("sample_status") == "ready") & (F.col("label_status") == "ready") & (F.col("execution_status") == "ready")
    version = digest(F.col("sample_id"), F.col("horizon"), F.col("label_status"), F.col("label_reason"))
    return rows.withColumns({"learning_ready": F.coalesce(ready, F.lit(False)), "label_version_id": version})


def counters(items: DataFrame) -> DataFrame:
    """counter, name and n: samples by status, labels by status, reasons of both, ready and learning-ready pairs.

    One pass: every row says what it counts for, and the first row of a sample speaks for the sample.
    """
    first = F.row_number().over(Window.partitionBy("sample_id").orderBy("horizon", "label_version_id")) == 1
    word = lambda counter, name: F.struct(F.lit(counter).alias("counter"), name.alias("name"))
    ready = (F.col("sample_status") == "ready") & (F.col("label_status") == "ready")
    of_sample = F.concat(F.array(word("feature_status", F.col("sample_status"))), F.transform("sample_reasons", lambda r: word("feature_reason", r)))
    of_pair = F.array_compact(
        F.array(
            word("label_status", F.col("label_status")),
            F.when(F.col("label_reason").isNotNull(), word("label_reason", F.col("label_reason"))),
            F.when(ready, word("pairs", F.lit("ready"))),
            F.when(F.col("learning_ready"), word("pairs", F.lit("learning_ready"))),
        )
    )
    marked = items.select("sample_id", "sample_status", "sample_reasons", "label_status", "label_reason", "learning_ready", first.alias("_first"))
    said = marked.select(F.inline(F.when(F.col("_first"), F.concat(of_sample, of_pair)).otherwise(of_pair)))
    return said.groupBy("counter", "name").agg(F.count("*").alias("n"))


def membership(items: DataFrame) -> DataFrame:
    """Members of a dataset: sample_id, horizon, feature_version_id, label_version_id and the member's digest."""
    names = ["sample_id", "horizon", "feature_version_id", "label_version_id"]
    return items.select(*names, digest(*[F.col(n) for n in names]).alias("content_sha256"))


def verified_rows(members: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with issue: the feature or label they name is not stored, belongs to another sample, or the member's
    digest is not that of its content."""
    feature = features.select(F.col("feature_version_id"), F.col("sample_id").alias("_f")).dropDuplicates(["feature_version_id"])
    label = labels.select(F.col("label_version_id"), F.col("sample_id").alias("_l"), F.col("horizon").alias("_h")).dropDuplicates(["label_version_id"])
    joined = members.join(feature, "feature_version_id", "left").join(label, "label_version_id", "left")
    body = digest(*[F.col(n) for n in ("sample_id", "horizon", "feature_version_id", "label_version_id")])
    issue = first_reason(
        (F.col("_f").isNull(), "feature_missing"),
        (F.col("_l").isNull(), "label_missing"),
        ((F.col("_f") != F.col("sample_id")) | (F.col("_l") != F.col("sample_id")) | (F.col("_h") != F.col("horizon")), "member_link_mismatch"),
        (body != F.col("content_sha256"), "member_hash_mismatch"),
    )
    return joined.select(*members.columns, issue.alias("issue"))


def eligibility(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """One row: n_eligible, n_rows and status OK or BLOCKED; rows have the reason of a selection, null if eligible."""
    out = rows.agg(F.count_if(F.col(reason).isNull()).alias("n_eligible"), F.count("*").alias("n_rows"))
    return out.withColumn("status", F.when(F.col("n_eligible") > 0, "OK").otherwise("BLOCKED"))


def quality_report(parts: dict[str, DataFrame]) -> DataFrame:
    """check, code and n over the findings of several checks; each part has a column ``code``."""
    named = [df.select(F.lit(name).alias("check"), F.col("code").cast("string").alias("code")) for name, df in sorted(parts.items())]
    out = named[0]
    for part in named[1:]:
        out = out.unionByName(part)
    return out.groupBy("check", "code").agg(F.count("*").alias("n"))
