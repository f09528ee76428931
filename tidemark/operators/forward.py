"""Forward evaluation: samples frozen with refreshed labels, mature updates, overlays and records made once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import digest, first_reason
from tidemark.operators.diagnostics import forward_timing, input_gate


def frozen_sample(stored: DataFrame, refreshed: DataFrame, key: list[str]) -> DataFrame:
    """Each stored label, or the refreshed one where there is one, with origin `refreshed` or `preserved`.

    Both have key columns, status, reason and label_version_id; a refreshed label of an unknown key is no sample's.
    """
    names = ("status", "reason", "label_version_id")
    side = refreshed.select(*key, F.struct(*names).alias("_new"))
    rows = stored.join(side, key, "left")
    return rows.select(*key, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{n}")).otherwise(F.col(n)).alias(n) for n in names], F.when(F.col("_new").isNotNull(), "refreshed").otherwise("preserved").alias("origin"))


def mature_updates(stored: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """New label versions to append, with the one they follow: pending labels that are pending no longer. Labels
    that were final, and horizons that did not change, stay as they are."""
    now = current.select(*key, F.col("status").alias("_status"), F.col("reason").alias("_reason"))
    changed = stored.where("status = 'pending'").join(now, key).where("_status <> 'pending'")
    version = digest(*[F.col(k) for k in key], F.col("_status"), F.col("_reason"))
    return changed.select(*key, F.col("_status").alias("status"), F.col("_reason").alias("reason"), version.alias("label_version_id"), F.col("label_version_id").alias("previous_label_version_id"))


def overlaid(base: DataFrame, reviewed: DataFrame, key: list[str]) -> DataFrame:
    """Base rows with those of a reviewed overlay in place of the ones of equal key, and overlay to tell."""
    rest = base.join(reviewed.select(*key).distinct(), key, "left_anti").withColumn("overlay", F.lit(False))
    return rest.unionByName(reviewed.withColumn("overlay", F.lit(True)))


def identity_fault(expected: DataFrame, current: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Current rows with fault: no identity is expected for their key, or it is another one."""
    side = expected.select(*key, F.struct(*fields).alias("_expected"))
    fault = first_reason((F.col("_expected").isNull(), "identity_unknown"), (~F.struct(*fields).eqNullSafe(F.col("_expected")), "identity_mismatch"))
    return current.join(side, key, "left").withColumn("fault", fault).drop("_expected")


def forward_records(rows: DataFrame, now: Column, values: dict[str, Column], key: list[str]) -> DataFrame:
    """One record for each row: reason (timing first, then input gates), the predictions of ``values`` where there is
    no reason, and the digest that seals it. Appended by key, a record is made once (store.append)."""
    gated = rows.withColumn("_gates", input_gate(now))
    reason = F.coalesce(forward_timing(now), F.get("_gates", 0))
    out = gated.withColumn("reason", reason)
    made = {n: F.when(F.col("reason").isNull(), v) for n, v in values.items()}
    sealed = digest(*[F.col(k) for k in key], F.col("reason"), *made.values())
    return out.withColumns(made).withColumn("record_sha256", sealed).select(*key, "reason", *values, "record_sha256")


def forward_summary(records: DataFrame, outcomes: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """name, n and mae of recorded predictions against outcomes (key, actual) that came since."""
    pairs = records.where("reason is null").join(outcomes.select(*key, "actual"), key).select("actual", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])))
    return pairs.where("actual is not null").groupBy("name").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("value") - F.col("actual"))).alias("mae"))


def merged_members(parts: list[DataFrame], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members, clashes) of several frozen datasets: members with one content under their key once, and keys under which
    parts differ. Parts have key columns and content_sha256; a merged dataset is frozen from the members (store.freeze)."""
    every = parts[0].select(*key, "content_sha256")
    for part in parts[1:]:
        every = every.unionByName(part.select(*key, "content_sha256"))
    counts = every.groupBy(*key).agg(F.min("content_sha256").alias("content_sha256"), F.count_distinct("content_sha256").alias("n_contents"))
    return counts.where("n_contents = 1").drop("n_contents"), counts.where("n_contents > 1").drop("content_sha256")
