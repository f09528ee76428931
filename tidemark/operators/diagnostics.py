"""What blocks samples: categories of reasons, waiting labels judged again later, forward gates, run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import all_reasons, first_reason

#: A reason belongs to the first category one of whose words it contains.
CATEGORIES = (
    ("identity", ("identity", "mapping", "symbol", "series_mismatch")),
    ("calendar", ("calendar", "session", "decision_date")),
    ("actions", ("corporate_action", "dividend", "split", "ledger")),
    ("state", ("halt", "delist", "listing", "trading_status", "status_interval")),
    ("waiting", ("waiting", "not_yet", "delay", "pending", "after_label")),
    ("rights", ("rights", "license")),
    ("prices", ("price", "open", "lookback", "history", "missing", "currency", "conflict")),
)
MINIMUM_SAMPLES, MINIMUM_DAYS = 100, 180


def category(reason: Column) -> Column:
    out = F.lit("other")
    for name, words in reversed(CATEGORIES):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(reason, F.lit(word))
        out = F.when(hit, name).otherwise(out)
    return out


def blockers(rows: DataFrame, sample: list[str], reason: str = "reason") -> DataFrame:
    """category, reason, n_rows, n_samples (different ones)."""
    named = rows.where(F.col(reason).isNotNull()).withColumn("category", category(F.col(reason)))
    return named.groupBy("category", F.col(reason).alias("reason")).agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*sample)).alias("n_samples"))


def reassessed(labels: DataFrame, at: Column, *, delay_hours: float = 48) -> DataFrame:
    """Adds later_status and later_reason: what a pending label is at a later clock; others stay."""
    deadline = F.col("exit_close") + F.make_dt_interval(secs=F.lit(delay_hours * 3600))
    waiting = F.col("status") == "pending"
    status = F.when(~waiting, F.col("status")).when(F.col("exit_at") > at, "pending").when(at <= deadline, "pending").otherwise("blocked")
    reason = F.when(~waiting, F.col("reason")).when(F.col("exit_at") > at, "target_open_not_yet_reached").when(at <= deadline, "waiting_for_received_usable_open_price_within_delay").otherwise("past_endpoint_price_missing_or_collection_failure")
    return labels.withColumns({"later_status": status, "later_reason": reason})


def forward_timing(now: Column) -> Column:
    """Why a forward prediction cannot be recorded now: it has to come after the decision and before the entry."""
    return first_reason(
        (F.col("decision_at").isNull() | F.col("intended_entry_at").isNull(), "schedule_outside_calendar"),
        (now < F.col("decision_at"), "before_decision_time"),
        (now >= F.col("intended_entry_at"), "entry_already_passed"),
    )


def input_gate(cutoff: Column) -> Column:
    """All reasons why a forward input cannot be used."""
    return all_reasons(
        (F.col("available_at") > cutoff, "input_after_cutoff"),
        (F.col("feature_ready_at") > F.col("decision_at"), "feature_after_decision"),
        (F.coalesce(F.col("missing_any"), F.lit(True)), "feature_missing"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and n of each table, in one plan."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: The areas that a blocking reason can belong to, each by words one of which the reason contains. A reason may belong to several.
AREAS = {
    "publication_version": ("publication", "historical", "version_content", "calendar_not_historically"),
    "observed_timing": ("receipt", "received", "usable", "actual_feature", "after_cutoff"),
    "price_fields": ("price_semantics", "opening_prices", "input_field", "currency", "no_computable", "session_scope", "scoped_price"),
    "corporate_actions": ("corporate_action",),
    "security_identity_listing": ("security_identity", "symbol_mapping", "identifier", "listing"),
    "tradability": ("trading_status", "security_status", "halted", "trading_state"),
    "future_outcome": ("target_open", "waiting_for_received"),
    "past_outcome_missing": ("past_endpoint", "missing_session", "collection_failure"),
    "rights": ("rights", "permission"),
    "code_schema_connection": ("scope_contract", "legacy_strict", "no_eligible", "feature_sample_not_ready"),
}
#: What lifts a reason, and whether code alone can.
LIFTED_BY = {
    "publication_time_unknown": ("a publication time and evidence bound to the version", False),
    "actual_receipt_unproven": ("a successful receipt that came over the network", False),
    "received_after_cutoff": ("a receipt from before the cutoff", False),
    "processing_after_cutoff": ("processing that was complete before the cutoff", False),
    "calendar_not_historically_verified": ("a calendar notice from the time itself", False),
    "opening_prices_unavailable_close_only": ("opens as traded at entry and exit", False),
    "price_semantics_not_requested": ("prices as traded", False),
    "security_identity_unverified": ("an external security id with evidence", False),
    "security_trading_status_unverified": ("the security's own trading state over entry and exit", False),
    "corporate_action_coverage_unconfirmed": ("complete coverage of actions over the interval", False),
    "target_open_not_yet_reached": ("the exit session", False),
    "past_endpoint_missing_from_local_source_range": ("bars of the endpoint dates", False),
    "learning_rights_unconfirmed": ("rights to learn, bound to source and symbol", False),
    "legacy_strict_pit_or_rights_unmet": ("a scope contract and all of its evidence", True),
    "no_eligible_feature_inputs": ("inputs that a query lets through", False),
    "feature_sample_not_ready": ("what its own reasons ask for", False),
    "feature_not_ready_by_decision": ("inputs and features that were ready before the decision", False),
    "label_not_ready": ("what its own reasons ask for", False),
    "label_not_available_at_training_asof": ("the time at which all of a label's dependencies were there", False),
}


def areas(reason: Column) -> Column:
    """The areas of a reason."""
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(reason, w))
    return F.array_compact(F.array(*[F.when(hit(words), F.lit(name)) for name, words in AREAS.items()]))


def diagnosis(rows: DataFrame, key: list[str], reasons: str = "reasons") -> DataFrame:
    """measure (reason, area, overlap), name, n, needs, code_can_resolve: how many different keys each blocks.

    rows: key and an array of reasons, a key in as many rows as there are. Overlaps count keys that two areas block. A key's
    reasons meet once; areas are ten, so what a key adds is bounded.
    """
    one = rows.select(*key, F.explode(reasons).alias("reason")).where("reason is not null").distinct()
    lifted = F.create_map(*[F.lit(x) for name, (needs, _) in LIFTED_BY.items() for x in (name, needs)])
    alone = F.create_map(*[F.lit(x) for name, (_, code) in LIFTED_BY.items() for x in (name, code)])
    word = lambda measure, name: F.struct(F.lit(measure).alias("measure"), name.alias("name"))
    of_key = one.groupBy(*key).agg(F.collect_set("reason").alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(areas(F.col("reason")))))).alias("a"))
    pairs = F.flatten(F.transform("a", lambda x: F.transform(F.filter("a", lambda y: y > x), lambda y: word("overlap", F.concat(x, F.lit(" & "), y)))))
    said = of_key.select(F.inline(F.concat(F.transform("r", lambda x: word("reason", x)), F.transform("a", lambda x: word("area", x)), pairs)))
    out = said.groupBy("measure", "name").agg(F.count("*").alias("n"))
    is_reason = F.col("measure") == "reason"
    return out.withColumns({"needs": F.when(is_reason, F.try_element_at(lifted, F.col("name"))), "code_can_resolve": F.when(is_reason, F.coalesce(F.try_element_at(alone, F.col("name")), F.lit(False)))})


def endpoint_figures(labels: DataFrame, versions: DataFrame, series: list[str], key: list[str]) -> DataFrame:
    """For each label (key, series, entry_date, exit_date) and endpoint what versions there are of its day, whether eligible or not.

    versions: series, trading_date, open, temporal_json, evidence_json, session_scope, volume_adjustment_basis. Versions are
    counted by series and day once, however many labels end there; a day without any has counts of 0.
    """
    published = F.get_json_object("temporal_json", "$.published_at").isNotNull()
    proven = F.coalesce(F.trim("evidence_json"), F.lit("{}")) != "{}"
    by_day = versions.groupBy(*series, "trading_date").agg(
        F.count("*").alias("n_versions"), F.count("open").alias("n_open"), F.count_if(published).alias("n_published"), F.count_if(proven).alias("n_proven"),
        F.min("session_scope").alias("session_scope"), F.min("volume_adjustment_basis").alias("volume_adjustment_basis"),
    )
    ends = F.array(*[F.struct(F.lit(name).alias("endpoint"), F.col(f"{name}_date").alias("trading_date")) for name in ("entry", "exit")])
    rows = labels.select(*key, *[c for c in series if c not in key], F.inline(ends))
    out = rows.join(by_day, [*series, "trading_date"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_versions", "n_open", "n_published", "n_proven")})
