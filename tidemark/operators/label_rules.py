"""Label rules by evidence: conflicts, action coverage and halts that matter for one holding interval.

A review says what an action version is (``share_split``, ``ordinary_cash_dividend``) and when it took effect. Lists of
required versions say that the actions of a series are complete, for prices and for cash apart. Facts that have a date
meet labels by series and period, so a label only sees the facts of its own interval; facts without a date hold for
every label of their series. Halts and the intervals that say halts are completely known are sets of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import first_reason, left_open
from tidemark.operators import intervals

#: What a reviewed action counts as, by its own type and by what the review found.
REVIEWED = {"split": ("split", "splits", "share_split"), "dividend": ("dividend", "dividends", "ordinary_cash_dividend")}
#: Faults of action coverage, from the first on.
FAULTS = {
    "price": ("price_action_coverage_unverified", "price_action_required_version_unavailable", "corporate_action_type_unverified_or_unsupported", "price_action_coverage_mismatch"),
    "cash": ("cash_action_coverage_unverified", "cash_action_required_version_unavailable", "cash_action_coverage_type_unverified", "cash_action_coverage_mismatch"),
}
HALTED, BOUNDARY = "target_security_halted_or_resumption_unknown", "target_security_resumption_boundary_unverified"


def action_date(event_type: Column, effective_date: Column, ex_date: Column) -> Column:
    """The day an action counts for: splits by their effective date, dividends by their ex-date, others by whichever they have."""
    return F.when(event_type.isin("split", "splits"), effective_date).when(event_type.isin("dividend", "dividends"), ex_date).otherwise(F.coalesce(effective_date, ex_date))


def outside_holding(date: Column, entry_date: Column, exit_date: Column) -> Column:
    """Whether an action has a date, and one outside (entry, exit]."""
    return F.coalesce(date.isNotNull() & ~left_open(entry_date, exit_date, date), F.lit(False))


def action_class(event_type: Column, reviewed: Column) -> Column:
    """split or dividend where the review agrees with the action's own type, else null: amounts do not tell special cash from ordinary."""
    out = F.lit(None).cast("string")
    for name, (one, many, found) in REVIEWED.items():
        out = F.when(event_type.isin(one, many) & (reviewed == found), name).otherwise(out)
    return out


def action_faults(actions: DataFrame, reviewed: DataFrame, required: DataFrame, series: list[str]) -> DataFrame:
    """series, kind, date (null: every day) and rank of all that is wrong with the actions of a series, whatever the label.

    actions: series, version_id, event_type, effective_date, ex_date. reviewed: series, version_id, classification,
    effective_date. required: series, kind, version_id; a null version_id stands for an empty list.
    """
    by = [*series, "version_id"]
    review = reviewed.select(*by, F.col("classification").alias("_class"), F.col("effective_date").alias("_reviewed_on")).dropDuplicates(by)
    facts = actions.select(*by, "event_type", action_date(F.col("event_type"), F.col("effective_date"), F.col("ex_date")).alias("date"), "ex_date").dropDuplicates(by)
    facts = facts.join(review.drop("_reviewed_on"), by, "left").withColumn("class", action_class(F.col("event_type"), F.col("_class"))).drop("_class")
    needed = required.where("version_id is not null").select(*by, "kind").distinct()

    own = facts.select(*by, "class", "date", F.lit(True).alias("found"))
    met = needed.join(own, by, "left").join(review.select(*by, "_reviewed_on"), by, "left")
    wanted = F.when(F.col("kind") == "price", "split").otherwise("dividend")
    missing, wrong = F.col("found").isNull(), ~F.coalesce(F.col("class") == wanted, F.lit(False))
    lacking = met.where(missing | wrong).select(*series, "kind", F.when(missing, F.col("_reviewed_on")).otherwise(F.col("date")).alias("date"), F.when(missing, 1).otherwise(2).alias("rank"))

    kinds = facts.withColumn("kind", F.explode(F.array(F.lit("price"), F.lit("cash"))))
    counts = F.when(F.col("kind") == "price", ~F.coalesce(F.col("class") == "dividend", F.lit(False))).otherwise((F.col("class") == "dividend") & F.col("ex_date").isNotNull())
    unlisted = kinds.where(counts).join(needed, [*by, "kind"], "left_anti").select(*series, "kind", F.when(F.col("kind") == "price", F.col("date")).otherwise(F.col("ex_date")).alias("date"), F.lit(3).alias("rank"))
    return lacking.unionByName(unlisted)


def coverage_reasons(rows: DataFrame, actions: DataFrame, reviewed: DataFrame, required: DataFrame, series: list[str], key: list[str]) -> DataFrame:
    """Adds price_coverage_reason and cash_coverage_reason of each label (key, series, entry_date, exit_date); null if its interval is covered.

    A list that a series lacks, or that names a version twice, is unverified. Of what is wrong in the interval the first by
    FAULTS counts.
    """
    faults = action_faults(actions, reviewed, required, series)
    lists = required.groupBy(*series, "kind").agg((F.count("version_id") == F.count_distinct("version_id")).alias("sound")).groupBy(*series)
    lists = lists.agg(*[F.max(F.when((F.col("kind") == kind) & F.col("sound"), True)).alias(f"_{kind}_list") for kind in FAULTS])
    always = faults.where("date is null").groupBy(*series).agg(*[F.min(F.when(F.col("kind") == kind, F.col("rank"))).alias(f"_{kind}_always") for kind in FAULTS])
    dated = faults.where("date is not null").select(*series, "kind", "rank", F.col("date").alias("_on"), intervals.period(F.col("date")).alias("_period"))
    spans = rows.where("entry_date < exit_date").select(*key, *[c for c in series if c not in key], "entry_date", "exit_date")
    spans = spans.withColumn("_period", F.explode(F.sequence(intervals.period(F.col("entry_date")), intervals.period(F.col("exit_date")))))
    inside = spans.join(dated, [*series, "_period"]).where(left_open(F.col("entry_date"), F.col("exit_date"), F.col("_on")))
    inside = inside.groupBy(*key).agg(*[F.min(F.when(F.col("kind") == kind, F.col("rank"))).alias(f"_{kind}_inside") for kind in FAULTS])
    out = rows.join(lists, series, "left").join(always, series, "left").join(inside, key, "left")
    reasons = []
    for kind, names in FAULTS.items():
        rank = F.when(F.col(f"_{kind}_list").isNull(), 0).otherwise(F.least(f"_{kind}_always", f"_{kind}_inside"))
        reasons.append(F.get(F.array(*map(F.lit, names)), rank).alias(f"{kind}_coverage_reason"))
    return out.select(*[F.col(c) for c in rows.columns], *reasons)


def relevant_conflicts(rows: DataFrame, conflicts: DataFrame, reviewed: DataFrame, series: list[str], key: list[str], *, endpoint_only: bool = False, require_cash: bool = False, holding: bool = True) -> DataFrame:
    """Adds conflict: whether a label's conflicts matter for it. rows: key, series, entry_date, exit_date, n_conflicts.

    conflicts: key, conflict_id, date, version_ids. With ``endpoint_only`` those that are dated elsewhere than at the
    endpoints do not; else, unless cash is required, those only between ordinary cash dividends do not. Conflicts whose
    versions were all reviewed to take effect outside the holding interval do not. A count that its conflicts do not
    account for always matters.
    """
    ids = conflicts.select(*key, "conflict_id", F.explode_outer("version_ids").alias("version_id")).distinct()
    spans = rows.select(*key, *[c for c in series if c not in key], "entry_date", "exit_date").dropDuplicates(key)
    review = reviewed.select(*series, "version_id", "classification", "effective_date").dropDuplicates([*series, "version_id"])
    told = ids.join(spans, key).join(review, [*series, "version_id"], "left")
    cash = F.coalesce(F.col("classification") == "ordinary_cash_dividend", F.lit(False))
    away = outside_holding(F.col("effective_date"), F.col("entry_date"), F.col("exit_date"))
    each = told.groupBy(*key, "conflict_id").agg(F.count("version_id").alias("_ids"), F.min(cash).alias("_cash"), F.min(away).alias("_away"))
    dated = conflicts.select(*key, "conflict_id", "date").dropDuplicates([*key, "conflict_id"]).join(each, [*key, "conflict_id"]).join(spans.select(*key, "entry_date", "exit_date"), key)
    elsewhere = F.coalesce(~F.col("date").isin(F.col("entry_date"), F.col("exit_date")), F.lit(False))
    passed = elsewhere if endpoint_only else (F.lit(not require_cash) & (F.col("_ids") > 0) & F.col("_cash"))
    passed = passed | (F.lit(holding) & (F.col("_ids") > 0) & F.col("_away"))
    counts = dated.groupBy(*key).agg(F.count("*").alias("_n"), F.max(~passed).alias("_matters"))
    out = rows.join(counts, key, "left")
    matters = (F.col("n_conflicts") > 0) & (F.coalesce("_matters", F.lit(False)) | (F.coalesce("_n", F.lit(0)) != F.col("n_conflicts")))
    return out.select(*[F.col(c) for c in rows.columns], F.coalesce(matters, F.lit(False)).alias("conflict"))


def halt_reasons(rows: DataFrame, halts: DataFrame, known: DataFrame, series: list[str]) -> DataFrame:
    """Adds halt_reason: why the halts of a security leave an endpoint in doubt; null if they do not.

    rows: series, entry_at, exit_at, halted_dates. halts: series, start_at, resumed_at (null: not resumed). known: series,
    start_at, end_at, complete: where halts, those from before included, are verified to be completely known; such
    intervals of one series count as one where they touch. The moment of resumption itself is in doubt.
    """
    good = known.where("complete and start_at <= end_at")
    told = good.select(*series).distinct().withColumn("_told", F.lit(True))
    covered = intervals.contained(rows, good, series, "entry_at", "exit_at", "start_at", "end_at", closed=True)
    torn = halts.where("start_at is null or resumed_at <= start_at").select(*series).distinct().withColumn("_torn", F.lit(True))
    targets = rows.select(*series, F.explode(F.array("entry_at", "exit_at")).alias("_at")).where("_at is not null").distinct()
    sound = halts.where("start_at is not null and (resumed_at is null or resumed_at > start_at)").select(*series, "start_at", "resumed_at")
    inside = intervals.at_points(targets, sound, series, "_at", "start_at", "resumed_at").select(*series, "_at", F.lit(HALTED).alias("_why"), F.lit(0).alias("_rank"))
    edge = targets.join(sound.select(*series, F.col("resumed_at").alias("_at")), [*series, "_at"]).select(*series, "_at", F.lit(BOUNDARY).alias("_why"), F.lit(1).alias("_rank"))
    why = inside.unionByName(edge).groupBy(*series, "_at").agg(F.min_by("_why", "_rank").alias("_why"))
    out = covered.join(told, series, "left").join(torn, series, "left")
    for end in ("entry", "exit"):
        out = out.join(why.select(*series, F.col("_at").alias(f"{end}_at"), F.col("_why").alias(f"_{end}_why")), [*series, f"{end}_at"], "left")
    reason = first_reason(
        (F.size(F.coalesce("halted_dates", F.array().cast("array<date>"))) > 0, "security_halt_date_only_evidence"),
        (F.col("_told").isNull(), "security_halt_interval_coverage_unverified"),
        (~F.col("covered"), "security_halt_interval_not_covered"),
        (F.col("_torn"), "security_halt_interval_invalid"),
    )
    return out.select(*[F.col(c) for c in rows.columns], F.coalesce(reason, "_entry_why", "_exit_why").alias("halt_reason"))
