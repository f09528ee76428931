"""From normalised rows to append-only versions: identities, series, digests and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import all_reasons, digest, finite, first_reason

#: Price meaning by provider.
SEMANTICS = {"chart_json": "split_adjusted", "keyed_json": "as_traded", "array_json": "as_traded", "csv": "unknown"}


def semantics(provider: Column) -> Column:
    out = F.lit("unknown")
    for name, meaning in SEMANTICS.items():
        out = F.when(provider == name, meaning).otherwise(out)
    return out


def receipt_id(given: Column, *manifest: Column) -> Column:
    """The receipt's own id, or for older manifests a digest of the manifest."""
    return F.coalesce(given, digest(*manifest))


def resolved_security(rows: DataFrame) -> DataFrame:
    """Adds security_id and identifier_verification: verified needs an external id and evidence; a company
    number is no security id."""
    company = F.coalesce(F.rlike(F.col("external_security_id"), F.lit(r"(?i)^cik[:\s]")), F.lit(False))
    verified = F.col("external_security_id").isNotNull() & F.col("evidence").isNotNull() & ~company
    id_ = F.when(verified, digest(F.lit("external"), F.col("external_security_id"))).otherwise(digest(F.lit("local"), F.col("source"), F.col("local_instrument_id")))
    return rows.withColumns({"security_id": id_, "identifier_verification": F.when(verified, "verified").otherwise("temporary")})


def publication_precision(rows: DataFrame) -> DataFrame:
    """Adds precision and temporal_issue: a timestamp, a date or unknown, and whether the fields agree."""
    precision = F.when(F.col("published_at").isNotNull(), "timestamp").when(F.col("publication_date").isNotNull(), "date").otherwise("unknown")
    issue = first_reason(
        (F.col("published_at").isNotNull() & F.col("publication_date").isNotNull(), "ambiguous_publication_precision"),
        (F.col("revised_at") < F.col("published_at"), "revision_before_publication"),
        (F.col("revised_at").isNotNull() & F.col("published_at").isNull() & F.col("publication_date").isNull(), "revision_without_publication"),
    )
    return rows.withColumns({"precision": precision, "temporal_issue": issue})


def bound_evidence(versions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds publication_bound: verified evidence of the version's own content and times exists.

    Versions meet evidence by content and both times at once, so content that very many versions share is dealt out by
    their times. Versions without a publication time have no evidence and are dealt out by all that they say.
    """
    facts = evidence.where("verified and published_at is not null").select(F.col("version_raw_sha256").alias("_raw"), F.col("published_at").alias("_p"), F.col("revised_at").alias("_r"), F.lit(0).cast("bigint").alias("_none")).distinct()
    keep = versions.columns
    dealt = versions.withColumn("_deal", F.when(F.col("published_at").isNull(), F.xxhash64(*keep)).otherwise(0))
    same = (F.col("raw_sha256") == F.col("_raw")) & (F.col("published_at") == F.col("_p")) & F.col("revised_at").eqNullSafe(F.col("_r")) & (F.col("_deal") == F.col("_none"))
    return dealt.join(facts, same, "left").select(*keep, F.col("_p").isNotNull().alias("publication_bound")).distinct()


def matching_origins(reprocessed: DataFrame, originals: DataFrame) -> DataFrame:
    """Adds origin_receipt and origin_issue: the one original receipt of the same request, content and fetch time."""
    key = ["request_id", "raw_sha256", "fetched_at"]
    one = originals.groupBy(*key).agg(F.count_distinct("receipt_id").alias("_n"), F.min("receipt_id").alias("_id"))
    joined = reprocessed.join(one, key, "left")
    issue = first_reason((F.col("_n").isNull(), "original_receipt_missing"), (F.col("_n") > 1, "original_receipt_ambiguous"))
    return joined.withColumns({"origin_receipt": F.when(F.col("_n") == 1, F.col("_id")), "origin_issue": issue}).drop("_n", "_id")


def price_series(bars: DataFrame) -> DataFrame:
    """Each bar as an ohlcv series and, where it has an adjusted close, a close_only series."""
    none = F.lit(None).cast("double")
    full = F.struct(F.lit("ohlcv").alias("price_kind"), F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("volume"))
    only = F.struct(F.lit("close_only").alias("price_kind"), none.alias("open"), none.alias("high"), none.alias("low"), F.col("adjusted_close").alias("close"), F.lit(None).cast("bigint").alias("volume"))
    kept = [c for c in bars.columns if c not in ("open", "high", "low", "close", "volume", "adjusted_close")]
    series = F.when(F.col("adjusted_close").isNull(), F.array(full)).otherwise(F.array(full, only))
    return bars.select(*kept, F.inline(series))


def action_issues(actions: DataFrame, key: list[str]) -> DataFrame:
    """Adds issues and ex_date: event keys that repeat, ratios and amounts that are none; a dividend's ex date
    is its event date unless given."""
    many = F.count("*").over(Window.partitionBy(*key)) > 1
    split, cash = F.col("event_type") == "split", F.col("event_type") == "dividend"
    good = lambda c: F.coalesce(finite(F.col(c)) & (F.col(c) > 0), F.lit(False))
    issues = all_reasons(
        (many, "duplicate_event_key"),
        (split & ~(good("numerator") & good("denominator")), "split_ratio_invalid"),
        (cash & ~F.coalesce(finite(F.col("amount")) & (F.col("amount") >= 0), F.lit(False)), "dividend_amount_invalid"),
        (~F.coalesce(split | cash, F.lit(False)), "event_type_unsupported"),
    )
    return actions.withColumns({"issues": issues, "ex_date": F.coalesce("ex_date", F.when(cash, F.col("event_date")))})


def symbol_rows(explicit: DataFrame, directory: DataFrame) -> DataFrame:
    """Explicit assertions and those inferred from a directory, which have no effective dates."""
    inferred = directory.select("symbol", F.lit("directory").alias("origin"))
    return explicit.withColumn("origin", F.lit("explicit")).unionByName(inferred, allowMissingColumns=True)


def quarantined(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reason)"""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def value_hash(*fields: str) -> Column:
    return digest(*[F.col(f) for f in fields])


def reviewed(rows: DataFrame, review: dict) -> DataFrame:
    """Rows of a reviewed interval under the review's meaning and a normalisation version of its own; others go."""
    inside = F.col("trading_date").between(F.lit(review["start"]).cast("date"), F.lit(review["end"]).cast("date"))
    return rows.where(inside).withColumns({"price_semantics": F.lit(review["price_semantics"]), "currency": F.lit(review["currency"]), "normalizer_version": F.lit(review["version"])})
