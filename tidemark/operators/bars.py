"""Bar quality: issues by row, duplicates, moves, comparison of sources, adjustment of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import all_reasons, finite, first_reason

TOLERANCE, LARGE_MOVE, FACTOR_TOLERANCE = 1e-6, 0.25, 5e-5
FIELDS = ("open", "high", "low", "close", "volume")
PRICES = FIELDS[:4]


def issue_codes(*, outside: Column | None = None, listed: tuple[Column, Column] | None = None) -> Column:
    """Issues that one bar shows by itself, in order."""
    p = [F.col(c) for c in PRICES]
    gone = F.coalesce(*[F.when(c.isNull(), True) for c in p], F.lit(False))
    wild = ~gone & ~(finite(p[0]) & finite(p[1]) & finite(p[2]) & finite(p[3]))
    fine = ~gone & ~wild
    o, h, low, c = p
    uneven = (low > F.least(o, c) + TOLERANCE) | (h + TOLERANCE < F.greatest(o, c)) | (low > h)
    pairs = [
        (gone, "missing_price"),
        (wild, "nonfinite_price"),
        (fine & uneven, "inconsistent_ohlc"),
        (fine & (F.least(*p) < 0), "negative_price"),
        (fine & ((o == 0) | (h == 0) | (low == 0) | (c == 0)), "zero_price"),
        (F.col("volume").isNull(), "missing_volume"),
        (F.col("volume") < 0, "negative_volume"),
        (F.col("volume") == 0, "reported_zero_volume_not_proof_of_no_trading"),
    ]
    if outside is not None:
        pairs.append((outside, "observation_outside_reference_calendar"))
    if listed:
        pairs += [(F.col("trading_date") < listed[0], "pre_listing_observation"), (F.col("trading_date") > listed[1], "post_delisting_observation")]
    return all_reasons(*pairs)


def duplicates(bars: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Rows after the first of their key: duplicate_key if equal to the first, conflicting_duplicate if not."""
    w = Window.partitionBy(*key).orderBy(*order)
    same = [F.col(f).eqNullSafe(F.first(f).over(w)) for f in fields]
    equal = F.forall(F.array(*same), lambda x: x)
    marked = bars.withColumns({"_n": F.row_number().over(w), "code": F.when(equal, "duplicate_key").otherwise("conflicting_duplicate")})
    return marked.where("_n > 1").drop("_n")


def large_moves(bars: DataFrame, sessions: DataFrame, series: list[str]) -> DataFrame:
    """Closes that moved by more than LARGE_MOVE against the previous bar where no session lies between."""
    w = Window.partitionBy(*series).orderBy("trading_date")
    placed = bars.where(F.coalesce(*[F.when(F.col(c).isNull(), True) for c in PRICES], F.lit(False)) == F.lit(False)).join(F.broadcast(sessions.select("trading_date", "idx")), "trading_date")
    back = placed.withColumns({"previous_date": F.lag("trading_date").over(w), "_close": F.lag("close").over(w), "_idx": F.lag("idx").over(w)})
    move = F.try_divide(F.col("close"), F.col("_close")) - 1
    return back.withColumn("change", move).where((F.col("idx") - F.col("_idx") == 1) & (F.col("close") != 0) & (F.abs("change") > LARGE_MOVE)).drop("_close", "_idx", "idx")


def compare_sources(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Fields on which two sources differ beyond tolerance on common keys: 1e-5, volume 1e-4, relative to the left."""
    a = left.select(*key, *[F.col(f).cast("double").alias(f"a_{f}") for f in FIELDS])
    b = right.select(*key, *[F.col(f).cast("double").alias(f"b_{f}") for f in FIELDS])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in FIELDS])
    rows = a.join(b, key).select(*key, F.inline(pairs)).where("a is not null and b is not null")
    relative = F.try_divide(F.abs(F.col("a") - F.col("b")), F.abs("a"))
    limit = F.when(F.col("field") == "volume", 1e-4).otherwise(1e-5)
    return rows.withColumn("relative_difference", relative).where(relative.isNull() | (relative > limit))


def missing_sessions(observations: DataFrame, spine: DataFrame, series: list[str]) -> DataFrame:
    """Sessions of the spine (series, trading_date) without an observation."""
    return spine.join(observations.select(*series, "trading_date"), [*series, "trading_date"], "left_anti")


def action_checks(bars: DataFrame, actions: DataFrame, series: list[str]) -> DataFrame:
    """Each action against the bars before and on its date: skipped, failed, observed, passed or review.

    The bar before is the latest of an earlier date, by one aggregate over a range join.
    """
    keep = F.struct("trading_date", "close", "adjusted_close")
    own = [*series, "version_id"]
    before = actions.select(*own, "event_date").join(bars.select(*series, F.col("trading_date").alias("_d"), keep.alias("_bar")), series).where("_d < event_date").groupBy(*own).agg(F.max_by("_bar", "_d").alias("pre"))
    at = bars.select(*series, F.col("trading_date").alias("event_date"), keep.alias("post"))
    joined = actions.join(before, own, "left").join(at, [*series, "event_date"], "left")
    split = F.col("event_type") == "split"
    factor = F.try_divide(F.try_divide(F.col("pre.adjusted_close"), F.col("pre.close")), F.try_divide(F.col("post.adjusted_close"), F.col("post.close")))
    expected = 1 - F.try_divide(F.col("amount"), F.col("pre.close"))
    usable = F.coalesce(F.col("numerator") > 0, F.lit(False)) & F.coalesce(F.col("denominator") > 0, F.lit(False)) & F.coalesce(F.col("pre.close") > 0, F.lit(False)) & F.coalesce(F.col("post.close") > 0, F.lit(False))
    status = F.when(F.col("pre").isNull() | F.col("post").isNull(), "skipped").when(split & ~usable, "failed").when(split, "observed").when(F.abs(factor - expected) < FACTOR_TOLERANCE, "passed").when(factor.isNotNull(), "review")
    return joined.select(*own, "event_type", "event_date", status.alias("status"), factor.alias("observed_factor"), expected.alias("expected_factor")).where("status is not null")


def manifest_reason() -> Column:
    """Why a manifest cannot be imported, by its first fault."""
    return first_reason(
        (F.col("schema_version").isNull(), "schema_version_missing"),
        (F.col("source").isNull() | F.col("request_id").isNull(), "identity_missing"),
        (F.col("fetched_at").isNull(), "receipt_time_invalid"),
        (~F.rlike(F.coalesce("sha256", F.lit("")), F.lit("^[0-9a-f]{64}$")), "raw_hash_invalid"),
        (F.coalesce(F.col("file_size"), F.lit(-1)) < 0, "file_size_invalid"),
        ((F.col("status") == "success") & F.col("normalized_sha256").isNull(), "normalized_artifact_missing"),
    )
