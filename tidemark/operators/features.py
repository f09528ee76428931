"""Features over the last sessions of a dense spine: frames count sessions, never observed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import finite, first_reason
from tidemark.operators.calendar import elapsed

CHANGES, VOLATILITIES, MEANS, LOOKBACK = (1, 5, 20, 60), (5, 20, 60), (20, 60), 61


def _reason(n: int, fields: tuple[str, ...], series: list[str], only: dict[str, int] | None = None) -> Column:
    """Why the last n sessions cannot give a value. ``only`` limits a field to one place of the frame, counted back."""
    w = Window.partitionBy(*series).orderBy("idx")
    frame, long = w.rowsBetween(1 - n, 0), w.rowsBetween(1 - LOOKBACK, 0)
    earliest = F.min(F.when(F.col("observed"), F.col("idx"))).over(long)
    present = F.count_if(F.col("observed")).over(frame)
    after_start = F.col("idx") - F.greatest(earliest, F.col("idx") - n + 1) + 1

    def some(test) -> Column:
        found = F.lit(False)
        for f in fields:
            bad = F.coalesce(test(f), F.lit(False))
            found = found | (F.coalesce(F.lag(bad, only[f]).over(w), F.lit(False)) if only else F.max(bad).over(frame))
        return found

    sign = lambda f: (F.col(f) < 0) if f == "volume" else (F.col(f) <= 0)
    return first_reason(
        (F.col("idx") + 1 < n, "lookback_outside_calendar"),
        ((present < n) & (present > 0) & (present == after_start), "insufficient_history_or_prelisting_unverified"),
        ((present < n) & (present == 0) & (earliest > F.col("idx")), "insufficient_history_or_prelisting_unverified"),
        (present < n, "missing_session_or_collection_failure"),
        (some(lambda f: F.col(f).isNull()), "missing_input_field"),
        (some(lambda f: ~finite(F.col(f))), "invalid_input_type_or_nonfinite"),
        (some(sign), "negative_volume" if fields == ("volume",) else "zero_or_negative_price"),
    )


def features(spine: DataFrame, series: list[str], *, as_traded: bool = True) -> DataFrame:
    """Per session of each series: values, and for every value its reason if it has none.

    Names follow the price meaning: price changes for as-traded prices, returns for adjusted ones.
    """
    w = Window.partitionBy(*series).orderBy("idx")
    change, volatility = ("close_price_change", "realized_log_price_change_volatility") if as_traded else ("close_return", "realized_log_return_volatility")
    df = spine.withColumn("_log", F.ln(F.when(F.col("close") > 0, F.col("close"))))
    df = df.withColumn("_step", F.col("_log") - F.lag("_log").over(w))
    values: dict[str, tuple[Column, Column]] = {}
    for n in CHANGES:
        values[f"{change}_{n}"] = (F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1, _reason(n + 1, ("close",), series))
    for n in VOLATILITIES:
        values[f"{volatility}_{n}"] = (F.stddev_samp("_step").over(w.rowsBetween(1 - n, 0)), _reason(n + 1, ("close",), series))
    for n in MEANS:
        values[f"close_to_ma_{n}"] = (F.try_divide(F.col("close"), F.avg("close").over(w.rowsBetween(1 - n, 0))) - 1, _reason(n, ("close",), series))
    values["open_gap"] = (F.try_divide(F.col("open"), F.lag("close").over(w)) - 1, _reason(2, ("open", "close"), series, {"open": 0, "close": 1}))
    values["intraday_high_low_ratio"] = (F.try_divide(F.col("high"), F.col("low")) - 1, _reason(1, ("high", "low"), series))
    values["volume_to_prior20_mean"] = (F.try_divide(F.col("volume").cast("double"), F.avg("volume").over(w.rowsBetween(-20, -1))), _reason(21, ("volume",), series))
    out = {}
    for name, (value, reason) in values.items():
        out[f"{name}_reason"] = F.coalesce(reason, F.when(~finite(value), "invalid_numeric_result"))
        out[name] = F.when(reason.isNull() & finite(value), value)
    df = df.withColumns(out).withColumn("elapsed_sessions", elapsed(F.col("idx"), F.col("observed"), series))
    missing = F.exists(F.array(*[F.col(f"{n}_reason").isNotNull() for n in values]), lambda x: x)
    return df.withColumn("missing_any", missing).drop("_log", "_step")


def series_reason(identity: list[str], *, expected_semantics: str | None = None, expected_currency: str | None = None) -> list[Column]:
    """Aggregates over a series' rows for the reason that holds for all of its features: use in groupBy(...).agg(...)."""
    pairs = [(F.count_distinct(F.struct(*identity)) > 1, "mixed_series_meaning_currency_session_or_identity"), (F.max((F.col("price_semantics") == "unknown") | F.col("currency").isNull()), "unknown_meaning_or_currency")]
    if expected_semantics:
        pairs.append((F.max(F.col("price_semantics") != expected_semantics), "price_meaning_contract_mismatch"))
    if expected_currency:
        pairs.append((F.max(F.col("currency") != expected_currency), "currency_contract_mismatch"))
    pairs.append((F.count("*") > F.count_distinct("trading_date"), "duplicate_feature_session"))
    return [first_reason(*pairs).alias("series_reason")]
