"""Session calendars: dense index, plans, windows and elapsed sessions. A calendar is pinned by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.values import plus_seconds

HORIZONS = (1, 5, 20)


def indexed(sessions: DataFrame) -> DataFrame:
    """Adds idx, from 0, by date within each calendar version and exchange (columns other than these are kept)."""
    keys = [c for c in ("calendar_version", "exchange") if c in sessions.columns]
    return sessions.withColumn("idx", (F.row_number().over(Window.partitionBy(*keys).orderBy("trading_date")) - 1).cast("bigint"))


def plan(sessions: DataFrame, *, delay_seconds: float = 3600, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Per session as decision date: decision_at, entry and the exits of each horizon; null past the calendar's end."""
    w = Window.partitionBy(*[c for c in ("calendar_version", "exchange") if c in sessions.columns]).orderBy("idx")
    ahead = lambda c, n: F.lead(c, n).over(w)
    exits = [x for h in horizons for x in (ahead("trading_date", 1 + h).alias(f"exit_date_{h}"), ahead("open_utc", 1 + h).alias(f"exit_at_{h}"), ahead("close_utc", 1 + h).alias(f"exit_close_{h}"))]
    return sessions.select(
        F.col("trading_date").alias("decision_date"),
        "idx",
        plus_seconds(F.col("close_utc"), delay_seconds).alias("decision_at"),
        ahead("trading_date", 1).alias("entry_date"),
        ahead("open_utc", 1).alias("intended_entry_at"),
        *exits,
    )


def spine(observations: DataFrame, sessions: DataFrame, series: list[str]) -> DataFrame:
    """Every session from the calendar's first to each series' last, with the series' row where it has one.

    Nothing is filled: a session without an observation has null values. ``observed`` tells.
    """
    placed = observations.join(F.broadcast(sessions.select("trading_date", "idx")), "trading_date")
    spans = placed.groupBy(*series).agg(F.max("idx").alias("last")).select(*series, F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("idx"))
    values = placed.drop("trading_date").withColumn("observed", F.lit(True))
    dense = spans.join(values, [*series, "idx"], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))
    return dense.join(F.broadcast(sessions.select("idx", "trading_date")), "idx")


def elapsed(idx: Column, observed: Column, series: list[str]) -> Column:
    """Sessions since the last observation at or before each session of a spine."""
    w = Window.partitionBy(*series).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return idx - F.last(F.when(observed, idx), ignorenulls=True).over(w)


def gaps(observations: DataFrame, sessions: DataFrame, series: list[str]) -> DataFrame:
    """Sessions between a series' first and last observation on which it has none."""
    dense = spine(observations.select(*series, "trading_date"), sessions, series)
    first = F.min(F.when(F.col("observed"), F.col("idx"))).over(Window.partitionBy(*series))
    return dense.withColumn("_first", first).where("not observed and idx > _first").select(*series, "trading_date")


def sessions_by_rule(days: DataFrame, holidays: DataFrame, early: DataFrame, *, zone: str = "America/New_York", opens: str = "09:30", closes: str = "16:00", version: str) -> DataFrame:
    """Sessions on those of ``days`` (trading_date) that are weekdays and no ``holidays`` (trading_date), with local hours as
    UTC; ``early`` (trading_date, closes) has the days that close earlier. Holidays and early closes are data."""
    open_days = days.where(F.weekday("trading_date") < 5).select("trading_date").distinct().join(holidays.select("trading_date").distinct(), "trading_date", "left_anti")
    timed = open_days.join(early.groupBy("trading_date").agg(F.min("closes").alias("_closes")), "trading_date", "left")
    utc = lambda clock: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("trading_date").cast("string"), clock)), zone).cast("timestamp_ntz")
    return timed.select(F.lit(version).alias("calendar_version"), "trading_date", utc(F.lit(opens)).alias("open_utc"), utc(F.coalesce("_closes", F.lit(closes))).alias("close_utc"), F.lit(zone).alias("timezone"))


def session_table(spark: SparkSession, start: str, end: str, *, holidays: list[str] = (), early: dict[str, str] | None = None, version: str, **hours: str) -> DataFrame:
    """``sessions_by_rule`` over the days from start to end, both included, with holidays and early closes as lists."""
    days = spark.sql("SELECT explode(sequence(CAST(:start AS DATE), CAST(:end AS DATE), INTERVAL 1 DAY)) AS trading_date", args={"start": start, "end": end})
    closed = spark.createDataFrame([(h,) for h in holidays], "d string").select(F.col("d").cast("date").alias("trading_date"))
    earlier = spark.createDataFrame(list((early or {}).items()), "d string, closes string").select(F.col("d").cast("date").alias("trading_date"), "closes")
    return sessions_by_rule(days, closed, earlier, version=version, **hours)
