"""Half-open date or time intervals in bulk: joins at a point, unions, containment, and where owners overlap.

Intervals meet points by equal keys and equal periods of PERIOD days, then by their exact bounds, so no join
compares everything with everything. Unions and overlaps are one sweep over the ends of a key's intervals: a
running maximum, or running sums of what is open. A null upper bound is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import half_open

#: Days of a period by which intervals and points are joined.
PERIOD = 64


def period(at: Column, days: int = PERIOD) -> Column:
    return F.floor(F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")) / days).cast("int")


def spread(spans: DataFrame, lo: str, hi: str, first: Column, last: Column, days: int = PERIOD) -> DataFrame:
    """``spans`` once for each period between their bounds, as far as these lie between ``first`` and ``last``."""
    start, end = F.greatest(F.col(lo), first), F.least(F.coalesce(F.col(hi), last), last)
    inside = spans.withColumns({"_from": period(start, days), "_to": period(end, days)}).where("_from <= _to")
    return inside.withColumn("_period", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")


def at_points(points: DataFrame, spans: DataFrame, on: list[str], at: str, lo: str, hi: str, days: int = PERIOD) -> DataFrame:
    """Each point with every interval of its key that holds it. The other columns of both have to differ."""
    ends = points.agg(F.min(at).alias("_first"), F.max(at).alias("_last")).first()
    first, last = F.lit(ends["_first"]), F.lit(ends["_last"])
    side = spread(spans, lo, hi, first.cast(points.schema[at].dataType), last.cast(points.schema[at].dataType), days)
    met = points.withColumn("_period", period(F.col(at), days)).join(side, [*on, "_period"])
    return met.where(half_open(F.col(lo), F.col(hi), F.col(at))).drop("_period")


def union(spans: DataFrame, key: list[str], lo: str, hi: str) -> DataFrame:
    """Each key's intervals with those that overlap or touch made one: key, lo, hi (null: open)."""
    order = Window.partitionBy(*key).orderBy(lo).rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.max(F.col(hi).isNull()).over(order), F.lit(False))
    apart = ~open_before & F.coalesce(F.max(hi).over(order) < F.col(lo), F.lit(True))
    some = spans.where(F.col(hi).isNull() | (F.col(lo) < F.col(hi))).select(*key, lo, hi)
    marked = some.withColumn("_opens", apart.cast("int")).withColumn("_part", F.sum("_opens").over(Window.partitionBy(*key).orderBy(lo).rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy(*key, "_part").agg(F.min(lo).alias(lo), F.max(hi).alias("_hi"), F.max(F.col(hi).isNull()).alias("_open"))
    return whole.select(*key, lo, F.when(~F.col("_open"), F.col("_hi")).alias(hi))


def gaps(spans: DataFrame, key: list[str], lo: str, hi: str) -> DataFrame:
    """Between a key's intervals, where none is open: key, lo, hi."""
    one = union(spans, key, lo, hi)
    after = one.withColumn("_next", F.lead(lo).over(Window.partitionBy(*key).orderBy(lo))).where(F.col("_next").isNotNull())
    return after.select(*key, F.col(hi).alias(lo), F.col("_next").alias(hi))


def several(spans: DataFrame, key: list[str], owner: list[str], lo: str, hi: str) -> DataFrame:
    """Where intervals of unlike owners of one key are open at a time: key, lo, hi.

    Owners of a key are numbered. The numbers that are open are all alike exactly if n * sum(x * x) = sum(x) ** 2, so running
    sums over the ends of the intervals tell where they are not.
    """
    some = spans.where(F.col(hi).isNull() | (F.col(lo) < F.col(hi)))
    number = some.withColumn("_x", F.dense_rank().over(Window.partitionBy(*key).orderBy(*owner)).cast("decimal(18,0)"))
    ends = number.select(*key, "_x", F.inline(F.array(F.struct(F.col(lo).alias("_at"), F.lit(1).alias("_d")), F.struct(F.col(hi).alias("_at"), F.lit(-1).alias("_d"))))).where("_at is not null")
    steps = ends.groupBy(*key, "_at").agg(F.sum("_d").alias("_n"), F.sum(F.col("_d") * F.col("_x")).alias("_s"), F.sum(F.col("_d") * F.col("_x") * F.col("_x")).cast("decimal(38,0)").alias("_q"))
    along = Window.partitionBy(*key).orderBy("_at")
    exact = {"_n": "decimal(12,0)", "_s": "decimal(18,0)", "_q": "decimal(25,0)"}  # products of these stay whole
    open_ = steps.select(*key, "_at", F.lead("_at").over(along).alias("_next"), *[F.sum(c).over(along).cast(kind).alias(c) for c, kind in exact.items()])
    return open_.where(F.col("_n") * F.col("_q") != F.col("_s") * F.col("_s")).select(*key, F.col("_at").alias(lo), F.col("_next").alias(hi))


def contained(targets: DataFrame, spans: DataFrame, key: list[str], start: str, end: str, lo: str, hi: str, *, closed: bool = False) -> DataFrame:
    """``targets`` with ``covered``: whether one stretch of their key's intervals, joined where they touch, holds them from
    start to end, both included; with ``closed`` the upper bound of a stretch belongs to it."""
    whole = union(spans, key, lo, hi)
    points = targets.select(*key, start, end).distinct()
    met = at_points(points, whole, key, start, lo, hi).groupBy(*key, start, end).agg(F.max(F.col(hi).isNull() | (F.col(end) <= F.col(hi) if closed else F.col(end) < F.col(hi))).alias("covered"))
    met = met.select(*[F.col(c).alias(f"_of_{c}") for c in (*key, start, end)], "covered")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*key, start, end)]
    return targets.join(met, same, "left").select(*[F.col(c) for c in targets.columns], F.coalesce("covered", F.lit(False)).alias("covered"))
