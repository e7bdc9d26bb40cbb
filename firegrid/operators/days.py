"""Choice of days and temporal folds.  A day list is bounded by the calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(hotspots: DataFrame, day: str = "day") -> DataFrame:
    """Hotspots per day, busiest first; equal counts by day."""
    return hotspots.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "day")


def _busy(hotspots: DataFrame, least: int) -> DataFrame:
    return hotspots.groupBy("day").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def top_days(hotspots: DataFrame, n: int = 30, least: int = 10) -> DataFrame:
    return _busy(hotspots, least).orderBy(F.col("n").desc(), "day").limit(n)


def days_by_month(
    hotspots: DataFrame, per_month: int = 4, least: int = 10, months: Sequence[int] | None = None
) -> DataFrame:
    """Busiest days of each calendar month (years merged), sorted by day."""
    busy = _busy(hotspots, least).withColumn("month", F.month("day"))
    if months is not None:
        busy = busy.where(F.col("month").isin(list(months)))
    rank = F.row_number().over(Window.partitionBy("month").orderBy(F.col("n").desc(), "day"))
    return busy.withColumn("_rn", rank).where(F.col("_rn") <= per_month).drop("_rn").orderBy("day")


def dense_range(hotspots: DataFrame, start: str, end: str, least: int = 10) -> DataFrame:
    """Days of an inclusive range with enough hotspots."""
    span = hotspots.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return _busy(span, least).orderBy("day")


def temporal_folds(days: DataFrame, folds: int = 4, buffer_days: int = 1) -> DataFrame:
    """(fold, role, day): contiguous test blocks; training days lie more than ``buffer_days`` away
    from the block.  Fewer than two days per fold, or fewer than two folds, gives one fold per day.

    Training rows are the output itself: each day is generated once per fold it is compared with.
    """
    known = days.select("day").distinct()
    total = F.count("*").over(Window.partitionBy(F.lit(1)))
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("day")) - 1
    ranked = known.withColumns({"i": order, "n": total})
    lone = (F.lit(folds) < 2) | (F.col("n") < 2 * folds)
    block = sum(
        (F.when(F.col("i") >= F.floor(F.lit(k) * (F.col("n") / float(folds))), 1).otherwise(0) for k in range(1, folds)),
        F.lit(0),
    )
    placed = ranked.withColumn("fold", F.when(lone, F.col("i")).otherwise(block).cast("int"))
    spans = placed.groupBy("fold").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    count = F.when(lone, F.col("n")).otherwise(F.lit(folds))
    tried = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    train = tried.join(spans, "fold").where(
        (F.datediff("day", "last") > buffer_days) | (F.datediff("first", "day") > buffer_days)
    )
    return placed.select("fold", F.lit("test").alias("role"), "day").unionByName(
        train.select("fold", F.lit("train").alias("role"), "day")
    )
