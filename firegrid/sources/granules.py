"""Catalogue of satellite granules as a table of file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.session import store

# Name patterns of the product files.
PRODUCT = "ABI-L2-CMIPF"
CHANNEL_PATTERN = r"M\d+C(\d{2})"
START_PATTERN = r"_s(\d{4})(\d{3})(\d{2})(\d{2})(\d{2})(\d)(?:_|\.)"


def base_name(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def channel_of(name: Column) -> Column:
    """Two-digit channel as a number; NULL for other products or file types."""
    usable = name.contains(PRODUCT) & name.endswith(".nc")
    found = F.regexp_extract(name, CHANNEL_PATTERN, 1)
    return F.when(usable & (found != ""), found.cast("int"))


def start_instant(name: Column) -> Column:
    """Start instant coded as year, day of year, h, m, s, tenth; NULL when it does not parse."""
    base = base_name(name)
    part = lambda i: F.regexp_extract(base, START_PATTERN, i)
    number = lambda i: part(i).cast("int")
    fits = (number(3) < 24) & (number(4) < 60) & (number(5) < 60) & (number(1) >= 1)
    day = F.date_add(F.make_date(number(1), F.lit(1), F.lit(1)), number(2) - 1)
    seconds = number(3) * 3600 + number(4) * 60 + number(5)
    instant = F.timestamp_millis(
        (F.unix_date(day).cast("bigint") * 86400 + seconds) * 1000 + number(6) * 100
    )
    return F.when((part(1) != "") & fits, instant)


def hour_prefix(product: str, when: Column) -> Column:
    """product/yyyy/ddd/hh/ of an instant."""
    return F.concat(
        F.lit(product.strip("/") + "/"), F.date_format(when, "yyyy"), F.lit("/"),
        F.lpad(F.dayofyear(when).cast("string"), 3, "0"), F.lit("/"), F.date_format(when, "HH"), F.lit("/"),
    )


def catalogue(names: DataFrame, column: str = "name") -> DataFrame:
    """Granules of the product: name, channel, start."""
    name = F.col(column)
    return names.select(
        name.alias("name"), channel_of(name).alias("channel"), start_instant(name).alias("start")
    ).where(F.col("channel").isNotNull())


def nearest_granule(requests: DataFrame, granules: DataFrame) -> DataFrame:
    """For each request (when, channel), the granule of the same hour whose start is nearest;
    equal distances take the first name.  Requests without a granule keep NULL."""
    hour = lambda t: F.date_trunc("hour", t)
    timed = granules.where(F.col("start").isNotNull()).select(
        "channel", "name", "start", hour(F.col("start")).alias("_hour")
    )
    wanted = requests.withColumn("_hour", hour(F.col("when")))
    gap = F.abs(F.unix_millis("start") - F.unix_millis("when")) / 1000.0
    near = wanted.join(timed, ["channel", "_hour"]).groupBy("when", "channel").agg(
        F.min(F.struct(gap.alias("gap_s"), F.col("name").alias("name"))).alias("_b")
    )
    return requests.join(near, ["when", "channel"], "left").select(
        *requests.columns, F.col("_b.name").alias("name"), F.col("_b.gap_s").alias("gap_s")
    )


def locate_granules(requests: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """For each (day, channel, hour): the first granule of that hour, else the first of that day
    and channel with ``is_fallback``.  Requests without an hour (no such column, or NULL) ask for the
    first of the day.  Requests that resolve to nothing keep a NULL name."""
    wanted = requests.columns
    if "hour" not in wanted:
        requests = requests.withColumn("hour", F.lit(None).cast("int"))
    base = base_name(F.col(column))
    tagged = names.where(base.endswith(".nc")).select(
        base.alias("name"),
        F.regexp_extract(base, r"_s(\d{7})", 1).alias("_ymd"),
        F.regexp_extract(base, r"_s\d{7}(\d{2})", 1).cast("int").alias("hour"),
        F.regexp_extract(base, r"M6C(\d{2})", 1).cast("int").alias("channel"),
    ).where((F.col("_ymd") != "") & F.col("channel").isNotNull())
    # One pass over the names; the first of a day is the first of its hours.
    exact = store(tagged.groupBy("_ymd", "channel", "hour").agg(F.min("name").alias("_exact")), "granules")
    daily = exact.groupBy("_ymd", "channel").agg(F.min("_exact").alias("_any"))
    asked = requests.withColumn(
        "_ymd", F.concat(F.date_format("day", "yyyy"), F.lpad(F.dayofyear("day").cast("string"), 3, "0"))
    )
    return (
        asked.join(exact, ["_ymd", "channel", "hour"], "left")
        .join(daily, ["_ymd", "channel"], "left")
        .select(
            *wanted,
            F.coalesce("_exact", "_any").alias("name"),
            (F.col("hour").isNotNull() & F.col("_exact").isNull() & F.col("_any").isNotNull()).alias("is_fallback"),
        )
    )


def day_requests(days: DataFrame, hours: Sequence[int], channels: Sequence[int]) -> DataFrame:
    """Every (day, hour, channel) a day needs."""
    return (
        days.select("day")
        .withColumn("hour", F.explode(F.array(*[F.lit(h) for h in hours])))
        .withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    )


def complete_days(
    days: DataFrame,
    names: DataFrame,
    hours: Sequence[int] = (16, 17, 18),
    channels: Sequence[int] = (7, 13, 14),
    strict: bool = False,
) -> DataFrame:
    """Days for which every (hour, channel) resolves.  Because of the day fallback one granule per
    channel is enough; ``strict`` asks for each hour itself."""
    found = locate_granules(day_requests(days, hours, channels), names)
    ok = F.col("name").isNotNull() & (~F.col("is_fallback") if strict else F.lit(True))
    return (
        found.groupBy("day").agg(F.count_if(ok).alias("_n"))
        .where(F.col("_n") == len(set(hours)) * len(set(channels)))
        .drop("_n")
    )


def missing_days(days: DataFrame, complete: DataFrame) -> DataFrame:
    return days.select("day").distinct().join(complete.select("day"), "day", "left_anti")
