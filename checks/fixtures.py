"""Scene tables derived from the given star-schema tables.

Seven scenes (ship years), three hours each, listed out of clock order; positions reach beyond
the box; flags, gaps and out-of-range brightness come from the columns of ``lineitem``.
Hotspots and second-sensor detections are all of ``events``, dealt by the parity of their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.operators import grid as G
from firegrid.operators.neighborhood import settle
from firegrid.schema import state_grid
from firegrid.sources.pixels import long_pixels

GRID = state_grid(24, 24)
HOURS = 3

_LAT = "-8.0e0 + 5.6e0 * ((({a}*7919 + {b}*104729) % 10007) / 10007e0)"
_LON = "-41.6e0 + 4.7e0 * ((({a}*6007 + {b}*3571 + {c}*31) % 10009) / 10009e0)"

# Text both engines accept.
WIDE_PIXELS = f"""
SELECT l_orderkey, l_linenumber,
  CAST(year(l_shipdate) - 1994 AS INT) AS scene_id,
  CAST(16 + l_linenumber % 3 AS INT) AS hour,
  CAST((l_linenumber + 1) % 3 AS INT) AS hour_seq,
  {_LAT.format(a='l_orderkey', b='l_linenumber')} AS lat,
  {_LON.format(a='l_partkey', b='l_suppkey', c='l_orderkey')} AS lon,
  285e0 + 0.5e0*l_quantity AS bt13,
  282e0 + 0.5e0*l_quantity - 10e0*l_tax AS bt14,
  289e0 + 0.5e0*l_quantity + 180e0*l_discount AS bt7,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS dqf
FROM lineitem"""

_SLOT = "(1 + (day(ts) - 1) % 7)"

_EVENTS = f"""
SELECT event_id, ts, CAST({_SLOT} AS INT) AS scene_id, event_type, value,
  {{lat}} AS lat,
  {{lon}} AS lon,
  CASE WHEN value < 20e0 THEN 'l' WHEN value < 60e0 THEN 'n' WHEN value < 150e0 THEN 'h' END AS level
FROM events"""

POINTS = _EVENTS.format(
    lat=_LAT.format(a="event_id", b="user_id"), lon=_LON.format(a="event_id", b="user_id", c="user_id")
)

# Every event burns at one of 33 places of its scene, up to 0.05 degrees off; 17 places are seen by both sides.
_PLACE = "(user_id % 25 + 8 * (event_id % 2))"
_OFF = " + 0.1e0 * ((event_id * {} % 101) / 101e0 - 0.5e0)"
FIRES = _EVENTS.format(
    lat=_LAT.format(a=_PLACE, b=_SLOT) + _OFF.format(37), lon=_LON.format(a=_PLACE, b=_SLOT, c=_PLACE) + _OFF.format(61)
)

HOTSPOTS = "SELECT * FROM fires WHERE event_id % 2 = 0"

# Detections carry the numeric confidence the normaliser would give.
DETECTIONS = """
SELECT event_id, ts, scene_id, lat, lon,
  CASE level WHEN 'l' THEN 30e0 WHEN 'n' THEN 60e0 WHEN 'h' THEN 90e0 END AS confidence
FROM fires WHERE event_id % 2 = 1"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def wide_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    return spark.sql(WIDE_PIXELS)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_pixels(wide_pixels(spark, sf_dir).drop("l_orderkey", "l_linenumber"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(POINTS).withColumn("datetime", F.col("ts").cast("timestamp"))


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events at the places they gather at: even ids are hotspots, odd ones detections of the second sensor."""
    tables(spark, sf_dir, "events")
    return spark.sql(FIRES).withColumn("datetime", F.col("ts").cast("timestamp"))


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires(spark, sf_dir).where("event_id % 2 = 0")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("level")
    confidence = F.when(level == "l", 30.0).when(level == "n", 60.0).when(level == "h", 90.0)
    rows = fires(spark, sf_dir).where("event_id % 2 = 1")
    return rows.withColumn("confidence", confidence).drop("level", "event_type", "value")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_pixels(spark, sf_dir).select("scene_id", "hour", "hour_seq").distinct()


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense cube at a stored precision of 1e-6 K, so both engines see the same numbers."""
    dense = G.hourly_cube(pixels(spark, sf_dir), GRID, layers=layers(spark, sf_dir))
    return dense.withColumns({f"bt{ch}": F.round(f"bt{ch}", 6) for ch in (7, 13, 14)})


def day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(G.day_cells(cube(spark, sf_dir)), GRID)
