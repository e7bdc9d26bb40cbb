"""Pixel tables: long form per channel, and navigation from fixed-grid scan angles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.functions import geo
from firegrid.schema import CHANNELS


def read_pixels(spark, path: str) -> DataFrame:
    """Parquet pixel table as it is, so that predicates on the brightness reach the scan.

    NaN brightness is dropped with the range by the quality filter, which every binning starts with.
    """
    return spark.read.parquet(path)


def long_pixels(wide: DataFrame, channels: Sequence[int] = CHANNELS) -> DataFrame:
    """One row per channel from a table with one brightness column per channel."""
    pairs = ", ".join(f"{ch}, bt{ch}" for ch in channels)
    others = [c for c in wide.columns if c not in {f"bt{ch}" for ch in channels}]
    return wide.selectExpr(*others, f"stack({len(channels)}, {pairs}) AS (channel, bt)")


def navigate(
    pixels: DataFrame,
    height: float,
    lon0: float,
    semi_major: float,
    semi_minor: float,
    sweep: str = "x",
) -> DataFrame:
    """Adds lat and lon from scan angles ``x_rad`` and ``y_rad``; NULL off the Earth."""
    lat, lon = geo.scan_angle_latlon(F.col("x_rad"), F.col("y_rad"), height, lon0, semi_major, semi_minor, sweep)
    return pixels.withColumns({"lat": lat, "lon": lon})
