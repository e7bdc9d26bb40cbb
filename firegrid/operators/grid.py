"""From pixels and points to grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions import geo
from firegrid.functions.stats import with_quantiles
from firegrid.operators.neighborhood import settle
from firegrid.schema import CHANNELS, SCENE, GridSpec


def quality_filter(pixels: DataFrame, good_only: bool = True) -> DataFrame:
    """Finite brightness in 180..330 K, and nominal quality flag when asked."""
    ok = pixels.where(
        F.col("bt").between(180.0, 330.0) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    ).where(~F.isnan("bt") & ~F.isnan("lat") & ~F.isnan("lon"))
    return ok.where(F.col("dqf") == 0) if good_only else ok


def bbox_filter(points: DataFrame, grid: GridSpec) -> DataFrame:
    return points.where(geo.in_bbox(F.col("lat"), F.col("lon"), grid))


def day_filter(points: DataFrame, day: str, ts: str = "datetime") -> DataFrame:
    """Half-open UTC day window; stays a range predicate so a scan can use it."""
    d0 = F.lit(day).cast("timestamp")
    return points.where((F.col(ts) >= d0) & (F.col(ts) < d0 + F.expr("INTERVAL 24 HOURS")))


def index_window(pixels: DataFrame, grid: GridSpec, keys: Sequence[str] = SCENE) -> DataFrame:
    """Smallest (y, x) index rectangle covering the box, per scene; empty when nothing is inside."""
    inside = bbox_filter(pixels, grid)
    return inside.groupBy(*keys).agg(
        F.min("y").alias("y_lo"), F.max("y").alias("y_hi"),
        F.min("x").alias("x_lo"), F.max("x").alias("x_hi"),
    )


def crop_to_window(pixels: DataFrame, grid: GridSpec, keys: Sequence[str] = SCENE) -> DataFrame:
    """Pixels of the covering rectangle, including those in it but outside the box."""
    window = index_window(pixels, grid, keys)
    return (
        pixels.join(window, list(keys))
        .where(F.col("y").between(F.col("y_lo"), F.col("y_hi")) & F.col("x").between(F.col("x_lo"), F.col("x_hi")))
        .drop("y_lo", "y_hi", "x_lo", "x_hi")
    )


def grid_edges(spark, grid: GridSpec) -> DataFrame:
    """All edges of both axes: ``axis``, ``i``, ``edge``."""
    lat = spark.range(grid.h + 1).select(
        F.lit("lat").alias("axis"), F.col("id").cast("int").alias("i"),
        geo.edge(F.col("id"), grid.min_lat, grid.max_lat, grid.h).alias("edge"),
    )
    lon = spark.range(grid.w + 1).select(
        F.lit("lon").alias("axis"), F.col("id").cast("int").alias("i"),
        geo.edge(F.col("id"), grid.min_lon, grid.max_lon, grid.w).alias("edge"),
    )
    return lat.unionByName(lon)


def assign_cells(points: DataFrame, grid: GridSpec, closed_top: bool = True) -> DataFrame:
    """Add ``r`` and ``c``; points outside the grid are dropped first."""
    inside = points.where(geo.in_grid(F.col("lat"), F.col("lon"), grid, closed_top))
    return inside.withColumns(
        {"r": geo.lat_row(F.col("lat"), grid), "c": geo.lon_col(F.col("lon"), grid)}
    )


def bin_mean(pixels: DataFrame, grid: GridSpec, good_only: bool = True) -> DataFrame:
    """Mean brightness and pixel count per scene, hour, channel and cell (occupied cells only)."""
    placed = assign_cells(quality_filter(pixels, good_only), grid)
    return placed.groupBy("scene_id", "hour", "hour_seq", "channel", "r", "c").agg(
        F.avg("bt").alias("bt"), F.count("bt").alias("n")
    )


def pivot_channels(cells: DataFrame, channels: Sequence[int] = CHANNELS) -> DataFrame:
    """One column per channel, from a fixed list so no extra pass discovers the values."""
    wide = cells.groupBy("scene_id", "hour", "hour_seq", "r", "c").pivot("channel", list(channels)).agg(F.first("bt"))
    return wide.withColumnsRenamed({str(ch): f"bt{ch}" for ch in channels})


def layer_skeleton(layers: DataFrame, grid: GridSpec) -> DataFrame:
    """Every (r, c) of every row of ``layers``, generated in place (no join)."""
    return layers.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(grid.h - 1)))).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(grid.w - 1)))
    )


def hourly_cube(
    pixels: DataFrame,
    grid: GridSpec,
    channels: Sequence[int] = CHANNELS,
    layers: DataFrame | None = None,
    good_only: bool = True,
) -> DataFrame:
    """Dense cube: quality filter, binning, channel pivot and completion in one aggregation.

    Pixels are averaged map-side first, so what moves is at most one partial row per cell and
    task.  The empty skeleton joins the same aggregation as rows without values.  ``layers``
    names the (scene_id, hour, hour_seq) wanted; by default those present in ``pixels``.
    """
    if layers is None:
        layers = pixels.select("scene_id", "hour", "hour_seq").distinct()
    placed = assign_cells(quality_filter(pixels, good_only), grid)
    key = ["scene_id", "hour", "hour_seq", "r", "c"]
    values = placed.select(*key, "channel", "bt")
    empty = layer_skeleton(layers.select("scene_id", "hour", "hour_seq"), grid).select(
        *key, F.lit(None).cast("int").alias("channel"), F.lit(None).cast("double").alias("bt")
    )
    dense = values.unionByName(empty).groupBy(*key).agg(
        *[F.avg(F.when(F.col("channel") == ch, F.col("bt"))).alias(f"bt{ch}") for ch in channels]
    )
    return settle(dense, grid)


def complete_grid(cells: DataFrame, grid: GridSpec, layers: DataFrame | None = None) -> DataFrame:
    """Dense version of an already binned table: every cell of every layer, NULL where absent."""
    key = ["scene_id", "hour", "hour_seq"]
    base = layers if layers is not None else cells.select(*key).distinct()
    return layer_skeleton(base.select(*key), grid).join(cells, [*key, "r", "c"], "left")


def presence_mask(points: DataFrame, grid: GridSpec, closed_top: bool = True) -> DataFrame:
    """Cells holding at least one point."""
    return assign_cells(points, grid, closed_top).select("scene_id", "r", "c").distinct()


def cell_centers(cells: DataFrame, grid: GridSpec) -> DataFrame:
    return cells.withColumns(
        {"lat": geo.center_lat(F.col("r"), grid), "lon": geo.center_lon(F.col("c"), grid)}
    )


def merge_hours_max(cube: DataFrame, channels: Sequence[int] = CHANNELS) -> DataFrame:
    """Maximum over hours per channel, ignoring missing hours."""
    return cube.groupBy("scene_id", "r", "c").agg(*[F.max(f"bt{ch}").alias(f"bt{ch}") for ch in channels])


def all_present(channels: Sequence[int] = CHANNELS) -> Column:
    out = F.lit(True)
    for ch in channels:
        out = out & F.col(f"bt{ch}").isNotNull()
    return out


def valid_cells(cube: DataFrame, channels: Sequence[int] = CHANNELS) -> DataFrame:
    """Dense (scene_id, r, c, valid): every channel present in every hour."""
    return cube.groupBy("scene_id", "r", "c").agg(F.bool_and(all_present(channels)).alias("valid"))


def with_valid(cube: DataFrame, channels: Sequence[int] = CHANNELS) -> DataFrame:
    """The same flag attached to every hourly row."""
    w = Window.partitionBy("scene_id", "r", "c")
    return cube.withColumn("valid", F.bool_and(all_present(channels)).over(w))


def day_cells(cube: DataFrame, channels: Sequence[int] = CHANNELS) -> DataFrame:
    """Hour-merged maxima and validity in one aggregation."""
    return cube.groupBy("scene_id", "r", "c").agg(
        *[F.max(f"bt{ch}").alias(f"bt{ch}") for ch in channels],
        F.bool_and(all_present(channels)).alias("valid"),
    )


def fill_with_median(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SCENE, group_rows: int | None = None
) -> DataFrame:
    """Replace NULL by the group median of the column."""
    medians = {f"_med_{c}": (F.col(c), 0.5) for c in columns}
    ranked = with_quantiles(df, keys, medians, group_rows)
    return ranked.withColumns({c: F.coalesce(c, f"_med_{c}") for c in columns}).drop(*medians)
