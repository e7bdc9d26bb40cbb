"""Neighbourhood operators on dense cell tables and sparse masks.

Dense operators expect every (r, c) of the grid for each key.  Smoothing and maxima are
separable window passes; only the sliding median leaves the JVM, one bounded tile at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firegrid.functions.geo import gate_iterations
from firegrid.functions.stats import WINDOW_ROWS
from firegrid.schema import LAYER, SCENE, GridSpec

CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
BOX = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))
MAX_TILE = 96


def odd_size(k: int) -> int:
    """Window sizes are odd and at least 3."""
    k = int(k)
    return max(3, k if k % 2 == 1 else k + 1)


def tile_side(n: int) -> int:
    """Even tile length of at most 96 cells."""
    return math.ceil(n / math.ceil(n / MAX_TILE))


def settle(df: DataFrame, grid: GridSpec, scene: str = "scene_id") -> DataFrame:
    """Place each scene in one partition: later windows, tiles and folds reuse this shuffle.

    A scene holds at most ``grid.cells`` rows per hour.  Grids too large for one task stay
    spread; their operators shuffle by their own, finer keys.
    """
    return df.repartition(scene) if grid.cells <= WINDOW_ROWS else df


def _sliding_median(block: np.ndarray, k: int) -> np.ndarray:
    views = np.lib.stride_tricks.sliding_window_view(block, (k, k))
    flat = views.reshape(*views.shape[:2], k * k)
    return np.partition(flat, k * k // 2, axis=-1)[..., k * k // 2]


def median_backgrounds(
    df: DataFrame,
    value: str,
    sizes: Iterable[int],
    grid: GridSpec,
    keys: Sequence[str] = LAYER,
    prefix: str = "med",
) -> DataFrame:
    """k x k medians with replicated borders, for several k in one pass: adds ``{prefix}{k}``.

    The grid is cut into tiles of at most 96 cells a side plus a halo of half the largest
    window, so a task's array is bounded whatever the grid.  ``value`` must have no NULL
    unless the whole layer is NULL, in which case the medians are NULL.
    """
    sizes = sorted({odd_size(k) for k in sizes})
    halo = sizes[-1] // 2
    th, tw = tile_side(grid.h), tile_side(grid.w)
    nth, ntw = math.ceil(grid.h / th), math.ceil(grid.w / tw)
    names = {k: f"{prefix}{k}" for k in sizes}
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in names.values()])
    columns = schema.fieldNames()

    def tiles_of(x: Column, side: int, count: int) -> Column:
        first = F.greatest(F.lit(0), F.floor((x - halo) / side)).cast("int")
        last = F.least(F.lit(count - 1), F.floor((x + halo) / side)).cast("int")
        return F.explode(F.sequence(first, last))

    def one_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["_tr"].iloc[0]) * th, int(pdf["_tc"].iloc[0]) * tw
        r1, c1 = min(r0 + th, grid.h), min(c0 + tw, grid.w)
        top, left = max(r0 - halo, 0), max(c0 - halo, 0)
        bottom, right = min(r1 + halo, grid.h), min(c1 + halo, grid.w)
        rows, cols = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        block = np.full((bottom - top, right - left), np.nan)
        block[rows - top, cols - left] = pdf[value].to_numpy(dtype=np.float64)
        pads = (
            (halo - (r0 - top), halo - (bottom - r1)),
            (halo - (c0 - left), halo - (right - c1)),
        )
        block = np.pad(block, pads, mode="edge")
        own = (rows >= r0) & (rows < r1) & (cols >= c0) & (cols < c1)
        out = pdf.loc[own, columns[: -len(names)]].copy()
        rr, cc = rows[own] - r0, cols[own] - c0
        for k, name in names.items():
            trim = halo - k // 2
            inner = block[trim : block.shape[0] - trim, trim : block.shape[1] - trim]
            out[name] = _sliding_median(inner, k)[rr, cc]
        return out

    tiled = df.withColumn("_tr", tiles_of(F.col("r"), th, nth)).withColumn(
        "_tc", tiles_of(F.col("c"), tw, ntw)
    )
    out = tiled.groupBy(*keys, "_tr", "_tc").applyInPandas(one_tile, schema)
    # The grouped map forgets how its rows are placed.
    return settle(out, grid, keys[0])


def _line(keys: Sequence[str], across: str, along: str):
    return Window.partitionBy(*keys, across).orderBy(along)


def _weighted_line(x: Column, weights: Sequence[float], keys: Sequence[str], across: str, along: str) -> Column:
    """Sum of w[d] * x shifted by d, the ends of the line repeated."""
    w = _line(keys, across, along)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(x).over(whole), F.last(x).over(whole)
    radius = len(weights) // 2
    total = weights[radius] * x
    for d in range(1, radius + 1):
        before = F.coalesce(F.lag(x, d).over(w), first)
        after = F.coalesce(F.lead(x, d).over(w), last)
        total = total + (weights[radius - d] * before + weights[radius + d] * after)
    return total


def _two_passes(df: DataFrame, value: str, out: str, weights: Sequence[float], keys: Sequence[str]) -> DataFrame:
    half = df.withColumn("_half", _weighted_line(F.col(value), weights, keys, "c", "r"))
    return half.withColumn(out, _weighted_line(F.col("_half"), weights, keys, "r", "c")).drop("_half")


def box_mean(df: DataFrame, value: str, out: str, size: int = 5, keys: Sequence[str] = SCENE) -> DataFrame:
    """size x size mean with replicated borders."""
    return _two_passes(df, value, out, [1.0 / size] * size, keys)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    return [v / sum(raw) for v in raw]


def gaussian_smooth(
    df: DataFrame, value: str, out: str, sigma: float, keys: Sequence[str] = SCENE, truncate: float = 4.0
) -> DataFrame:
    """Gaussian smoothing with replicated borders; a vanishing sigma copies the value."""
    if sigma <= 1e-6:
        return df.withColumn(out, F.col(value))
    return _two_passes(df, value, out, gaussian_weights(sigma, truncate), keys)


def local_maximum(df: DataFrame, value: str, out: str, radius: int, keys: Sequence[str] = SCENE) -> DataFrame:
    """Maximum over a square of side max(3, 2 * radius + 1)."""
    d = max(1, int(radius))
    column = _line(keys, "c", "r").rowsBetween(-d, d)
    row = _line(keys, "r", "c").rowsBetween(-d, d)
    half = df.withColumn("_half", F.max(value).over(column))
    return half.withColumn(out, F.max("_half").over(row)).drop("_half")


def peaks(
    df: DataFrame,
    value: str,
    threshold: float,
    radius: int = 2,
    sigma: float = 1.0,
    keys: Sequence[str] = SCENE,
) -> DataFrame:
    """Non-maximum suppression on a dense table with ``valid``: cells equal to their local
    maximum after smoothing and at least ``threshold``.  Plateau ties all stay."""
    smooth = gaussian_smooth(df, value, "smoothed", sigma, keys)
    top = local_maximum(smooth, "smoothed", "_top", radius, keys)
    keep = (F.col("smoothed") == F.col("_top")) & (F.col("smoothed") >= threshold) & F.col("valid")
    return top.where(keep).drop("_top")


def shift_each(mask: DataFrame, offsets: Sequence[tuple[int, int]], grid: GridSpec | None = None) -> DataFrame:
    """Every true cell copied to each offset, clipped to the grid when one is given."""
    moves = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i, j in offsets])
    moved = (
        mask.withColumn("_o", F.explode(moves))
        .withColumns({"r": F.col("r") + F.col("_o.dr"), "c": F.col("c") + F.col("_o.dc")})
        .drop("_o")
    )
    if grid is None:
        return moved
    return moved.where(F.col("r").between(0, grid.h - 1) & F.col("c").between(0, grid.w - 1))


def dilate(
    mask: DataFrame, iterations: int, grid: GridSpec, keys: Sequence[str] = SCENE, side: int = 3
) -> DataFrame:
    """n rounds of a square structure equal one larger square: one generate, one distinct."""
    key = [*keys, "r", "c"]
    mask = mask.select(*key)
    reach = max(0, int(iterations)) * (side // 2)
    if reach == 0:
        return mask
    offsets = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    return shift_each(mask, offsets, grid).distinct()


def dilate_km(mask: DataFrame, radius_km: float, grid: GridSpec, keys: Sequence[str] = SCENE) -> DataFrame:
    """Dilation by a radius given in km."""
    return dilate(mask, gate_iterations(grid, radius_km), grid, keys)


def keep_valid(mask: DataFrame, valid: DataFrame) -> DataFrame:
    """Mask cells that are valid; ``valid`` is the dense (scene_id, r, c, valid) table."""
    ok = valid.where("valid").select("scene_id", "r", "c")
    return mask.join(ok, ["scene_id", "r", "c"], "left_semi")


def erode(mask: DataFrame, structure: Sequence[tuple[int, int]], keys: Sequence[str] = SCENE) -> DataFrame:
    """Cells whose whole structure lies in the mask; outside the grid counts as false."""
    key = [*keys, "r", "c"]
    votes = shift_each(mask.select(*key), [(-i, -j) for i, j in structure])
    full = votes.groupBy(*key).agg(F.count("*").alias("_votes")).where(F.col("_votes") == len(structure))
    return full.drop("_votes")


def opening(mask: DataFrame, grid: GridSpec, shape: str = "cross", keys: Sequence[str] = SCENE) -> DataFrame:
    """Erosion then dilation.  Repeating an opening changes nothing, so there is no count."""
    structure = CROSS if shape == "cross" else BOX
    return shift_each(erode(mask, structure, keys), structure, grid).distinct()
