"""Isolation-forest detectors on brightness and residual columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.operators import grid as G
from firegrid.operators import neighborhood as N
from firegrid.operators.detectors import KEY, residual_field
from firegrid.operators.outliers import above_share, isolation_scores
from firegrid.schema import SCENE, GridSpec

ONE_BAND = ("filled", "background", "residual")
MULTI_BAND = ("filled", "background", "residual", "dbt", "filled14", "residual14")


def one_band_scores(field: DataFrame, grid: GridSpec, trees: int = 200, seed: int = 42) -> DataFrame:
    """``iso_score`` of seen cells from (bt13, background, residual); none below 50 seen cells."""
    return _scores(field, ONE_BAND, 50, trees, seed, grid)


def _scores(field: DataFrame, columns: Sequence[str], least: int, trees: int, seed: int, grid: GridSpec) -> DataFrame:
    seen = field.where("seen13").withColumn("_n", F.count("*").over(Window.partitionBy(*SCENE)))
    pool = seen.where(F.col("_n") >= least).select(*KEY, *columns)
    return isolation_scores(pool, columns, trees, seed).select(*KEY, "iso_score")


def multiband_field(day: DataFrame, grid: GridSpec, median_size: int = 9) -> DataFrame:
    """Residual field extended by channel 14 and the spectral difference, and ``multi``: whether
    the scene has both extra bands and at least 80 seen cells."""
    k = N.odd_size(median_size)
    field = residual_field(day, grid, median_size)
    scene = Window.partitionBy(*SCENE)
    multi = (
        (F.count("bt7").over(scene) > 0)
        & (F.count("bt14").over(scene) > 0)
        & (F.count(F.when(F.col("seen13"), 1)).over(scene) >= 80)
    )
    field = field.withColumns({"multi": multi, "filled7": F.col("bt7"), "filled14": F.col("bt14")})
    field = G.fill_with_median(field, ["filled7", "filled14"], SCENE, grid.cells)
    field = N.median_backgrounds(field, "filled14", [k], grid, SCENE, "_m")
    return field.withColumns(
        {
            "residual14": F.col("filled14") - F.col(f"_m{k}"),
            "dbt": F.col("filled7") - F.col("filled14"),
        }
    ).drop(f"_m{k}")


def forest_scores(day: DataFrame, grid: GridSpec, median_size: int = 9, seed: int = 42) -> DataFrame:
    """Scores of the multi-band forest (280 trees), or the one-band forest (200 trees) for scenes
    lacking a band or with fewer than 80 seen cells."""
    if not {"bt7", "bt14"} <= set(day.columns):
        return one_band_scores(residual_field(day, grid, median_size), grid, 200, seed)
    field = multiband_field(day, grid, median_size)
    wide = _scores(field.where("multi"), MULTI_BAND, 80, 280, seed, grid)
    narrow = one_band_scores(field.where("NOT multi"), grid, 200, seed)
    return wide.unionByName(narrow)


def forest_mask(
    day: DataFrame, grid: GridSpec, contamination: float = 0.02, median_size: int = 9, seed: int = 42
) -> DataFrame:
    return above_share(forest_scores(day, grid, median_size, seed), "iso_score", contamination, grid.cells)


def one_band_mask(
    day: DataFrame, grid: GridSpec, contamination: float = 0.02, median_size: int = 9, seed: int = 42
) -> DataFrame:
    scores = one_band_scores(residual_field(day, grid, median_size), grid, 200, seed)
    return above_share(scores, "iso_score", contamination, grid.cells)
