"""Day products: classifier peaks, precision mask, sensor fusion, and their map layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from firegrid.operators import evaluate as E
from firegrid.operators import features as M
from firegrid.operators import fusion as X
from firegrid.operators import grid as G
from firegrid.operators import learning as L
from firegrid.operators import neighborhood as N
from firegrid.operators import outliers as O
from firegrid.schema import GridSpec
from firegrid.session import cut


@dataclass(frozen=True)
class DayProducts:
    prob: DataFrame
    peaks: DataFrame
    precise: DataFrame
    fused: DataFrame


def labelled_features(cube: DataFrame, hotspots: DataFrame, grid: GridSpec, dilation: int = 1) -> DataFrame:
    """Features of every scene with the dilated truth as label."""
    truth = N.dilate(G.presence_mask(hotspots, grid), dilation, grid)
    return M.with_label(M.build_features(cube, grid), truth)


def day_products(
    cube: DataFrame,
    hotspots: DataFrame,
    detections: DataFrame,
    grid: GridSpec,
    cfg: L.ClassifierConfig = L.multiday_config(),
    threshold: float = 0.7258,
    growth: int = 2,
    outliers: O.OutlierConfig = O.OutlierConfig(method="local_outlier_factor", contamination=0.12),
    fusion: X.FusionConfig = X.FusionConfig(mode="weighted", gate_km=3.0),
) -> DayProducts:
    """The three masks of the map run: grown peaks, peaks that are outliers, peaks fused with the
    second sensor."""
    table = cut(labelled_features(cube, hotspots, grid))
    fitted = L.fit_classifier(table, cfg)
    prob = cut(L.predict_probability(fitted, table))
    found = cut(L.grown_peaks(prob, grid, threshold, 1, 1.2, growth))
    precise = O.keep_outliers(found, table, outliers, grid.cells)
    fused = X.fused_mask(X.fuse(found, detections, prob, grid, fusion))
    return DayProducts(prob, found, precise, fused)


def score_products(products: DayProducts, hotspots: DataFrame, grid: GridSpec, radius_km: float = 10.0) -> dict[str, DataFrame]:
    scenes = products.prob.select("scene_id").distinct()
    return {
        name: E.event_metrics(mask, hotspots, grid, radius_km, scenes=scenes)
        for name, mask in (("peaks", products.peaks), ("precise", products.precise), ("fused", products.fused))
    }
