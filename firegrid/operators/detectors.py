"""Single-pass detectors: spatial residual, combined persistence, event detector, mask algebra."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions import stats
from firegrid.operators import components as C
from firegrid.operators import grid as G
from firegrid.operators import neighborhood as N
from firegrid.operators.twin import hourly_anomaly_score
from firegrid.schema import LAYER, SCENE, GridSpec

KEY = ("scene_id", "r", "c")


# ---------------------------------------------------------------- spatial residual


def residual_field(day: DataFrame, grid: GridSpec, median_size: int = 9) -> DataFrame:
    """Adds ``filled``, ``background`` and ``residual`` of channel 13, and ``seen13``."""
    filled = day.withColumns(
        {
            "filled": F.col("bt13"),
            "seen13": F.col("bt13").isNotNull() & (F.col("bt13") > 0),
        }
    )
    filled = G.fill_with_median(filled, ["filled"], SCENE, grid.cells)
    k = N.odd_size(median_size)
    return (
        N.median_backgrounds(filled, "filled", [k], grid, SCENE, "_m")
        .withColumnRenamed(f"_m{k}", "background")
        .withColumn("residual", F.col("filled") - F.col("background"))
    )


def residual_mask(field: DataFrame, contamination: float, grid: GridSpec) -> DataFrame:
    return stats.percentile_mask(
        field, F.col("residual"), F.col("seen13"), stats.pct(contamination), SCENE, grid.cells
    )


def spatial_residual(
    day: DataFrame, grid: GridSpec, contamination: float = 0.02, median_size: int = 9
) -> DataFrame:
    """Residual against the local median at or above its scene percentile."""
    return residual_mask(residual_field(day, grid, median_size), contamination, grid).select(*KEY)


def with_spectral_cut(field: DataFrame, grid: GridSpec, dbt_percentile: float = 85.0) -> DataFrame:
    """Adds ``spectral_ok``: bt7 - bt14 at or above its scene percentile; true for a whole scene
    without any cell holding all three channels."""
    dbt = F.when(F.col("bt13").isNotNull(), F.col("bt7") - F.col("bt14"))
    cut = stats.with_quantiles(field, SCENE, {"_dthr": (dbt, dbt_percentile / 100.0)}, grid.cells)
    ok = F.when(F.col("_dthr").isNull(), F.lit(True)).otherwise(F.coalesce(dbt >= F.col("_dthr"), F.lit(False)))
    return cut.withColumn("spectral_ok", ok).drop("_dthr")


def spatial_residual_multiband(
    day: DataFrame,
    grid: GridSpec,
    contamination: float = 0.02,
    median_size: int = 9,
    dbt_percentile: float = 85.0,
) -> DataFrame:
    """The residual mask narrowed by the spectral difference when bands 7 and 14 are there."""
    field = residual_field(day, grid, median_size)
    if not {"bt7", "bt14"} <= set(day.columns):
        return residual_mask(field, contamination, grid).select(*KEY)
    hot = residual_mask(with_spectral_cut(field, grid, dbt_percentile), contamination, grid)
    return hot.where("spectral_ok").select(*KEY)


# ---------------------------------------------------------------- combined persistence


@dataclass(frozen=True)
class PersistenceConfig:
    median_sizes: tuple[int, ...] = (5, 9, 15)
    dbt_weight: float = 0.55
    hour_percentile: float = 88.0
    hour_percentiles: tuple[float, ...] | None = None
    adaptive: bool = True
    adaptive_span: float = 7.5
    adaptive_clip: tuple[float, float] = (79.0, 93.0)
    weights: tuple[float, float, float] = (0.42, 0.21, 0.37)
    min_persist: float | None = None
    persist_scale: float = 0.56
    persist_floor: float = 0.16
    min_active_hours: int = -1
    norm: tuple[float, float] = (6.0, 94.0)
    box_opening: int = 0
    opening_from_cells: int = 260
    opening_rounds: int = 1
    opening_shape: str = "cross"
    min_component: int = 3


def precision_preset() -> PersistenceConfig:
    """Stricter limits and more weight on persistence."""
    return PersistenceConfig(
        hour_percentile=91.0,
        adaptive_clip=(83.0, 94.0),
        adaptive_span=8.5,
        weights=(0.39, 0.17, 0.44),
        persist_floor=0.26,
        persist_scale=0.68,
        opening_from_cells=85,
        opening_rounds=2,
        min_component=5,
        norm=(7.0, 93.0),
    )


def with_hour_threshold(
    scored: DataFrame, cfg: PersistenceConfig, grid: GridSpec, out: str = "hour_threshold"
) -> DataFrame:
    """Score threshold of each hour over its usable cells (``usable`` column).

    In adaptive mode a flat hour (small p90 - p10) gets a higher percentile, when it has at
    least 64 usable cells.
    """
    base: Column = F.lit(cfg.hour_percentile)
    if cfg.hour_percentiles is not None:
        base = F.element_at(F.array(*[F.lit(p) for p in cfg.hour_percentiles]), F.col("hour_seq") + 1)
    level = base
    pool = F.when(F.col("usable"), F.col("score"))
    if cfg.adaptive:
        scored = stats.with_quantiles(scored, LAYER, {"_p10": (pool, 0.10), "_p90": (pool, 0.90)}, grid.cells)
        count = F.count(pool).over(Window.partitionBy(*LAYER))
        slack = F.greatest(F.lit(0.0), (0.12 - (F.col("_p90") - F.col("_p10"))) / (0.12 + 1e-6))
        lifted = stats.clip(base + cfg.adaptive_span * slack, *cfg.adaptive_clip)
        level = F.when(count >= 64, lifted).otherwise(base)
    marked = stats.with_varying_quantile(
        scored, LAYER, F.col("score"), F.col("usable"), level / 100.0, out, grid.cells
    )
    return marked.drop("_p10", "_p90")


def required_hours(hours: int, setting: int) -> int | None:
    """Active hours a cell needs: off for one hour or setting 0; negative is automatic."""
    if hours < 2 or setting == 0:
        return None
    if setting < 0:
        return 2 if hours >= 3 else 1
    return min(setting, hours)


def persistence_field(
    cube: DataFrame, grid: GridSpec, hours: int, cfg: PersistenceConfig = PersistenceConfig()
) -> DataFrame:
    """Dense per-cell table with ``combined`` score, ``persist``, active hour count and
    ``eligible`` (valid cell observed at least once)."""
    if cfg.hour_percentiles is not None and len(cfg.hour_percentiles) != hours:
        raise ValueError("hour_percentiles must have one value per hour")
    scored = hourly_anomaly_score(G.with_valid(cube), grid, cfg.median_sizes, cfg.dbt_weight)
    scored = scored.withColumn("usable", F.col("score_valid") & F.col("valid"))
    scored = with_hour_threshold(scored, cfg, grid)
    active = F.col("usable") & (F.col("score") >= F.col("hour_threshold"))
    cells = scored.groupBy(*KEY).agg(
        F.count_if(active).cast("double").alias("active_hours"),
        F.count_if(F.col("usable")).cast("double").alias("usable_hours"),
        F.max("score").alias("peak"),
        F.avg("score").alias("mean"),
        F.bool_and("valid").alias("valid"),
    )
    cells = cells.withColumns(
        {
            "persist": F.col("active_hours") / F.greatest(F.col("usable_hours"), F.lit(1e-9)),
            "eligible": F.col("valid") & (F.col("usable_hours") >= 1),
        }
    )
    lo, hi = cfg.norm[0] / 100.0, cfg.norm[1] / 100.0
    ok = F.col("eligible")
    cells = stats.with_robust_units(
        cells, SCENE, {"_peak": (F.col("peak"), ok, lo, hi), "_mean": (F.col("mean"), ok, lo, hi)}, grid.cells
    )
    wp, wm, wr = (w / sum(cfg.weights) for w in cfg.weights)
    return cells.withColumn(
        "combined", wp * F.col("_peak") + wm * F.col("_mean") + wr * F.col("persist")
    ).drop("_peak", "_mean")


def persistence_candidates(
    field: DataFrame, contamination: float, grid: GridSpec, hours: int, cfg: PersistenceConfig = PersistenceConfig()
) -> DataFrame:
    """Cells past the score threshold and both persistence gates, before any morphology."""
    hot = stats.with_quantiles(
        field, SCENE,
        {
            "_thr": (F.when(F.col("eligible"), F.col("combined")), stats.clamped_pct(contamination)),
            "_seen": (F.when(F.col("eligible"), F.col("usable_hours")), 0.5),
        },
        grid.cells,
    ).where(F.col("eligible") & (F.col("combined") >= F.col("_thr")))
    seen = F.greatest(F.lit(1.0), F.col("_seen"))
    if cfg.min_persist is not None:
        gate: Column = F.lit(cfg.min_persist)
    else:
        gate = F.greatest(F.lit(cfg.persist_floor), F.lit(cfg.persist_scale) / seen)
    hot = hot.where((seen < 2) | (F.col("persist") >= gate))
    need = required_hours(hours, cfg.min_active_hours)
    if need is not None:
        hot = hot.where(F.col("active_hours") >= need)
    return hot.select(*KEY)


def persistence_cleanup(
    mask: DataFrame, grid: GridSpec, cfg: PersistenceConfig = PersistenceConfig(), keys: Sequence[str] = SCENE
) -> DataFrame:
    """Opening of crowded scenes, removal of small components, optional box opening."""
    if cfg.opening_from_cells > 0 and cfg.opening_rounds > 0:
        sized = mask.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
        crowded = F.col("_n") >= cfg.opening_from_cells
        opened = N.opening(sized.where(crowded), grid, cfg.opening_shape, keys)
        mask = sized.where(~crowded).drop("_n").unionByName(opened)
    mask = C.filter_by_size(mask, grid, cfg.min_component, 0, 1, keys)
    if cfg.box_opening > 0:
        mask = N.opening(mask, grid, "box", keys)
    return mask


def combined_persistence(
    cube: DataFrame,
    contamination: float,
    grid: GridSpec,
    hours: int,
    cfg: PersistenceConfig = PersistenceConfig(),
    **overrides,
) -> DataFrame:
    """Temporal peak, mean and persistence combined, thresholded, gated and cleaned.

    The opening and the component filter only remove cells, so the result stays inside the
    valid cells of the candidates.
    """
    cfg = replace(cfg, **overrides)
    field = persistence_field(cube, grid, hours, cfg)
    return persistence_cleanup(persistence_candidates(field, contamination, grid, hours, cfg), grid, cfg)


# ---------------------------------------------------------------- event detector


@dataclass(frozen=True)
class EventConfig:
    median_sizes: tuple[int, ...] = (3, 5, 7)
    btd_low: float = 35.0
    btd_high: float = 90.0
    glint: float = 99.2
    min_active_hours: int = 2
    risk_percentile: float = 98.0
    opening_rounds: int = 0
    min_component: int = 1
    max_component: int = 200
    norm: tuple[float, float] = (5.0, 95.0)
    weight_anomaly: float = 0.55
    weight_band: float = 0.20
    weight_persistence: float = 0.25


def fine_anomaly(layers: DataFrame, grid: GridSpec, sizes: Sequence[int] = (3, 5, 7)) -> DataFrame:
    """Adds ``anomaly``: mean of robust positive residuals at small scales, over ``seen`` cells."""
    odd = sorted({N.odd_size(k) for k in sizes})
    pooled = stats.with_quantiles(
        layers, LAYER, {"_med": (F.when(F.col("seen"), F.col("bt13")), 0.5)}, grid.cells
    )
    filled = pooled.withColumn(
        "_f", F.when(F.col("seen"), F.col("bt13")).otherwise(F.coalesce("_med", F.lit(0.0)))
    ).drop("_med")
    local = N.median_backgrounds(filled, "_f", odd, grid, LAYER, "_m")
    units = {
        f"_u{k}": (F.greatest(F.lit(0.0), F.col("_f") - F.col(f"_m{k}")), F.col("seen"), 0.04, 0.96)
        for k in odd
    }
    scaled = stats.with_robust_units(local, LAYER, units, grid.cells)
    scales = [F.col(f"_u{N.odd_size(k)}") for k in sizes]
    mean = sum(scales[1:], scales[0]) / float(len(scales))
    return scaled.withColumn("anomaly", mean).select(*layers.columns, "anomaly")


def band_score(layers: DataFrame, grid: GridSpec, low: float = 35.0, high: float = 90.0) -> DataFrame:
    """Adds ``band`` (triangular score of bt7 - bt14 between two percentiles) and ``in_band``."""
    btd = F.col("bt7") - F.col("bt14")
    pool = F.when(F.col("seen"), btd)
    ranked = stats.with_quantiles(
        layers, LAYER, {"_lo": (pool, low / 100.0), "_hi": (pool, high / 100.0)}, grid.cells
    )
    inside, score = band_between(pool, F.col("_lo"), F.col("_hi"))
    return ranked.withColumns({"in_band": inside, "band": score}).drop("_lo", "_hi")


def band_between(btd: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Whether a difference lies between two limits, and its triangular score there (0 outside)."""
    width = F.greatest(high - low, F.lit(1e-6))
    inside = F.coalesce(btd.between(low, high), F.lit(False))
    score = 1.0 - 2.0 * F.abs(btd - 0.5 * (low + high)) / width
    return inside, F.when(inside, stats.clip(score)).otherwise(F.lit(0.0))


def glint_flag(layers: DataFrame, grid: GridSpec, percentile: float = 99.2) -> DataFrame:
    """Adds ``glint``: channel 7 at or above an extreme percentile of the layer."""
    pool = F.when(F.col("seen"), F.col("bt7"))
    ranked = stats.with_quantiles(layers, LAYER, {"_g": (pool, percentile / 100.0)}, grid.cells)
    return ranked.withColumn("glint", F.coalesce(pool >= F.col("_g"), F.lit(False))).drop("_g")


def event_layers(cube: DataFrame, grid: GridSpec, cfg: EventConfig = EventConfig()) -> DataFrame:
    """Hourly anomaly, band score and glint flag.  Without bands 7 and 14 every seen cell counts
    as in band and nothing as glint."""
    layers = G.with_valid(cube, [ch for ch in (7, 13, 14) if f"bt{ch}" in cube.columns])
    layers = layers.withColumn("seen", F.col("bt13").isNotNull() & F.col("valid"))
    layers = fine_anomaly(layers, grid, cfg.median_sizes)
    if not {"bt7", "bt14"} <= set(cube.columns):
        return layers.withColumns({"band": F.lit(0.0), "in_band": F.col("seen"), "glint": F.lit(False)})
    return glint_flag(band_score(layers, grid, cfg.btd_low, cfg.btd_high), grid, cfg.glint)


def event_signals(
    layers: DataFrame, grid: GridSpec, norm: tuple[float, float] = (5.0, 95.0), settings: Sequence[str] = ()
) -> DataFrame:
    """Per cell: scaled anomaly and band score averaged over active hours, active hour count, and
    ``alive`` (in band at least once, not glint throughout); apart for each of the ``settings`` columns."""
    active = (F.col("anomaly") > 0.05) & F.col("in_band") & ~F.col("glint")
    cells = layers.groupBy(*KEY, *settings).agg(
        F.count_if(active).alias("active_hours"),
        F.coalesce(F.avg(F.when(active, F.col("anomaly"))), F.lit(0.0)).alias("_a"),
        F.coalesce(F.avg(F.when(active, F.col("band"))), F.lit(0.0)).alias("_b"),
        (F.bool_or("in_band") & ~F.bool_and("glint")).alias("alive"),
        F.bool_and("valid").alias("valid"),
    )
    lo, hi = norm[0] / 100.0, norm[1] / 100.0
    units = {
        "anomaly_n": (F.col("_a"), F.col("valid"), lo, hi),
        "band_n": (F.col("_b"), F.col("valid"), lo, hi),
    }
    return stats.with_robust_units(cells, [*SCENE, *settings], units, grid.cells).drop("_a", "_b")


def weighted_risk(
    hours: int, anomaly: Column, band: Column, persistence: Column, min_hours: Column
) -> Column:
    """Weighted mean of the three signals; 0 for cells never alive or active too few hours."""
    total = F.greatest(anomaly + band + persistence, F.lit(1e-9))
    risk = (
        anomaly * F.col("anomaly_n")
        + band * F.col("band_n")
        + persistence * (F.col("active_hours") / float(hours))
    ) / total
    gated = (min_hours > 1) & (min_hours <= hours)
    enough = ~gated | (F.col("active_hours") >= min_hours)
    return F.when(F.col("alive") & enough, risk).otherwise(F.lit(0.0))


def event_risk(layers: DataFrame, grid: GridSpec, hours: int, cfg: EventConfig = EventConfig()) -> DataFrame:
    """Dense (scene_id, r, c, risk, valid, active_hours)."""
    weights = (F.lit(w) for w in (cfg.weight_anomaly, cfg.weight_band, cfg.weight_persistence))
    risk = weighted_risk(hours, *weights, F.lit(cfg.min_active_hours))
    return event_signals(layers, grid, cfg.norm).select(*KEY, risk.alias("risk"), "valid", "active_hours")


def event_candidates(risk: DataFrame, grid: GridSpec, cfg: EventConfig = EventConfig()) -> DataFrame:
    """Valid cells at or above the percentile of positive risk; none with fewer than 32 such cells."""
    pool = F.when(F.col("valid") & (F.col("risk") > 0), F.col("risk"))
    ranked = stats.with_quantiles(risk, SCENE, {"_thr": (pool, cfg.risk_percentile / 100.0)}, grid.cells)
    ranked = ranked.withColumn("_n", F.count(pool).over(Window.partitionBy(*SCENE)))
    keep = (F.col("_n") >= 32) & F.col("valid") & (F.col("risk") >= F.col("_thr"))
    return ranked.where(keep).select(*KEY)


def event_detector(
    cube: DataFrame, grid: GridSpec, hours: int, cfg: EventConfig = EventConfig()
) -> DataFrame:
    """Fine anomaly inside a spectral band, persistent, not glint, component-size limited."""
    mask = event_candidates(event_risk(event_layers(cube, grid, cfg), grid, hours, cfg), grid, cfg)
    if cfg.opening_rounds > 0:
        mask = N.opening(mask, grid, "cross")
    return C.filter_by_size(mask, grid, cfg.min_component, cfg.max_component)


# ---------------------------------------------------------------- mask algebra


def intersect_masks(*masks: DataFrame) -> DataFrame:
    if not masks:
        raise ValueError("at least one mask is needed")
    return reduce(DataFrame.intersect, [m.select(*KEY) for m in masks]).distinct()


def unite_masks(*masks: DataFrame) -> DataFrame:
    if not masks:
        raise ValueError("at least one mask is needed")
    return reduce(DataFrame.unionByName, [m.select(*KEY) for m in masks]).distinct()
