"""Evaluation of several detectors over many days, calibration and comparison sweeps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions import stats
from firegrid.operators import detectors as D
from firegrid.operators import evaluate as E
from firegrid.operators import forests as R
from firegrid.operators import grid as G
from firegrid.operators import neighborhood as N
from firegrid.operators import twin as T
from firegrid.schema import SCENE, GridSpec
from firegrid.session import cut, store

KEY = ("scene_id", "r", "c")
METHODS = ("spatial_residual", "isolation_forest", "digital_twin", "combined_persistence")
GROUPS = {"both": METHODS[:2], "all": METHODS}


@dataclass(frozen=True)
class RunConfig:
    """Defaults of a batch evaluation."""

    hours: tuple[int, ...] = (16, 17, 18)
    contamination: float = 0.02
    truth_dilation: int = 1
    method: str = "all"
    beta: float = 1.0
    twin: T.TwinConfig = field(default_factory=T.TwinConfig)
    persistence: D.PersistenceConfig = field(default_factory=D.PersistenceConfig)

    def methods(self) -> tuple[str, ...]:
        return GROUPS.get(self.method, (self.method,))


def method_mask(
    name: str, cube: DataFrame, day: DataFrame, grid: GridSpec, contamination: float, cfg: RunConfig
) -> DataFrame:
    if name == "spatial_residual":
        return D.spatial_residual_multiband(day, grid, contamination)
    if name == "isolation_forest":
        return R.forest_mask(day, grid, contamination)
    if name == "digital_twin":
        return T.risk_mask(cube, contamination, grid, cfg.twin)
    if name == "combined_persistence":
        return D.combined_persistence(cube, contamination, grid, len(cfg.hours), cfg.persistence)
    raise ValueError(f"unknown method: {name}")


def tagged_confusion(
    masks: DataFrame, tags: Sequence[str], cells: DataFrame, every: DataFrame
) -> DataFrame:
    """Confusion per (scene, tags) of many sparse masks at once.

    ``masks`` has scene_id, r, c and the tag columns; ``cells`` is the dense (valid, truth)
    table; ``every`` lists the (scene, tags) rows wanted, so an empty mask still gets a row.
    Predicted cells are counted from the sparse masks; the rest follows from scene totals.
    """
    tags = list(tags)
    v, t = F.col("valid"), F.col("truth")
    scene = cells.groupBy("scene_id").agg(
        F.count_if(v).alias("valid_cells"), F.count_if(v & t).alias("truth_cells")
    )
    marks = cells.where("valid").select(*KEY, "truth")
    hits = masks.join(marks, list(KEY)).groupBy("scene_id", *tags).agg(
        F.count_if("truth").alias("tp"), F.count_if(~t).alias("fp")
    )
    zero = F.lit(0).cast("bigint")
    rows = every.join(scene, "scene_id").join(hits, ["scene_id", *tags], "left").withColumns(
        {"tp": F.coalesce("tp", zero), "fp": F.coalesce("fp", zero)}
    )
    rows = rows.withColumns(
        {
            "fn": F.col("truth_cells") - F.col("tp"),
            "tn": F.col("valid_cells") - F.col("truth_cells") - F.col("fp"),
            "pred_cells": F.col("tp") + F.col("fp"),
        }
    )
    return E.with_rates(rows)


def truth_cells(hotspots: DataFrame, day: DataFrame, grid: GridSpec, dilation: int) -> DataFrame:
    """Dense (scene_id, r, c, valid, truth_raw, truth)."""
    raw = G.presence_mask(hotspots, grid)
    flagged = E.with_flag(day.select(*KEY, "valid"), raw, "truth_raw")
    return E.with_flag(flagged, N.dilate(raw, dilation, grid), "truth")


def evaluate_days(cube: DataFrame, hotspots: DataFrame, grid: GridSpec, cfg: RunConfig = RunConfig()) -> DataFrame:
    """One metric row per (scene, method) for every scene of the cube."""
    cube = cut(cube)
    day = cut(N.settle(G.day_cells(cube), grid))
    truth = truth_cells(hotspots, day, grid, cfg.truth_dilation)
    names = cfg.methods()
    masks = reduce(
        DataFrame.unionByName,
        [
            method_mask(n, cube, day, grid, cfg.contamination, cfg).select(*KEY, F.lit(n).alias("method"))
            for n in names
        ],
    )
    scenes = day.select("scene_id").distinct()
    every = scenes.withColumn("method", F.explode(F.array(*[F.lit(n) for n in names])))
    spots = hotspots.groupBy("scene_id").agg(F.count("*").alias("n_hotspots"))
    raw = truth.groupBy("scene_id").agg(F.count_if(F.col("valid") & F.col("truth_raw")).alias("truth_cells_raw"))
    rows = tagged_confusion(masks, ["method"], truth, every).join(raw, "scene_id").join(spots, "scene_id", "left")
    rows = rows.withColumn("n_hotspots", F.coalesce("n_hotspots", F.lit(0).cast("bigint")))
    return E.with_f_beta(rows, max(cfg.beta, 1e-6)).withColumn("contamination", F.lit(cfg.contamination))


# ---------------------------------------------------------------- calibration


def contamination_steps(n: int = 32, lo: float = 0.004, hi: float = 0.18) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n - 1)] + [hi]


def _step_levels(scored: DataFrame, value: Column, q: Sequence[float], rows: int) -> DataFrame:
    """Adds ``_t``: the scene's quantiles at every step."""
    if rows <= stats.WINDOW_ROWS:
        levels = F.percentile(value, F.array(*[F.lit(x) for x in q])).over(Window.partitionBy(*SCENE))
        return scored.withColumn("_t", levels)
    names = {f"_q{i}": (value, x) for i, x in enumerate(q)}
    return stats.with_quantiles(scored, SCENE, names, rows).withColumn("_t", F.array(*names)).drop(*names)


def _steps_where(test) -> Column:
    """Steps whose level passes ``test``, one row each."""
    indexed = F.transform("_t", lambda t, i: F.struct(i.alias("step"), t.alias("t")))
    return F.explode(F.transform(F.filter(indexed, lambda s: test(s["t"])), lambda s: s["step"]))


def _masks_at(
    scored: DataFrame, score: Column, pool: Column, steps: Sequence[float], clamp: bool, rows: int,
    extra: Column | None = None,
) -> DataFrame:
    """Masks of every step from one scoring pass: (scene_id, r, c, step), ``score >= percentile``."""
    q = [stats.clamped_pct(c) if clamp else stats.pct(c) for c in steps]
    hot = _step_levels(scored, F.when(pool, score), q, rows).where(pool if extra is None else pool & extra)
    return hot.select(*KEY, _steps_where(lambda t: score >= t).alias("step"))


def step_masks(
    name: str, cube: DataFrame, day: DataFrame, grid: GridSpec, steps: Sequence[float], cfg: RunConfig = RunConfig()
) -> DataFrame:
    """Masks of one method at every contamination step, scored once."""
    if name == "spatial_residual":
        field_ = D.with_spectral_cut(D.residual_field(day, grid), grid)
        return _masks_at(field_, F.col("residual"), F.col("seen13"), steps, False, grid.cells, F.col("spectral_ok"))
    if name == "isolation_forest":
        # Strictly beyond the percentile of the negated score, as in the single-step detector.
        rated = R.forest_scores(day, grid)
        q = [min(max(c, 0.001), 0.5) for c in steps]
        leveled = _step_levels(rated, -F.col("iso_score"), q, grid.cells)
        return leveled.select(*KEY, _steps_where(lambda t: -F.col("iso_score") < t).alias("step"))
    if name == "digital_twin":
        field_ = cut(T.risk_field(cube, grid, cfg.twin))
        if cfg.twin.threshold_mode == "gmm2":
            parts = [
                T.mixture_mask(field_, c, grid).withColumn("step", F.lit(i)) for i, c in enumerate(steps)
            ]
            masks = reduce(DataFrame.unionByName, parts)
        else:
            masks = _masks_at(field_, F.col("smoothed"), F.col("valid"), steps, True, grid.cells)
        weak = field_.where("valid").select(*KEY)
        kept = T.drop_weak_inliers(field_, weak, grid, cfg.twin.lof_neighbors)
        return masks.join(kept, list(KEY), "left_semi")
    if name == "combined_persistence":
        hours = len(cfg.hours)
        field_ = cut(D.persistence_field(cube, grid, hours, cfg.persistence))
        scored = _masks_at(field_, F.col("combined"), F.col("eligible"), steps, True, grid.cells)
        # Both gates ignore the threshold, and a looser threshold only adds cells: the loosest
        # candidates tell which cells pass the gates at every step.
        passing = D.persistence_candidates(field_, 0.5, grid, hours, cfg.persistence)
        gated = scored.join(passing, list(KEY), "left_semi")
        return D.persistence_cleanup(gated, grid, cfg.persistence, ("scene_id", "step"))
    raise ValueError(f"unknown method: {name}")


def calibrate(
    name: str, cube: DataFrame, hotspots: DataFrame, grid: GridSpec, cfg: RunConfig = RunConfig(), n_steps: int = 32
) -> DataFrame:
    """Best contamination per scene by F-beta; ties by precision, IoU, hits, fewer false alarms and
    a sparser mask, then the first step."""
    steps = contamination_steps(n_steps)
    cube = cut(cube)
    day = cut(N.settle(G.day_cells(cube), grid))
    truth = truth_cells(hotspots, day, grid, cfg.truth_dilation)
    masks = store(step_masks(name, cube, day, grid, steps, cfg))
    every = day.select("scene_id").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))))
    rows = E.with_f_beta(tagged_confusion(masks, ["step"], truth, every), max(cfg.beta, 1e-6))
    sparse = masks.groupBy("scene_id", "step").agg(F.count("*").alias("mask_cells"))
    rows = rows.join(sparse, ["scene_id", "step"], "left").withColumns(
        {
            "mask_cells": F.coalesce("mask_cells", F.lit(0).cast("bigint")),
            "contamination": F.element_at(F.array(*[F.lit(c) for c in steps]), F.col("step") + 1),
        }
    )
    order = [F.round(c, 12).desc() for c in ("f_beta", "precision", "iou")]
    order += [F.col("tp").desc(), F.col("fp").asc(), F.col("mask_cells").asc(), F.col("step").asc()]
    best = F.row_number().over(Window.partitionBy("scene_id").orderBy(*order))
    return rows.withColumn("_rn", best).where(F.col("_rn") == 1).drop("_rn", "truth_cells", "pred_cells")


# ---------------------------------------------------------------- comparison matrix


def comparison_matrix(
    cube: DataFrame,
    hotspots: DataFrame,
    grid: GridSpec,
    contaminations: Sequence[float] = (0.01, 0.02, 0.04, 0.06),
    radii: Sequence[float] = (1.5, 3.0, 5.0, 8.0),
    methods: Sequence[str] = METHODS,
    cfg: RunConfig = RunConfig(),
) -> DataFrame:
    """Detector x contamination x radius: event metrics next to cell metrics."""
    cube = cut(cube)
    day = cut(N.settle(G.day_cells(cube), grid))
    truth = truth_cells(hotspots, day, grid, cfg.truth_dilation)
    masks = store(
        reduce(
            DataFrame.unionByName,
            [
                step_masks(m, cube, day, grid, contaminations, cfg).select(
                    *KEY, F.lit(m).alias("method"), "step"
                )
                for m in methods
            ],
        )
    )
    every = (
        day.select("scene_id").distinct()
        .withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(contaminations) - 1))))
    )
    keys = ["scene_id", "method", "step"]
    curve = E.event_curve(masks, hotspots, grid, radii, valid=day, scenes=every, keys=keys)
    grid_rows = tagged_confusion(masks, ["method", "step"], truth, every).select(
        *keys, F.col("f1").alias("grid_f1"), F.col("precision").alias("grid_precision"),
        F.col("recall").alias("grid_recall"), "pred_cells",
    )
    level = F.element_at(F.array(*[F.lit(c) for c in contaminations]), F.col("step") + 1)
    return curve.join(grid_rows, keys).withColumn("contamination", level).drop("step")
