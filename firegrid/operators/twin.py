"""Hourly anomaly score, risk assimilation over hours and the risk mask."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions import stats
from firegrid.operators import grid as G
from firegrid.operators import neighborhood as N
from firegrid.operators.outliers import local_outlier_factor
from firegrid.schema import LAYER, SCENE, GridSpec
from firegrid.session import cut, store


@dataclass(frozen=True)
class TwinConfig:
    """Defaults of the risk-state detector."""

    persistence: float = 0.5
    median_size: int = 9
    median_sizes: tuple[int, ...] = (5, 9, 15)
    sigma: float = 1.2
    dbt_weight: float = 0.55
    fusion: str = "prob_or"
    threshold_mode: str = "percentile"
    lof_neighbors: int = 24

    def sizes(self) -> tuple[int, ...]:
        return self.median_sizes or (max(3, self.median_size | 1),)


def hourly_anomaly_score(
    cube: DataFrame,
    grid: GridSpec,
    median_sizes: Sequence[int] = (5, 9, 15),
    dbt_weight: float = 0.55,
) -> DataFrame:
    """Adds ``score`` in 0..1 and ``score_valid`` to every row of a dense cube.

    Multi-scale positive residual of channel 13 against local medians, blended with the
    positive part of bt7 - bt14 above its 55th percentile where all three channels exist.
    """
    layer = Window.partitionBy(*LAYER)
    sizes = sorted({N.odd_size(k) for k in median_sizes})
    both = (F.count("bt7").over(layer) > 0) & (F.count("bt14").over(layer) > 0)
    seen13 = F.col("bt13").isNotNull() & (F.col("bt13") > 0)
    dbt = F.col("bt7") - F.col("bt14")
    marked = cube.withColumns({"_v13": seen13, "_both": both}).withColumn(
        "_vbtd", F.col("_both") & F.col("_v13") & dbt.isNotNull()
    )
    marked = stats.with_quantiles(
        marked, LAYER,
        {"_med": (F.col("bt13"), 0.5), "_base": (F.when(F.col("_vbtd"), dbt), 0.55)},
        grid.cells,
    )
    filled = marked.withColumns(
        {
            "_f13": F.coalesce("bt13", "_med"),
            "_dpos": F.greatest(F.lit(0.0), dbt - F.coalesce("_base", F.lit(0.0))),
        }
    ).drop("_med", "_base")
    local = N.median_backgrounds(filled, "_f13", sizes, grid, LAYER, "_m")
    units = {
        f"_u{k}": (F.greatest(F.lit(0.0), F.col("_f13") - F.col(f"_m{k}")), F.col("_v13"), 0.03, 0.97)
        for k in sizes
    }
    units["_ubtd"] = (F.when(dbt.isNotNull(), F.col("_dpos")), F.col("_vbtd"), 0.03, 0.97)
    scaled = stats.with_robust_units(local, LAYER, units, grid.cells)
    # A size asked for twice counts twice in the mean.
    scales = [F.col(f"_u{N.odd_size(k)}") for k in median_sizes]
    mean = sum(scales[1:], scales[0]) / float(len(scales))
    blended = (mean + dbt_weight * F.col("_ubtd")) / (1.0 + dbt_weight)
    return (
        scaled.withColumn("score", stats.clip(F.when(F.col("_vbtd"), blended).otherwise(mean)))
        .withColumn("score_valid", F.when(F.col("_both"), F.col("_vbtd")).otherwise(F.col("_v13")))
        .select(*cube.columns, "score", "score_valid")
    )


def unit_or_zero(x: Column) -> Column:
    return stats.clip(F.coalesce(x, F.lit(0.0)))


def fuse_step(risk: Column, score: Column, valid: Column, persistence: float, mode: str = "prob_or") -> Column:
    """One assimilation step.  An invalid observation keeps the risk without decay."""
    p = min(max(persistence, 0.0), 1.0)
    r, s = unit_or_zero(risk), unit_or_zero(score)
    if mode == "max_persist":
        new = F.greatest(r * p, s)
    elif mode == "prob_or":
        new = 1.0 - (1.0 - r * p) * (1.0 - s)
    else:
        raise ValueError(f"unknown fusion mode: {mode}")
    return F.when(valid, new).otherwise(r)


def assimilate(
    scored: DataFrame,
    persistence: float = 0.5,
    mode: str = "prob_or",
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Fold each cell's hours in ``hour_seq`` order, starting from zero.

    A cell holds one observation per hour, so the folded array is as short as the day.
    ``also`` computes further aggregates in the same grouping.
    """
    steps = F.array_sort(F.collect_list(F.struct("hour_seq", "score", "score_valid")))
    risk = F.aggregate(
        steps, F.lit(0.0),
        lambda acc, o: fuse_step(acc, o["score"], o["score_valid"], persistence, mode),
    )
    extra = [expr.alias(name) for name, expr in (also or {}).items()]
    return scored.groupBy("scene_id", "r", "c").agg(risk.alias("risk"), *extra)


def risk_field(cube: DataFrame, grid: GridSpec, cfg: TwinConfig = TwinConfig()) -> DataFrame:
    """Dense (scene_id, r, c, risk, smoothed, valid)."""
    scored = hourly_anomaly_score(cube, grid, cfg.sizes(), cfg.dbt_weight)
    risk = assimilate(
        scored, cfg.persistence, cfg.fusion, {"valid": F.bool_and(G.all_present())}
    )
    return N.gaussian_smooth(risk, "risk", "smoothed", cfg.sigma)


def hot_posterior(field: DataFrame, value: str = "smoothed", max_iter: int = 200, tol: float = 1e-3) -> DataFrame:
    """Two-component Gaussian mixture per scene over the valid cells: adds ``p_hot``.

    Each step is one grouped aggregation for every scene together.  Starting from the lower and
    upper half of the values, steps run until no scene's mean log-likelihood moves by ``tol``.
    The handful of numbers per scene is a stored table: its size decides how it is joined.
    """
    floor = 1e-4
    pool = cut(field.where(F.col("valid")).select("scene_id", "r", "c", F.col(value).alias("x")))
    stat = pool.groupBy("scene_id").agg(F.percentile("x", F.lit(0.5)).alias("mid"))
    halves = pool.join(stat, "scene_id").withColumn("g", F.when(F.col("x") > F.col("mid"), 1.0).otherwise(0.0))
    params = store(_mixture_params(halves, F.lit(None).cast("double"), floor), "mixture")
    for _ in range(max_iter):
        rated = _responsibilities(pool.join(params, "scene_id"))
        params = store(_mixture_params(rated, F.avg("loglik"), floor, F.max("ll")), "mixture")
        moved = F.col("ll_old").isNull() | (F.abs(F.col("ll") - F.col("ll_old")) >= tol)
        if params.where(moved).isEmpty():
            break
    final = _responsibilities(pool.join(params, "scene_id"))
    hot = F.when(F.col("m1") >= F.col("m0"), F.col("g")).otherwise(1.0 - F.col("g"))
    return final.select("scene_id", "r", "c", F.col("x").alias(value), hot.alias("p_hot"))


def _mixture_params(
    rated: DataFrame, loglik: Column, floor: float, previous: Column | None = None
) -> DataFrame:
    """Weighted moments of both components from responsibilities ``g`` (component 1)."""
    g, h, x = F.col("g"), 1.0 - F.col("g"), F.col("x")
    tiny = 1e-12
    sums = rated.groupBy("scene_id").agg(
        F.count("*").alias("n"),
        F.sum(h).alias("w0"), F.sum(g).alias("w1"),
        F.sum(h * x).alias("s0"), F.sum(g * x).alias("s1"),
        F.sum(h * x * x).alias("q0"), F.sum(g * x * x).alias("q1"),
        (loglik if previous is not None else F.max(loglik)).alias("ll"),
        (previous if previous is not None else F.max(F.lit(None).cast("double"))).alias("ll_old"),
    )
    mean = lambda k: F.col(f"s{k}") / (F.col(f"w{k}") + tiny)
    var = lambda k: F.greatest(
        F.col(f"q{k}") / (F.col(f"w{k}") + tiny) - mean(k) * mean(k), F.lit(0.0)
    ) + floor
    return sums.select(
        "scene_id", "ll", "ll_old",
        mean(0).alias("m0"), mean(1).alias("m1"), var(0).alias("v0"), var(1).alias("v1"),
        (F.col("w0") / F.col("n")).alias("p0"), (F.col("w1") / F.col("n")).alias("p1"),
    )


def _responsibilities(joined: DataFrame) -> DataFrame:
    def log_density(k: int) -> Column:
        d = F.col("x") - F.col(f"m{k}")
        return F.log(F.col(f"p{k}") + 1e-300) - 0.5 * (
            F.log(2.0 * 3.141592653589793 * F.col(f"v{k}")) + d * d / F.col(f"v{k}")
        )

    top = F.greatest("_l0", "_l1")
    return (
        joined.withColumns({"_l0": log_density(0), "_l1": log_density(1)})
        .withColumn("loglik", top + F.log(F.exp(F.col("_l0") - top) + F.exp(F.col("_l1") - top)))
        .withColumn("g", F.exp(F.col("_l1") - F.col("loglik")))
    )


def mixture_mask(field: DataFrame, contamination: float, grid: GridSpec) -> DataFrame:
    """Posterior of the hotter component at or above its percentile; scenes with fewer than 80
    valid cells use the plain percentile of the risk."""
    q = stats.clamped_pct(contamination)
    sized = field.withColumn("_n", F.count(F.when(F.col("valid"), 1)).over(Window.partitionBy(*SCENE)))
    plain = stats.percentile_mask(
        sized.where(F.col("_n") < 80), F.col("smoothed"), F.col("valid"), q, SCENE, grid.cells
    )
    rated = hot_posterior(sized.where(F.col("_n") >= 80))
    mixed = stats.percentile_mask(rated, F.col("p_hot"), F.lit(True), q, SCENE, grid.cells)
    return plain.select("scene_id", "r", "c").unionByName(mixed.select("scene_id", "r", "c"))


def drop_weak_inliers(field: DataFrame, mask: DataFrame, grid: GridSpec, neighbors: int = 24) -> DataFrame:
    """Local-outlier refinement on (risk, 5x5 mean): a predicted cell is dropped when its factor
    is ordinary (at most 1.5) and its risk lies below the 72nd percentile of the scene.
    Scenes with fewer than ``neighbors + 15`` valid cells are left alone."""
    key = ["scene_id", "r", "c"]
    if neighbors <= 0:
        return mask.select(*key)
    context = N.box_mean(field, "smoothed", "around", 5)
    pool = stats.with_quantiles(
        context.where("valid"), SCENE, {"_soft": (F.col("smoothed"), 0.72)}, grid.cells
    ).withColumn("_n", F.count("*").over(Window.partitionBy(*SCENE)))
    factors = local_outlier_factor(
        pool.where(F.col("_n") >= neighbors + 15), ["smoothed", "around"], neighbors
    )
    weak = factors.where((F.col("lof") <= 1.5) & (F.col("smoothed") < F.col("_soft")))
    return mask.select(*key).join(weak.select(*key), key, "left_anti")


def risk_mask_from_field(
    field: DataFrame, contamination: float, grid: GridSpec, cfg: TwinConfig = TwinConfig()
) -> DataFrame:
    """Threshold a risk field, refine it and keep valid cells."""
    if cfg.threshold_mode == "percentile":
        base = stats.percentile_mask(
            field, F.col("smoothed"), F.col("valid"), stats.clamped_pct(contamination), SCENE, grid.cells
        )
    elif cfg.threshold_mode == "gmm2":
        base = mixture_mask(field, contamination, grid)
    else:
        raise ValueError(f"unknown threshold mode: {cfg.threshold_mode}")
    return drop_weak_inliers(field, base, grid, cfg.lof_neighbors)


def risk_mask(
    cube: DataFrame, contamination: float, grid: GridSpec, cfg: TwinConfig = TwinConfig()
) -> DataFrame:
    """The whole detector: score, assimilate, smooth, threshold, refine."""
    return risk_mask_from_field(risk_field(cube, grid, cfg), contamination, grid, cfg)
