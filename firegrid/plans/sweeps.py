"""Parameter sweeps: parameters are columns, so a sweep is one job, not a loop of jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions import stats
from firegrid.operators import components as C
from firegrid.operators import detectors as D
from firegrid.operators import evaluate as E
from firegrid.operators import fusion as X
from firegrid.operators import grid as G
from firegrid.operators import learning as L
from firegrid.operators import neighborhood as N
from firegrid.operators import outliers as O
from firegrid.schema import LAYER, GridSpec
from firegrid.session import cut, store

KEY = ("scene_id", "r", "c")
EMPTY = "0"

# Parameter space of the detector search.
EVENT_SPACE = {
    "median_sizes": ((3, 5), (3, 5, 7), (5, 7)),
    "btd_low": (25.0, 35.0, 50.0),
    "btd_high": (80.0, 90.0, 95.0),
    "risk_percentile": (95.0, 97.0, 98.5, 99.2),
    "min_active_hours": (1, 2, 3),
    "weight_anomaly": (0.45, 0.55, 0.65),
    "weight_persistence": (0.15, 0.25, 0.35),
    "max_component": (80, 200, 0),
}


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def distinct_masks(masks: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Masks of many settings without repetition: (keys, mask) for each setting, and (scene_id, mask, r, c) once a mask.

    A mask is named by its size and 128 bits of hashes of its cells. Settings with an empty mask are absent.
    """
    own = F.concat_ws("-", F.count("*"), F.bit_xor(F.xxhash64("r", "c")), F.bit_xor(F.xxhash64("c", F.lit("second"), "r")))
    members = store(masks.groupBy(*keys).agg(own.alias("mask")), "members")
    settings = [k for k in keys if k != "scene_id"]
    first = members.groupBy("scene_id", "mask").agg(F.min(F.struct(*settings)).alias("_first")).select("scene_id", "mask", "_first.*")
    return members, masks.join(first, list(keys)).select("scene_id", "mask", "r", "c")


def event_sweep(
    cube: DataFrame,
    hotspots: DataFrame,
    grid: GridSpec,
    hours: int,
    space: dict = EVENT_SPACE,
    radius_km: float = 5.0,
) -> DataFrame:
    """Event metrics of every detector setting.

    Layers are scored once: anomalies once per list of window sizes, band percentiles all at once;
    settings are then rows. Weights and hour counts share their risk fields, percentiles their
    thresholds, and size limits the components of one labelling.
    """
    sizes = {",".join(map(str, k)): tuple(k) for k in space["median_sizes"]}
    levels = {f"_q{x}".replace(".", "_"): x for x in (*space["btd_low"], *space["btd_high"])}
    layers = G.with_valid(cube).withColumn("seen", F.col("bt13").isNotNull() & F.col("valid"))
    scored = layers
    for i, k in enumerate(sizes.values()):
        scored = D.fine_anomaly(scored, grid, k).withColumnRenamed("anomaly", f"_a{i}")
    btd = F.col("bt7") - F.col("bt14")
    pool = F.when(F.col("seen"), btd)
    scored = D.glint_flag(stats.with_quantiles(scored, LAYER, {n: (pool, x / 100.0) for n, x in levels.items()}, grid.cells), grid)
    at = {x: F.col(n) for n, x in levels.items()}
    cases = F.array(
        *[
            F.struct(
                F.lit(name).alias("sizes"), F.lit(float(low)).alias("btd_low"), F.lit(float(high)).alias("btd_high"),
                F.col(f"_a{i}").alias("anomaly"), at[low].alias("_lo"), at[high].alias("_hi"),
            )
            for i, name in enumerate(sizes)
            for low, high in product(space["btd_low"], space["btd_high"])
        ]
    )
    outer = ["sizes", "btd_low", "btd_high"]
    rows = cut(scored).withColumn("_s", F.explode(cases)).select(*LAYER, "r", "c", "valid", "glint", pool.alias("_btd"), "_s.*")
    inside, score = D.band_between(F.col("_btd"), F.col("_lo"), F.col("_hi"))
    rows = rows.withColumns({"in_band": inside, "band": score})
    signals = cut(D.event_signals(rows, grid, settings=outer))
    inner = ["min_active_hours", "weight_anomaly", "weight_persistence"]
    fields = F.array(
        *[
            F.struct(F.lit(int(m)).alias(inner[0]), F.lit(float(a)).alias(inner[1]), F.lit(float(w)).alias(inner[2]))
            for m, a, w in product(*(space[n] for n in inner))
        ]
    )
    tried = signals.where("valid").withColumn("_s", F.explode(fields)).select("*", "_s.*").drop("_s")
    wa, wp = F.col("weight_anomaly"), F.col("weight_persistence")
    risk = D.weighted_risk(hours, wa, F.greatest(F.lit(0.05), 1.0 - wa - wp), wp, F.col("min_active_hours"))
    keys = ["scene_id", *outer, *inner]
    tried = cut(tried.select(*keys, "r", "c", risk.alias("risk")).where("risk > 0"))
    ranks = {f"_p{i}": float(x) for i, x in enumerate(space["risk_percentile"])}
    found = stats.quantiles(tried, keys, {n: (F.col("risk"), x / 100.0) for n, x in ranks.items()}, grid.cells)
    enough = tried.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n >= 32")
    steps = F.array(*[F.struct(F.lit(x).alias("risk_percentile"), F.col(n).alias("_thr")) for n, x in ranks.items()])
    limits = found.join(enough, keys).withColumn("_s", F.explode(steps)).select(*keys, "_s.*")
    keys = [*keys, "risk_percentile"]
    hot = tried.join(limits, keys[:-1]).where(F.col("risk") >= F.col("_thr")).select(*keys, "r", "c")
    members, once = distinct_masks(cut(hot), keys)
    one = ["scene_id", "mask"]
    labelled = cut(C.label_components(once, grid, 1, one))
    sizes_of = labelled.groupBy(*one, "label").agg(F.count("*").alias("_size"))
    most = F.explode(F.array(*[F.lit(int(x)) for x in space["max_component"]]))
    kept = labelled.join(sizes_of, [*one, "label"]).withColumn("max_component", most)
    kept = kept.where((F.col("max_component") == 0) | (F.col("_size") <= F.col("max_component")))
    limited, last = distinct_masks(kept.select("scene_id", F.col("mask").alias("whole"), "max_component", "r", "c"), ["scene_id", "whole", "max_component"])
    scored = store(E.event_curve(last, hotspots, grid, (radius_km,), scenes=_with_empty(limited, cube), keys=one), "scored")
    every = signals.select("scene_id", *outer).distinct().withColumn("_s", F.explode(fields)).select("scene_id", *outer, "_s.*")
    every = every.withColumn("risk_percentile", F.explode(F.array(*[F.lit(x) for x in ranks.values()]))).withColumn("max_component", most)
    named = every.join(members.withColumnRenamed("mask", "whole"), keys, "left").join(limited, ["scene_id", "whole", "max_component"], "left")
    named = named.withColumn("mask", F.coalesce("mask", F.lit(EMPTY))).drop("whole")
    return named.join(scored, one).drop("mask")


def _with_empty(members: DataFrame, cube: DataFrame) -> DataFrame:
    """Every mask of a scene, and the empty one of every scene."""
    nothing = cube.select("scene_id").distinct().withColumn("mask", F.lit(EMPTY))
    return members.select("scene_id", "mask").unionByName(nothing).distinct()


def peak_sweep(
    prob: DataFrame,
    hotspots: DataFrame,
    grid: GridSpec,
    thresholds: Sequence[float],
    radii: Sequence[int] = (1, 2, 3, 4),
    sigmas: Sequence[float] = (0.8, 1.2, 1.6, 2.0),
    growths: Sequence[int] = (0, 1, 2),
    distances: Sequence[float] = (3.0, 5.0, 8.0, 10.0),
) -> DataFrame:
    """Threshold x peak radius x smoothing x growth x match radius.

    Smoothing runs once per sigma and the local maximum once per radius; thresholds, growth and
    match radii are rows.
    """
    prob = cut(prob)
    found = []
    for sigma in sigmas:
        smooth = cut(N.gaussian_smooth(prob, "prob", "smoothed", sigma))
        for radius in radii:
            top = N.local_maximum(smooth, "smoothed", "_top", radius)
            found.append(
                top.where(F.col("valid") & (F.col("smoothed") == F.col("_top"))).select(
                    *KEY, F.lit(float(sigma)).alias("sigma"), F.lit(int(radius)).alias("nms_radius"), "smoothed"
                )
            )
    keys = ["scene_id", "sigma", "nms_radius", "threshold"]
    masks = store(E.masks_by_threshold(_union(found), "smoothed", thresholds, keys[:-1]))
    grown = _union(
        [N.dilate(masks, g, grid, keys).withColumn("growth", F.lit(int(g))) for g in growths]
    )
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    every = prob.select("scene_id").distinct()
    for name, values in (("sigma", [float(s) for s in sigmas]), ("nms_radius", [int(r) for r in radii])):
        every = every.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    every = every.withColumn("threshold", F.explode(levels)).withColumn(
        "growth", F.explode(F.array(*[F.lit(int(g)) for g in growths]))
    )
    return E.event_curve(grown, hotspots, grid, distances, valid=prob, scenes=every, keys=[*keys, "growth"])


def fusion_sweep(
    pred: DataFrame,
    detections: DataFrame,
    cells: DataFrame,
    hotspots: DataFrame,
    held_out: DataFrame,
    grid: GridSpec,
    modes: Sequence[str] = X.MODES,
    gates: Sequence[float] = (3.0, 5.0, 8.0),
    radii: Sequence[float] = (5.0, 8.0, 10.0),
) -> DataFrame:
    """Fusion mode x gate x match radius against all hotspots and against the held-out ones."""
    masks = store(
        _union(
            [
                X.fused_mask(X.fuse(pred, detections, cells, grid, X.FusionConfig(mode=m, gate_km=g))).select(
                    *KEY, F.lit(m).alias("mode"), F.lit(float(g)).alias("gate_km")
                )
                for m in modes
                for g in gates
            ]
        )
    )
    every = (
        cells.select("scene_id").distinct()
        .withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
        .withColumn("gate_km", F.explode(F.array(*[F.lit(float(g)) for g in gates])))
    )
    keys = ["scene_id", "mode", "gate_km"]
    full = E.event_curve(masks, hotspots, grid, radii, scenes=every, keys=keys)
    held = E.event_curve(masks, held_out, grid, radii, scenes=every, keys=keys)
    on = [*keys, "radius_km"]
    return full.select(
        *on, F.col("n_components").alias("n_pred"), F.col("f1").alias("f1_full"),
        F.col("precision").alias("precision_full"), F.col("recall").alias("recall_full"),
    ).join(
        held.select(
            *on, F.col("f1").alias("f1_holdout"), F.col("precision").alias("precision_holdout"),
            F.col("recall").alias("recall_holdout"),
        ),
        on,
    )


def outlier_sweep(
    candidates: DataFrame,
    features: DataFrame,
    hotspots: DataFrame,
    grid: GridSpec,
    methods: Sequence[str] = ("isolation_forest", "local_outlier_factor", "elliptic_envelope", "ensemble"),
    contaminations: Sequence[float] = (0.005, 0.01, 0.02, 0.04, 0.08, 0.12),
    radii: Sequence[float] = (5.0, 8.0, 10.0),
) -> DataFrame:
    """Outlier filter x contamination x match radius; each method is fitted once."""
    found = O.outlier_masks(features, methods, contaminations, group_rows=grid.cells)
    masks = store(found.join(candidates.select(*KEY), list(KEY), "left_semi"))
    every = (
        features.select("scene_id").distinct()
        .withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
        .withColumn("contamination", F.explode(F.array(*[F.lit(float(c)) for c in contaminations])))
    )
    return E.event_curve(
        masks, hotspots, grid, radii, valid=features, scenes=every, keys=["scene_id", "method", "contamination"]
    )


# ---------------------------------------------------------------- outlier combinations


def only_outliers(outliers: DataFrame, valid: DataFrame, growth: int, grid: GridSpec) -> DataFrame:
    return L.grow(outliers, valid, growth, grid)


def union_with_outliers(pred: DataFrame, outliers: DataFrame, valid: DataFrame, growth: int, grid: GridSpec) -> DataFrame:
    return D.unite_masks(pred, L.grow(outliers, valid, growth, grid))


def outlier_weighted_peaks(
    prob: DataFrame, outliers: DataFrame, radius: int, growth: int, grid: GridSpec, sigma: float = 1.2
) -> DataFrame:
    """Peaks of the smoothed probability restricted to outliers (zero elsewhere), then growth."""
    smooth = N.gaussian_smooth(prob, "prob", "_ps", sigma)
    flagged = E.with_flag(smooth, outliers, "_out").withColumn(
        "_score", F.when(F.col("_out"), F.col("_ps")).otherwise(F.lit(0.0))
    )
    top = N.local_maximum(N.settle(flagged, grid), "_score", "_top", radius)
    hit = top.where(
        F.col("valid") & F.col("_out") & (F.col("_score") > 0) & (F.col("_score") == F.col("_top"))
    )
    return L.grow(hit.select(*KEY), prob, growth, grid)


def outlier_mode_sweep(
    base: DataFrame,
    prob: DataFrame,
    features: DataFrame,
    hotspots: DataFrame,
    grid: GridSpec,
    methods: Sequence[str] = ("isolation_forest", "local_outlier_factor", "elliptic_envelope", "ensemble"),
    contaminations: Sequence[float] = (0.005, 0.01, 0.02, 0.04, 0.08),
    growths: Sequence[int] = (0, 1, 2),
    peak_radii: Sequence[int] = (1, 2, 3),
    radii: Sequence[float] = (10.0,),
    sigma: float = 1.2,
) -> DataFrame:
    """Events of every way to use outliers: alone, added to ``base``, or as peaks of ``prob``.

    One row per scene, mode (only / union / peaks), method, contamination, peak radius (0 where none),
    growth and match radius.  Methods are fitted once; settings are rows of one table of masks.
    """
    setting = ["scene_id", "method", "contamination"]
    found = store(O.outlier_masks(features, methods, contaminations, group_rows=grid.cells))
    valid = features.where("valid").select(*KEY)

    def grown(mask: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
        return N.dilate(mask, n, grid, keys).join(valid, list(KEY), "left_semi") if n else mask.select(*keys, "r", "c")

    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("method"), F.lit(float(c)).alias("contamination")) for m in methods for c in contaminations])
    )
    smooth = N.gaussian_smooth(prob, "prob", "_ps", sigma).select(*KEY, "_ps")
    dense = smooth.withColumn("_p", pairs).select(*KEY, "_ps", "_p.method", "_p.contamination")
    score = F.when(F.col("_out"), F.col("_ps")).otherwise(F.lit(0.0))
    dense = dense.join(found.withColumn("_out", F.lit(True)), [*setting, "r", "c"], "left").withColumn("_score", score)
    scored = cut(N.settle(dense, grid))

    def as_mode(mask: DataFrame, mode: str, peak: int, growth: int) -> DataFrame:
        named = {"mode": F.lit(mode), "peak_radius": F.lit(peak), "growth": F.lit(growth)}
        return mask.select(*setting, "r", "c").withColumns(named)

    parts = []
    wide = base.select(*KEY).withColumn("_p", pairs).select(*KEY, "_p.method", "_p.contamination")
    for n in growths:
        alone = grown(found, n, setting)
        parts.append(as_mode(alone, "only", 0, n))
        parts.append(as_mode(alone.select(*setting, "r", "c").unionByName(wide).distinct(), "union", 0, n))
    for d in peak_radii:
        top = N.local_maximum(scored, "_score", "_top", d, setting)
        hit = cut(top.where(F.col("_out") & (F.col("_score") > 0) & (F.col("_score") == F.col("_top"))).select(*setting, "r", "c"))
        parts += [as_mode(grown(hit, n, setting), "peaks", d, n) for n in growths]
    masks = store(_union(parts))
    modes = [("only", 0), ("union", 0), *(("peaks", d) for d in peak_radii)]
    cases = [F.struct(F.lit(m).alias("mode"), F.lit(d).alias("peak_radius"), F.lit(n).alias("growth")) for m, d in modes for n in growths]
    every = features.select("scene_id").distinct().withColumn("_p", pairs).withColumn("_m", F.explode(F.array(*cases)))
    every = every.select("scene_id", "_p.method", "_p.contamination", "_m.mode", "_m.peak_radius", "_m.growth")
    keys = ["scene_id", "mode", "method", "contamination", "peak_radius", "growth"]
    return E.event_curve(masks, hotspots, grid, radii, valid=features, scenes=every, keys=keys)
