"""Event metrics by distance, cell confusion, sweeps.

Distance matching never forms point-by-cell pairs.  Predicted units are spread to the grid
cells from which they can be reached and gathered there, at most one small array per cell;
points meet that array in one equi-join and are aggregated map-side.  A cell crowded with
points only makes a skewed probe side, which adaptive execution splits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions import geo
from firegrid.functions.stats import bracketed_quantiles, f1, f_beta, ratio
from firegrid.operators import components as C
from firegrid.operators import grid as G
from firegrid.schema import KM_PER_DEG, SCENE, GridSpec
from firegrid.session import cut, store

KEY = ("scene_id", "r", "c")


def place_points(points: DataFrame, grid: GridSpec, closed_top: bool = True) -> DataFrame:
    """Points inside the box with their cell."""
    return G.assign_cells(G.bbox_filter(points, grid), grid, closed_top)


def collapsed(points: DataFrame) -> DataFrame:
    """Placed points with equal places as one row and its number of ``copies``; collapsed ones may collapse again."""
    n = F.sum("copies") if "copies" in points.columns else F.count("*")
    return points.groupBy("scene_id", "r", "c", "lat", "lon").agg(n.alias("copies"))


def prediction_units(
    mask: DataFrame,
    grid: GridSpec,
    matching: str = "cell",
    connectivity: int = 2,
    keys: Sequence[str] = SCENE,
) -> DataFrame:
    """Units of a prediction: every cell, or the centroid of every component."""
    if matching == "cell":
        cells = G.cell_centers(mask.select(*keys, "r", "c"), grid)
        unit = (F.col("r") * grid.w + F.col("c")).cast("bigint")
        return cells.select(*keys, unit.alias("unit"), "lat", "lon", F.lit(1).cast("bigint").alias("size"))
    if matching == "centroid":
        mids = C.component_centroids(mask, grid, connectivity, keys)
        return mids.select(*keys, F.col("label").alias("unit"), "lat", "lon", "size")
    raise ValueError(f"unknown matching: {matching}")


def _reference(units: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reference latitude: the mean of both mean latitudes; only where both sides have rows."""
    u = units.groupBy(*keys).agg(F.avg("lat").alias("_u"))
    n = F.sum("copies") if "copies" in points.columns else F.count("*")
    lat = F.sum(F.col("lat") * F.col("copies")) if "copies" in points.columns else F.sum("lat")
    p = points.groupBy("scene_id").agg((lat / n).alias("_p"))
    return u.join(p, "scene_id").select(*keys, (0.5 * (F.col("_u") + F.col("_p"))).alias("lat_ref"))


def _reach_table(
    units: DataFrame, ref: DataFrame, grid: GridSpec, radius_km: float, keys: Sequence[str]
) -> DataFrame:
    """Per cell, the units a point in that cell could reach within ``radius_km``."""
    dr, dc = geo.cell_reach(grid, radius_km)
    home = units.withColumns(
        {"r": geo.lat_row(F.col("lat"), grid), "c": geo.lon_col(F.col("lon"), grid)}
    )
    spread = (
        home.join(ref, list(keys))
        .withColumn("r", F.explode(F.sequence(F.col("r") - dr, F.col("r") + dr)))
        .withColumn("c", F.explode(F.sequence(F.col("c") - dc, F.col("c") + dc)))
        .where(F.col("r").between(0, grid.h - 1) & F.col("c").between(0, grid.w - 1))
    )
    return spread.groupBy(*keys, "r", "c", "lat_ref").agg(
        F.collect_list(F.struct("unit", "lat", "lon")).alias("near")
    )


def _distances(radius_km: float) -> Column:
    """Units of ``near`` within the radius, with their distance to the row's point."""
    kx = geo.km_per_deg_lon(F.col("lat_ref"))

    def away(u: Column) -> Column:
        d = F.hypot((F.col("lat") - u["lat"]) * KM_PER_DEG, (F.col("lon") - u["lon"]) * kx)
        return F.struct(u["unit"].alias("unit"), d.alias("km"))

    return F.filter(F.transform("near", away), lambda s: s["km"] <= radius_km)


def _hits(
    units: DataFrame, points: DataFrame, grid: GridSpec, radii: Sequence[float], keys: Sequence[str]
) -> DataFrame:
    """Per key: points and units matched at each radius (arrays in the order of ``radii``)."""
    top = float(max(radii))
    reach = _reach_table(units, _reference(units, points, keys), grid, top, keys)
    met = points.join(reach, ["scene_id", "r", "c"]).withColumn("_hit", _distances(top)).where(F.size("_hit") > 0)
    point_row = F.struct(
        F.lit(None).cast("bigint").alias("unit"), F.array_min(F.transform("_hit", lambda s: s["km"])).alias("km")
    )
    rows = met.select(*keys, "copies", F.explode(F.concat(F.array(point_row), "_hit")).alias("_s"))
    per_unit = rows.groupBy(*keys, F.col("_s.unit").alias("unit")).agg(
        F.min("_s.km").alias("km"),
        *[F.sum(F.when(F.col("_s.km") <= r, F.col("copies")).otherwise(0)).alias(f"p{i}") for i, r in enumerate(radii)],
    )
    is_unit = F.col("unit").isNotNull()
    return per_unit.groupBy(*keys).agg(
        F.array(*[F.max(F.when(~is_unit, F.col(f"p{i}"))) for i in range(len(radii))]).alias("point_hits"),
        F.array(*[F.count_if(is_unit & (F.col("km") <= r)) for r in radii]).alias("unit_hits"),
    )


def event_curve(
    mask: DataFrame,
    hotspots: DataFrame,
    grid: GridSpec,
    radii: Sequence[float] = (1.5, 3.0, 5.0, 8.0),
    matching: str = "cell",
    connectivity: int = 2,
    valid: DataFrame | None = None,
    scenes: DataFrame | None = None,
    keys: Sequence[str] = SCENE,
) -> DataFrame:
    """Event metrics for several radii from one join.

    ``keys`` starts with ``scene_id`` and may carry parameter columns; ``scenes`` lists the key
    rows that must appear even with an empty side.  Hotspots are restricted to the box, and
    predictions to ``valid`` when given.  Hotspots may come :func:`collapsed`.
    """
    keys = list(keys)
    if valid is not None:
        ok = valid.where("valid").select(*KEY)
        mask = mask.join(ok, list(KEY), "left_semi")
    # Copies of a point collapse before anything is joined; the points are read three times below.
    points = store(collapsed(place_points(hotspots, grid)), "points")
    # The units are read four times below: compute the prediction once.
    units = store(prediction_units(mask, grid, matching, connectivity, keys), "units")
    base = scenes.select(*keys).distinct() if scenes is not None else (
        units.select(*keys).distinct() if len(keys) > 1
        else units.select(*keys).unionByName(points.select(*keys)).distinct()
    )
    per_key = units.groupBy(*keys).agg(
        F.count("*").alias("n_components"),
        F.percentile("size", F.lit(0.5)).alias("component_size_median"),
        F.max("size").alias("component_size_max"),
    )
    per_scene = points.groupBy("scene_id").agg(F.sum("copies").alias("n_focos"))
    zero = F.lit(0).cast("bigint")
    full = (
        base.join(per_key, keys, "left")
        .join(per_scene, "scene_id", "left")
        .join(_hits(units, points, grid, radii, keys), keys, "left")
    )
    at = F.posexplode(F.array(*[F.lit(float(r)) for r in radii]))
    rows = full.select("*", at.alias("_i", "radius_km")).select(
        *keys, "radius_km",
        F.coalesce("n_focos", zero).alias("n_focos"),
        F.coalesce("n_components", zero).alias("n_components"),
        F.coalesce(F.get("point_hits", F.col("_i")), zero).alias("tp_recall"),
        F.coalesce(F.get("unit_hits", F.col("_i")), zero).alias("tp_precision"),
        F.coalesce("component_size_median", F.lit(0.0)).alias("component_size_median"),
        F.coalesce("component_size_max", zero).alias("component_size_max"),
    )
    rows = rows.withColumns(
        {
            "fn_focos": F.col("n_focos") - F.col("tp_recall"),
            "fp_components": F.col("n_components") - F.col("tp_precision"),
            "precision": ratio(F.col("tp_precision"), F.col("n_components")),
            "recall": ratio(F.col("tp_recall"), F.col("n_focos")),
        }
    )
    return rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def event_metrics(mask: DataFrame, hotspots: DataFrame, grid: GridSpec, radius_km: float = 3.0, **options) -> DataFrame:
    """Event metrics at one radius; options as in :func:`event_curve`."""
    return event_curve(mask, hotspots, grid, (radius_km,), **options)


def hotspot_distance(
    mask: DataFrame, hotspots: DataFrame, grid: GridSpec, radius_km: float, matching: str = "cell"
) -> DataFrame:
    """Every in-box hotspot row with ``km`` to its nearest unit, NULL beyond the radius."""
    points = place_points(hotspots, grid)
    units = store(prediction_units(mask, grid, matching), "units")
    reach = _reach_table(units, _reference(units, points, SCENE), grid, radius_km, SCENE)
    met = points.join(reach, list(KEY), "left").withColumn("_hit", _distances(radius_km))
    return met.withColumn("km", F.array_min(F.transform("_hit", lambda s: s["km"]))).drop("near", "_hit", "lat_ref")


def unit_distance(
    mask: DataFrame, hotspots: DataFrame, grid: GridSpec, radius_km: float, matching: str = "cell"
) -> DataFrame:
    """Every unit with ``km`` to its nearest hotspot, NULL beyond the radius."""
    points = place_points(hotspots, grid)
    units = store(prediction_units(mask, grid, matching), "units")
    reach = _reach_table(units, _reference(units, points, SCENE), grid, radius_km, SCENE)
    unique = points.select("scene_id", "r", "c", "lat", "lon").distinct()
    hits = unique.join(reach, list(KEY)).select("scene_id", F.explode(_distances(radius_km)).alias("s"))
    best = hits.groupBy("scene_id", F.col("s.unit").alias("unit")).agg(F.min("s.km").alias("km"))
    return units.join(best, ["scene_id", "unit"], "left")


def classify_hotspots(mask: DataFrame, hotspots: DataFrame, grid: GridSpec, radius_km: float) -> DataFrame:
    """TP / FN class of each hotspot."""
    rows = hotspot_distance(mask, hotspots, grid, radius_km)
    return rows.withColumn("klass", F.when(F.col("km").isNotNull(), "TP").otherwise("FN"))


def classify_predictions(mask: DataFrame, hotspots: DataFrame, grid: GridSpec, radius_km: float) -> DataFrame:
    """TP / FP class of each predicted cell."""
    rows = unit_distance(mask, hotspots, grid, radius_km)
    return rows.withColumn("klass", F.when(F.col("km").isNotNull(), "TP").otherwise("FP"))


def cell_classes(cells: DataFrame) -> DataFrame:
    """TN / FN / FP / TP of each valid cell of a dense table with ``pred`` and ``truth``."""
    klass = (
        F.when(F.col("pred") & F.col("truth"), "TP")
        .when(F.col("pred"), "FP")
        .when(F.col("truth"), "FN")
        .otherwise("TN")
    )
    return cells.where("valid").withColumn("klass", klass)


def with_flag(cells: DataFrame, mask: DataFrame, name: str) -> DataFrame:
    """Attach a sparse mask as a boolean column of a dense table."""
    flagged = mask.select(*KEY).distinct().withColumn(name, F.lit(True))
    return cells.join(flagged, list(KEY), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def confusion(cells: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Cell-by-cell metrics over valid cells of a dense (pred, truth, valid) table."""
    v, p, t = F.col("valid"), F.col("pred"), F.col("truth")
    counted = cells.groupBy(*keys).agg(
        F.count_if(v & p & t).alias("tp"), F.count_if(v & p & ~t).alias("fp"),
        F.count_if(v & ~p & t).alias("fn"), F.count_if(v & ~p & ~t).alias("tn"),
        F.count_if(v).alias("valid_cells"),
    )
    return with_rates(counted)


def with_rates(counted: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    rated = counted.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return rated.withColumns(
        {
            "f1": f1(F.col("precision"), F.col("recall")),
            "iou": ratio(tp, tp + fp + fn),
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        }
    )


def with_f_beta(metrics: DataFrame, beta: float, out: str = "f_beta") -> DataFrame:
    return metrics.withColumn(out, f_beta(F.col("precision"), F.col("recall"), beta))


def best_row(df: DataFrame, group: Sequence[str], best: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Best row of each group: highest ``best`` columns (to 12 digits), then lowest ``tie``."""
    order = [F.round(b, 12).desc() for b in best] + [F.col(t).asc() for t in tie]
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def masks_by_threshold(cells: DataFrame, score: str, thresholds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Each cell once per threshold it reaches."""
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.filter(levels, lambda t: F.col(score) >= t)
    return cells.select(*keys, "r", "c", F.explode(reached).alias("threshold"))


def threshold_sweep(
    cells: DataFrame,
    score: str,
    hotspots: DataFrame,
    grid: GridSpec,
    thresholds: Sequence[float],
    radius_km: float,
    keys: Sequence[str] = SCENE,
) -> DataFrame:
    """Event metrics at every threshold of a score on candidate cells, in one job.  Every
    (key, threshold) appears, also where nothing is predicted."""
    masks = masks_by_threshold(cells, score, thresholds, keys)
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    wanted = cells.select(*keys).distinct().withColumn("threshold", F.explode(levels))
    return event_curve(masks, hotspots, grid, (radius_km,), scenes=wanted, keys=[*keys, "threshold"])


def nearest_component_km(
    mask: DataFrame, hotspots: DataFrame, grid: GridSpec, start_km: float = 50.0
) -> DataFrame:
    """Distance of each in-box hotspot to the nearest component centroid, with no limit.

    Hotspots look inside ``start_km`` first; those that find nothing try twice as far, until
    the radius spans the grid.  Buckets as wide as the radius make each try an equi-join.
    """
    points = place_points(hotspots, grid)
    units = store(prediction_units(mask, grid, "centroid"), "units")
    ref = store(_reference(units, points, SCENE), "reference")
    left = cut(points.join(ref, "scene_id"))
    units = units.join(ref, "scene_id")
    span = math.hypot(
        (grid.max_lat - grid.min_lat) * KM_PER_DEG, (grid.max_lon - grid.min_lon) * KM_PER_DEG
    )
    done, radius = None, float(start_km)
    while True:
        kx = geo.km_per_deg_lon(F.col("lat_ref"))
        row = F.floor(F.col("lat") * KM_PER_DEG / radius)
        col = F.floor(F.col("lon") * kx / radius)
        around = (
            units.withColumns({"_b": row, "_d": col})
            .withColumn("_b", F.explode(F.sequence(F.col("_b") - 1, F.col("_b") + 1)))
            .withColumn("_d", F.explode(F.sequence(F.col("_d") - 1, F.col("_d") + 1)))
            .groupBy("scene_id", "_b", "_d")
            .agg(F.collect_list(F.struct("unit", "lat", "lon")).alias("near"))
        )
        placed = left.withColumns({"_b": row, "_d": col}).join(around, ["scene_id", "_b", "_d"], "left")
        looked = placed.withColumn(
            "km", F.array_min(F.transform(_distances(radius), lambda s: s["km"]))
        ).drop("near", "_b", "_d")
        looked = cut(looked)
        found = looked.where(F.col("km").isNotNull())
        done = found if done is None else done.unionByName(found)
        if radius >= span:
            break
        left = looked.where(F.col("km").isNull()).drop("km")
        radius *= 2.0
    return done.drop("lat_ref")


def distance_summary(distances: DataFrame, keys: Sequence[str] = SCENE, limits: Sequence[float] = (3, 5, 8, 20, 50)) -> DataFrame:
    """Counts within each limit and min / median / max distance per scene.

    Hotspots of a scene are not bounded by the grid, so the median takes the bracketed route.
    """
    keys = list(keys)
    counted = distances.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("km").alias("km_min"), F.max("km").alias("km_max"),
        *[F.count_if(F.col("km") <= d).alias(f"within_{int(d)}km") for d in limits],
    )
    return counted.join(bracketed_quantiles(distances, keys, {"km_median": (F.col("km"), 0.5)}), keys, "left")


def unseen_hotspots(hotspots: DataFrame, seen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Hotspots the second sensor did not see: the held-out truth."""
    return hotspots.join(seen.select(*on).distinct(), list(on), "left_anti")
