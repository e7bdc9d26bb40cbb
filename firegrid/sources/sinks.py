"""Result sinks: metric records, map layers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.operators import evaluate as E
from firegrid.schema import GridSpec

# Layer colours and popup wording of the map.
COLOURS = {"TP": "#238b45", "FP": "#fd8d3c", "FN": "#a50f15"}
HOTSPOT_TITLE = "Foco"
PREDICTION_TITLE = "Previsão"


def metric_records(metrics: DataFrame, run: Mapping[str, object]) -> DataFrame:
    """Metric rows with the run parameters as columns (lists become arrays)."""
    def literal(v: object) -> Column:
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)

    return metrics.withColumns({k: literal(v) for k, v in run.items()})


def write_metric_records(metrics: DataFrame, run: Mapping[str, object], path: str) -> None:
    """One JSON object per (scene, method)."""
    metric_records(metrics, run).write.mode("overwrite").json(path)


def _colour(klass: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, code in COLOURS.items():
        out = F.when(klass == name, F.lit(code)).otherwise(out)
    return out


def map_points(
    mask: DataFrame, hotspots: DataFrame, grid: GridSpec, radius_km: float = 10.0, ts: str = "datetime"
) -> DataFrame:
    """Marker table: hotspots TP / FN and predictions TP / FP, with popup text and colour.

    Coordinates print with four digits, exact halves to the even digit.
    """
    spots = E.classify_hotspots(mask, hotspots, grid, radius_km).select(
        "scene_id", F.lit("hotspot").alias("layer"), "klass", "lat", "lon",
        F.format_string(
            f"<b>{HOTSPOT_TITLE}</b><br/>%s UTC<br/>lat=%.4f, lon=%.4f<br/>%s",
            F.date_format(ts, "yyyy-MM-dd HH:mm"), F.bround("lat", 4), F.bround("lon", 4), F.col("klass"),
        ).alias("popup"),
    )
    preds = E.classify_predictions(mask, hotspots, grid, radius_km).select(
        "scene_id", F.lit("prediction").alias("layer"), "klass", "lat", "lon",
        F.format_string(
            f"<b>{PREDICTION_TITLE}</b><br/>lat=%.4f, lon=%.4f<br/>%s (R={radius_km:.1f} km)",
            F.bround("lat", 4), F.bround("lon", 4), F.col("klass"),
        ).alias("popup"),
    )
    return spots.unionByName(preds).withColumn("colour", _colour(F.col("klass")))


def layer_counts(points: DataFrame) -> DataFrame:
    """Markers per scene, layer and class."""
    return points.groupBy("scene_id", "layer", "klass").agg(F.count("*").alias("n"))


def geojson_features(points: DataFrame) -> DataFrame:
    """One GeoJSON feature per row."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct("layer", "klass", "popup", "colour").alias("properties"),
    )
    return points.select("scene_id", F.to_json(feature).alias("feature"))


def write_map(points: DataFrame, path: str) -> None:
    """GeoJSON lines, one folder per scene."""
    geojson_features(points).write.mode("overwrite").partitionBy("scene_id").text(path)


def map_index(points: DataFrame, pattern: str = "scene_id={scene}") -> DataFrame:
    """One index row per scene: link and marker count."""
    before, _, after = pattern.partition("{scene}")
    link = F.concat(F.lit(before), F.col("scene_id").cast("string"), F.lit(after))
    return points.groupBy("scene_id").agg(F.count("*").alias("n_points")).select(
        "scene_id", link.alias("href"), "n_points"
    )
