"""Per-cell features, labels, fold columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.functions import stats
from firegrid.operators import grid as G
from firegrid.operators import neighborhood as N
from firegrid.operators.twin import TwinConfig, assimilate, hourly_anomaly_score
from firegrid.schema import LAYER, SCENE, GridSpec

KEY = ("scene_id", "r", "c")

# Feature order of the classifier.
FEATURES = ("bt13_max", "bt7_max", "btd_median", "twin_risk", "bt13_anom_21", "persist_h")


def build_features(cube: DataFrame, grid: GridSpec, cfg: TwinConfig = TwinConfig(lof_neighbors=0)) -> DataFrame:
    """Dense (scene_id, r, c, six features, valid): one grouping over hours, then fills, smoothing
    and one 21 x 21 median."""
    scored = hourly_anomaly_score(G.with_valid(cube), grid, cfg.sizes(), cfg.dbt_weight)
    usable13 = F.when(F.col("valid"), F.col("bt13"))
    scored = stats.with_quantiles(scored, LAYER, {"_p70": (usable13, 0.70)}, grid.cells)
    btd = F.col("bt7") - F.col("bt14")
    cells = assimilate(
        scored, cfg.persistence, cfg.fusion,
        {
            "bt13_max": F.max("bt13"),
            "bt7_max": F.max("bt7"),
            "btd_median": F.percentile(btd, F.lit(0.5)),
            "persist_h": F.count_if(F.col("bt13") >= F.col("_p70")).cast("double"),
            "valid": F.bool_and("valid"),
        },
    )
    cells = G.fill_with_median(cells, ["bt13_max", "bt7_max", "btd_median"], SCENE, grid.cells)
    cells = N.gaussian_smooth(cells, "risk", "twin_risk", cfg.sigma)
    cells = N.median_backgrounds(cells, "bt13_max", [21], grid, SCENE, "_m")
    return cells.withColumn("bt13_anom_21", F.col("bt13_max") - F.col("_m21")).select(*KEY, *FEATURES, "valid")


def diagnostic_features(cube: DataFrame, grid: GridSpec) -> DataFrame:
    """Feature set of the separability report: residuals at 5, 11 and 21, spectral residual at 11,
    and hours whose 5 x 5 residual exceeds 0.5 K."""
    hourly = cube.withColumn("_f", F.col("bt13"))
    hourly = G.fill_with_median(hourly, ["_f"], LAYER, grid.cells)
    hourly = N.median_backgrounds(hourly, "_f", [5], grid, LAYER, "_h")
    cells = hourly.groupBy(*KEY).agg(
        F.max("bt13").alias("bt13"),
        F.max("bt7").alias("bt7"),
        F.max("bt14").alias("bt14"),
        F.count_if(F.col("_f") - F.col("_h5") > 0.5).cast("double").alias("n_active_h"),
        F.bool_and(G.all_present()).alias("valid"),
    )
    cells = G.fill_with_median(cells, ["bt13", "bt7", "bt14"], SCENE, grid.cells)
    cells = cells.withColumn("btd", F.col("bt7") - F.col("bt14"))
    cells = N.median_backgrounds(cells, "bt13", [5, 11, 21], grid, SCENE, "_m")
    cells = N.median_backgrounds(cells, "btd", [11], grid, SCENE, "_b")
    return cells.select(
        *KEY, "bt13",
        (F.col("bt13") - F.col("_m5")).alias("res13_5"),
        (F.col("bt13") - F.col("_m11")).alias("res13_11"),
        (F.col("bt13") - F.col("_m21")).alias("res13_21"),
        "btd",
        (F.col("btd") - F.col("_b11")).alias("res_btd_11"),
        "bt7", "n_active_h", "valid",
    )


DIAGNOSTIC = ("bt13", "res13_5", "res13_11", "res13_21", "btd", "res_btd_11", "bt7", "n_active_h")


def with_label(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds boolean ``label``: the cell is in the (already dilated) truth mask."""
    flagged = truth.select(*KEY).distinct().withColumn("label", F.lit(True))
    return cells.join(flagged, list(KEY), "left").withColumn("label", F.coalesce("label", F.lit(False)))


def training_rows(cells: DataFrame, *extra: str) -> DataFrame:
    """Valid labelled cells of every scene: stacking days needs no loop."""
    return cells.where("valid").select(*KEY, *FEATURES, F.col("label").cast("int").alias("label"), *extra)


def separability(labelled: DataFrame, features: Sequence[str] = DIAGNOSTIC, keys: Sequence[str] = SCENE) -> DataFrame:
    """Medians and upper quartiles of positive and negative valid cells, and the difference of
    medians over the negative (population) deviation."""
    pairs = ", ".join(f"'{f}', `{f}`" for f in features)
    long = labelled.where("valid").selectExpr(*keys, "label", f"stack({len(features)}, {pairs}) AS (feature, v)")
    pos, neg = F.when(F.col("label"), F.col("v")), F.when(~F.col("label"), F.col("v"))
    at = lambda x, q: F.percentile(x, F.lit(q))
    return long.groupBy(*keys, "feature").agg(
        at(pos, 0.5).alias("med_pos"), at(neg, 0.5).alias("med_neg"),
        at(pos, 0.75).alias("p75_pos"), at(neg, 0.75).alias("p75_neg"),
        ((at(pos, 0.5) - at(neg, 0.5)) / (F.stddev_pop(neg) + 1e-9)).alias("separation"),
    )


def _cuts(n: int, parts: int) -> list[int]:
    """Integer-truncated equal splits of 0..n."""
    return [int(k * (n / parts)) for k in range(parts)] + [n]


def block_of(x: Column, n: int, parts: int) -> Column:
    inner = _cuts(n, parts)[1:-1]
    return sum((F.when(x >= s, 1).otherwise(0) for s in inner), F.lit(0))


def spatial_fold(grid: GridSpec, blocks_lat: int = 3, blocks_lon: int = 3) -> Column:
    """Fold number of a cell: its block.  Training for fold k is every other block."""
    return block_of(F.col("r"), grid.h, blocks_lat) * blocks_lon + block_of(F.col("c"), grid.w, blocks_lon)


def population_scaling(rows: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """One row with mean and population deviation of each column."""
    return rows.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    )


def scaled_columns(stats_row: dict, columns: Sequence[str] = FEATURES) -> dict[str, Column]:
    """Standardised columns from the fitted row; a zero deviation counts as one."""
    return {
        c: (F.col(c) - F.lit(stats_row[f"mean_{c}"])) / F.lit(stats_row[f"std_{c}"] or 1.0) for c in columns
    }

