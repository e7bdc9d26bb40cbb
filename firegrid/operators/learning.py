"""Classifiers over cell features: fits for all folds at once, probabilities, peaks, held-out evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.operators import boosting as B
from firegrid.operators import evaluate as E
from firegrid.operators import logistic as LR
from firegrid.operators import neighborhood as N
from firegrid.operators.features import FEATURES, KEY, training_rows
from firegrid.schema import GridSpec
from firegrid.session import cut, store


@dataclass(frozen=True)
class ClassifierConfig:
    kind: str = "logreg"
    c: float = 0.5
    threshold: float = 0.5
    max_iter: int = 400
    depth: int = 4
    rate: float = 0.07
    rounds: int = 200
    sigma: float = 1.0
    nms_radius: int = 2
    nms_threshold: float = 0.5
    bins: int = 255
    features: tuple[str, ...] = FEATURES

    @property
    def boosting(self) -> B.BoostingConfig:
        return B.BoostingConfig(self.depth, self.rate, self.rounds, self.bins)


def multiday_config(**changes) -> ClassifierConfig:
    """Boosted trees with the smoothing and peak radius used across days."""
    return ClassifierConfig(**{"kind": "boosted", "sigma": 1.2, "nms_radius": 1, **changes})


@dataclass(frozen=True)
class FittedClassifier:
    model: LR.Logits | B.Trees
    cfg: ClassifierConfig


def fit_classifier(
    labelled: DataFrame,
    cfg: ClassifierConfig = ClassifierConfig(),
    where: Column | None = None,
    fold: Column | None = None,
    models: Sequence[int | None] = (None,),
) -> FittedClassifier:
    """Fit on valid labelled cells (of every scene given), classes balanced by weight.

    ``where`` restricts training.  ``models`` lists folds: one model for each, trained on all rows of other
    folds, all in the same jobs; None leaves no fold out.  The driver sees sums for each model.
    """
    cells = labelled if where is None else labelled.where(where)
    rows = training_rows(cells)
    if fold is not None:
        rows = training_rows(cells.withColumn("_fold", fold), "_fold")
        fold = F.col("_fold")
    if cfg.kind == "boosted":
        return FittedClassifier(B.fit_trees(rows, cfg.features, cfg.boosting, fold, models), cfg)
    if cfg.kind != "logreg":
        raise ValueError(f"unknown classifier: {cfg.kind}")
    return FittedClassifier(LR.fit_logistic(rows, cfg.features, cfg.c, cfg.max_iter, fold, models), cfg)


def predict_probability(fitted: FittedClassifier, cells: DataFrame, model: Column | None = None) -> DataFrame:
    """Dense (scene_id, r, c, valid, prob): 0 where invalid; ``model`` names the left-out fold of the model to use."""
    predict = B.predict_trees if isinstance(fitted.model, B.Trees) else LR.predict_logistic
    return predict(fitted.model, cells, fitted.cfg.features, model)


def threshold_mask(prob: DataFrame, threshold: float = 0.5) -> DataFrame:
    return prob.where(F.col("valid") & (F.col("prob") >= threshold)).select(*KEY)


def peak_mask(
    prob: DataFrame, threshold: float = 0.5, radius: int = 2, sigma: float = 1.0
) -> DataFrame:
    return N.peaks(prob, "prob", threshold, radius, sigma).select(*KEY)


def grow(mask: DataFrame, valid: DataFrame, rounds: int, grid: GridSpec) -> DataFrame:
    """Square growth limited to valid cells; zero rounds return the mask itself."""
    if rounds <= 0:
        return mask.select(*KEY)
    return N.keep_valid(N.dilate(mask, rounds, grid), valid)


def grown_peaks(
    prob: DataFrame, grid: GridSpec, threshold: float, radius: int = 1, sigma: float = 1.2, rounds: int = 2
) -> DataFrame:
    return grow(peak_mask(prob, threshold, radius, sigma), prob, rounds, grid)


def held_out_probability(table: DataFrame, scenes: Sequence, cfg: ClassifierConfig = multiday_config()) -> DataFrame:
    """Probabilities of the cells of every scene of ``scenes`` by the model that trained on all other scenes."""
    ids = list(scenes)
    number = F.coalesce(*[F.when(F.col("scene_id") == s, i) for i, s in enumerate(ids)], F.lit(-2))
    wanted = table.where(F.col("scene_id").isin(ids))
    if len(ids) == 1:
        return cut(predict_probability(fit_classifier(table, cfg), wanted))
    fitted = fit_classifier(table, cfg, fold=number, models=range(len(ids)))
    return cut(predict_probability(fitted, wanted, number))


def leave_one_scene_out(
    labelled: DataFrame,
    hotspots: DataFrame,
    grid: GridSpec,
    scenes: Sequence,
    cfg: ClassifierConfig = multiday_config(),
    radius_km: float = 10.0,
    threshold: float = 0.7258,
    rounds: int = 2,
) -> DataFrame:
    """Train on the other scenes, predict grown peaks, event metrics for each held-out scene.

    ``scenes`` is the short list of held-out days; a single scene is scored in sample. Models
    of all days are fitted together, fold by fold as a key; the feature table is written once to the
    shared folder, and masks of all days are evaluated in one job.
    """
    table = cut(labelled)
    ids = list(scenes)
    prob = held_out_probability(table, ids, cfg)
    mask = grown_peaks(prob, grid, threshold, 1, 1.2, rounds)
    held = hotspots.where(F.col("scene_id").isin(ids))
    return E.event_metrics(mask, held, grid, radius_km, scenes=prob.select("scene_id").distinct())


def fold_best_threshold(
    labelled: DataFrame,
    hotspots: DataFrame,
    grid: GridSpec,
    fold: Column,
    folds: Sequence[int],
    thresholds: Sequence[float],
    radii: Sequence[int] = (1, 2, 3),
    cfg: ClassifierConfig = ClassifierConfig(),
    radius_km: float = 5.0,
) -> DataFrame:
    """Spatial cross-validation: fit on the other blocks, sweep (threshold, peak radius) on the
    held-out block, keep the best F1 of each fold.  All folds are fitted in the same jobs."""
    table = cut(labelled.withColumn("fold", fold))
    # Copies collapse once for all folds.
    spots = store(E.collapsed(E.place_points(hotspots, grid, closed_top=False)).withColumn("fold", fold), "spots")
    fitted = fit_classifier(table, cfg, fold=F.col("fold"), models=folds)
    parts = []
    for k in folds:
        prob = cut(predict_probability(fitted, table, F.lit(k)))
        tested = None
        for radius in radii:
            top = N.peaks(prob, "prob", float("-inf"), radius, cfg.sigma)
            rows = top.where(F.col("fold") == k).select(*KEY, F.lit(radius).alias("nms_radius"), "smoothed")
            tested = rows if tested is None else tested.unionByName(rows)
        scored = E.threshold_sweep(
            tested, "smoothed", spots.where(F.col("fold") == k), grid, thresholds, radius_km,
            keys=("scene_id", "nms_radius"),
        )
        best = E.best_row(scored, ["scene_id"], ["f1"], ["threshold", "nms_radius"])
        parts.append(best.withColumn("fold", F.lit(k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def held_out_summary(rows: DataFrame) -> DataFrame:
    """Mean, population deviation and median over units with hotspots."""
    some = rows.where(F.col("n_focos") > 0)
    return some.agg(
        F.count("*").alias("n"),
        F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"),
        F.percentile("f1", F.lit(0.5)).alias("f1_median"),
        F.avg("precision").alias("precision_mean"), F.avg("recall").alias("recall_mean"),
    )
