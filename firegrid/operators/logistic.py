"""Penalised logistic regression by Newton steps whose moments are one grouped sum for all models.

A model may leave one fold out. A step sums gradient and curvature of every model in one aggregation,
combined within tasks; the driver solves one small system for each model. Steps that do not lower the
loss are halved, so the fit ends at the only minimum and does not depend on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.session import cut

#: The fit has ended when no entry of the gradient exceeds this share of the number of rows.
TOLERANCE = 1e-10


@dataclass(frozen=True)
class Logits:
    """``models`` name the folds left out (None: none); ``beta`` holds the weights of scaled features, then the intercept."""

    models: tuple[int | None, ...]
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray


def _for_models(rows: DataFrame, models: Sequence[int | None]) -> DataFrame:
    """Every row once for each model that trains on it, ``_m`` being the model's place."""
    left_out = F.array(*[F.lit(m).cast("int") for m in models])
    mine = F.filter(
        F.sequence(F.lit(0), F.lit(len(models) - 1)),
        lambda i: F.coalesce(F.get(left_out, i) != F.col("_fold"), F.lit(True)),
    )
    return rows.withColumn("_m", F.explode(mine))


def _moments(rows: DataFrame, features: Sequence[str], models: Sequence[int | None]):
    n, d = len(models), len(features)
    mean, scale, counts = np.zeros((n, d)), np.ones((n, d)), np.zeros((n, 2))
    per = _for_models(rows, models).groupBy("_m").agg(
        F.array(*[F.avg(c) for c in features]).alias("mean"),
        F.array(*[F.stddev_pop(c) for c in features]).alias("std"),
        F.array(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).alias("counts"),
    )
    for r in per.collect():
        std = np.array(r["std"])
        mean[r["_m"]], scale[r["_m"]], counts[r["_m"]] = r["mean"], np.where(std > 0, std, 1.0), r["counts"]
    return mean, scale, counts


def fit_logistic(
    rows: DataFrame,
    features: Sequence[str],
    c: float = 0.5,
    max_iter: int = 400,
    fold: Column | None = None,
    models: Sequence[int | None] = (None,),
) -> Logits:
    """Fit one model per entry of ``models`` on ``rows`` (features, none null, and a 0 / 1 ``label``).

    The loss is the sum of class-balanced log losses plus |weights|^2 / (2 c), on features scaled by the
    model's own rows; the intercept is free. Constant features get weight 0. A model without rows of both
    classes is an error. The driver sees (features + 1)^2 sums for each model.
    """
    models, d = tuple(models), len(features)
    rows = cut(rows.select(*features, "label", (F.lit(-1) if fold is None else fold).cast("int").alias("_fold")))
    mean, scale, counts = _moments(rows, features, models)
    if (counts == 0).any():
        raise ValueError("training needs cells of both classes")
    total = counts.sum(1)
    balance = total[:, None] / (2.0 * counts)
    wide = _for_models(rows, models)
    schema = "_m int, mean array<double>, scale array<double>, beta array<double>, w array<double>"
    z = [(F.col(f) - F.get("mean", F.lit(j))) / F.get("scale", F.lit(j)) for j, f in enumerate(features)]
    score = sum((F.get("beta", F.lit(j)) * F.col(f"_z{j}") for j in range(d)), F.get("beta", F.lit(d)))
    s, y, p, w = F.col("_s"), F.col("label"), F.col("_p"), F.col("_w")
    axes = [F.col(f"_z{j}") for j in range(d)] + [F.lit(1.0)]
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    sums = {
        "loss": F.sum(w * (F.log1p(F.exp(-F.abs(s))) + F.greatest(s, F.lit(0.0)) - y * s)),
        "g": F.array(*[F.sum(w * (p - y) * a) for a in axes]),
        "h": F.array(*[F.sum(w * p * (1.0 - p) * axes[i] * axes[j]) for i, j in pairs]),
    }
    ridge = np.append(np.full(d, 1.0 / c), 0.0)
    best = np.zeros((len(models), d + 1))
    beta, lowest = best.copy(), np.full(len(models), np.inf)
    for _ in range(max_iter):
        params = [(m, mean[m].tolist(), scale[m].tolist(), beta[m].tolist(), balance[m].tolist()) for m in range(len(models))]
        met = wide.join(wide.sparkSession.createDataFrame(params, schema), "_m")
        met = met.withColumns({f"_z{j}": x for j, x in enumerate(z)}).withColumns({"_s": score, "_w": F.get("w", F.col("label"))})
        met = met.withColumn("_p", 1.0 / (1.0 + F.exp(-s)))
        steepest = 0.0
        for r in met.groupBy("_m").agg(*[x.alias(n) for n, x in sums.items()]).collect():
            m = r["_m"]
            loss = r["loss"] + 0.5 * float(ridge @ beta[m] ** 2)
            if loss > lowest[m] + 1e-12 * abs(lowest[m]):
                beta[m] = 0.5 * (beta[m] + best[m])
                steepest = np.inf
                continue
            best[m], lowest[m] = beta[m], loss
            gradient = np.array(r["g"]) + ridge * beta[m]
            curve = np.zeros((d + 1, d + 1))
            for (i, j), v in zip(pairs, r["h"]):
                curve[i, j] = curve[j, i] = v
            beta[m] = beta[m] - np.linalg.solve(curve + np.diag(ridge), gradient)
            steepest = max(steepest, np.abs(gradient).max() / total[m])
        if steepest <= TOLERANCE:
            break
    return Logits(models, mean, scale, best)


def predict_logistic(fitted: Logits, cells: DataFrame, features: Sequence[str], model: Column | None = None) -> DataFrame:
    """``cells`` (one boolean ``valid``) without its features, with ``prob``: 0 where invalid.

    ``model`` is the left-out fold of the model to use for a row; rows of no model get null.
    """
    kept = [c for c in cells.columns if c not in features]
    at = F.lit(0)
    if model is not None:
        at = F.coalesce(*[F.when(model == F.lit(m), i) for i, m in enumerate(fitted.models) if m is not None])
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), at)
    score = pick(fitted.beta[:, -1])
    for j, f in enumerate(features):
        score = score + pick(fitted.beta[:, j]) * (F.col(f) - pick(fitted.mean[:, j])) / pick(fitted.scale[:, j])
    prob = F.when(F.col("valid"), 1.0 / (1.0 + F.exp(-score))).otherwise(F.lit(0.0))
    return cells.select(*kept, prob.alias("prob"))
