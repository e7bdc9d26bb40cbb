"""Arrays to tables and back, and planted scenes."""

from __future__ import annotations

import numpy as np
import pandas as pd

from firegrid.schema import GridSpec


def grid_of(h: int, w: int) -> GridSpec:
    return GridSpec(-8.0, -2.0, -42.0, -36.0, h, w)


def dense(spark, arrays: dict[str, np.ndarray], scene: int = 1, valid: np.ndarray | None = None):
    """Dense table from equally shaped arrays; NaN becomes NULL."""
    first = next(iter(arrays.values()))
    r, c = np.indices(first.shape)
    pdf = pd.DataFrame({"scene_id": scene, "r": r.ravel().astype("int32"), "c": c.ravel().astype("int32")})
    names = ["scene_id int", "r int", "c int"]
    for name, a in arrays.items():
        pdf[name] = pd.Series(a.ravel(), dtype="float64").astype(object).where(~np.isnan(a.ravel()), None)
        names.append(f"{name} double")
    if valid is not None:
        pdf["valid"] = valid.ravel()
        names.append("valid boolean")
    return spark.createDataFrame(pdf.values.tolist(), ", ".join(names))


def cube_of(spark, hours: list[dict[int, np.ndarray]], scene: int = 1):
    parts = None
    for seq, slot in enumerate(hours):
        from pyspark.sql import functions as F

        part = dense(spark, {f"bt{ch}": a for ch, a in slot.items()}, scene).withColumns(
            {"hour": F.lit(16 + seq), "hour_seq": F.lit(seq)}
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts.select("scene_id", "hour", "hour_seq", "r", "c", "bt7", "bt13", "bt14").repartition("scene_id")


def mask_of(spark, a: np.ndarray, scene: int = 1):
    rows = [(scene, int(r), int(c)) for r, c in np.argwhere(a)]
    return spark.createDataFrame(rows, "scene_id int, r int, c int")


def to_array(df, column: str, shape: tuple[int, int]) -> np.ndarray:
    out = np.full(shape, np.nan)
    for row in df.select("r", "c", column).collect():
        out[row["r"], row["c"]] = np.nan if row[column] is None else float(row[column])
    return out


def to_mask(df, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, dtype=bool)
    for row in df.select("r", "c").collect():
        out[row["r"], row["c"]] = True
    return out


def points_of(spark, latlon, scene: int = 1):
    rows = [(scene, float(a), float(b)) for a, b in latlon]
    return spark.createDataFrame(rows, "scene_id int, lat double, lon double")


# Planted scenes.  The first rises steadily from south to north and has small fires strewn over it; the
# second is cool and has one fire front that runs along a bent line.

STREWN = (36, 44)
FRONT = (45, 64)


def strewn_fires(seed: int = 5):
    """Four hours; seven fires of one cell each, none near another."""
    rng = np.random.default_rng(seed)
    truth = np.zeros(STREWN, dtype=bool)
    spots = [(4 + 9 * (k // 4), 5 + 11 * (k % 4)) for k in range(16)]
    for k in rng.permutation(16)[:7]:
        r, c = spots[k]
        truth[r + rng.integers(3), c + rng.integers(3)] = True
    ground = np.linspace(292.0, 293.5, STREWN[0])[:, None] + np.zeros(STREWN)
    hours = []
    for warmth in (0.0, 0.6, 1.1, 0.4):
        bt14 = ground + warmth + rng.normal(0.0, 0.35, STREWN)
        bt13 = bt14 + 2.2 + rng.normal(0.0, 0.1, STREWN)
        bt13[truth] += 13.0
        bt14[truth] += 12.0
        bt7 = bt14 + rng.normal(11.0, 0.7, STREWN)
        bt7[truth] += 1.5
        hours.append({7: bt7, 13: bt13, 14: bt14})
    return hours, truth


def fire_front(seed: int = 17):
    """Three hours; a front four cells deep that bends halfway."""
    rng = np.random.default_rng(seed)
    r, c = np.indices(FRONT)
    line = 12 + np.abs(c - 30) // 2
    truth = (r >= line) & (r < line + 4) & (c >= 8) & (c < 54)
    hours = []
    for _ in range(3):
        bt13 = 279.0 + rng.normal(0.0, 0.5, FRONT) + np.where(truth, 21.0 + rng.normal(0.0, 0.4, FRONT), 0.0)
        bt14 = bt13 - 3.0
        bt7 = bt13 + np.where(truth, 18.0, 3.0) + rng.normal(0.0, 0.3, FRONT)
        hours.append({7: bt7, 13: bt13, 14: bt14})
    return hours, truth
