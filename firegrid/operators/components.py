"""Connected components of sparse masks, for all scenes at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions import geo
from firegrid.operators.neighborhood import tile_side
from firegrid.schema import SCENE, GridSpec
from firegrid.session import cut, store


def _spread_minimum(mask: np.ndarray, connectivity: int) -> np.ndarray:
    """Smallest flat position of each cell's component inside one tile."""
    far = mask.size
    flat = np.arange(far).reshape(mask.shape)
    label = np.where(mask, flat, far)
    shifts = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 2 else [])
    while True:
        new = np.pad(label, 1, constant_values=far)
        mid = new[1:-1, 1:-1]
        old = np.pad(label, 1, constant_values=far)
        for i, j in shifts:
            for a, b in ((i, j), (-i, -j)):
                np.minimum(mid, old[1 + a : old.shape[0] - 1 + a, 1 + b : old.shape[1] - 1 + b], out=mid)
        new = np.where(mask, mid, far)
        new[mask] = new.ravel()[new[mask]]
        if np.array_equal(new, label):
            return label
        label = new


def _tile_labels(mask: DataFrame, grid: GridSpec, connectivity: int, keys: Sequence[str]) -> DataFrame:
    """Each cell with ``node``: the smallest cell number of its component within its tile."""
    th, tw = tile_side(grid.h), tile_side(grid.w)
    width = grid.w
    rows = mask.select(*keys, "r", "c")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = rows.columns

    def one_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        top, left = r.min(), c.min()
        block = np.zeros((r.max() - top + 1, c.max() - left + 1), dtype=bool)
        block[r - top, c - left] = True
        at = _spread_minimum(block, connectivity)[r - top, c - left]
        lead_r, lead_c = at // block.shape[1] + top, at % block.shape[1] + left
        return pdf[names].assign(node=lead_r.astype("int64") * width + lead_c)

    tile = [F.floor(F.col("r") / th).alias("_tr"), F.floor(F.col("c") / tw).alias("_tc")]
    return rows.groupBy(*keys, *tile).applyInPandas(one_tile, f"{schema}, node bigint")


def label_components(
    mask: DataFrame, grid: GridSpec, connectivity: int = 1, keys: Sequence[str] = SCENE
) -> DataFrame:
    """Adds ``label``: the smallest cell number of the component (4 neighbours, 8 for 2).

    Tiles of at most 96 x 96 cells are labelled on their own.  A grid of one tile is done then;
    otherwise the pieces that touch across tile borders form a small graph: each round a piece
    takes the smallest label among its neighbours, then the label of that label, until nothing
    moves.  Only the fact that something moved reaches the driver.
    """
    keys = list(keys)
    local = _tile_labels(mask, grid, connectivity, keys)
    th, tw = tile_side(grid.h), tile_side(grid.w)
    if th >= grid.h and tw >= grid.w:
        return local.withColumnRenamed("node", "label")
    cells = cut(local)
    steps = ((1, 0), (0, 1), (1, 1), (1, -1)) if connectivity == 2 else ((1, 0), (0, 1))
    moves = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i, j in steps])
    edge = lambda r, c: (F.floor(r / th), F.floor(c / tw))
    shifted = cells.withColumn("_o", F.explode(moves)).select(
        *keys, (F.col("r") + F.col("_o.dr")).alias("r"), (F.col("c") + F.col("_o.dc")).alias("c"),
        F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("node").alias("other"),
    )
    here, there = edge(F.col("r"), F.col("c")), edge(F.col("_r"), F.col("_c"))
    across = shifted.where((here[0] != there[0]) | (here[1] != there[1])).drop("_r", "_c")
    down = cells.join(across, [*keys, "r", "c"]).select(*keys, "node", "other").distinct()
    links = store(
        down.unionByName(
            down.select(*keys, F.col("other").alias("node"), F.col("node").alias("other"))
        )
    )
    labels = links.select(*keys, "node").distinct().withColumn("label", F.col("node"))
    moving = True
    while moving:
        seen = links.join(labels.withColumnRenamed("node", "other"), [*keys, "other"])
        nearest = seen.groupBy(*keys, "node").agg(F.min("label").alias("_near"))
        hooked = labels.join(nearest, [*keys, "node"]).select(
            *keys, "node", F.col("label").alias("_old"), F.least("label", "_near").alias("_mid")
        )
        parent = hooked.select(*keys, F.col("node").alias("_mid"), F.col("_mid").alias("_up"))
        stepped = store(
            hooked.join(parent, [*keys, "_mid"], "left").select(
                *keys, "node", F.least("_mid", F.coalesce("_up", "_mid")).alias("label"), "_old"
            )
        )
        moving = not stepped.where(F.col("label") != F.col("_old")).isEmpty()
        labels = stepped.drop("_old")
    return (
        cells.join(labels, [*keys, "node"], "left")
        .withColumn("label", F.coalesce("label", "node"))
        .drop("node")
    )


def component_sizes(labelled: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    return labelled.groupBy(*keys, "label").agg(F.count("*").alias("size"))


def filter_by_size(
    mask: DataFrame,
    grid: GridSpec,
    min_cells: int = 1,
    max_cells: int = 0,
    connectivity: int = 1,
    keys: Sequence[str] = SCENE,
) -> DataFrame:
    """Drop components smaller than ``min_cells`` or larger than ``max_cells`` (0 = no limit)."""
    key = [*keys, "r", "c"]
    if min_cells <= 1 and max_cells <= 0:
        return mask.select(*key)
    size = F.count("*").over(Window.partitionBy(*keys, "label"))
    sized = label_components(mask, grid, connectivity, keys).withColumn("_size", size)
    keep = F.col("_size") >= min_cells
    if max_cells > 0:
        keep = keep & (F.col("_size") <= max_cells)
    return sized.where(keep).select(*key)


def component_centroids(
    mask: DataFrame, grid: GridSpec, connectivity: int = 2, keys: Sequence[str] = SCENE
) -> DataFrame:
    """Mean centre and size of each component."""
    labelled = label_components(mask, grid, connectivity, keys)
    return labelled.groupBy(*keys, "label").agg(
        F.avg(geo.center_lat(F.col("r"), grid)).alias("lat"),
        F.avg(geo.center_lon(F.col("c"), grid)).alias("lon"),
        F.count("*").alias("size"),
    )
