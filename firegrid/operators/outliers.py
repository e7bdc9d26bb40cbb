"""Outlier detectors over per-cell features, every scene in the same job.

Isolation forest: every draw is a hash of what it is drawn for, so any attempt grows the same
trees; blocks of 25 trees grow level by level from samples, scoring runs per chunk of cells.  Local outlier factor: exact neighbours through a nearest-neighbour join pruned by boxes.
Robust envelope: concentration steps as grouped moments.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions import stats
from firegrid.schema import SCENE
from firegrid.session import cut, store

KEY = ("scene_id", "r", "c")

# Feature order and defaults of the outlier layer.
OUTLIER_FEATURES = ("twin_risk", "bt13_max", "bt7_max", "btd_median", "bt13_anom_21", "persist_h")
MIN_ROWS = 50
BLOCK_ROWS = 1024
# Numbers of 2^4 tree nodes, some 8 blocks, travel together.
GROUP_BITS = 4
CHUNK_ROWS = 16384
TREE_SAMPLE = 256
TREE_BLOCK = 25
PRIME = (1 << 31) - 1
# Path lengths are added up in whole units, so that no order of summing changes a score.
PATH_UNIT = 1 << 20


@dataclass(frozen=True)
class OutlierConfig:
    method: str = "isolation_forest"
    contamination: float = 0.02
    neighbors: int = 24
    trees: int = 200
    seed: int = 42
    min_agree: int = 2
    features: tuple[str, ...] = OUTLIER_FEATURES


def scale_features(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SCENE) -> DataFrame:
    """Zero mean and unit population deviation per group; a constant column keeps deviation 1."""
    w = Window.partitionBy(*keys)
    moments = df.withColumns(
        {f"_mean_{c}": F.avg(c).over(w) for c in columns}
        | {f"_std_{c}": F.stddev_pop(c).over(w) for c in columns}
    )
    scaled = {
        c: (F.col(c) - F.col(f"_mean_{c}"))
        / F.when(F.col(f"_std_{c}") > 0, F.col(f"_std_{c}")).otherwise(F.lit(1.0))
        for c in columns
    }
    return moments.withColumns(scaled).drop(*[f"_{k}_{c}" for c in columns for k in ("mean", "std")])


# ---------------------------------------------------------------- isolation forest


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=np.float64)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, big))


def _mixed(h: Column, x: Column) -> Column:
    """Next state of a hash below 2^31 - 1 after ``x``; products stay within 64 bits."""
    t = (h * 48271 + F.pmod(x.cast("long"), F.lit(PRIME))) % PRIME
    return (t * t + 12345) % PRIME


def _drawn(seed: int, tree: Column, x: Column) -> Column:
    """Number from 0 to 2^31 - 2 that belongs to (seed, tree, x)."""
    start = _mixed(F.lit(seed).cast("long"), tree * 69621 + 1)
    return _mixed(_mixed(start, x), F.lit(7))


def _sample_rows(df: DataFrame, trees: int, seed: int) -> DataFrame:
    """Up to 256 rows per (scene, tree), without replacement, and ``sample``, their number.

    A threshold on the draw thins the copies before anything moves; the exact count comes from
    ranking the few that remain, at most 512 on average.
    """
    n = df.groupBy(*SCENE).agg(F.count("*").alias("_n"))
    cells = df.withColumn("_cell", _mixed(_mixed(F.lit(0).cast("long"), F.col("r") + 1), F.col("c") + 1))
    draws = (
        cells.join(n, "scene_id")
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("_u", _drawn(seed, F.col("tree"), F.col("_cell")))
        .where(F.col("_u") * F.col("_n") < 2 * TREE_SAMPLE * PRIME)
        .withColumn("block", F.floor(F.col("tree") / TREE_BLOCK).cast("int"))
        .repartition("scene_id", "block")
    )
    order = Window.partitionBy("scene_id", "block", "tree").orderBy("_u", "r", "c")
    kept = draws.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= TREE_SAMPLE)
    return kept.withColumn("sample", F.least(F.col("_n"), F.lit(TREE_SAMPLE)).cast("int")).drop("_k", "_u", "_n", "_cell")


def _draws(seed: int, tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """:func:`_drawn` for arrays."""
    h = np.full(len(tree), seed, dtype=np.int64)
    for v in (tree * 69621 + 1, x, np.int64(7)):
        t = (h * 48271 + v % PRIME) % PRIME
        h = (t * t + 12345) % PRIME
    return h


def _grow_trees(x: np.ndarray, tree: np.ndarray, limit: int, seed: int) -> pd.DataFrame:
    """Random axis-parallel splits of several trees at once, level by level; one row per node.

    ``x`` holds the sampled rows and ``tree`` the tree of each.  Every level finds the ends of all
    open nodes together, draws a feature that varies and a cut between its ends, and passes the
    rows on.
    """
    tree = tree.astype(np.int64)
    node = np.ones(len(x), dtype=np.int64)
    grown = []
    for depth in range(limit + 1):
        order = np.lexsort((node, tree))
        x, tree, node = x[order], tree[order], node[order]
        start = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (node[1:] != node[:-1])])
        count = np.diff(np.r_[start, len(x)])
        own, number = tree[start], node[start]
        low, high = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
        varies = high > low
        split = (count > 1) & varies.any(axis=1) & (depth < limit)
        which = _draws(seed, own, 2 * number) % np.maximum(varies.sum(axis=1), 1)
        feature = np.argmax(np.cumsum(varies, axis=1) > which[:, None], axis=1)
        at = np.arange(len(start))
        lo, hi = low[at, feature], high[at, feature]
        cut_at = lo + _draws(seed, own, 2 * number + 1) / PRIME * (hi - lo)
        cut_at = np.where(cut_at < hi, cut_at, lo)
        length = depth * PATH_UNIT + np.round(average_path(count) * PATH_UNIT).astype(np.int64)
        grown.append(
            pd.DataFrame(
                {
                    "tree": own, "node": number, "feature": np.where(split, feature, -1),
                    "cut": np.where(split, cut_at, 0.0), "units": np.where(split, 0, length),
                }
            )
        )
        if not split.any():
            break
        keep = np.repeat(split, count)
        slot = np.repeat(at, count)[keep]
        x, tree, node = x[keep], tree[keep], node[keep]
        node = 2 * node + (x[np.arange(len(x)), feature[slot]] > cut_at[slot])
    return pd.concat(grown)


def isolation_forest(df: DataFrame, columns: Sequence[str], trees: int = 200, seed: int = 42) -> DataFrame:
    """Nodes of one forest per scene: (scene_id, tree, node, feature, cut, units, sample).

    Node 1 is the root, 2k and 2k + 1 are the children of k; rows above ``cut`` go to the second.
    A leaf has feature -1 and in ``units`` its depth, corrected for the rows it still holds.  The
    feature of a split is drawn among those that vary in the node, the cut between their ends.
    A task grows the 25 trees of a block, at most 6,400 sampled rows, whatever the scene's size.
    """
    columns = list(columns)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = int(pdf["sample"].iloc[0])
        limit = math.ceil(math.log2(max(sample, 1)))
        nodes = _grow_trees(pdf[columns].to_numpy(dtype=np.float64), pdf["tree"].to_numpy(), limit, seed)
        return nodes.assign(scene_id=pdf["scene_id"].iloc[0], sample=sample)[
            ["scene_id", "tree", "node", "feature", "cut", "units", "sample"]
        ]

    scene_type = df.schema["scene_id"].dataType.simpleString()
    return _sample_rows(df.select(*KEY, *columns), trees, seed).groupBy("scene_id", "block").applyInPandas(
        grow, f"scene_id {scene_type}, tree int, node int, feature int, cut double, units bigint, sample int"
    )


def _chunk_counts(df: DataFrame) -> DataFrame:
    """(scene_id, _chunks): tasks of about ``CHUNK_ROWS`` rows that the counted scene needs."""
    rows = df.groupBy(*SCENE).agg(F.count("*").alias("_rows"))
    return rows.select("scene_id", F.ceil(F.col("_rows") / CHUNK_ROWS).cast("int").alias("_chunks"))


def _into_chunks(df: DataFrame, chunks: DataFrame, by: Sequence[str] = ("r", "c")) -> DataFrame:
    spread = F.pmod(F.xxhash64(*by), F.col("_chunks").cast("bigint")).cast("int")
    return df.join(chunks, "scene_id").withColumn("_chunk", spread).drop("_chunks")


def isolation_scores(df: DataFrame, columns: Sequence[str], trees: int = 200, seed: int = 42) -> DataFrame:
    """Adds ``iso_score`` in 0..1, higher = more isolated.  Scene ids may be of any type.

    A forest is at most ``trees`` x 511 nodes, copied to each chunk of its scene.
    """
    columns = list(columns)
    forest = isolation_forest(df, columns, trees, seed)
    chunks = _chunk_counts(df)
    chunked = _into_chunks(df, chunks)
    copies = forest.join(chunks, "scene_id").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    copies = copies.drop("_chunks")
    names = df.columns

    def score(cells: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty or cells.empty:
            return cells[names].assign(iso_score=0.5)
        x = cells[columns].to_numpy(dtype=np.float64)
        every = np.arange(len(x))
        owner, slot = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        shape = int(owner.max()) + 1, int(slot.max()) + 1
        feature, split, units = np.full(shape, -1), np.zeros(shape), np.zeros(shape, dtype=np.int64)
        feature[owner, slot], split[owner, slot], units[owner, slot] = nodes["feature"], nodes["cut"], nodes["units"]
        total = np.zeros(len(x), dtype=np.int64)
        for f_, s_, u_ in zip(feature, split, units):
            at = np.ones(len(x), dtype=np.int64)
            while (f_[at] >= 0).any():
                f = f_[at]
                at = np.where(f >= 0, 2 * at + (x[every, np.maximum(f, 0)] > s_[at]), at)
            total += u_[at]
        norm = len(np.unique(owner)) * max(float(average_path(float(nodes["sample"].iloc[0]))), 1e-12)
        return cells[names].assign(iso_score=np.power(2.0, -(total / PATH_UNIT) / norm))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return (
        chunked.groupBy("scene_id", "_chunk")
        .cogroup(copies.groupBy("scene_id", "_chunk"))
        .applyInPandas(score, f"{fields}, iso_score double")
    )


# ---------------------------------------------------------------- local outlier factor


def _nearest(queries: np.ndarray, points: np.ndarray, same: np.ndarray | None, k: int):
    """Indices and distances of the ``k`` nearest points; equal distances keep point order.

    A matrix product with its rounding bound tells which points can be among them; only those are
    compared feature by feature, so the distances do not depend on the product.
    """
    rough = (queries * queries).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2.0 * (queries @ points.T)
    least = min(k, len(points))
    if not least or not np.isfinite(rough).all():
        wanted = np.ones(rough.shape, dtype=bool)
    else:
        if same is not None:
            rough[same] = np.inf
        scale = (queries * queries).sum(axis=1) + (points * points).sum(axis=1).max()
        error = 8.0 * (points.shape[1] + 4) * np.finfo(np.float64).eps * scale
        wanted = rough <= (np.partition(rough, least - 1, axis=1)[:, least - 1] + 2.0 * error)[:, None]
    if same is not None:
        wanted[same] = False
    row, col = np.nonzero(wanted)
    d2 = np.zeros(len(row))
    for f in range(points.shape[1]):
        d2 += (queries[row, f] - points[col, f]) ** 2
    count = wanted.sum(axis=1)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    width = max(int(count.max(initial=0)), least)
    near, dist = np.zeros((len(queries), width), dtype=np.int64), np.full((len(queries), width), np.inf)
    near[row, at], dist[row, at] = col, d2
    idx = np.argsort(dist, axis=1, kind="stable")[:, :least]
    return np.take_along_axis(near, idx, axis=1), np.sqrt(np.take_along_axis(dist, idx, axis=1))


def _pieces(n: int, against: int):
    """Slices of ``n`` queries whose distances to ``against`` points take some 16 MB."""
    size = min(max((1 << 21) // max(against, 1), 16), 512)
    return [slice(s, min(s + size, n)) for s in range(0, n, size)]


def _split_space(x: np.ndarray, leaves: int) -> list[tuple[int, int, float, int, int]]:
    """(node, axis, cut, left, right) of a binary split of space into ``leaves`` or a few more parts.

    Each part is halved at the median of its widest axis; axis -1 marks a leaf.
    """
    nodes: list[tuple[int, int, float, int, int]] = []
    fresh, todo = 1, [(0, x, leaves)]
    while todo:
        node, part, want = todo.pop()
        spread = np.ptp(part, axis=0) if len(part) else np.zeros(0)
        axis = int(spread.argmax()) if want > 1 and spread.size and spread.max() > 0 else -1
        at = float(np.median(part[:, axis])) if axis >= 0 else 0.0
        if axis >= 0 and not (part[:, axis] > at).any():
            at = float(part[part[:, axis] < at, axis].max())  # most rows lie on the upper edge
        if axis < 0:
            nodes.append((node, -1, 0.0, -1, -1))
            continue
        nodes.append((node, axis, at, fresh, fresh + 1))
        low = part[:, axis] <= at
        todo += [(fresh, part[low], want // 2), (fresh + 1, part[~low], want - want // 2)]
        fresh += 2
    return sorted(nodes)


def _blocks(points: DataFrame, xs: Sequence[str]) -> DataFrame:
    """``points`` with ``block`` and ``part``: regions of about ``BLOCK_ROWS`` rows, split over all features.

    The regions come from a hash sample of the scene (16 rows a region).  A region that stays too
    large, as copies cannot be told apart, is dealt to parts of that size by the hash of the row.
    """
    scene_type = points.schema["scene_id"].dataType.simpleString()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    names = points.columns
    rows = points.groupBy(*SCENE).agg(F.count("*").alias("_rows"))
    share = F.greatest(F.lit(16.0 / BLOCK_ROWS), 4096.0 / F.col("_rows"))
    drawn = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        leaves = math.ceil(int(pdf["_rows"].iloc[0]) / BLOCK_ROWS)
        nodes = pd.DataFrame(_split_space(pdf.sort_values("id")[list(xs)].to_numpy(), leaves), columns=["node", "axis", "cut", "lo", "hi"])
        nodes.insert(0, "scene_id", pdf["scene_id"].iloc[0])
        return nodes

    tree_type = f"scene_id {scene_type}, node int, axis int, cut double, lo int, hi int"
    trees = points.join(rows, "scene_id").where(drawn).groupBy("scene_id").applyInPandas(split, tree_type)
    chunks = _chunk_counts(points)
    copies = trees.join(chunks, "scene_id").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))

    def place(pdf: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        axis, at, lo, hi = (nodes[c].to_numpy() for c in ("axis", "cut", "lo", "hi"))
        x = pdf[list(xs)].to_numpy()
        node = np.zeros(len(x), dtype=np.int64)
        while len(x) and len(axis) and (axis[node] >= 0).any():
            a = axis[node]
            down = np.where(x[np.arange(len(x)), np.maximum(a, 0)] <= at[node], lo[node], hi[node])
            node = np.where(a >= 0, down, node)
        return pdf[names].assign(block=node)

    placed = cut(
        _into_chunks(points, chunks, ("id",))
        .groupBy("scene_id", "_chunk")
        .cogroup(copies.drop("_chunks").groupBy("scene_id", "_chunk"))
        .applyInPandas(place, f"{fields}, block int")
    )
    sizes = placed.groupBy("scene_id", "block").agg(F.ceil(F.count("*") / (4 * BLOCK_ROWS)).alias("_parts"))
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    return placed.join(sizes, ["scene_id", "block"]).withColumn("part", part).drop("_parts")


def nearest_neighbors(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Exact k nearest rows of the same scene: (scene_id, id, nid, dist); equal distances keep id order.

    ``id`` packs (r, c) into 64 bits.  Rows are cut into blocks by all features.  A first pass inside
    each block bounds the k-th distance; blocks whose boxes lie within a block's largest bound are
    paired, some 8 neighbouring blocks of each side in one visit, and only rows that can reach the boxes
    of a visit travel.  So a task holds two groups of blocks and gives at most k rows per row and visit,
    none beyond the row's bound, never all pairs.  A row whose k nearest are its own copies visits no
    other group.
    """
    columns = list(columns)
    scene_type = df.schema["scene_id"].dataType.simpleString()
    xs = [f"x{i}" for i in range(len(columns))]
    xdef = ", ".join(f"{x} double" for x in xs)
    points = cut(
        df.select(
            "scene_id",
            (F.shiftleft(F.col("r").cast("bigint"), 32) + F.col("c")).alias("id"),
            *[F.col(c).cast("double").alias(x) for c, x in zip(columns, xs)],
        )
    )
    points = cut(_blocks(points, xs))
    home = ["scene_id", "block", "part"]

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[xs].to_numpy()
        reach = np.full(len(x), np.inf)
        if len(x) > k:
            for s in _pieces(len(x), len(x)):
                rows = np.arange(s.start, s.stop)
                same = (np.arange(len(rows)), rows)
                reach[s] = _nearest(x[s], x, same, k)[1][:, -1]
        return pdf.assign(reach=reach)

    bounded = cut(
        points.select("scene_id", "id", *xs, "block", "part")
        .groupBy(*home)
        .applyInPandas(bound, f"scene_id {scene_type}, id bigint, {xdef}, block int, part int, reach double")
    )
    # Rounding must not hide a block that touches the bound.
    slack = F.col("reach") * (1.0 + 1e-9) + 1e-12
    boxes = cut(
        bounded.groupBy(*home).agg(
            *[F.min(x).alias(f"lo_{x}") for x in xs], *[F.max(x).alias(f"hi_{x}") for x in xs], F.max("reach").alias("reach")
        )
    )
    there = boxes.select(
        "scene_id", F.col("block").alias("to_block"), F.col("part").alias("to_part"),
        *[F.col(f"{e}_{x}").alias(f"{e}_to_{x}") for x in xs for e in ("lo", "hi")],
    )
    zero = F.lit(0.0)
    gaps = [F.greatest(F.col(f"lo_to_{x}") - F.col(f"hi_{x}"), F.col(f"lo_{x}") - F.col(f"hi_to_{x}"), zero) for x in xs]
    apart = F.sqrt(sum((g * g for g in gaps), zero))
    own = (F.col("block") == F.col("to_block")) & (F.col("part") == F.col("to_part"))
    group, to_group = F.shiftright("block", GROUP_BITS), F.shiftright("to_block", GROUP_BITS)
    pairs = cut(boxes.join(there, "scene_id").where(own | ((F.col("reach") > 0) & (apart <= slack))).select(
        *home, "to_block", "to_part", group.alias("group"), to_group.alias("to_group"), own.alias("own"), *[f"{e}_to_{x}" for x in xs for e in ("lo", "hi")]
    ))
    visit = ["scene_id", "group", "part", "to_group", "to_part"]
    boxed = pairs.groupBy("block", *visit).agg(
        F.bool_or("own").alias("own"), *[F.min(f"lo_to_{x}").alias(f"lo_to_{x}") for x in xs], *[F.max(f"hi_to_{x}").alias(f"hi_to_{x}") for x in xs]
    )
    gaps = [F.greatest(F.col(f"lo_to_{x}") - F.col(x), F.col(x) - F.col(f"hi_to_{x}"), zero) for x in xs]
    apart = F.sqrt(sum((g * g for g in gaps), zero))
    visits = bounded.join(boxed, home).where(F.col("own") | ((F.col("reach") > 0) & (apart <= slack))).select(*visit, "id", *xs, "reach")
    hosts = points.withColumnsRenamed({"block": "to_block", "part": "to_part"}).join(
        pairs.select(*visit, "to_block").distinct(), ["scene_id", "to_block", "to_part"]
    )
    # Names of their own: both sides come from the same pairs.
    hosts = hosts.select(*[F.col(c).alias(c) for c in (*visit, "id", *xs)])

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        pid, px = p["id"].to_numpy(), p[xs].to_numpy()
        qid, qx, reach = q["id"].to_numpy(), q[xs].to_numpy(), q["reach"].to_numpy()
        out = []
        for s in _pieces(len(qid), len(pid)):
            here = np.searchsorted(pid, qid[s])
            own = pid[np.minimum(here, len(pid) - 1)] == qid[s] if len(pid) else np.zeros(0, bool)
            same = (np.flatnonzero(own), here[own])
            idx, dist = _nearest(qx[s], px, same, k)
            close = (np.isfinite(dist) & (dist <= reach[s][:, None])).ravel()
            out.append(pd.DataFrame({"id": np.repeat(qid[s], idx.shape[1])[close], "nid": pid[idx].ravel()[close], "dist": dist.ravel()[close]}))
        res = pd.concat(out) if out else pd.DataFrame({"id": [], "nid": [], "dist": []})
        res.insert(0, "scene_id", q["scene_id"].iloc[0] if len(q) else None)
        return res

    found = (
        visits.groupBy(*visit)
        .cogroup(hosts.groupBy(*visit))
        .applyInPandas(search, f"scene_id {scene_type}, id bigint, nid bigint, dist double")
    )
    best = Window.partitionBy("scene_id", "id").orderBy("dist", "nid")
    return found.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k).drop("_k")


def local_outlier_factor(df: DataFrame, columns: Sequence[str], neighbors: int = 24) -> DataFrame:
    """Adds ``lof``.  The neighbour count is clamped to [5, rows - 1] of the scene."""
    k = max(5, int(neighbors))
    near = cut(nearest_neighbors(df, columns, k))
    kdist = near.groupBy("scene_id", "id").agg(F.max("dist").alias("kdist"))
    reach = near.join(kdist.withColumnRenamed("id", "nid"), ["scene_id", "nid"])
    lrd = reach.groupBy("scene_id", "id").agg(
        (1.0 / (F.avg(F.greatest("dist", "kdist")) + 1e-10)).alias("lrd")
    )
    around = near.join(lrd.withColumnsRenamed({"id": "nid", "lrd": "nlrd"}), ["scene_id", "nid"])
    mean = around.groupBy("scene_id", "id").agg(F.avg("nlrd").alias("mean_lrd"))
    factor = mean.join(lrd, ["scene_id", "id"]).select(
        "scene_id",
        F.shiftright("id", 32).cast("int").alias("r"),
        F.col("id").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("c"),
        (F.col("mean_lrd") / F.col("lrd")).alias("lof"),
    )
    return df.join(factor, list(KEY))


# ---------------------------------------------------------------- robust envelope


def chi2_quantile(p_z: float, dof: int) -> float:
    """Wilson-Hilferty approximation from the standard normal quantile ``p_z``."""
    a = 2.0 / (9.0 * dof)
    return dof * (1.0 - a + p_z * math.sqrt(a)) ** 3


def _moment_columns(xs: Sequence[str], chosen: Column) -> list[Column]:
    cols = [F.count_if(chosen).alias("m")]
    cols += [F.avg(F.when(chosen, F.col(x))).alias(f"mu_{i}") for i, x in enumerate(xs)]
    for i, a in enumerate(xs):
        for j in range(i, len(xs)):
            pair = F.covar_pop(F.when(chosen, F.col(a)), F.when(chosen, F.col(xs[j])))
            cols.append(pair.alias(f"s_{i}_{j}"))
    return cols


def _inverted(moments: DataFrame, p: int) -> DataFrame:
    """One small row per scene: mean, inverse covariance and log-determinant (NULL if singular)."""

    def invert(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                s = np.array([[rec[f"s_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
                sign, logdet = np.linalg.slogdet(s) if np.isfinite(s).all() else (0.0, np.nan)
                if sign <= 0 or logdet < -200:
                    continue
                mu = [float(rec[f"mu_{i}"]) for i in range(p)]
                rows.append((rec["scene_id"], mu, np.linalg.inv(s).ravel().tolist(), float(logdet)))
            yield pd.DataFrame(rows, columns=["scene_id", "mu", "inv", "logdet"])

    scene_type = moments.schema["scene_id"].dataType.simpleString()
    return moments.mapInPandas(
        invert, f"scene_id {scene_type}, mu array<double>, inv array<double>, logdet double"
    )


def _mahalanobis(xs: Sequence[str]) -> Column:
    p = len(xs)
    d = [F.col(x) - F.get("mu", F.lit(i)) for i, x in enumerate(xs)]
    total = F.lit(0.0)
    for i in range(p):
        inner = F.lit(0.0)
        for j in range(p):
            inner = inner + F.get("inv", F.lit(i * p + j)) * d[j]
        total = total + d[i] * inner
    return total


def envelope_distance(df: DataFrame, columns: Sequence[str], max_steps: int = 30) -> DataFrame:
    """Adds ``envelope``: squared distance under a minimum-covariance fit of each scene.

    Starts from the half of rows nearest the coordinate medians, repeats "fit, keep the h
    nearest" until no determinant falls, then reweights once.  Each step is one grouped
    aggregation for all scenes.  Scenes with a singular fit are left out.
    """
    xs = list(columns)
    p = len(xs)
    data = cut(df)
    med = data.groupBy("scene_id").agg(*[F.percentile(x, F.lit(0.5)).alias(f"_m{i}") for i, x in enumerate(xs)])
    spread = sum((F.abs(F.col(x) - F.col(f"_m{i}")) for i, x in enumerate(xs)), F.lit(0.0))
    dist = data.join(med, "scene_id").withColumn("d2", spread).drop(*[f"_m{i}" for i in range(p)])
    whole = Window.partitionBy(*SCENE)
    order = whole.orderBy("d2", "r", "c")

    def half(frame: DataFrame) -> DataFrame:
        need = F.floor((F.count("*").over(whole) + p + 1) / 2)
        return frame.withColumn("_in", F.row_number().over(order) <= need)

    fit = store(_inverted(half(dist).groupBy("scene_id").agg(*_moment_columns(xs, F.col("_in"))), p))
    for _ in range(max_steps):
        dist = data.join(fit, "scene_id").withColumn("d2", _mahalanobis(xs)).drop("mu", "inv", "logdet")
        nxt = store(_inverted(half(dist).groupBy("scene_id").agg(*_moment_columns(xs, F.col("_in"))), p))
        gain = nxt.join(fit.select("scene_id", F.col("logdet").alias("_was")), "scene_id")
        settled = gain.where(F.col("logdet") < F.col("_was") - 1e-9).isEmpty()
        fit = nxt
        if settled:
            break
    raw = data.join(fit, "scene_id").withColumn("d2", _mahalanobis(xs)).drop("mu", "inv", "logdet")
    # Normal quantiles 0.5 and 0.975.
    scale = F.percentile("d2", F.lit(0.5)).over(whole) / chi2_quantile(0.0, p)
    near = raw.withColumn("_in", F.col("d2") / scale < chi2_quantile(1.959964, p))
    final = store(_inverted(near.groupBy("scene_id").agg(*_moment_columns(xs, F.col("_in"))), p))
    return data.join(final, "scene_id").withColumn("envelope", _mahalanobis(xs)).drop("mu", "inv", "logdet")


# ---------------------------------------------------------------- masks


def above_share(df: DataFrame, score: str, contamination: float, group_rows: int | None = None) -> DataFrame:
    """Rows strictly beyond the percentile that leaves ``contamination`` outside."""
    cont = min(max(contamination, 0.001), 0.5)
    cut_at = stats.with_quantiles(df, SCENE, {"_cut": (-F.col(score), cont)}, group_rows)
    return cut_at.where(-F.col(score) < F.col("_cut")).select(*KEY)


METHODS = ("isolation_forest", "local_outlier_factor", "elliptic_envelope")


def outlier_masks(
    features: DataFrame,
    methods: Sequence[str],
    contaminations: Sequence[float],
    cfg: OutlierConfig = OutlierConfig(),
    group_rows: int | None = None,
) -> DataFrame:
    """Outlying valid cells per method and contamination: (scene_id, r, c, method, contamination).

    A method is fitted once, as its score does not depend on the contamination; one pass finds all
    thresholds.  The ensemble counts the votes of the three methods.  Scenes with fewer than 50
    valid cells give none.
    """
    missing = [f for f in cfg.features if f not in features.columns]
    if missing:
        raise KeyError(f"unknown features {missing}")
    unknown = [m for m in methods if m not in (*METHODS, "ensemble")]
    if unknown:
        raise ValueError(f"unknown outlier method: {unknown[0]}")
    cols = list(cfg.features)
    pool = features.where("valid").select(*KEY, *cols)
    pool = pool.withColumn("_n", F.count("*").over(Window.partitionBy(*SCENE))).where(F.col("_n") >= MIN_ROWS)
    scaled = cut(scale_features(pool.drop("_n"), cols))

    def scores(method: str) -> DataFrame:
        if method == "isolation_forest":
            found = isolation_scores(scaled, cols, cfg.trees, cfg.seed).withColumnRenamed("iso_score", "_score")
        elif method == "local_outlier_factor":
            found = local_outlier_factor(scaled, cols, cfg.neighbors).withColumnRenamed("lof", "_score")
        else:
            found = envelope_distance(scaled, cols).withColumnRenamed("envelope", "_score")
        return found.select(*KEY, "_score")

    def beyond(method: str) -> DataFrame:
        shares = {f"_cut{i}": (-F.col("_score"), min(max(c, 0.001), 0.5)) for i, c in enumerate(contaminations)}
        placed = stats.with_quantiles(cut(scores(method)), SCENE, shares, group_rows)
        hit = [F.when(-F.col("_score") < F.col(f"_cut{i}"), F.lit(float(c))) for i, c in enumerate(contaminations)]
        hits = F.explode(F.filter(F.array(*hit), lambda c: c.isNotNull())).alias("contamination")
        return placed.select(*KEY, F.lit(method).alias("method"), hits)

    votes = cut(reduce(DataFrame.unionByName, [beyond(m) for m in METHODS if m in methods or "ensemble" in methods]))
    own = votes.where(F.col("method").isin(*methods))
    if "ensemble" not in methods:
        return own
    agreed = votes.groupBy(*KEY, "contamination").agg(F.count("*").alias("_votes")).where(F.col("_votes") >= cfg.min_agree)
    return own.unionByName(agreed.select(*KEY, F.lit("ensemble").alias("method"), "contamination"))


def outlier_mask(
    features: DataFrame, cfg: OutlierConfig = OutlierConfig(), group_rows: int | None = None
) -> DataFrame:
    """Outlying valid cells in feature space.  Scenes with fewer than 50 valid cells give none."""
    return outlier_masks(features, (cfg.method,), (cfg.contamination,), cfg, group_rows).select(*KEY)


def keep_outliers(
    candidates: DataFrame, features: DataFrame, cfg: OutlierConfig = OutlierConfig(), group_rows: int | None = None
) -> DataFrame:
    """Candidate cells that are outliers too."""
    out = outlier_mask(features, cfg, group_rows)
    return candidates.select(*KEY).join(out, list(KEY), "left_semi")
