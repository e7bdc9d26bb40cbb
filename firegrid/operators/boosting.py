"""Gradient-boosted trees on binned features, several models at once over one table.

Rows carry a fold; model ``k`` of a leave-one-out set trains on the rows of every other fold. Each
level of each round is one pass over the rows in which a task adds up gradients, second derivatives
and counts by (model, node, feature, bin), whatever the number of models; the driver sees those sums
and picks the splits. Features are binned once. Margins are kept as a column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.session import cut

#: Rows that bin edges are taken from: all up to this many, beyond that a share drawn by hash.
EDGE_ROWS = 200_000
#: Rounds after which the margins are written anew; the trees since then are applied on the fly.
ROUNDS_PER_CUT = 25
#: Rows a task should have at least, and tasks whose sums go to the driver as they are.
TASK_ROWS = 50_000
DIRECT = 32


@dataclass(frozen=True)
class BoostingConfig:
    depth: int = 4
    rate: float = 0.07
    rounds: int = 200
    bins: int = 255
    min_leaf: int = 20
    min_hessian: float = 1e-3


@dataclass
class Trees:
    """Complete trees of one depth: [round, model, node] features and bins, [round, model, leaf] values."""

    models: list
    edges: list[np.ndarray]
    depth: int
    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray

    def leaf(self, binned: np.ndarray, t: int, k: int, depth: int | None = None) -> np.ndarray:
        """The node of each row at ``depth`` (of the leaves without), counted from 0 within its level."""
        node = np.zeros(len(binned), np.int64)
        each = np.arange(len(binned))
        for level in range(self.depth if depth is None else depth):
            at = node + (1 << level) - 1
            node = 2 * node + (binned[each, self.feature[t, k, at]] > self.split[t, k, at])
        return node

    def margin(self, binned: np.ndarray, k: int, rounds: range) -> np.ndarray:
        out = np.zeros(len(binned))
        for t in rounds:
            out += self.value[t, k, self.leaf(binned, t, k)]
        return out

    def bin(self, x: np.ndarray) -> np.ndarray:
        """Bins of raw feature values: how many edges lie below each."""
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1).astype(np.int16)


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int, n: int) -> list[np.ndarray]:
    """Distinct quantiles of each feature, interpolated, over a bounded number of rows."""
    if n > EDGE_ROWS:
        rows = rows.where(F.pmod(F.xxhash64(*features), F.lit(1 << 30)) < (EDGE_ROWS << 30) // n)
    levels = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.agg(*[F.percentile(f, levels).alias(f) for f in features]).first()
    return [np.unique(np.array(found[f] or [], float)) for f in features]


def _columns(batch: pa.RecordBatch, width: int, models: int) -> tuple[np.ndarray, ...]:
    bins = batch.column(0).flatten().to_numpy().reshape(-1, width)
    margins = batch.column(1).flatten().to_numpy().reshape(-1, models)
    return bins, margins, batch.column(2).to_numpy(), batch.column(3).to_numpy()


def fit_trees(
    rows: DataFrame,
    features: Sequence[str],
    cfg: BoostingConfig = BoostingConfig(),
    fold: Column | None = None,
    models: Sequence[int | None] = (None,),
) -> Trees:
    """Fit one model per entry of ``models`` on ``rows`` (features and a 0 / 1 ``label``).

    Model ``k`` leaves the rows of fold ``k`` out, ``None`` leaves none out. Classes are balanced by weight
    within each model. Splits of equal gain (to nine digits) go to the first feature and the lowest bin.
    The driver sees sums: models x nodes of a level x features x bins, whatever the number of rows.
    """
    if cfg.bins > 1 << 14:
        raise ValueError("at most 16384 bins")
    width, models = len(features), list(models)
    fold = F.lit(-1) if fold is None else fold
    table = rows.select(*features, F.col("label").cast("int").alias("label"), fold.cast("int").alias("fold"))
    counts = table.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()  # two rows a fold
    weight = np.zeros((len(models), 2))
    for k, left_out in enumerate(models):
        n = np.array([sum(r["n"] for r in counts if r["label"] == y and r["fold"] != left_out) for y in (0, 1)], float)
        if not n.all():
            raise ValueError("training needs cells of both classes")
        weight[k] = n.sum() / (2 * n)
    total = sum(r["n"] for r in counts)
    trees = Trees(
        models, bin_edges(table, features, cfg.bins, total), cfg.depth,
        np.zeros((cfg.rounds, len(models), (1 << cfg.depth) - 1), np.int64),
        np.full((cfg.rounds, len(models), (1 << cfg.depth) - 1), 1 << 15, np.int64),
        np.zeros((cfg.rounds, len(models), 1 << cfg.depth)),
    )
    zeros = F.array(*[F.lit(0.0)] * len(models))
    state = _settle(_binned(table, features, trees), zeros, total)
    tasks = state.rdd.getNumPartitions()
    left_out = [np.iinfo(np.int32).min if m is None else m for m in models]
    first = 0
    for t in range(cfg.rounds):
        if t - first == ROUNDS_PER_CUT:
            state = cut(_advance(state, trees, range(first, t), width))
            first = t
        for level in range(cfg.depth):
            sums = _sums(state, tasks, trees, t, level, first, width, cfg.bins, weight, left_out)
            _split_level(trees, t, level, sums, cfg)
    return trees


def _binned(table: DataFrame, features: Sequence[str], trees: Trees) -> DataFrame:
    edges = Trees(trees.models, trees.edges, 0, *[np.zeros(0)] * 3)
    schema = pa.schema([("bins", pa.list_(pa.int16())), ("label", pa.int32()), ("fold", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], 1)
            at = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.array(edges.bin(x).ravel(), pa.int16()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(len(features)), batch.column(len(features) + 1)], schema=schema)

    return table.mapInArrow(task, "bins array<smallint>, label int, fold int")


def _settle(binned: DataFrame, margins: Column, total: int) -> DataFrame:
    ready = binned.select("bins", margins.alias("margins"), "label", "fold")
    tasks = max(1, min(ready.rdd.getNumPartitions(), -(-total // TASK_ROWS)))
    return cut(ready.coalesce(tasks))


def _advance(state: DataFrame, trees: Trees, rounds: range, width: int) -> DataFrame:
    n = len(trees.models)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, margins, _, _ = _columns(batch, width, n)
            new = margins + np.stack([trees.margin(bins, k, rounds) for k in range(n)], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, new.size + 1, n), pa.int32()), pa.array(new.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2), batch.column(3)], names=batch.schema.names)

    return state.mapInArrow(task, "bins array<smallint>, margins array<double>, label int, fold int")


def _sums(
    state: DataFrame, tasks: int, trees: Trees, t: int, level: int, first: int, width: int, bins: int, weight: np.ndarray,
    left_out: list[int],
) -> np.ndarray:
    """[sum, model, node, feature, bin] with the sums gradient, second derivative and count."""
    n, nodes = len(trees.models), 1 << level
    shape = (3, n, nodes, width, bins)
    done = Trees(trees.models, [], trees.depth, trees.feature[first : t + 1], trees.split[first : t + 1], trees.value[first : t + 1])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            binned, margins, label, fold = _columns(batch, width, n)
            for k in range(n):
                mine = fold != left_out[k]
                b, y = binned[mine].astype(np.int64), label[mine]
                p = 1 / (1 + np.exp(-(margins[mine, k] + done.margin(b, k, range(t - first)))))
                w = weight[k][y]
                at = done.leaf(b, t - first, k, level) * bins
                for f in range(width):
                    where = at + b[:, f]
                    for i, v in enumerate((w * (p - y), w * p * (1 - p), None)):
                        total[i, k, :, f] += np.bincount(where, v, nodes * bins).reshape(nodes, bins)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for data in batch.column(0):
                total += np.frombuffer(data.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = state.mapInArrow(task, "sums binary")
    if tasks > DIRECT:
        parts = parts.repartition(max(DIRECT // 2, int(tasks**0.5))).mapInArrow(add, "sums binary")
    return sum((np.frombuffer(bytes(r["sums"])).reshape(shape) for r in parts.collect()), np.zeros(shape))


def _split_level(trees: Trees, t: int, level: int, sums: np.ndarray, cfg: BoostingConfig) -> None:
    """Best split of every node of a level; at the last one, the values of the leaves below."""
    last = level == trees.depth - 1
    for k in range(sums.shape[1]):
        for node in range(sums.shape[2]):
            below = np.cumsum(sums[:, k, node], axis=2)  # [sum, feature, bin]
            whole = below[:, :1, -1:]
            g, h, c = below
            g_all, h_all, c_all = (float(v[0, 0]) for v in whole)
            ok = (c >= cfg.min_leaf) & (c_all - c >= cfg.min_leaf) & (h >= cfg.min_hessian) & (h_all - h >= cfg.min_hessian)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, g**2 / h + (g_all - g) ** 2 / (h_all - h) - (g_all**2 / h_all if h_all else 0.0), -1.0)
            gain = np.round(gain, 9)
            best = int(gain.argmax())
            at, (f, b) = (1 << level) - 1 + node, divmod(best, gain.shape[1])
            if gain.flat[best] > 0:
                trees.feature[t, k, at], trees.split[t, k, at] = f, b
                sides = (g[f, b], h[f, b]), (g_all - g[f, b], h_all - h[f, b])
            else:  # every row goes left
                sides = (g_all, h_all), (0.0, 0.0)
            if last:
                for i, (gs, hs) in enumerate(sides):
                    trees.value[t, k, 2 * node + i] = -cfg.rate * gs / hs if hs > 0 else 0.0


def predict_trees(trees: Trees, cells: DataFrame, features: Sequence[str], model: Column | None = None) -> DataFrame:
    """``cells`` (one boolean ``valid``) without its features, with ``prob``: 0 where invalid.

    ``model`` is the left-out fold of the model to use for a row; rows of no model get null.
    """
    kept = [c for c in cells.columns if c not in features]
    known = {-1 if m is None else m: k for k, m in enumerate(trees.models)}
    chosen = cells.withColumn("_model", (F.lit(-1) if model is None else model).cast("int"))
    schema = ", ".join(f"`{c}` {t}" for c, t in cells.select(*kept).dtypes) + ", prob double"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], 1)
            valid = batch.column("valid").fill_null(False).to_numpy(zero_copy_only=False)
            binned, of = trees.bin(x), batch.column("_model").to_numpy(zero_copy_only=False)
            prob = np.full(len(x), np.nan)
            for fold, k in known.items():
                mine = of == fold
                prob[mine] = 1 / (1 + np.exp(-trees.margin(binned[mine], k, range(len(trees.value)))))
            prob[~valid] = 0.0
            columns = [batch.column(c) for c in kept] + [pa.array(prob, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "prob"])

    return chosen.select(*kept, *features, "_model").mapInArrow(task, schema)
