"""Matching in space and time: points and units within a radius and a time interval of each other.

Both sides are binned by radius and interval.  Tiles of bins, with the rows one bin around them, go to one
task each, which compares the rows of neighbouring bins; crowded places get smaller tiles.  What even
the smallest tile cannot settle within its share of rows and comparisons is left to pairs of bins: each
pair is judged by the boxes of its rows (all of them match, none does, or the pair is split into halves
of both along every axis), and rows are compared one by one only where few pairs of rows are left open,
so crowded bins never put out all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from firegrid.functions import geo
from firegrid.functions.stats import f1, ratio
from firegrid.schema import KM_PER_DEG, SCENE
from firegrid.session import store

#: Bins along each side of a tile, from the first try to the last: powers of two, each half of the one before.
TILES = (16, 8, 4, 2)
#: Rows of a tile with those around it; tiles with more are cut into the next size.
TILE_ROWS = 200_000
#: Rows of a neighbouring bin that are looked at before all of them are.
FIRST_LOOK = 4
#: Comparisons a tile may make for each of its rows, after a first look; tiles with more are left to pairs of bins.
TILE_PAIRS_PER_ROW = 512
#: Comparisons held at a time.
CHUNK = 1 << 20
#: Bins are split until the open pairs stand for no more than this many pairs of rows for each row.
PAIRS_PER_ROW = 16
#: Bins of a millionth of the radius: what is left then are rows at the very edge.
MAX_LEVEL = 20
#: Boxes are judged with this margin (km), so that rounding is left to the comparison of rows.
MARGIN_KM = 1e-7

AXES = ("x", "y", "t")
PLACE = ("lat", "lon", "t")


def _sided(points: DataFrame, units: DataFrame, keys: Sequence[str], timed: bool) -> DataFrame:
    """Distinct places in space and time of both sides (``unit`` tells them apart) with their number of copies."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) if timed else F.lit(0).cast("bigint")
    p, u = (side.select(*keys, "lat", "lon", t.alias("t"), F.lit(unit).alias("unit")) for side, unit in ((points, False), (units, True)))
    return p.unionByName(u).groupBy(*keys, "unit", *PLACE).agg(F.count("*").alias("copies"))


def _reference(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of both mean latitudes, for keys that have rows on both sides."""

    def mean(unit: bool) -> Column:
        copies = F.when(F.col("unit") == unit, F.col("copies"))
        return F.sum(F.col("lat") * copies) / F.sum(F.when(F.col("lat").isNotNull(), copies))

    means = rows.groupBy(*keys).agg((0.5 * (mean(False) + mean(True))).alias("lat_ref"))
    return means.dropna(subset=[*keys, "lat_ref"])


def _bin(axis: str, level: int, steps: dict[str, float]) -> Column:
    """Halving a step is exact in binary, so a bin's parent is its number shifted by one."""
    return F.floor(F.col(axis) / F.lit(steps[axis]) * F.lit(float(2**level))).cast("bigint")


def _bins(side: DataFrame, keys: Sequence[str], level: int, steps: dict[str, float], tag: str) -> DataFrame:
    """Bins of a level with the box of their rows, their number and whether all are matched already."""
    return side.groupBy(*keys, *[_bin(a, level, steps).alias(f"{tag}_{a}") for a in AXES]).agg(
        *[F.min(a).alias(f"{tag}_{a}_lo") for a in AXES],
        *[F.max(a).alias(f"{tag}_{a}_hi") for a in AXES],
        F.count("*").alias(f"{tag}_n"),
        F.bool_and("hit").alias(f"{tag}_done"),
    )


def _judged(pairs: DataFrame, keys: Sequence[str], radius_km: float, micros: int) -> DataFrame:
    """Pairs of bins that still matter, with ``near``: every row of one matches every row of the other."""
    edge = lambda s: F.col(s)

    def gap(a: str) -> Column:
        return F.greatest(edge(f"p_{a}_lo") - edge(f"u_{a}_hi"), edge(f"u_{a}_lo") - edge(f"p_{a}_hi"), F.lit(0).cast("bigint" if a == "t" else "double"))

    def span(a: str) -> Column:
        return F.greatest(edge(f"p_{a}_hi") - edge(f"u_{a}_lo"), edge(f"u_{a}_hi") - edge(f"p_{a}_lo"))

    possible = (F.hypot(gap("x"), gap("y")) <= radius_km + MARGIN_KM) & (gap("t") <= micros)
    near = (F.hypot(span("x"), span("y")) <= radius_km - MARGIN_KM) & (span("t") <= micros)
    bins = [f"{side}_{a}" for side in "pu" for a in AXES]
    return pairs.where(possible & ~(F.col("p_done") & F.col("u_done"))).select(
        *keys, *bins, near.alias("near"), (F.col("p_n") * F.col("u_n")).cast("double").alias("rows")
    )


def _marked(side: DataFrame, keys: Sequence[str], near: DataFrame, level: int, steps: dict[str, float], tag: str) -> DataFrame:
    """Rows of the bins of ``near`` count as matched."""
    on = [*keys, *[f"{tag}_{a}" for a in AXES]]
    placed = side.withColumns({f"{tag}_{a}": _bin(a, level, steps) for a in AXES})
    found = near.select(*on).distinct().withColumn("_now", F.lit(True))
    joined = placed.join(found, on, "left")
    return joined.select(*[F.col(c) for c in side.columns if c != "hit"], (F.col("hit") | F.coalesce("_now", F.lit(False))).alias("hit"))


def _shared(p: dict, u: dict, radius_km: float, micros: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of windows that hold both sides and are too small for any two rows to be out of reach."""
    hit = np.zeros(len(p["x"]), bool), np.zeros(len(u["x"]), bool)
    if 0.01 * radius_km <= MARGIN_KM:
        return hit
    sizes = {"x": 0.7 * radius_km, "y": 0.7 * radius_km, "t": max(micros, 1)}
    code, width = [np.zeros(len(h), np.int64) for h in hit], 1
    for a in AXES:
        at = [side[a] // sizes[a] for side in (p, u)]
        low, high = min(x.min() for x in at), max(x.max() for x in at)
        code = [c + (x - low).astype(np.int64) * width for c, x in zip(code, at)]
        width *= int(high - low) + 1
    seen = [np.bincount(c, minlength=width) > 0 for c in code]
    both = seen[0] & seen[1]
    return both[code[0]], both[code[1]]


def _found(p: dict, u: dict, open_p: np.ndarray, hit_p: np.ndarray, radius_km: float, micros: int, budget: int) -> bool:
    """Sets ``hit_p`` for the open rows of ``p``; False if that takes more comparisons than the budget."""
    step = radius_km + 1e-6
    cells = {a: [np.floor(side[a] / step).astype(np.int64) for side in (p, u)] for a in "xy"}
    low = {a: min(c.min() for c in both) - 1 for a, both in cells.items()}
    wide = max(c.max() for c in cells["y"]) - low["y"] + 2
    code_p, code_u = ((cells["x"][i] - low["x"]) * wide + cells["y"][i] - low["y"] for i in (0, 1))
    times, rank = np.unique(u["t"], return_inverse=True)
    ranks = len(times) + 1
    key = code_u * ranks + rank
    order = np.argsort(key)
    key, lat, lon = key[order], u["lat"][order], u["lon"][order]
    todo = np.flatnonzero(open_p & ~hit_p)
    since, until = (np.searchsorted(times, p["t"] + d, side) for d, side in ((-micros, "left"), (micros, "right")))
    spans = []
    for dx, dy in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)):
        # A first look at a few rows of each neighbouring bin settles most rows where many match.
        todo = todo[~hit_p[todo]]
        base = (code_p[todo] + dx * wide + dy) * ranks
        start, end = np.searchsorted(key, base + since[todo]), np.searchsorted(key, base + until[todo])
        for first in range(FIRST_LOOK):
            live = np.flatnonzero((start + first < end) & ~hit_p[todo])
            rows, other = todo[live], start[live] + first
            hit_p[rows] = _km(p, rows, lat[other], lon[other]) <= radius_km
        rest = np.flatnonzero((start + FIRST_LOOK < end) & ~hit_p[todo])
        spans.append((todo[rest], start[rest] + FIRST_LOOK, end[rest]))
    spans = [tuple(x[~hit_p[rows]] for x in (rows, start, end)) for rows, start, end in spans]
    if sum(int((end - start).sum()) for _, start, end in spans) > budget:
        return False
    for rows, start, end in spans:
        live = ~hit_p[rows]
        rows, start, end = rows[live], start[live], end[live]
        done = np.cumsum(end - start)
        for lo, hi in _chunks(done):
            n = (end - start)[lo:hi]
            each = np.repeat(rows[lo:hi], n)
            other = np.arange(n.sum()) + np.repeat(start[lo:hi] - (np.cumsum(n) - n), n)
            hit_p[each[_km(p, each, lat[other], lon[other]) <= radius_km]] = True
    return True


def _chunks(done: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose comparisons, summed up in ``done``, fit a chunk; one row at least."""
    lo = 0
    while lo < len(done):
        before = done[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(done, before + CHUNK, "right")))
        yield lo, hi
        lo = hi


def _km(p: dict, rows: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    return np.hypot((p["lat"][rows] - lat) * KM_PER_DEG, (p["lon"][rows] - lon) * p["per_lon"][rows])


def _tile_hits(rows: pa.Table, radius_km: float, micros: int, pairs_per_row: int) -> pa.Table:
    """The own rows of a tile with ``hit``, null if the tile takes too many comparisons."""
    unit, own = (rows[c].to_numpy() for c in ("unit", "own"))
    columns = {c: rows[c].to_numpy() for c in ("lat", "lon", "t", "per_lon")}
    columns |= {"x": columns["lon"] * columns["per_lon"], "y": columns["lat"] * KM_PER_DEG}
    p, u = ({c: v[of] for c, v in columns.items()} for of in (~unit, unit))
    hit = np.zeros(len(unit), bool)
    settled = True
    if len(p["x"]) and len(u["x"]):
        hit_p, hit_u = _shared(p, u, radius_km, micros)
        budget = pairs_per_row * len(unit)
        settled = _found(p, u, own[~unit], hit_p, radius_km, micros, budget) and _found(u, p, own[unit], hit_u, radius_km, micros, budget)
        hit[~unit], hit[unit] = hit_p, hit_u
    kept = rows.filter(pa.array(own)).drop_columns(["per_lon", "own"])
    return kept.append_column("hit", pa.array(hit[own], mask=None if settled else np.ones(own.sum(), bool)))


def _around(rows: DataFrame, size: int, steps: dict[str, float], timed: bool) -> DataFrame:
    """Rows in every tile that holds them or lies one bin beside them; ``own`` in the tile that holds them."""
    out = rows
    for a in AXES if timed else AXES[:2]:
        first, last = (F.shiftright(_bin(a, 0, steps) + d, size.bit_length() - 1) for d in (-1, 1))
        out = out.withColumn(f"tile_{a}", F.explode(F.sequence(first, last)))
    if not timed:
        out = out.withColumn("tile_t", F.lit(0).cast("bigint"))
    own = [F.col(f"tile_{a}") == F.shiftright(_bin(a, 0, steps), size.bit_length() - 1) for a in AXES]
    return out.withColumns({"size": F.lit(size), "own": own[0] & own[1] & own[2]})


def _by_boxes(
    rows: DataFrame, keys: Sequence[str], radius_km: float, micros: int, steps: dict[str, float], timed: bool
) -> DataFrame:
    """Places (keys, unit, lat, lon, t) that match, by boxes of ever smaller bins."""
    at_p, at_u = (store(rows.where(side).withColumn("hit", F.lit(False)), "rows") for side in (~F.col("unit"), F.col("unit")))
    budget = PAIRS_PER_ROW * (at_p.count() + at_u.count())
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    ub = _bins(at_u, keys, 0, steps, "u")
    spread = ub.withColumn("p_x", F.explode(F.transform(around, lambda i: F.col("u_x") + i)))
    spread = spread.withColumn("p_y", F.explode(F.transform(around, lambda i: F.col("u_y") + i)))
    spread = spread.withColumn("p_t", F.explode(F.transform(around, lambda i: F.col("u_t") + i)) if timed else F.col("u_t"))
    pairs = spread.join(_bins(at_p, keys, 0, steps, "p"), [*keys, "p_x", "p_y", "p_t"])
    for level in range(MAX_LEVEL + 1):
        judged = store(_judged(pairs, keys, radius_km, micros), "pairs")
        near, still = judged.where("near"), judged.where("NOT near")
        at_p = store(_marked(at_p, keys, near, level, steps, "p"), "points")
        at_u = store(_marked(at_u, keys, near, level, steps, "u"), "units")
        left = still.agg(F.coalesce(F.sum("rows"), F.lit(0.0))).first()[0]
        if left <= budget or level == MAX_LEVEL:
            break
        halves = {
            side: _bins(rows, keys, level + 1, steps, side).withColumns({f"{side}up_{a}": F.shiftright(f"{side}_{a}", 1) for a in AXES})
            for side, rows in (("p", at_p), ("u", at_u))
        }
        up = still.select(*keys, *[F.col(f"{s}_{a}").alias(f"{s}up_{a}") for s in "pu" for a in AXES])
        pairs = up.join(halves["p"], [*keys, *[f"pup_{a}" for a in AXES]]).join(halves["u"], [*keys, *[f"uup_{a}" for a in AXES]])

    def rows_of(side: DataFrame, tag: str) -> DataFrame:
        cols = {f"{tag}_{a}": _bin(a, level, steps) for a in AXES} | {f"{tag}{c}": F.col(c) for c in (*PLACE, "hit")}
        return side.withColumns(cols).select(*keys, "lat_ref", *cols)

    bins = [*keys, *[f"p_{a}" for a in AXES]]
    met = still.select(*keys, *[f"{s}_{a}" for s in "pu" for a in AXES]).join(rows_of(at_p, "p"), bins)
    met = met.join(rows_of(at_u, "u").drop("lat_ref"), [*keys, *[f"u_{a}" for a in AXES]])
    km = geo.local_km(F.col("plat"), F.col("plon"), F.col("ulat"), F.col("ulon"), F.col("lat_ref"))
    met = met.where(~(F.col("phit") & F.col("uhit")) & (F.abs(F.col("pt") - F.col("ut")) <= micros) & (km <= radius_km))
    met = store(met.select(*keys, *[f"{s}{c}" for s in "pu" for c in PLACE]), "met")


    def found(side: DataFrame, unit: bool, tag: str) -> DataFrame:
        one = met.select(*keys, *[F.col(f"{tag}{c}").alias(c) for c in PLACE])
        return side.where("hit").select(*keys, *PLACE).unionByName(one).distinct().withColumn("unit", F.lit(unit))

    return found(at_p, False, "p").unionByName(found(at_u, True, "u"))


def interval_matches(
    points: DataFrame, units: DataFrame, radius_km: float, minutes: float | None, keys: Sequence[str] = SCENE
) -> tuple[DataFrame, DataFrame]:
    """Both sides as distinct places (keys, lat, lon, t, copies) with ``hit``: one of the other side is near.

    Inputs carry ``keys``, ``lat``, ``lon`` and, unless ``minutes`` is None (any time matches), ``ts``.
    Distances are equirectangular around the mean of both mean latitudes of a key; both limits are
    inclusive.  Rows with a null place or time stay and match nothing, as do keys with one side only
    and null keys; repeated rows count as copies; empty tables give empty sides.
    """
    keys = list(keys)
    timed = minutes is not None
    micros = int(round(minutes * 60e6)) if timed else 0
    steps = {"x": radius_km + 1e-6, "y": radius_km + 1e-6, "t": float(max(micros, 1))}
    places = store(_sided(points, units, keys, timed), "places")
    ref = store(_reference(places, keys), "reference")
    per_lon = geo.km_per_deg_lon(F.col("lat_ref"))
    placed = places.join(ref, keys, "left").withColumns({"per_lon": per_lon, "x": F.col("lon") * per_lon, "y": F.col("lat") * F.lit(KM_PER_DEG)})
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col("t").isNotNull()
    rows = placed.where(finite)

    tile = [*keys, "size", *[f"tile_{a}" for a in AXES]]
    crowded, tiles = None, []
    for size in TILES:
        held = _around(rows, size, steps, timed)
        if crowded is not None:  # the halves of what was crowded
            up = [*keys, *[F.col(f"tile_{a}").alias(f"up_{a}") for a in AXES]]
            held = held.withColumns({f"up_{a}": F.shiftright(f"tile_{a}", 1) for a in AXES})
            held = held.join(crowded.select(*up), [*keys, *[f"up_{a}" for a in AXES]], "left_semi").drop(*[f"up_{a}" for a in AXES])
        crowded = store(held.groupBy(*tile).agg(F.count("*").alias("n")).where(F.col("n") > TILE_ROWS).drop("n"), "crowded")
        if crowded.isEmpty():
            tiles.append(held)
            break
        tiles.append(held.join(crowded, tile, "left_anti"))
    plain = [*tile, "unit", *PLACE, "copies"]
    held = reduce(DataFrame.unionByName, tiles).select(*plain, "per_lon", "own")
    schema = StructType([held.schema[c] for c in plain]).add("hit", "boolean")
    pairs_per_row = TILE_PAIRS_PER_ROW
    settled = held.groupBy(*tile).applyInArrow(lambda rows: _tile_hits(rows, radius_km, micros, pairs_per_row), schema)
    over = _around(rows, TILES[-1], steps, timed).join(crowded, tile, "left_semi").where("own")
    never = placed.where(~F.coalesce(finite, F.lit(False))).withColumn("hit", F.lit(False))
    out = [c for c in plain if c not in tile or c in keys] + ["hit"]
    done = settled.unionByName(over.select(*plain, F.lit(None).cast("boolean").alias("hit")))
    done = store(done.unionByName(never.select(*out), allowMissingColumns=True), "settled")
    unsettled = store(done.where("hit IS NULL").select(*tile).distinct(), "unsettled")
    done = done.select(*out)
    if not unsettled.isEmpty():
        near = [_around(rows, size, steps, timed).join(unsettled, tile, "left_semi") for size in TILES]
        place = [*keys, "unit", *PLACE]
        apart = reduce(DataFrame.unionByName, near).select(*place, "lat_ref", "x", "y").distinct()
        found = _by_boxes(apart, keys, radius_km, micros, steps, timed).withColumn("_found", F.lit(True))
        done = done.join(found, place, "left").withColumn("hit", F.coalesce("hit", "_found", F.lit(False))).drop("_found")
    return done.where(~F.col("unit")).drop("unit"), done.where("unit").drop("unit")


def interval_metrics(
    hotspots: DataFrame, units: DataFrame, radius_km: float, minutes: float | None, keys: Sequence[str] = SCENE
) -> DataFrame:
    """Event metrics per key when a match must be within the radius and within ``minutes``.

    Keys of either side appear; copies count one by one.  With ``minutes=None`` and cell units the
    figures are those of matching by distance alone.
    """
    keys = list(keys)
    p, u = interval_matches(hotspots, units, radius_km, minutes, keys)
    zero = F.lit(0).cast("bigint")

    def counted(side: DataFrame, n: str, tp: str) -> DataFrame:
        hits = F.sum(F.when(F.col("hit"), F.col("copies")).otherwise(0))
        return side.groupBy(*keys).agg(F.sum("copies").alias(n), hits.alias(tp))

    both = counted(p, "n_focos", "tp_recall").join(counted(u, "n_units", "tp_precision"), keys, "full")
    rows = both.select(*keys, *[F.coalesce(c, zero).alias(c) for c in ("n_focos", "n_units", "tp_recall", "tp_precision")])
    rows = rows.withColumns(
        {
            "precision": ratio(F.col("tp_precision"), F.col("n_units")),
            "recall": ratio(F.col("tp_recall"), F.col("n_focos")),
        }
    )
    return rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))
