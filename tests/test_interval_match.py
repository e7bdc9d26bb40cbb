import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.operators import evaluate as E
from firegrid.operators import interval_match as I

from .helpers import grid_of, mask_of, points_of

SCHEMA = "scene_id int, lat double, lon double, ts timestamp"
START = dt.datetime(2024, 9, 1, tzinfo=dt.timezone.utc)


def table(spark, rows):
    return spark.createDataFrame([(s, la, lo, None if m is None else START + dt.timedelta(minutes=m)) for s, la, lo, m in rows], SCHEMA)


def brute(points, units, radius, minutes):
    """Counts of matched points and units of each scene, pair by pair."""
    out = {}
    for s in {r[0] for r in points + units}:
        p, u = ([r for r in side if r[0] == s] for side in (points, units))
        hit_p, hit_u = set(), set()
        if p and u:
            ref = np.radians(0.5 * (np.mean([r[1] for r in p]) + np.mean([r[1] for r in u])))
            for i, a in enumerate(p):
                for j, b in enumerate(u):
                    km = np.hypot((a[1] - b[1]) * 111.32, (a[2] - b[2]) * 111.32 * np.cos(ref))
                    if km <= radius and (minutes is None or abs(a[3] - b[3]) <= minutes):
                        hit_p.add(i)
                        hit_u.add(j)
        out[s] = (len(p), len(u), len(hit_p), len(hit_u))
    return out


def counts(rows):
    return {r["scene_id"]: (r["n_focos"], r["n_units"], r["tp_recall"], r["tp_precision"]) for r in rows.collect()}


def strewn(rng, n, crowd):
    rows = [(int(s), float(a), float(o), int(m)) for s, a, o, m in zip(rng.integers(1, 3, n), rng.uniform(-6, -5, n), rng.uniform(-40, -39, n), rng.integers(0, 600, n))]
    # A third of the rows crowd one place and hour; some are plain repeats.
    rows += [(1, -5.5 + float(d) * 0.02, -39.5 + float(e) * 0.02, int(m)) for d, e, m in zip(rng.normal(size=crowd), rng.normal(size=crowd), rng.integers(100, 140, crowd))]
    return rows + rows[:20]


@pytest.mark.parametrize("minutes", [30, 0, None])
def test_matches_brute_force(spark, monkeypatch, minutes):
    rng = np.random.default_rng(5)
    points, units = strewn(rng, 160, 80), strewn(rng, 140, 70) + [(9, -5.0, -39.0, 5)]
    monkeypatch.setattr(I, "PAIRS_PER_ROW", 4)  # so that bins are split several times
    got = counts(I.interval_metrics(table(spark, points), table(spark, units), 6.0, minutes))
    assert got == brute(points, units, 6.0, minutes)


def test_limits_are_inclusive(spark):
    points, units = [(1, -5.0, -39.0, 0), (2, -5.0, -39.0, 0)], [(1, -5.0, -39.0, 30), (2, -5.0, -39.0, 31)]
    assert counts(I.interval_metrics(table(spark, points), table(spark, units), 1.0, 30)) == {1: (1, 1, 1, 1), 2: (1, 1, 0, 0)}


def test_nulls_match_nothing_and_empty_tables_pass(spark):
    points = table(spark, [(1, -5.0, -39.0, None), (1, None, -39.0, 0), (1, -5.0, -39.0, 0)])
    units = table(spark, [(1, -5.0, -39.0, 10)])
    assert counts(I.interval_metrics(points, units, 1.0, 30)) == {1: (3, 1, 1, 1)}
    assert counts(I.interval_metrics(points, units.limit(0), 1.0, 30)) == {1: (3, 0, 0, 0)}
    assert I.interval_metrics(points.limit(0), units.limit(0), 1.0, 30).count() == 0


def test_any_time_is_matching_by_distance(spark):
    g = grid_of(40, 40)
    rng = np.random.default_rng(8)
    mask = mask_of(spark, rng.random((40, 40)) < 0.03)
    spots = points_of(spark, list(zip(rng.uniform(-8, -4, 200), rng.uniform(-42, -38, 200))))
    want = E.event_metrics(mask, spots, g, 9.0).first()
    got = I.interval_metrics(E.place_points(spots, g), E.prediction_units(mask, g), 9.0, None).first()
    assert all(got[c] == want[c] for c in ("n_focos", "tp_recall", "tp_precision", "precision", "recall", "f1"))
    assert got["n_units"] == want["n_components"]


@pytest.mark.parametrize("minutes", [30, None])
@pytest.mark.parametrize("limits", [{"TILE_ROWS": 100}, {"TILE_ROWS": 0, "PAIRS_PER_ROW": 4}, {"TILE_PAIRS_PER_ROW": 0, "PAIRS_PER_ROW": 4}], ids=["cut", "crowded", "many pairs"])
def test_crowded_tiles_match_brute_force(spark, monkeypatch, minutes, limits):
    rng = np.random.default_rng(6)
    points, units = strewn(rng, 120, 60), strewn(rng, 100, 50) + [(9, -5.0, -39.0, 5)]
    # Two crowds that lie in neighbouring bins, just out of reach.
    points += [(3, -5.0 - i * 1e-5, -39.0, i) for i in range(9)]
    units += [(3, -5.0 - i * 1e-5, -39.0 + 6.1 / 110.8, i) for i in range(9)]
    boxed, by_boxes = [], I._by_boxes
    monkeypatch.setattr(I, "_by_boxes", lambda *a: boxed.append(1) or by_boxes(*a))
    for name, value in limits.items():
        monkeypatch.setattr(I, name, value)
    got = counts(I.interval_metrics(table(spark, points), table(spark, units), 6.0, minutes))
    assert got == brute(points, units, 6.0, minutes)
    assert boxed


def test_spread_rows_store_no_pairs(spark, monkeypatch):
    """With a row or two in each bin, pairs of bins would be several times the rows."""
    rng = np.random.default_rng(7)
    sides = [[(1, float(a), float(o), int(m)) for a, o, m in zip(rng.uniform(-6, -5, 1500), rng.uniform(-40, -39, 1500), rng.integers(0, 300, 1500))] for _ in "pu"]
    kept, store = [], I.store

    def counted(df, *name):
        kept.append((out := store(df, *name)).count())
        return out

    monkeypatch.setattr(I, "store", counted)
    got = counts(I.interval_metrics(table(spark, sides[0]), table(spark, sides[1]), 12.0, 30))
    assert got == brute(*sides, 12.0, 30)
    assert max(kept) <= 3000


def test_radius_zero_matches_equal_places(spark):
    points, units = [(1, -5.0, -39.0, 0), (1, -5.0, -39.1, 0)], [(1, -5.0, -39.0, 3), (1, -5.0, -39.0 + 1e-9, 0)]
    assert counts(I.interval_metrics(table(spark, points), table(spark, units), 0.0, 5)) == {1: (2, 2, 1, 1)}


def test_comparisons_in_chunks(monkeypatch):
    rng = np.random.default_rng(9)
    side = lambda n: {"x": rng.uniform(0, 30, n), "y": rng.uniform(0, 30, n), "t": rng.integers(0, 90, n)}
    p, u = side(300), side(200)
    for s in (p, u):
        s.update(lat=s["y"] / I.KM_PER_DEG, lon=s["x"], per_lon=np.ones(len(s["x"])))
    monkeypatch.setattr(I, "CHUNK", 7)
    want = ((np.hypot(p["x"][:, None] - u["x"], p["y"][:, None] - u["y"]) <= 4) & (np.abs(p["t"][:, None] - u["t"]) <= 20)).any(axis=1)
    hit = np.zeros(300, bool)
    assert I._found(p, u, np.ones(300, bool), hit, 4.0, 20, 10**6) and (hit == want).all()
    assert 0 < want.sum() < 300
    far = u | {"lat": u["lat"] + 1.0}  # in the same bins by x and y, but out of reach
    assert not I._found(p, far, np.ones(300, bool), np.zeros(300, bool), 4.0, 90, 0)
