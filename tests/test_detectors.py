import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.operators import detectors as D
from firegrid.operators import evaluate as E
from firegrid.operators import forests as R
from firegrid.operators import grid as G
from firegrid.operators import twin as T
from firegrid.plans import evaluate_days as P
from firegrid.session import cut

from .helpers import FRONT, STREWN, cube_of, fire_front, grid_of, mask_of, strewn_fires, to_array, to_mask


def rates(pred, truth):
    tp = (pred & truth).sum()
    p, r = tp / max(pred.sum(), 1), tp / truth.sum()
    return p, (2 * p * r / (p + r) if p + r else 0.0)


@pytest.fixture(scope="module")
def front(spark):
    hours, truth = fire_front()
    return cut(cube_of(spark, hours)), hours, truth


# A front of this size is far more than a tenth of the scene: nothing is cut by persistence or size.
WIDE = D.PersistenceConfig(
    hour_percentile=80.0, adaptive=False, weights=(0.4, 0.2, 0.4), min_persist=0.0, persist_floor=0.0,
    persist_scale=0.0, min_active_hours=0, opening_from_cells=0, opening_rounds=0, min_component=1,
)
TWIN = T.TwinConfig(persistence=0.6, sigma=0.8, dbt_weight=0.6, lof_neighbors=0, median_sizes=(7, 15))


def test_front_is_found_by_persistence_twin_and_both(front, spark):
    cube, _, truth = front
    g = grid_of(*FRONT)
    share = truth.mean()
    a = to_mask(D.combined_persistence(cube, share, g, 3, WIDE), truth.shape)
    b = to_mask(T.risk_mask(cube, share, g, TWIN), truth.shape)
    both = to_mask(D.intersect_masks(mask_of(spark, a), mask_of(spark, b)), truth.shape)
    assert np.array_equal(both, a & b)
    for pred in (a, b):
        p, f = rates(pred, truth)
        assert p > 0.75 and f > 0.75


def score_brute(slot, sizes=(7, 15), weight=0.6):
    def unit(x, v):
        lo, hi = np.percentile(x[v], [3, 97])
        return np.clip((x - lo) / (hi - lo + 1e-9), 0, 1)

    x = slot[13]
    v = np.ones_like(x, dtype=bool)
    total = 0
    for k in sizes:
        p = np.pad(x, k // 2, mode="edge")
        bg = np.median(np.lib.stride_tricks.sliding_window_view(p, (k, k)), axis=(2, 3))
        total = total + unit(np.maximum(0, x - bg), v)
    dbt = slot[7] - slot[14]
    extra = unit(np.maximum(0, dbt - np.percentile(dbt, 55)), v)
    return np.clip((total / len(sizes) + weight * extra) / (1 + weight), 0, 1)


def test_score_and_assimilation_match_arrays(front):
    cube, hours, truth = front
    g = grid_of(*FRONT)
    scored = cut(T.hourly_anomaly_score(cube, g, (7, 15), 0.6))
    want = [score_brute(s) for s in hours]
    for i, w in enumerate(want):
        assert np.allclose(to_array(scored.where(F.col("hour_seq") == i), "score", truth.shape), w, atol=1e-9)
    for mode in ("prob_or", "max_persist"):
        risk = np.zeros(truth.shape)
        for w in want:
            risk = np.maximum(risk * 0.6, w) if mode == "max_persist" else 1 - (1 - risk * 0.6) * (1 - w)
        got = to_array(T.assimilate(scored, 0.6, mode), "risk", truth.shape)
        assert np.allclose(got, risk, atol=1e-9)
    with pytest.raises(ValueError):
        T.assimilate(scored, 0.5, "sum")


def test_order_and_invalid_hours(spark):
    rows = [(1, 0, 0, 2, 0.9, False), (1, 0, 0, 0, 0.8, True), (1, 0, 0, 1, 0.2, True)]
    df = spark.createDataFrame(rows, "scene_id int, r int, c int, hour_seq int, score double, score_valid boolean")
    assert T.assimilate(df, 0.5, "max_persist").first()["risk"] == pytest.approx(0.4)
    assert T.assimilate(df, 0.5, "prob_or").first()["risk"] == pytest.approx(1 - 0.6 * 0.8)


def test_mixture_separates_the_front(front):
    cube, _, truth = front
    g = grid_of(*FRONT)
    field = cut(T.risk_field(cube, g, TWIN))
    pred = to_mask(T.mixture_mask(field, truth.mean(), g), truth.shape)
    p, f = rates(pred, truth)
    assert p > 0.7 and f > 0.7
    hot = to_array(T.hot_posterior(field), "p_hot", truth.shape)
    assert hot[truth].mean() > hot[~truth].mean()


def test_event_detector_on_strewn_fires(spark):
    hours, truth = strewn_fires()
    cube, g = cut(cube_of(spark, hours)), grid_of(*STREWN)
    layers = D.event_layers(cube, g)
    values = to_array(cut(D.event_risk(layers, g, 4)), "risk", truth.shape)
    assert np.isfinite(values).all() and values.min() >= 0
    # The scene has no glint, so the limits against it are opened.
    wide = D.EventConfig(risk_percentile=90.0, btd_low=5.0, btd_high=99.9, glint=100.0, max_component=0)
    assert (to_mask(D.event_detector(cube, g, 4, wide), truth.shape) & truth).any()
    small = to_mask(D.event_detector(cube, g, 4, D.EventConfig(max_component=1, risk_percentile=85.0)), truth.shape)
    near = np.pad(small, 1)
    lone = ~(near[:-2, 1:-1] | near[2:, 1:-1] | near[1:-1, :-2] | near[1:-1, 2:])
    assert not (small & ~lone).any()


def test_forest_finds_the_fires_and_needs_rows(spark):
    hours, truth = strewn_fires()
    g = grid_of(*STREWN)
    day = cut(G.day_cells(cube_of(spark, hours)))
    pred = to_mask(R.forest_mask(day, g, 0.02), truth.shape)
    assert (pred & truth).sum() >= 5 and pred.sum() <= 0.03 * truth.size
    few = day.where("r < 6 AND c < 6")
    assert R.one_band_mask(few, grid_of(6, 6), 0.05).isEmpty()


def test_residual_mask_and_empty_scene(spark):
    hours, truth = strewn_fires()
    g = grid_of(*STREWN)
    day = cut(G.day_cells(cube_of(spark, hours)))
    pred = to_mask(D.spatial_residual(day, g, 0.006), truth.shape)
    assert (pred & truth).sum() == 7
    empty = {ch: np.full((5, 5), np.nan) for ch in (7, 13, 14)}
    none = G.day_cells(cube_of(spark, [empty]))
    assert D.spatial_residual(none, grid_of(5, 5), 0.1).isEmpty()


def test_hour_rules_and_masks():
    assert [D.required_hours(n, s) for n, s in ((1, -1), (2, -1), (3, -1), (3, 0), (2, 5))] == [None, 1, 2, None, 2]
    with pytest.raises(ValueError):
        D.intersect_masks()
    with pytest.raises(ValueError):
        D.unite_masks()
    preset = D.precision_preset()
    assert preset.min_component == 5 and preset.persist_floor == 0.26 and preset.weights == (0.39, 0.17, 0.44)


def test_hour_percentiles_must_match(front):
    cube, _, _ = front
    with pytest.raises(ValueError):
        D.persistence_field(cube, grid_of(*FRONT), 3, D.PersistenceConfig(hour_percentiles=(80.0,)))


def test_calibrated_step_equals_a_direct_run(front, spark):
    cube, _, truth = front
    g = grid_of(*FRONT)
    rows = [
        (1, float(g.min_lat + g.lat_step * (r + 0.5)), float(g.min_lon + g.lon_step * (c + 0.5))) for r, c in np.argwhere(truth)
    ]
    spots = spark.createDataFrame(rows, "scene_id int, lat double, lon double")
    cfg = P.RunConfig(hours=(1, 2, 3), truth_dilation=0, twin=TWIN, persistence=WIDE)
    day = cut(G.day_cells(cube))

    def direct(mask):
        return E.confusion(E.with_flag(E.with_flag(day, mask, "pred"), mask_of(spark, truth), "truth")).first()

    best = P.calibrate("digital_twin", cube, spots, g, cfg).first()
    same = direct(T.risk_mask(cube, best["contamination"], g, TWIN))
    assert (best["tp"], best["fp"]) == (same["tp"], same["fp"]) and best["f_beta"] > 0.75
    best = P.calibrate("combined_persistence", cube, spots, g, cfg).first()
    same = direct(D.combined_persistence(cube, best["contamination"], g, 3, WIDE))
    assert (best["tp"], best["fp"]) == (same["tp"], same["fp"])
