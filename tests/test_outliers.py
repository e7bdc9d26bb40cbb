import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.operators import evaluate as E
from firegrid.operators import outliers as O
from firegrid.plans import sweeps as W

from .helpers import dense, grid_of, mask_of, points_of, to_array, to_mask

SHAPE = (34, 46)
PLANTED = ((2, 41), (11, 9), (17, 30), (24, 22), (31, 3), (29, 44))


@pytest.fixture(scope="module")
def table(spark):
    """Correlated ordinary features; in the planted cells each is off by eight of its deviations."""
    rng = np.random.default_rng(23)
    common = rng.normal(size=SHAPE)
    level = dict(twin_risk=(0.12, 0.03), bt13_max=(294.0, 0.8), bt7_max=(303.0, 1.4), btd_median=(8.0, 0.6), bt13_anom_21=(0.1, 0.4), persist_h=(1.5, 0.25))
    arrays = {k: m + s * (0.5 * common + rng.normal(size=SHAPE)) for k, (m, s) in level.items()}
    for r, c in PLANTED:
        for k, (m, s) in level.items():
            arrays[k][r, c] = m + 8 * s
    return dense(spark, arrays, valid=np.ones(SHAPE, dtype=bool)).cache(), arrays


@pytest.mark.parametrize("method", ["isolation_forest", "local_outlier_factor", "elliptic_envelope", "ensemble"])
def test_planted_cells_are_found(table, method):
    df, _ = table
    out = to_mask(O.outlier_mask(df, O.OutlierConfig(method=method, contamination=0.02)), SHAPE)
    assert sum(out[r, c] for r, c in PLANTED) >= 5
    assert out.sum() <= 0.025 * out.size


def test_scenes_named_by_their_day(table):
    df, _ = table
    named = df.withColumn("scene_id", F.lit("2024-10-03"))
    cfg = O.OutlierConfig(contamination=0.02, trees=50)
    out = to_mask(O.outlier_mask(named, cfg), SHAPE)
    assert sum(out[r, c] for r, c in PLANTED) >= 5


def test_few_rows_unknown_names_and_filter(table, spark):
    df, _ = table
    assert O.outlier_mask(df.where("r < 6 AND c < 8")).isEmpty()
    with pytest.raises(ValueError):
        O.outlier_mask(df, O.OutlierConfig(method="magic"))
    with pytest.raises(KeyError):
        O.outlier_mask(df, O.OutlierConfig(features=("nothing",)))
    cand = np.zeros(SHAPE, dtype=bool)
    cand[PLANTED[1]] = cand[0, 0] = True
    kept = to_mask(O.keep_outliers(mask_of(spark, cand), df, O.OutlierConfig(contamination=0.02)), SHAPE)
    assert not (kept & ~cand).any() and kept[PLANTED[1]]


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    idx = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, idx, 1)
    kd = dist[:, -1]
    lrd = 1.0 / (np.maximum(dist, kd[idx]).mean(axis=1) + 1e-10)
    return lrd[idx].mean(axis=1) / lrd


@pytest.mark.parametrize("copies", [0.0, 0.35])
def test_neighbours_are_exact_across_blocks(spark, monkeypatch, copies):
    """Small blocks, and a third of the rows equal: every block still answers."""
    monkeypatch.setattr(O, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(20, 20)), rng.normal(size=(20, 20))
    same = rng.random((20, 20)) < copies
    a[same], b[same] = 0.1, 0.2
    df = dense(spark, {"a": a, "b": b})
    got = to_array(O.local_outlier_factor(df, ["a", "b"], 10), "lof", a.shape)
    want = brute_lof(np.column_stack([a.ravel(), b.ravel()]), 10)
    assert np.allclose(got.ravel(), want, rtol=1e-9)


def test_constant_first_feature_and_far_rows(spark, monkeypatch):
    """Most rows agree in the first feature; rows and columns lie beyond 16 bits."""
    monkeypatch.setattr(O, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(12)
    x = np.column_stack([np.where(rng.random(300) < 0.9, 0.0, rng.normal(size=300)), rng.normal(size=(300, 2))])
    rows = [("day", 70_000 + i // 20, 90_000 + i % 20, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "scene_id string, r int, c int, a double, b double, d double")
    got = {(r.r, r.c): r.lof for r in O.local_outlier_factor(df, ["a", "b", "d"], 8).collect()}
    want = brute_lof(x, 8)
    assert np.allclose([got[r[1], r[2]] for r in rows], want, rtol=1e-9)


def test_envelope_of_clean_normal_data_is_mahalanobis(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(30, 30))
    b = 0.5 * a + rng.normal(size=(30, 30))
    got = to_array(O.envelope_distance(dense(spark, {"a": a, "b": b}), ["a", "b"]), "envelope", a.shape)
    x = np.column_stack([a.ravel(), b.ravel()])
    want = np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(np.cov(x.T)), x - x.mean(0))
    assert np.corrcoef(got.ravel(), want)[0, 1] > 0.98


def draw(seed, tree, x):
    h = seed
    for v in (tree * 69621 + 1, x, 7):
        t = (h * 48271 + v) % O.PRIME
        h = (t * t + 12345) % O.PRIME
    return h


def test_forest_equals_trees_grown_one_by_one(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(20, 15, 2)), 2)
    df = dense(spark, {"a": x[..., 0], "b": x[..., 1], "k": np.ones(x.shape[:2])})
    seed, n, sample = 9, 300, 256
    got = {(v["tree"], v["node"]): v for v in O.isolation_forest(df, ["a", "k", "b"], 4, seed).collect()}
    seen = 0

    def cell(r, c):
        h = 0
        for v in (r + 1, c + 1):
            t = (h * 48271 + v) % O.PRIME
            h = (t * t + 12345) % O.PRIME
        return h

    def grow(tree, node, rows, depth):
        nonlocal seen
        seen += 1
        v = got[tree, node]
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        vary = [f for f in range(3) if hi[f] > lo[f]]
        assert v["sample"] == sample
        if len(rows) == 1 or not vary or depth == 8:
            assert v["feature"] == -1
            assert v["units"] == depth * O.PATH_UNIT + round(float(O.average_path(len(rows))) * O.PATH_UNIT)
            return
        f = vary[draw(seed, tree, 2 * node) % len(vary)]
        cut = lo[f] + draw(seed, tree, 2 * node + 1) / O.PRIME * (hi[f] - lo[f])
        assert v["feature"] == f and abs(v["cut"] - cut) < 1e-12
        grow(tree, 2 * node, rows[rows[:, f] <= v["cut"]], depth + 1)
        grow(tree, 2 * node + 1, rows[rows[:, f] > v["cut"]], depth + 1)

    for tree in range(4):
        order = sorted((draw(seed, tree, cell(r, c)), r, c) for r in range(20) for c in range(15))[:sample]
        grow(tree, 1, np.array([[x[r, c, 0], 1.0, x[r, c, 1]] for _u, r, c in order]), 0)
    assert seen == len(got)


def test_draws_are_even_and_samples_differ(spark):
    df = dense(spark, {"a": np.zeros((60, 60))})
    rows = O._sample_rows(df, 50, 3).groupBy("tree").count().collect()
    assert {r["count"] for r in rows} == {256} and len(rows) == 50
    times = O._sample_rows(df, 50, 3).groupBy("r", "c").count().toPandas()["count"].to_numpy()
    # 50 trees x 256 of 3,600 cells: 3.6 times each, and no cell in most trees.
    assert len(times) > 3400 and times.max() < 15


def test_scores_of_tiny_and_constant_scenes(spark):
    for shape in ((1, 1), (1, 2), (4, 5)):
        scores = O.isolation_scores(dense(spark, {"a": np.ones(shape)}), ["a"], 10).collect()
        assert len(scores) == shape[0] * shape[1] and len({s["iso_score"] for s in scores}) == 1
    assert O.isolation_scores(dense(spark, {"a": np.ones((2, 2))}).where("r < 0"), ["a"], 10).isEmpty()


def test_combination_modes(spark, table):
    df, _ = table
    g = grid_of(*SHAPE)
    out = O.outlier_mask(df, O.OutlierConfig(contamination=0.01)).cache()
    base = np.zeros(SHAPE, dtype=bool)
    base[0, 0] = True
    grown = to_mask(W.only_outliers(out, df, 1, g), SHAPE)
    union = to_mask(W.union_with_outliers(mask_of(spark, base), out, df, 1, g), SHAPE)
    assert np.array_equal(union, grown | base)
    prob = dense(spark, {"prob": np.random.default_rng(2).random(SHAPE)}, valid=np.ones(SHAPE, dtype=bool))
    peaks = to_mask(W.outlier_weighted_peaks(prob, out, 1, 0, g), SHAPE)
    assert not (peaks & ~to_mask(out, SHAPE)).any() and peaks.any()


def test_mode_sweep_equals_single_runs(spark, table):
    df, _ = table
    g = grid_of(*SHAPE)
    rng = np.random.default_rng(6)
    prob = dense(spark, {"prob": rng.random(SHAPE)}, valid=np.ones(SHAPE, dtype=bool)).cache()
    base = mask_of(spark, rng.random(SHAPE) < 0.01)
    spots = points_of(spark, [(g.min_lat + g.lat_step * (r + 0.4), g.min_lon + g.lon_step * (c + 0.6)) for r, c in PLANTED])
    rows = W.outlier_mode_sweep(
        base, prob, df, spots, g, ("elliptic_envelope",), (0.01, 0.02), growths=(0, 1), peak_radii=(2,), radii=(10.0,)
    ).collect()
    assert len(rows) == 2 * 3 * 2
    got = {(r["mode"], r["contamination"], r["growth"]): (r["n_components"], r["tp_recall"]) for r in rows}
    out = O.outlier_mask(df, O.OutlierConfig(method="elliptic_envelope", contamination=0.02)).cache()
    single = {
        "only": W.only_outliers(out, df, 1, g),
        "union": W.union_with_outliers(base, out, df, 1, g),
        "peaks": W.outlier_weighted_peaks(prob, out, 2, 1, g),
    }
    for mode, mask in single.items():
        want = E.event_curve(mask, spots, g, (10.0,), valid=df).first()
        assert got[mode, 0.02, 1] == (want["n_components"], want["tp_recall"])


def test_nearest_points_by_product_equal_plain_distances():
    rng = np.random.default_rng(11)
    for x in (rng.normal(size=(700, 64)), rng.integers(0, 9, (400, 2)).astype(float), rng.normal(size=(300, 6)) + 1e6, rng.normal(size=(4, 3))):
        rows = np.arange(len(x))
        d2 = np.zeros((len(x), len(x)))
        for f in range(x.shape[1]):
            d2 += (x[:, f, None] - x[None, :, f]) ** 2
        d2[rows, rows] = np.inf
        want = np.argsort(d2, axis=1, kind="stable")[:, :10]
        idx, dist = O._nearest(x, x, (rows, rows), 10)
        near = np.isfinite(dist)
        assert (dist == np.sqrt(np.take_along_axis(d2, want, axis=1))).all() and (idx[near] == want[near]).all()
    # A piece's distances keep their size, however many points a visit holds.
    assert max(s.stop - s.start for s in O._pieces(4096, 1 << 16)) * (1 << 16) <= 1 << 21
