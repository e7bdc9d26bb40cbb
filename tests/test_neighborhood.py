import numpy as np
import pytest

from firegrid.operators import components as C
from firegrid.operators import neighborhood as N
from firegrid.schema import SCENE

from .helpers import dense, grid_of, mask_of, to_array, to_mask


def padded_median(a, k):
    p = np.pad(a, k // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (k, k)), axis=(2, 3))


@pytest.mark.parametrize("shape", [(13, 17), (100, 205)])
def test_medians_across_tiles(spark, shape):
    a = np.random.default_rng(1).normal(300, 3, shape)
    out = N.median_backgrounds(dense(spark, {"v": a}), "v", [3, 8, 21], grid_of(*shape), SCENE).cache()
    assert out.count() == a.size
    for k in (3, 9, 21):
        assert np.array_equal(to_array(out, f"med{k}", shape), padded_median(a, k))


def test_median_of_an_empty_layer_is_null(spark):
    out = N.median_backgrounds(dense(spark, {"v": np.full((4, 4), np.nan)}), "v", [3], grid_of(4, 4), SCENE)
    assert out.where("med3 IS NOT NULL").isEmpty()


def line_filter(a, w):
    rad = len(w) // 2
    for axis in (0, 1):
        p = np.pad(a, [(rad, rad) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        a = sum(w[i] * np.take(p, range(i, i + a.shape[axis]), axis=axis) for i in range(len(w)))
    return a


def test_smoothing_mean_and_maximum(spark):
    a = np.random.default_rng(2).normal(0, 1, (9, 12))
    df = dense(spark, {"v": a})
    for sigma in (0.8, 2.0):
        got = to_array(N.gaussian_smooth(df, "v", "s", sigma), "s", a.shape)
        assert np.allclose(got, line_filter(a, N.gaussian_weights(sigma)), atol=1e-12)
    assert np.array_equal(to_array(N.gaussian_smooth(df, "v", "s", 0.0), "s", a.shape), a)
    assert np.allclose(to_array(N.box_mean(df, "v", "m"), "m", a.shape), line_filter(a, [0.2] * 5), atol=1e-12)
    p = np.pad(a, 2, mode="edge")
    want = np.lib.stride_tricks.sliding_window_view(p, (5, 5)).max(axis=(2, 3))
    assert np.array_equal(to_array(N.local_maximum(df, "v", "t", 2), "t", a.shape), want)


def test_peaks_keep_plateaus_and_respect_valid(spark):
    a = np.zeros((7, 7))
    a[1, 1] = a[1, 2] = 5.0
    a[5, 5] = 4.0
    valid = np.ones_like(a, dtype=bool)
    valid[5, 5] = False
    got = to_mask(N.peaks(dense(spark, {"p": a}, valid=valid), "p", 1.0, 1, 0.0), a.shape)
    assert set(map(tuple, np.argwhere(got))) == {(1, 1), (1, 2)}


def grow(a, n, box=True):
    for _ in range(n):
        p = np.pad(a, 1)
        a = np.lib.stride_tricks.sliding_window_view(p, (3, 3)).any(axis=(2, 3)) if box else (
            p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
        )
    return a


def shrink(a, box):
    p = np.pad(a, 1)
    if box:
        return np.lib.stride_tricks.sliding_window_view(p, (3, 3)).all(axis=(2, 3))
    return p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]


def test_dilation_and_opening(spark):
    a = np.random.default_rng(3).random((15, 11)) < 0.6
    g = grid_of(15, 11)
    m = mask_of(spark, a)
    sparse = np.random.default_rng(4).random((15, 11)) < 0.03
    for n in (0, 1, 3):
        assert np.array_equal(to_mask(N.dilate(mask_of(spark, sparse), n, g), a.shape), grow(sparse, n))
    for shape, box in (("cross", False), ("box", True)):
        assert np.array_equal(to_mask(N.opening(m, g, shape), a.shape), grow(shrink(a, box), 1, box))


def brute_labels(a, conn):
    h, w = a.shape
    out = np.full(a.shape, -1)
    moves = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (conn == 2 or not (i and j))]
    for r, c in np.argwhere(a):
        if out[r, c] >= 0:
            continue
        todo, out[r, c] = [(r, c)], r * w + c
        while todo:
            y, x = todo.pop()
            for i, j in moves:
                v, u = y + i, x + j
                if 0 <= v < h and 0 <= u < w and a[v, u] and out[v, u] < 0:
                    out[v, u] = r * w + c
                    todo.append((v, u))
    return out


@pytest.mark.parametrize("conn", [1, 2])
def test_components_of_one_tile(spark, conn):
    a = np.random.default_rng(5).random((30, 41)) < 0.5
    got = to_array(C.label_components(mask_of(spark, a), grid_of(30, 41), conn), "label", a.shape)
    assert np.array_equal(np.where(a, got, -1), brute_labels(a, conn))


@pytest.mark.parametrize("conn", [1, 2])
def test_components_across_tiles(spark, conn):
    a = np.random.default_rng(6).random((105, 110)) < 0.45
    a[:, 3] = True
    a[100, :] = True
    got = to_array(C.label_components(mask_of(spark, a), grid_of(105, 110), conn), "label", a.shape)
    assert np.array_equal(np.where(a, got, -1), brute_labels(a, conn))


def test_size_filter_and_centroids(spark):
    a = np.zeros((10, 10), dtype=bool)
    a[0, 0:3] = True
    a[5, 5] = True
    a[7:10, 7:10] = True
    g = grid_of(10, 10)
    kept = to_mask(C.filter_by_size(mask_of(spark, a), g, 2, 5), a.shape)
    assert set(map(tuple, np.argwhere(kept))) == {(0, 0), (0, 1), (0, 2)}
    mids = {r["size"]: (r["lat"], r["lon"]) for r in C.component_centroids(mask_of(spark, a), g).collect()}
    assert mids[1] == pytest.approx((-8 + 0.6 * 5.5, -42 + 0.6 * 5.5))
    assert mids[3] == pytest.approx((-8 + 0.3, -42 + 0.6 * 1.5))
