import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.functions import geo
from firegrid.operators import evaluate as E

from .helpers import dense, grid_of, mask_of, points_of

G60 = grid_of(60, 60)


def center(r, c, g=G60):
    return g.min_lat + g.lat_step * (r + 0.5), g.min_lon + g.lon_step * (c + 0.5)


def brute(mask, spots, radius, g):
    units = np.array([center(r, c, g) for r, c in np.argwhere(mask)])
    spots = np.array(spots)
    ref = np.radians(0.5 * (units[:, 0].mean() + spots[:, 0].mean()))
    d = np.hypot(
        (spots[:, None, 0] - units[None, :, 0]) * 111.32, (spots[:, None, 1] - units[None, :, 1]) * 111.32 * np.cos(ref)
    )
    return int((d <= radius).any(axis=1).sum()), int((d <= radius).any(axis=0).sum())


def test_distance_of_one_degree(spark):
    km = spark.range(1).select(
        geo.local_km(F.lit(-5.0), F.lit(-39.0), F.lit(-6.0), F.lit(-39.0), F.lit(-5.5)).alias("a"),
        geo.local_km(F.lit(-5.0), F.lit(-39.0), F.lit(-5.0), F.lit(-39.0), F.lit(-5.0)).alias("b"),
    ).first()
    assert km["a"] == pytest.approx(111.32) and km["b"] == 0.0


@pytest.mark.parametrize("radius", [2.0, 7.0, 15.0, 40.0])
def test_cells_match_brute_force(spark, radius):
    rng = np.random.default_rng(int(radius))
    mask = rng.random((60, 60)) < 0.02
    spots = list(zip(rng.uniform(-8, -2, 150), rng.uniform(-42, -36, 150)))
    spots += [spots[0]] * 50  # copies count as points
    m = E.event_metrics(mask_of(spark, mask), points_of(spark, spots), G60, radius).first()
    assert (m["tp_recall"], m["tp_precision"]) == brute(mask, spots, radius, G60)
    assert m["n_focos"] == 200 and m["fn_focos"] == 200 - m["tp_recall"]
    assert m["n_components"] == mask.sum()


def test_one_crowded_cell(spark):
    """A third of all points in one cell changes nothing."""
    rng = np.random.default_rng(9)
    lat, lon = center(30, 30)
    spots = [(lat + a, lon + b) for a, b in rng.uniform(-0.04, 0.04, (400, 2))]
    spots += list(zip(rng.uniform(-8, -2, 800), rng.uniform(-42, -36, 800)))
    mask = rng.random((60, 60)) < 0.05
    m = E.event_metrics(mask_of(spark, mask), points_of(spark, spots), G60, 8.0).first()
    assert (m["tp_recall"], m["tp_precision"]) == brute(mask, spots, 8.0, G60)


def test_perfect_and_far(spark):
    a = np.zeros((60, 60), dtype=bool)
    a[10, 10] = True
    near = E.event_metrics(mask_of(spark, a), points_of(spark, [center(10, 10)]), G60, 3.0).first()
    assert (near["precision"], near["recall"], near["f1"]) == (1.0, 1.0, 1.0)
    far = E.event_metrics(mask_of(spark, a), points_of(spark, [center(40, 40)]), G60, 3.0).first()
    assert (far["precision"], far["recall"], far["f1"], far["fn_focos"], far["fp_components"]) == (0, 0, 0, 1, 1)


def test_cell_counts_units_centroid_counts_components(spark):
    a = np.zeros((60, 60), dtype=bool)
    a[10:14, 10:14] = True
    spots = points_of(spark, [center(10, 10)])
    cell = E.event_metrics(mask_of(spark, a), spots, G60, 3.0).first()
    mid = E.event_metrics(mask_of(spark, a), spots, G60, 3.0, matching="centroid").first()
    assert cell["n_components"] == 16 and mid["n_components"] == 1
    assert cell["tp_recall"] == 1 and mid["tp_recall"] == 0
    assert mid["component_size_median"] == 16 and mid["component_size_max"] == 16
    with pytest.raises(ValueError):
        E.event_metrics(mask_of(spark, a), spots, G60, 3.0, matching="blob")


def test_empty_sides(spark):
    a = np.zeros((60, 60), dtype=bool)
    scenes = spark.createDataFrame([(1,)], "scene_id int")
    none = E.event_metrics(mask_of(spark, a), points_of(spark, []), G60, 3.0, scenes=scenes).first()
    assert none["n_focos"] == 0 and none["n_components"] == 0 and none["f1"] == 0.0
    lost = E.event_metrics(mask_of(spark, a), points_of(spark, [(-5, -39)]), G60, 3.0, scenes=scenes).first()
    assert lost["fn_focos"] == 1 and lost["recall"] == 0.0
    a[3, 3] = True
    false = E.event_metrics(mask_of(spark, a), points_of(spark, []), G60, 3.0, scenes=scenes).first()
    assert false["fp_components"] == 1 and false["component_size_max"] == 1


def test_hits_grow_with_the_radius(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((60, 60)) < 0.01
    spots = points_of(spark, zip(rng.uniform(-8, -2, 60), rng.uniform(-42, -36, 60)))
    rows = E.event_curve(mask_of(spark, mask), spots, G60, (1.5, 3.0, 5.0, 8.0, 20.0)).orderBy("radius_km").collect()
    hits = [r["tp_recall"] for r in rows]
    assert hits == sorted(hits) and len(hits) == 5


def test_invalid_cells_do_not_count(spark):
    a = np.zeros((60, 60), dtype=bool)
    a[10, 10] = a[20, 20] = True
    ok = np.ones_like(a)
    ok[20, 20] = False
    valid = dense(spark, {"z": np.zeros(a.shape)}, valid=ok)
    m = E.event_metrics(mask_of(spark, a), points_of(spark, [center(10, 10)]), G60, 3.0, valid=valid).first()
    assert m["n_components"] == 1 and m["precision"] == 1.0


def test_nearest_component_has_no_limit(spark):
    a = np.zeros((60, 60), dtype=bool)
    a[0, 0] = a[59, 59] = True
    spots = [center(30, 30), center(1, 1), center(58, 50)]
    got = E.nearest_component_km(mask_of(spark, a), points_of(spark, spots), G60, 5.0).collect()
    units = np.array([center(0, 0), center(59, 59)])
    ref = np.radians(0.5 * (units[:, 0].mean() + np.mean([s[0] for s in spots])))
    for row in got:
        d = np.hypot((row["lat"] - units[:, 0]) * 111.32, (row["lon"] - units[:, 1]) * 111.32 * np.cos(ref))
        assert row["km"] == pytest.approx(d.min())
    assert len(got) == 3


def test_confusion_and_beta(spark):
    rows = [(1, 0, 0, True, True, True), (1, 0, 1, True, True, False), (1, 0, 2, True, False, True),
            (1, 0, 3, True, False, False), (1, 0, 4, False, True, True)]
    df = spark.createDataFrame(rows, "scene_id int, r int, c int, valid boolean, pred boolean, truth boolean")
    m = E.with_f_beta(E.confusion(df), 0.5).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"], m["valid_cells"]) == (1, 1, 1, 1, 4)
    assert m["f1"] == 0.5 and m["iou"] == pytest.approx(1 / 3) and m["f_beta"] == 0.5
    assert [r["klass"] for r in E.cell_classes(df).orderBy("c").collect()] == ["TP", "FP", "FN", "TN"]


def test_threshold_sweep_keeps_empty_settings(spark):
    cells = spark.createDataFrame([(1, 10, 10, 0.6), (1, 40, 40, 0.3)], "scene_id int, r int, c int, s double")
    rows = E.threshold_sweep(cells, "s", points_of(spark, [center(10, 10)]), G60, [0.2, 0.5, 0.9], 3.0)
    got = {r["threshold"]: (r["n_components"], r["f1"]) for r in rows.collect()}
    assert got[0.5] == (1, 1.0) and got[0.9] == (0, 0.0) and got[0.2][0] == 2
    assert E.best_row(rows, ["scene_id"], ["f1"], ["threshold"]).first()["threshold"] == 0.5
