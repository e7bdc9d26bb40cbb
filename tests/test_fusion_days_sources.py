import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.queries import granule_names
from firegrid.functions import geo
from firegrid.operators import days as Y
from firegrid.operators import fusion as U
from firegrid.schema import state_grid
from firegrid.sources import granules as GR
from firegrid.sources import sinks
from firegrid.sources import tables as TB

from .helpers import dense, grid_of, mask_of, points_of, to_array, to_mask

G = grid_of(60, 60)


def spot(r, c):
    return G.min_lat + G.lat_step * (r + 0.5), G.min_lon + G.lon_step * (c + 0.5)


@pytest.fixture(scope="module")
def parts(spark):
    pred = np.zeros((60, 60), dtype=bool)
    pred[10, 10] = pred[10, 11] = pred[40, 40] = True
    prob = np.random.default_rng(0).random((60, 60)) * 0.4
    prob[pred] = 0.9
    valid = np.ones((60, 60), dtype=bool)
    valid[50, 50] = False
    cells = dense(spark, {"prob": prob}, valid=valid)
    det = points_of(spark, [spot(11, 11), spot(50, 50), spot(20, 30)])
    return pred, prob, valid, cells, det, mask_of(spark, pred)


def test_fusion_modes(parts):
    pred, prob, valid, cells, det, mask = parts
    d = np.zeros_like(pred)
    d[11, 11] = d[50, 50] = d[20, 30] = True
    n = geo.gate_iterations(G, 25.0)
    gate = np.zeros_like(pred)
    for r, c in np.argwhere(d):
        gate[max(0, r - n) : r + n + 1, max(0, c - n) : c + n + 1] = True
    gate &= valid
    got = {m: to_mask(U.fused_mask(U.fuse(mask, det, cells, G, U.FusionConfig(mode=m, gate_km=25.0))), pred.shape) for m in U.MODES}
    assert np.array_equal(got["and"], pred & gate)
    assert np.array_equal(got["or"], (pred | gate) & valid)
    assert np.array_equal(got["gated"], ((pred & gate) | d) & valid)
    support = np.clip(gate + 0.5 * d, 0, 1)
    score = 0.6 * np.where(valid, prob, 0) + 0.4 * support
    cut = np.sort(score.ravel())[-3]
    assert np.array_equal(got["weighted"], (score >= cut) & valid)
    with pytest.raises(ValueError):
        U.fuse(mask, det, cells.drop("prob"), G, U.FusionConfig(mode="weighted"))
    with pytest.raises(ValueError):
        U.fuse(mask, det, cells, G, U.FusionConfig(mode="xor"))


def test_weighted_without_predictions_uses_support(parts, spark):
    _, _, valid, cells, det, _ = parts
    none = mask_of(spark, np.zeros((60, 60), dtype=bool))
    fused = U.fuse(none, det, cells, G, U.FusionConfig(mode="weighted", gate_km=5.0))
    assert np.array_equal(to_array(fused, "fused", valid.shape) > 0, to_array(fused, "gate", valid.shape) > 0)


def test_detection_mask_rules(spark):
    rows = [(1, -5.0, -39.0, 90.0, "2024-10-31 10:00:00"), (1, -6.0, -39.0, None, "2024-10-31 10:00:00"),
            (1, -7.0, -39.0, 90.0, "2024-11-01 00:00:00"), (1, -2.0, -39.0, 90.0, "2024-10-31 10:00:00")]
    det = spark.createDataFrame(rows, "scene_id int, lat double, lon double, confidence double, t string").withColumn("datetime", F.to_timestamp("t"))
    assert U.detection_mask(det, G).count() == 3
    assert U.detection_mask(det, G, "2024-10-31", 50.0).count() == 1
    assert U.detection_mask(det.limit(0), G).isEmpty()


def test_gate_rounds_half_to_even():
    g = state_grid(72, 72)
    lat = 5.4 * 111.32 / 72
    lon = 4.5 * 111.32 * np.cos(np.radians(-5.2)) / 72
    cell = (lat + lon) / 2
    assert geo.gate_iterations(g, 0.1) == 1
    assert geo.gate_iterations(g, 2.5 * cell) == round(2.5 * cell / cell) == 2
    assert geo.gate_iterations(g, 3.4 * cell) == 3


COUNTS = {"2024-10-31": 3, "2024-11-01": 1, "2024-11-15": 50, "2024-12-12": 20}


def day_rows(spark, counts):
    rows = [(dt.date.fromisoformat(d),) for d, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "day date")


def names(df):
    return [r["day"].isoformat() for r in df.collect()]


def test_day_selection(spark):
    df = day_rows(spark, COUNTS)
    assert names(Y.daily_counts(df)) == ["2024-11-15", "2024-12-12", "2024-10-31", "2024-11-01"]
    assert names(Y.top_days(df, 2, 2)) == ["2024-11-15", "2024-12-12"]
    assert names(Y.days_by_month(df, 1, 1)) == ["2024-10-31", "2024-11-15", "2024-12-12"]
    assert names(Y.days_by_month(df, 4, 1, (11,))) == ["2024-11-01", "2024-11-15"]
    assert names(Y.dense_range(df, "2024-11-01", "2024-12-31", 10)) == ["2024-11-15", "2024-12-12"]


def folds_of(spark, days, k, buffer):
    out = {}
    for r in Y.temporal_folds(spark.createDataFrame([(d,) for d in days], "day date"), k, buffer).collect():
        out.setdefault(r["fold"], {"test": set(), "train": set()})[r["role"]].add(r["day"])
    return out


def test_temporal_folds(spark):
    start = dt.date(2024, 1, 1)
    spaced = [start + dt.timedelta(days=5 * i) for i in range(8)]
    f = folds_of(spark, spaced, 4, 1)
    assert len(f) == 4 and set().union(*(v["test"] for v in f.values())) == set(spaced)
    assert all(v["train"] == set(spaced) - v["test"] for v in f.values())
    run = [start + dt.timedelta(days=i) for i in range(8)]
    for v in folds_of(spark, run, 4, 1).values():
        assert all(abs((a - b).days) > 1 for a in v["train"] for b in v["test"])
    two = folds_of(spark, spaced[:2], 4, 1)
    assert {tuple(v["test"]) for v in two.values()} == {(spaced[0],), (spaced[1],)}
    assert all(len(v["train"]) == 1 for v in two.values())


def test_hotspot_csv_rules(spark, tmp_path):
    a = tmp_path / "a.csv"
    a.write_text(
        "lat,lon,data_pas,data_hora_gmt,estado_id,estado\n-5,-39,2024-10-31 16:00:00,2024-10-31 10:00:00,23,X\n"
        "-5,-39,bad,2024-10-31 10:00:00,23,X\n-5,-39,2024-10-31 17:00:00,,junk,ceará\n-5,-39,2024-10-31 17:00:00,,24,CEARA\n,-39,2024-10-31 17:00:00,,23,X\n"
    )
    assert TB.load_hotspots(spark, str(a)).count() == 2
    assert TB.load_hotspots_with_day(spark, str(a)).count() == 3
    assert TB.filter_state(spark, str(a)).count() == 3
    b = tmp_path / "b.csv"
    b.write_text("lat,lon,data_pas,data_hora_gmt,estado_id,estado\n-5,-39,,2024-10-31 10:00:00,23,X\n")
    assert TB.load_hotspots(spark, str(b)).first()["datetime"].hour == 10
    assert TB.load_hotspots_with_day(spark, str(b)).isEmpty()
    c = tmp_path / "c.csv"
    c.write_text("lat,lon\n1,2\n")
    with pytest.raises(ValueError):
        TB.filter_state(spark, str(c))


def test_detection_csv(spark, tmp_path):
    p = tmp_path / "firms_X_2024-10-31.csv"
    p.write_text("latitude,longitude,brightness,acq_date,acq_time,confidence,frp\n-5.1,-39.2,330.5,2024-10-31,48,h,12.3\n-5.2,-39.2,330.5,2024-10-31,1648,x,1\n")
    rows = TB.load_detections(spark, str(p)).orderBy("datetime").collect()
    assert [(r["datetime"].hour, r["datetime"].minute, r["confidence"]) for r in rows] == [(0, 48, 90.0), (16, 48, None)]
    assert TB.load_cached_detections(spark, str(tmp_path), "X", ["2024-10-31"]).count() == 2
    none = TB.load_cached_detections(spark, str(tmp_path), "Y", ["2024-10-31"])
    assert none.isEmpty() and none.columns == ["lat", "lon", "datetime", "confidence"]
    q = tmp_path / "n.csv"
    q.write_text("latitude,longitude,confidence\n-5,-39,75\n")
    row = TB.load_detections(spark, str(q)).first()
    assert row["confidence"] == 75.0 and row["datetime"] is None


def test_years(spark):
    a = spark.createDataFrame([(2023, 1), (2024, 2)], "year int, v int")
    m = spark.createDataFrame([(2024, 9), (2025, 3)], "year int, v int")
    assert {r["v"] for r in TB.assemble_years(a, m).collect()} == {1, 2, 3}


def test_granules(spark):
    base = "ABI-L2-CMIPF/2024/305/16/OR_ABI-L2-CMIPF-M6C13_G16_s2024305{}_e0_c0.nc"
    names_df = spark.createDataFrame([(base.format(t),) for t in ("1600204", "1610209", "1700204")] + [("x_M6C13.txt",)], "name string")
    cat = GR.catalogue(names_df)
    assert cat.count() == 3
    first = cat.orderBy("name").first()
    assert (first["start"].month, first["start"].day, first["start"].minute, first["start"].second) == (10, 31, 0, 20)
    asks = spark.sql("SELECT timestamp'2024-10-31 16:06:00' AS when, 13 AS channel UNION ALL SELECT timestamp'2024-10-31 19:00:00', 13")
    got = {r["when"].hour: r["name"] for r in GR.nearest_granule(asks, cat).collect()}
    assert "1610" in got[16] and got[19] is None
    days = spark.sql("SELECT date'2024-10-31' AS day UNION ALL SELECT date'2024-11-01'")
    loose = GR.complete_days(days, names_df, (16, 17, 18), (13,))
    assert names(loose) == ["2024-10-31"]
    assert GR.complete_days(days, names_df, (16, 17, 18), (13,), strict=True).isEmpty()
    assert names(GR.missing_days(days, loose)) == ["2024-11-01"]


def test_granule_of_a_day_without_an_hour(spark):
    names = [f"OR_ABI-L2-CMIPF-M6C07_G16_s2024123{h}00204_e0_c0.nc" for h in ("17", "16")]
    days = spark.createDataFrame([(dt.date(2024, 5, 2), 7), (dt.date(2024, 5, 3), 7)], "day date, channel int")
    got = GR.locate_granules(days, spark.createDataFrame([(n,) for n in names], "name string"))
    assert got.columns == ["day", "channel", "name", "is_fallback"]
    assert sorted((r["day"].day, r["name"], r["is_fallback"]) for r in got.collect()) == [(2, names[1], False), (3, None, False)]


def test_granule_lookup_reads_the_names_once(spark):
    names = [f"OR_ABI-L2-CMIPF-M6C07_G16_s2024123{h}00204_e0_c0.nc" for h in ("17", "16", "16")]
    days = spark.createDataFrame([(dt.date(2024, 5, 2), 7, 18), (dt.date(2024, 5, 2), 7, 17)], "day date, channel int, hour int")
    got = GR.locate_granules(days, spark.createDataFrame([(n,) for n in names], "name string"))
    assert "regexp_extract" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["hour"], r["name"], r["is_fallback"]) for r in got.collect()) == [(17, names[0], False), (18, names[1], True)]


def test_granule_names_are_parsed_once(spark):
    """Names of lines are told apart and stored before they are parsed."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("tables not present")
    plan = GR.catalogue(granule_names(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" in plan and "l_shipdate" not in plan and "lineitem" not in plan


def test_map_layers_and_records(spark, tmp_path):
    m = np.zeros((60, 60), dtype=bool)
    m[10, 10] = m[50, 50] = True
    spots = points_of(spark, [spot(10, 10), spot(30, 30)]).withColumn("datetime", F.lit("2024-10-31 16:48:00").cast("timestamp"))
    pts = sinks.map_points(mask_of(spark, m), spots, G, 5.0).cache()
    counts = {(r["layer"], r["klass"]): r["n"] for r in sinks.layer_counts(pts).collect()}
    assert counts == {("hotspot", "TP"): 1, ("hotspot", "FN"): 1, ("prediction", "TP"): 1, ("prediction", "FP"): 1}
    assert "2024-10-31 16:48 UTC" in pts.where("layer = 'hotspot'").first()["popup"]
    sinks.write_map(pts, str(tmp_path / "map"))
    line = spark.read.text(str(tmp_path / "map")).first()["value"]
    assert line.startswith('{"type":"Feature"') and "#" in line
    sinks.write_metric_records(spark.createDataFrame([(1, 0.5)], "scene_id int, f1 double"), {"hours": [16, 17]}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["hours"] == [16, 17]
    assert sinks.map_index(pts).first()["href"] == "scene_id=1"
