import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.functions import geo
from firegrid.operators import grid as G
from firegrid.schema import state_grid

from .helpers import grid_of, points_of


@pytest.mark.parametrize("n", [24, 48, 72, 144, 192])
def test_every_edge_lands_in_the_bin_it_opens(spark, n):
    g = state_grid(n, n)
    edges = np.linspace(g.min_lat, g.max_lat, n + 1)
    rows = points_of(spark, [(e, -39.0) for e in edges]).coalesce(1)
    got = [r["r"] for r in G.assign_cells(rows, g).orderBy("lat").collect()]
    assert got == [min(i, n - 1) for i in range(n + 1)]


def test_random_points_match_digitize(spark):
    g = state_grid(72, 72)
    rng = np.random.default_rng(0)
    lat, lon = rng.uniform(-8.2, -2.2, 400), rng.uniform(-41.8, -36.8, 400)
    rows = spark.createDataFrame(
        [(1, float(a), float(b), i) for i, (a, b) in enumerate(zip(lat, lon))], "scene_id int, lat double, lon double, i int"
    )
    le, oe = np.linspace(g.min_lat, g.max_lat, 73), np.linspace(g.min_lon, g.max_lon, 73)
    for closed in (True, False):
        got = {r["i"]: (r["r"], r["c"]) for r in G.assign_cells(rows, g, closed).collect()}
        r, c = np.digitize(lat, le) - 1, np.digitize(lon, oe) - 1
        want = {i: (r[i], c[i]) for i in range(400) if 0 <= r[i] < 72 and 0 <= c[i] < 72}
        assert got == want


def test_top_edge_rules(spark):
    g = grid_of(10, 10)
    rows = points_of(spark, [(-2.0, -36.0), (-8.0, -42.0)])
    assert {(r["r"], r["c"]) for r in G.assign_cells(rows, g, True).collect()} == {(9, 9), (0, 0)}
    assert {(r["r"], r["c"]) for r in G.assign_cells(rows, g, False).collect()} == {(0, 0)}


def pixel_rows(spark):
    rows = [
        (1, 16, 0, 13, -7.95, -41.95, 300.0, 0),
        (1, 16, 0, 13, -7.95, -41.95, 302.0, 0),
        (1, 16, 0, 13, -7.95, -41.95, 400.0, 0),
        (1, 16, 0, 13, -7.95, -41.95, 290.0, 1),
        (1, 16, 0, 7, -7.95, -41.95, 310.0, 0),
        (1, 16, 0, 13, -2.05, -36.05, float("nan"), 0),
        (1, 17, 1, 13, -2.05, -36.05, 295.0, 0),
    ]
    return spark.createDataFrame(
        rows, "scene_id int, hour int, hour_seq int, channel int, lat double, lon double, bt double, dqf int"
    )


def test_cube_is_dense_and_keeps_gaps(spark):
    g = grid_of(4, 5)
    cube = G.hourly_cube(pixel_rows(spark), g)
    assert cube.count() == 2 * 20
    first = cube.where("hour = 16 AND r = 0 AND c = 0").first()
    assert (first["bt13"], first["bt7"], first["bt14"]) == (301.0, 310.0, None)
    assert cube.where("bt13 IS NOT NULL").count() == 2
    assert cube.where(F.isnan("bt13")).count() == 0
    other = G.complete_grid(G.pivot_channels(G.bin_mean(pixel_rows(spark), g)), g)
    same = cube.exceptAll(other.select(cube.columns))
    assert same.isEmpty()


def test_valid_needs_every_hour_and_channel(spark):
    g = grid_of(1, 2)
    rows = [(1, h, h, ch, -5.0, lon, 300.0, 0) for h in (0, 1) for ch in (7, 13, 14) for lon in (-40.0, -37.0)]
    rows.remove((1, 1, 1, 14, -5.0, -37.0, 300.0, 0))
    px = spark.createDataFrame(rows, "scene_id int, hour int, hour_seq int, channel int, lat double, lon double, bt double, dqf int")
    got = {r["c"]: r["valid"] for r in G.valid_cells(G.hourly_cube(px, g)).collect()}
    assert got == {0: True, 1: False}


def test_filters_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "pixels")
    pixel_rows(spark).write.parquet(path)
    df = G.hourly_cube(spark.read.parquet(path), grid_of(4, 5))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(bt,180.0)" in text and "EqualTo(dqf,0)" in text
    assert "GreaterThanOrEqual(lat,-8.0)" in text
    assert "partial_avg" in text


def test_rectangle_includes_pixels_outside_the_box(spark):
    g = grid_of(4, 4)
    rows = [(1, 0, 0, -5.0, -39.0), (1, 2, 2, -4.0, -38.0), (1, 1, 1, 9.0, 9.0), (1, 5, 5, 9.0, 9.0)]
    px = spark.createDataFrame(rows, "scene_id int, x int, y int, lat double, lon double")
    assert sorted(r["x"] for r in G.crop_to_window(px, g).collect()) == [0, 1, 2]


def test_day_window_is_half_open(spark):
    rows = spark.sql(
        "SELECT explode(array(timestamp'2024-10-31 00:00:00', timestamp'2024-10-31 23:59:59', timestamp'2024-11-01 00:00:00')) AS datetime"
    )
    assert G.day_filter(rows, "2024-10-31").count() == 2


def test_scan_angles_at_and_off_the_earth(spark):
    rows = spark.sql("SELECT 0e0 AS x, 0e0 AS y UNION ALL SELECT 0.3e0, 0e0 UNION ALL SELECT 0.05e0, 0.04e0")
    lat, lon = geo.scan_angle_latlon(F.col("x"), F.col("y"), 35786023.0, -75.0, 6378137.0, 6356752.31414)
    got = rows.select("x", lat.alias("lat"), lon.alias("lon")).orderBy("x").collect()
    assert abs(got[0]["lat"]) < 1e-9 and abs(got[0]["lon"] + 75.0) < 1e-9
    assert got[1]["lat"] > 0 and got[1]["lon"] > -75.0
    assert got[2]["lat"] is None
    # Forward projection of the middle point returns its angles.
    la, lo = np.radians(got[1]["lat"]), np.radians(got[1]["lon"] + 75.0)
    a, b, h = 6378137.0, 6356752.31414, 35786023.0 + 6378137.0
    pc = np.arctan((b / a) ** 2 * np.tan(la))
    rc = b / np.sqrt(1 - (1 - (b / a) ** 2) * np.cos(pc) ** 2)
    sx, sy, sz = h - rc * np.cos(pc) * np.cos(lo), -rc * np.cos(pc) * np.sin(lo), rc * np.sin(pc)
    assert abs(np.arctan(sz / sx) - 0.04) < 1e-9
    assert abs(np.arcsin(-sy / np.sqrt(sx**2 + sy**2 + sz**2)) - 0.05) < 1e-9
