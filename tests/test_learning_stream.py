import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.operators import boosting as B
from firegrid.operators import detectors as D
from firegrid.operators import evaluate as E
from firegrid.operators import features as M
from firegrid.operators import learning as L
from firegrid.operators import logistic as LR
from firegrid.operators import twin as T
from firegrid.operators.grid import hourly_cube
from firegrid.plans import day_products as DP
from firegrid.plans import sweeps as W
from firegrid.session import cut, scratch_path
from firegrid.streaming import risk as ST

from .helpers import STREWN, cube_of, grid_of, strewn_fires, to_array, to_mask

GRID = grid_of(*STREWN)


@pytest.fixture(scope="module")
def scene(spark):
    cubes, spots = None, []
    for k in (1, 2):
        hours, truth = strewn_fires(seed=k)
        part = cube_of(spark, hours, k)
        cubes = part if cubes is None else cubes.unionByName(part)
        spots += [
            (k, float(GRID.min_lat + GRID.lat_step * (r + 0.5)), float(GRID.min_lon + GRID.lon_step * (c + 0.5)))
            for r, c in np.argwhere(truth)
        ]
    hotspots = spark.createDataFrame(spots, "scene_id int, lat double, lon double")
    cube = cut(cubes.repartition("scene_id"))
    return cube, hotspots, truth, cut(DP.labelled_features(cube, hotspots, GRID))


def truth_of(seed):
    return strewn_fires(seed=seed)[1]


def test_features_match_arrays(spark, scene):
    cube, _, truth, table = scene
    hours, _ = strewn_fires(seed=1)
    mine = table.where("scene_id = 1")
    b13 = np.stack([h[13] for h in hours])
    assert np.allclose(to_array(mine, "bt13_max", truth.shape), b13.max(0))
    assert np.allclose(to_array(mine, "btd_median", truth.shape), np.median(np.stack([h[7] - h[14] for h in hours]), 0))
    want = sum((b >= np.percentile(b, 70)).astype(float) for b in b13)
    assert np.array_equal(to_array(mine, "persist_h", truth.shape), want)
    pad = np.pad(b13.max(0), 10, mode="edge")
    bg = np.median(np.lib.stride_tricks.sliding_window_view(pad, (21, 21)), axis=(2, 3))
    assert np.allclose(to_array(mine, "bt13_anom_21", truth.shape), b13.max(0) - bg)
    assert mine.where("label").count() == 9 * truth_of(1).sum()


@pytest.mark.parametrize("cfg", [L.ClassifierConfig(), L.multiday_config(rounds=10)])
def test_classifiers_rank_the_points(scene, cfg):
    _, _, _, table = scene
    truth = truth_of(1)
    prob = cut(L.predict_probability(L.fit_classifier(table, cfg), table))
    low, high = prob.agg(F.min("prob"), F.max("prob")).first()
    assert 0 <= low <= high <= 1
    mine = prob.where("scene_id = 1")
    p = to_array(mine, "prob", truth.shape)
    assert p[truth].mean() > p.mean() + 0.2
    peaks = to_mask(L.peak_mask(mine, 0.3, 2, 0.0), truth.shape)
    assert not (peaks & ~(p >= 0.3)).any()
    assert not (peaks & ~to_mask(L.grown_peaks(mine, GRID, 0.3, 2, 0.0, 2), truth.shape)).any()


def test_unknown_classifier_and_one_class(scene):
    _, _, _, table = scene
    with pytest.raises(ValueError):
        L.fit_classifier(table, L.ClassifierConfig(kind="forest"))
    with pytest.raises(ValueError):
        L.fit_classifier(table.where("NOT label"))


def test_newton_steps_end_at_the_optimum_of_every_fold(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 2)) * [1.0, 50.0] + [3.0, -7.0]
    y = (x[:, 0] - 3 + rng.normal(size=600) > 0.8).astype(int)
    fold = rng.integers(0, 2, 600)
    rows = spark.createDataFrame([(float(a), float(b), 5.0, int(t), int(f)) for (a, b), t, f in zip(x, y, fold)], "a double, b double, k double, label int, f int")
    got = LR.fit_logistic(rows, ("a", "b", "k"), 0.5, 50, F.col("f"), (0, None))
    for i, left in enumerate((0, None)):
        keep = np.ones(600, bool) if left is None else fold != left
        u, t = x[keep], y[keep]
        z = np.column_stack([(u - u.mean(0)) / u.std(0), np.zeros(len(u)), np.ones(len(u))])
        w = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum())))
        p = 1 / (1 + np.exp(-z @ got.beta[i]))
        gradient = z.T @ (w * (p - t)) + np.append(got.beta[i][:3] / 0.5, 0.0)
        assert np.abs(gradient).max() < 1e-6 and got.beta[i][2] == 0 and got.beta[i][0] > 1


def test_folds_partition_the_grid(scene):
    _, _, truth, table = scene
    fold = to_array(table.where("scene_id = 1").withColumn("fold", M.spatial_fold(GRID)), "fold", truth.shape)
    rows, columns = [0, 12, 24, 36], [0, 14, 29, 44]
    for i in range(3):
        for j in range(3):
            assert (fold[rows[i] : rows[i + 1], columns[j] : columns[j + 1]] == 3 * i + j).all()


def test_leave_one_out_and_summary(scene):
    _, hotspots, _, table = scene
    rows = cut(L.leave_one_scene_out(table, hotspots, GRID, [1, 2], L.multiday_config(kind="logreg"), 30.0, 0.5))
    assert sorted(r["scene_id"] for r in rows.collect()) == [1, 2]
    s = L.held_out_summary(rows).first()
    f = [r["f1"] for r in rows.collect()]
    assert s["n"] == 2 and s["f1_mean"] == pytest.approx(np.mean(f)) and s["f1_std"] == pytest.approx(np.std(f))


def test_event_sweep_has_every_setting(scene):
    cube, hotspots, _, _ = scene
    space = {
        "median_sizes": ((3,),), "btd_low": (10.0,), "btd_high": (99.0,), "risk_percentile": (90.0, 97.0),
        "min_active_hours": (1, 2), "weight_anomaly": (0.55,), "weight_persistence": (0.25,), "max_component": (1, 0),
    }
    rows = W.event_sweep(cube, hotspots, GRID, 3, space, 30.0).collect()
    assert len(rows) == 2 * 8
    loose = {(r["scene_id"], r["min_active_hours"], r["max_component"], r["risk_percentile"]): r["n_components"] for r in rows}
    assert all(loose[(1, h, 0, 90.0)] >= loose[(1, h, 1, 90.0)] for h in (1, 2))


def test_event_sweep_equals_single_runs(scene):
    cube, hotspots, _, _ = scene
    space = {
        "median_sizes": ((3,), (3, 5)), "btd_low": (10.0, 30.0), "btd_high": (95.0,), "risk_percentile": (90.0, 97.0),
        "min_active_hours": (1, 2), "weight_anomaly": (0.45, 0.65), "weight_persistence": (0.25,), "max_component": (3, 0),
    }
    rows = cut(W.event_sweep(cube, hotspots, GRID, 3, space, 30.0))
    assert rows.count() == 2 * 64
    names = ("n_focos", "n_components", "tp", "fp", "fn")
    for sizes, low, pct, hours, wa, most in (((3, 5), 30.0, 97.0, 2, 0.65, 3), ((3,), 10.0, 90.0, 1, 0.45, 0)):
        cfg = D.EventConfig(
            median_sizes=sizes, btd_low=low, btd_high=95.0, risk_percentile=pct, min_active_hours=hours, weight_anomaly=wa,
            weight_band=max(0.05, 1 - wa - 0.25), weight_persistence=0.25, min_component=1, max_component=most, opening_rounds=0,
        )
        mask = D.event_detector(cube, GRID, 3, cfg)
        one = E.event_metrics(mask, hotspots, GRID, 30.0, scenes=cube.select("scene_id").distinct()).collect()
        mine = rows.where(
            (F.col("sizes") == ",".join(map(str, sizes))) & (F.col("btd_low") == low) & (F.col("risk_percentile") == pct)
            & (F.col("min_active_hours") == hours) & (F.col("weight_anomaly") == wa) & (F.col("max_component") == most)
        ).collect()
        pick = lambda some: sorted((r["scene_id"], *(r[n] for n in names if n in r.asDict())) for r in some)
        assert pick(mine) == pick(one)


def plain_boosting(x, y, left_out, fold, cfg, edges):
    """One model, row by row in numpy."""
    mine = fold != left_out
    b = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    w = np.where(y == 1, mine.sum() / (2 * (y[mine] == 1).sum()), mine.sum() / (2 * (y[mine] == 0).sum()))
    margin = np.zeros(len(x))
    for _ in range(cfg.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def grow(rows, depth):
            inside = rows & mine
            if depth < cfg.depth:
                best = (0.0, None)
                for f in range(x.shape[1]):
                    for s in range(cfg.bins):
                        left, right = inside & (b[:, f] <= s), inside & (b[:, f] > s)
                        if left.sum() < cfg.min_leaf or right.sum() < cfg.min_leaf:
                            continue
                        gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[right].sum(), h[right].sum()
                        gain = round(gl**2 / hl + gr**2 / hr - (gl + gr) ** 2 / (hl + hr), 9)
                        if gain > best[0]:
                            best = gain, (f, s)
                if best[1]:
                    f, s = best[1]
                    grow(rows & (b[:, f] <= s), depth + 1)
                    grow(rows & (b[:, f] > s), depth + 1)
                    return
            margin[rows] -= cfg.rate * g[inside].sum() / h[inside].sum()

        grow(np.ones(len(x), bool), 0)
    return 1 / (1 + np.exp(-margin))


def test_boosted_trees_match_a_plain_fit(spark, monkeypatch):
    monkeypatch.setattr(B, "ROUNDS_PER_CUT", 2)
    monkeypatch.setattr(B, "DIRECT", 1)
    monkeypatch.setattr(B, "TASK_ROWS", 50)
    r = np.random.default_rng(6)
    x = np.round(r.standard_normal((300, 3)), 2)
    y = (x[:, 0] + x[:, 1] ** 2 + 0.5 * r.standard_normal(300) > 0.8).astype(int)
    fold = r.integers(0, 3, 300)
    rows = [(i, *map(float, x[i]), int(y[i]), int(fold[i]), bool(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, label int, fold int, valid boolean").repartition(5)
    cfg = B.BoostingConfig(depth=3, rate=0.3, rounds=5, bins=12, min_leaf=8)
    trees = B.fit_trees(df, ("a", "b", "c"), cfg, F.col("fold"), [0, 1, 2])
    got = {q["i"]: q["prob"] for q in B.predict_trees(trees, df, ("a", "b", "c"), F.col("fold")).collect()}
    for k in range(3):
        want = plain_boosting(x, y, k, fold, cfg, trees.edges)
        for i in np.flatnonzero(fold == k):
            assert got[i] == pytest.approx(want[i] if i % 7 else 0.0, abs=1e-9)
    with pytest.raises(ValueError):
        B.fit_trees(df.where("label = 1"), ("a", "b", "c"), cfg)


def stream_of(spark, df, name, parts):
    path = scratch_path(spark, name)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_equals_batch_and_flags_late_hours(spark, scene):
    cube, _, _, _ = scene
    scored = cut(T.hourly_anomaly_score(cube.where("scene_id = 1"), GRID).select("scene_id", "hour_seq", "r", "c", "score", "score_valid"))
    hour = lambda s: scored.where(F.col("hour_seq") == s)
    base = scratch_path(spark, "t")
    ST.run_to_parquet(ST.risk_states(stream_of(spark, scored, "s", [hour(0), hour(1), hour(2), hour(3), hour(1)])), f"{base}/o", f"{base}/c")
    updates = spark.read.parquet(f"{base}/o")
    assert updates.where("late = 1").count() == STREWN[0] * STREWN[1]
    got = to_array(ST.latest_risk(updates), "risk", STREWN)
    assert np.allclose(got, to_array(T.assimilate(scored), "risk", STREWN), atol=1e-12)
    with pytest.raises(ValueError):
        ST.risk_states(scored, mode="sum")


def test_pixels_to_risk_in_one_stream(spark):
    """Hours arrive out of order inside the delay; the last ones stay open until the watermark closes them."""
    h, w = 12, 14
    g = grid_of(h, w)
    rng = np.random.default_rng(4)
    parts = []
    for hour in (0, 1, 3, 2, 4, 30):
        rows = []
        for r in range(h):
            for c in range(w):
                lat, lon = float(g.min_lat + g.lat_step * (r + 0.5)), float(g.min_lon + g.lon_step * (c + 0.5))
                rows += [(1 + hour // 24, hour, lat, lon, ch, float(b), 0) for ch, b in zip((7, 13, 14), rng.normal((300, 295, 291), 3.0))]
        df = spark.createDataFrame(rows, "scene_id int, h int, lat double, lon double, channel int, bt double, dqf int")
        parts.append(df.withColumn("ts", F.expr("timestamp'2024-05-01 00:10:00' + make_dt_interval(0, h)")).drop("h"))
    base = scratch_path(spark, "r")
    query = ST.advance_risk(stream_of(spark, parts[0], "p", parts), g, f"{base}/o", f"{base}/c", median_sizes=(3, 5), delay="3 hours")
    query.awaitTermination()
    last = max(int(f.split("=")[1]) for f in __import__("os").listdir(f"{base}/o".removeprefix("file:")) if f.startswith("batch="))
    got = to_array(spark.read.parquet(f"{base}/o/batch={last}").where("scene_id = 1"), "risk", (h, w))
    cells = None
    for p, seq in zip(parts[:5], (0, 1, 3, 2, 4)):
        one = p.withColumn("hour", F.lit(seq)).withColumn("hour_seq", F.lit(seq))
        cells = one if cells is None else cells.unionByName(one)
    batch = T.assimilate(T.hourly_anomaly_score(hourly_cube(cells, g), g, (3, 5)))
    assert np.allclose(got, to_array(batch, "risk", (h, w)), atol=1e-9)


def test_product_run(scene):
    cube, hotspots, _, _ = scene
    out = DP.day_products(cube, hotspots, hotspots, GRID, L.multiday_config(kind="logreg"), 0.5)
    scores = {k: v.collect() for k, v in DP.score_products(out, hotspots, GRID, 30.0).items()}
    assert set(scores) == {"peaks", "precise", "fused"} and all(len(v) == 2 for v in scores.values())
    assert out.precise.join(out.peaks, ["scene_id", "r", "c"], "left_anti").isEmpty()


def test_state_of_a_cell_ends_after_its_day(spark):
    """Cell 0 is seen on the first day only, then again on the third; cell 1 moves the watermark on."""
    path, base = scratch_path(spark, "obs"), scratch_path(spark, "expiry")
    schema = "scene_id int, r int, c int, hour_seq int, score double, score_valid boolean, ts timestamp"
    query = lambda: ST.risk_states(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), ts="ts"
    )
    risks = {}
    for step, (cell, hour) in enumerate([(0, 0), (0, 1), (1, 48), (1, 49), (0, 50)]):
        row = spark.createDataFrame([(1, 0, cell, hour, 0.5, True)], schema.rsplit(",", 1)[0])
        row.withColumn("ts", F.timestamp_seconds(F.lit(8.0e8) + F.col("hour_seq") * 3600)).coalesce(1).write.mode("append").parquet(path)
        ST.run_to_parquet(query(), f"{base}/o", f"{base}/c")
        kept = spark.read.format("statestore").load(f"{base}/c").select("key.*").collect()
        risks[step] = {r["c"] for r in kept}
    assert 0 in risks[1] and risks[3] == {1} and risks[4] == {0, 1}
    out = {(r["c"], r["hour_seq"]): r["risk"] for r in spark.read.parquet(f"{base}/o").collect()}
    assert out[(0, 1)] == 0.625 and out[(0, 50)] == 0.5 and out[(1, 49)] == 0.625


def test_fold_search_reads_the_hotspots_once(spark, scene):
    _, hotspots, _, table = scene
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    counted = cut(hotspots).mapInPandas(counting, hotspots.schema)
    fold = (F.col("c") >= GRID.w // 2).cast("int")

    def best(spots):
        found = L.fold_best_threshold(table, spots, GRID, fold, range(2), [0.3, 0.7], (1,), radius_km=20.0)
        return {(r["scene_id"], r["fold"]): (r["n_focos"], r["tp_recall"], r["tp_precision"]) for r in found.collect()}

    once = best(counted)
    assert seen.value == hotspots.count()
    twice = best(hotspots.unionByName(hotspots))
    assert twice == {k: (2 * n, 2 * tp, units) for k, (n, tp, units) in once.items()} and any(tp for _, tp, _ in once.values())
