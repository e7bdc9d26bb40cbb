import numpy as np
from pyspark.sql import functions as F

from firegrid.functions import stats


def groups(spark, values: dict[int, np.ndarray]):
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    return spark.createDataFrame(rows, "k int, x double")


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    values = {1: rng.normal(size=501), 2: rng.normal(size=2), 3: np.array([4.0])}
    df = groups(spark, values)
    got = {r["k"]: (r["a"], r["b"]) for r in stats.quantiles(df, ["k"], {"a": (F.col("x"), 0.03), "b": (F.col("x"), 0.88)}).collect()}
    for k, v in values.items():
        assert np.allclose(got[k], np.percentile(v, [3, 88]), atol=1e-12)


def test_bracketed_route_is_exact_with_hot_values(spark):
    rng = np.random.default_rng(1)
    values = {
        1: np.concatenate([np.full(4000, 0.25), rng.normal(size=8000)]),
        2: rng.exponential(size=5000),
        3: np.array([1.0, 2.0, 4.0]),
        4: np.zeros(100),
    }
    df = groups(spark, values)
    specs = {f"q{i}": (F.col("x"), q) for i, q in enumerate((0.0, 0.03, 0.5, 0.6, 0.97, 0.996, 1.0))}
    got = {r["k"]: [r[n] for n in specs] for r in stats.bracketed_quantiles(df, ["k"], specs).collect()}
    for k, v in values.items():
        assert np.allclose(got[k], np.percentile(v, [0, 3, 50, 60, 97, 99.6, 100]), atol=1e-12), k


def test_bracketed_values_are_not_sorted_by_key(spark):
    df = spark.range(1_000_000).select((F.col("id") % 3).alias("k"), F.sqrt("id").alias("x"))
    specs = {"a": (F.col("x"), 0.55), "b": (F.col("x"), 0.98)}
    found = stats.bracketed_quantiles(df, ["k"], specs)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: (r["a"], r["b"]) for r in found.collect()}
    for k in range(3):
        assert np.allclose(got[k], np.percentile(np.sqrt(np.arange(k, 1_000_000, 3)), [55, 98]), atol=1e-9)


def test_large_groups_take_the_bracketed_route(spark):
    df = groups(spark, {1: np.arange(100.0)})
    a = stats.with_quantiles(df, ["k"], {"t": (F.col("x"), 0.9)}).first()["t"]
    b = stats.with_quantiles(df, ["k"], {"t": (F.col("x"), 0.9)}, stats.WINDOW_ROWS + 1).first()["t"]
    assert abs(a - b) < 1e-12 and abs(a - 89.1) < 1e-9


def test_varying_quantile(spark):
    rng = np.random.default_rng(2)
    values = {1: rng.normal(size=77), 2: rng.normal(size=10)}
    level = F.when(F.col("k") == 1, 0.81).otherwise(0.5)
    got = stats.with_varying_quantile(groups(spark, values), ["k"], F.col("x"), F.lit(True), level, "t")
    found = {r["k"]: r["t"] for r in got.select("k", "t").distinct().collect()}
    assert np.allclose([found[1], found[2]], [np.percentile(values[1], 81), np.percentile(values[2], 50)])


def test_robust_unit_edges(spark):
    df = groups(spark, {1: np.full(5, 7.0), 2: np.array([0.0, 10.0])})
    got = stats.with_robust_units(df, ["k"], {"u": (F.col("x"), F.col("k") == 2, 0.05, 0.95)})
    rows = {(r["k"], r["x"]): r["u"] for r in got.collect()}
    assert rows[(1, 7.0)] == 0.0 and rows[(2, 0.0)] == 0.0 and rows[(2, 10.0)] == 1.0


def test_rank_and_top_k(spark):
    pool = np.array([1.0, 2.0, 2.0, 5.0])
    probes = [0.5, 2.0, 9.0]
    asked = groups(spark, {1: np.array(probes + [2.0] * 50)}).withColumnRenamed("x", "probe")
    ranked = stats.percentile_rank(groups(spark, {1: pool}), asked, ["k"], "x", "probe").collect()
    assert len(ranked) == 53
    assert {r["probe"]: r["rank_pct"] for r in ranked} == {0.5: 0.0, 2.0: 75.0, 9.0: 100.0}
    assert stats.top_k_with_ties(groups(spark, {1: pool}), ["k"], F.col("x"), F.lit(2)).count() == 3


HOT = {
    1: np.concatenate([np.full(3000, 0.25), np.random.default_rng(4).normal(size=2000)]),
    2: np.array([-1.7e308, 1.7e308, 0.0, 5e-324]),
    3: np.array([2.0]),
}


def test_counted_ranks_are_exact(spark):
    df = groups(spark, HOT).unionByName(spark.createDataFrame([(1, None), (4, None)], "k int, x double"))
    asked = [(k, f"r{r}", r) for k, v in HOT.items() for r in {0, 1, 2, len(v) // 2, len(v) - 1, len(v), len(v) + 1}]
    ranks = spark.createDataFrame(asked + [(4, "r1", 1)], "k int, name string, rank int")
    found = {(r["k"], r["name"]): r["x"] for r in stats.counted_ranks(df, ["k"], ranks, bins=8).collect()}
    assert found == {(k, n): np.sort(HOT[k])[r - 1] for k, n, r in asked if 1 <= r <= len(HOT[k])}


def test_counting_and_windows_mark_the_same_rows(spark):
    rows = groups(spark, {1: HOT[1], 2: np.array([3.0, 1.0, 2.0, 2.0])})
    rows = rows.unionByName(spark.createDataFrame([(2, None), (5, None)], "k int, x double"))
    for k in (0, 1, 4, 5, 2000):
        a, b = (stats.top_k_with_ties(rows, ["k"], F.col("x"), F.lit(k), n) for n in (None, 100))
        count = lambda d: sorted(map(str, d.groupBy("k", "x").count().collect()))
        assert count(a) == count(b), k


def test_counting_never_sorts_a_group(spark):
    top = stats.top_k_with_ties(groups(spark, {1: HOT[1]}), ["k"], F.col("x"), F.lit(7))
    assert "Window" not in top._jdf.queryExecution().executedPlan().toString()
    assert stats.top_k_with_ties(top.limit(0), ["k"], F.col("x"), F.lit(7)).count() == 0
