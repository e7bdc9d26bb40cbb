"""Exact per-group percentiles and the scores built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.session import cut, store

# A group up to this many rows is ranked inside one window; a larger grid takes the
# bracketed route, which never gathers a whole group.
WINDOW_ROWS = 1 << 20

Specs = Mapping[str, tuple[Column, float]]


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def pct(contamination: float) -> float:
    """Quantile that leaves ``contamination`` of the cells above it."""
    return 100.0 * (1.0 - contamination) / 100.0


def clamped_pct(contamination: float) -> float:
    return pct(min(max(contamination, 0.001), 0.5))


def with_quantiles(
    df: DataFrame, keys: Sequence[str], specs: Specs, group_rows: int | None = None
) -> DataFrame:
    """Attach exact linear-interpolation quantiles of each group as columns.

    ``specs`` maps an output name to ``(value, q)``; NULL values are left out of the pool.
    ``group_rows`` is the known bound on rows per group (the grid size).  Windows need no
    second pass over ``df`` and no shuffle when it is already partitioned by scene.
    """
    if group_rows is not None and group_rows > WINDOW_ROWS:
        return df.join(bracketed_quantiles(df, keys, specs), list(keys), "left")
    over = Window.partitionBy(*keys)
    return df.withColumns(
        {name: F.percentile(x, F.lit(float(q))).over(over) for name, (x, q) in specs.items()}
    )


def quantiles(df: DataFrame, keys: Sequence[str], specs: Specs, group_rows: int | None = None) -> DataFrame:
    """One row per group with the exact quantiles; groups beyond a bound of ``group_rows`` are bracketed first."""
    if group_rows is not None and group_rows > WINDOW_ROWS:
        return bracketed_quantiles(df, keys, specs)
    return df.groupBy(*keys).agg(
        *[F.percentile(x, F.lit(float(q))).alias(name) for name, (x, q) in specs.items()]
    )


def bracketed_quantiles(
    df: DataFrame, keys: Sequence[str], specs: Specs, accuracy: int = 2000
) -> DataFrame:
    """Exact quantiles of groups too large for one task.

    A sketch brackets each quantile; only values inside the bracket are counted and ranked,
    and values outside are merely counted.  The sketch error is below 1/accuracy of the group,
    so a bracket two errors and one rank wide always holds both neighbouring ranks.
    """
    keys = list(keys)
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q"), x.cast("double").alias("x"))
                    for n, (x, q) in specs.items()
                ]
            )
        ).alias("s"),
    ).select(*keys, "s.*").where(F.col("x").isNotNull())
    margin = 2.0 / accuracy + 1.0 / F.col("n")
    grid = [i / accuracy for i in range(accuracy + 1)]
    sketch = long.groupBy(*keys, "name", "q").agg(
        F.percentile_approx("x", grid, accuracy * 5).alias("p"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.count("x").alias("n"),
    )
    lo_at = (F.floor((F.col("q") - margin) * accuracy) + 1).cast("int")
    hi_at = (F.ceil((F.col("q") + margin) * accuracy) + 1).cast("int")
    bounds = sketch.select(
        *keys, "name", "q", "n",
        F.when(lo_at <= 1, F.col("x_min")).otherwise(F.get("p", lo_at - 1)).alias("lo"),
        F.when(hi_at > accuracy, F.col("x_max")).otherwise(F.get("p", hi_at - 1)).alias("hi"),
    )
    # Stored, so that its measured size lets the values stay where they are: few keys would otherwise
    # sort them in as few tasks.
    bounds = store(bounds, "bounds")
    on = [*keys, "name", "q"]
    tagged = long.join(bounds, on)
    counted = (
        tagged.where(F.col("x") <= F.col("hi"))
        .withColumn("v", F.when(F.col("x") >= F.col("lo"), F.col("x")))
        .groupBy(*on, "n", "v")
        .agg(F.count("*").alias("m"))
    )
    # The value-less row counts everything below the bracket and sorts first.
    ranked = counted.withColumn(
        "cum", F.sum("m").over(Window.partitionBy(*on).orderBy(F.col("v").asc_nulls_first()))
    )
    pos = (F.col("n") - 1) * F.col("q")
    at_lo = F.min(F.when(F.col("cum") > F.floor(pos), F.col("v")))
    at_hi = F.min(F.when(F.col("cum") > F.ceil(pos), F.col("v")))
    frac = F.first(pos - F.floor(pos))
    exact = ranked.groupBy(*keys, "name").agg((at_lo + (at_hi - at_lo) * frac).alias("value"))
    return exact.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in specs]
    )


def unit_between(x: Column, lo: Column, hi: Column) -> Column:
    """Scale to 0..1 between two quantiles; 0 when the pool was empty.

    ``least`` and ``greatest`` skip NULL, so an absent value must be settled before clipping.
    """
    return F.when(x.isNull() | lo.isNull(), F.lit(0.0)).otherwise(clip((x - lo) / (hi - lo + 1e-9)))


def with_robust_units(
    df: DataFrame,
    keys: Sequence[str],
    specs: Mapping[str, tuple[Column, Column, float, float]],
    group_rows: int | None = None,
) -> DataFrame:
    """Robust unit scaling: ``specs`` maps output -> (value, valid, q_lo, q_hi)."""
    wanted: dict[str, tuple[Column, float]] = {}
    for name, (x, valid, q_lo, q_hi) in specs.items():
        pool = F.when(valid, x)
        wanted[f"_{name}_lo"] = (pool, q_lo)
        wanted[f"_{name}_hi"] = (pool, q_hi)
    ranked = with_quantiles(df, keys, wanted, group_rows)
    units = {n: unit_between(x, F.col(f"_{n}_lo"), F.col(f"_{n}_hi")) for n, (x, *_rest) in specs.items()}
    return ranked.withColumns(units).drop(*wanted)


def counted_ranks(values: DataFrame, keys: Sequence[str], ranks: DataFrame, bins: int = 1024) -> DataFrame:
    """The ``rank``-th smallest ``x`` (from 1) of each group for every row (keys, name, rank) of ``ranks``.

    No group is ever sorted: a pass counts values by bin between the bounds still open, with the smallest
    and largest value of each bin; the bin that holds the rank gives the next bounds, until they are equal.
    Tasks shuffle at most ``bins`` rows for each group and name.  ``x`` must be finite or null (not
    counted); ranks outside 1..n give no row; keys must not be named like the columns used here.
    ``values`` is read once a pass, so store it first.
    """
    keys, names = list(keys), [*keys, "name"]
    pool = values.where(F.col("x").isNotNull()).select(*keys, "x")
    extent = pool.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    asked = ranks.join(extent, keys).where(F.col("rank").between(1, F.col("n")))
    state = store(asked.select(*names, F.col("rank").cast("bigint").alias("rank"), "lo", "hi"), "ranks")
    done = []
    lo, hi, x = (F.col(c) / 2.0 for c in ("lo", "hi", "x"))  # halves, as hi - lo may overflow
    upper = (F.col("x") > F.col("lo")).cast("bigint")  # the smallest doubles are equal once halved
    spot = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(upper)
    before = Window.partitionBy(*names).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        done.append(state.where("lo = hi").select(*names, F.col("lo").alias("x")))
        still = state.where("lo < hi")
        if still.isEmpty():
            break
        met = pool.join(still, keys).where(F.col("x").between(F.col("lo"), F.col("hi")))
        counted = met.groupBy(*names, "rank", spot.alias("bin")).agg(
            F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")
        )
        below = counted.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
        held = below.where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("n")))
        state = store(held.select(*names, (F.col("rank") - F.col("below")).alias("rank"), "lo", "hi"), "ranks")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found


def with_varying_quantile(
    df: DataFrame, keys: Sequence[str], x: Column, pool: Column, q: Column, out: str, group_rows: int | None = None
) -> DataFrame:
    """Quantile whose level differs by group: two ranks of the pool, interpolated.

    ``group_rows`` is the known bound on rows per group; up to ``WINDOW_ROWS`` a window ranks the pool
    in place, larger or unknown groups are ranked by counting.
    """
    if group_rows is None or group_rows > WINDOW_ROWS:
        keys = list(keys)
        kept = cut(df.withColumns({"_x": F.when(pool, x).cast("double"), "_q": q}))
        size = kept.groupBy(*keys).agg(F.count("_x").alias("_n"), F.max("_q").alias("_q"))
        pos = (F.col("_n") - 1) * F.col("_q")
        size = store(size.select(*keys, pos.alias("_pos")), "levels")
        asked = size.select(*keys, F.explode(F.create_map(F.lit("lo"), F.floor("_pos") + 1, F.lit("hi"), F.ceil("_pos") + 1)).alias("name", "rank"))
        found = counted_ranks(kept.select(*keys, F.col("_x").alias("x")), keys, asked)
        both = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("x"))).alias(f"_{n}") for n in ("lo", "hi")])
        level = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))
        return kept.drop("_x", "_q").join(size.join(both, keys).select(*keys, level.alias(out)), keys, "left")
    ordered = Window.partitionBy(*keys, "_pool").orderBy("_x")
    whole = Window.partitionBy(*keys)
    pos = (F.col("_n") - 1) * F.col("_q")
    at = lambda k: F.max(F.when(F.col("_rank") == k, F.col("_x"))).over(whole)
    return (
        df.withColumns({"_x": F.when(pool, x), "_q": q})
        .withColumn("_pool", F.col("_x").isNotNull())
        .withColumns(
            {
                "_rank": F.when(F.col("_pool"), F.row_number().over(ordered) - 1),
                "_n": F.count("_x").over(whole),
            }
        )
        .withColumns({"_lo": at(F.floor(pos)), "_hi": at(F.ceil(pos))})
        .withColumn(out, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos)))
        .drop("_x", "_q", "_pool", "_rank", "_n", "_lo", "_hi")
    )


def percentile_mask(
    df: DataFrame, x: Column, pool: Column, q: float, keys: Sequence[str], group_rows: int | None = None
) -> DataFrame:
    """Rows of the pool at or above its quantile ``q``."""
    marked = with_quantiles(df, keys, {"_thr": (F.when(pool, x), q)}, group_rows)
    return marked.where(pool & (x >= F.col("_thr"))).drop("_thr")


def percentile_rank(
    pool: DataFrame, probes: DataFrame, keys: Sequence[str], value: str, probe: str, out: str = "rank_pct"
) -> DataFrame:
    """Adds to ``probes`` 100 * share of the group's pool that is <= the probe value.

    Equal values collapse to counts before the running sum, so many probes at one value are one
    row of the window; the ranks come back by an equi-join.
    """
    keys = list(keys)
    marks = pool.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"), F.lit(1).alias("_m")).unionByName(
        probes.where(F.col(probe).isNotNull()).select(*keys, F.col(probe).alias("_x"), F.lit(0).alias("_m"))
    )
    counted = marks.groupBy(*keys, "_x").agg(F.sum("_m").alias("_m"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranks = counted.select(
        *keys, F.col("_x").alias(probe),
        (100.0 * F.sum("_m").over(upto) / F.greatest(F.sum("_m").over(group), F.lit(1))).alias(out),
    )
    return probes.join(ranks, [*keys, probe])


def with_in_top(
    df: DataFrame, keys: Sequence[str], score: Column, k: Column, out: str, group_rows: int | None = None
) -> DataFrame:
    """Marks rows scoring at least the k-th largest score of their group; ties at the cut stay.

    ``k`` is an aggregate over the group.  Null scores come last: they are in only where k exceeds the
    number of scores.  Routes as in :func:`with_varying_quantile`.
    """
    keys = list(keys)
    if group_rows is not None and group_rows <= WINDOW_ROWS:
        scene = Window.partitionBy(*keys)
        ranked = df.withColumns({"_k": k.over(scene), "_rank": F.rank().over(scene.orderBy(score.desc()))})
        return ranked.withColumn(out, F.col("_rank") <= F.col("_k")).drop("_k", "_rank")
    kept = cut(df.withColumn("_x", score.cast("double")))
    size = store(kept.groupBy(*keys).agg(k.cast("bigint").alias("_k"), F.count("_x").alias("_n")), "sizes")
    asked = size.where("_k >= 1").select(*keys, F.lit("cut").alias("name"), (F.col("_n") - F.col("_k") + 1).alias("rank"))
    found = counted_ranks(kept.select(*keys, F.col("_x").alias("x")), keys, asked)
    limits = size.join(found.select(*keys, F.col("x").alias("_cut")), keys, "left")
    inside = (F.col("_k") > F.col("_n")) | F.coalesce(F.col("_x") >= F.col("_cut"), F.lit(False))
    return kept.join(limits, keys).withColumn(out, inside).drop("_x", "_k", "_n", "_cut")


def top_k_with_ties(
    df: DataFrame, keys: Sequence[str], score: Column, k: Column, group_rows: int | None = None
) -> DataFrame:
    """Rows scoring at least the k-th largest score of the group (``k`` the same for its rows); ties at the cut stay."""
    return with_in_top(df, keys, score, F.max(k), "_in", group_rows).where("_in").drop("_in")


def five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(value).alias("min_v"),
        F.percentile(value, F.lit(0.25)).alias("p25"),
        F.percentile(value, F.lit(0.5)).alias("med"),
        F.percentile(value, F.lit(0.75)).alias("p75"),
        F.max(value).alias("max_v"),
    )


def ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = max(beta, 1e-9) ** 2
    den = b2 * precision + recall
    return F.when(den > 1e-15, (1.0 + b2) * precision * recall / den).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2.0 * precision * recall, precision + recall)
