"""Incremental operation: hourly binning, scoring of closed hours, risk state per cell."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from firegrid.operators import grid as G
from firegrid.operators.neighborhood import settle
from firegrid.operators.twin import fuse_step, hourly_anomaly_score
from firegrid.schema import CHANNELS, GridSpec
from firegrid.session import cut

RISK_OUTPUT = "scene_id {scene}, r int, c int, hour_seq int, risk double, late int"
RISK_STATE = "risk double, last_hour int, ends long"


def hourly_cells(pixels: DataFrame, grid: GridSpec, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Streaming binning: quality filter, one-hour tumbling window, mean per channel and cell.

    ``hour`` is the clock hour of the window and ``hour_seq`` its number, which orders the hours of
    all days.  Pixels older than the watermark are dropped by the engine.
    """
    placed = G.assign_cells(G.quality_filter(pixels.withWatermark(ts, delay)), grid)
    hourly = placed.groupBy(F.window(ts, "1 hour"), "scene_id", "r", "c").agg(
        *[F.avg(F.when(F.col("channel") == ch, F.col("bt"))).alias(f"bt{ch}") for ch in CHANNELS],
        F.count("bt").alias("n"),
    )
    start = F.col("window.start")
    number = F.floor(F.unix_timestamp(start) / 3600).cast("int")
    return hourly.select(
        "scene_id", start.alias("hour_start"), F.pmod(number, F.lit(24)).alias("hour"), number.alias("hour_seq"), "r", "c",
        *[f"bt{ch}" for ch in CHANNELS], "n",
    )


def score_closed_hours(
    cells: DataFrame, grid: GridSpec, out_path: str, checkpoint: str, median_sizes: Iterable[int] = (5, 9, 15)
) -> StreamingQuery:
    """Score each micro-batch of complete hourly layers and append the scored cells as parquet.

    ``cells`` carries scene_id, hour, hour_seq, r, c and the channels; the score needs scene-wide
    percentiles, so it runs as a batch job on the hours of the micro-batch.  The batch number is
    part of the folder, so a repeated batch overwrites itself.
    """
    sizes = tuple(median_sizes)

    def score(batch: DataFrame, number: int) -> None:
        dense = settle(G.complete_grid(batch, grid), grid)
        scored = hourly_anomaly_score(dense, grid, sizes)
        scored.select("scene_id", "hour", "hour_seq", "r", "c", "score", "score_valid").write.mode(
            "overwrite"
        ).parquet(f"{out_path}/batch={number}")

    return (
        cells.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def risk_states(
    scored: DataFrame,
    persistence: float = 0.5,
    mode: str = "prob_or",
    ts: str | None = None,
    delay: str = "1 hour",
    keep_hours: int = 24,
) -> DataFrame:
    """Risk per cell kept as keyed state, one output row per observation.

    Observations of a micro-batch are applied in ``hour_seq`` order.  One that is not newer than
    the state cannot be applied (assimilation has no inverse): it leaves the risk unchanged and
    counts as ``late``.  With ``ts``, the event time of an observation, a cell's state ends once the
    watermark has passed its last hour by ``keep_hours``; observations at or behind the watermark
    (which begins at the epoch) are dropped by the engine.  Without it state is kept for good.
    """
    p = min(max(persistence, 0.0), 1.0)
    if mode not in ("prob_or", "max_persist"):
        raise ValueError(f"unknown fusion mode: {mode}")
    keep = keep_hours * 3_600_000

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        risk, last, ends = state.get if state.exists else (0.0, -(2**31), 0)
        rows = pd.concat(list(batches)).sort_values("hour_seq")
        out = []
        for seq, score, valid in zip(rows["hour_seq"], rows["score"], rows["score_valid"]):
            late = int(seq) <= last
            if not late:
                last = int(seq)
                if bool(valid):
                    s = 0.0 if pd.isna(score) else min(max(float(score), 0.0), 1.0)
                    decayed = risk * p
                    risk = max(decayed, s) if mode == "max_persist" else 1.0 - (1.0 - decayed) * (1.0 - s)
            out.append((*key, int(seq), risk, int(late)))
        if ts is not None:
            ends = max(ends, int(rows["_at"].max()) + keep)
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        state.update((risk, last, ends))
        yield pd.DataFrame(out, columns=["scene_id", "r", "c", "hour_seq", "risk", "late"])

    timeout = GroupStateTimeout.NoTimeout
    if ts is not None:
        scored = scored.withWatermark(ts, delay).withColumn("_at", F.unix_millis(F.col(ts)))
        timeout = GroupStateTimeout.EventTimeTimeout
    scene = scored.schema["scene_id"].dataType.simpleString()
    return scored.groupBy("scene_id", "r", "c").applyInPandasWithState(
        advance, RISK_OUTPUT.format(scene=scene), RISK_STATE, "append", timeout
    )


def advance_risk(
    pixels: DataFrame,
    grid: GridSpec,
    out_path: str,
    checkpoint: str,
    persistence: float = 0.5,
    mode: str = "prob_or",
    median_sizes: Iterable[int] = (5, 9, 15),
    delay: str = "1 hour",
    keep_hours: int = 24,
) -> StreamingQuery:
    """From streamed pixels to the risk of every cell: binning, scoring and assimilation in one query.

    An hour reaches a micro-batch once and whole, when the watermark closes it.  Each batch folds its
    hours, in order, into the risk that the batch before left, all in the JVM, and writes the open
    scenes to a folder of its own: scene_id, r, c, risk, hour_seq (the last one seen).  A scene whose
    last hour lies ``keep_hours`` back is dropped, so the state ends with the day.  A repeated batch
    reads the same predecessor and overwrites itself.
    """
    sizes = tuple(median_sizes)
    key = ["scene_id", "r", "c"]

    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cells = cut(batch.drop("hour_start", "n"))
        dense = settle(G.complete_grid(cells, grid), grid)
        scored = hourly_anomaly_score(dense, grid, sizes).select(*key, "hour_seq", "score", "score_valid")
        steps = scored.groupBy(*key).agg(
            F.array_sort(F.collect_list(F.struct("hour_seq", "score", "score_valid"))).alias("steps"),
            F.max("hour_seq").alias("_new"),
        )
        if number:
            before = spark.read.parquet(f"{out_path}/batch={number - 1}")
        else:
            before = steps.select(*key, F.lit(0.0).alias("risk"), F.lit(None).cast("int").alias("hour_seq")).limit(0)
        folded = F.aggregate(
            F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)),
            F.coalesce("risk", F.lit(0.0)),
            lambda acc, o: fuse_step(acc, o["score"], o["score_valid"], persistence, mode),
        )
        state = before.join(steps, key, "full").select(
            *key, folded.alias("risk"), F.greatest("hour_seq", "_new").alias("hour_seq")
        )
        newest = cells.agg(F.max("hour_seq")).first()[0]
        if newest is not None:
            state = state.where(F.col("hour_seq") > newest - keep_hours)
        state.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return (
        hourly_cells(pixels, grid, delay)
        .writeStream.foreachBatch(advance)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def latest_risk(updates: DataFrame) -> DataFrame:
    """Current risk of each cell from the stream of updates."""
    newest = F.max_by("risk", "hour_seq").alias("risk")
    return updates.where(F.col("late") == 0).groupBy("scene_id", "r", "c").agg(
        newest, F.count("*").alias("hours_seen")
    )


def run_to_parquet(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    """Drain what is available into parquet files."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
