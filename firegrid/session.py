"""Session helpers: builder defaults, shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "firegrid", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Files of a lineage cut go once no table refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Cells stay partitioned by scene, so a join on (scene, r, c) needs no second shuffle.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the one the session names, a temporary one only in local mode."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="spark-firegrid-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts lineage like :func:`cut`, and the reader knows the size: a join with a small stored table
    is planned as a broadcast by that measured size, a large one is shuffled.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    Keeps the partitioning, so tables settled by scene stay settled.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
