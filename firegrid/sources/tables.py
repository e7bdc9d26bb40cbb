"""Hotspot and detection tables from delimited files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.schema import STATE_CODE, STATE_NAME_PREFIX

DETECTION_SCHEMA = "lat double, lon double, datetime timestamp, confidence double"


def read_delimited(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Header CSV with every column as text: no inference pass, casts decide what is a value."""
    return spark.read.option("header", True).csv(path if isinstance(path, str) else list(path))


def _number(name: str) -> Column:
    return F.expr(f"try_cast(`{name}` AS DOUBLE)")


def _instant(name: str) -> Column:
    return F.expr(f"try_cast(`{name}` AS TIMESTAMP)")


def _located(df: DataFrame, stamp: str) -> DataFrame:
    rows = df.withColumns({"datetime": _instant(stamp), "lat": _number("lat"), "lon": _number("lon")})
    return rows.dropna(subset=["datetime", "lat", "lon"])


def load_hotspots(spark: SparkSession, path: str | Sequence[str], state: int = STATE_CODE) -> DataFrame:
    """Hotspots of one state.

    The timestamp comes from ``data_pas`` when any row has one, otherwise from
    ``data_hora_gmt``.  A row belongs to the state by its numeric code, or by name when the code
    is no number.
    """
    raw = read_delimited(spark, path)
    passes = "data_pas" in raw.columns and not raw.where(F.col("data_pas").isNotNull()).isEmpty()
    rows = _located(raw, "data_pas" if passes else "data_hora_gmt")
    code = _number("estado_id")
    named = F.upper("estado").startswith(STATE_NAME_PREFIX)
    return rows.where((code == float(state)) | (code.isNull() & named))


def load_hotspots_with_day(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Hotspots of every state with ``day``; ``data_pas`` is used whenever the column exists."""
    raw = read_delimited(spark, path)
    rows = _located(raw, "data_pas" if "data_pas" in raw.columns else "data_hora_gmt")
    return rows.withColumn("day", F.to_date("datetime"))


def filter_state(spark: SparkSession, path: str | Sequence[str], state: int = STATE_CODE) -> DataFrame:
    """National files reduced to one state by its numeric code."""
    raw = read_delimited(spark, path)
    if "estado_id" not in raw.columns:
        raise ValueError("column estado_id is missing")
    return raw.where(_number("estado_id") == float(state))


def assemble_years(annual: DataFrame, monthly: DataFrame, year: str = "year") -> DataFrame:
    """Rows per year: the annual table where it has the year, else the monthly rows."""
    known = annual.select(year).distinct()
    return annual.unionByName(monthly.join(known, year, "left_anti"), allowMissingColumns=True)


def write_years(rows: DataFrame, path: str, year: str = "year") -> None:
    rows.write.mode("overwrite").partitionBy(year).option("header", True).csv(path)


def normalise_detections(raw: DataFrame) -> DataFrame:
    """Second-sensor rows as lat, lon, datetime, confidence (other columns kept).

    HHMM times are zero padded.  Confidence is decided row by row, so files of both kinds read alike
    together or alone: l / n / h becomes 30 / 60 / 90, a number stays, any other text is NULL.
    """
    rows = raw.withColumnsRenamed(
        {a: b for a, b in (("latitude", "lat"), ("longitude", "lon")) if a in raw.columns}
    )
    rows = rows.withColumns({"lat": _number("lat"), "lon": _number("lon")})
    if {"acq_date", "acq_time"} <= set(rows.columns):
        hhmm = F.lpad(F.expr("CAST(try_cast(acq_time AS INT) AS STRING)"), 4, "0")
        stamp = F.concat_ws(
            "", F.col("acq_date").cast("string"), F.lit(" "), F.substring(hhmm, 1, 2), F.lit(":"), F.substring(hhmm, 3, 2), F.lit(":00")
        )
        rows = rows.withColumn("datetime", F.expr("NULL").cast("timestamp")).withColumn(
            "datetime", F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))
        )
    elif "datetime" in rows.columns:
        rows = rows.withColumn("datetime", _instant("datetime"))
    else:
        rows = rows.withColumn("datetime", F.lit(None).cast("timestamp"))
    if "confidence" in rows.columns and dict(rows.dtypes)["confidence"] == "string":
        level = F.lower("confidence")
        named = F.when(level == "l", 30.0).when(level == "n", 60.0).when(level == "h", 90.0)
        rows = rows.withColumn("confidence", F.coalesce(named, _number("confidence")))
    return rows


def load_detections(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return normalise_detections(read_delimited(spark, path))


def load_cached_detections(spark: SparkSession, folder: str, source: str, days: Sequence[str]) -> DataFrame:
    """Cached files of (source, day); an empty typed table when none exists.

    The reader's own globs pick the names (files or folders), wherever the cache lies.
    """
    names = ",".join(f"firms_{source}_{d}.csv" for d in days)
    try:
        raw = read_delimited(spark, f"{folder}/{{{names}}}")
    except AnalysisException as e:
        if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        return spark.createDataFrame([], DETECTION_SCHEMA)
    return normalise_detections(raw)
