"""One registered query per operator, with its reference SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as X
from checks import sql as S
from firegrid.functions import geo, stats
from firegrid.operators import components as C
from firegrid.operators import days as Y
from firegrid.operators import detectors as D
from firegrid.operators import evaluate as E
from firegrid.operators import features as M
from firegrid.operators import forests as R
from firegrid.operators import fusion as U
from firegrid.operators import grid as G
from firegrid.operators import interval_match as I
from firegrid.operators import learning as L
from firegrid.operators import neighborhood as N
from firegrid.operators import outliers as O
from firegrid.operators import twin as T
from firegrid.plans import day_products as DP
from firegrid.plans import evaluate_days as P
from firegrid.plans import sweeps as W
from firegrid.schema import LAYER, SCENE
from firegrid.session import cut, scratch_path, store
from firegrid.sources import granules as GR
from firegrid.sources import pixels as PX
from firegrid.sources import sinks
from firegrid.sources import tables as TB
from firegrid.streaming import risk as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
GRID = X.GRID
KEY = ["scene_id", "r", "c"]
RADII = [5.0, 10.0, 20.0, 30.0]


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = S.query(sql)
        return fn

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def rsql(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def mask_sql(src: str) -> str:
    return f"SELECT scene_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM {src}"


def warm(spark: SparkSession, sf: str) -> DataFrame:
    """A crowded mask: the warmest 30 percent of each scene."""
    return stats.percentile_mask(X.day(spark, sf), F.col("bt13"), F.col("bt13").isNotNull(), 0.7, SCENE).select(*KEY)


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    return X.layers(spark, sf).select("scene_id").distinct()


def event_view(df: DataFrame, *keys: str) -> DataFrame:
    cols = [
        "radius_km", "n_focos", "n_components", "tp_recall", "tp_precision", "fn_focos", "fp_components",
        "precision", "recall", "f1", "component_size_median", "component_size_max",
    ]
    return rounded(df.select(*keys, *cols), "precision", "recall", "f1", "component_size_median")


def confusion_view(df: DataFrame, *keys: str) -> DataFrame:
    cols = ["tp", "fp", "fn", "tn", "valid_cells", "precision", "recall", "f1", "iou", "accuracy"]
    return rounded(df.select(*keys, *cols), "precision", "recall", "f1", "iou", "accuracy")


# ================================================================ sources

RAW_HOTSPOTS = """
SELECT event_id,
  CASE WHEN event_type = 'view' THEN 'n/a' WHEN event_type = 'signup' THEN NULL ELSE CAST(ts AS STRING) END AS data_pas,
  CAST(ts AS STRING) AS data_hora_gmt,
  CASE WHEN value < 1e0 THEN NULL ELSE lat END AS lat, lon,
  CASE WHEN event_type IN ('error', 'view') THEN '23' WHEN event_type = 'click' THEN 'n/d' ELSE '29' END AS estado_id,
  CASE WHEN value >= 50e0 THEN 'Ceará' ELSE 'Bahia' END AS estado
FROM points"""
S.define("raw_hotspots", RAW_HOTSPOTS.replace("STRING", "VARCHAR"))


def raw_hotspots(spark: SparkSession, sf: str) -> str:
    X.points(spark, sf).createOrReplaceTempView("points")
    path = scratch_path(spark, "hotspots")
    spark.sql(RAW_HOTSPOTS).write.option("header", True).csv(path)
    return path


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


@register(
    "s1_hotspot_scan",
    "SELECT event_id, strftime(try_cast(data_pas AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS stamp, round(lat, 6) AS lat, "
    "round(lon, 6) AS lon FROM raw_hotspots WHERE try_cast(data_pas AS TIMESTAMP) IS NOT NULL AND lat IS NOT NULL "
    "AND (estado_id = '23' OR (estado_id = 'n/d' AND estado LIKE 'Cear%'))",
)
def s1(spark, sf):
    rows = TB.load_hotspots(spark, raw_hotspots(spark, sf))
    return rows.select(F.col("event_id").cast("bigint").alias("event_id"), stamp("datetime").alias("stamp"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@register(
    "s2_hotspot_scan_with_day",
    "SELECT event_id, strftime(CAST(data_pas AS TIMESTAMP), '%Y-%m-%d') AS day FROM raw_hotspots "
    "WHERE try_cast(data_pas AS TIMESTAMP) IS NOT NULL AND lat IS NOT NULL",
)
def s2(spark, sf):
    rows = TB.load_hotspots_with_day(spark, raw_hotspots(spark, sf))
    return rows.select(F.col("event_id").cast("bigint").alias("event_id"), F.date_format("day", "yyyy-MM-dd").alias("day"))


@register(
    "s3_state_filter",
    "SELECT estado_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM raw_hotspots WHERE estado_id = '23' GROUP BY ALL",
)
def s3(spark, sf):
    rows = TB.filter_state(spark, raw_hotspots(spark, sf))
    return rows.groupBy("estado_id").agg(F.count("*").alias("n"), F.sum(F.col("event_id").cast("bigint")).alias("id_sum"))


@register(
    "s4_year_assembly",
    "WITH t AS (SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderstatus = 'F' AS annual, o_orderkey FROM orders), "
    "a AS (SELECT DISTINCT year FROM t WHERE annual) "
    "SELECT year, annual, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM t WHERE annual OR year NOT IN (SELECT year FROM a) GROUP BY ALL",
)
def s4(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").alias("annual"), "o_orderkey"
    )
    rows = TB.assemble_years(orders.where("annual"), orders.where("NOT annual"))
    return rows.groupBy("year", "annual").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


RAW_DETECTIONS = """
SELECT event_id, lat AS latitude, lon AS longitude, CAST(CAST(ts AS DATE) AS STRING) AS acq_date,
  CAST(hour(ts) * 100 + minute(ts) AS INT) AS acq_time, level AS confidence
FROM points"""


def raw_detections(spark: SparkSession, sf: str) -> DataFrame:
    X.points(spark, sf).createOrReplaceTempView("points")
    return spark.sql(RAW_DETECTIONS)


S.define(
    "norm_detections",
    "SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS stamp, lat, lon, "
    "CASE level WHEN 'l' THEN 30e0 WHEN 'n' THEN 60e0 WHEN 'h' THEN 90e0 END AS confidence FROM points",
)


@register(
    "s5_detection_normaliser",
    "SELECT event_id, stamp, round(lat, 6) AS lat, round(lon, 6) AS lon, confidence FROM norm_detections",
)
def s5(spark, sf):
    path = scratch_path(spark, "detections")
    raw_detections(spark, sf).write.option("header", True).csv(path)
    rows = TB.load_detections(spark, path)
    return rows.select(F.col("event_id").cast("bigint").alias("event_id"), stamp("datetime").alias("stamp"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "confidence")


@register(
    "s6_cached_detections",
    "SELECT event_id, stamp, confidence FROM norm_detections WHERE stamp < '2024-01-02'",
)
def s6(spark, sf):
    folder = scratch_path(spark, "cache")
    raw = raw_detections(spark, sf)
    raw.where("acq_date = '2024-01-01'").write.option("header", True).csv(f"{folder}/firms_VIIRS_2024-01-01.csv")
    found = TB.load_cached_detections(spark, folder, "VIIRS", ["2024-01-01", "2024-01-02"])
    none = TB.load_cached_detections(spark, folder, "VIIRS", ["2024-01-03"])
    both = found.select("event_id", "lat", "lon", "datetime", "confidence").unionByName(none, allowMissingColumns=True)
    return both.select(F.col("event_id").cast("bigint").alias("event_id"), stamp("datetime").alias("stamp"), "confidence")


# Granule names: year 2024, day of year = month of shipping (a calendar day in January), minute
# and second from the line; hour 17 of channel 7 never arrives in scene 3.
GRANULE_NAMES = """
SELECT DISTINCT concat('ABI-L2-CMIPF/2024/', lpad(CAST(month(l_shipdate) AS STRING), 3, '0'), '/',
  CAST(16 + l_linenumber % 3 AS STRING), '/OR_ABI-L2-CMIPF-M6C', lpad(CAST(channel AS STRING), 2, '0'), '_G16_s2024',
  lpad(CAST(month(l_shipdate) AS STRING), 3, '0'), CAST(16 + l_linenumber % 3 AS STRING),
  lpad(CAST(l_linenumber * 7 AS STRING), 2, '0'), '204', CASE WHEN l_returnflag = 'N' THEN '_e0_c0.nc' ELSE '_e0_c0.txt' END) AS name
FROM (SELECT *, explode(array(7, 13, 14)) AS channel FROM lineitem) t
WHERE NOT (channel = 7 AND month(l_shipdate) = 3 AND 16 + l_linenumber % 3 = 17)"""
S.define(
    "granule_names",
    GRANULE_NAMES.replace("explode(array(7, 13, 14))", "unnest([7, 13, 14])").replace("AS STRING", "AS VARCHAR"),
)


def granule_names(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with equal parts give equal names, so they are told apart before names are built.  The few names
    are stored: a filter on parsed names would otherwise move below the DISTINCT and parse the name of every line."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.select("l_shipdate", "l_linenumber", "l_returnflag").distinct().createOrReplaceTempView("lineitem")
    return store(spark.sql(GRANULE_NAMES), "names")


S.define(
    "granules",
    "SELECT name, CAST(regexp_extract(name, 'M\\d+C(\\d{2})', 1) AS INT) AS channel, "
    "strptime(regexp_extract(name, '_s(\\d{4})', 1) || '-01-01', '%Y-%m-%d') "
    "+ to_days(CAST(regexp_extract(name, '_s\\d{4}(\\d{3})', 1) AS INT) - 1) "
    "+ to_hours(CAST(regexp_extract(name, '_s\\d{7}(\\d{2})', 1) AS INT)) "
    "+ to_minutes(CAST(regexp_extract(name, '_s\\d{9}(\\d{2})', 1) AS INT)) "
    "+ to_milliseconds(1000 * CAST(regexp_extract(name, '_s\\d{11}(\\d{2})', 1) AS INT) "
    "+ 100 * CAST(regexp_extract(name, '_s\\d{13}(\\d)', 1) AS INT)) AS start "
    "FROM granule_names WHERE name LIKE '%.nc' AND contains(name, 'ABI-L2-CMIPF')",
)


@register(
    "s7_granule_catalogue",
    "SELECT name, channel, strftime(start, '%Y-%m-%d %H:%M:%S.%g') AS start_at, "
    "'ABI-L2-CMIPF/' || strftime(start, '%Y/%j/%H/') AS prefix FROM granules",
)
def s7(spark, sf):
    cat = GR.catalogue(granule_names(spark, sf))
    return cat.select(
        "name", "channel", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSS").alias("start_at"),
        GR.hour_prefix("ABI-L2-CMIPF", F.col("start")).alias("prefix"),
    )


S.define(
    "granule_requests",
    "SELECT DISTINCT date_trunc('second', CAST('2024-01-01' AS TIMESTAMP) + to_days(CAST(day(ts) - 1 AS INT)) + to_hours(CAST(15 + hour(ts) % 4 AS INT)) "
    "+ to_minutes(CAST(minute(ts) AS INT))) AS wanted, 13 AS channel FROM events",
)


@register(
    "s8_nearest_granule",
    "SELECT strftime(q.wanted, '%Y-%m-%d %H:%M') AS wanted, q.channel, b.name, b.gap_s FROM granule_requests q LEFT JOIN "
    "(SELECT wanted, channel, name, gap_s FROM (SELECT q.wanted, q.channel, g.name, abs(epoch_ms(g.start) - epoch_ms(q.wanted)) / 1000e0 AS gap_s, "
    "row_number() OVER (PARTITION BY q.wanted, q.channel ORDER BY abs(epoch_ms(g.start) - epoch_ms(q.wanted)), g.name) AS rn FROM granule_requests q "
    "JOIN granules g ON g.channel = q.channel AND date_trunc('hour', g.start) = date_trunc('hour', q.wanted)) t WHERE rn = 1) b "
    "ON b.wanted = q.wanted AND b.channel = q.channel",
)
def s8(spark, sf):
    X.tables(spark, sf, "events")
    requests = spark.sql(
        "SELECT DISTINCT CAST('2024-01-01' AS TIMESTAMP) + make_dt_interval(day(ts) - 1, 15 + hour(ts) % 4, minute(ts), 0) AS when, "
        "13 AS channel FROM events"
    )
    near = GR.nearest_granule(requests, GR.catalogue(granule_names(spark, sf)))
    return near.select(F.date_format("when", "yyyy-MM-dd HH:mm").alias("wanted"), "channel", "name", "gap_s")


S.define("event_days", "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events")
S.define(
    "day_asks",
    "SELECT day, h.hour, c.channel FROM event_days CROSS JOIN (VALUES (16), (17), (18)) h(hour) CROSS JOIN (VALUES (7), (13), (14)) c(channel)",
)
S.define(
    "granule_tags",
    "SELECT regexp_extract(name, '[^/]*$') AS name, regexp_extract(name, '_s(\\d{7})', 1) AS ymd, "
    "CAST(regexp_extract(name, '_s\\d{7}(\\d{2})', 1) AS INT) AS hour, CAST(regexp_extract(name, 'M6C(\\d{2})', 1) AS INT) AS channel "
    "FROM granule_names WHERE name LIKE '%.nc'",
)
S.define(
    "located",
    "SELECT a.day, a.hour, a.channel, coalesce(e.name, d.name) AS name, e.name IS NULL AND d.name IS NOT NULL AS is_fallback FROM day_asks a "
    "LEFT JOIN (SELECT ymd, channel, hour, min(name) AS name FROM granule_tags GROUP BY ALL) e ON e.ymd = strftime(a.day, '%Y%j') "
    "AND e.channel = a.channel AND e.hour = a.hour LEFT JOIN (SELECT ymd, channel, min(name) AS name FROM granule_tags GROUP BY ALL) d "
    "ON d.ymd = strftime(a.day, '%Y%j') AND d.channel = a.channel",
)


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.to_date("ts").alias("day")).distinct()


@register(
    "s9_granule_lookup",
    "SELECT strftime(day, '%Y-%m-%d') AS day, hour, channel, name, is_fallback FROM located",
)
def s9(spark, sf):
    asks = GR.day_requests(event_days(spark, sf), (16, 17, 18), (7, 13, 14))
    return GR.locate_granules(asks, granule_names(spark, sf)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register(
    "s10_complete_days",
    "SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN count(name) < 9 THEN 'missing' WHEN count(*) FILTER (NOT is_fallback AND name IS NOT NULL) = 9 "
    "THEN 'strict' ELSE 'complete' END AS status FROM located GROUP BY ALL",
)
def s10(spark, sf):
    days, names = event_days(spark, sf), granule_names(spark, sf)
    loose = GR.complete_days(days, names)
    strict = GR.complete_days(days, names, strict=True).withColumn("status", F.lit("strict"))
    missing = GR.missing_days(days, loose).withColumn("status", F.lit("missing"))
    known = loose.join(strict, "day", "left").withColumn("status", F.coalesce("status", F.lit("complete")))
    return known.unionByName(missing).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register(
    "s11_quality_filter",
    "SELECT scene_id, channel, count(*) AS n, min(bt) AS bt_min, max(bt) AS bt_max FROM good_pixels GROUP BY ALL",
)
def s11(spark, sf):
    return G.quality_filter(X.pixels(spark, sf)).groupBy("scene_id", "channel").agg(
        F.count("*").alias("n"), F.min("bt").alias("bt_min"), F.max("bt").alias("bt_max")
    )


# Satellite height, sub-satellite longitude and ellipsoid axes of the fixed grid.
ORBIT = dict(height=35786023.0, lon0=-75.0, semi_major=6378137.0, semi_minor=6356752.31414)
SCAN = (
    "SELECT l_orderkey, l_linenumber, -0.16e0 + 0.32e0 * (((l_orderkey*7919 + l_linenumber*104729) % 10007) / 10007e0) AS x_rad, "
    "-0.16e0 + 0.32e0 * (((l_partkey*6007 + l_suppkey*3571) % 10009) / 10009e0) AS y_rad FROM lineitem"
)


def scan_sql() -> str:
    flat = S.lit((ORBIT["semi_major"] / ORBIT["semi_minor"]) ** 2)
    bh = S.lit(ORBIT["height"] + ORBIT["semi_major"])
    c0 = S.lit((ORBIT["height"] + ORBIT["semi_major"]) ** 2 - ORBIT["semi_major"] ** 2)
    S.define("scan", SCAN)
    S.define("scan_v", "SELECT *, cos(x_rad) * cos(y_rad) AS vx, sin(x_rad) AS vy, cos(x_rad) * sin(y_rad) AS vz FROM scan")
    S.define("scan_a", f"SELECT *, vx*vx + vy*vy + {flat}*vz*vz AS a, -2e0*{bh}*vx AS b FROM scan_v")
    S.define("scan_d", f"SELECT *, b*b - 4e0*a*{c0} AS disc FROM scan_a")
    S.define("scan_s", "SELECT *, CASE WHEN disc >= 0 THEN (-b - sqrt(CASE WHEN disc >= 0 THEN disc END)) / (2e0*a) END AS s FROM scan_d")
    return (
        f"SELECT l_orderkey, l_linenumber, round(degrees(atan({flat} * s*vz / sqrt(power({bh} - s*vx, 2) + power(s*vy, 2)))), 6) AS lat, "
        f"round({S.lit(ORBIT['lon0'])} + degrees(atan2(s*vy, {bh} - s*vx)), 6) AS lon FROM scan_s"
    )


@register("s12_scan_angles", scan_sql())
def s12(spark, sf):
    X.tables(spark, sf, "lineitem")
    rows = PX.navigate(spark.sql(SCAN), **ORBIT)
    return rounded(rows.select("l_orderkey", "l_linenumber", "lat", "lon"), "lat", "lon")


# ================================================================ grid


@register("g1_box_filter", f"SELECT event_id FROM points WHERE {S.IN_BOX}")
def g1(spark, sf):
    return G.bbox_filter(X.points(spark, sf), GRID).select("event_id")


@register("g2_day_window", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def g2(spark, sf):
    return G.day_filter(X.points(spark, sf), "2024-01-15").select("event_id")


def index_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "x": F.floor((F.col("lon") + 45.0) * 20.0).cast("int"),
            "y": F.floor((F.col("lon") * 0.3 - F.col("lat") + 30.0) * 20.0).cast("int"),
        }
    )


S.define(
    "indexed",
    "SELECT *, CAST(floor((lon + 45e0) * 20e0) AS INT) AS x, CAST(floor((lon * 0.3e0 - lat + 30e0) * 20e0) AS INT) AS y FROM wide_pixels",
)
S.define(
    "index_window",
    f"SELECT scene_id, min(y) AS y_lo, max(y) AS y_hi, min(x) AS x_lo, max(x) AS x_hi FROM indexed WHERE {S.IN_BOX} GROUP BY ALL",
)


@register(
    "g3_covering_rectangle",
    "SELECT w.*, count(*) AS n FROM index_window w JOIN indexed i ON i.scene_id = w.scene_id AND i.y BETWEEN y_lo AND y_hi "
    "AND i.x BETWEEN x_lo AND x_hi GROUP BY ALL",
)
def g3(spark, sf):
    rows = index_columns(X.wide_pixels(spark, sf))
    inside = G.crop_to_window(rows, GRID).groupBy("scene_id").agg(F.count("*").alias("n"))
    return G.index_window(rows, GRID).join(inside, "scene_id")


@register(
    "g4_grid_edges",
    "SELECT axis, CAST(i AS INT) AS i, round(edge, 9) AS edge, n FROM ("
    f"SELECT 'lat' AS axis, g.i, {S.edge('g.i', GRID.min_lat, GRID.max_lat, GRID.h)} AS edge FROM generate_series(0, {GRID.h}) g(i) "
    f"UNION ALL SELECT 'lon', g.i, {S.edge('g.i', GRID.min_lon, GRID.max_lon, GRID.w)} FROM generate_series(0, {GRID.w}) g(i)) e "
    "LEFT JOIN (SELECT 'lat' AS axis, r AS i, count(*) AS n FROM placed_pixels GROUP BY ALL UNION ALL "
    "SELECT 'lon', c, count(*) FROM placed_pixels GROUP BY ALL) p USING (axis, i)",
)
def g4(spark, sf):
    placed = G.assign_cells(G.quality_filter(X.pixels(spark, sf)), GRID)
    lat = placed.groupBy(F.col("r").alias("i")).agg(F.count("*").alias("n")).withColumn("axis", F.lit("lat"))
    lon = placed.groupBy(F.col("c").alias("i")).agg(F.count("*").alias("n")).withColumn("axis", F.lit("lon"))
    return G.grid_edges(spark, GRID).withColumn("edge", F.round("edge", 9)).join(lat.unionByName(lon), ["axis", "i"], "left")


def on_edge(df: DataFrame) -> DataFrame:
    """Points beyond the north edge moved exactly onto it, so both edge rules matter."""
    return df.withColumn("lat", F.least(F.col("lat"), F.lit(GRID.max_lat)))


def assign_sql(closed: bool) -> str:
    name = S.define(
        f"assigned_{closed}".lower(),
        f"SELECT event_id, {S.row_of('lat', closed)} AS r, {S.col_of('lon', closed)} AS c FROM "
        f"(SELECT event_id, least(lat, {S.lit(GRID.max_lat)}) AS lat, lon FROM points) t",
    )
    return f"SELECT event_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM {name} WHERE r IS NOT NULL AND c IS NOT NULL"


@register("g5_cell_closed_top", assign_sql(True))
def g5(spark, sf):
    return G.assign_cells(on_edge(X.points(spark, sf)), GRID, True).select("event_id", "r", "c")


@register("g6_cell_open_top", assign_sql(False))
def g6(spark, sf):
    return G.assign_cells(on_edge(X.points(spark, sf)), GRID, False).select("event_id", "r", "c")


@register("g7_bin_mean", f"SELECT scene_id, hour, hour_seq, channel, r, c, {rsql('bt')}, n FROM binned")
def g7(spark, sf):
    return rounded(G.bin_mean(X.pixels(spark, sf), GRID), "bt")


@register("g8_channel_pivot", f"SELECT scene_id, hour, hour_seq, r, c, {rsql('bt7', 'bt13', 'bt14')} FROM pivoted")
def g8(spark, sf):
    return rounded(G.pivot_channels(G.bin_mean(X.pixels(spark, sf), GRID)), "bt7", "bt13", "bt14")


@register("g9_dense_cube", "SELECT scene_id, hour, hour_seq, r, c, bt7, bt13, bt14 FROM cube")
def g9(spark, sf):
    return X.cube(spark, sf)


@register("g9b_complete_grid", "SELECT scene_id, hour, hour_seq, r, c, bt7, bt13, bt14 FROM cube")
def g9b(spark, sf):
    cells = G.pivot_channels(G.bin_mean(X.pixels(spark, sf), GRID))
    return rounded(G.complete_grid(cells, GRID, X.layers(spark, sf)), "bt7", "bt13", "bt14")


@register("g10_presence_mask", mask_sql("truth_raw"))
def g10(spark, sf):
    return G.presence_mask(X.hotspots(spark, sf), GRID)


@register("g11_cell_centres", f"SELECT scene_id, r, c, round({S.clat('r')}, 9) AS lat, round({S.clon('c')}, 9) AS lon FROM day")
def g11(spark, sf):
    rows = G.cell_centers(X.day(spark, sf).select(*KEY), GRID)
    return rows.withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)})


@register("g12_mask_points", f"SELECT scene_id, round({S.clat('r')}, 9) AS lat, round({S.clon('c')}, 9) AS lon FROM warm")
def g12(spark, sf):
    rows = G.cell_centers(warm(spark, sf), GRID)
    return rows.select("scene_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@register("g13_hour_maximum", "SELECT scene_id, r, c, bt7, bt13, bt14 FROM day")
def g13(spark, sf):
    return G.merge_hours_max(X.cube(spark, sf))


@register("g14_valid_cells", "SELECT scene_id, r, c, valid FROM day")
def g14(spark, sf):
    return G.valid_cells(X.cube(spark, sf))


@register(
    "g15_median_fill",
    f"SELECT scene_id, hour, r, c, {rsql('f7', 'f13')} FROM (SELECT *, coalesce(bt7, median(bt7) OVER (PARTITION BY scene_id, hour)) AS f7, "
    "coalesce(bt13, median(bt13) OVER (PARTITION BY scene_id, hour)) AS f13 FROM cube) t",
)
def g15(spark, sf):
    rows = G.fill_with_median(X.cube(spark, sf), ["bt7", "bt13"], LAYER)
    return rows.select("scene_id", "hour", "r", "c", F.round("bt7", 6).alias("f7"), F.round("bt13", 6).alias("f13"))


# ================================================================ neighbourhoods

S.score_ctes()
for _k in (3,):
    S.median_cte(f"hour_med{_k}", "hour_marked", "f13", _k, ("scene_id", "hour"))
S.median_cte("day_med21", "day_filled", "f13", 21, ("scene_id",))


def filled_hours(spark: SparkSession, sf: str) -> DataFrame:
    return G.fill_with_median(X.cube(spark, sf), ["bt13"], LAYER)


@register(
    "n1_median_windows",
    "SELECT scene_id, hour, r, c, round(a.med, 6) AS med3, round(b.med, 6) AS med5, round(d.med, 6) AS med15 FROM hour_med3 a "
    "JOIN hour_med5 b USING (scene_id, hour, r, c) JOIN hour_med15 d USING (scene_id, hour, r, c)",
)
def n1(spark, sf):
    rows = N.median_backgrounds(filled_hours(spark, sf), "bt13", [3, 5, 15], GRID)
    return rounded(rows.select("scene_id", "hour", "r", "c", "med3", "med5", "med15"), "med3", "med5", "med15")


@register("n1b_median_21", "SELECT scene_id, r, c, round(med, 6) AS med21 FROM day_med21")
def n1b(spark, sf):
    day = G.fill_with_median(X.day(spark, sf), ["bt13"])
    return rounded(N.median_backgrounds(day, "bt13", [21], GRID, SCENE).select(*KEY, "med21"), "med21")


@register("n2_box_mean", f"SELECT scene_id, r, c, round(f13, 6) AS mean5 FROM {S.box_mean_cte('day_mean5', 'day_filled', 'f13', 5)}")
def n2(spark, sf):
    day = G.fill_with_median(X.day(spark, sf), ["bt13"])
    return rounded(N.box_mean(day, "bt13", "mean5").select(*KEY, "mean5"), "mean5")


@register("n3_gaussian", f"SELECT scene_id, r, c, round(f13, 6) AS smooth FROM {S.smooth_cte('day_smooth', 'day_filled', 'f13', 1.6)}")
def n3(spark, sf):
    day = G.fill_with_median(X.day(spark, sf), ["bt13"])
    return rounded(N.gaussian_smooth(day, "bt13", "smooth", 1.6).select(*KEY, "smooth"), "smooth")


@register("n4_local_maximum", f"SELECT scene_id, r, c, round(top, 6) AS top FROM {S.local_max_cte('day_top', 'day_filled', 'f13', 3)}")
def n4(spark, sf):
    day = G.fill_with_median(X.day(spark, sf), ["bt13"])
    return rounded(N.local_maximum(day, "bt13", "top", 3).select(*KEY, "top"), "top")


S.smooth_cte("day_smooth1", "day_filled", "f13", 1.0)
S.local_max_cte("day_smooth1_top", "day_smooth1", "f13", 2)


@register(
    "n5_peaks",
    "SELECT s.scene_id, s.r, s.c, round(s.f13, 6) AS smoothed FROM day_smooth1 s JOIN day_smooth1_top t USING (scene_id, r, c) "
    "JOIN day d USING (scene_id, r, c) WHERE s.f13 = t.top AND s.f13 >= 301e0 AND d.valid",
)
def n5(spark, sf):
    day = G.fill_with_median(X.day(spark, sf), ["bt13"])
    return rounded(N.peaks(day, "bt13", 301.0, 2, 1.0).select(*KEY, "smoothed"), "smoothed")


@register("n6_dilation", mask_sql(S.dilate_cte("truth2", "truth_raw", 2)))
def n6(spark, sf):
    return N.dilate(G.presence_mask(X.hotspots(spark, sf), GRID), 2, GRID)


@register("n7_radius_gate", mask_sql(S.dilate_cte("truth_60km", "truth_raw", S.gate_steps(60.0))))
def n7(spark, sf):
    return N.dilate_km(G.presence_mask(X.hotspots(spark, sf), GRID), 60.0, GRID)


S.quantile_mask_cte("wide_warm", "day", "bt13", "bt13 IS NOT NULL", 0.25)


def wide_warm(spark: SparkSession, sf: str) -> DataFrame:
    return stats.percentile_mask(X.day(spark, sf), F.col("bt13"), F.col("bt13").isNotNull(), 0.25, SCENE).select(*KEY)


@register("n8_opening_cross", mask_sql(S.opening_cte("open_cross", "wide_warm", "cross")))
def n8(spark, sf):
    return N.opening(wide_warm(spark, sf), GRID, "cross")


@register("n8b_opening_box", mask_sql(S.opening_cte("open_box", "wide_warm", "box")))
def n8b(spark, sf):
    return N.opening(wide_warm(spark, sf), GRID, "box")


@register("n9_components_4", f"SELECT scene_id, r, c, label FROM {S.label_cte('warm_lab4', 'warm', 1)}")
def n9(spark, sf):
    return C.label_components(warm(spark, sf), GRID, 1).select(*KEY, "label")


@register("n9b_components_8", f"SELECT scene_id, r, c, label FROM {S.label_cte('warm_lab8', 'warm', 2)}")
def n9b(spark, sf):
    return C.label_components(warm(spark, sf), GRID, 2).select(*KEY, "label")


@register("n10_component_sizes", mask_sql(S.sized_cte("warm_sized", "warm", 3, 12)))
def n10(spark, sf):
    return C.filter_by_size(warm(spark, sf), GRID, 3, 12)


@register(
    "n11_component_centroids",
    f"SELECT scene_id, unit AS label, round(lat, 6) AS lat, round(lon, 6) AS lon, size FROM {S.centroid_cte('warm_mid', 'warm')}",
)
def n11(spark, sf):
    return rounded(C.component_centroids(warm(spark, sf), GRID), "lat", "lon")


# ================================================================ scene statistics


@register(
    "t1_scene_percentile",
    "SELECT scene_id, round(quantile_cont(bt13, 0.55e0) FILTER (valid), 4) AS p55, round(quantile_cont(bt13, 0.992e0) FILTER (valid), 4) AS p99 "
    "FROM day GROUP BY ALL",
)
def t1(spark, sf):
    x = F.when(F.col("valid"), F.col("bt13"))
    found = stats.quantiles(X.day(spark, sf), SCENE, {"p55": (x, 0.55), "p99": (x, 0.992)})
    return found.withColumns({c: F.round(c, 4) for c in ("p55", "p99")})


@register(
    "t1b_bracketed_percentile",
    "SELECT channel, round(quantile_cont(bt, 0.55e0), 6) AS p55, round(quantile_cont(bt, 0.98e0), 6) AS p98 FROM good_pixels GROUP BY ALL",
)
def t1b(spark, sf):
    rows = G.quality_filter(X.pixels(spark, sf))
    found = stats.bracketed_quantiles(rows, ["channel"], {"p55": (F.col("bt"), 0.55), "p98": (F.col("bt"), 0.98)})
    return rounded(found, "p55", "p98")


@register(
    "t2_robust_unit",
    f"SELECT scene_id, r, c, round({S.unit_expr('f13', 'valid', 0.05, 0.95, 'scene_id')}, 6) AS unit FROM day_filled",
)
def t2(spark, sf):
    day = G.fill_with_median(X.day(spark, sf), ["bt13"])
    rows = stats.with_robust_units(day, SCENE, {"unit": (F.col("bt13"), F.col("valid"), 0.05, 0.95)})
    return rounded(rows.select(*KEY, "unit"), "unit")


S.define(
    "spot_cells",
    f"SELECT event_id, scene_id, {S.row_of('lat', False)} AS r, {S.col_of('lon', False)} AS c FROM hotspots WHERE {S.IN_BOX}",
)
S.define(
    "spot_values",
    "SELECT s.event_id, s.scene_id, d.bt13 FROM spot_cells s JOIN day d USING (scene_id, r, c)",
)
S.define(
    "spot_ranks",
    "SELECT v.event_id, v.scene_id, v.bt13, 100e0 * count(d.bt13) / greatest(any_value(n.n), 1) AS rank_pct FROM spot_values v "
    "JOIN (SELECT scene_id, count(*) AS n FROM day WHERE valid GROUP BY ALL) n USING (scene_id) "
    "LEFT JOIN day d ON d.scene_id = v.scene_id AND d.valid AND d.bt13 <= v.bt13 WHERE v.bt13 IS NOT NULL GROUP BY v.event_id, v.scene_id, v.bt13",
)


def spot_ranks(spark: SparkSession, sf: str) -> DataFrame:
    day = X.day(spark, sf)
    spots = E.place_points(X.hotspots(spark, sf), GRID, closed_top=False).select("event_id", *KEY)
    probes = spots.join(day, KEY).select("event_id", "scene_id", F.col("bt13").alias("probe"))
    pool = day.where("valid").select("scene_id", F.col("bt13").alias("pool"))
    return stats.percentile_rank(pool, probes, SCENE, "pool", "probe")


@register("t3_percentile_rank", "SELECT event_id, scene_id, round(rank_pct, 6) AS rank_pct FROM spot_ranks")
def t3(spark, sf):
    return rounded(spot_ranks(spark, sf).select("event_id", "scene_id", "rank_pct"), "rank_pct")


@register("t4_contamination_mask", mask_sql(S.quantile_mask_cte("hot5", "day", "bt13", "valid", stats.clamped_pct(0.05))))
def t4(spark, sf):
    return stats.percentile_mask(X.day(spark, sf), F.col("bt13"), F.col("valid"), stats.clamped_pct(0.05), SCENE).select(*KEY)


@register(
    "t5_top_k_with_ties",
    "SELECT scene_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM (SELECT *, rank() OVER (PARTITION BY scene_id ORDER BY round(bt13, 0) DESC) AS rk "
    "FROM day WHERE bt13 IS NOT NULL) t WHERE rk <= 20",
)
def t5(spark, sf):
    day = X.day(spark, sf).where(F.col("bt13").isNotNull())
    return stats.top_k_with_ties(day, SCENE, F.round("bt13", 0), F.lit(20)).select(*KEY)


@register(
    "t5b_top_pixels_by_counting",
    f"SELECT scene_id, l_orderkey, l_linenumber, round(bt7, 6) AS bt7 FROM (SELECT *, rank() OVER (PARTITION BY scene_id ORDER BY round(bt7, 4) DESC) AS rk "
    f"FROM ({X.WIDE_PIXELS}) w) t WHERE rk <= 500",
)
def t5b(spark, sf):
    """All pixels of a scene, a group without a bound: ranked by counting, never sorted."""
    top = stats.top_k_with_ties(X.wide_pixels(spark, sf), SCENE, F.round("bt7", 4), F.lit(500))
    return rounded(top.select("scene_id", "l_orderkey", "l_linenumber", "bt7"), "bt7")


@register(
    "t6_five_numbers",
    "SELECT scene_id, kind, round(min(bt13), 6) AS min_v, round(quantile_cont(bt13, 0.25e0), 6) AS p25, round(quantile_cont(bt13, 0.5e0), 6) AS med, "
    "round(quantile_cont(bt13, 0.75e0), 6) AS p75, round(max(bt13), 6) AS max_v FROM (SELECT scene_id, 'hotspots' AS kind, bt13 FROM spot_values "
    "UNION ALL SELECT scene_id, 'scene', bt13 FROM day WHERE valid) t GROUP BY ALL",
)
def t6(spark, sf):
    day = X.day(spark, sf)
    spots = E.place_points(X.hotspots(spark, sf), GRID, closed_top=False).select("event_id", *KEY)
    at = spots.join(day, KEY).select("scene_id", F.lit("hotspots").alias("kind"), "bt13")
    rows = at.unionByName(day.where("valid").select("scene_id", F.lit("scene").alias("kind"), "bt13"))
    return rounded(stats.five_numbers(rows, ["scene_id", "kind"], "bt13"), "min_v", "p25", "med", "p75", "max_v")


@register(
    "t7_top_shares",
    "SELECT scene_id, count(*) AS n, count(*) FILTER (rank_pct >= 99) AS top1, count(*) FILTER (rank_pct >= 98) AS top2, "
    "count(*) FILTER (rank_pct >= 95) AS top5 FROM spot_ranks GROUP BY ALL",
)
def t7(spark, sf):
    at = lambda p: F.count_if(F.col("rank_pct") >= p)
    return spot_ranks(spark, sf).groupBy("scene_id").agg(
        F.count("*").alias("n"), at(99).alias("top1"), at(98).alias("top2"), at(95).alias("top5")
    )


S.define(
    "diag_hours",
    "SELECT *, coalesce(bt13, median(bt13) OVER (PARTITION BY scene_id, hour)) AS f FROM cube",
)
S.median_cte("diag_h5", "diag_hours", "f", 5, ("scene_id", "hour"))
S.define(
    "diag_active",
    "SELECT h.scene_id, h.r, h.c, CAST(count(*) FILTER (h.f - m.med > 0.5e0) AS DOUBLE) AS n_active_h FROM diag_hours h "
    "JOIN diag_h5 m USING (scene_id, hour, r, c) GROUP BY ALL",
)
S.define("diag_base", "SELECT *, f7 - f14 AS btd FROM day_filled")
for _k in (5, 11):
    S.median_cte(f"day_med{_k}", "day_filled", "f13", _k, ("scene_id",))
S.median_cte("btd_med11", "diag_base", "btd", 11, ("scene_id",))
S.define(
    "diag_features",
    "SELECT b.scene_id, b.r, b.c, b.f13 AS bt13, b.f13 - a.med AS res13_5, b.f13 - e.med AS res13_11, b.f13 - g.med AS res13_21, b.btd, "
    "b.btd - t.med AS res_btd_11, b.f7 AS bt7, n.n_active_h, b.valid FROM diag_base b JOIN day_med5 a USING (scene_id, r, c) "
    "JOIN day_med11 e USING (scene_id, r, c) JOIN day_med21 g USING (scene_id, r, c) JOIN btd_med11 t USING (scene_id, r, c) "
    "JOIN diag_active n USING (scene_id, r, c)",
)
S.define(
    "diag_long",
    "SELECT scene_id, r, c, valid, feature, v FROM (SELECT * FROM diag_features) UNPIVOT (v FOR feature IN (" + ", ".join(M.DIAGNOSTIC) + "))",
)
S.define(
    "diag_labelled",
    "SELECT l.*, t.r IS NOT NULL AS label FROM diag_long l LEFT JOIN truth1 t USING (scene_id, r, c)",
)


@register(
    "t8_separability",
    "SELECT feature, round(median(v) FILTER (label), 6) AS med_pos, round(median(v) FILTER (NOT label), 6) AS med_neg, "
    "round(quantile_cont(v, 0.75e0) FILTER (label), 6) AS p75_pos, round(quantile_cont(v, 0.75e0) FILTER (NOT label), 6) AS p75_neg, "
    "round((median(v) FILTER (label) - median(v) FILTER (NOT label)) / (stddev_pop(v) FILTER (NOT label) + 1e-9), 6) AS separation, scene_id "
    "FROM diag_labelled WHERE valid GROUP BY ALL",
)
def t8(spark, sf):
    truth = N.dilate(G.presence_mask(X.hotspots(spark, sf), GRID), 1, GRID)
    rows = M.separability(M.with_label(M.diagnostic_features(X.cube(spark, sf), GRID), truth))
    return rounded(rows, "med_pos", "med_neg", "p75_pos", "p75_neg", "separation")


# ================================================================ detectors

S.quantile_mask_cte("res_hot", "residuals", "residual", "seen13", stats.pct(0.05))


@register("d1_spatial_residual", mask_sql("res_hot"))
def d1(spark, sf):
    return D.spatial_residual(X.day(spark, sf), GRID, 0.05)


S.define(
    "res_spectral",
    "SELECT *, CASE WHEN bt13 IS NOT NULL THEN bt7 - bt14 END AS dbt, quantile_cont(CASE WHEN bt13 IS NOT NULL THEN bt7 - bt14 END, 0.85e0) "
    "OVER (PARTITION BY scene_id) AS dthr FROM residuals",
)
S.quantile_mask_cte("res_multi", "res_spectral", "residual", "seen13", stats.pct(0.15))


@register("d2_residual_multiband", mask_sql("res_multi WHERE dthr IS NULL OR dbt >= dthr"))
def d2(spark, sf):
    return D.spatial_residual_multiband(X.day(spark, sf), GRID, 0.15)


S.define("forest_pool", "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY scene_id) AS n_seen FROM residuals WHERE seen13) t WHERE n_seen >= 50")
S.forest_cte("band_forest", "forest_pool", ["f13", "background", "residual"], 200)
S.outside_cte("band_outliers", "band_forest", "iso_score", 0.05)


@register("d3_forest_one_band", mask_sql("band_outliers"))
def d3(spark, sf):
    return R.one_band_mask(X.day(spark, sf), GRID, 0.05)


S.median_cte("day_med9_14", "day_filled", "f14", 9, ("scene_id",))
S.define("multi_day", "SELECT scene_id FROM day GROUP BY scene_id HAVING count(bt7) > 0 AND count(bt14) > 0 AND count(*) FILTER (bt13 > 0) >= 80")
S.define(
    "multi_pool",
    "SELECT d.scene_id, d.r, d.c, d.f13, d.background, d.residual, d.f7 - d.f14 AS dbt, d.f14, d.f14 - m.med AS residual14 "
    "FROM residuals d JOIN multi_day USING (scene_id) JOIN day_med9_14 m USING (scene_id, r, c) WHERE d.seen13",
)
S.forest_cte("multi_forest", "multi_pool", ["f13", "background", "residual", "dbt", "f14", "residual14"], 280)
S.define("narrow_pool", "SELECT * FROM forest_pool ANTI JOIN multi_day USING (scene_id)")
S.forest_cte("narrow_forest", "narrow_pool", ["f13", "background", "residual"], 200)
S.define("either_forest", "SELECT * FROM multi_forest UNION ALL SELECT * FROM narrow_forest")
S.outside_cte("either_outliers", "either_forest", "iso_score", 0.05)


@register("d4_forest_multiband", mask_sql("either_outliers"))
def d4(spark, sf):
    return R.forest_mask(X.day(spark, sf), GRID, 0.05)


@register(
    "d5_hourly_score",
    f"SELECT scene_id, hour, r, c, round(score, 6) AS score, score_valid FROM {S.score_ctes()}",
)
def d5(spark, sf):
    rows = T.hourly_anomaly_score(X.cube(spark, sf), GRID)
    return rounded(rows.select("scene_id", "hour", "r", "c", "score", "score_valid"), "score")


S.risk_ctes("prob_or")
S.risk_ctes("max_persist")
S.field_ctes()


@register(
    "d6_assimilation_step",
    "SELECT scene_id, r, c, round(CASE WHEN v1 THEN 1e0 - (1e0 - s0 * 0.5e0) * (1e0 - s1) ELSE s0 END, 6) AS prob_or, "
    "round(CASE WHEN v1 THEN greatest(s0 * 0.5e0, s1) ELSE s0 END, 6) AS max_persist FROM obs",
)
def d6(spark, sf):
    rows = T.hourly_anomaly_score(X.cube(spark, sf), GRID)
    at = lambda i, c: F.max(F.when(F.col("hour_seq") == i, F.col(c)))
    pair = rows.groupBy(*KEY).agg(
        at(0, "score").alias("s0"), at(1, "score").alias("s1"), at(1, "score_valid").alias("v1")
    )
    step = lambda m: F.round(T.fuse_step(F.col("s0"), F.col("s1"), F.col("v1"), 0.5, m), 6)
    return pair.select(*KEY, step("prob_or").alias("prob_or"), step("max_persist").alias("max_persist"))


@register("d7_assimilated_series", "SELECT scene_id, r, c, round(risk, 6) AS risk FROM risk_prob_or")
def d7(spark, sf):
    return rounded(T.assimilate(T.hourly_anomaly_score(X.cube(spark, sf), GRID)), "risk")


@register("d7b_series_max_persist", "SELECT scene_id, r, c, round(risk, 6) AS risk FROM risk_max_persist")
def d7b(spark, sf):
    return rounded(T.assimilate(T.hourly_anomaly_score(X.cube(spark, sf), GRID), 0.5, "max_persist"), "risk")


@register("d8_mixture_mask")
def d8(spark, sf):
    return T.mixture_mask(T.risk_field(X.cube(spark, sf), GRID), 0.05, GRID)


MIXTURE_STEPS = 5
S.define("mix_pool", "SELECT scene_id, r, c, risk AS x FROM risk_field WHERE valid")
S.define(
    "mix_g0",
    "SELECT p.*, CASE WHEN x > mid THEN 1e0 ELSE 0e0 END AS g FROM mix_pool p JOIN (SELECT scene_id, quantile_cont(x, 0.5e0) AS mid FROM mix_pool GROUP BY scene_id) h USING (scene_id)",
)
for _t in range(MIXTURE_STEPS + 1):
    S.define(
        f"mix_p{_t}",
        "SELECT scene_id, m0, m1, greatest(q0 / (w0 + 1e-12) - m0 * m0, 0e0) + 1e-4 AS v0, greatest(q1 / (w1 + 1e-12) - m1 * m1, 0e0) + 1e-4 AS v1, w0 / n AS p0, w1 / n AS p1 "
        "FROM (SELECT *, s0 / (w0 + 1e-12) AS m0, s1 / (w1 + 1e-12) AS m1 FROM (SELECT scene_id, count(*) AS n, sum(1e0 - g) AS w0, sum(g) AS w1, sum((1e0 - g) * x) AS s0, "
        f"sum(g * x) AS s1, sum((1e0 - g) * x * x) AS q0, sum(g * x * x) AS q1 FROM mix_g{_t} GROUP BY scene_id) a) b",
    )
    S.define(
        f"mix_g{_t + 1}",
        "SELECT scene_id, r, c, x, 1e0 / (1e0 + exp(least(l0 - l1, 7e2))) AS g FROM (SELECT *, ln(p0 + 1e-300) - 0.5e0 * (ln(v0) + (x - m0) ** 2 / v0) AS l0, "
        f"ln(p1 + 1e-300) - 0.5e0 * (ln(v1) + (x - m1) ** 2 / v1) AS l1 FROM mix_pool JOIN mix_p{_t} USING (scene_id)) t",
    )


@register(
    "d8b_mixture_five_steps",
    f"SELECT scene_id, r, c, round(CASE WHEN m1 >= m0 THEN g ELSE 1e0 - g END, 6) AS p_hot FROM mix_g{MIXTURE_STEPS + 1} JOIN mix_p{MIXTURE_STEPS} USING (scene_id)",
)
def d8b(spark, sf):
    """Posterior of the hotter component after a fixed number of steps, whatever the likelihood does."""
    field = T.risk_field(X.cube(spark, sf), GRID)
    rated = T.hot_posterior(field, max_iter=MIXTURE_STEPS, tol=0.0)
    return rounded(rated.select(*KEY, "p_hot"), "p_hot")


S.quantile_mask_cte("risk_hot", "risk_field", "risk", "valid", stats.clamped_pct(0.05))
S.quantile_mask_cte("risk_wide", "risk_field", "risk", "valid", 0.5)
S.refined_cte("risk_refined", "risk_hot")
S.refined_cte("risk_wide_refined", "risk_wide")


@register("d9_inlier_refinement", mask_sql("risk_wide_refined"))
def d9(spark, sf):
    field = cut(T.risk_field(X.cube(spark, sf), GRID))
    base = stats.percentile_mask(field, F.col("smoothed"), F.col("valid"), 0.5, SCENE)
    return T.drop_weak_inliers(field, base, GRID)


@register("d10_risk_mask", mask_sql("risk_refined"))
def d10(spark, sf):
    return T.risk_mask(X.cube(spark, sf), 0.05, GRID)


@register("d10b_risk_mask_no_refinement", mask_sql("risk_hot"))
def d10b(spark, sf):
    return T.risk_mask(X.cube(spark, sf), 0.05, GRID, T.TwinConfig(lof_neighbors=0))


S.persistence_ctes()


@register("d11_hour_threshold", "SELECT scene_id, hour, round(thr, 6) AS hour_threshold FROM hour_cut")
def d11(spark, sf):
    rows = T.hourly_anomaly_score(G.with_valid(X.cube(spark, sf)), GRID)
    rows = rows.withColumn("usable", F.col("score_valid") & F.col("valid"))
    marked = D.with_hour_threshold(rows, D.PersistenceConfig(), GRID)
    return rounded(marked.select("scene_id", "hour", "hour_threshold").distinct(), "hour_threshold")


@register(
    "d11b_layer_level_by_counting",
    "SELECT scene_id, hour, round(lo + (hi - lo) * (pos - floor(pos)), 6) AS level FROM (SELECT scene_id, hour, pos, max(x) FILTER (rk = floor(pos)) AS lo, max(x) FILTER (rk = ceil(pos)) AS hi "
    "FROM (SELECT scene_id, hour, x, row_number() OVER (PARTITION BY scene_id, hour ORDER BY x) - 1 AS rk, "
    "(count(*) OVER (PARTITION BY scene_id, hour) - 1) * (0.5e0 + 0.05e0 * scene_id + 0.02e0 * (hour - 16)) AS pos "
    f"FROM (SELECT scene_id, hour, round(bt7, 4) AS x FROM ({X.WIDE_PIXELS}) w) v) t GROUP BY ALL) u",
)
def d11b(spark, sf):
    """A level per scene and hour over all pixels of the layer, ranked by counting."""
    q = 0.5 + 0.05 * F.col("scene_id") + 0.02 * (F.col("hour") - 16)
    marked = stats.with_varying_quantile(X.wide_pixels(spark, sf), ["scene_id", "hour"], F.round("bt7", 4), F.lit(True), q, "level")
    return rounded(marked.select("scene_id", "hour", "level").distinct(), "level")


@register(
    "d12_persistence_field",
    f"SELECT scene_id, r, c, eligible, active_hours, {rsql('persist', 'combined')} FROM persist_field",
)
def d12(spark, sf):
    field = D.persistence_field(X.cube(spark, sf), GRID, X.HOURS)
    return rounded(field.select(*KEY, "eligible", "active_hours", "persist", "combined"), "persist", "combined")


@register("d12b_combined_persistence", mask_sql(S.persistence_mask_cte("persist_mask", stats.clamped_pct(0.3))))
def d12b(spark, sf):
    return D.combined_persistence(X.cube(spark, sf), 0.3, GRID, X.HOURS)


@register("d12c_persistence_cleanup", mask_sql(S.persistence_mask_cte("persist_mask2", stats.clamped_pct(0.3), 2)))
def d12c(spark, sf):
    return D.combined_persistence(X.cube(spark, sf), 0.3, GRID, X.HOURS, min_component=2)


@register(
    "d13_precision_preset",
    mask_sql(S.persistence_mask_cte("precise_mask", stats.clamped_pct(0.3), 1, D.precision_preset(), "_precise")),
)
def d13(spark, sf):
    return D.combined_persistence(X.cube(spark, sf), 0.3, GRID, X.HOURS, D.precision_preset(), min_component=1)


S.event_risk_ctes()


def event_layer_rows(spark: SparkSession, sf: str) -> DataFrame:
    return D.event_layers(X.cube(spark, sf), GRID)


@register("d14_fine_anomaly", "SELECT scene_id, hour, r, c, round(anomaly, 6) AS anomaly FROM ev_layers")
def d14(spark, sf):
    return rounded(event_layer_rows(spark, sf).select("scene_id", "hour", "r", "c", "anomaly"), "anomaly")


@register("d15_band_score", "SELECT scene_id, hour, r, c, round(band, 6) AS band, in_band FROM ev_layers")
def d15(spark, sf):
    layers = G.with_valid(X.cube(spark, sf)).withColumn("seen", F.col("bt13").isNotNull() & F.col("valid"))
    return rounded(D.band_score(layers, GRID).select("scene_id", "hour", "r", "c", "band", "in_band"), "band")


@register("d16_glint", "SELECT scene_id, hour, r, c FROM ev_layers WHERE glint")
def d16(spark, sf):
    layers = G.with_valid(X.cube(spark, sf)).withColumn("seen", F.col("bt13").isNotNull() & F.col("valid"))
    return D.glint_flag(layers, GRID).where("glint").select("scene_id", "hour", "r", "c")


@register("d17_event_risk", "SELECT scene_id, r, c, round(risk, 6) AS risk, active_hours FROM ev_risk")
def d17(spark, sf):
    rows = D.event_risk(event_layer_rows(spark, sf), GRID, X.HOURS)
    return rounded(rows.select(*KEY, "risk", "active_hours"), "risk")


S.event_mask_cte("ev_mask", 0.9)


@register("d17b_event_detector", mask_sql("ev_mask"))
def d17b(spark, sf):
    return D.event_detector(X.cube(spark, sf), GRID, X.HOURS, D.EventConfig(risk_percentile=90.0))


@register(
    "d18_mask_intersection",
    "SELECT scene_id, r, c FROM warm INTERSECT SELECT scene_id, r, c FROM res_hot",
)
def d18(spark, sf):
    return D.intersect_masks(warm(spark, sf), D.spatial_residual(X.day(spark, sf), GRID, 0.05))


@register("d18b_mask_union", "SELECT scene_id, r, c FROM hot5 UNION SELECT scene_id, r, c FROM res_hot")
def d18b(spark, sf):
    hot = stats.percentile_mask(X.day(spark, sf), F.col("bt13"), F.col("valid"), stats.clamped_pct(0.05), SCENE)
    return D.unite_masks(hot, D.spatial_residual(X.day(spark, sf), GRID, 0.05))


S.quantile_mask_cte("m_res_all", "res_spectral", "residual", "seen13", stats.pct(0.05))
S.quantile_mask_cte("m_risk_all", "risk_field", "risk", "valid", stats.clamped_pct(0.05))
S.refined_cte("m_risk", "m_risk_all")
S.persistence_mask_cte("m_persist", stats.clamped_pct(0.05))
S.define(
    "method_masks",
    "SELECT 'spatial_residual' AS method, scene_id, r, c FROM m_res_all WHERE dthr IS NULL OR dbt >= dthr UNION ALL "
    "SELECT 'digital_twin', scene_id, r, c FROM m_risk UNION ALL SELECT 'combined_persistence', scene_id, r, c FROM m_persist "
    "UNION ALL SELECT 'isolation_forest', scene_id, r, c FROM either_outliers",
)
S.define(
    "method_flags",
    "SELECT m.method, d.scene_id, d.valid, p.r IS NOT NULL AS pred, t.r IS NOT NULL AS truth FROM day d "
    "CROSS JOIN (VALUES ('spatial_residual'), ('digital_twin'), ('combined_persistence'), ('isolation_forest')) m(method) "
    "LEFT JOIN method_masks p ON p.method = m.method AND p.scene_id = d.scene_id AND p.r = d.r AND p.c = d.c "
    "LEFT JOIN truth1 t ON t.scene_id = d.scene_id AND t.r = d.r AND t.c = d.c",
)
S.confusion_cte("method_metrics", "method_flags", "scene_id, method")
S.define("spot_counts", "SELECT scene_id, count(*) AS n_hotspots FROM hotspots GROUP BY ALL")


@register(
    "d19_day_evaluation",
    f"SELECT scene_id, method, {S.CONFUSION_COLUMNS}, coalesce(n_hotspots, 0) AS n_hotspots, "
    "round(CASE WHEN 0.25e0 * precision + recall > 1e-15 THEN 1.25e0 * precision * recall / (0.25e0 * precision + recall) ELSE 0e0 END, 6) AS f_beta "
    "FROM method_metrics LEFT JOIN spot_counts USING (scene_id) WHERE method <> 'isolation_forest'",
)
def d19(spark, sf):
    """The three methods without the forest, which d19b adds."""
    cube, spots = cut(X.cube(spark, sf)), X.hotspots(spark, sf)
    parts = None
    for method in ("spatial_residual", "digital_twin", "combined_persistence"):
        cfg = P.RunConfig(contamination=0.05, method=method, beta=0.5)
        rows = P.evaluate_days(cube, spots, GRID, cfg)
        parts = rows if parts is None else parts.unionByName(rows)
    keep = confusion_view(parts, "scene_id", "method", "n_hotspots", "f_beta")
    return rounded(keep, "f_beta")


@register("d19b_day_evaluation_all", f"SELECT scene_id, method, {S.CONFUSION_COLUMNS} FROM method_metrics")
def d19b(spark, sf):
    rows = P.evaluate_days(X.cube(spark, sf), X.hotspots(spark, sf), GRID, P.RunConfig(contamination=0.05))
    return confusion_view(rows, "scene_id", "method")


def steps_sql() -> str:
    """Calibration of the multi-band residual, every step and tie rule spelled out."""
    steps = P.contamination_steps(32)
    values = ", ".join(f"({i}, {S.lit(c)}, {S.lit(stats.pct(c))})" for i, c in enumerate(steps))
    S.define("cal_steps", f"SELECT * FROM (VALUES {values}) t(step, contamination, q)")
    S.define(
        "cal_thr",
        "SELECT scene_id, unnest(range(32)) AS step, unnest(quantile_cont(residual, ["
        + ", ".join(S.lit(stats.pct(c)) for c in steps) + "])) AS thr FROM res_spectral WHERE seen13 GROUP BY scene_id",
    )
    S.define(
        "cal_flags",
        "SELECT x.scene_id, t.step, x.valid, x.seen13 AND x.residual >= t.thr AND (x.dthr IS NULL OR coalesce(x.dbt >= x.dthr, FALSE)) AS pred, "
        "k.r IS NOT NULL AS truth FROM res_spectral x JOIN cal_thr t USING (scene_id) LEFT JOIN truth1 k ON k.scene_id = x.scene_id AND k.r = x.r AND k.c = x.c",
    )
    S.confusion_cte("cal_metrics", "cal_flags", "scene_id, step")
    S.define("cal_sparse", "SELECT scene_id, step, count(*) FILTER (pred) AS mask_cells FROM cal_flags GROUP BY ALL")
    S.define(
        "cal_best",
        "SELECT *, f1 AS f_beta, row_number() OVER (PARTITION BY scene_id ORDER BY round(f1, 12) DESC, round(precision, 12) DESC, round(iou, 12) DESC, "
        "tp DESC, fp, mask_cells, step) AS rn FROM cal_metrics JOIN cal_sparse USING (scene_id, step) JOIN cal_steps USING (step)",
    )
    return (
        f"SELECT scene_id, CAST(step AS INT) AS step, {S.CONFUSION_COLUMNS}, round(f_beta, 6) AS f_beta, CAST(mask_cells AS BIGINT) AS mask_cells, "
        "round(contamination, 9) AS contamination FROM cal_best WHERE rn = 1"
    )


@register("d20_calibration", steps_sql())
def d20(spark, sf):
    best = P.calibrate("spatial_residual", X.cube(spark, sf), X.hotspots(spark, sf), GRID)
    out = confusion_view(best, "scene_id", "step", "f_beta", "mask_cells", "contamination")
    return rounded(out, "f_beta").withColumn("contamination", F.round("contamination", 9))


@register("d20b_calibration_persistence")
def d20b(spark, sf):
    best = P.calibrate("combined_persistence", X.cube(spark, sf), X.hotspots(spark, sf), GRID)
    return confusion_view(best, "scene_id", "step", "contamination")


@register("d20c_calibration_twin")
def d20c(spark, sf):
    best = P.calibrate("digital_twin", X.cube(spark, sf), X.hotspots(spark, sf), GRID)
    return confusion_view(best, "scene_id", "step", "contamination")


@register("d20d_calibration_forest")
def d20d(spark, sf):
    best = P.calibrate("isolation_forest", X.cube(spark, sf), X.hotspots(spark, sf), GRID)
    return confusion_view(best, "scene_id", "step", "contamination")


# ================================================================ features and learning

S.feature_ctes()


@register("m1_features", f"SELECT scene_id, r, c, {rsql(*M.FEATURES)}, valid FROM features")
def m1(spark, sf):
    return rounded(M.build_features(X.cube(spark, sf), GRID), *M.FEATURES)


@register("m1b_diagnostic_features", f"SELECT scene_id, r, c, {rsql(*M.DIAGNOSTIC)}, valid FROM diag_features")
def m1b(spark, sf):
    return rounded(M.diagnostic_features(X.cube(spark, sf), GRID), *M.DIAGNOSTIC)


S.define(
    "training",
    "SELECT f.*, CAST(CASE WHEN t.r IS NOT NULL THEN 1 ELSE 0 END AS INT) AS label FROM features f LEFT JOIN truth1 t USING (scene_id, r, c) WHERE f.valid",
)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return DP.labelled_features(X.cube(spark, sf), X.hotspots(spark, sf), GRID)


@register("m2_stacked_rows", f"SELECT scene_id, r, c, {rsql(*M.FEATURES)}, label FROM training")
def m2(spark, sf):
    return rounded(M.training_rows(labelled(spark, sf)), *M.FEATURES)


@register(
    "m3_standard_scaling",
    "SELECT scene_id, r, c, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1e0 END, 6) AS {c}" for c in M.FEATURES
    ) + " FROM training",
)
def m3(spark, sf):
    rows = cut(M.training_rows(labelled(spark, sf)))
    moments = M.population_scaling(rows).first().asDict()
    scaled = rows.withColumns(M.scaled_columns(moments)).select(*KEY, *M.FEATURES)
    return rounded(scaled, *M.FEATURES)


@register("m4_logistic_regression")
def m4(spark, sf):
    table = cut(labelled(spark, sf))
    return L.predict_probability(L.fit_classifier(table), table).select(*KEY, "prob")


# Where the gradient is zero, sum of w p z + weight / c equals sum of w y z, which needs no fit; only the optimum does that.
_W = "CASE WHEN label = 1 THEN n / (2e0 * n1) ELSE n / (2e0 * (n - n1)) END"
_Z = {c: f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1e0 END" for c in M.FEATURES}


@register(
    "m4b_logistic_optimum",
    "SELECT feature, round(sum(v), 4) AS moment FROM (SELECT unnest(['intercept', "
    + ", ".join(f"'{c}'" for c in M.FEATURES) + f"]) AS feature, unnest([w, {', '.join(f'w * z_{c}' for c in M.FEATURES)}]) AS v FROM (SELECT label, "
    + f"{_W} AS w, " + ", ".join(f"z_{c}" for c in M.FEATURES) + " FROM (SELECT label, count(*) OVER () AS n, sum(label) OVER () AS n1, "
    + ", ".join(f"{z} AS z_{c}" for c, z in _Z.items()) + " FROM (SELECT * REPLACE (CAST(label AS INT) AS label) FROM training) r) t) u WHERE label = 1) x GROUP BY ALL",
)
def m4b(spark, sf):
    """Moments of the fitted probabilities; equal to those of the labels at the optimum and nowhere else."""
    table = cut(labelled(spark, sf))
    fitted = L.fit_classifier(table)
    rows = cut(M.training_rows(table, "valid"))
    known = rows.join(L.predict_probability(fitted, rows).select(*KEY, "prob"), KEY)
    n, n1 = rows.agg(F.count("*"), F.sum("label")).first()
    w = F.when(F.col("label") == 1, n / (2.0 * n1)).otherwise(n / (2.0 * (n - n1)))
    known = known.withColumns(M.scaled_columns(M.population_scaling(rows).first().asDict()))
    pull = {c: float(b) / fitted.cfg.c for c, b in zip(M.FEATURES, fitted.model.beta[0])}
    sums = [F.struct(F.lit("intercept").alias("feature"), F.sum(w * F.col("prob")).alias("moment"))] + [
        F.struct(F.lit(c).alias("feature"), (F.sum(w * F.col("prob") * F.col(c)) + pull[c]).alias("moment")) for c in M.FEATURES
    ]
    return known.agg(F.array(*sums).alias("_a")).select(F.explode("_a").alias("_a")).select("_a.feature", F.round("_a.moment", 4).alias("moment"))


BOOSTED = L.multiday_config()


@register("m5_boosted_trees")
def m5(spark, sf):
    table = cut(labelled(spark, sf))
    return L.predict_probability(L.fit_classifier(table, BOOSTED), table).select(*KEY, "prob")


FEW_ROUNDS = L.multiday_config(rounds=3, bins=64)


def few_rounds(prefix: str, models: str) -> str:
    cfg = FEW_ROUNDS.boosting
    return S.boosted_cte(prefix, models, M.FEATURES, cfg.rounds, cfg.depth, cfg.rate, cfg.bins, cfg.min_leaf)


@register(
    "m5b_boosted_three_rounds",
    f"SELECT scene_id, r, c, round(1e0 / (1e0 + exp(-margin)), 6) AS prob FROM {few_rounds('bt', 'SELECT -1 AS model')}",
)
def m5b(spark, sf):
    table = cut(labelled(spark, sf))
    prob = L.predict_probability(L.fit_classifier(table, FEW_ROUNDS), table.where("valid"))
    return rounded(prob.select(*KEY, "prob"), "prob")


@register("m6_probability_mask")
def m6(spark, sf):
    table = cut(labelled(spark, sf))
    return L.threshold_mask(L.predict_probability(L.fit_classifier(table), table), 0.5)


@register("m7_grown_peaks")
def m7(spark, sf):
    table = cut(labelled(spark, sf))
    prob = cut(L.predict_probability(L.fit_classifier(table), table))
    return L.grown_peaks(prob, GRID, 0.5, 1, 1.2, 2)


@register(
    "m8a_spatial_folds",
    "SELECT scene_id, r, c, CAST((CASE WHEN r >= 8 THEN 1 ELSE 0 END + CASE WHEN r >= 16 THEN 1 ELSE 0 END) * 4 + CASE WHEN c >= 6 THEN 1 ELSE 0 END "
    "+ CASE WHEN c >= 12 THEN 1 ELSE 0 END + CASE WHEN c >= 18 THEN 1 ELSE 0 END AS INT) AS fold FROM day",
)
def m8a(spark, sf):
    return X.day(spark, sf).select(*KEY, M.spatial_fold(GRID, 3, 4).cast("int").alias("fold"))


S.define("order_days", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders")
S.define(
    "fold_test",
    "SELECT day, CAST((i >= floor(1 * (n / 4e0))) AS INT) + CAST((i >= floor(2 * (n / 4e0))) AS INT) + CAST((i >= floor(3 * (n / 4e0))) AS INT) AS fold "
    "FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM order_days) t",
)


@register(
    "m8b_temporal_folds",
    "SELECT CAST(fold AS INT) AS fold, 'test' AS role, strftime(day, '%Y-%m-%d') AS day FROM fold_test UNION ALL "
    "SELECT CAST(s.fold AS INT), 'train', strftime(d.day, '%Y-%m-%d') FROM order_days d JOIN (SELECT fold, min(day) AS a, max(day) AS b FROM fold_test GROUP BY ALL) s "
    "ON date_diff('day', s.b, d.day) > 1 OR date_diff('day', d.day, s.a) > 1",
)
def m8b(spark, sf):
    days = spark.read.parquet(f"{sf}/orders.parquet").select(F.to_date("o_orderdate").alias("day"))
    return Y.temporal_folds(days, 4, 1).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("m8c_fold_best_threshold")
def m8c(spark, sf):
    table = labelled(spark, sf)
    # The published search over 3 x 3 blocks.
    thresholds = [0.2 + i * (0.95 - 0.2) / 31 for i in range(32)]
    best = L.fold_best_threshold(table, X.hotspots(spark, sf), GRID, M.spatial_fold(GRID, 3, 3), range(9), thresholds, (1, 2, 3), radius_km=20.0)
    return event_view(best, "scene_id", "fold", "threshold", "nms_radius")


S.define(
    "scaled_features",
    "SELECT scene_id, r, c, " + ", ".join(
        f"({c} - avg({c}) OVER (PARTITION BY scene_id)) / CASE WHEN stddev_pop({c}) OVER (PARTITION BY scene_id) > 0 "
        f"THEN stddev_pop({c}) OVER (PARTITION BY scene_id) ELSE 1e0 END AS {c}" for c in O.OUTLIER_FEATURES
    ) + " FROM features WHERE valid",
)
S.forest_cte("feature_forest", "scaled_features", list(O.OUTLIER_FEATURES), 200)
S.outside_cte("forest_outliers", "feature_forest", "iso_score", 0.05)


@register("m9a_isolation_forest", mask_sql("forest_outliers"))
def m9a(spark, sf):
    feats = M.build_features(X.cube(spark, sf), GRID)
    return O.outlier_mask(feats, O.OutlierConfig(contamination=0.05), GRID.cells)


S.lof_cte("feature_lof", "scaled_features", list(O.OUTLIER_FEATURES), 24)
S.define(
    "lof_mask",
    "SELECT scene_id, r, c FROM (SELECT *, quantile_cont(-lof, 0.05e0) OVER (PARTITION BY scene_id) AS cutoff, count(*) OVER (PARTITION BY scene_id) AS n "
    "FROM feature_lof) t WHERE n >= 50 AND -lof < cutoff",
)


@register("m9b_local_outlier_factor", "SELECT scene_id, r, c, round(lof, 6) AS lof FROM feature_lof")
def m9b(spark, sf):
    feats = M.build_features(X.cube(spark, sf), GRID).where("valid")
    scaled = O.scale_features(feats.select(*KEY, *O.OUTLIER_FEATURES), O.OUTLIER_FEATURES)
    return rounded(O.local_outlier_factor(scaled, O.OUTLIER_FEATURES, 24).select(*KEY, "lof"), "lof")


@register("m9c_elliptic_envelope")
def m9c(spark, sf):
    feats = M.build_features(X.cube(spark, sf), GRID)
    return O.outlier_mask(feats, O.OutlierConfig(method="elliptic_envelope", contamination=0.05), GRID.cells)


@register("m9d_ensemble_vote")
def m9d(spark, sf):
    feats = M.build_features(X.cube(spark, sf), GRID)
    return O.outlier_mask(feats, O.OutlierConfig(method="ensemble", contamination=0.05), GRID.cells)


@register("m10_outlier_filter", "SELECT scene_id, r, c FROM risk_wide INTERSECT SELECT scene_id, r, c FROM lof_mask")
def m10(spark, sf):
    cube = cut(X.cube(spark, sf))
    wide = T.risk_mask(cube, 0.5, GRID, T.TwinConfig(lof_neighbors=0))
    cfg = O.OutlierConfig(method="local_outlier_factor", contamination=0.05)
    return O.keep_outliers(wide, M.build_features(cube, GRID), cfg, GRID.cells)


S.dilate_cte("lof_grown", "lof_mask", 1)


@register("m11_outliers_grown", mask_sql("lof_grown JOIN day USING (scene_id, r, c) WHERE valid"))
def m11(spark, sf):
    feats = cut(M.build_features(X.cube(spark, sf), GRID))
    out = O.outlier_mask(feats, O.OutlierConfig(method="local_outlier_factor", contamination=0.05), GRID.cells)
    return W.only_outliers(out, feats, 1, GRID)


@register(
    "m11b_outlier_union",
    "SELECT scene_id, r, c FROM risk_hot UNION SELECT g.scene_id, g.r, g.c FROM lof_grown g JOIN day d USING (scene_id, r, c) WHERE d.valid",
)
def m11b(spark, sf):
    cube = cut(X.cube(spark, sf))
    feats = cut(M.build_features(cube, GRID))
    out = O.outlier_mask(feats, O.OutlierConfig(method="local_outlier_factor", contamination=0.05), GRID.cells)
    hot = T.risk_mask(cube, 0.05, GRID, T.TwinConfig(lof_neighbors=0))
    return W.union_with_outliers(hot, out, feats, 1, GRID)


# The risk stands in for the probability: a deterministic score both engines can compute.
S.define("risk_prob", "SELECT scene_id, r, c, CASE WHEN valid THEN risk ELSE 0e0 END AS prob, valid FROM risk_field")
S.smooth_cte("risk_prob_smooth", "risk_prob", "prob", 1.2)
S.define(
    "risk_prob_out",
    "SELECT p.scene_id, p.r, p.c, CASE WHEN m.r IS NOT NULL THEN p.prob ELSE 0e0 END AS score FROM risk_prob_smooth p LEFT JOIN lof_mask m USING (scene_id, r, c)",
)
S.local_max_cte("risk_prob_top", "risk_prob_out", "score", 1)
S.define(
    "outlier_peaks",
    "SELECT p.scene_id, p.r, p.c FROM risk_prob_out p JOIN risk_prob_top t USING (scene_id, r, c) JOIN day d USING (scene_id, r, c) "
    "WHERE d.valid AND p.score > 0 AND p.score = t.top",
)


def risk_probability(spark: SparkSession, sf: str) -> DataFrame:
    field = T.risk_field(X.cube(spark, sf), GRID)
    return field.select(*KEY, F.when(F.col("valid"), F.col("smoothed")).otherwise(0.0).alias("prob"), "valid")


@register(
    "m11c_outlier_weighted_peaks",
    f"SELECT g.scene_id, g.r, g.c FROM {S.dilate_cte('outlier_peaks_grown', 'outlier_peaks', 1)} g JOIN day d USING (scene_id, r, c) WHERE d.valid",
)
def m11c(spark, sf):
    prob = cut(risk_probability(spark, sf))
    feats = M.build_features(X.cube(spark, sf), GRID)
    out = O.outlier_mask(feats, O.OutlierConfig(method="local_outlier_factor", contamination=0.05), GRID.cells)
    return W.outlier_weighted_peaks(prob, out, 1, 1, GRID)


@register("m12_multiday_training")
def m12(spark, sf):
    products = DP.day_products(
        X.cube(spark, sf), X.hotspots(spark, sf), X.detections(spark, sf), GRID, BOOSTED, threshold=0.5
    )
    out = None
    for name, rows in DP.score_products(products, X.hotspots(spark, sf), GRID, 20.0).items():
        tagged = rows.withColumn("product", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return event_view(out, "scene_id", "product")


@register("m13_leave_one_day_out")
def m13(spark, sf):
    table = cut(labelled(spark, sf))
    ids = [r["scene_id"] for r in table.select("scene_id").distinct().orderBy("scene_id").collect()]
    rows = L.leave_one_scene_out(
        table, X.hotspots(spark, sf), GRID, ids, BOOSTED, 20.0, 0.5
    )
    return L.held_out_summary(rows)


@register(
    "m13b_held_out_three_rounds",
    "SELECT scene_id, r, c, round(1e0 / (1e0 + exp(-margin)), 6) AS prob "
    f"FROM {few_rounds('lo', 'SELECT DISTINCT scene_id AS model FROM training')} WHERE scene_id = model",
)
def m13b(spark, sf):
    table = cut(labelled(spark, sf))
    ids = [r["scene_id"] for r in table.where("valid").select("scene_id").distinct().orderBy("scene_id").collect()]
    return rounded(L.held_out_probability(table.where("valid"), ids, FEW_ROUNDS).select(*KEY, "prob"), "prob")


# ================================================================ evaluation

S.units_cte("res_units", "res_hot")
S.event_cte("ec_cell", "res_units", RADII, "scenes")


@register(
    "e1_local_distance",
    f"SELECT p.event_id, u.unit, round(x.km, 6) AS km FROM ec_cell_pairs x JOIN res_units u USING (scene_id, unit) JOIN hotspots_in p ON p.pid = x.pid "
    "WHERE x.km <= 30e0",
)
def e1(spark, sf):
    points = E.place_points(X.hotspots(spark, sf), GRID)
    units = E.prediction_units(D.spatial_residual(X.day(spark, sf), GRID, 0.05), GRID)
    reach = E._reach_table(units, E._reference(units, points, SCENE), GRID, 30.0, SCENE)
    near = points.join(reach, KEY).select("event_id", F.explode(E._distances(30.0)).alias("s"))
    return near.select("event_id", F.col("s.unit").alias("unit"), F.round("s.km", 6).alias("km"))


@register("e2_radius_join_cells", f"SELECT scene_id, {S.EVENT_COLUMNS} FROM ec_cell WHERE radius_km = 20e0")
def e2(spark, sf):
    mask = D.spatial_residual(X.day(spark, sf), GRID, 0.05)
    return event_view(E.event_metrics(mask, X.hotspots(spark, sf), GRID, 20.0, scenes=scenes(spark, sf)), "scene_id")


S.define(
    "timed_ref",
    "SELECT scene_id, 0.5e0 * (avg(lat) FILTER (event_id % 2 = 0) + avg(lat) FILTER (event_id % 2 = 1)) AS lat_ref FROM points GROUP BY scene_id",
)
S.define(
    "timed_pairs",
    "SELECT scene_id, p.event_id AS pid, u.event_id AS uid, p.ts BETWEEN u.ts - INTERVAL 30 MINUTE AND u.ts + INTERVAL 30 MINUTE AS soon FROM points p JOIN points u USING (scene_id) "
    "JOIN timed_ref x USING (scene_id) WHERE p.event_id % 2 = 0 AND u.event_id % 2 = 1 "
    "AND sqrt(((p.lat - u.lat) * 111.32e0) ** 2 + ((p.lon - u.lon) * 111.32e0 * cos(radians(x.lat_ref))) ** 2) <= 12e0",
)
S.define(
    "timed_hits",
    "SELECT scene_id, minutes, count(DISTINCT pid) AS tp_recall, count(DISTINCT uid) AS tp_precision FROM ("
    "SELECT scene_id, 30 AS minutes, pid, uid FROM timed_pairs WHERE soon UNION ALL SELECT scene_id, -1, pid, uid FROM timed_pairs) t GROUP BY ALL",
)
_TP = "coalesce(tp_recall, 0)", "coalesce(tp_precision, 0)"


@register(
    "e2t_time_matching",
    f"SELECT scene_id, minutes, n_focos, n_units, {_TP[0]} AS tp_recall, {_TP[1]} AS tp_precision, round({_TP[0]} / n_focos, 6) AS recall, "
    f"round({_TP[1]} / n_units, 6) AS precision FROM (SELECT scene_id, m.minutes, count(*) FILTER (event_id % 2 = 0) AS n_focos, count(*) FILTER (event_id % 2 = 1) AS n_units "
    "FROM points CROSS JOIN (VALUES (30), (-1)) m(minutes) GROUP BY ALL) n LEFT JOIN timed_hits USING (scene_id, minutes)",
)
def e2t(spark, sf):
    """All events: even ids as hotspots, odd ones as a second sensor; -1 minutes stands for any time."""
    at = X.points(spark, sf).select("event_id", "scene_id", "lat", "lon", "ts")
    even, odd = at.where("event_id % 2 = 0"), at.where("event_id % 2 = 1")
    parts = [I.interval_metrics(even, odd, 12.0, m).withColumn("minutes", F.lit(-1 if m is None else m)) for m in (30, None)]
    rows = parts[0].unionByName(parts[1])
    return rounded(rows.select("scene_id", "minutes", "n_focos", "n_units", "tp_recall", "tp_precision", "recall", "precision"), "recall", "precision")


S.centroid_cte("warm_units", "warm", 2)
S.event_cte("ec_mid", "warm_units", RADII, "scenes")


@register("e3_radius_join_centroids", f"SELECT scene_id, {S.EVENT_COLUMNS} FROM ec_mid")
def e3(spark, sf):
    rows = E.event_curve(warm(spark, sf), X.hotspots(spark, sf), GRID, RADII, "centroid", scenes=scenes(spark, sf))
    return event_view(rows, "scene_id")


# Every scene of either table, so scenes with one empty side appear: hotspots only count where
# the mask has none.
S.define("ec_every", "SELECT DISTINCT scene_id FROM events_scenes UNION SELECT scene_id FROM scenes")
S.define("events_scenes", "SELECT DISTINCT scene_id FROM hotspots UNION SELECT scene_id + 100 FROM scenes")
S.define("valid_hot", "SELECT h.scene_id, h.r, h.c FROM res_hot h JOIN day d USING (scene_id, r, c) WHERE d.valid AND h.scene_id <> 2")
S.units_cte("valid_hot_units", "valid_hot")
S.define("hotspots_some", "SELECT * FROM hotspots WHERE scene_id <> 3")
S.event_cte("ec_sides", "valid_hot_units", [20.0], "ec_every", points="hotspots_some")


@register("e4_event_metrics_empty_sides", f"SELECT scene_id, {S.EVENT_COLUMNS} FROM ec_sides")
def e4(spark, sf):
    day = X.day(spark, sf)
    mask = D.spatial_residual(day, GRID, 0.05).where(F.col("scene_id") != 2)
    spots = X.hotspots(spark, sf)
    known = scenes(spark, sf)
    every = spots.select("scene_id").union(known).union(known.select(F.col("scene_id") + 100)).distinct()
    rows = E.event_metrics(mask, spots.where(F.col("scene_id") != 3), GRID, 20.0, valid=day, scenes=every)
    return event_view(rows, "scene_id")


@register("e5_radius_curve", f"SELECT scene_id, {S.EVENT_COLUMNS} FROM ec_cell")
def e5(spark, sf):
    mask = D.spatial_residual(X.day(spark, sf), GRID, 0.05)
    return event_view(E.event_curve(mask, X.hotspots(spark, sf), GRID, RADII, scenes=scenes(spark, sf)), "scene_id")


S.define(
    "res_flags",
    "SELECT d.scene_id, d.r, d.c, d.valid, p.r IS NOT NULL AS pred, t.r IS NOT NULL AS truth FROM day d LEFT JOIN res_hot p USING (scene_id, r, c) "
    "LEFT JOIN truth1 t USING (scene_id, r, c)",
)
S.confusion_cte("res_confusion", "res_flags")


def residual_flags(spark: SparkSession, sf: str) -> DataFrame:
    day = X.day(spark, sf)
    cells = P.truth_cells(X.hotspots(spark, sf), day, GRID, 1)
    return E.with_flag(cells, D.spatial_residual(day, GRID, 0.05), "pred")


@register("e6_cell_confusion", f"SELECT scene_id, {S.CONFUSION_COLUMNS} FROM res_confusion")
def e6(spark, sf):
    return confusion_view(E.confusion(residual_flags(spark, sf)), "scene_id")


@register(
    "e7_f_beta",
    "SELECT scene_id, round(CASE WHEN 4e0 * precision + recall > 1e-15 THEN 5e0 * precision * recall / (4e0 * precision + recall) ELSE 0e0 END, 6) AS f2 FROM res_confusion",
)
def e7(spark, sf):
    rows = E.with_f_beta(E.confusion(residual_flags(spark, sf)), 2.0, "f2")
    return rounded(rows.select("scene_id", "f2"), "f2")


@register(
    "e8_cell_classes",
    "SELECT scene_id, r, c, CASE WHEN pred AND truth THEN 'TP' WHEN pred THEN 'FP' WHEN truth THEN 'FN' ELSE 'TN' END AS klass FROM res_flags WHERE valid",
)
def e8(spark, sf):
    return E.cell_classes(residual_flags(spark, sf)).select(*KEY, "klass")


S.define("spot_best", "SELECT pid, min(km) AS km FROM ec_cell_pairs GROUP BY ALL")


@register(
    "e8b_hotspot_classes",
    "SELECT p.event_id, p.scene_id, CASE WHEN b.km <= 20e0 THEN 'TP' ELSE 'FN' END AS klass, round(CASE WHEN b.km <= 20e0 THEN b.km END, 6) AS km "
    "FROM hotspots_in p LEFT JOIN spot_best b ON b.pid = p.pid",
)
def e8b(spark, sf):
    mask = D.spatial_residual(X.day(spark, sf), GRID, 0.05)
    rows = E.classify_hotspots(mask, X.hotspots(spark, sf), GRID, 20.0)
    return rounded(rows.select("event_id", "scene_id", "klass", "km"), "km")


@register(
    "e8c_prediction_classes",
    "SELECT u.scene_id, u.unit, CASE WHEN min(x.km) <= 20e0 THEN 'TP' ELSE 'FP' END AS klass FROM res_units u LEFT JOIN ec_cell_pairs x "
    "USING (scene_id, unit) GROUP BY ALL",
)
def e8c(spark, sf):
    mask = D.spatial_residual(X.day(spark, sf), GRID, 0.05)
    return E.classify_predictions(mask, X.hotspots(spark, sf), GRID, 20.0).select("scene_id", "unit", "klass")


def values(name: str, items) -> str:
    return f"(VALUES {', '.join(f'({S.lit(x) if isinstance(x, float) else x})' for x in items)}) v_{name}({name})"


# The published peak search.
PEAK_SPACE = {
    "thresholds": [0.30 + i * (0.95 - 0.30) / 29 for i in range(30)], "radii": (1, 2, 3, 4), "sigmas": (0.8, 1.2, 1.6, 2.0),
    "growths": (0, 1, 2), "distances": (3.0, 5.0, 8.0, 10.0),
}


def sweep_sql() -> str:
    """Peak sweep over the risk: sigma x peak radius x threshold x growth x match radius."""
    parts = []
    for sigma in PEAK_SPACE["sigmas"]:
        tag = str(sigma).replace(".", "")
        S.smooth_cte(f"sw_s{tag}", "risk_prob", "prob", sigma)
        for rad in PEAK_SPACE["radii"]:
            S.local_max_cte(f"sw_t{tag}_{rad}", f"sw_s{tag}", "prob", rad)
            parts.append(
                f"SELECT s.scene_id, {S.lit(sigma)} AS sigma, {rad} AS nms_radius, s.r, s.c, s.prob AS smoothed FROM sw_s{tag} s "
                f"JOIN sw_t{tag}_{rad} t USING (scene_id, r, c) JOIN day d USING (scene_id, r, c) WHERE d.valid AND s.prob = t.top"
            )
    S.define("sw_found", " UNION ALL ".join(parts))
    S.define("sw_masks", f"SELECT f.*, threshold FROM sw_found f JOIN {values('threshold', PEAK_SPACE['thresholds'])} ON f.smoothed >= threshold")
    grown = ["SELECT scene_id, sigma, nms_radius, threshold, 0 AS growth, r, c FROM sw_masks"]
    for g in PEAK_SPACE["growths"][1:]:
        S.dilate_cte(f"sw_grown{g}", "sw_masks", g, "scene_id, sigma, nms_radius, threshold")
        grown.append(f"SELECT scene_id, sigma, nms_radius, threshold, {g}, r, c FROM sw_grown{g}")
    S.define("sw_all", f"SELECT g.* FROM ({' UNION ALL '.join(grown)}) g JOIN day d USING (scene_id, r, c) WHERE d.valid")
    keys = "scene_id, sigma, nms_radius, threshold, growth"
    S.units_cte("sw_units", "sw_all", keys)
    S.define(
        "sw_every",
        f"SELECT {keys} FROM scenes CROSS JOIN {values('sigma', PEAK_SPACE['sigmas'])} CROSS JOIN {values('nms_radius', PEAK_SPACE['radii'])} "
        f"CROSS JOIN {values('threshold', PEAK_SPACE['thresholds'])} CROSS JOIN {values('growth', PEAK_SPACE['growths'])}",
    )
    S.event_cte("sw_events", "sw_units", list(PEAK_SPACE["distances"]), "sw_every", keys)
    S.define(
        "sw_best",
        "SELECT *, row_number() OVER (PARTITION BY scene_id, radius_km ORDER BY round(f1, 12) DESC, threshold, nms_radius, sigma, growth) AS rn FROM sw_events",
    )
    return f"SELECT scene_id, threshold, CAST(nms_radius AS INT) AS nms_radius, sigma, CAST(growth AS INT) AS growth, {S.EVENT_COLUMNS} FROM sw_best WHERE rn = 1"


@register("e9_peak_sweep", sweep_sql())
def e9(spark, sf):
    rows = W.peak_sweep(risk_probability(spark, sf), X.hotspots(spark, sf), GRID, **PEAK_SPACE)
    best = E.best_row(rows, ["scene_id", "radius_km"], ["f1"], ["threshold", "nms_radius", "sigma", "growth"])
    return event_view(best, "scene_id", "threshold", "nms_radius", "sigma", "growth")


@register("e9b_event_detector_sweep")
def e9b(spark, sf):
    rows = W.event_sweep(X.cube(spark, sf), X.hotspots(spark, sf), GRID, X.HOURS, W.EVENT_SPACE, 20.0)
    return event_view(rows, "scene_id", "sizes", "btd_low", "btd_high", "risk_percentile", "min_active_hours", "weight_anomaly", "weight_persistence", "max_component")


@register("e9c_outlier_sweep")
def e9c(spark, sf):
    cube = cut(X.cube(spark, sf))
    wide = T.risk_mask(cube, 0.3, GRID, T.TwinConfig(lof_neighbors=0))
    feats = cut(M.build_features(cube, GRID))
    rows = W.outlier_sweep(
        cut(wide), feats, X.hotspots(spark, sf), GRID
    )
    return event_view(rows, "scene_id", "method", "contamination")


@register("e9d_outlier_mode_sweep")
def e9d(spark, sf):
    cube = cut(X.cube(spark, sf))
    base = T.risk_mask(cube, 0.05, GRID, T.TwinConfig(lof_neighbors=0))
    feats = cut(M.build_features(cube, GRID))
    rows = W.outlier_mode_sweep(cut(base), cut(risk_probability(spark, sf)), feats, X.hotspots(spark, sf), GRID)
    return event_view(rows, "scene_id", "mode", "method", "contamination", "peak_radius", "growth")


S.define(
    "nearest_km",
    "SELECT p.event_id, p.scene_id, min(x.km) AS km FROM hotspots_in p JOIN ec_mid_pairs x ON x.pid = p.pid GROUP BY ALL",
)


@register(
    "e10_nearest_component",
    "SELECT scene_id, count(*) AS n, round(min(km), 6) AS km_min, round(median(km), 6) AS km_median, round(max(km), 6) AS km_max, "
    + ", ".join(f"count(*) FILTER (km <= {d}) AS within_{d}km" for d in (3, 5, 8, 20, 50)) + " FROM nearest_km GROUP BY ALL",
)
def e10(spark, sf):
    near = E.nearest_component_km(warm(spark, sf), X.hotspots(spark, sf), GRID, 5.0)
    return rounded(E.distance_summary(near), "km_min", "km_median", "km_max")


# The published comparison.
MATRIX_SHARES, MATRIX_RADII = (0.01, 0.02, 0.04, 0.06), (1.5, 3.0, 5.0, 8.0)


def matrix_sql() -> str:
    parts = []
    for i, c in enumerate(MATRIX_SHARES):
        S.quantile_mask_cte(f"mx_r{i}", "res_spectral", "residual", "seen13", stats.pct(c))
        S.quantile_mask_cte(f"mx_t{i}_all", "risk_field", "risk", "valid", stats.clamped_pct(c))
        S.refined_cte(f"mx_t{i}", f"mx_t{i}_all")
        S.persistence_mask_cte(f"mx_p{i}", stats.clamped_pct(c))
        parts += [
            f"SELECT scene_id, 'spatial_residual' AS method, {S.lit(c)} AS contamination, r, c FROM mx_r{i} WHERE dthr IS NULL OR dbt >= dthr",
            f"SELECT scene_id, 'digital_twin', {S.lit(c)}, r, c FROM mx_t{i}",
            f"SELECT scene_id, 'combined_persistence', {S.lit(c)}, r, c FROM mx_p{i}",
        ]
    S.define("mx_all", " UNION ALL ".join(parts))
    S.define("mx_valid", "SELECT m.* FROM mx_all m JOIN day d USING (scene_id, r, c) WHERE d.valid")
    keys = "scene_id, method, contamination"
    S.units_cte("mx_units", "mx_valid", keys)
    S.define(
        "mx_every",
        "SELECT scene_id, method, contamination FROM scenes CROSS JOIN (VALUES ('spatial_residual'), ('digital_twin'), ('combined_persistence')) m(method) "
        f"CROSS JOIN {values('contamination', MATRIX_SHARES)}",
    )
    S.event_cte("mx_events", "mx_units", list(MATRIX_RADII), "mx_every", keys)
    S.define(
        "mx_flags",
        "SELECT e.*, d.valid, p.r IS NOT NULL AS pred, t.r IS NOT NULL AS truth FROM mx_every e JOIN day d USING (scene_id) "
        "LEFT JOIN mx_all p ON p.scene_id = e.scene_id AND p.method = e.method AND p.contamination = e.contamination AND p.r = d.r AND p.c = d.c "
        "LEFT JOIN truth1 t ON t.scene_id = e.scene_id AND t.r = d.r AND t.c = d.c",
    )
    S.confusion_cte("mx_grid", "mx_flags", keys)
    cols = S.EVENT_COLUMNS.replace("round(f1,", "round(e.f1,").replace("round(precision,", "round(e.precision,").replace("round(recall,", "round(e.recall,")
    return (
        f"SELECT e.scene_id, e.method, e.contamination, {cols}, round(g.f1, 6) AS grid_f1, CAST(g.tp + g.fp AS BIGINT) AS pred_cells "
        "FROM mx_events e JOIN mx_grid g ON g.scene_id = e.scene_id AND g.method = e.method AND g.contamination = e.contamination"
    )


@register("e11_comparison_matrix", matrix_sql())
def e11(spark, sf):
    rows = P.comparison_matrix(
        X.cube(spark, sf), X.hotspots(spark, sf), GRID, MATRIX_SHARES, MATRIX_RADII,
        ("spatial_residual", "digital_twin", "combined_persistence"),
    )
    return matrix_view(rows)


def matrix_view(rows: DataFrame) -> DataFrame:
    return event_view(rows.withColumn("grid_f1", F.round("grid_f1", 6)), "scene_id", "method", "contamination", "grid_f1", "pred_cells")


@register("e11b_comparison_matrix_all")
def e11b(spark, sf):
    return matrix_view(P.comparison_matrix(X.cube(spark, sf), X.hotspots(spark, sf), GRID))


# Hotspots lying in a cell of the second sensor count as seen.
S.define("det_cells", f"SELECT DISTINCT scene_id, {S.row_of('lat', False)} AS r, {S.col_of('lon', False)} AS c FROM detections WHERE {S.IN_BOX}")
S.define(
    "hotspots_held",
    f"SELECT h.* FROM (SELECT *, {S.row_of('lat', False)} AS r, {S.col_of('lon', False)} AS c FROM hotspots WHERE {S.IN_BOX}) h "
    "ANTI JOIN det_cells d USING (scene_id, r, c)",
)
S.event_cte("ec_held", "res_units", [20.0], "scenes", points="hotspots_held")


def held_out(spark: SparkSession, sf: str) -> DataFrame:
    seen = U.detection_mask(X.detections(spark, sf), GRID)
    return E.unseen_hotspots(E.place_points(X.hotspots(spark, sf), GRID, False), seen, KEY).drop("r", "c")


@register("e12_held_out", f"SELECT scene_id, {S.EVENT_COLUMNS} FROM ec_held")
def e12(spark, sf):
    mask = D.spatial_residual(X.day(spark, sf), GRID, 0.05)
    return event_view(E.event_metrics(mask, held_out(spark, sf), GRID, 20.0, scenes=scenes(spark, sf)), "scene_id")


# ================================================================ fusion

S.define(
    "sure_cells",
    f"SELECT DISTINCT scene_id, {S.row_of('lat', False)} AS r, {S.col_of('lon', False)} AS c FROM detections WHERE {S.IN_BOX} "
    "AND coalesce(confidence, 0e0) >= 60e0 AND CAST(ts AS DATE) = DATE '2024-01-15'",
)


@register("f1_detection_mask", mask_sql("sure_cells"))
def f1(spark, sf):
    return U.detection_mask(X.detections(spark, sf), GRID, "2024-01-15", 60.0)


GATE_KM = 25.0
S.dilate_cte("det_gate", "det_cells", S.gate_steps(GATE_KM))
S.define(
    "fusion_flags",
    "SELECT f.scene_id, f.r, f.c, f.valid, p.r IS NOT NULL AS pred, d.r IS NOT NULL AS detected, g.r IS NOT NULL AND f.valid AS gate, f.prob FROM risk_prob f "
    "LEFT JOIN warm p USING (scene_id, r, c) LEFT JOIN det_cells d USING (scene_id, r, c) LEFT JOIN det_gate g USING (scene_id, r, c)",
)
S.define(
    "fusion_scored",
    "SELECT *, (0.6e0 * CASE WHEN valid THEN greatest(0e0, least(1e0, prob)) ELSE 0e0 END + 0.4e0 * least(1e0, CAST(gate AS INT) + 0.5e0 * CAST(detected AS INT))) / 1e0 AS s, "
    "count(*) FILTER (pred) OVER (PARTITION BY scene_id) AS k FROM fusion_flags",
)
S.define("fusion_ranked", "SELECT *, rank() OVER (PARTITION BY scene_id ORDER BY s DESC) AS rk FROM fusion_scored")
FUSED_SQL = {
    "and": "pred AND gate AND valid",
    "or": "(pred OR gate) AND valid",
    "gated": "((pred AND gate) OR detected) AND valid",
    "weighted": "valid AND CASE WHEN k > 0 THEN rk <= k ELSE least(1e0, CAST(gate AS INT) + 0.5e0 * CAST(detected AS INT)) >= 0.5e0 END",
}


def fused(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    cells = risk_probability(spark, sf)
    return U.fuse(warm(spark, sf), X.detections(spark, sf), cells, GRID, U.FusionConfig(mode=mode, gate_km=GATE_KM))


for _n, _mode in (("f2_fusion_and", "and"), ("f3_fusion_or", "or"), ("f4_fusion_gated", "gated"), ("f5_fusion_weighted", "weighted")):
    register(_n, mask_sql(f"fusion_ranked WHERE {FUSED_SQL[_mode]}"))(
        lambda spark, sf, mode=_mode: U.fused_mask(fused(spark, sf, mode))
    )


@register("f6_fusion_result", f"SELECT scene_id, r, c, {FUSED_SQL['gated']} AS fused, detected, gate FROM fusion_flags")
def f6(spark, sf):
    return fused(spark, sf, "gated")


@register("f7_fusion_sweep")
def f7(spark, sf):
    prob = cut(risk_probability(spark, sf))
    rows = W.fusion_sweep(
        cut(warm(spark, sf)), X.detections(spark, sf), prob, X.hotspots(spark, sf), held_out(spark, sf), GRID,
    )
    return rounded(rows, "f1_full", "precision_full", "recall_full", "f1_holdout", "precision_holdout", "recall_holdout")


# ================================================================ day selection


def hotspot_days(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.to_date("o_orderdate").alias("day"))


def text_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


S.define("day_counts", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL")


@register("y1_daily_counts", "SELECT strftime(day, '%Y-%m-%d') AS day, n FROM day_counts")
def y1(spark, sf):
    return text_day(Y.daily_counts(hotspot_days(spark, sf)))


@register("y2_top_days", "SELECT strftime(day, '%Y-%m-%d') AS day, n FROM day_counts WHERE n >= 3 ORDER BY n DESC, day_counts.day LIMIT 30")
def y2(spark, sf):
    return text_day(Y.top_days(hotspot_days(spark, sf), 30, 3))


@register(
    "y3_days_by_month",
    "SELECT strftime(day, '%Y-%m-%d') AS day, n, CAST(month AS INT) AS month FROM (SELECT *, month(day) AS month, row_number() OVER (PARTITION BY month(day) ORDER BY n DESC, day) AS rn "
    "FROM day_counts WHERE n >= 3 AND month(day) IN (8, 9, 10, 11)) t WHERE rn <= 4",
)
def y3(spark, sf):
    return text_day(Y.days_by_month(hotspot_days(spark, sf), 4, 3, (8, 9, 10, 11)))


@register(
    "y4_dense_range",
    "SELECT strftime(day, '%Y-%m-%d') AS day, n FROM day_counts WHERE day BETWEEN DATE '1996-02-01' AND DATE '1996-05-31' AND n >= 3",
)
def y4(spark, sf):
    return text_day(Y.dense_range(hotspot_days(spark, sf), "1996-02-01", "1996-05-31", 3))


# ================================================================ sinks

RUN = {"hours_utc": [18, 16, 17], "truth_dilate_iters": 1, "twin_fusion": "prob_or"}


@register(
    "s13_metric_records",
    f"SELECT scene_id, {S.CONFUSION_COLUMNS}, '18,16,17' AS hours_utc, CAST(1 AS BIGINT) AS truth_dilate_iters, 'prob_or' AS twin_fusion FROM res_confusion",
)
def s13(spark, sf):
    path = scratch_path(spark, "metrics")
    sinks.write_metric_records(E.confusion(residual_flags(spark, sf)), RUN, path)
    back = spark.read.json(path).withColumn("hours_utc", F.array_join("hours_utc", ","))
    return confusion_view(back, "scene_id", "hours_utc", "truth_dilate_iters", "twin_fusion").withColumn("scene_id", F.col("scene_id").cast("int"))


@register(
    "s14_map_layers",
    "SELECT scene_id, 'hotspot' AS layer, CASE WHEN b.km <= 20e0 THEN 'TP' ELSE 'FN' END AS klass, '<b>Foco</b><br/>' || strftime(ts, '%Y-%m-%d %H:%M') || ' UTC<br/>lat=' || "
    "printf('%.4f', lat) || ', lon=' || printf('%.4f', lon) || '<br/>' || CASE WHEN b.km <= 20e0 THEN 'TP' ELSE 'FN' END AS popup FROM hotspots_in p LEFT JOIN spot_best b ON b.pid = p.pid "
    "UNION ALL SELECT scene_id, 'prediction', klass, '<b>Previsão</b><br/>lat=' || printf('%.4f', lat) || ', lon=' || printf('%.4f', lon) || '<br/>' || klass || ' (R=20.0 km)' "
    "FROM (SELECT u.scene_id, u.lat, u.lon, CASE WHEN min(x.km) <= 20e0 THEN 'TP' ELSE 'FP' END AS klass FROM res_units u LEFT JOIN ec_cell_pairs x USING (scene_id, unit) GROUP BY ALL) t",
)
def s14(spark, sf):
    mask = D.spatial_residual(X.day(spark, sf), GRID, 0.05)
    return sinks.map_points(mask, X.hotspots(spark, sf), GRID, 20.0).select("scene_id", "layer", "klass", "popup")


@register(
    "s14b_map_index",
    "SELECT scene_id, 'scene_id=' || CAST(scene_id AS VARCHAR) AS href, count(*) AS n_points FROM (SELECT scene_id FROM hotspots_in UNION ALL SELECT scene_id FROM res_units) t GROUP BY ALL",
)
def s14b(spark, sf):
    mask = D.spatial_residual(X.day(spark, sf), GRID, 0.05)
    path = scratch_path(spark, "map")
    sinks.write_map(sinks.map_points(mask, X.hotspots(spark, sf), GRID, 20.0), path)
    back = spark.read.text(path)
    return sinks.map_index(back).withColumn("scene_id", F.col("scene_id").cast("int"))


# ================================================================ streaming


@register(
    "w1_hourly_stream_bins",
    f"SELECT scene_id, strftime(hour_start, '%Y-%m-%d %H:%M') AS hour_start, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(avg(bt), 6) AS bt13, count(*) AS n FROM ("
    f"SELECT scene_id, date_trunc('hour', ts) AS hour_start, {S.row_of('lat')} AS r, {S.col_of('lon')} AS c, 200e0 + least(value, 120e0) AS bt FROM points) t "
    "WHERE r IS NOT NULL AND c IS NOT NULL AND hour_start < (SELECT date_trunc('hour', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY ALL",
)
def w1(spark, sf):
    """Append mode: an hour is written once the watermark (latest event minus one hour) closes it."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events.createOrReplaceTempView("events_stream")
    rows = spark.sql(X.POINTS.replace("FROM events", "FROM events_stream"))
    stream = rows.select(
        F.col("ts").cast("timestamp").alias("ts"), "scene_id", "lat", "lon", F.lit(13).alias("channel"),
        (200.0 + F.least(F.col("value"), F.lit(120.0))).alias("bt"), F.lit(0).alias("dqf"),
    )
    base = scratch_path(spark, "hourly")
    ST.run_to_parquet(ST.hourly_cells(stream, GRID), f"{base}/out", f"{base}/ckpt")
    back = spark.read.parquet(f"{base}/out")
    return back.select(
        "scene_id", F.date_format("hour_start", "yyyy-MM-dd HH:mm").alias("hour_start"), "r", "c", F.round("bt13", 6).alias("bt13"), "n"
    )


def streamed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cube as a stream of hourly files, in assimilation order."""
    path = scratch_path(spark, "cube")
    cube = cut(X.cube(spark, sf))
    for seq in range(X.HOURS):
        cube.where(F.col("hour_seq") == seq).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(cube.schema).option("maxFilesPerTrigger", 1).parquet(path)


@register("w2_scored_hours", f"SELECT scene_id, hour, r, c, round(score, 6) AS score, score_valid FROM {S.score_ctes()}")
def w2(spark, sf):
    base = scratch_path(spark, "scores")
    query = ST.score_closed_hours(streamed_cells(spark, sf), GRID, f"{base}/out", f"{base}/ckpt")
    query.awaitTermination()
    back = spark.read.parquet(f"{base}/out")
    return rounded(back.select("scene_id", "hour", "r", "c", "score", "score_valid"), "score")


@register("w3_risk_state", "SELECT scene_id, r, c, round(risk, 6) AS risk, CAST(3 AS BIGINT) AS hours_seen FROM risk_prob_or")
def w3(spark, sf):
    scored = T.hourly_anomaly_score(X.cube(spark, sf), GRID).select("scene_id", "hour_seq", "r", "c", "score", "score_valid")
    path = scratch_path(spark, "scored")
    # The scenes are replayed side by side, as hours of one day.
    scored = cut(scored.withColumn("ts", F.timestamp_seconds(F.lit(8.0e8) + F.col("hour_seq") * 3600)))
    for seq in range(X.HOURS):
        scored.where(F.col("hour_seq") == seq).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(path)
    base = scratch_path(spark, "risk")
    ST.run_to_parquet(ST.risk_states(stream, ts="ts"), f"{base}/out", f"{base}/ckpt")
    return rounded(ST.latest_risk(spark.read.parquet(f"{base}/out")), "risk")


# ================================================================ embeddings as features

S.define(
    "vectors",
    "SELECT CAST(label AS INT) AS scene_id, CAST(vec_id AS INT) AS r, 0 AS c, "
    + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS v{i}" for i in range(1, 65)) + " FROM embeddings",
)
S.lof_cte("vector_lof", "vectors", [f"v{i}" for i in range(1, 65)], 10)


@register("m9e_lof_on_embeddings", "SELECT scene_id, r, round(lof, 6) AS lof FROM vector_lof")
def m9e(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("label").cast("int").alias("scene_id"), F.col("vec_id").cast("int").alias("r"), F.lit(0).alias("c"),
        *[F.element_at("embedding", i).cast("double").alias(f"v{i}") for i in range(1, 65)],
    )
    cols = [f"v{i}" for i in range(1, 65)]
    return rounded(O.local_outlier_factor(rows, cols, 10).select("scene_id", "r", "lof"), "lof")
