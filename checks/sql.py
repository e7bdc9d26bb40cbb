"""Reference SQL, assembled from named common table expressions.

``query(final)`` pulls in the expressions the final SELECT needs.  The text runs on DuckDB and
uses another formulation than the Spark code wherever there is one: offset joins instead of
windows and tiles, plain pair comparison instead of bucketed joins, recursion instead of label
propagation.
"""

from __future__ import annotations

import math
import re

from checks import fixtures as X
from firegrid.operators.detectors import PersistenceConfig
from firegrid.operators.neighborhood import gaussian_weights
from firegrid.schema import KM_PER_DEG

H, W = X.GRID.h, X.GRID.w
CTES: dict[str, str] = {}


def lit(x: float) -> str:
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def define(name: str, body: str) -> str:
    CTES.setdefault(name, body)
    return name


def query(final: str) -> str:
    needed: set[str] = set()

    def visit(text: str, own: str = "") -> None:
        for word in set(re.findall(r"\b[a-z_][a-z0-9_]*\b", text)):
            if word in CTES and word != own and word not in needed:
                needed.add(word)
                visit(CTES[word], word)

    visit(final)
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for word in sorted(set(re.findall(r"\b[a-z_][a-z0-9_]*\b", CTES[name]))):
            if word in needed and word != name:
                place(word)
        order.append(name)

    for name in sorted(needed):
        place(name)
    if not order:
        return final.strip()
    parts = []
    for name in order:
        recursive = re.search(rf"\b(?:FROM|JOIN) {name}\b", CTES[name]) is not None
        head = name if recursive else f"{name} AS MATERIALIZED"
        parts.append(f"{head} AS ({CTES[name]})" if recursive else f"{head} ({CTES[name]})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final.strip()


def clip(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def edge(i: str, lo: float, hi: float, n: int) -> str:
    return f"(CASE WHEN {i} >= {n} THEN {lit(hi)} ELSE {lit(lo)} + ({i}) * {lit((hi - lo) / n)} END)"


def axis(v: str, lo: float, hi: float, n: int, closed: bool = True) -> str:
    i = f"CAST(floor(({v} - {lit(lo)}) / {lit((hi - lo) / n)}) AS INT)"
    top = str(n - 1) if closed else "NULL"
    return (
        f"(CASE WHEN {v} = {lit(hi)} THEN {top} WHEN {v} >= {lit(lo)} AND {v} < {lit(hi)} THEN "
        f"{i} - CASE WHEN {v} < {edge(i, lo, hi, n)} THEN 1 ELSE 0 END "
        f"+ CASE WHEN {v} >= {edge(i + ' + 1', lo, hi, n)} THEN 1 ELSE 0 END END)"
    )


def row_of(v: str, closed: bool = True) -> str:
    return axis(v, X.GRID.min_lat, X.GRID.max_lat, H, closed)


def col_of(v: str, closed: bool = True) -> str:
    return axis(v, X.GRID.min_lon, X.GRID.max_lon, W, closed)


def clat(r: str) -> str:
    g = X.GRID
    return f"(0.5e0 * ({edge(r, g.min_lat, g.max_lat, H)} + {edge(r + ' + 1', g.min_lat, g.max_lat, H)}))"


def clon(c: str) -> str:
    g = X.GRID
    return f"(0.5e0 * ({edge(c, g.min_lon, g.max_lon, W)} + {edge(c + ' + 1', g.min_lon, g.max_lon, W)}))"


IN_BOX = (
    f"lat BETWEEN {lit(X.GRID.min_lat)} AND {lit(X.GRID.max_lat)} "
    f"AND lon BETWEEN {lit(X.GRID.min_lon)} AND {lit(X.GRID.max_lon)}"
)

# ---------------------------------------------------------------- fixtures

define("wide_pixels", X.WIDE_PIXELS)
define("points", X.POINTS)
define("fires", X.FIRES)
define("hotspots", X.HOTSPOTS)
define("detections", X.DETECTIONS)
define(
    "pixels",
    " UNION ALL ".join(
        f"SELECT scene_id, hour, hour_seq, lat, lon, dqf, {ch} AS channel, bt{ch} AS bt FROM wide_pixels"
        for ch in (7, 13, 14)
    ),
)
define("good_pixels", "SELECT * FROM pixels WHERE bt BETWEEN 180 AND 330 AND dqf = 0")
define(
    "placed_pixels",
    f"SELECT * FROM (SELECT *, {row_of('lat')} AS r, {col_of('lon')} AS c FROM good_pixels) t "
    "WHERE r IS NOT NULL AND c IS NOT NULL",
)
define(
    "binned",
    "SELECT scene_id, hour, hour_seq, channel, r, c, avg(bt) AS bt, count(*) AS n FROM placed_pixels GROUP BY ALL",
)
define("layers", "SELECT DISTINCT scene_id, hour, hour_seq FROM wide_pixels")
define(
    "all_cells",
    f"SELECT CAST(a.i AS INT) AS r, CAST(b.i AS INT) AS c FROM generate_series(0, {H - 1}) a(i), "
    f"generate_series(0, {W - 1}) b(i)",
)
define(
    "pivoted",
    "SELECT scene_id, hour, hour_seq, r, c, "
    + ", ".join(f"max(bt) FILTER (channel = {ch}) AS bt{ch}" for ch in (7, 13, 14))
    + " FROM binned GROUP BY ALL",
)
define(
    "cube",
    "SELECT l.scene_id, l.hour, l.hour_seq, a.r, a.c, round(p.bt7, 6) AS bt7, round(p.bt13, 6) AS bt13, "
    "round(p.bt14, 6) AS bt14 FROM layers l CROSS JOIN all_cells a "
    "LEFT JOIN pivoted p ON p.scene_id = l.scene_id AND p.hour = l.hour AND p.r = a.r AND p.c = a.c",
)
PRESENT = "(bt7 IS NOT NULL AND bt13 IS NOT NULL AND bt14 IS NOT NULL)"
define(
    "day",
    "SELECT scene_id, r, c, max(bt7) AS bt7, max(bt13) AS bt13, max(bt14) AS bt14, "
    f"bool_and({PRESENT}) AS valid FROM cube GROUP BY ALL",
)


# ---------------------------------------------------------------- neighbourhoods


def near_cte(name: str, src: str, h: int, keys: tuple[str, ...]) -> str:
    """Every cell with the clamped positions of its (2h+1) x (2h+1) neighbourhood."""
    ks = ", ".join(f"a.{x}" for x in keys)
    return define(
        name,
        f"SELECT {ks}, a.r, a.c, greatest(0, least({H - 1}, a.r + di.i)) AS rr, greatest(0, least({W - 1}, a.c + dj.j)) AS cc "
        f"FROM {src} a CROSS JOIN generate_series(-{h}, {h}) di(i) CROSS JOIN generate_series(-{h}, {h}) dj(j)",
    )


def median_cte(name: str, src: str, value: str, k: int, keys: tuple[str, ...]) -> str:
    """k x k median with clamped offsets."""
    near = near_cte(name + "_near", src, k // 2, keys)
    on = " AND ".join(f"n.{x} = b.{x}" for x in keys)
    ks = ", ".join(f"n.{x}" for x in keys)
    return define(
        name,
        f"SELECT {ks}, n.r, n.c, median(b.{value}) AS med FROM {near} n JOIN {src} b ON {on} AND b.r = n.rr AND b.c = n.cc GROUP BY ALL",
    )


def line_cte(name: str, src: str, value: str, weights: list[float], along: str) -> str:
    """One pass of a weighted sum along r or c with clamped offsets."""
    rad = len(weights) // 2
    table = ", ".join(f"({i - rad}, {lit(w)})" for i, w in enumerate(weights))
    other = "c" if along == "r" else "r"
    top = H - 1 if along == "r" else W - 1
    define(
        name + "_near",
        f"SELECT a.scene_id, a.r, a.c, w.w, greatest(0, least({top}, a.{along} + w.d)) AS at FROM {src} a "
        f"CROSS JOIN (VALUES {table}) w(d, w)",
    )
    return define(
        name,
        f"SELECT n.scene_id, n.r, n.c, sum(n.w * b.{value}) AS {value} FROM {name}_near n JOIN {src} b "
        f"ON n.scene_id = b.scene_id AND n.{other} = b.{other} AND b.{along} = n.at GROUP BY ALL",
    )


def smooth_cte(name: str, src: str, value: str, sigma: float) -> str:
    ws = gaussian_weights(sigma)
    line_cte(name + "_half", src, value, ws, "r")
    return line_cte(name, name + "_half", value, ws, "c")


def box_mean_cte(name: str, src: str, value: str, size: int = 5) -> str:
    near = near_cte(name + "_near", src, size // 2, ("scene_id",))
    return define(
        name,
        f"SELECT n.scene_id, n.r, n.c, avg(b.{value}) AS {value} FROM {near} n JOIN {src} b "
        "ON n.scene_id = b.scene_id AND b.r = n.rr AND b.c = n.cc GROUP BY ALL",
    )


def local_max_cte(name: str, src: str, value: str, rad: int) -> str:
    near = near_cte(name + "_near", src, rad, ("scene_id",))
    return define(
        name,
        f"SELECT n.scene_id, n.r, n.c, max(b.{value}) AS top FROM {near} n JOIN {src} b "
        "ON n.scene_id = b.scene_id AND b.r = n.rr AND b.c = n.cc GROUP BY ALL",
    )


def dilate_cte(name: str, src: str, n: int, keys: str = "scene_id") -> str:
    ks = ", ".join(f"m.{k.strip()}" for k in keys.split(","))
    return define(
        name,
        f"SELECT DISTINCT {ks}, a.r, a.c FROM {src} m JOIN all_cells a ON abs(a.r - m.r) <= {n} AND abs(a.c - m.c) <= {n}",
    )


def opening_cte(name: str, src: str, shape: str, key: str = "scene_id") -> str:
    near = "abs(b.r - a.r) + abs(b.c - a.c) <= 1" if shape == "cross" else "abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1"
    need = 5 if shape == "cross" else 9
    define(
        name + "_core",
        f"SELECT a.{key}, a.r, a.c FROM {src} a JOIN {src} b ON a.{key} = b.{key} AND {near} "
        f"GROUP BY a.{key}, a.r, a.c HAVING count(*) = {need}",
    )
    return define(
        name, f"SELECT DISTINCT a.{key}, b.r, b.c FROM {name}_core a JOIN all_cells b ON {near}"
    )


def label_cte(name: str, src: str, conn: int, key: str = "scene_id") -> str:
    near = "abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1" if conn == 2 else "abs(b.r - a.r) + abs(b.c - a.c) <= 1"
    define(
        name + "_walk",
        f"SELECT {key}, r, c, CAST(r * {W} + c AS BIGINT) AS seed FROM {src} UNION "
        f"SELECT b.{key}, b.r, b.c, a.seed FROM {name}_walk a JOIN {src} b ON a.{key} = b.{key} AND {near} "
        f"AND b.r * {W} + b.c > a.seed",
    )
    return define(
        name, f"SELECT {key}, r, c, min(seed) AS label FROM {name}_walk GROUP BY ALL"
    )


def sized_cte(name: str, src: str, lo: int, hi: int, conn: int = 1, key: str = "scene_id") -> str:
    lab = label_cte(name + "_lab", src, conn, key)
    cap = f" AND n <= {hi}" if hi > 0 else ""
    return define(
        name,
        f"SELECT {key}, r, c FROM (SELECT *, count(*) OVER (PARTITION BY {key}, label) AS n FROM {lab}) t WHERE n >= {lo}{cap}",
    )


def quantile_mask_cte(name: str, src: str, value: str, pool: str, q: float, keys: str = "scene_id") -> str:
    return define(
        name,
        f"SELECT * EXCLUDE (thr) FROM (SELECT *, quantile_cont({value}, {lit(q)}) FILTER ({pool}) "
        f"OVER (PARTITION BY {keys}) AS thr FROM {src}) t WHERE {pool} AND {value} >= thr",
    )


def unit_expr(value: str, pool: str, lo: float, hi: float, keys: str) -> str:
    """Robust unit scaling as a window expression."""
    w = f"OVER (PARTITION BY {keys})"
    a = f"quantile_cont({value}, {lit(lo)}) FILTER ({pool}) {w}"
    b = f"quantile_cont({value}, {lit(hi)}) FILTER ({pool}) {w}"
    return f"(CASE WHEN {a} IS NULL OR {value} IS NULL THEN 0e0 ELSE {clip(f'({value} - {a}) / ({b} - {a} + 1e-9)')} END)"


# ---------------------------------------------------------------- event metrics


def units_cte(name: str, mask: str, keys: str = "scene_id") -> str:
    return define(
        name,
        f"SELECT {keys}, CAST(r * {W} + c AS BIGINT) AS unit, {clat('r')} AS lat, {clon('c')} AS lon, "
        f"CAST(1 AS BIGINT) AS size FROM {mask}",
    )


def centroid_cte(name: str, mask: str, conn: int = 2) -> str:
    lab = label_cte(name + "_lab", mask, conn)
    return define(
        name,
        f"SELECT scene_id, label AS unit, avg({clat('r')}) AS lat, avg({clon('c')}) AS lon, count(*) AS size "
        f"FROM {lab} GROUP BY ALL",
    )


def event_cte(
    name: str, units: str, radii: list[float], every: str, keys: str = "scene_id", points: str = "hotspots"
) -> str:
    """Event metrics by plain pair comparison; ``every`` lists the key rows wanted."""
    ks = [k.strip() for k in keys.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    sel = lambda a: ", ".join(f"{a}.{k}" for k in ks)
    pts = define(
        f"{points}_in",
        f"SELECT *, row_number() OVER (ORDER BY event_id) AS pid FROM {points} WHERE {IN_BOX}",
    )
    us = define(
        f"{name}_us",
        f"SELECT {keys}, count(*) AS n_components, median(size) AS med_size, max(size) AS max_size, avg(lat) AS mlat "
        f"FROM {units} GROUP BY ALL",
    )
    ps = define(f"{points}_stat", f"SELECT scene_id, count(*) AS n_focos, avg(lat) AS plat FROM {pts} GROUP BY ALL")
    pairs = define(
        f"{name}_pairs",
        f"SELECT {sel('u')}, u.unit, p.pid, sqrt(power((p.lat - u.lat) * {lit(KM_PER_DEG)}, 2) + "
        f"power((p.lon - u.lon) * {lit(KM_PER_DEG)} * cos(radians(0.5e0 * (s.mlat + q.plat))), 2)) AS km "
        f"FROM {units} u JOIN {us} s ON {same('u', 's')} JOIN {ps} q ON q.scene_id = u.scene_id "
        f"JOIN {pts} p ON p.scene_id = u.scene_id",
    )
    rad = ", ".join(f"({lit(r)})" for r in radii)
    rows = define(
        f"{name}_rows",
        f"SELECT {sel('e')}, x.radius_km, coalesce(q.n_focos, 0) AS n_focos, coalesce(s.n_components, 0) AS n_components, "
        "coalesce(h.tpr, 0) AS tp_recall, coalesce(h.tpp, 0) AS tp_precision, "
        "coalesce(s.med_size, 0e0) AS component_size_median, coalesce(s.max_size, 0) AS component_size_max "
        f"FROM {every} e CROSS JOIN (VALUES {rad}) x(radius_km) "
        f"LEFT JOIN {us} s ON {same('e', 's')} LEFT JOIN {ps} q ON q.scene_id = e.scene_id "
        f"LEFT JOIN (SELECT {keys}, radius_km, count(DISTINCT pid) AS tpr, count(DISTINCT unit) AS tpp FROM {pairs} "
        f"JOIN (VALUES {rad}) y(radius_km) ON km <= y.radius_km GROUP BY ALL) h "
        f"ON {same('e', 'h')} AND h.radius_km = x.radius_km",
    )
    define(
        f"{name}_rates",
        "SELECT *, n_focos - tp_recall AS fn_focos, n_components - tp_precision AS fp_components, "
        "CASE WHEN n_components > 0 THEN tp_precision / CAST(n_components AS DOUBLE) ELSE 0e0 END AS precision, "
        f"CASE WHEN n_focos > 0 THEN tp_recall / CAST(n_focos AS DOUBLE) ELSE 0e0 END AS recall FROM {rows}",
    )
    return define(
        name,
        "SELECT *, CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 "
        f"FROM {name}_rates",
    )


EVENT_COLUMNS = (
    "radius_km, CAST(n_focos AS BIGINT) AS n_focos, CAST(n_components AS BIGINT) AS n_components, "
    "CAST(tp_recall AS BIGINT) AS tp_recall, CAST(tp_precision AS BIGINT) AS tp_precision, "
    "CAST(fn_focos AS BIGINT) AS fn_focos, CAST(fp_components AS BIGINT) AS fp_components, "
    "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
    "round(component_size_median, 6) AS component_size_median, CAST(component_size_max AS BIGINT) AS component_size_max"
)


def confusion_cte(name: str, flags: str, keys: str = "scene_id") -> str:
    """Cell confusion of a dense (keys, valid, pred, truth) table."""
    define(
        name + "_n",
        f"SELECT {keys}, count(*) FILTER (valid AND pred AND truth) AS tp, count(*) FILTER (valid AND pred AND NOT truth) AS fp, "
        "count(*) FILTER (valid AND NOT pred AND truth) AS fn, count(*) FILTER (valid AND NOT pred AND NOT truth) AS tn, "
        f"count(*) FILTER (valid) AS valid_cells FROM {flags} GROUP BY ALL",
    )
    define(
        name + "_r",
        "SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0e0 END AS precision, "
        f"CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0e0 END AS recall FROM {name}_n",
    )
    return define(
        name,
        "SELECT *, CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END AS f1, "
        "CASE WHEN tp + fp + fn > 0 THEN tp / CAST(tp + fp + fn AS DOUBLE) ELSE 0e0 END AS iou, "
        "CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) ELSE 0e0 END AS accuracy "
        f"FROM {name}_r",
    )


CONFUSION_COLUMNS = (
    "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, "
    "CAST(valid_cells AS BIGINT) AS valid_cells, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(f1, 6) AS f1, round(iou, 6) AS iou, round(accuracy, 6) AS accuracy"
)


# ---------------------------------------------------------------- shared derived tables

define("scenes", "SELECT DISTINCT scene_id FROM layers")
define(
    "day_filled",
    "SELECT *, coalesce(bt13, median(bt13) OVER (PARTITION BY scene_id)) AS f13, "
    "coalesce(bt7, median(bt7) OVER (PARTITION BY scene_id)) AS f7, "
    "coalesce(bt14, median(bt14) OVER (PARTITION BY scene_id)) AS f14, bt13 IS NOT NULL AND bt13 > 0 AS seen13 FROM day",
)
median_cte("day_med9", "day_filled", "f13", 9, ("scene_id",))
define(
    "residuals",
    "SELECT d.*, m.med AS background, d.f13 - m.med AS residual FROM day_filled d JOIN day_med9 m USING (scene_id, r, c)",
)
# A crowded mask for the morphological operators: the warmest 30 percent of each scene.
quantile_mask_cte("warm", "day", "bt13", "bt13 IS NOT NULL", 0.7)
define("truth_raw", f"SELECT DISTINCT scene_id, {row_of('lat')} AS r, {col_of('lon')} AS c FROM hotspots WHERE {IN_BOX}")
dilate_cte("truth1", "truth_raw", 1)


def score_ctes(sizes: tuple[int, ...] = (5, 9, 15)) -> str:
    """Hourly score; returns the name of the table with score and score_valid."""
    lay = "scene_id, hour"
    define(
        "hour_marked",
        "SELECT *, bt13 IS NOT NULL AND bt13 > 0 AS v13, bt7 - bt14 AS dbt, "
        f"count(bt7) OVER (PARTITION BY {lay}) > 0 AND count(bt14) OVER (PARTITION BY {lay}) > 0 AS both_bands, "
        f"coalesce(bt13, median(bt13) OVER (PARTITION BY {lay})) AS f13 FROM cube",
    )
    define("hour_valid", "SELECT *, both_bands AND v13 AND dbt IS NOT NULL AS vbtd FROM hour_marked")
    define(
        "hour_base",
        "SELECT *, greatest(0e0, dbt - coalesce(quantile_cont(dbt, 0.55e0) FILTER (vbtd) "
        f"OVER (PARTITION BY {lay}), 0e0)) AS dpos FROM hour_valid",
    )
    tag = "_".join(map(str, sizes))
    for k in sizes:
        median_cte(f"hour_med{k}", "hour_marked", "f13", k, ("scene_id", "hour"))
    define(
        f"hour_res_{tag}",
        "SELECT b.*, " + ", ".join(f"greatest(0e0, b.f13 - m{k}.med) AS res{k}" for k in sizes)
        + " FROM hour_base b "
        + " ".join(f"JOIN hour_med{k} m{k} USING (scene_id, hour, r, c)" for k in sizes),
    )
    units = ", ".join(f"{unit_expr(f'res{k}', 'v13', 0.03, 0.97, lay)} AS u{k}" for k in sizes)
    define(
        f"hour_units_{tag}",
        f"SELECT *, {units}, CASE WHEN dbt IS NULL THEN 0e0 ELSE {unit_expr('dpos', 'vbtd', 0.03, 0.97, lay)} END AS ubtd "
        f"FROM hour_res_{tag}",
    )
    mean = "(" + " + ".join(f"u{k}" for k in sizes) + f") / {lit(len(sizes))}"
    return define(
        f"scored_{tag}",
        "SELECT scene_id, hour, hour_seq, r, c, bt7, bt13, bt14, "
        f"{clip(f'CASE WHEN vbtd THEN ({mean} + 0.55e0 * ubtd) / 1.55e0 ELSE {mean} END')} AS score, "
        f"CASE WHEN both_bands THEN vbtd ELSE v13 END AS score_valid FROM hour_units_{tag}",
    )


def risk_ctes(mode: str = "prob_or", p: float = 0.5) -> str:
    """Three assimilation steps written out."""
    scored = score_ctes()

    def step(prev: str, i: int) -> str:
        new = (
            f"greatest({prev} * {lit(p)}, s{i})" if mode == "max_persist"
            else f"1e0 - (1e0 - {prev} * {lit(p)}) * (1e0 - s{i})"
        )
        return f"(CASE WHEN v{i} THEN {new} ELSE {prev} END)"

    define(
        "obs",
        "SELECT scene_id, r, c, " + ", ".join(
            f"max(score) FILTER (hour_seq = {i}) AS s{i}, bool_or(score_valid) FILTER (hour_seq = {i}) AS v{i}" for i in range(3)
        ) + f", bool_and({PRESENT}) AS valid FROM {scored} GROUP BY ALL",
    )
    define(f"risk1_{mode}", f"SELECT *, {step('0e0', 0)} AS k1 FROM obs")
    define(f"risk2_{mode}", f"SELECT *, {step('k1', 1)} AS k2 FROM risk1_{mode}")
    return define(f"risk_{mode}", f"SELECT scene_id, r, c, valid, {step('k2', 2)} AS risk FROM risk2_{mode}")


def field_ctes() -> str:
    """Smoothed risk joined with validity."""
    risk = risk_ctes()
    smooth_cte("risk_smooth", risk, "risk", 1.2)
    return define(
        "risk_field",
        f"SELECT a.scene_id, a.r, a.c, a.valid, a.risk AS raw_risk, s.risk AS risk FROM {risk} a JOIN risk_smooth s USING (scene_id, r, c)",
    )


def lof_cte(name: str, src: str, columns: list[str], k: int) -> str:
    """Local outlier factor by comparing every pair of a scene."""
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in columns)
    define(
        name + "_nn",
        f"SELECT * FROM (SELECT a.scene_id, a.r, a.c, b.r AS nr, b.c AS nc, sqrt({d2}) AS dist, row_number() OVER "
        f"(PARTITION BY a.scene_id, a.r, a.c ORDER BY sqrt({d2}), b.r, b.c) AS rn FROM {src} a JOIN {src} b "
        f"ON a.scene_id = b.scene_id AND (a.r <> b.r OR a.c <> b.c)) t WHERE rn <= {k}",
    )
    define(name + "_kd", f"SELECT scene_id, r, c, max(dist) AS kd FROM {name}_nn GROUP BY ALL")
    define(
        name + "_lrd",
        f"SELECT n.scene_id, n.r, n.c, 1e0 / (avg(greatest(n.dist, k.kd)) + 1e-10) AS lrd FROM {name}_nn n JOIN {name}_kd k "
        "ON k.scene_id = n.scene_id AND k.r = n.nr AND k.c = n.nc GROUP BY ALL",
    )
    define(
        name + "_lof",
        f"SELECT n.scene_id, n.r, n.c, avg(l.lrd) AS mean_lrd FROM {name}_nn n JOIN {name}_lrd l "
        "ON l.scene_id = n.scene_id AND l.r = n.nr AND l.c = n.nc GROUP BY ALL",
    )
    return define(
        name,
        f"SELECT s.*, m.mean_lrd / l.lrd AS lof FROM {src} s JOIN {name}_lof m USING (scene_id, r, c) "
        f"JOIN {name}_lrd l USING (scene_id, r, c)",
    )


def forest_cte(name: str, src: str, columns: list[str], trees: int, seed: int = 42, depth: int = 8) -> str:
    """Isolation scores: trees grown and walked by one join a level."""
    xs = ", ".join(f"x{i}" for i in range(len(columns)))

    def state(h: str, v: str) -> str:
        t = f"(({h} * 48271 + {v}) % 2147483647)"
        return f"(({t} * {t} + 12345) % 2147483647)"

    def draw(dest: str, rel: str, x: str, cols: str) -> str:
        """``rel`` with the draw for (seed, tree, x) as ``dest``, one state a step."""
        one = f"SELECT *, {state(str(seed), 'tree * 69621 + 1')} AS h1 FROM {rel}"
        two = f"SELECT *, {state('h1', x)} AS h2 FROM ({one}) d1"
        return f"SELECT {cols}, {state('h2', '7')} AS {dest} FROM ({two}) d2"

    own = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(columns))
    first = f"SELECT scene_id, r, c, {own}, {state('0', 'CAST(r AS BIGINT) + 1')} AS h, count(*) OVER (PARTITION BY scene_id) AS n FROM {src}"
    define(f"{name}_pool", f"SELECT scene_id, r, c, {xs}, n, least(n, 256) AS sample, {state('h', 'CAST(c AS BIGINT) + 1')} AS cell FROM ({first}) p")
    spread = f"(SELECT p.*, CAST(t.tree AS BIGINT) AS tree FROM {name}_pool p CROSS JOIN range({trees}) t(tree))"
    define(
        f"{name}_rows0",
        f"SELECT scene_id, tree, sample, {xs}, CAST(1 AS BIGINT) AS node FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, tree ORDER BY u, r, c) AS k "
        f"FROM ({draw('u', spread + ' s', 'cell', f'scene_id, r, c, tree, n, sample, {xs}')}) u WHERE u * n < 1099511627264) v WHERE k <= 256",
    )

    def mean_path(n: str) -> str:
        return f"(CASE WHEN {n} <= 1 THEN 0e0 WHEN {n} = 2 THEN 1e0 ELSE 2e0 * (ln({n} - 1e0) + 0.5772156649015329e0) - 2e0 * ({n} - 1e0) / {n} END)"

    define(f"{name}_walk0", f"SELECT scene_id, r, c, sample, {xs}, tree, CAST(1 AS BIGINT) AS node FROM {spread} s")
    for d in range(depth + 1):
        ends = ", ".join(f"min(x{i}) AS lo{i}, max(x{i}) AS hi{i}" for i in range(len(columns)))
        define(f"{name}_stat{d}", f"SELECT scene_id, tree, node, sample, count(*) AS n, {ends} FROM {name}_rows{d} GROUP BY ALL")
        varying = " UNION ALL ".join(
            f"SELECT scene_id, tree, node, {i} AS f, lo{i} AS lo, hi{i} AS hi FROM {name}_stat{d} WHERE n > 1 AND hi{i} > lo{i} AND sample > {1 << d}"
            for i in range(len(columns))
        )
        counted = (
            "SELECT *, row_number() OVER (PARTITION BY scene_id, tree, node ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY scene_id, tree, node) AS k "
            f"FROM ({varying}) a"
        )
        picked = draw("pick", f"({counted}) b", "node * 2", "scene_id, tree, node, f, lo, hi, i, k")
        shared = draw("share", f"({picked}) e", "node * 2 + 1", "scene_id, tree, node, f, lo, hi, i, k, pick")
        define(
            f"{name}_split{d}",
            "SELECT scene_id, tree, node, f, CASE WHEN lo + share / 2147483647e0 * (hi - lo) < hi THEN lo + share / 2147483647e0 * (hi - lo) ELSE lo END AS at "
            f"FROM ({shared}) g WHERE i = pick % k",
        )
        define(
            f"{name}_leaf{d}",
            f"SELECT scene_id, tree, node, {d} * 1048576 + CAST(round({mean_path('n')} * 1048576e0) AS BIGINT) AS units FROM {name}_stat{d} ANTI JOIN {name}_split{d} USING (scene_id, tree, node)",
        )
        if d < depth:
            value = "CASE s.f " + " ".join(f"WHEN {i} THEN x{i}" for i in range(len(columns))) + " END"
            step = f"node * 2 + CASE WHEN {value} > s.at THEN 1 ELSE 0 END AS node"
            joined = f"JOIN {name}_split{d} s USING (scene_id, tree, node)"
            define(f"{name}_rows{d + 1}", f"SELECT scene_id, tree, sample, {xs}, {step} FROM {name}_rows{d} {joined}")
            define(f"{name}_walk{d + 1}", f"SELECT scene_id, r, c, sample, {xs}, tree, {step} FROM {name}_walk{d} {joined}")
    ends = " UNION ALL ".join(
        f"SELECT scene_id, r, c, sample, units FROM {name}_walk{d} JOIN {name}_leaf{d} USING (scene_id, tree, node)" for d in range(depth + 1)
    )
    return define(
        name,
        f"SELECT scene_id, r, c, pow(2e0, -(sum(units) / 1048576e0) / ({trees} * greatest({mean_path('sample')}, 1e-12))) AS iso_score FROM ({ends}) w GROUP BY scene_id, r, c, sample",
    )


def outside_cte(name: str, src: str, score: str, share: float) -> str:
    """Rows beyond the percentile of ``score`` that leaves ``share`` outside, per scene."""
    return define(
        name,
        f"SELECT scene_id, r, c FROM (SELECT *, quantile_cont(-{score}, {lit(share)}) OVER (PARTITION BY scene_id) AS cutoff FROM {src}) t WHERE -{score} < cutoff",
    )


def refined_cte(name: str, mask: str) -> str:
    """Mask minus weak inliers of the risk field."""
    field = field_ctes()
    box_mean_cte("risk_around", field, "risk", 5)
    define(
        "lof_pool",
        f"SELECT f.scene_id, f.r, f.c, f.risk, a.risk AS around, quantile_cont(f.risk, 0.72e0) OVER (PARTITION BY f.scene_id) AS soft, "
        f"count(*) OVER (PARTITION BY f.scene_id) AS n FROM {field} f JOIN risk_around a USING (scene_id, r, c) WHERE f.valid",
    )
    define("lof_rows", "SELECT * FROM lof_pool WHERE n >= 39")
    lof_cte("risk_lof", "lof_rows", ["risk", "around"], 24)
    define("weak_cells", "SELECT scene_id, r, c FROM risk_lof WHERE lof <= 1.5e0 AND risk < soft")
    return define(name, f"SELECT m.* FROM {mask} m ANTI JOIN weak_cells w USING (scene_id, r, c)")


def feature_ctes() -> str:
    """Six classifier features."""
    scored = score_ctes()
    field = field_ctes()
    define(
        "p70",
        "SELECT c.scene_id, c.hour, quantile_cont(c.bt13, 0.7e0) AS thr FROM cube c JOIN day d USING (scene_id, r, c) "
        "WHERE d.valid GROUP BY ALL",
    )
    define(
        "feat_hours",
        "SELECT c.scene_id, c.r, c.c, max(c.bt13) AS m13, max(c.bt7) AS m7, median(c.bt7 - c.bt14) AS mbtd, "
        "CAST(count(*) FILTER (c.bt13 >= p.thr) AS DOUBLE) AS persist_h FROM cube c LEFT JOIN p70 p USING (scene_id, hour) GROUP BY ALL",
    )
    define(
        "feat_filled",
        "SELECT scene_id, r, c, persist_h, coalesce(m13, median(m13) OVER (PARTITION BY scene_id)) AS bt13_max, "
        "coalesce(m7, median(m7) OVER (PARTITION BY scene_id)) AS bt7_max, "
        "coalesce(mbtd, median(mbtd) OVER (PARTITION BY scene_id)) AS btd_median FROM feat_hours",
    )
    median_cte("feat_med21", "feat_filled", "bt13_max", 21, ("scene_id",))
    del scored
    return define(
        "features",
        "SELECT f.scene_id, f.r, f.c, f.bt13_max, f.bt7_max, f.btd_median, k.risk AS twin_risk, f.bt13_max - m.med AS bt13_anom_21, "
        f"f.persist_h, k.valid FROM feat_filled f JOIN feat_med21 m USING (scene_id, r, c) JOIN {field} k USING (scene_id, r, c)",
    )


def persistence_ctes(cfg: PersistenceConfig = PersistenceConfig(), tag: str = "") -> str:
    """Combined-persistence field; ``tag`` ends the names that belong to settings of their own."""
    scored = score_ctes()
    base, span, (low, high) = cfg.hour_percentile, cfg.adaptive_span, cfg.adaptive_clip
    define(
        "usable",
        f"SELECT s.*, d.valid, s.score_valid AND d.valid AS usable FROM {scored} s JOIN day d USING (scene_id, r, c)",
    )
    define(
        f"hour_levels{tag}",
        f"SELECT scene_id, hour, CASE WHEN count(*) >= 64 THEN greatest({lit(low)}, least({lit(high)}, {lit(base)} + {lit(span)} * greatest(0e0, "
        f"(0.12e0 - (quantile_cont(score, 0.9e0) - quantile_cont(score, 0.1e0))) / (0.12e0 + 1e-6)))) ELSE {lit(base)} END AS level "
        "FROM usable WHERE usable GROUP BY ALL",
    )
    define(
        f"hour_ranked{tag}",
        "SELECT u.scene_id, u.hour, u.score, h.level, row_number() OVER (PARTITION BY u.scene_id, u.hour ORDER BY u.score) - 1 AS rk, "
        "(count(*) OVER (PARTITION BY u.scene_id, u.hour) - 1) * h.level / 100e0 AS pos FROM usable u "
        f"JOIN hour_levels{tag} h USING (scene_id, hour) WHERE u.usable",
    )
    define(
        f"hour_cut{tag}",
        "SELECT scene_id, hour, max(level) AS level, max(score) FILTER (rk = floor(pos)) + (max(score) FILTER (rk = ceil(pos)) "
        f"- max(score) FILTER (rk = floor(pos))) * max(pos - floor(pos)) AS thr FROM hour_ranked{tag} GROUP BY ALL",
    )
    define(
        f"persist_cells{tag}",
        "SELECT u.scene_id, u.r, u.c, CAST(count(*) FILTER (u.usable AND u.score >= h.thr) AS DOUBLE) AS active_hours, "
        "CAST(count(*) FILTER (u.usable) AS DOUBLE) AS usable_hours, max(u.score) AS peak, avg(u.score) AS mean, "
        f"bool_and(u.valid) AS valid FROM usable u LEFT JOIN hour_cut{tag} h USING (scene_id, hour) GROUP BY ALL",
    )
    define(
        f"persist_ok{tag}",
        f"SELECT *, active_hours / greatest(usable_hours, 1e-9) AS persist, valid AND usable_hours >= 1 AS eligible FROM persist_cells{tag}",
    )
    total = sum(cfg.weights)
    peak, mean, persist = (lit(w / total) for w in cfg.weights)
    q = [n / 100.0 for n in cfg.norm]
    return define(
        f"persist_field{tag}",
        f"SELECT *, {peak} * {unit_expr('peak', 'eligible', *q, 'scene_id')} + "
        f"{mean} * {unit_expr('mean', 'eligible', *q, 'scene_id')} + {persist} * persist AS combined "
        f"FROM persist_ok{tag}",
    )


def persistence_mask_cte(
    name: str, q: float, least: int = 3, cfg: PersistenceConfig = PersistenceConfig(), tag: str = ""
) -> str:
    field, crowd = persistence_ctes(cfg, tag), cfg.opening_from_cells
    define(
        f"{name}_thr",
        f"SELECT *, quantile_cont(combined, {lit(q)}) FILTER (eligible) OVER (PARTITION BY scene_id) AS thr, "
        f"greatest(1e0, median(usable_hours) FILTER (eligible) OVER (PARTITION BY scene_id)) AS seen FROM {field}",
    )
    define(
        f"{name}_gated",
        f"SELECT scene_id, r, c FROM {name}_thr WHERE eligible AND combined >= thr AND (seen < 2 OR persist >= "
        f"greatest({lit(cfg.persist_floor)}, {lit(cfg.persist_scale)} / seen)) AND active_hours >= 2",
    )
    define(f"{name}_n", f"SELECT *, count(*) OVER (PARTITION BY scene_id) AS n FROM {name}_gated")
    define(f"{name}_big", f"SELECT scene_id, r, c FROM {name}_n WHERE n >= {crowd}")
    opening_cte(f"{name}_open", f"{name}_big", "cross")
    define(
        f"{name}_all",
        f"SELECT scene_id, r, c FROM {name}_n WHERE n < {crowd} UNION ALL SELECT scene_id, r, c FROM {name}_open",
    )
    return sized_cte(name, f"{name}_all", least, 0, 1)


def event_layer_ctes(sizes: tuple[int, ...] = (3, 5, 7)) -> str:
    lay = "scene_id, hour"
    define("ev_seen", "SELECT c.*, d.valid, c.bt13 IS NOT NULL AND d.valid AS seen, c.bt7 - c.bt14 AS btd FROM cube c JOIN day d USING (scene_id, r, c)")
    define(
        "ev_filled",
        f"SELECT *, CASE WHEN seen THEN bt13 ELSE coalesce(median(bt13) FILTER (seen) OVER (PARTITION BY {lay}), 0e0) END AS f FROM ev_seen",
    )
    for k in sizes:
        median_cte(f"ev_med{k}", "ev_filled", "f", k, ("scene_id", "hour"))
    define(
        "ev_res",
        "SELECT e.*, " + ", ".join(f"greatest(0e0, e.f - m{k}.med) AS res{k}" for k in sizes) + " FROM ev_filled e "
        + " ".join(f"JOIN ev_med{k} m{k} USING (scene_id, hour, r, c)" for k in sizes),
    )
    mean = " + ".join(unit_expr(f"res{k}", "seen", 0.04, 0.96, lay) for k in sizes)
    define(
        "ev_thr",
        f"SELECT *, ({mean}) / {lit(len(sizes))} AS anomaly, quantile_cont(btd, 0.35e0) FILTER (seen) OVER (PARTITION BY {lay}) AS lo, "
        f"quantile_cont(btd, 0.9e0) FILTER (seen) OVER (PARTITION BY {lay}) AS hi, "
        f"quantile_cont(bt7, {lit(99.2 / 100.0)}) FILTER (seen) OVER (PARTITION BY {lay}) AS g FROM ev_res",
    )
    define(
        "ev_flags",
        "SELECT *, coalesce(seen AND btd BETWEEN lo AND hi, FALSE) AS in_band, coalesce(seen AND bt7 >= g, FALSE) AS glint FROM ev_thr",
    )
    return define(
        "ev_layers",
        "SELECT *, CASE WHEN in_band THEN " + clip("1e0 - 2e0 * abs(btd - 0.5e0 * (lo + hi)) / greatest(hi - lo, 1e-6)")
        + " ELSE 0e0 END AS band, anomaly > 0.05e0 AND in_band AND NOT glint AS active FROM ev_flags",
    )


def event_risk_ctes() -> str:
    lay = event_layer_ctes()
    define(
        "ev_cells",
        "SELECT scene_id, r, c, count(*) FILTER (active) AS active_hours, coalesce(avg(anomaly) FILTER (active), 0e0) AS a, "
        "coalesce(avg(band) FILTER (active), 0e0) AS b, bool_or(in_band) AND NOT bool_and(glint) AS alive, bool_and(valid) AS valid "
        f"FROM {lay} GROUP BY ALL",
    )
    return define(
        "ev_risk",
        "SELECT scene_id, r, c, valid, active_hours, CASE WHEN alive AND active_hours >= 2 THEN "
        f"(0.55e0 * {unit_expr('a', 'valid', 0.05, 0.95, 'scene_id')} + 0.2e0 * {unit_expr('b', 'valid', 0.05, 0.95, 'scene_id')} "
        "+ 0.25e0 * (active_hours / 3e0)) / 1e0 ELSE 0e0 END AS risk FROM ev_cells",
    )


def event_mask_cte(name: str, q: float) -> str:
    risk = event_risk_ctes()
    define(
        f"{name}_thr",
        f"SELECT *, quantile_cont(risk, {lit(q)}) FILTER (valid AND risk > 0) OVER (PARTITION BY scene_id) AS thr, "
        f"count(*) FILTER (valid AND risk > 0) OVER (PARTITION BY scene_id) AS n FROM {risk}",
    )
    define(f"{name}_hot", f"SELECT scene_id, r, c FROM {name}_thr WHERE n >= 32 AND valid AND risk >= thr")
    return sized_cte(name, f"{name}_hot", 1, 200, 1)


def gate_steps(km: float) -> int:
    g = X.GRID
    mid = math.radians(0.5 * (g.min_lat + g.max_lat))
    lat = (g.max_lat - g.min_lat) * KM_PER_DEG / g.h
    lon = (g.max_lon - g.min_lon) * KM_PER_DEG * math.cos(mid) / g.w
    return max(1, round(km / ((lat + lon) / 2)))


def boosted_cte(p: str, models: str, features: tuple[str, ...], rounds: int, depth: int, rate: float, bins: int, min_leaf: int) -> str:
    """Boosted trees over ``training`` for every model of the query ``models`` (the scene each leaves out)."""
    f = range(len(features))
    levels = "[" + ", ".join(lit(i / bins) for i in range(1, bins)) + "]"
    define(f"{p}_models", models)
    define(f"{p}_edges", "SELECT " + ", ".join(f"list_sort(list_distinct(quantile_cont({x}, {levels}))) AS e{i}" for i, x in enumerate(features)) + " FROM training")
    define(
        f"{p}_bins",
        "SELECT scene_id, r, c, label, "
        + ", ".join(f"len(list_filter(e{i}, lambda v: v < t.{x})) AS b{i}" for i, x in enumerate(features))
        + f" FROM training t, {p}_edges",
    )
    define(
        f"{p}_weights",
        f"SELECT model, count(*) / (2e0 * count(*) FILTER (label = 0)) AS w0, count(*) / (2e0 * count(*) FILTER (label = 1)) AS w1 "
        f"FROM {p}_bins JOIN {p}_models ON scene_id <> model GROUP BY model",
    )
    bs = ", ".join(f"b{i}" for i in f)
    define(
        f"{p}_s0",
        f"SELECT model, scene_id, r, c, label, {bs}, scene_id <> model AS train, CASE WHEN label = 1 THEN w1 ELSE w0 END AS w, 0e0 AS margin "
        f"FROM {p}_bins, {p}_weights",
    )
    for t in range(rounds):
        define(
            f"{p}_n{t}_0",
            f"SELECT *, w * (p - label) AS g, w * p * (1e0 - p) AS h, 0 AS node FROM (SELECT *, 1e0 / (1e0 + exp(-margin)) AS p FROM {p}_s{t})",
        )
        for level in range(depth):
            src = f"{p}_n{t}_{level}"
            long = " UNION ALL ".join(f"SELECT model, node, {i} AS f, b{i} AS b, g, h FROM {src} WHERE train" for i in f)
            define(f"{p}_h{t}_{level}", f"SELECT model, node, f, b, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({long}) GROUP BY ALL")
            define(
                f"{p}_c{t}_{level}",
                "SELECT *, sum(g) OVER u AS ga, sum(h) OVER u AS ha, sum(n) OVER u AS na, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(n) OVER o AS nl "
                f"FROM {p}_h{t}_{level} WINDOW u AS (PARTITION BY model, node, f), o AS (PARTITION BY model, node, f ORDER BY b)",
            )
            define(
                f"{p}_b{t}_{level}",
                f"SELECT model, node, f, b FROM (SELECT *, round(gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) - ga * ga / ha, 9) AS gain FROM {p}_c{t}_{level} "
                f"WHERE nl >= {min_leaf} AND na - nl >= {min_leaf} AND hl >= 1e-3 AND ha - hl >= 1e-3) WHERE gain > 0 "
                "QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY gain DESC, f, b) = 1",
            )
            chosen = "CASE k.f " + " ".join(f"WHEN {i} THEN b{i}" for i in f) + " END"
            define(
                f"{p}_n{t}_{level + 1}",
                f"SELECT s.* REPLACE (2 * s.node + CASE WHEN k.f IS NOT NULL AND {chosen} > k.b THEN 1 ELSE 0 END AS node) "
                f"FROM {src} s LEFT JOIN {p}_b{t}_{level} k ON s.model = k.model AND s.node = k.node",
            )
        define(f"{p}_v{t}", f"SELECT model, node, -{lit(rate)} * sum(g) / sum(h) AS v FROM {p}_n{t}_{depth} WHERE train GROUP BY ALL")
        define(
            f"{p}_s{t + 1}",
            f"SELECT s.model, scene_id, r, c, label, {bs}, train, w, margin + coalesce(v, 0e0) AS margin "
            f"FROM {p}_n{t}_{depth} s LEFT JOIN {p}_v{t} v ON s.model = v.model AND s.node = v.node",
        )
    return f"{p}_s{rounds}"
