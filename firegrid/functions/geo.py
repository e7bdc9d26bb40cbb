"""Column expressions for grid geometry, distance and satellite navigation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from firegrid.schema import KM_PER_DEG, GridSpec


def edge(i: Column, lo: float, hi: float, n: int) -> Column:
    """Edge ``i`` of ``n`` equal bins; the last edge is exactly ``hi``."""
    return F.when(i >= n, F.lit(hi)).otherwise(F.lit(lo) + i * F.lit((hi - lo) / n))


def axis_index(v: Column, lo: float, hi: float, n: int) -> Column:
    """Bin index of a value already known to lie in [lo, hi]; ``hi`` itself is in the last bin.

    The floor can land one bin off an edge, so it is corrected against the two edges around it.
    """
    step = F.lit((hi - lo) / n)
    i = F.floor((v - F.lit(lo)) / step).cast("int")
    low = F.lit(lo) + i * step
    high = F.lit(lo) + (i + 1) * step
    fixed = i - (v < low).cast("int") + (v >= high).cast("int")
    return F.least(fixed, F.lit(n - 1))


def in_grid(lat: Column, lon: Column, grid: GridSpec, closed_top: bool = True) -> Column:
    """Whether a point falls in a cell: plain range predicates a scan can use.  The north and east
    edges belong to the last cells, or to none with ``closed_top=False``."""
    if closed_top:
        return in_bbox(lat, lon, grid)
    return (lat >= grid.min_lat) & (lat < grid.max_lat) & (lon >= grid.min_lon) & (lon < grid.max_lon)


def lat_row(lat: Column, grid: GridSpec) -> Column:
    return axis_index(lat, grid.min_lat, grid.max_lat, grid.h)


def lon_col(lon: Column, grid: GridSpec) -> Column:
    return axis_index(lon, grid.min_lon, grid.max_lon, grid.w)


def center_lat(r: Column, grid: GridSpec) -> Column:
    lo, hi, n = grid.min_lat, grid.max_lat, grid.h
    return 0.5 * (edge(r, lo, hi, n) + edge(r + 1, lo, hi, n))


def center_lon(c: Column, grid: GridSpec) -> Column:
    lo, hi, n = grid.min_lon, grid.max_lon, grid.w
    return 0.5 * (edge(c, lo, hi, n) + edge(c + 1, lo, hi, n))


def in_bbox(lat: Column, lon: Column, grid: GridSpec) -> Column:
    """Inclusive on all four sides."""
    return lat.between(grid.min_lat, grid.max_lat) & lon.between(grid.min_lon, grid.max_lon)


def km_per_deg_lon(lat_ref: Column) -> Column:
    return F.lit(KM_PER_DEG) * F.cos(F.radians(lat_ref))


def local_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, lat_ref: Column) -> Column:
    """Equirectangular distance around ``lat_ref``."""
    return F.hypot((lat_a - lat_b) * KM_PER_DEG, (lon_a - lon_b) * km_per_deg_lon(lat_ref))


def cell_reach(grid: GridSpec, radius_km: float) -> tuple[int, int]:
    """Row and column offsets that can hold a cell whose centre is within ``radius_km`` of a
    point, for any reference latitude inside the grid."""
    lat_km = grid.lat_step * KM_PER_DEG
    widest = max(abs(grid.min_lat), abs(grid.max_lat))
    lon_km = grid.lon_step * KM_PER_DEG * math.cos(math.radians(widest))
    return math.ceil(radius_km / lat_km) + 1, math.ceil(radius_km / max(lon_km, 1e-9)) + 1


def gate_iterations(grid: GridSpec, radius_km: float) -> int:
    """Dilation steps for a radius: half-to-even rounding of radius over mean cell size, at least 1."""
    mid = 0.5 * (grid.min_lat + grid.max_lat)
    lat_km = (grid.max_lat - grid.min_lat) * KM_PER_DEG / grid.h
    lon_km = (grid.max_lon - grid.min_lon) * KM_PER_DEG * math.cos(math.radians(mid)) / grid.w
    return max(1, round(radius_km / max((lat_km + lon_km) / 2.0, 1e-6)))


def scan_angle_latlon(
    x: Column,
    y: Column,
    height: float,
    lon0: float,
    semi_major: float,
    semi_minor: float,
    sweep: str = "x",
) -> tuple[Column, Column]:
    """Latitude and longitude of a geostationary fixed-grid scan angle pair (radians).

    NULL where the line of sight misses the ellipsoid.
    """
    flat = (semi_major / semi_minor) ** 2
    big_h = height + semi_major
    if sweep == "x":
        vx, vy, vz = F.cos(x) * F.cos(y), F.sin(x), F.cos(x) * F.sin(y)
    else:
        vx, vy, vz = F.cos(x) * F.cos(y), F.sin(x) * F.cos(y), F.sin(y)
    a = vx * vx + vy * vy + flat * vz * vz
    b = -2.0 * big_h * vx
    disc = b * b - 4.0 * a * (big_h**2 - semi_major**2)
    dist = (-b - F.sqrt(disc)) / (2.0 * a)
    east, up, ahead = dist * vy, dist * vz, F.lit(big_h) - dist * vx
    lat = F.degrees(F.atan(flat * up / F.hypot(ahead, east)))
    lon = F.lit(lon0) + F.degrees(F.atan2(east, ahead))
    seen = disc >= 0
    return F.when(seen, lat), F.when(seen, lon)
