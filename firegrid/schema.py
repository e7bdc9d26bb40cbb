"""Grid description and the column conventions shared by every operator.

Tables
  pixels  scene_id, hour, hour_seq, channel, lat, lon, bt, dqf        one row per satellite pixel
  cube    scene_id, hour, hour_seq, r, c, bt7, bt13, bt14             dense, NULL = no data
  cells   scene_id, r, c, ...                                         dense, one row per grid cell
  mask    scene_id, r, c                                              sparse set of true cells

Row 0 is the south edge and column 0 the west edge.  A scene holds at most
``grid.cells`` rows per hour whatever the number of pixels, so per-scene groups are
bounded by the grid, not by the data.
"""

from __future__ import annotations

from dataclasses import dataclass

SCENE = ("scene_id",)
LAYER = ("scene_id", "hour")
CHANNELS = (7, 13, 14)
KM_PER_DEG = 111.32


@dataclass(frozen=True)
class GridSpec:
    """Uniform latitude / longitude grid over a bounding box."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float
    h: int
    w: int

    @property
    def cells(self) -> int:
        return self.h * self.w

    @property
    def lat_step(self) -> float:
        return (self.max_lat - self.min_lat) / self.h

    @property
    def lon_step(self) -> float:
        return (self.max_lon - self.min_lon) / self.w

    def resized(self, h: int, w: int) -> "GridSpec":
        return GridSpec(self.min_lat, self.max_lat, self.min_lon, self.max_lon, h, w)


# State bounding box (degrees) and its statistical office code.
STATE_CODE = 23
STATE_NAME_PREFIX = "CEAR"


def state_grid(h: int = 72, w: int = 72) -> GridSpec:
    return GridSpec(min_lat=-7.9, max_lat=-2.5, min_lon=-41.5, max_lon=-37.0, h=h, w=w)
