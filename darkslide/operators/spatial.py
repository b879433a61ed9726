"""Points in regions: adaptive cell coverage, interior equi-joins, exact tests on the boundary only.

Each region is covered by cells of a quadtree over longitude and latitude at a few fixed levels. A cell
wholly inside the region decides by equality of cell ids alone; a cell that touches the border makes its
points candidates for the exact test. Points never meet regions whose cells they do not share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.session import cut

EARTH_RADIUS_M = 6371008.8
LEVELS = (4, 7, 10, 13, 16)
_SLACK_M = 0.01
_SLACK_DEG = 1e-9

COVER_SCHEMA = "region_id long, level int, cell long, interior boolean"


def _cell_size(level: int) -> tuple[float, float]:
    return 360.0 / (1 << level), 180.0 / (1 << level)


def _circle_state(lat: float, lon: float, radius: float, lon0, lon1, lat0, lat1) -> np.ndarray:
    """0 outside, 1 border, 2 inside, for arrays of cells; bounds by the triangle inequality, so never wrong."""
    mlat, mlon = np.radians((lat0 + lat1) / 2), np.radians((lon0 + lon1) / 2)
    p, q = math.radians(lat), math.radians(lon)
    h = np.sin((mlat - p) / 2) ** 2 + np.cos(mlat) * math.cos(p) * np.sin((mlon - q) / 2) ** 2
    d = 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))
    widest = np.where((lat0 <= 0) & (lat1 >= 0), 1.0, np.maximum(np.cos(np.radians(lat0)), np.cos(np.radians(lat1))))
    reach = EARTH_RADIUS_M * np.radians((lat1 - lat0) / 2 + (lon1 - lon0) / 2 * widest)
    return np.where(d + reach <= radius - _SLACK_M, 2, np.where(d - reach > radius + _SLACK_M, 0, 1))


def _ring_state(xs: np.ndarray, ys: np.ndarray, lon0, lon1, lat0, lat1) -> np.ndarray:
    """The same for a closed ring with straight edges in degrees; a cell that no edge meets is wholly in or out."""
    out = np.zeros(len(lon0), dtype=int)
    x0, x1, y0, y1 = xs[:-1], xs[1:], ys[:-1], ys[1:]
    for i in range(len(lon0)):
        a, b, c, d = lon0[i] - _SLACK_DEG, lon1[i] + _SLACK_DEG, lat0[i] - _SLACK_DEG, lat1[i] + _SLACK_DEG
        # an edge meets the box unless the box lies on one side of its line, or beside its extent
        near = (np.maximum(x0, x1) >= a) & (np.minimum(x0, x1) <= b) & (np.maximum(y0, y1) >= c) & (np.minimum(y0, y1) <= d)
        if near.any():
            dx, dy = (x1 - x0)[near], (y1 - y0)[near]
            side = [dx * (y - y0[near]) - dy * (x - x0[near]) for x in (a, b) for y in (c, d)]
            if ((np.min(side, axis=0) <= 0) & (np.max(side, axis=0) >= 0)).any():
                out[i] = 1
                continue
        mx, my = (lon0[i] + lon1[i]) / 2, (lat0[i] + lat1[i]) / 2
        cross = (y0 > my) != (y1 > my)
        at = x0[cross] + (my - y0[cross]) * (x1 - x0)[cross] / (y1 - y0)[cross]
        out[i] = 2 * int((at > mx).sum() % 2)
    return out


def cover(shape: str | None, lat: float | None, lon: float | None, radius: float | None, ring: list | None, max_cells: int) -> list[tuple[int, int, bool]]:
    """(level, cell, interior) of one region. A region without usable geometry has no cells.

    Border cells are split level by level while the cover keeps within max_cells; what is left unsplit stays
    border, so a small max_cells makes the cover coarser, never wrong.
    """
    top = LEVELS[0]
    w, h = _cell_size(top)
    if shape == "circle":
        if None in (lat, lon, radius) or not all(map(math.isfinite, (lat, lon, radius))) or radius < 0:
            return []
        ix, iy = np.meshgrid(np.arange(1 << top), np.arange(1 << top))
        state = lambda a, b, c, d: _circle_state(lat, lon, radius, a, b, c, d)
    elif shape == "polygon":
        if ring is None or len(ring) < 4:
            return []
        xs, ys = np.array([p["lon"] for p in ring], float), np.array([p["lat"] for p in ring], float)
        if not (np.isfinite(xs).all() and np.isfinite(ys).all()):
            return []
        ix, iy = np.meshgrid(
            np.arange(math.floor((xs.min() + 180) / w), math.floor((xs.max() + 180) / w) + 1),
            np.arange(max(0, math.floor((ys.min() + 90) / h)), min((1 << top) - 1, math.floor((ys.max() + 90) / h)) + 1),
        )
        state = lambda a, b, c, d: _ring_state(xs, ys, a, b, c, d)
    else:
        return []
    done: list[tuple[int, int, bool]] = []
    ix, iy, border = ix.ravel(), iy.ravel(), None
    for k, level in enumerate(LEVELS):
        w, h = _cell_size(level)
        s = state(ix * w - 180, (ix + 1) * w - 180, iy * h - 90, (iy + 1) * h - 90)
        inside, edge = s == 2, s == 1
        if k and len(done) + int(inside.sum() + edge.sum()) > max_cells:
            level, (ix, iy) = LEVELS[k - 1], border
            done += [(level, _cell_id(level, x, y), False) for x, y in zip(ix, iy)]
            return done
        done += [(level, _cell_id(level, x, y), True) for x, y in zip(ix[inside], iy[inside])]
        border = ix, iy = ix[edge], iy[edge]
        if k == len(LEVELS) - 1 or not len(ix):
            break
        n = 1 << (LEVELS[k + 1] - level)
        ox, oy = np.meshgrid(np.arange(n), np.arange(n))
        ix, iy = (ix[:, None] * n + ox.ravel()).ravel(), (iy[:, None] * n + oy.ravel()).ravel()
    return done + [(LEVELS[k], _cell_id(LEVELS[k], x, y), False) for x, y in zip(*border)]


def _cell_id(level: int, x: int, y: int) -> int:
    return (int(x) % (1 << level)) * (1 << level) + int(y)


def region_cover(regions: DataFrame, max_cells: int = 512) -> DataFrame:
    """The cells of every region, made where the regions are: (region_id, level, cell, interior).

    regions: region_id, shape ('circle' or 'polygon'), lat, lon, radius_m, ring. A region that runs past the
    date line may name a cell twice; one row per cell is kept, as border if either is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (r.region_id, *c)
                for r in b.itertuples(index=False)
                for c in cover(r.shape, *(None if pd.isna(v) else float(v) for v in (r.lat, r.lon, r.radius_m)), None if r.ring is None else list(r.ring), max_cells)
            ]
            yield pd.DataFrame(rows, columns=["region_id", "level", "cell", "interior"])

    # few rows and much work: as many tasks as a shuffle has
    spread = regions.where("region_id is not null").select("region_id", "shape", "lat", "lon", "radius_m", "ring").repartition(int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "region_id")
    cells = spread.mapInPandas(run, COVER_SCHEMA)
    return cells.groupBy("region_id", "level", "cell").agg(F.min("interior").alias("interior"))


def cell_of(level: F.Column, lat: F.Column, lon: F.Column) -> F.Column:
    """The cell of a point at a level; the north pole and longitude 180 belong to the last and first cells."""
    n = F.pow(F.lit(2), level).cast("long")
    x = F.pmod(F.floor((lon + 180) / 360 * n), n)
    y = F.least(F.floor((lat + 90) / 180 * n), n - 1)
    return x * n + y


def great_circle_m(lat1: F.Column, lon1: F.Column, lat2: F.Column, lon2: F.Column) -> F.Column:
    """Great-circle distance on the sphere of EARTH_RADIUS_M, by the haversine formula."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_ring(ring: F.Column, lat: F.Column, lon: F.Column) -> F.Column:
    """Even-odd test against a closed ring; the point is tried at its longitude and one turn either way."""

    def crossings(x: F.Column) -> F.Column:
        def hit(i: F.Column) -> F.Column:
            p, q = F.get(ring, i), F.get(ring, i + 1)
            spans = (p["lat"] > lat) != (q["lat"] > lat)
            at = p["lon"] + (lat - p["lat"]) * (q["lon"] - p["lon"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0))
            return F.when(spans & (at > x), 1).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0), lambda n, i: n + hit(i)) % 2 == 1

    usable = ring.isNotNull() & (F.size(ring) >= 4)
    return F.when(usable, crossings(lon) | crossings(lon + 360) | crossings(lon - 360)).otherwise(False)


def points_in_regions(points: DataFrame, regions: DataFrame, max_cells: int = 512, broadcast_rows: int = 2_000_000, salts: int = 16) -> DataFrame:
    """(point_id, region_id) for every point in a region.

    points: point_id, lat, lon. regions: as in region_cover; other columns of either are ignored, whatever
    their names. Points with null, NaN or out-of-range coordinates and regions without usable geometry match
    nothing; repeated points or regions give their pairs once.

    The cover has at most max_cells rows a region (or the whole first level), so the count of regions bounds
    it: within broadcast_rows it is broadcast and points are not shuffled; beyond, both sides are hashed on
    the cell, with cover rows repeated over salts so that a crowded cell spreads over that many tasks.
    """
    lat, lon = F.col("lat"), F.col("lon")
    fine = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    points = points.select("point_id", F.col("lat").cast("double"), F.col("lon").cast("double")).where(fine)
    regions = regions.select("region_id", "shape", *(F.col(c).cast("double") for c in ("lat", "lon", "radius_m")), "ring")
    n = regions.count()
    small = n * max(max_cells, 4 ** LEVELS[0]) <= broadcast_rows
    # read by the interior and by the border join, so written once
    cells = cut(region_cover(regions, max_cells), "cover")
    levels = F.array(*(F.lit(v) for v in LEVELS))
    located = points.select("*", F.explode(levels).alias("level")).withColumn("cell", cell_of(F.col("level"), lat, lon))
    if small:
        met = located.join(F.broadcast(cells), ["level", "cell"])
    else:
        located = located.withColumn("salt", F.pmod(F.xxhash64("point_id"), F.lit(salts)))
        cells = cells.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        met = located.join(cells, ["level", "cell", "salt"])
    geo = regions.select("region_id", "shape", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "radius_m", "ring")
    inner = met.where("interior").select("point_id", "region_id")
    edge = met.where("not interior")
    if small:
        edge = edge.join(F.broadcast(geo), "region_id")
    else:  # a crowded region spreads over the salts, its shape repeated for each
        edge = edge.join(geo.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["region_id", "salt"])
    exact = F.when(F.col("shape") == "circle", great_circle_m(lat, lon, F.col("r_lat"), F.col("r_lon")) <= F.col("radius_m")).otherwise(in_ring(F.col("ring"), lat, lon))
    # cells of one region are disjoint, so pairs repeat only where points or regions do
    return inner.unionByName(edge.where(exact).select("point_id", "region_id")).dropDuplicates()
