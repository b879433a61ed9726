import math
import random

import pytest
from pyspark.sql import functions as F

from darkslide.operators import spatial

REGIONS = "region_id long, shape string, lat double, lon double, radius_m double, ring array<struct<lon:double,lat:double>>, level string, cell string"
POINTS = "point_id long, lat double, lon double, region_id string, interior string"
NAN = float("nan")


def ring(*xy):
    return [{"lon": float(x), "lat": float(y)} for x, y in (*xy, xy[0])]


REGION_ROWS = [
    (1, "circle", 10.0, 20.0, 5000.0, None, "x", "x"),
    (2, "circle", 89.9, 0.0, 40000.0, None, None, None),
    (3, "circle", 0.0, 179.99, 9000.0, None, None, None),
    (4, "polygon", None, None, None, ring((170, -5), (190, -5), (185, 6), (172, 4)), None, None),
    (5, "polygon", None, None, None, ring((19.9, 9.9), (20.1, 9.9), (20.1, 10.1), (20.0, 10.0), (19.9, 10.1)), None, None),
    (6, "circle", None, 1.0, 5.0, None, None, None),
    (7, "polygon", None, None, None, None, None, None),
    (8, "blob", 1.0, 1.0, 1e6, None, None, None),
    (9, "circle", 10.0, 20.0, 0.0, None, None, None),
]


def inside(r, lat, lon):
    _, shape, y, x, radius, poly, *_ = r
    if shape == "circle" and y is not None:
        h = math.sin(math.radians(lat - y) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(lon - x) / 2) ** 2
        return 2 * spatial.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h))) <= radius
    if shape == "polygon" and poly:
        for s in (0, 360, -360):
            n = 0
            for a, b in zip(poly, poly[1:]):
                if (a["lat"] > lat) != (b["lat"] > lat):
                    n += a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / (b["lat"] - a["lat"]) > lon + s
            if n % 2:
                return True
    return False


@pytest.mark.parametrize("broadcast_rows", [2_000_000, 0])
@pytest.mark.parametrize("max_cells", [16, 512])
def test_agrees_with_brute_force(spark, broadcast_rows, max_cells):
    rnd = random.Random(3)
    points = [(i, 10 + rnd.gauss(0, 0.06), 20 + rnd.gauss(0, 0.06)) for i in range(400)]
    points += [(1000 + i, rnd.uniform(-8, 8), rnd.choice((rnd.uniform(168, 180), rnd.uniform(-180, -168)))) for i in range(400)]
    points += [(2000 + i, rnd.uniform(89, 90), rnd.uniform(-180, 180)) for i in range(100)] + [(3000, 90.0, 0.0), (3001, 0.0, 180.0), (3002, 10.0, 20.0)]
    expected = {(p, r[0]) for p, lat, lon in points for r in REGION_ROWS if inside(r, lat, lon)}
    rows = [(*p, "a", "b") for p in points] + [(4000, None, 20.0, "", ""), (4001, NAN, 20.0, "", ""), (4002, 95.0, 20.0, "", ""), (4003, 10.0, 200.0, "", "")]
    got = spatial.points_in_regions(spark.createDataFrame(rows + rows[:50], POINTS), spark.createDataFrame(REGION_ROWS, REGIONS), max_cells, broadcast_rows)
    got = [tuple(r) for r in got.collect()]
    assert set(got) == expected and len(got) == len(expected) and len(expected) > 300


def test_empty_tables(spark):
    none = spark.createDataFrame([], POINTS)
    regions = spark.createDataFrame(REGION_ROWS, REGIONS)
    assert spatial.points_in_regions(none, regions).count() == 0
    assert spatial.points_in_regions(spark.createDataFrame([(1, 1.0, 1.0, "", "")], POINTS), regions.where(F.lit(False))).count() == 0


def test_interior_cells_need_no_test():
    cells = spatial.cover("circle", 10.0, 20.0, 50_000.0, None, 512)
    assert any(i for *_, i in cells) and len(cells) <= 512 and len({c[:2] for c in cells}) == len(cells)
