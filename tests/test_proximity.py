import math
import random

from conftest import rows

from quarrymill.operators.proximity import containing_regions, near_pairs, near_points


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def brute(points, radius):
    ids = sorted(points)
    return sorted((i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if haversine(points[i], points[j]) <= radius)


def frame(spark, data):
    return spark.createDataFrame([(i, *p, "x", 7) for i, p in data], "id long, latitude double, longitude double, cell string, part int")


def test_against_brute_force_everywhere(spark):
    rng = random.Random(5)
    points = {}
    for k, (lat, lon) in enumerate([(52.5, 13.4), (0.0, 0.1), (0.0, 179.999), (89.9995, 10.0), (-89.9999, 0.0), (66.0, -179.9995), (-33.9, 18.4)]):
        for n in range(60):
            dlat, dlon = rng.uniform(-0.004, 0.004), rng.uniform(-0.004, 0.004) / max(0.00001, math.cos(math.radians(lat)))
            points[k * 100 + n] = (max(-90.0, min(90.0, lat + dlat)), (lon + dlon + 180) % 360 - 180)
    got = sorted((r["id_a"], r["id_b"]) for r in near_pairs(frame(spark, points.items()), 200.0, chunk=16).collect())
    assert got == brute(points, 200.0)
    assert len(got) > 100


def test_unusable_repeated_and_equal_points(spark):
    nan = float("nan")
    data = [(1, (50.0, 8.0)), (1, (50.0, 8.0)), (2, (50.0, 8.0)), (3, (0.0, 0.0)), (4, (0.0, 0.0)), (5, (None, 8.0)), (6, (50.0, None)), (7, (nan, 8.0)), (8, (91.0, 8.0)), (9, (50.0, 181.0)), (10, (50.0, 8.0)), (None, (50.0, 8.0))]
    got = sorted((r["id_a"], r["id_b"]) for r in near_pairs(frame(spark, data)).collect())
    assert got == [(1, 2), (1, 10), (2, 10)]


def test_full_cell_is_split_without_loss(spark):
    data = [(i, (50.0, 8.0)) for i in range(60)]
    assert near_pairs(frame(spark, data), chunk=7).count() == 60 * 59 // 2


def test_empty(spark):
    assert near_pairs(frame(spark, [])).count() == 0
    regions = spark.createDataFrame([], "region_id int, ring array<struct<lat:double,lon:double>>")
    assert containing_regions(frame(spark, [(1, (1.0, 1.0))]), regions).count() == 0


def test_regions(spark):
    ring = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    notch = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (5.0, 5.0), (10.0, 0.0)]
    regions = spark.createDataFrame([(1, ring), (2, notch), (3, [(0.0, 0.0)]), (4, None)], "region_id int, ring array<struct<lat:double,lon:double>>")
    got = rows(containing_regions(frame(spark, [(1, (2.0, 5.0)), (2, (9.0, 5.0)), (3, (20.0, 5.0)), (4, (None, 1.0))]), regions, 1.0))
    assert got == [(1, 1), (1, 2), (2, 1)]


def inside(ring, lat, lon):
    hit = False
    for (a_lat, a_lon), (b_lat, b_lon) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a_lat > lat) != (b_lat > lat) and lon < (b_lon - a_lon) * (lat - a_lat) / (b_lat - a_lat) + a_lon:
            hit = not hit
    return hit


def test_regions_against_brute_force(spark):
    """Stars of many edges, one over the 180th meridian, in coarse and fine cells."""
    rng = random.Random(11)

    def star(lat, lon, n):
        return [(lat + (2 + 3 * (i % 2)) * math.sin(2 * math.pi * i / n), lon + (2 + 4 * (i % 3)) * math.cos(2 * math.pi * i / n)) for i in range(n)]

    stars = {1: star(10.0, 20.0, 60), 2: star(12.0, 22.0, 9), 3: star(-40.0, 179.0, 40), 4: [(0.0, 0.0), (0.0, 30.0), (30.0, 30.0), (30.0, 0.0)]}
    wrap = lambda lon: (lon + 180) % 360 - 180
    regions = spark.createDataFrame([(k, [(a, wrap(o)) for a, o in ring]) for k, ring in stars.items()], "region_id int, ring array<struct<lat:double,lon:double>>")
    points = [(i, (rng.uniform(-50, 35), wrap(rng.choice([rng.uniform(-5, 40), rng.uniform(170, 190)])))) for i in range(1500)]
    want = sorted((i, k) for i, (lat, lon) in points for k, ring in stars.items() if inside(ring, lat, lon) or inside(ring, lat, lon + 360))
    for degrees in (0.7, 5.0):
        assert sorted((r["id"], r["region_id"]) for r in containing_regions(frame(spark, points), regions, degrees).collect()) == want
    assert len({k for _, k in want}) == 4


def test_points_near_origins(spark):
    rng = random.Random(3)
    points = [(i, (rng.choice([rng.uniform(-90, 90), 89.999, 10.0]), rng.uniform(-180, 180))) for i in range(400)] + [(1000 + i, (10.0 + i * 1e-3, 179.99 + i * 1e-3 if i < 10 else -180 + i * 1e-3)) for i in range(20)]
    origins = spark.createDataFrame([(k, float(a), float(o), "x") for k, (a, o) in enumerate([(89.9995, 0.0), (10.0, 180.0), (10.0, -179.995), (0.0, 0.0), (91.0, 0.0)])], "origin_id long, latitude double, longitude double, id string")
    got = sorted((r["origin_id"], r["id"]) for r in near_points(frame(spark, points), origins, 3_000.0, chunk=4).collect())

    def far(a, b):
        x, y = (math.radians(b[0] - a[0]) / 2, math.radians(b[1] - a[1]) / 2)
        return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(math.sin(x) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(y) ** 2)))

    want = sorted((k, i) for k, o in enumerate([(89.9995, 0.0), (10.0, 180.0), (10.0, -179.995)]) for i, p in points if far(o, p) <= 3_000)
    assert got == want and len(want) > 100
