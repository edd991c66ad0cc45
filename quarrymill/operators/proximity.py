"""Points near other points, and regions that contain points.

Points are hashed to grid cells as high as the search radius; every row of cells has its own
cell width, so cells keep their size in metres towards the poles. Candidates come from an
equi-join on cells; the exact great-circle distance (or point-in-polygon test) decides.

Rows whose coordinates are null, NaN, out of range or both zero are ignored. Several rows of one
id count as one (the smallest usable coordinate pair). Empty inputs give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.tables import staged

EARTH_RADIUS_M = 6_371_000.0
#: Points of one cell that one task compares at a time; fuller cells are split into chunks.
CELL_CHUNK = 2048


def usable_point(lat: Column, lon: Column) -> Column:
    """False for missing, NaN, impossible and (0, 0) coordinates."""
    ok = ~F.isnan(lat) & ~F.isnan(lon) & F.abs(lat).between(0, 90) & F.abs(lon).between(0, 180)
    return F.coalesce(ok & ~((lat == 0) & (lon == 0)), F.lit(False))


def great_circle_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Haversine distance in metres on a sphere of radius 6,371 km."""
    dlat, dlon = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


class Grid:
    """Rows of ``step`` degrees of latitude, each cut into cells at least as wide as high."""

    def __init__(self, radius_m: float):
        self.angle = radius_m / EARTH_RADIUS_M
        self.step = math.degrees(self.angle) * (1 + 1e-9)

    def row(self, lat: Column) -> Column:
        return F.floor((lat + 90) / F.lit(self.step)).cast("long")

    def columns_in(self, row: Column) -> Column:
        """Number of cells around the globe in a row."""
        edge = F.greatest(F.abs(row * self.step - 90), F.abs((row + 1) * self.step - 90))
        around = F.floor(360 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / self.step)
        return F.greatest(F.lit(1), around).cast("long")

    def column(self, lon: Column, around: Column) -> Column:
        return F.floor((lon + 180) / 360 * around).cast("long")

    @staticmethod
    def key(row: Column, col: Column, around: Column) -> Column:
        return F.shiftleft(row, 32) + F.pmod(col, around)

    def home(self, lat: Column, lon: Column) -> Column:
        row = self.row(lat)
        around = self.columns_in(row)
        return self.key(row, self.column(lon, around), around)

    def reached(self, lat: Column, lon: Column, row: Column) -> Column:
        """Keys of all cells of ``row`` that a circle around the point may touch."""
        around = self.columns_in(row)
        sin_d, cos_lat = F.lit(math.sin(self.angle) * (1 + 1e-9)), F.cos(F.radians(lat))
        half = F.when(cos_lat > sin_d, F.degrees(F.asin(sin_d / cos_lat))).otherwise(F.lit(180.0))
        first, last = self.column(lon - half, around), self.column(lon + half, around)
        last = F.least(last, first + around - 1)
        return F.transform(F.sequence(first, last), lambda c: self.key(row, c, around))


def split_full_cells(home: DataFrame, asking: DataFrame, chunk: int = CELL_CHUNK) -> tuple[DataFrame, DataFrame]:
    """Give both sides of a join on ``cell`` a ``part``: cells with many points become several
    parts, each point of ``home`` in one of them and each row of ``asking`` in all."""
    full = (
        home.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk)
        .select("cell", F.ceil(F.col("_n") / chunk).cast("int").alias("_parts"))
    )
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    home = home.join(full, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("_parts")
    asking = asking.join(full, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return home, asking


def _points(df: DataFrame, id_col: str, lat_col: str, lon_col: str) -> DataFrame:
    points = df.select(F.col(id_col).alias("id"), F.col(lat_col).cast("double").alias("lat"), F.col(lon_col).cast("double").alias("lon"))
    points = points.filter(F.col("id").isNotNull() & usable_point(F.col("lat"), F.col("lon")))
    return points.groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("id", "p.lat", "p.lon")


def near_pairs(df: DataFrame, radius_m: float = 200.0, id_col: str = "id", lat_col: str = "latitude", lon_col: str = "longitude", chunk: int = CELL_CHUNK) -> DataFrame:
    """All pairs ``(id_a, id_b, distance_m)``, ``id_a < id_b``, at most ``radius_m`` apart.

    Each point looks into its own row of cells (pairs kept in id order) and the next row to the
    north, so every pair of different cells is met once.
    """
    grid = Grid(radius_m)
    points = _points(df, id_col, lat_col, lon_col)
    lat, lon = F.col("lat"), F.col("lon")
    home = points.withColumn("cell", grid.home(lat, lon))
    own = F.transform(grid.reached(lat, lon, grid.row(lat)), lambda c: F.struct(c.alias("cell"), F.lit(True).alias("own")))
    north = F.transform(grid.reached(lat, lon, grid.row(lat) + 1), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("own")))
    asking = points.select(F.col("id").alias("q_id"), lat.alias("q_lat"), lon.alias("q_lon"), F.inline(F.concat(own, north)))
    home, asking = split_full_cells(home, asking, chunk)
    distance = great_circle_m(F.col("q_lat"), F.col("q_lon"), lat, lon)
    near = asking.join(home, ["cell", "part"]).filter((~F.col("own") | (F.col("q_id") < F.col("id"))) & (F.abs(F.col("q_lat") - lat) <= grid.step) & (distance <= radius_m))
    return near.select(F.least("q_id", "id").alias("id_a"), F.greatest("q_id", "id").alias("id_b"), distance.alias("distance_m"))


def near_points(points: DataFrame, origins: DataFrame, radius_m: float, id_col: str = "id", lat_col: str = "latitude", lon_col: str = "longitude", origin_col: str = "origin_id", chunk: int = CELL_CHUNK) -> DataFrame:
    """``(origin_id, id, distance_m)``: all points at most ``radius_m`` from each of any number of
    origins. Origins look into the cells of their own and both neighbouring rows."""
    grid = Grid(radius_m)
    lat, lon = F.col("lat"), F.col("lon")
    home = _points(points, id_col, lat_col, lon_col).withColumn("cell", grid.home(lat, lon))
    asked = _points(origins, origin_col, lat_col, lon_col)
    cells = F.concat(*[grid.reached(lat, lon, grid.row(lat) + k) for k in (-1, 0, 1)])
    asking = asked.select(F.col("id").alias("q_id"), lat.alias("q_lat"), lon.alias("q_lon"), F.explode(F.array_distinct(cells)).alias("cell"))
    home, asking = split_full_cells(home, asking, chunk)
    distance = great_circle_m(F.col("q_lat"), F.col("q_lon"), lat, lon)
    near = asking.join(home, ["cell", "part"]).filter((F.abs(F.col("q_lat") - lat) <= grid.step) & (distance <= radius_m))
    return near.select(F.col("q_id").alias("origin_id"), "id", distance.alias("distance_m"))


def _edges(regions: DataFrame, region_col: str, ring_col: str) -> DataFrame:
    """``(region_id, a_lat, a_lon, b_lat, b_lon)``: the edges of every ring, longitudes running on
    beyond 180 degrees where a ring crosses that meridian."""
    rings = regions.select(F.col(region_col).alias("region_id"), F.col(ring_col).alias("ring")).filter(F.size("ring") >= 3)
    # several rings of one id stay apart
    vertices = rings.withColumn("ring_no", F.monotonically_increasing_id()).select("region_id", "ring_no", F.posexplode("ring").alias("at", "v")).select("region_id", "ring_no", "at", F.col("v.lat").alias("lat"), F.col("v.lon").alias("lon"))
    order = Window.partitionBy("region_id", "ring_no").orderBy("at")
    jump = F.col("lon") - F.lag("lon").over(order)
    turned = vertices.withColumn("turn", F.when(jump > 180, -360.0).when(jump < -180, 360.0).otherwise(0.0))
    turned = turned.withColumn("lon", F.col("lon") + F.sum("turn").over(order)).drop("turn")
    whole = Window.partitionBy("region_id", "ring_no").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    return turned.select("region_id", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), after("lat").alias("b_lat"), after("lon").alias("b_lon")).filter("a_lat <> b_lat OR a_lon <> b_lon")


def _crossing(lat: Column, lon: Column) -> Column:
    """1 if a ray from the point to the east meets the edge, else 0 (even-odd rule)."""
    span = (F.col("a_lat") > lat) != (F.col("b_lat") > lat)
    at = (F.col("b_lon") - F.col("a_lon")) * F.try_divide(lat - F.col("a_lat"), F.col("b_lat") - F.col("a_lat")) + F.col("a_lon")
    return F.when(span & (lon < at), 1).otherwise(0)


def containing_regions(
    points: DataFrame, regions: DataFrame, cell_degrees: float = 0.25, id_col: str = "id", lat_col: str = "latitude", lon_col: str = "longitude", region_col: str = "region_id", ring_col: str = "ring"
) -> DataFrame:
    """``(id, region_id)`` for every point inside a region.

    A region is one ring, an array of ``struct(lat, lon)``, or several rows of rings; two neighbours
    more than 180 degrees of longitude apart are joined over the 180th meridian. Fewer than three
    vertices or null contain nothing, nor does a ring around a pole have a defined inside.

    Rings are taken apart: every edge goes to the rows of cells it passes. A cell that no edge
    touches is inside or outside as a whole, which its centre decides, and its points need no test;
    points of touched cells are tested against the edges of their row only. No ring is copied.
    """
    around = max(1, math.ceil(360 / cell_degrees))
    width, step = 360 / around, cell_degrees
    row_of = lambda lat: F.floor((lat + 90) / F.lit(step)).cast("long")
    col_of = lambda lon: F.floor((lon + 180) / F.lit(width)).cast("long")
    edges = _edges(regions, region_col, ring_col)
    low, high = F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat")
    edges = staged(edges.withColumn("row", F.explode(F.sequence(row_of(low), row_of(high)))), "region_edges")
    # the part of the edge inside its row, a little widened against rounding
    bottom, top = F.col("row") * step - 90, (F.col("row") + 1) * step - 90
    at = lambda lat: F.coalesce(F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * F.try_divide(lat - F.col("a_lat"), F.col("b_lat") - F.col("a_lat")), F.col("a_lon"))
    ends = [at(F.greatest(low, bottom)), at(F.least(high, top))]
    flat = low == high
    left = F.when(flat, F.least("a_lon", "b_lon")).otherwise(F.least(*ends)) - 1e-9
    right = F.when(flat, F.greatest("a_lon", "b_lon")).otherwise(F.greatest(*ends)) + 1e-9
    touched = staged(edges.select("region_id", "row", F.explode(F.sequence(col_of(left), col_of(right))).alias("col")).distinct(), "touched")
    spans = touched.groupBy("region_id", "row").agg(F.min("col").alias("first"), F.max("col").alias("last"))
    free = spans.select("region_id", "row", F.explode(F.sequence("first", "last")).alias("col")).join(touched, ["region_id", "row", "col"], "left_anti")
    centre = _crossing((F.col("row") + 0.5) * step - 90, (F.col("col") + 0.5) * width - 180)
    inner = free.join(edges, ["region_id", "row"]).groupBy("region_id", "row", "col").agg(F.sum(centre).alias("n")).filter("n % 2 = 1").drop("n")
    cells = inner.withColumn("whole", F.lit(True)).unionByName(touched.withColumn("whole", F.lit(False)))
    key = lambda row, col: F.shiftleft(row, 32) + F.pmod(col, F.lit(around))
    cells = cells.select("region_id", "row", "whole", key(F.col("row"), F.col("col")).alias("cell"), (F.floor(F.col("col") / around) * 360.0).alias("turn"))

    pts = _points(points, id_col, lat_col, lon_col)
    pts = pts.withColumn("cell", key(row_of(F.col("lat")), col_of(F.col("lon"))))
    pts, cells = split_full_cells(pts, cells, 1 << 16)
    met = pts.join(cells, ["cell", "part"]).select("id", "lat", (F.col("lon") + F.col("turn")).alias("lon"), "region_id", "row", "whole")
    tested = met.filter("NOT whole").join(edges, ["region_id", "row"]).groupBy("id", "region_id", "lon").agg(F.sum(_crossing(F.col("lat"), F.col("lon"))).alias("n")).filter("n % 2 = 1")
    return met.filter("whole").select("id", "region_id").unionByName(tested.select("id", "region_id")).distinct()
