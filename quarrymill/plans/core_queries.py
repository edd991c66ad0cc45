"""Registered queries of the core, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import packed_values, proximity
from quarrymill.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return register


@query(
    """
    WITH p AS (SELECT DISTINCT id, latitude AS lat, longitude AS lon FROM locations
               WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)
                 AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0))
    SELECT a.id AS id_a, b.id AS id_b FROM p a JOIN p b ON a.id < b.id AND b.lat BETWEEN a.lat - 0.0018 AND a.lat + 0.0018
    WHERE 2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
          + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 200
    """
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of locations at most 200 m apart."""
    return proximity.near_pairs(table(spark, sf_dir, "locations"), 200.0).select("id_a", "id_b")


@query(
    """
    WITH p AS (SELECT DISTINCT id, latitude AS lat, longitude AS lon FROM locations
               WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)
                 AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0))
    SELECT id, 1 AS region_id FROM p WHERE lat > 52 AND lat < 53 AND lon > 13 AND lon < 13.5 + (lat - 52) * 0.5
    UNION ALL
    SELECT id, 2 AS region_id FROM p WHERE lat > 40 AND lat < 60 AND lon > 0 AND lon < 30
    """
)
def p1_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations inside each of two regions, a trapezium and a rectangle."""
    rings = [(1, [(52.0, 13.0), (52.0, 13.5), (53.0, 14.0), (53.0, 13.0)]), (2, [(40.0, 0.0), (40.0, 30.0), (60.0, 30.0), (60.0, 0.0)])]
    regions = spark.createDataFrame(rings, "region_id int, ring array<struct<lat:double,lon:double>>")
    return proximity.containing_regions(table(spark, sf_dir, "locations"), regions, cell_degrees=1.0)


@query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per synonym with its place in the field; gazetteer names are the dictionary."""
    places = table(spark, sf_dir, "locations")
    return packed_values.split_packed(places, places.select("name").distinct())


@query()
def p7_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but values that any field quotes with separators inside keep them in every field."""
    places = table(spark, sf_dir, "locations")
    quoted = packed_values.quoted_values(places, "synonyms")
    return packed_values.split_packed(places, quoted, run=6)
