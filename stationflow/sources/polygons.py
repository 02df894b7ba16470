"""GeoJSON boundaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.functions.rules import require

_RINGS = "array<array<array<double>>>"


def polygons_column(geojson: str) -> Column:
    """array<polygon>, a polygon being array<ring>, a ring array<[lon, lat]>; first ring outer, others holes."""
    kind = json.loads(geojson).get("type")
    require(kind in ("Polygon", "MultiPolygon"), f"a boundary is a Polygon or MultiPolygon, not {kind}")
    shape = _RINGS if kind == "Polygon" else f"array<{_RINGS}>"
    coordinates = F.from_json(F.lit(geojson), f"coordinates {shape}")["coordinates"]
    return F.array(coordinates) if kind == "Polygon" else coordinates


def polygon_vertices(spark: SparkSession, geojson: str) -> DataFrame:
    """(poly_id, ring_id, is_hole, seq, lon, lat)."""
    polygons = spark.range(1).select(F.posexplode(polygons_column(geojson)).alias("poly_id", "rings"))
    rings = polygons.select("poly_id", F.posexplode("rings").alias("ring_id", "ring"))
    points = rings.select("poly_id", "ring_id", F.posexplode("ring").alias("seq", "point"))
    return points.select(
        "poly_id",
        "ring_id",
        (F.col("ring_id") > 0).alias("is_hole"),
        "seq",
        F.col("point")[0].alias("lon"),
        F.col("point")[1].alias("lat"),
    )
