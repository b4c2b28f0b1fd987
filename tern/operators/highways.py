"""GeoJSON ingest and the spatial queries on highway segments
(S3, J8, P7, F15, F16, J4, J5, J6, A8, A10).

``national_highway_system`` rows carry a surrogate key ``fid``, the text
``document:position``, because nothing makes OBJECTID unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tern.functions import geo, variant
from tern.operators import spatial_join
from tern.session import materialize

# The reference's search radii (10 and 20 miles, in meters).
TEN_MILES_M = 16093.4
TWENTY_MILES_M = 32186.9


def flatten_features(staging: DataFrame, doc_id: str = "doc_id", raw: str = "raw_data") -> DataFrame:
    """``LATERAL FLATTEN(raw_data:features)``: one row per feature."""
    return variant.flatten(staging, raw, "$.features").select(doc_id, "pos", "value")


def national_highway_system(staging: DataFrame, doc_id: str = "doc_id", raw: str = "raw_data", strict: bool = True) -> DataFrame:
    """The typed segments table (``create table national_highway_system``)."""
    f = flatten_features(staging, doc_id, raw)
    fid = F.concat_ws(":", F.col(doc_id).cast("string"), F.col("pos").cast("string"))
    return segments(f.select(fid.alias("fid"), F.col(doc_id).alias("doc_id"), "pos", "value"), "fid", "doc_id", "pos", strict=strict)


def segments(features: DataFrame, *keys: str, strict: bool = True) -> DataFrame:
    """Typed columns of single features (``value``), after the ``keys``."""
    v = F.col("value")
    f = features.withColumn("_geometry", variant.get(v, "$.geometry", "variant", strict))
    geog = geo.to_geography("_geometry", strict)
    return f.select(
        *keys,
        variant.get(v, "$.properties.OBJECTID", "int", strict).alias("object_id"),
        variant.get(v, "$.properties.FILE_NAME", "string", strict).alias("file_name"),
        variant.get(v, "$.properties.MILES", "decimal(38,2)", strict).alias("miles"),
        variant.get(v, "$.properties.AADT", "int", strict).alias("average_annual_daily_traffic"),
        variant.get(v, "$.properties.SPEED_LIMI", "int", strict).alias("speed_limit"),
        variant.get(v, "$.properties.YEAR", "int", strict).alias("year"),
        variant.get(v, "$.properties.SIGN1", "string", strict).alias("sign1"),
        geog.alias("geography_linestring"),
        v.alias("raw_json"),
    ).withColumn("geojson", geo.as_geojson("geography_linestring"))


def distinct_cities(weather: DataFrame) -> DataFrame:
    """``SELECT DISTINCT city_name, latitude, longitude`` (A10)."""
    return weather.select("city_name", "latitude", "longitude").distinct()


def highway_subset(cities: DataFrame, highways: DataFrame, meters: float = TEN_MILES_M) -> DataFrame:
    """``national_highway_system_subset``: every (city, segment) within
    ``meters`` (J4), with the city columns then all segment columns."""
    keys = ["city_name", "latitude", "longitude"]
    pairs = spatial_join.dwithin_pairs(cities, keys, highways, ["fid"], meters)
    return pairs.join(highways, "fid", "inner").select(*keys, *highways.columns)


def city_intersections(highways: DataFrame, cities: DataFrame, meters: float = TEN_MILES_M) -> DataFrame:
    """Intersections per city (J6 + A8): ordered pairs (t1, t2) of segments
    that intersect with different object_id, t1 within ``meters`` of the city;
    counted per city name, most first.

    The city restriction is applied to t1 first: the self-join tests pairs of
    which one is near a city.  A segment's pairs are counted before they meet its
    cities, so no pair is repeated for each of them.
    """
    keys = ["city_name", "latitude", "longitude"]
    near = materialize(spatial_join.dwithin_pairs(cities, keys, highways, ["fid"], meters).select("city_name", "fid"), "near")
    pairs = spatial_join.intersects_pairs(highways, "fid", "object_id", left=near)
    counts = pairs.groupBy(F.col("fid_1").alias("fid")).agg(F.count(F.lit(1)).alias("_pairs"))
    return (
        near.join(counts, "fid", "inner")
        .groupBy("city_name")
        .agg(F.sum("_pairs").alias("intersection_cnt"))
        .orderBy(F.col("intersection_cnt").desc(), F.col("city_name"))
    )
