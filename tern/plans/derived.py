"""Workload inputs derived by Spark from the driver's TPC-H-like tables.

The driver tables hold no JSON orders, highways or weather, so they are
derived here with integer arithmetic that DuckDB repeats exactly in the
oracles (SURVEY §7.3).  Everything is a projection or join of whole tables,
so the work grows with the scale factor.

Fixed values of the derivation (both engines must use the same):
* orders JSON: order_id = l_orderkey, custid = o_custkey,
  product_id = l_partkey, quantity = l_quantity as integer,
  order_total = l_extendedprice, purchase_date = date(o_orderdate)
* product stock = 500 + p_partkey % 501; stock date = 2001-08-01 minus
  (p_partkey % 90) days
* as_of of the six-month window: 2001-08-01 00:00:00
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tern.sources.tables import table

AS_OF = "2001-08-01 00:00:00"


def sales_orders_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders packed as one JSON VARIANT per line (``sales_data``)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return sales_orders_from(li, o)


def sales_orders_from(li: DataFrame, o: DataFrame, *keep: str) -> DataFrame:
    """The JSON orders of the given lineitem and orders rows, and columns to
    keep beside them."""
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    # Built straight into a VARIANT object (no JSON text round trip); the
    # value is the same as parse_json of the reference's JSON text.
    doc = F.to_variant_object(
        F.struct(
            F.col("l_orderkey").alias("order_id"),
            F.col("o_custkey").alias("custid"),
            F.struct(
                F.col("l_partkey").alias("product_id"),
                F.col("l_quantity").cast("int").alias("quantity"),
                F.col("l_extendedprice").cast("decimal(10,2)").alias("order_total"),
                F.date_format("o_orderdate", "yyyy-MM-dd").alias("purchase_date"),
            ).alias("purchase"),
        )
    )
    return j.select(doc.alias("sales_data"), *keep)


def sales_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cust_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("industry"),
    )


def sales_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        (F.lit(500) + F.col("p_partkey") % 501).cast("decimal(10,2)").alias("stock"),
        F.date_sub(F.lit("2001-08-01").cast("date"), (F.col("p_partkey") % 90).cast("int")).alias("stockdate"),
    )


# --------------------------------------------------------------------------
# Highways (from customer) and hourly weather (from events)
#
# Fixed values of the derivation, repeated in the DuckDB oracles:
#   city of user u:      lat = 25.0 + (u % 40) * 0.6 + ((u * 37) % 100) / 1000.0
#                        lon = -125.0 + ((u div 40) % 500) * 0.6 + ((u * 53) % 100) / 1000.0
#   city name:           'city_' || (u - 1 if u % 50 = 49 else u)   (two places, one name)
#   highway of customer c, anchored at city u = c div 10:
#     start:             the city point when c % 10 in (0, 5), else
#                        lat + ((c * 7919) % 401 - 200) / 1000.0,
#                        lon + ((c * 104729) % 401 - 200) / 1000.0
#     points:            2 + c % 39
#     vertex k:          lat0 + k * ((c * 31) % 21 - 10) / 2000.0 + ((k * c) % 7) / 10000.0
#                        lon0 + k * ((c * 17) % 21 - 10) / 2000.0 + ((k * c * 3) % 5) / 10000.0
#     wide lines:        two points each, when c % 194 = 50 across the antimeridian:
#                        (179.9, 10 + (c % 40) / 100), (-179.9, 10.2 + (c * 7) % 40 / 100); when
#                        c % 194 = 147 a long arc: (-20 + (c % 10) / 2, 55), (20 - (c * 3) % 10 / 2, 55 + (c % 3) / 5)
#     geometry:          NULL when c % 101 = 100; MultiLineString when c % 7 = 3, second
#                        part [(lon0 + 0.01, lat0 - 0.01), (lon0 + 0.02, lat0 + 0.005)];
#                        else LineString
#     document:          c div 8, features in the order of c; no feature when c % 23 = 0
#     properties:        OBJECTID c, or c - 1 when c % 11 = 10 (two features share it), FILE_NAME 'nhs_' || c_nationkey || '.geojson',
#                        MILES (c % 500) / 100, AADT (c * 97) % 200000,
#                        SPEED_LIMI 0 when c % 13 = 0 else 25 + (c % 9) * 5,
#                        YEAR NULL when c % 17 = 0 else 2010 + c % 12, SIGN1 'I' || (c % 99 + 1)
#   weather row of event e (user u):
#     datetime ts; precipitation_type 1 for 'purchase', 2 for 'error', else 0
#     precipitation_lwe (e * 7919) % 1000003 / 1000000; rain_lwe the same when type 1 else 0
#     minutes_of_precipitation e % 61; minutes_of_rain the same when type 1 else 0
#     temperature 30 + e % 70 + (e * 31) % 1000 / 1000; humidity_relative (e * 7) % 101 + (e * 13) % 9973 / 10000
#     wind_speed e % 30 + (e * 3) % 977 / 1000; wind_gust e % 30 + e % 11
# --------------------------------------------------------------------------


def _city_lat(u):
    return F.lit(25.0) + (u % 40) * F.lit(0.6) + ((u * 37) % 100) / F.lit(1000.0)


def _city_lon(u):
    return F.lit(-125.0) + ((F.floor(u / 40)) % 500) * F.lit(0.6) + ((u * 53) % 100) / F.lit(1000.0)


def _city_name(u):
    return F.concat(F.lit("city_"), F.when(u % 50 == 49, u - 1).otherwise(u).cast("string"))


def highway_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c`` and the GeoJSON text of its feature (null: none)."""
    # the table is small, its features are not: more tasks than its files give
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    cust = cust.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    c = F.col("c_custkey")
    u = F.floor(c / 10)
    near = (c % 10 == 0) | (c % 10 == 5)
    lat0 = F.when(near, _city_lat(u)).otherwise(_city_lat(u) + ((c * 7919) % 401 - 200) / F.lit(1000.0))
    lon0 = F.when(near, _city_lon(u)).otherwise(_city_lon(u) + ((c * 104729) % 401 - 200) / F.lit(1000.0))
    npts = F.when(c % 97 == 50, 2).otherwise(F.lit(2) + c % 39).cast("int")
    dlat = ((c * 31) % 21 - 10) / F.lit(2000.0)
    dlon = ((c * 17) % 21 - 10) / F.lit(2000.0)
    coords = F.transform(
        F.sequence(F.lit(0), npts - 1),
        lambda k: F.array(
            lon0 + k * dlon + ((k * c * 3) % 5) / F.lit(10000.0),
            lat0 + k * dlat + ((k * c) % 7) / F.lit(10000.0),
        ),
    )
    point = lambda lon, lat: F.array(lon.cast("double"), lat.cast("double"))
    hundred, two = F.lit(100.0), F.lit(2.0)
    across = F.array(point(F.lit(179.9), F.lit(10.0) + (c % 40) / hundred), point(F.lit(-179.9), F.lit(10.2) + ((c * 7) % 40) / hundred))
    long_arc = F.array(point(F.lit(-20.0) + (c % 10) / two, F.lit(55.0)), point(F.lit(20.0) - ((c * 3) % 10) / two, F.lit(55.0) + (c % 3) / F.lit(5.0)))
    coords = F.when(c % 194 == 50, across).when(c % 194 == 147, long_arc).otherwise(coords)
    second = F.array(
        F.array(lon0 + F.lit(0.01), lat0 - F.lit(0.01)),
        F.array(lon0 + F.lit(0.02), lat0 + F.lit(0.005)),
    )
    geom = (
        F.when(c % 101 == 100, F.lit("null"))
        .when(c % 7 == 3, F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.array(coords, second).alias("coordinates"))))
        .otherwise(F.to_json(F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates"))))
    )
    props = F.to_json(
        F.struct(
            F.when(c % 11 == 10, c - 1).otherwise(c).alias("OBJECTID"),
            F.concat(F.lit("nhs_"), F.col("c_nationkey").cast("string"), F.lit(".geojson")).alias("FILE_NAME"),
            ((c % 500).cast("decimal(10,2)") / 100).cast("decimal(10,2)").alias("MILES"),
            ((c * 97) % 200000).alias("AADT"),
            F.when(c % 13 == 0, F.lit(0)).otherwise(25 + (c % 9) * 5).alias("SPEED_LIMI"),
            F.when(c % 17 == 0, F.lit(None)).otherwise(2010 + c % 12).alias("YEAR"),
            F.concat(F.lit("I"), (c % 99 + 1).cast("string")).alias("SIGN1"),
        ),
        {"ignoreNullFields": "false"},
    )
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), geom, F.lit(',"properties":'), props, F.lit("}"))
    return cust.select(c.alias("c"), F.when(c % 23 != 0, feature).alias("feature"))


def highway_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON FeatureCollection texts with the features of eight customers
    each (the staged files); the document's number is in the text too."""
    rows = highway_features(spark, sf_dir).select(F.floor(F.col("c") / 8).cast("long").alias("doc_id"), "c", "feature")
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("c", "feature"))).alias("f"))  # eight at most
    features = F.array_join(F.transform("f", lambda x: x["feature"]), ",")
    doc = F.concat(F.lit('{"type":"FeatureCollection","document":'), F.col("doc_id").cast("string"), F.lit(',"features":['), features, F.lit("]}"))
    return docs.select("doc_id", doc.alias("raw_text"))


def write_large_documents(spark: SparkSession, sf_dir: str, folder: str, documents: int = 8) -> None:
    """The same features as a few large FeatureCollections, that of customer c
    in document ``c % documents``, in the order of c.  A document is one file's
    (a file may have several), so it is written by one task, line by line, and
    each by its own."""
    rows = highway_features(spark, sf_dir).where("feature is not null").withColumn("d", F.col("c") % documents)
    ends = rows.groupBy("d").agg(F.min("c").alias("first"), F.max("c").alias("last"))
    head = F.when(F.col("c") == F.col("first"), F.concat(F.lit('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"a } in text"}},"features":['))).otherwise(",")
    line = F.concat(head, "feature", F.when(F.col("c") == F.col("last"), "]}").otherwise(""))
    rows.join(ends, "d").select("d", "c", line.alias("value")).repartitionById(documents, F.col("d").cast("int")).sortWithinPartitions("d", "c").select("value").write.text(folder)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather rows (the shared weather table) derived from events."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e, u = F.col("event_id"), F.col("user_id")
    ptype = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 2).otherwise(0)
    precip = ((e * 7919) % 1000003) / F.lit(1000000.0)
    minutes = (e % 61).cast("double")
    return ev.select(
        _city_name(u).alias("city_name"),
        _city_lat(u).alias("latitude"),
        _city_lon(u).alias("longitude"),
        F.col("ts").alias("datetime"),
        ((e * 7) % 101 + ((e * 13) % 9973) / F.lit(10000.0)).alias("humidity_relative"),
        minutes.alias("minutes_of_precipitation"),
        F.when(ptype == 1, minutes).otherwise(F.lit(0.0)).alias("minutes_of_rain"),
        precip.alias("precipitation_lwe"),
        ptype.alias("precipitation_type"),
        F.when(ptype == 1, precip).otherwise(F.lit(0.0)).alias("rain_lwe"),
        (F.lit(30) + e % 70 + ((e * 31) % 1000) / F.lit(1000.0)).alias("temperature"),
        ((e % 30) + (e % 11)).cast("double").alias("wind_gust"),
        (e % 30 + ((e * 3) % 977) / F.lit(1000.0)).alias("wind_speed"),
    )
