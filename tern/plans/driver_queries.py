"""The reference's workloads expressed on the driver tables.

Each function reads the given tables (or data Spark derives from them) in
full, so its work grows with the scale factor.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tern.functions import dialect
from tern.operators import tpch
from tern.plans.registry import register
from tern.session import materialize, scratch_path
from tern.sources import datagen, files, geojson
from tern.sources.tables import table

# --------------------------------------------------------------------------
# W1  TPC-H
# --------------------------------------------------------------------------


@register(
    "lineitem_count",
    oracle="SELECT count(*) AS row_count FROM lineitem",
)
def lineitem_count(spark: SparkSession, sf_dir: str):
    return tpch.row_count(table(spark, sf_dir, "lineitem"))


@register(
    "tpch_q1",
    oracle="""
SELECT l_returnflag, l_linestatus,
       CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS sum_base_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))) AS DECIMAL(38,4)) AS sum_disc_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))
                * (1 + CAST(l_tax AS DECIMAL(15,2)))) AS DECIMAL(38,6)) AS sum_charge,
       CAST(avg(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(38,6)) AS avg_qty,
       CAST(avg(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,6)) AS avg_price,
       CAST(avg(CAST(l_discount AS DECIMAL(15,2))) AS DECIMAL(38,6)) AS avg_disc,
       count(*) AS count_order
FROM lineitem
WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL 90 DAY
GROUP BY l_returnflag, l_linestatus
ORDER BY l_returnflag, l_linestatus
""",
)
def tpch_q1(spark: SparkSession, sf_dir: str):
    return tpch.q1(table(spark, sf_dir, "lineitem"))


# --------------------------------------------------------------------------
# W3  sales tables from JSON orders
# --------------------------------------------------------------------------

from tern.functions import variant  # noqa: E402
from tern.operators import sales  # noqa: E402
from tern.plans import derived  # noqa: E402
from tern.plans import oracle as O  # noqa: E402


def _customer_orders(spark, sf_dir, materialized=False):
    """``customer_orders`` from the JSON orders.  ``materialized`` writes it
    first (the reference keeps it as a table), for queries that read it more
    than once."""
    co = sales.customer_orders(derived.sales_customers(spark, sf_dir), derived.sales_orders_json(spark, sf_dir))
    return materialize(co, "customer-orders") if materialized else co


def _sales_report(spark, sf_dir, with_days=True):
    co = _customer_orders(spark, sf_dir, materialized=with_days)
    return sales.sales_report(co, derived.sales_products(spark, sf_dir), with_days)


def _cumulative(spark, sf_dir):
    return sales.cumulative_purchases(_sales_report(spark, sf_dir, False), derived.AS_OF)


def _alert(spark, sf_dir):
    return sales.product_inventory_alert(
        _sales_report(spark, sf_dir, False), derived.sales_products(spark, sf_dir), with_creation_time=False
    )


@register("variant_extract", oracle=O.VARIANT_EXTRACT)
def variant_extract(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    v = variant.parse("props")
    return ev.select(
        "event_id",
        "event_type",
        variant.get(v, "$.k", "int").alias("k"),
        variant.get(v, "$.missing", "int").alias("k_missing"),
        variant.get(v, "$.k", "string").alias("k_text"),
    )


@register("customer_orders", oracle=O.CUSTOMER_ORDERS)
def customer_orders(spark, sf_dir):
    return _customer_orders(spark, sf_dir)


@register("sales_report", oracle=O.SALES_REPORT)
def sales_report(spark, sf_dir):
    return _sales_report(spark, sf_dir)


@register("cumulative_purchases", oracle=O.CUMULATIVE_PURCHASES)
def cumulative_purchases(spark, sf_dir):
    return _cumulative(spark, sf_dir)


@register("top_customers", oracle=O.TOP_CUSTOMERS)
def top_customers(spark, sf_dir):
    return sales.top_customers(_cumulative(spark, sf_dir), 15)


@register("running_units", oracle=O.RUNNING_UNITS)
def running_units(spark, sf_dir):
    return sales.running_units(_sales_report(spark, sf_dir, False))


@register("running_units_by_sale", oracle=O.RUNNING_UNITS_BY_SALE)
def running_units_by_sale(spark, sf_dir):
    report = _sales_report(spark, sf_dir, False).select(*sales.SALE)  # only what the running total reads is written
    return sales.running_units_by_sale(materialize(report, "sales-report"))


@register("cumulative_as_of_dates", oracle=O.CUMULATIVE_AS_OF_DATES)
def cumulative_as_of_dates(spark, sf_dir):
    """D3 for three moments: the first from daily totals, the others by moving
    the bound, once forward and once back."""
    report = materialize(_sales_report(spark, sf_dir, False), "sales-report")
    daily, last = materialize(sales.daily_purchases(report), "daily"), materialize(sales.last_purchases(report), "last")
    start, *others = O.AS_OF_DATES
    parts = materialize(sales.purchases_since(daily, last, dialect.months_before(start, 6)), "purchases")
    out, at = [sales.cumulative_of(parts).withColumn("as_of", F.lit(start))], start
    for to in others:
        parts = materialize(sales.moved_purchases(parts, daily, last, at, to), "purchases")
        out, at = [*out, sales.cumulative_of(parts).withColumn("as_of", F.lit(to))], to
    return reduce(DataFrame.unionByName, out)


@register("sales_report_after_late_orders", oracle=O.SALES_REPORT)
def sales_report_after_late_orders(spark, sf_dir):
    """Every seventh order arrives after the report was made."""
    co = _customer_orders(spark, sf_dir, materialized=True)
    products = derived.sales_products(spark, sf_dir)
    late = F.col("order_id") % 7 == 3
    report = materialize(sales.sales_report(co.where(~late), products), "sales-report")
    return sales.report_after(report, materialize(sales.sales_report(co.where(late), products, False), "late-sales"))


@register("latest_sales", oracle=O.LATEST_SALES)
def latest_sales(spark, sf_dir):
    return sales.latest_sales(_sales_report(spark, sf_dir, False))


@register("inventory_alert", oracle=O.INVENTORY_ALERT)
def inventory_alert(spark, sf_dir):
    return _alert(spark, sf_dir)


@register("low_stock", oracle=O.LOW_STOCK)
def low_stock(spark, sf_dir):
    return sales.low_stock(_alert(spark, sf_dir), 10)


# --------------------------------------------------------------------------
# W4/W5  highways, spatial joins, weather and report
# --------------------------------------------------------------------------

from tern.functions import geo  # noqa: E402
from tern.operators import highways, report, spatial_join, weather  # noqa: E402


_SEGMENT = ("fid", "object_id", "geography_linestring")


def _highways(spark, sf_dir, *columns):
    """``create table national_highway_system as …``: built once per query and
    written as Parquet in the shared folder, as the reference materializes it;
    only the columns the query reads are built."""
    docs = derived.highway_documents(spark, sf_dir)
    staging = docs.select("doc_id", variant.parse("raw_text").alias("raw_data"))
    hw = highways.national_highway_system(staging)
    return materialize(hw.select(*dict.fromkeys((*_SEGMENT, *columns))), "highways")


def _weather(spark, sf_dir):
    return derived.weather(spark, sf_dir)


def _cities(spark, sf_dir):
    return highways.distinct_cities(_weather(spark, sf_dir))


def _subset(spark, sf_dir, *columns, meters=highways.TEN_MILES_M):
    return highways.highway_subset(_cities(spark, sf_dir), _highways(spark, sf_dir, *columns), meters)


_FEATURE = ["doc_id", "pos", "object_id", "file_name", "miles", "average_annual_daily_traffic", "speed_limit", "year", "sign1"]


@register("flatten_features", oracle=O.FLATTEN_FEATURES)
def flatten_features(spark, sf_dir):
    hw = _highways(spark, sf_dir, *_FEATURE)
    return hw.select(*_FEATURE, F.col("geography_linestring.type").alias("geom_type"))


@register("load_json_files", oracle=O.FLATTEN_FEATURES)
def load_json_files(spark, sf_dir):
    """The documents landed as JSON files, found by listing, loaded into a
    VARIANT and flattened (S3, S4, J8).  A malformed record fails the load."""
    landing = scratch_path(spark, "landing")
    derived.highway_documents(spark, sf_dir).select("raw_text").write.text(landing)
    listed = files.list_files(spark, landing, "part-*")
    loaded = files.load_json_variant(spark, landing, multiline=False).where(F.lit(not listed.isEmpty()))
    staging = loaded.select(variant.get("raw_data", "$.document", "long").alias("doc_id"), "raw_data")
    hw = highways.national_highway_system(staging)
    return hw.select(*_FEATURE, F.col("geography_linestring.type").alias("geom_type"))


@register("split_features", oracle=O.SPLIT_FEATURES)
def split_features(spark, sf_dir):
    """A few large FeatureCollections, each read by several tasks (S3)."""
    landing = scratch_path(spark, "large-landing")
    derived.write_large_documents(spark, sf_dir, landing)
    split = geojson.split_of(files.list_files(spark, landing, "part-*").agg(F.sum("size")).first()[0] or 0)
    found = geojson.features(spark, landing, split_bytes=split, chunk=split // 4)
    hw = highways.segments(found.withColumn("fid", F.concat_ws(":", "file", "document", "pos")), "fid", "pos")
    return hw.select(*_FEATURE[1:], F.col("geography_linestring.type").alias("geom_type"))


@register("ingest_quarantine", oracle=O.INGEST_QUARANTINE)
def ingest_quarantine(spark, sf_dir):
    """The documents as JSON lines, some cut off, through the stream that keeps
    malformed records apart (S5)."""
    root = scratch_path(spark, "ingest")
    docs = derived.highway_documents(spark, sf_dir)
    cut = F.expr("substring(raw_text, 1, length(raw_text) - 2)")
    docs.select(F.when(F.col("doc_id") % 9 == 4, cut).otherwise(F.col("raw_text"))).write.text(f"{root}/landing")
    where = [f"{root}/{x}" for x in ("landing", "good", "malformed")]
    for _ in range(2):  # the second start finds no new file
        files.ingest_with_quarantine(spark, *where, f"{root}/checkpoint").awaitTermination()
    good = spark.read.parquet(where[1]).select(F.lit("good").alias("kind"), variant.get("raw_data", "$.document", "long").alias("d"))
    number = F.regexp_extract("record", '"document":([0-9]+)', 1).cast("long")
    bad = spark.read.parquet(where[2]).where("byte_offset >= 0").select(F.lit("malformed").alias("kind"), number.alias("d"))
    return good.unionByName(bad).groupBy("kind").agg(F.count(F.lit(1)).alias("documents"), F.sum("d").alias("document_sum"))


@register("geojson_roundtrip", oracle=O.GEOJSON_ROUNDTRIP)
def geojson_roundtrip(spark, sf_dir):
    hw = _highways(spark, sf_dir, "geojson").where(F.col("geography_linestring").isNotNull())
    g = F.col("geography_linestring")
    back = geo.to_geography(variant.parse("geojson"))
    return hw.select(
        "fid",
        g["type"].alias("geom_type"),
        F.size(g["parts"]).alias("n_parts"),
        F.aggregate(g["parts"], F.lit(0), lambda acc, p: acc + F.size(p)).alias("n_vertices"),
        (back == g).alias("roundtrip_equal"),
    )


@register("path_thinning", oracle=O.PATH_THINNING)
def path_thinning(spark, sf_dir):
    hw = report.with_paths(_highways(spark, sf_dir, "geojson"))
    p = F.col("path")
    return hw.select(
        "fid",
        F.size(F.col("geography_linestring.parts")[0]).alias("n_points"),
        F.size(p).alias("n_path"),
        p[0][0].alias("first_lon"),
        p[0][1].alias("first_lat"),
        F.element_at(p, -1)[0].alias("last_lon"),
        F.element_at(p, -1)[1].alias("last_lat"),
    )


_SUB_COLS = ["city_name", "latitude", "longitude", "fid", "object_id", "miles", "speed_limit"]


@register("geo_dwithin", oracle=O.GEO_DWITHIN)
def geo_dwithin(spark, sf_dir):
    return _subset(spark, sf_dir, "miles", "speed_limit").select(*_SUB_COLS)


@register("geo_dwithin_20mi", oracle=O.GEO_DWITHIN_20MI)
def geo_dwithin_20mi(spark, sf_dir):
    return _subset(spark, sf_dir, "miles", "speed_limit", meters=highways.TWENTY_MILES_M).select(*_SUB_COLS)


@register("geo_dwithin_radii", oracle=O.GEO_DWITHIN_RADII)
def geo_dwithin_radii(spark, sf_dir):
    """Segments within each city's own radius, 10 m to 1,000 km."""
    kinds = F.pmod(F.length("city_name") + F.floor(F.col("latitude") * 1000).cast("long"), F.lit(6)).cast("int")
    cities = _cities(spark, sf_dir).withColumn("radius", F.element_at(F.array(*[F.lit(r) for r in O.RADII]), kinds + 1))
    hw = _highways(spark, sf_dir)
    return spatial_join.dwithin_radius_pairs(cities, ["city_name", "latitude", "longitude", "radius"], "radius", hw, ["fid"])


@register("geo_intersects", oracle=O.GEO_INTERSECTS)
def geo_intersects(spark, sf_dir):
    hw = _highways(spark, sf_dir)
    return spatial_join.intersects_pairs(hw, "fid", "object_id")


@register("city_intersections", oracle=O.CITY_INTERSECTIONS)
def city_intersections(spark, sf_dir):
    return highways.city_intersections(_highways(spark, sf_dir), _cities(spark, sf_dir))


@register("rain_by_city_hour", oracle=O.RAIN_BY_CITY_HOUR)
def rain_by_city_hour(spark, sf_dir):
    return weather.rain_by_city_hour(_weather(spark, sf_dir), _highways(spark, sf_dir))


@register("weather_summary_left_join", oracle=O.WEATHER_SUMMARY_LEFT_JOIN)
def weather_summary_left_join(spark, sf_dir):
    sub = _subset(spark, sf_dir, "miles", "speed_limit", "average_annual_daily_traffic", "geojson")
    out = weather.highways_with_weather(sub, _weather(spark, sf_dir), *O._HOURS)
    return out.select(
        "city_name", "fid", "object_id", "miles", "speed_limit", "average_annual_daily_traffic", "aadt_value",
        "latest_date", "avg_humidity", "total_precipitation", "total_precip_minutes", "avg_temperature", "avg_wind_speed",
    )


@register("hourly_trends", oracle=O.HOURLY_TRENDS)
def hourly_trends(spark, sf_dir):
    return weather.hourly_trends(_weather(spark, sf_dir)).withColumn("hour_of_day", F.col("hour_of_day").cast("int"))


@register("hourly_rows_of_city", oracle=O.HOURLY_ROWS)
def hourly_rows_of_city(spark, sf_dir):
    return weather.hourly_rows(_weather(spark, sf_dir), *O._HOURS, city=O.CITY)


@register("hourly_trends_of_city", oracle=O.HOURLY_TRENDS_OF_CITY)
def hourly_trends_of_city(spark, sf_dir):
    out = weather.hourly_trends(_weather(spark, sf_dir), *O._HOURS, city=O.CITY)
    return out.withColumn("hour_of_day", F.col("hour_of_day").cast("int"))


@register("empty_reports", oracle=O.EMPTY_REPORTS)
def empty_reports(spark, sf_dir):
    """The report's stop where a city has no rows (A18), for two cities."""
    found = {c: report.is_empty(weather.hourly_rows(_weather(spark, sf_dir), *O._HOURS, city=c)) for c in (O.CITY, O.NO_CITY)}
    return spark.createDataFrame(list(found.items()), "city_name string, is_empty boolean")


@register("weather_of_city", oracle=O.WEATHER_OF_CITY)
def weather_of_city(spark, sf_dir):
    return weather.weather_summary(_weather(spark, sf_dir), *O._HOURS, city=O.CITY)


@register("fill_for_display", oracle=O.FILL_FOR_DISPLAY)
def fill_for_display(spark, sf_dir):
    """The left join's rows as the report shows them: missing text 'N/A',
    missing numbers 0, dates as text."""
    sub = _subset(spark, sf_dir, "miles", "year")
    joined = weather.highways_with_weather(sub.withColumns({"geojson": F.lit(None).cast("string"), "average_annual_daily_traffic": F.lit(None).cast("int")}),
                                           _weather(spark, sf_dir), *O._HOURS)
    return report.fill_for_display(joined.select("city_name", "fid", "miles", "year", "average_annual_daily_traffic", "latest_date", "avg_temperature"))


@register("trend_summary", oracle=O.TREND_SUMMARY)
def trend_summary(spark, sf_dir):
    return weather.trend_summary(weather.hourly_trends(_weather(spark, sf_dir)))


@register("segment_kpis", oracle=O.SEGMENT_KPIS)
def segment_kpis(spark, sf_dir):
    return report.segment_kpis(_subset(spark, sf_dir, "miles", "speed_limit", "year"))


@register("speed_stats", oracle=O.SPEED_STATS)
def speed_stats(spark, sf_dir):
    return report.speed_stats(_subset(spark, sf_dir, "speed_limit"))


@register("miles_histogram", oracle=O.MILES_HISTOGRAM)
def miles_histogram(spark, sf_dir):
    return report.histogram(_subset(spark, sf_dir, "miles"), "miles", 0.05, scale=2)


@register("speed_histogram", oracle=O.SPEED_HISTOGRAM)
def speed_histogram(spark, sf_dir):
    return report.histogram(_subset(spark, sf_dir, "speed_limit"), "speed_limit", 5)


@register("miles_auto_histogram", oracle=O.MILES_AUTO_HISTOGRAM)
def miles_auto_histogram(spark, sf_dir):
    sub = materialize(_subset(spark, sf_dir, "miles").select("city_name", "miles"), "subset-miles")
    return report.auto_histogram(sub, "miles", scale=2)


@register("speed_auto_histogram", oracle=O.SPEED_AUTO_HISTOGRAM)
def speed_auto_histogram(spark, sf_dir):
    sub = materialize(_subset(spark, sf_dir, "speed_limit").select("city_name", "speed_limit"), "subset-speed")
    return report.auto_histogram(sub, "speed_limit")


@register("payload_estimate", oracle=O.PAYLOAD_ESTIMATE)
def payload_estimate(spark, sf_dir):
    return report.payload_estimate(report.with_paths(_subset(spark, sf_dir, "geojson")))


# --------------------------------------------------------------------------
# W2  copy / update / promote
# --------------------------------------------------------------------------

from tern.sources import catalog  # noqa: E402


@register("identity_rows", oracle=O.IDENTITY_ROWS)
def identity_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns({c: F.col(c).cast("decimal(15,2)") for c in O.LINE_AMOUNTS})
    return catalog.with_identity(li, "line_id", start=1, order_by=li.columns)


@register(
    "unique_check",
    oracle="""
SELECT l_orderkey, l_linenumber, count(*) AS occurrences
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""",
)
def unique_check(spark, sf_dir):
    return catalog.check_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "update_rows",
    oracle="""
SELECT c_custkey, c_name, c_mktsegment, c_acctbal * 12 AS c_acctbal FROM customer
""",
)
def update_rows(spark, sf_dir):
    """The rows of the update (x 12); clone, promote and swap are catalog
    statements around it (``tern.sources.catalog``, tests/test_catalog.py)."""
    dev = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return catalog.updated(dev, {"c_acctbal": F.col("c_acctbal") * 12})


@register(
    "clone_update_swap",
    oracle="""
SELECT 'production' AS copy, c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 12 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT 'development', c_custkey, c_name, c_acctbal FROM customer
""",
)
def clone_update_swap(spark, sf_dir):
    """The workload as tables: create, clone, update the clone, swap both, read
    both, drop (S9, S10, S14-S18)."""
    db = f"tern_{uuid.uuid4().hex}"
    catalog.create_database(spark, db)
    prod, dev = f"{db}.customers", f"{db}.customers_dev"
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    catalog.create_table_as(rows, prod, order_by=["c_custkey"])
    catalog.clone_table(spark, prod, dev)
    catalog.update_table(spark, dev, {"c_acctbal": F.col("c_acctbal") * 12}, where=F.col("c_mktsegment") == "BUILDING")
    catalog.swap_tables(spark, dev, prod)
    both = [spark.table(t).select(F.lit(k).alias("copy"), "c_custkey", "c_name", "c_acctbal") for k, t in (("production", prod), ("development", dev))]
    out = materialize(both[0].unionByName(both[1]), "copies")
    for t in (prod, dev):
        catalog.drop_table(spark, t)
    spark.sql(f"DROP DATABASE {db}")
    return out


@register("landing_listing", oracle="SELECT CAST(sum(strlen(p_name) + 1) AS BIGINT) AS bytes FROM part")
def landing_listing(spark, sf_dir):
    """Sizes of landed files from their listing, contents unread."""
    landing = scratch_path(spark, "listing")
    table(spark, sf_dir, "part").select("p_name").write.text(landing)
    return files.list_files(spark, landing, "part-*").agg(F.sum("size").alias("bytes"))


@register(
    "customers_from_sql",
    oracle="SELECT count(*) AS customers, count(*) AS as_generated, count(DISTINCT c_custkey) AS ids FROM customer",
)
def customers_from_sql(spark, sf_dir):
    """The generator as a table function over the ids of a table (U4), compared
    with the expressions that make the same rows."""
    datagen.register_functions(spark)
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).createOrReplaceTempView("tern_ids")
    made = spark.sql("SELECT * FROM generate_customer_data(TABLE(tern_ids) PARTITION BY (id), 42)")
    made = materialize(made, "customers")
    same = datagen.customers_of(spark.table("tern_ids")).withColumn("same", F.lit(True))
    met = made.join(same, made.columns, "left")
    return met.agg(F.count(F.lit(1)).alias("customers"), F.count("same").alias("as_generated"), F.countDistinct("cust_id").alias("ids"))


# --------------------------------------------------------------------------
# W3  incremental refresh = full recompute
# --------------------------------------------------------------------------

from tern.sources import datagen  # noqa: E402
from tern.streaming.refresh import SalesRefresh  # noqa: E402

# The three arrival batches split the orders by order date.
_BATCH_BOUNDS = ("1997-01-01", "2000-01-01")


def refreshed_tables(spark, sf_dir, table_name, root=None):
    """Land the JSON orders in three batches (by order date, unknown dates
    first; all are written in one pass, and moved in one by one), run the refresh
    stream after each landing; the job, which maintains the named table and what
    it is made from."""
    root = root or scratch_path(spark, "refresh")
    landing = f"{root}/landing"
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    a, b = (F.lit(x).cast("timestamp_ntz") for x in _BATCH_BOUNDS)
    day = F.col("o_orderdate")
    batch = F.when(day.isNull() | (day < a), 0).when(day < b, 1).otherwise(2)
    datagen.write_json_batch(derived.sales_orders_from(li, o.withColumn("batch", batch), "batch"), f"{root}/written", by=("batch",))
    customers, products = derived.sales_customers(spark, sf_dir), derived.sales_products(spark, sf_dir)
    job = SalesRefresh(spark, f"{root}/tables", landing, customers, products, buckets=8, tables={table_name})
    for i in range(len(_BATCH_BOUNDS) + 1):
        datagen.land(spark, f"{root}/written/batch={i}", landing)
        job.start({"availableNow": True}).awaitTermination()
    return job


@register("refresh_incremental_equals_full", oracle=O.SALES_REPORT)
def refresh_incremental_equals_full(spark, sf_dir):
    return refreshed_tables(spark, sf_dir, "sales_report").read("sales_report")


@register("refresh_customer_orders", oracle=O.CUSTOMER_ORDERS)
def refresh_customer_orders(spark, sf_dir):
    return refreshed_tables(spark, sf_dir, "customer_orders").read("customer_orders")


@register("refresh_cumulative_purchases", oracle=O.CUMULATIVE_PURCHASES)
def refresh_cumulative_purchases(spark, sf_dir):
    return refreshed_tables(spark, sf_dir, "cumulative_purchases").read("cumulative_purchases", derived.AS_OF)


@register("refresh_inventory_alert", oracle=O.INVENTORY_ALERT)
def refresh_inventory_alert(spark, sf_dir):
    return refreshed_tables(spark, sf_dir, "product_inventory_alert").read("product_inventory_alert").drop("rowcreationtime")
