"""Table generators of the sales workload (U1-U4), as Spark jobs.

From SQL they are table functions (``register_functions``):
``SELECT * FROM generate_customer_data(TABLE(SELECT id FROM t), 42)`` makes the
row of each id, in the tasks that have the ids.

``spark.range(n)`` spreads the rows over all executors; every value is a
deterministic function of (seed, row id) through ``xxhash64``, so a batch
can be regenerated identically after a failure.  Order ids start at a given
``start_order_id`` so separate batches never collide (the reference derives
them from the call time, which can collide).
"""

from __future__ import annotations

import datetime as _dt
import struct

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The option lists of the reference's customer generator.
TIERS = ["Basic", "Gold", "Premium"]
INDUSTRIES = ["Retail", "Technology", "Healthcare", "Finance", "Manufacturing"]
REGIONS = ["North America", "Europe", "Asia", "South America", "Australia"]

# Synthetic company-name parts (our own word lists; the reference uses a
# fake-data library that is not available here).
_NAME_A = ["Blue", "North", "Summit", "Bright", "Green", "Iron", "Silver", "Cedar", "Harbor", "Maple"]
_NAME_B = ["Ridge", "Field", "Stone", "River", "Peak", "Bay", "Grove", "Works", "Point", "Vale"]
_NAME_C = ["Corp", "Group", "Labs", "Partners", "Holdings", "Systems", "Logistics", "Foods", "Media", "Trading"]


def _uniform(seed: int, salt: int) -> Column:
    """Deterministic uniform [0, 1) per row from (seed, id, salt)."""
    h = F.xxhash64(F.lit(seed), F.col("id"), F.lit(salt))
    return (F.pmod(h, F.lit(1 << 31)).cast("double")) / float(1 << 31)


def _pick(options: list[str], u: Column) -> Column:
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (F.floor(u * len(options)) + 1).cast("int"))


def _int_between(lo: int, hi: int, u: Column) -> Column:
    return (F.lit(lo) + F.floor(u * (hi - lo + 1))).cast("long")


def _name(seed: int, salt: int) -> Column:
    return F.concat_ws(
        " ",
        _pick(_NAME_A, _uniform(seed, salt)),
        _pick(_NAME_B, _uniform(seed, salt + 1)),
        _pick(_NAME_C, _uniform(seed, salt + 2)),
    )


def generate_customers(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``generate_customer_data(n)`` (U1): ids 1001.., 3 tiers, 5 industries,
    5 regions."""
    return customers_of(spark.range(n), seed)


def customers_of(ids: DataFrame, seed: int = 42) -> DataFrame:
    """The customer of each ``id``."""
    return ids.select(
        (F.col("id") + 1001).alias("cust_id"),
        _name(seed, 10).alias("customer_name"),
        _pick(TIERS, _uniform(seed, 1)).alias("tier"),
        _pick(INDUSTRIES, _uniform(seed, 2)).alias("industry"),
        _pick(REGIONS, _uniform(seed, 3)).alias("region"),
    )


def generate_products(spark: SparkSession, n: int, as_of: _dt.date, seed: int = 42) -> DataFrame:
    """``generate_product_inventory_data(n)`` (U2): ids 101.., whole-number
    stock in 500..1000, stock date within the 90 days before ``as_of``."""
    return spark.range(n).select(
        (F.col("id") + 101).alias("product_id"),
        _name(seed, 20).alias("product_name"),
        F.round(F.lit(500.0) + _uniform(seed, 4) * 500.0).cast("decimal(10,2)").alias("stock"),
        F.date_sub(F.lit(as_of), _int_between(0, 90, _uniform(seed, 5)).cast("int")).alias("stockdate"),
    )


def generate_sales(
    spark: SparkSession,
    n: int,
    start_order_id: int,
    as_of: _dt.date,
    seed: int = 42,
    n_customers: int = 999,
    n_products: int = 30,
) -> DataFrame:
    """``generate_sales_data(n)`` (U3): one VARIANT ``sales_data`` per order
    {order_id, custid 1001..1000+n_customers, purchase{product_id 101..,
    quantity 1..5, order_total 50..10000, purchase_date within 2 days}}."""
    order = F.struct(
        (F.col("id") + start_order_id).alias("order_id"),
        _int_between(1001, 1000 + n_customers, _uniform(seed, 6)).alias("custid"),
        F.struct(
            _int_between(101, 100 + n_products, _uniform(seed, 7)).alias("product_id"),
            _int_between(1, 5, _uniform(seed, 8)).alias("quantity"),
            F.round(F.lit(50.0) + _uniform(seed, 9) * 9950.0, 2).cast("decimal(10,2)").alias("order_total"),
            F.date_format(F.date_sub(F.lit(as_of), _int_between(0, 2, _uniform(seed, 11)).cast("int")), "yyyy-MM-dd").alias(
                "purchase_date"
            ),
        ).alias("purchase"),
    )
    return spark.range(n).select(F.parse_json(F.to_json(order)).alias("sales_data"))


def write_json_batch(df: DataFrame, directory: str, by: tuple[str, ...] = ()) -> None:
    """Land a batch of orders as JSON-lines files (what the stream picks up),
    compressed: their text is mostly the same names.  ``by``: columns that name
    a folder for each of several batches."""
    lines = df.select(F.to_json("sales_data").alias("value"), *by)
    lines.write.mode("append").partitionBy(*by).text(directory, compression="gzip")


def land(spark: SparkSession, written: str, landing: str) -> None:
    """Moves the folder of a batch that was written elsewhere below the landing
    folder, where the stream then finds its files whole.  No folder: no orders."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(landing).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(landing))
    to = path(landing, path(written).getName())
    if system.exists(path(written)) and not system.rename(path(written), to):
        raise OSError(f"{written} could not be moved to {landing}")


# ------------------------------------------------------------------ from SQL


def _uniform_of(seed: int, number: int, salt: int) -> float:
    """``_uniform`` of one id: Spark's XXH64 chains the columns through its seed."""
    h = 42
    for layout, value in (("<i", seed), ("<q", number), ("<i", salt)):
        h = xxhash.xxh64_intdigest(struct.pack(layout, value), h)
    return (h % (1 << 31)) / (1 << 31)


def _option(options: list[str], u: float) -> str:
    return options[int(u * len(options))]


class CustomerRows:
    """``generate_customer_data``: called with each row of its table argument
    (``id``), so it needs no more than a row at a time, in whatever task."""

    def eval(self, row, seed: int):
        if row["id"] is None:
            return
        u = lambda salt: _uniform_of(seed, row["id"], salt)
        name = " ".join(_option(words, u(10 + k)) for k, words in enumerate((_NAME_A, _NAME_B, _NAME_C)))
        yield row["id"] + 1001, name, _option(TIERS, u(1)), _option(INDUSTRIES, u(2)), _option(REGIONS, u(3))


def register_functions(spark: SparkSession) -> None:
    """The table functions for SQL (U4)."""
    columns = "cust_id bigint, customer_name string, tier string, industry string, region string"
    spark.udtf.register("generate_customer_data", F.udtf(CustomerRows, returnType=columns))
