"""Derived sales tables kept fresh by Structured Streaming.

    orders (files) -> customer_orders -> sales_report -> cumulative_purchases
                                                    \\-> product_inventory_alert

Invariant: after a batch every table equals its defining query
(``tern.operators.sales``) run in full on the orders consumed so far, the static
inputs and the moment asked for.

Everything is plain Parquet, partitioned by ``bucket``, a hash of the customer
modulo ``buckets``, and written with dynamic partition overwrite:

1. A batch's typed orders go to ``orders/bucket=b/batch_id=N``.  Nothing else
   reads the landing folder, so what is refreshed and what the stream has
   consumed cannot differ.
2. What a batch's orders give whatever came before goes to partitions of that
   batch, from its stored orders: customer_orders, ``sales`` (those with their
   product's name, which sales_report is made from), and what the two aggregates
   add up: daily totals and last purchases of a customer, and units of a product.
3. sales_report: under LAG late rows change the first row of a customer and date
   (``first``), and no other.  A batch's rows go, with the first rows of the
   buckets it touches, to partitions of that batch: those that are now first,
   which take the place of the earlier first rows, and the settled others, which
   stay.

Each partition is a function of stored orders alone, so a batch that failed
half-way or comes again gives the same tables (of a batch that the report already
has, its buckets' rows are computed anew from all stored orders), and which batch
is the next is the stream's own knowledge (its checkpoint).  ``cumulative_purchases`` and
``product_inventory_alert`` are sums over those partial tables when read, so the
moving six-month bound needs no rewrite: orders that expire are days that are
left out.

What the warehouse calls suspending a table is ``stop()`` of the stream, resuming
is ``start()`` with the same checkpoint, and dropping is deleting the folder.  A
changed static input takes effect with ``full_refresh``.  Readers see the
partitions of a running batch as they are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tern.functions import dialect
from tern.operators import sales

TABLES = ("customer_orders", "sales_report", "cumulative_purchases", "product_inventory_alert")
_ORDERS = "order_id bigint, custid bigint, product_id bigint, quantity bigint, order_total decimal(10,2), purchase_date date"
_SCHEMAS = {
    "orders": _ORDERS + ", bucket int, batch_id bigint",
    "customer_orders": "customer_id bigint, customer_name string, order_id bigint, product_id bigint, quantity bigint, "
                       "order_total decimal(10,2), purchase_date date, bucket int, batch_id bigint",
    "sales_report": "customer_id bigint, customer_name string, order_id bigint, product_id bigint, product_name string, "
                    "order_total decimal(10,2), quantity bigint, unitsalesprice decimal(18,8), purchase_date date, "
                    "days_since_last_purchase int, customer_sk string, bucket int, batch_id bigint, first boolean",
    "sales": "customer_id bigint, customer_name string, order_id bigint, product_id bigint, product_name string, "
             "order_total decimal(10,2), quantity bigint, purchase_date date, bucket int, batch_id bigint",
    "daily": "customer_id bigint, customer_name string, purchase_date date, rows bigint, orders bigint, total decimal(38,2), "
             "totals bigint, bucket int, batch_id bigint",
    "last": "customer_id bigint, customer_name string, product_id bigint, last_date date, bucket int, batch_id bigint",
    "units": "product_id bigint, purchase_date date, quantity bigint, bucket int, batch_id bigint",
}
_PART = ("bucket", "batch_id")


class SalesRefresh:
    """Keeps the sales tables under ``root`` fresh from orders landing in
    ``landing`` (JSON lines, one order per line, as ``sales_data``).

    ``buckets`` is part of the tables' path: choose it once, so that a bucket of
    the expected orders suits a few tasks.  ``tables`` limits what is maintained.
    """

    def __init__(self, spark: SparkSession, root: str, landing: str, customers: DataFrame, products: DataFrame, buckets: int = 64,
                 months: int = 6, tables: Iterable[str] = TABLES):
        if unknown := set(tables) - set(TABLES):
            raise ValueError(f"unknown tables {sorted(unknown)}")
        self.spark, self.root, self.landing = spark, f"{root.rstrip('/')}/buckets={buckets}", landing.rstrip("/")
        self.customers, self.products = customers, products
        self.buckets, self.months, self.tables = buckets, months, set(tables)

    # ----------------------------------------------------------- tables

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _folder(self, path: str):
        """A folder's path and its file system, as Hadoop has them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _stored(self, name: str, touched: list[int] | None = None, batch_id: int | None = None) -> DataFrame:
        """Rows of a table with their bucket; only the touched partitions, or
        those of a batch, are read."""
        path, system = self._folder(self.path(name))
        if not system.exists(path):
            return self.spark.createDataFrame([], _SCHEMAS[name])
        rows = self.spark.read.schema(_SCHEMAS[name]).parquet(self.path(name))
        rows = rows if batch_id is None else rows.where(F.col("batch_id") == batch_id)
        return rows if touched is None else rows.where(F.col("bucket").isin(touched))

    @staticmethod
    def _columns(name: str) -> list[str]:
        return [x.split()[0] for x in _SCHEMAS[name].split(", ")]

    def _replace(self, name: str, rows: DataFrame, whole: bool, by: tuple[str, ...] = ("bucket",)) -> None:
        """The partitions that ``rows`` has, or the ``whole`` table.  A task has
        a file for each of its partitions; rows are not shuffled to have fewer."""
        mode = "static" if whole else "dynamic"
        write = rows.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "zstd")
        write.partitionBy(*by).parquet(self.path(name))

    def read(self, name: str, as_of=None) -> DataFrame:
        """Current contents of a derived table; ``as_of`` is the moment (text,
        UTC) of ``cumulative_purchases``, by default now."""
        if name not in self.tables:
            raise KeyError(name)
        if name == "cumulative_purchases":
            since = dialect.months_before(as_of, self.months) if as_of is not None else F.add_months(F.localtimestamp(), -self.months)
            # a product is last bought in several batches, each of which has its own last day
            last = self._stored("last").where(F.col("last_date").cast("timestamp_ntz") >= since)
            last = last.groupBy("customer_id", "customer_name", "product_id").agg(F.max("last_date").alias("last_date"))
            return sales.cumulative_of(sales.purchases_since(self._stored("daily"), last, since))
        if name == "product_inventory_alert":
            return sales.product_inventory_alert(self._stored("units"), self.products)
        rows = self._stored(name)
        if name == "sales_report":
            rows = rows.where(~F.col("first") | self._counted(self._report_batches())).drop("first")
        return rows.drop(*_PART)

    def orders(self) -> DataFrame:
        """All orders that the stream has stored."""
        return self._stored("orders").drop(*_PART)

    # ---------------------------------------------------------- refresh

    def _build(self, batch_id: int | None) -> None:
        """The derived tables from the stored orders of a batch (None: of all),
        ``sales_report`` with the first rows of the buckets it touches."""
        whole = batch_id is None
        c = self.customers.select(F.col("cust_id").alias("custid"), "customer_name")
        joined = self._stored("orders", None, batch_id).join(c, "custid", "inner").withColumnRenamed("custid", "customer_id")
        self._replace("customer_orders", joined.select(*self._columns("customer_orders")), whole, _PART)
        mine = self._stored("customer_orders", None, batch_id)
        if "sales_report" in self.tables:
            self._build_report(mine, batch_id)
        report = sales.sales_report(mine, self.products, False, keep=_PART)
        if "cumulative_purchases" in self.tables:
            self._replace("daily", sales.daily_purchases(report, _PART), whole, _PART)
            self._replace("last", sales.last_purchases(report, _PART), whole, _PART)
        if "product_inventory_alert" in self.tables:
            units = report.groupBy(*_PART, "product_id").agg(F.max("purchase_date").alias("purchase_date"), F.sum("quantity").alias("quantity"))
            self._replace("units", units, whole, _PART)

    def _report_batches(self, first_only: bool = True) -> dict[int, int]:
        """The last batch of which the report of a bucket has rows, or first
        rows, which are the ones that count (a number per bucket)."""
        rows = self._stored("sales_report")
        rows = rows.where("first") if first_only else rows
        return dict(map(tuple, rows.groupBy("bucket").agg(F.max("batch_id")).collect()))

    @staticmethod
    def _counted(batches: dict[int, int]) -> Column:
        last = [(F.col("bucket") == b) & (F.col("batch_id") == n) for b, n in batches.items()]
        return F.col("first") & reduce(Column.__or__, last, F.lit(False))

    def _build_report(self, mine: DataFrame, batch_id: int | None) -> None:
        """The report after the batch's customer orders (None: all of them)."""
        self._replace("sales", sales.sales_report(mine, self.products, False, keep=_PART).select(*self._columns("sales")), batch_id is None, _PART)
        known = self._report_batches(first_only=False)
        touched = [r[0] for r in mine.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        anew = batch_id is None or any(known.get(b, -1) >= batch_id for b in touched)
        number = self._stored("orders").agg(F.max("batch_id")).first()[0] if anew else batch_id
        late = self._stored("sales", touched, None if anew else batch_id)
        firsts = self._stored("sales_report", touched).where(F.lit(False) if anew else self._counted(self._report_batches()))
        rows = sales.days_among(firsts, late, keep=("bucket",))
        rows = rows.withColumn("batch_id", F.lit(number).cast("bigint")).withColumn("first", ~sales.settled())
        self._replace("sales_report", rows, batch_id is None, (*_PART, "first"))
        for b in () if batch_id is None else touched:
            self._drop_replaced(b, number, anew)

    def _drop_replaced(self, bucket: int, batch_id: int, anew: bool) -> None:
        """Removes what the batch's partitions of a bucket stand for: earlier
        first rows, or all others if they are the bucket ``anew``."""
        path, system = self._folder(f"{self.path('sales_report')}/bucket={bucket}")
        if not system.exists(path):
            return
        for x in system.listStatus(path):
            if x.getPath().getName() != f"batch_id={batch_id}":
                system.delete(x.getPath() if anew else self._folder(f"{x.getPath()}/first=true")[0], True)

    def refresh_batch(self, batch: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` body: one micro-batch through the tables."""
        orders = sales.extract_orders(batch)
        orders = orders.withColumn("bucket", F.pmod(F.xxhash64("custid"), F.lit(self.buckets)).cast("int")).withColumn("batch_id", F.lit(batch_id))
        self._replace("orders", orders, False, _PART)
        if not self._stored("orders", None, batch_id).isEmpty():
            self._build(batch_id)

    def full_refresh(self) -> None:
        """Every table from all stored orders, as after a changed static input."""
        self._build(None)

    def start(self, trigger: dict | None = None, checkpoint: str | None = None):
        """Run the refresh as a stream over the landing directory.

        ``trigger`` is passed to ``writeStream.trigger``: the freshness
        target ``{"processingTime": "1 minute"}`` (LAG = '1 MINUTE'), or
        ``{"availableNow": True}`` for refresh on request.  A malformed record
        fails the batch; it is not turned into NULL.
        """
        src = self.spark.readStream.option("recursiveFileLookup", "true").text(self.landing)
        src = src.select(F.parse_json("value").alias("sales_data"))
        w = src.writeStream.foreachBatch(self.refresh_batch).option("checkpointLocation", checkpoint or self.path("_checkpoint"))
        return w.trigger(**(trigger or {"availableNow": True})).start()
