"""The sales tables derived from JSON orders.

Inputs
  customers          cust_id, customer_name, ...
  product_inventory  product_id, product_name, stock decimal(10,2), ...
  orders             sales_data VARIANT {order_id, custid,
                     purchase{product_id, quantity, order_total, purchase_date}}

Every function is the defining query of one derived table; the streaming
refresh in ``tern.streaming.refresh`` reuses them on changed keys only.

Skew: one customer or one product may hold a third of all orders.  Nothing
here sorts a whole customer in one task: the LAG of ``sales_report`` is
rebuilt from a per-(customer, date) aggregate (see ``_days_since_last``), and
the inventory alert is an aggregate, not a window (SURVEY §4.2 R3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tern.functions import dialect, variant
from tern.operators import running
from tern.session import materialize

# Row order inside one customer for LAG: the reference orders by date only;
# ties are broken by every remaining column so the result is deterministic.
TIE_BREAK = ("order_id", "product_id", "quantity", "order_total")


def extract_orders(orders: DataFrame, col: str = "sales_data", strict: bool = True) -> DataFrame:
    """Typed columns of the JSON orders (the ``sales_data:…::type`` list)."""
    v = F.col(col)
    return orders.select(
        variant.get(v, "$.order_id", "bigint", strict).alias("order_id"),
        variant.get(v, "$.custid", "bigint", strict).alias("custid"),
        variant.get(v, "$.purchase.product_id", "bigint", strict).alias("product_id"),
        variant.get(v, "$.purchase.quantity", "bigint", strict).alias("quantity"),
        variant.get(v, "$.purchase.order_total", "decimal(10,2)", strict).alias("order_total"),
        variant.get(v, "$.purchase.purchase_date", "date", strict).alias("purchase_date"),
    )


def customer_orders(customers: DataFrame, orders: DataFrame, strict: bool = True) -> DataFrame:
    """D1 ``customer_orders``: orders joined to customers on the JSON custid."""
    o = extract_orders(orders, strict=strict)
    c = customers.select(F.col("cust_id").alias("custid"), "customer_name")
    return o.join(c, "custid", "inner").select(
        F.col("custid").alias("customer_id"),
        "customer_name",
        "order_id",
        "product_id",
        "quantity",
        "order_total",
        "purchase_date",
    )


def _days_since_last(rows: DataFrame) -> DataFrame:
    """``DATEDIFF(DAY, LAG(purchase_date) OVER (PARTITION BY customer_id
    ORDER BY purchase_date, tie-break), purchase_date)`` without a window over
    a whole customer.

    The previous row is on the same date unless the row is the first of its
    (customer, date) group, so: every row but the first of its group gets 0,
    the first gets the gap to the customer's previous distinct date.

    1. per (customer, date): the smallest tie-break key (partial aggregate,
       combines map-side, so a hot customer or date does not land in one task);
    2. previous distinct date: a window over the *distinct dates* of a
       customer, bounded by the calendar, not by the number of orders;
    3. rows meet the group minima on all ordering columns (as one struct, so
       NULLs group as the window groups them): only exact duplicates share a
       key, and the rows are shuffled once;
    4. rows equal to the group minimum are identical on every ordering
       column; one of them (row_number within exact duplicates) is first.
    NULL dates follow the window semantics: LAG over them is NULL.
    """
    groups = rows.groupBy("customer_id", "purchase_date").agg(F.min(_tie_key()).alias("_kmin"))
    by_cust = Window.partitionBy("customer_id").orderBy(F.col("purchase_date").asc_nulls_first())
    return _with_days(rows, groups.withColumn("_prev", F.lag("purchase_date").over(by_cust)))


def _tie_key() -> Column:
    return F.struct(*[F.col(c) for c in TIE_BREAK])


def _with_days(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``days_since_last_purchase``, given for each (customer,
    date) the smallest tie-break key ``_kmin`` and the customer's previous date
    ``_prev`` (steps 3 and 4 above)."""
    own = ["customer_id", "purchase_date"]
    groups = groups.select(F.struct(*own, *[F.col(f"_kmin.{c}").alias(c) for c in TIE_BREAK]).alias("_key"), "_prev", F.lit(True).alias("_least"))
    # the key's columns are shuffled within it only
    others = [c for c in rows.columns if c not in (*own, *TIE_BREAK)]
    joined = rows.select(F.struct(*own, *TIE_BREAK).alias("_key"), *others).join(groups, "_key", "left")
    dup = Window.partitionBy("_key").orderBy(F.lit(1))
    first = F.col("_least").isNotNull() & (F.row_number().over(dup) == 1)
    days = (
        F.when(F.col("_key.purchase_date").isNull(), F.lit(None).cast("int"))
        .when(first, dialect.days_between("_prev", F.col("_key.purchase_date")))
        .otherwise(F.lit(0))
    )
    return joined.select(*[c if c in others else F.col(f"_key.{c}").alias(c) for c in rows.columns], days.alias("days_since_last_purchase"))


def report_after(report: DataFrame, late: DataFrame) -> DataFrame:
    """``sales_report`` after more rows arrived (D2), from the old ``report``
    and the ``late`` rows (the report's columns; their days are not read).

    Rows that are ``settled`` are passed on as they are, without a sort or an
    exchange.  What is left has the first row of every group, hence every date,
    and those rows and the late ones have the days that they have among all.
    ``report`` should be a written table: it is read twice.
    """
    return report.where(settled()).unionByName(days_among(report.where(~settled()), late).select(*report.columns))


def settled() -> Column:
    """Whether later rows leave a report's row as it is, and need not know of
    it.  Of a (customer, date) only the first row has days other than 0, so a
    row with 0 is not first, and later rows do not make it so; a row without a
    date has no days."""
    return F.col("purchase_date").isNull() | F.coalesce(F.col("days_since_last_purchase") == 0, F.lit(False))


def days_among(firsts: DataFrame, late: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of both with the days that they have among all, given of the
    earlier rows those that are not ``settled``.  Columns that follow from
    others are computed anew, not shuffled."""
    columns = [*_REPORTED, *keep]
    return _reported(_days_since_last(firsts.select(*columns).unionByName(late.select(*columns))), keep)


def sales_report(customer_orders_df: DataFrame, products: DataFrame, with_days: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """D2 ``sales_report``.

    ``with_days=False`` leaves out ``days_since_last_purchase`` (NULL): the
    downstream tables never read it, so their plans skip the LAG work.
    ``keep``: more columns of the orders, which come last.
    """
    p = products.select("product_id", "product_name")
    rows = customer_orders_df.join(p, "product_id", "inner")
    if with_days:
        rows = _days_since_last(rows)
    else:
        rows = rows.withColumn("days_since_last_purchase", F.lit(None).cast("int"))
    return _reported(rows, keep)


# What the other columns of ``sales_report`` are computed from.
_REPORTED = ("customer_id", "customer_name", "order_id", "product_id", "product_name", "order_total", "quantity", "purchase_date")


def _reported(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return rows.select(
        "customer_id",
        "customer_name",
        "order_id",
        "product_id",
        "product_name",
        "order_total",
        "quantity",
        dialect.divide("order_total", "quantity", 8).cast("decimal(18,8)").alias("unitsalesprice"),
        "purchase_date",
        F.col("days_since_last_purchase").cast("int").alias("days_since_last_purchase"),
        customer_sk("customer_id", "product_id", "purchase_date").alias("customer_sk"),
        *keep,
    )


def customer_sk(customer_id, product_id, purchase_date) -> Column:
    """``customer_id || '-' || product_id || '-' || purchase_date`` (F12);
    NULL when any part is NULL."""
    return F.concat(
        F.col(customer_id).cast("string"),
        F.lit("-"),
        F.col(product_id).cast("string"),
        F.lit("-"),
        F.date_format(purchase_date, "yyyy-MM-dd"),
    )


def cumulative_purchases(sales_report_df: DataFrame, as_of, months: int = 6) -> DataFrame:
    """D3 ``cumulative_purchases`` (A3, A4, F3): purchases since ``as_of``
    minus ``months`` (time of day kept), per customer."""
    since = dialect.months_before(as_of, months)
    return (
        sales_report_df.where(F.col("purchase_date").cast("timestamp_ntz") >= since)
        .groupBy("customer_id", "customer_name")
        .agg(
            F.sum("order_total").cast("decimal(38,2)").alias("total_sales"),
            F.count("customer_sk").alias("total_orders"),
            F.countDistinct("product_id").alias("distinct_products"),
        )
    )


def daily_purchases(sales_report_df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Partial totals of D3: per customer and day the rows, the orders with a
    key, and the sum of the totals with the number of those that are not null.
    Rows without a date never count.  ``by``: columns to part the totals by."""
    return sales_report_df.where(F.col("purchase_date").isNotNull()).groupBy("customer_id", "customer_name", "purchase_date", *by).agg(
        F.count(F.lit(1)).alias("rows"), F.count("customer_sk").alias("orders"),
        F.coalesce(F.sum("order_total"), F.lit(0)).cast("decimal(38,2)").alias("total"), F.count("order_total").alias("totals"),
    )


def last_purchases(sales_report_df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The last day on which a customer bought a product; a product is among
    the distinct ones of a window that is open at its end if that day is in it."""
    dated = sales_report_df.where(F.col("purchase_date").isNotNull() & F.col("product_id").isNotNull())
    return dated.groupBy("customer_id", "customer_name", "product_id", *by).agg(F.max("purchase_date").alias("last_date"))


_PARTS = ("rows", "orders", "total", "totals", "products")


def purchases_since(daily: DataFrame, last: DataFrame, since, until=None) -> DataFrame:
    """Sums of the partial totals of the days from ``since`` (a timestamp
    column) on, before ``until`` if given: ``customer_id``, ``customer_name``
    and ``_PARTS``, where ``products`` are those last bought in these days."""
    inside = lambda c: (c >= since) if until is None else (c >= since) & (c < until)
    day = lambda c: F.col(c).cast("timestamp_ntz")
    who = ["customer_id", "customer_name"]
    sums = daily.where(inside(day("purchase_date"))).select(*who, "rows", "orders", "total", "totals", F.lit(0).cast("long").alias("products"))
    zero = [F.lit(0).cast(t).alias(c) for c, t in zip(_PARTS[:-1], ("long", "long", "decimal(38,2)", "long"))]
    seen = last.where(inside(day("last_date"))).select(*who, *zero, F.lit(1).cast("long").alias("products"))
    return sums.unionByName(seen).groupBy(*who).agg(*[F.sum(c).cast("decimal(38,2)" if c == "total" else "long").alias(c) for c in _PARTS])


def moved_purchases(current: DataFrame, daily: DataFrame, last: DataFrame, as_of, to, months: int = 6) -> DataFrame:
    """``purchases_since`` for the moment ``to``, from that for ``as_of``: the
    days between the two bounds are subtracted (or, for an earlier moment,
    added); no order is read again, and no other day."""
    old, new = dialect.months_before(as_of, months), dialect.months_before(to, months)
    later = current.sparkSession.range(1).select(new >= old).first()[0]  # both are constants
    low, high, sign = (old, new, -1) if later else (new, old, 1)
    change = purchases_since(daily, last, low, high).select("customer_id", "customer_name", *[(F.col(c) * sign).alias(c) for c in _PARTS])
    both = current.unionByName(change).groupBy("customer_id", "customer_name")
    moved = both.agg(*[F.sum(c).cast("decimal(38,2)" if c == "total" else "long").alias(c) for c in _PARTS])
    return moved.where("rows > 0")


def cumulative_of(parts: DataFrame) -> DataFrame:
    """``cumulative_purchases``' columns of summed parts."""
    return parts.select(
        "customer_id", "customer_name", F.when(F.col("totals") > 0, F.col("total")).alias("total_sales"),
        F.col("orders").alias("total_orders"), F.col("products").alias("distinct_products"),
    )


def top_customers(cumulative: DataFrame, k: int = 15) -> DataFrame:
    """Top-k customers by sales (O3); ties broken by customer_id.
    Runs as TakeOrderedAndProject: each task keeps k rows."""
    return (
        cumulative.orderBy(F.col("total_sales").desc(), F.col("customer_id").asc())
        .limit(k)
        .select("customer_name", "total_sales", "total_orders", "distinct_products")
    )


def running_units(sales_report_df: DataFrame) -> DataFrame:
    """Units sold per product up to and including each date (N2): the running
    ``sum(quantity) over (partition by product order by date)``, whose RANGE
    frame gives all rows of a date the same total.  Rows are summed by product
    and date first, so the window sees the distinct dates of a product."""
    daily = sales_report_df.groupBy("product_id", "purchase_date").agg(F.sum("quantity").alias("units"))
    w = Window.partitionBy("product_id").orderBy(F.col("purchase_date").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("product_id", "purchase_date", F.sum("units").over(w).alias("totalunitsold"))


SALE = ("product_id", "customer_id", "order_id", "purchase_date", "quantity")


def running_units_by_sale(sales_report_df: DataFrame) -> DataFrame:
    """N2 for every sale: the units of its product sold up to and including its
    date.  A product with a third of all sales is not one task's
    (``running.running_sum``)."""
    sales = sales_report_df.select(*SALE)
    return running.running_sum(sales, "product_id", "purchase_date", "quantity", "totalunitsold")


def latest_sales(sales_report_df: DataFrame) -> DataFrame:
    """The latest row of each product (N3, ``qualify row_number() = 1``), as an
    aggregate: the largest (date, order, customer, quantity, total), rows
    without a date being the oldest."""
    order = ["purchase_date", "order_id", "customer_id", "quantity", "order_total"]
    last = F.max(F.struct(F.col("purchase_date").isNotNull(), *order)).alias("_last")
    return sales_report_df.groupBy("product_id").agg(last).select("product_id", *[F.col(f"_last.{c}") for c in order])


def product_inventory_alert(sales_report_df: DataFrame, products: DataFrame, with_creation_time: bool = True) -> DataFrame:
    """D4 ``product_inventory_alert``.

    The latest row of each product under the default RANGE frame carries the
    product's whole quantity total, and ties on the latest date do not change
    any output column, so the window + QUALIFY is a per-product aggregate.
    Rows without a date count in the total and are older than all others.
    """
    agg = sales_report_df.groupBy("product_id").agg(
        F.max("purchase_date").alias("latest_sales_date"),
        F.sum("quantity").alias("totalunitsold"),
    )
    p = products.select("product_id", "product_name", F.col("stock").alias("begining_stock"))
    out = agg.join(p, "product_id", "inner")
    left = F.col("begining_stock") - F.col("totalunitsold")
    cols = [
        "product_id",
        "product_name",
        "latest_sales_date",
        "begining_stock",
        "totalunitsold",
        left.cast("decimal(38,2)").alias("unitsleft"),
        dialect.divide(left * 100, "begining_stock", 2).cast("decimal(18,2)").alias("percent_unitleft"),
    ]
    if with_creation_time:
        cols.append(F.current_timestamp().alias("rowcreationtime"))
    return out.select(*cols)


def low_stock(alert: DataFrame, threshold: float | None = 10) -> DataFrame:
    """Products below ``threshold`` percent left, fewest units first."""
    out = alert if threshold is None else alert.where(F.col("percent_unitleft") < threshold)
    return out.orderBy(F.col("unitsleft").asc(), F.col("product_id").asc())
