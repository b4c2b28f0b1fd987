"""Sales workload edge cases (FIXTURES §3: orders_ties, orders_unmatched,
orders_expiry, alert_ties) and the skew-safe LAG against the window form."""

import datetime as dt
import json
import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from tern.operators import sales


def sales_report_window(customer_orders_df, products):
    """The textbook form of D2 with one window per customer.  Kept as the
    brute-force reference for tests; it sorts a whole customer in one task."""
    p = products.select("product_id", "product_name")
    rows = customer_orders_df.join(p, "product_id", "inner")
    w = Window.partitionBy("customer_id").orderBy(F.col("purchase_date").asc_nulls_first(), *sales.TIE_BREAK)
    return rows.select(
        "customer_id",
        "customer_name",
        "order_id",
        "product_id",
        "product_name",
        "order_total",
        "quantity",
        sales.dialect.divide("order_total", "quantity", 8).cast("decimal(18,8)").alias("unitsalesprice"),
        "purchase_date",
        sales.dialect.days_between(F.lag("purchase_date").over(w), "purchase_date").cast("int").alias("days_since_last_purchase"),
        sales.customer_sk("customer_id", "product_id", "purchase_date").alias("customer_sk"),
    )


def orders_df(spark, docs):
    rows = [(json.dumps(d),) for d in docs]
    return spark.createDataFrame(rows, "t string").select(F.parse_json("t").alias("sales_data"))


def order(oid, cust, prod, qty, total, date):
    p = {"product_id": prod, "order_total": total, "purchase_date": date}
    if qty is not None:
        p["quantity"] = qty
    return {"order_id": oid, "custid": cust, "purchase": p}


def customers(spark, ids=(1001, 1002)):
    return spark.createDataFrame([(i, f"C{i}") for i in ids], "cust_id long, customer_name string")


def products(spark, ids=(101, 102), stock=500):
    return spark.createDataFrame(
        [(i, f"P{i}", Decimal(stock)) for i in ids], "product_id long, product_name string, stock decimal(10,2)"
    )


def days_by_order(df):
    return sorted((r.order_id, r.days_since_last_purchase) for r in df.collect())


def test_orders_ties(spark):
    docs = [
        order(1, 1001, 101, 1, 10.0, "2024-01-05"),
        order(2, 1001, 101, 1, 10.0, "2024-01-05"),
        order(3, 1001, 102, 2, 20.0, "2024-01-05"),
        order(4, 1001, 101, 1, 10.0, "2024-01-09"),
        order(5, 1001, 101, 1, 10.0, "2024-01-02"),  # earlier date arriving last
    ]
    co = sales.customer_orders(customers(spark), orders_df(spark, docs))
    out = days_by_order(sales.sales_report(co, products(spark)))
    # order 5 is first (NULL); the first of the 01-05 ties gets 3, the others 0.
    assert out == [(1, 3), (2, 0), (3, 0), (4, 4), (5, None)]
    ref = days_by_order(sales_report_window(co, products(spark)))
    assert out == ref


def test_orders_unmatched(spark):
    docs = [
        order(1, 1001, 101, 2, 10.0, "2024-01-05"),
        order(2, 9999, 101, 1, 10.0, "2024-01-05"),  # no such customer
        order(3, 1001, 999, 1, 10.0, "2024-01-05"),  # no such product
        {"order_id": 4, "custid": 1001, "purchase": {"product_id": 101, "quantity": None, "order_total": 5.0,
                                                      "purchase_date": "2024-01-06"}},
        order(5, 1001, 101, None, 5.0, "2024-01-07"),  # missing quantity
        {"order_id": 6, "custid": 1001, "purchase": {"product_id": 101, "quantity": 1, "order_total": 5.0,
                                                      "purchase_date": None}},
    ]
    co = sales.customer_orders(customers(spark), orders_df(spark, docs))
    assert sorted(r.order_id for r in co.collect()) == [1, 3, 4, 5, 6]
    sr = sales.sales_report(co, products(spark))
    rows = {r.order_id: r for r in sr.collect()}
    assert sorted(rows) == [1, 4, 5, 6]
    assert rows[4].unitsalesprice is None and rows[5].unitsalesprice is None
    assert rows[1].unitsalesprice == Decimal("5.00000000")
    assert rows[6].customer_sk is None and rows[6].days_since_last_purchase is None
    cp = sales.cumulative_purchases(sr, "2024-02-01 00:00:00").collect()[0]
    # NULL customer_sk is not counted; NULL date row is outside the window
    assert cp.total_orders == 3 and cp.distinct_products == 1


def test_orders_expiry(spark):
    as_of = dt.datetime(2024, 7, 15, 12, 0, 0)
    docs = [
        order(1, 1001, 101, 1, 1.0, "2024-01-14"),
        order(2, 1001, 101, 1, 2.0, "2024-01-15"),  # exactly six months back
        order(3, 1001, 101, 1, 4.0, "2024-01-16"),
    ]
    sr = sales.sales_report(sales.customer_orders(customers(spark), orders_df(spark, docs)), products(spark))
    noon = sales.cumulative_purchases(sr, as_of).collect()[0]
    midnight = sales.cumulative_purchases(sr, as_of.replace(hour=0)).collect()[0]
    assert noon.total_sales == Decimal("4.00")  # the exact date is excluded at noon
    assert midnight.total_sales == Decimal("6.00")  # and included at midnight


def test_alert_ties_and_low_stock(spark):
    docs = [
        order(1, 1001, 101, 2, 1.0, "2024-01-01"),
        order(2, 1001, 101, 3, 1.0, "2024-01-05"),
        order(3, 1002, 101, 4, 1.0, "2024-01-05"),
        order(4, 1002, 102, 5, 1.0, "2024-01-03"),
    ]
    sr = sales.sales_report(sales.customer_orders(customers(spark), orders_df(spark, docs)), products(spark, stock=10))
    alert = {r.product_id: r for r in sales.product_inventory_alert(sr, products(spark, stock=10)).collect()}
    assert len(alert) == 2
    a = alert[101]
    assert (a.latest_sales_date, a.totalunitsold, a.unitsleft, a.percent_unitleft) == (
        dt.date(2024, 1, 5), 9, Decimal("1.00"), Decimal("10.00"))
    low = sales.low_stock(sales.product_inventory_alert(sr, products(spark, stock=10)), 60).collect()
    assert [r.product_id for r in low] == [101, 102]


def test_skew_safe_lag_equals_window(spark):
    rnd = random.Random(7)
    docs = []
    for i in range(400):
        cust = 1001 if rnd.random() < 0.4 else rnd.choice([1002, 1003])  # one hot customer
        docs.append(order(rnd.randint(1, 60), cust, rnd.choice([101, 102]), rnd.randint(1, 3),
                          rnd.choice([5.0, 7.5]), f"2024-01-{rnd.randint(1, 6):02d}"))
    co = sales.customer_orders(customers(spark, (1001, 1002, 1003)), orders_df(spark, docs))
    a = sales.sales_report(co, products(spark))
    b = sales_report_window(co, products(spark))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
