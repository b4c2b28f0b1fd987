"""Running totals, late rows, moved bounds and automatic bins against plain
windows and recomputation; the queries are compared with SQL in test_oracle."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tern.functions import dialect
from tern.operators import report, running, sales
from tern.session import materialize, settings

SALES = "product_id long, customer_id long, order_id long, purchase_date date, quantity long"


def day(n):
    return None if n is None else dt.date(2001, 1, 1) + dt.timedelta(days=n)


def test_hot_product_with_nulls(spark):
    """A third of all rows in one product and a sixth on one of its days; null
    products, dates and quantities; a product whose quantities are all null."""
    r = random.Random(1)
    rows = [(r.choice([1, 1, 2, 3, None]), r.randrange(9), i, day(r.choice([r.randrange(300), 7, None])), r.choice([1, 2, 5, None])) for i in range(3000)]
    rows += [(9, 1, 5000 + i, day(i), None) for i in range(5)]
    df = spark.createDataFrame(rows, SALES).repartition(6)
    w = Window.partitionBy("product_id").orderBy(F.col("purchase_date").asc_nulls_first())
    plain = df.withColumn("t", F.sum("quantity").over(w))
    got = running.running_sum(df, "product_id", "purchase_date", "quantity", "t")
    assert got.columns == plain.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))
    assert running.running_sum(df.limit(0), "product_id", "purchase_date", "quantity", "t").count() == 0


def test_hot_product_is_many_tasks(spark):
    """The runs of a product that has all rows: no task holds them all."""
    df = spark.range(4000).select(F.lit(1).alias("product_id"), F.col("id").alias("at"), F.lit(1).alias("q"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = df.groupBy("product_id", "at").agg(F.sum("q").alias("_own")).repartitionByRange("product_id", F.col("at").asc_nulls_first())
        assert placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1500
        got = running.running_totals(df, "product_id", "at", "q", "t").where(F.col("t") != F.col("at") + 1)
        assert got.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


CO = "customer_id long, customer_name string, order_id long, product_id long, quantity long, order_total decimal(10,2), purchase_date date"


def orders(spark, rows):
    products = spark.createDataFrame([(p, f"p{p}") for p in range(5)], "product_id long, product_name string")
    return lambda part, days=True: materialize(sales.sales_report(spark.createDataFrame(part, CO), products, days), "test-report")


@pytest.mark.parametrize("late_share", [0.0, 0.1, 0.6, 1.0])
def test_late_rows(spark, late_share):
    r = random.Random(int(late_share * 10))
    rows = [(r.choice([1, 1, 1, 2, 3, 4]), "c", r.randrange(60), r.randrange(5), r.randrange(1, 4), Decimal(r.randrange(1, 9)), day(r.choice([r.randrange(40), None])))
            for _ in range(300)]
    rows += rows[:40]  # equal rows on both sides
    late = [x for x in rows if r.random() < late_share]
    old = Counter(rows)
    old.subtract(late)
    make = orders(spark, rows)
    got = sales.report_after(make([x for x, n in old.items() for _ in range(n)]), make(late, False))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, make(rows).collect()))


def test_a_late_row_changes_its_follower_only(spark):
    rows = [(1, "c", i, 1, 1, Decimal(1), day(10 * i)) for i in range(8)] + [(2, "d", 90 + i, 1, 1, Decimal(1), day(i)) for i in range(3)]
    make = orders(spark, rows)
    before = {x.order_id: x.days_since_last_purchase for x in make(rows).collect()}
    after = sales.report_after(make(rows), make([(1, "c", 50, 1, 1, Decimal(1), day(33))], False))
    after = {x.order_id: x.days_since_last_purchase for x in after.collect()}
    assert after.pop(50) == 3 and {k: v for k, v in after.items() if before[k] != v} == {4: 7}


def test_moved_bound(spark):
    """Expired customers go, null totals stay null, and moving back restores."""
    none = None
    rows = [
        (1, "a", 1, 1, 1, Decimal("5.00"), dt.date(2001, 1, 10)), (1, "a", 2, 2, 1, Decimal("7.00"), dt.date(2001, 3, 1)),
        (1, "a", 3, 1, 1, none, dt.date(2001, 7, 1)), (2, "b", 4, 3, 1, none, dt.date(2001, 2, 28)), (2, "b", 5, 3, 1, none, none),
        (3, "c", 6, 1, 1, Decimal("1.00"), dt.date(2001, 2, 1)), (4, "d", 7, 1, 1, Decimal("1.00"), dt.date(2001, 2, 2)),
    ]
    full = orders(spark, rows)(rows, False)
    daily, last = materialize(sales.daily_purchases(full), "d"), materialize(sales.last_purchases(full), "l")
    at = "2001-07-01 00:00:00"
    parts = sales.purchases_since(daily, last, dialect.months_before(at, 6))
    for to in (at, "2001-08-01 12:00:00", "2001-08-01 00:00:00", "2003-01-01 00:00:00", "2001-05-01 00:00:00"):
        parts, at = materialize(sales.moved_purchases(parts, daily, last, at, to), "p"), to
        expect = sales.cumulative_purchases(full, to).collect()
        assert sorted(map(tuple, sales.cumulative_of(parts).collect())) == sorted(map(tuple, expect)), to
    assert len(expect) == 4


def test_bin_widths(spark):
    rows = [("even", i) for i in range(1000)] + [("same", 7)] * 50 + [("half", 3)] * 90 + [("half", 1000)] * 10 + [("none", None), (None, 5), (None, 9)]
    df = spark.createDataFrame(rows, "city_name string, x int")
    w = {r.city_name: r.width for r in report.bin_widths(df, "x").collect()}
    assert w == {"even": 100, "same": 1, "half": 200, None: 10}  # 2 * 500 / 10; one value; (1000 - 3) / 7.6; 2 * 4 / 1.26
    bins = report.auto_histogram(df, "x").collect()
    assert sum(r.n for r in bins) == len(rows) - 1
    assert {r.bin_start for r in bins if r.city_name == "even"} == set(range(0, 1000, 100))
    money = spark.createDataFrame([("a", Decimal("0.07")), ("a", Decimal("0.31"))], "city_name string, x decimal(10,2)")
    assert all(r.bin_start <= Decimal("0.31") and r.bin_width in (Decimal("0.20"), Decimal("0.50")) for r in report.auto_histogram(money, "x", scale=2).collect())


def exchanges(df):
    """Shuffles of the plan, no side being small enough to broadcast."""
    with settings(df.sparkSession, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        again = df.select("*")
        return str(again._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


def test_rows_are_shuffled_once_for_their_days(spark):
    """The rows once, and their groups three times; of a report, only the first
    rows of groups and the late rows."""
    make = orders(spark, None)
    report = make([(1, "c", i, 1, 1, Decimal(1), day(i)) for i in range(5)])
    assert exchanges(sales._days_since_last(report.drop("days_since_last_purchase"))) == 4
    after = sales.report_after(report, report.where("order_id = 3"))
    assert exchanges(after) == 4
    again = report.withColumn("days_since_last_purchase", F.lit(0))  # nothing is first, so nothing is looked at
    assert sales.report_after(again, report.limit(0)).where("days_since_last_purchase <> 0").count() == 0


def test_running_total_writes_what_it_reads(spark, monkeypatch):
    from tern.plans import driver_queries as q

    seen = {}
    monkeypatch.setattr(q, "materialize", lambda df, name: seen.setdefault(name, materialize(df, name)))
    assert q.running_units_by_sale(spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(seen["sales-report"].columns) == sorted(sales.SALE)
