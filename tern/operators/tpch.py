"""The TPC-H aggregate at scale.

Measures are cast to decimal(15,2), the TPC-H column type, so every sum is
exact and the result does not depend on the order partial sums are merged in.
Catalyst folds ``date '1998-12-01' - 90 days`` into a literal and pushes it to
the Parquet scan; the aggregate runs as partial (map side) + final hash
aggregate around a single exchange on the two group keys.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of TPC-H Q1: the reference date and the 90-day delta.
Q1_BASE_DATE = "1998-12-01"
Q1_DELTA_DAYS = 90


def row_count(lineitem: DataFrame) -> DataFrame:
    """``select count(*) from lineitem`` (A1); answered from Parquet footers."""
    return lineitem.agg(F.count(F.lit(1)).alias("row_count"))


def q1(lineitem: DataFrame, delta_days: int = Q1_DELTA_DAYS, base_date: str = Q1_BASE_DATE) -> DataFrame:
    cutoff = _dt.date.fromisoformat(base_date) - _dt.timedelta(days=delta_days)
    dec = "decimal(15,2)"
    qty = F.col("l_quantity").cast(dec)
    price = F.col("l_extendedprice").cast(dec)
    disc = F.col("l_discount").cast(dec)
    tax = F.col("l_tax").cast(dec)
    disc_price = price * (F.lit(1) - disc)
    charge = disc_price * (F.lit(1) + tax)
    return (
        lineitem.where(F.col("l_shipdate") <= F.lit(cutoff))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(qty).cast("decimal(38,2)").alias("sum_qty"),
            F.sum(price).cast("decimal(38,2)").alias("sum_base_price"),
            F.sum(disc_price).cast("decimal(38,4)").alias("sum_disc_price"),
            F.sum(charge).cast("decimal(38,6)").alias("sum_charge"),
            F.avg(qty).cast("decimal(38,6)").alias("avg_qty"),
            F.avg(price).cast("decimal(38,6)").alias("avg_price"),
            F.avg(disc).cast("decimal(38,6)").alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )
