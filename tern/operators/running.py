"""Running totals without a task per group.

``sum(value) OVER (PARTITION BY by ORDER BY order)`` with the default RANGE
frame, for groups that may hold a third of all rows.  A plain window sorts a
whole group in one task; here the sum is taken in three steps, each combined or
bounded:

1. totals of each (group, order value), the peers of the frame: an aggregate
   with partial sums, so neither a hot group nor a hot order value is one task's;
2. these are range-partitioned by (group, order) and written once; each task's
   run of a group is summed up by a window, and a run starts with the totals of
   the group's earlier runs (no more of them than tasks);
3. the running totals meet the rows again on (group, order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tern.session import materialize


def running_totals(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """``by``, ``order`` and the running total ``name``: one row per distinct
    order value of a group, null first.  Null values do not count; the total is
    null as long as there is none else."""
    peers = rows.groupBy(by, order).agg(F.sum(value).alias("_own"))
    placed = peers.repartitionByRange(F.col(by), F.col(order).asc_nulls_first()).withColumn("_run", F.spark_partition_id())
    placed = materialize(placed, "running-runs")
    # a null total must not count as zero, so how many there are is summed too
    upto = Window.partitionBy(by, "_run").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    within = placed.select(by, order, "_run", F.sum("_own").over(upto).alias("_in"))
    runs = placed.groupBy(by, "_run").agg(F.sum("_own").alias("_total"))
    earlier = Window.partitionBy(by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col(by).alias("_by"), F.col("_run").alias("_r"), F.sum("_total").over(earlier).alias("_before"))
    met = within.join(runs, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_run") == F.col("_r")))
    total = F.when(F.col("_in").isNull(), F.col("_before")).otherwise(F.col("_in") + F.coalesce("_before", F.lit(0)))
    return met.select(by, order, total.alias(name))


def running_sum(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the running total of each row's peers."""
    totals = running_totals(rows, by, order, value, name).withColumnsRenamed({by: "_by", order: "_order"})
    met = rows.join(totals, F.col(by).eqNullSafe(F.col("_by")) & F.col(order).eqNullSafe(F.col("_order")))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], name)
