"""Table definition, writes, copy / update / promote.

Tables are Parquet tables in the Spark catalog.  Parquet has no UPDATE, no
identity columns and no atomic swap, so:

* ``update_table`` writes the updated rows to a new table and renames it
  into place (the source is never overwritten while it is being read, and
  is dropped only after the new table has its name);
* ``with_identity`` numbers rows 1..n from per-partition counts and offsets
  of the rows as written once (no single-partition window); writers that append
  to one table at a time of their own take ids from ranges that they reserve
  before they write (``reserve_ids``, ``append_with_identity``);
* ``swap_tables`` is three renames through a temporary name; it is not
  atomic for concurrent readers, and a swap interrupted half-way is
  completed by calling it again (the temporary name records the state).
* ``clone_table`` copies the data (a metadata-only clone would need a
  storage engine; not built).
"""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tern.session import materialize


def create_database(spark: SparkSession, name: str) -> None:
    """``CREATE DATABASE IF NOT EXISTS``."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def create_table(spark: SparkSession, name: str, schema: StructType, replace: bool = True) -> None:
    """``CREATE OR REPLACE TABLE t (cols…)`` (S11): an empty Parquet table."""
    if replace:
        drop_table(spark, name)
    spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)


def insert_with_identity(spark: SparkSession, name: str, rows: Iterable[tuple], columns: list[str], identity: str) -> None:
    """``INSERT`` into a table with an ``AUTOINCREMENT`` column: new ids
    continue after the table's current maximum."""
    target = spark.table(name)
    start = (target.agg(F.max(identity)).first()[0] or 0) + 1
    df = spark.createDataFrame(list(rows), StructType([target.schema[c] for c in columns]))
    df = with_identity(df, identity, start=start).withColumn(identity, F.col(identity).cast(target.schema[identity].dataType))
    df.select(*target.columns).write.insertInto(name)


def create_table_as(df: DataFrame, name: str, order_by: list[str] | None = None) -> None:
    """``CREATE OR REPLACE TABLE t AS SELECT … [ORDER BY …]``.
    The order is kept inside each file (range-partitioned and sorted); a
    table read has no row order guarantee."""
    spark = df.sparkSession
    tmp = f"{name}__tern_ctas"
    _finish_replacement(spark, name, tmp)
    drop_table(spark, tmp)
    out = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df
    out.write.format("parquet").saveAsTable(tmp)
    _replace(spark, name, tmp)


def _replace(spark: SparkSession, name: str, new: str) -> None:
    """Put the complete table ``new`` in the place of ``name``: the old table
    is renamed aside, the new one in, and only then the old one dropped, so at
    every moment one complete copy exists under a known name."""
    old = f"{name}__tern_old"
    if _exists(spark, name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    drop_table(spark, old)


def _finish_replacement(spark: SparkSession, name: str, new: str) -> bool:
    """Complete a replacement that was interrupted between its renames (the
    old table stands aside, which is done only once ``new`` is complete).
    True if the new table was put in place by this call or before it."""
    old = f"{name}__tern_old"
    if not _exists(spark, old):
        return False
    if not _exists(spark, name):
        spark.sql(f"ALTER TABLE {new if _exists(spark, new) else old} RENAME TO {name}")
    drop_table(spark, old)
    return True


def drop_table(spark: SparkSession, name: str, if_exists: bool = True) -> None:
    """``DROP TABLE [IF EXISTS]``."""
    spark.sql(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{name}")


def clone_table(spark: SparkSession, src: str, dst: str) -> None:
    """``CREATE OR REPLACE TABLE dst CLONE src`` (S16) as a data copy; both
    tables evolve independently afterwards."""
    create_table_as(spark.table(src), dst)


def updated(df: DataFrame, assignments: dict[str, Column], where: Column | None = None) -> DataFrame:
    """The rows of ``UPDATE t SET c = expr [WHERE p]`` as a DataFrame.
    A NULL predicate leaves the row unchanged (as SQL)."""
    out = df
    for name, expr in assignments.items():
        value = expr if where is None else F.when(where, expr).otherwise(F.col(name))
        out = out.withColumn(name, value.cast(df.schema[name].dataType))
    return out


def update_table(spark: SparkSession, name: str, assignments: dict[str, Column], where: Column | None = None) -> None:
    """``UPDATE`` (S17): new table with the updated rows, renamed into place.

    Called again after an interruption, it completes an update whose new table
    was already complete instead of applying the assignments a second time;
    before that point the old table is untouched and the update starts anew.
    """
    new = f"{name}__tern_upd"
    if _finish_replacement(spark, name, new):
        return
    drop_table(spark, new)
    updated(spark.table(name), assignments, where).write.format("parquet").saveAsTable(new)
    _replace(spark, name, new)


def _exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def swap_tables(spark: SparkSession, a: str, b: str) -> None:
    """``ALTER TABLE a SWAP WITH b`` (S18) as renames a->tmp, b->a, tmp->b.
    Re-running after a failure finishes the remaining renames.  A missing
    table raises before anything is renamed."""
    tmp = f"{a}__tern_swap"
    if not _exists(spark, tmp):
        missing = [t for t in (a, b) if not _exists(spark, t)]
        if missing:
            raise ValueError(f"cannot swap, no table {missing}")
        spark.sql(f"ALTER TABLE {a} RENAME TO {tmp}")
    if not _exists(spark, a):
        spark.sql(f"ALTER TABLE {b} RENAME TO {a}")
    if not _exists(spark, b):
        spark.sql(f"ALTER TABLE {tmp} RENAME TO {b}")


def with_identity(df: DataFrame, col: str, start: int = 1, order_by: list[str] | None = None) -> DataFrame:
    """Dense ids ``start..start+n-1`` (S12, ``AUTOINCREMENT``).

    With ``order_by`` the ids follow that order (ties: any order among equal
    keys, so give a unique key); without, they follow the input's partition
    order.  The numbered input is one fixed thing: the rows, range-partitioned
    and sorted, are written once as Parquet in the shared folder together with
    their position (partition id and row number within it).  Counts per
    partition and the rows themselves are both read from those files, so they
    cannot disagree.  The counts are one row per partition; turned into offsets
    by a window over that small table they are broadcast, with the partition
    count as their size bound.  Raises if the output would not have as many
    rows as were written.
    """
    src = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df
    tagged = materialize(src.withColumn("_tid_m", F.monotonically_increasing_id()), "identity")
    # monotonically_increasing_id = (partition id << 33) + row position.
    part = F.shiftrightunsigned("_tid_m", 33)
    counts = tagged.groupBy(part.alias("_tid_p")).agg(F.count(F.lit(1)).alias("_tid_n"), F.max("_tid_m").alias("_tid_last"))
    counts = materialize(counts, "identity-counts")
    gap = counts.where(F.col("_tid_last") != F.shiftleft("_tid_p", 33) + F.col("_tid_n") - 1)
    if not gap.isEmpty():
        raise RuntimeError("the written rows are not numbered without gaps")
    w = Window.orderBy("_tid_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_tid_p", F.coalesce(F.sum("_tid_n").over(w), F.lit(0)).alias("_tid_o"))
    out = tagged.withColumn("_tid_p", part).join(F.broadcast(offsets), "_tid_p", "inner")
    pos = F.col("_tid_m") - F.shiftleft("_tid_p", 33)
    ident = F.col("_tid_o") + pos + F.lit(start)
    return out.select(ident.alias(col), *df.columns)


def reserve_ids(spark: SparkSession, ledger: str, n: int, block: int = 1_000_000) -> list[int]:
    """Ranges of ``block`` numbers, ``n`` together at least, that nobody else has
    or gets: the first number of each, from 0.

    A range is claimed by creating its file in the folder ``ledger``, which is
    given to one caller only where the file system creates files exclusively
    (HDFS does; an object store may not).  A claim is never given back, so a
    write that fails leaves a gap, as a warehouse's sequence does.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    folder = fs_path(ledger)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    k, got = max((int(x) for x in names if x.isdigit()), default=-1) + 1, []
    while len(got) * block < n:
        try:
            fs.create(fs_path(folder, str(k)), False).close()
            got.append(k * block)
        except Py4JJavaError as e:
            if "exist" not in str(e.java_exception).lower():
                raise
        k += 1
    return got


def append_with_identity(spark: SparkSession, name: str, df: DataFrame, identity: str, ledger: str, start: int = 1,
                         block: int = 1_000_000) -> None:
    """``INSERT`` of ``df`` into a table with an ``AUTOINCREMENT`` column whose
    writers share the ``ledger``: ids are unique whatever the order in which
    writes reserve, run and end, ascending within a write, and have gaps.
    ``start`` is the table's first id; all writers give the same.
    """
    rows = materialize(with_identity(df, "_tid_i", start=0), "append")
    ranges = reserve_ids(spark, ledger, rows.count(), block)
    if not ranges:
        return
    i, target = F.col("_tid_i"), spark.table(name)
    number = F.element_at(F.array(*[F.lit(r).cast("long") for r in ranges]), (F.floor(i / block) + 1).cast("int")) + i % block + start
    rows.withColumn(identity, number.cast(target.schema[identity].dataType)).select(*target.columns).write.insertInto(name)


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``PRIMARY KEY`` as a check on request (S13): key values that occur
    more than once (with their count) plus, as one row with NULL keys, the
    number of rows with a NULL key part.  Empty result = unique."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)
    any_null = None
    for k in keys:
        any_null = F.col(k).isNull() if any_null is None else (any_null | F.col(k).isNull())
    dup = dup.where(~any_null)
    nulls = df.where(any_null).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 0)
    for k in keys:
        nulls = nulls.withColumn(k, F.lit(None).cast(df.schema[k].dataType))
    return dup.unionByName(nulls.select(*keys, "occurrences"))
