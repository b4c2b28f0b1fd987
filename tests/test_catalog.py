"""Copy / update / promote (FIXTURES §1: the six literal customers)."""

import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tern.sources import catalog

ROWS = [
    ("Acme Corp", "Technology", 5),
    ("Greenfield Logistics", "Transportation", 3),
    ("Summit Financial", "Finance", 7),
    ("Bright Horizons Marketing", "Marketing", 2),
    ("Everest Publishing", "Publishing", 4),
    ("Insight Consulting Group", "Consulting", 6),
]
SCHEMA = StructType([
    StructField("CustomerID", IntegerType()),
    StructField("Name", StringType()),
    StructField("Industry", StringType()),
    StructField("DurationAsCustomer", IntegerType()),
])


def durations(spark, t):
    return [r.DurationAsCustomer for r in spark.table(t).orderBy("CustomerID").collect()]


def test_clone_update_swap(spark):
    db = f"demo_{uuid.uuid4().hex[:8]}"
    catalog.create_database(spark, db)
    prod, dev = f"{db}.customers", f"{db}.customers_dev"
    catalog.create_table(spark, prod, SCHEMA)
    catalog.insert_with_identity(spark, prod, [r for r in ROWS], ["Name", "Industry", "DurationAsCustomer"], "CustomerID")
    assert [r.CustomerID for r in spark.table(prod).orderBy("CustomerID").collect()] == [1, 2, 3, 4, 5, 6]
    catalog.clone_table(spark, prod, dev)
    catalog.update_table(spark, dev, {"DurationAsCustomer": F.col("DurationAsCustomer") * 12})
    assert durations(spark, prod) == [5, 3, 7, 2, 4, 6]  # the update left the source alone
    catalog.swap_tables(spark, dev, prod)
    assert durations(spark, prod) == [60, 36, 84, 24, 48, 72]
    assert durations(spark, dev) == [5, 3, 7, 2, 4, 6]
    catalog.swap_tables(spark, dev, prod)
    catalog.swap_tables(spark, dev, prod)  # swap twice = identity
    assert durations(spark, prod) == [60, 36, 84, 24, 48, 72]
    catalog.drop_table(spark, dev)
    assert not spark.catalog.tableExists(dev)
    # an update with a predicate; NULL predicate leaves the row
    catalog.update_table(spark, prod, {"DurationAsCustomer": F.lit(0)}, where=F.col("Industry") == "Finance")
    assert durations(spark, prod) == [60, 36, 0, 24, 48, 72]
    spark.sql(f"DROP DATABASE {db} CASCADE")


def test_identity_dense_and_unique(spark):
    df = spark.range(0, 1000, 1, numPartitions=7).select((F.col("id") * 3 % 1000).alias("k"))
    ids = catalog.with_identity(df, "rid", start=10, order_by=["k"])
    rows = ids.collect()
    assert sorted(r.rid for r in rows) == list(range(10, 1010))
    assert all(a.k < b.k for a, b in zip(sorted(rows, key=lambda r: r.rid), sorted(rows, key=lambda r: r.rid)[1:]))
    dup = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 3)], "a int, b int")
    res = sorted((r.a, r.b, r.occurrences) for r in catalog.check_unique(dup, ["a", "b"]).collect()
                 if r.a is not None)
    nulls = [r.occurrences for r in catalog.check_unique(dup, ["a", "b"]).collect() if r.a is None]
    assert res == [(1, 1, 2)] and nulls == [1]


def test_interrupted_replacement_keeps_the_table(spark):
    db = f"demo_{uuid.uuid4().hex[:8]}"
    catalog.create_database(spark, db)
    t = f"{db}.t"
    twelve = {"a": F.col("a") * 12}
    rows = lambda: sorted(r.a for r in spark.table(t).collect())
    catalog.create_table_as(spark.range(3).select(F.col("id").alias("a")), t)
    # interrupted with the old table aside and the new one complete
    catalog.updated(spark.table(t), twelve).write.saveAsTable(f"{t}__tern_upd")
    spark.sql(f"ALTER TABLE {t} RENAME TO {t}__tern_old")
    catalog.update_table(spark, t, twelve)
    assert rows() == [0, 12, 24] and not spark.catalog.tableExists(f"{t}__tern_old")
    # interrupted before the drop of the old table
    spark.table(t).write.saveAsTable(f"{t}__tern_old")
    catalog.update_table(spark, t, twelve)
    assert rows() == [0, 12, 24]
    # interrupted while the new table was written
    spark.range(1).select(F.col("id").alias("a")).write.saveAsTable(f"{t}__tern_upd")
    catalog.update_table(spark, t, twelve)
    assert rows() == [0, 144, 288]
    with pytest.raises(ValueError):
        catalog.swap_tables(spark, t, f"{db}.nothing")
    assert rows() == [0, 144, 288]
    spark.sql(f"DROP DATABASE {db} CASCADE")


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_identity_over_many_partitions(spark, aqe):
    """600,000 rows, all columns, several partitions: every row once, in order."""
    li = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    keys = ["l_orderkey", "l_linenumber"]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        ids = catalog.with_identity(li, "rid", order_by=[*keys, *[c for c in li.columns if c not in keys]])
        n = li.count()
        got = ids.agg(F.count("*"), F.countDistinct("rid"), F.min("rid"), F.max("rid")).first()
        assert tuple(got) == (n, n, 1, n)
        # ids ascend with the keys: between any two orders, the smaller one's last id comes first
        ends = ids.groupBy("l_orderkey").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"))
        w = Window.orderBy("l_orderkey")
        assert ends.withColumn("before", F.lag("hi").over(w)).where("before >= lo").count() == 0
        assert ids.drop("rid").exceptAll(li).isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_appending_writers_share_no_id(spark, workdir, monkeypatch):
    """The second writer reserves and writes while the first one is between its
    reservation and its write; ranges that are smaller than the writes."""
    db = f"demo_{uuid.uuid4().hex[:8]}"
    catalog.create_database(spark, db)
    t, ledger = f"{db}.t", f"{workdir}/ids"
    catalog.create_table(spark, t, StructType([StructField("id", IntegerType()), StructField("v", StringType())]))
    rows = lambda name, n: spark.range(0, n, 1, 3).select(F.concat(F.lit(name), F.col("id").cast("string")).alias("v"))
    reserve = catalog.reserve_ids

    def interrupted(*args, **how):
        got = reserve(*args, **how)
        monkeypatch.setattr(catalog, "reserve_ids", reserve)
        catalog.append_with_identity(spark, t, rows("second ", 25), "id", ledger, block=10)
        return got

    monkeypatch.setattr(catalog, "reserve_ids", interrupted)
    catalog.append_with_identity(spark, t, rows("first ", 35), "id", ledger, block=10)
    catalog.append_with_identity(spark, t, rows("none", 0), "id", ledger, block=10)
    got = {r.v: r.id for r in spark.table(t).collect()}
    assert len(got) == 60 and len(set(got.values())) == 60 and min(got.values()) == 1
    assert {v for k, v in got.items() if k.startswith("first")} == set(range(1, 36))
    assert {v for k, v in got.items() if k.startswith("second")} == set(range(41, 66))
    # a claim that another writer makes after the listing is left to it
    listed = reserve(spark, ledger, 10, 10)
    assert listed == [70] and reserve(spark, ledger, 25, 10) == [80, 90, 100]
    spark.sql(f"DROP DATABASE {db} CASCADE")
