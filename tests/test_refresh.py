"""Incremental refresh of the sales tables (FIXTURES §3: batch_replay,
bucket_emptied) and the invariant: after every batch each table equals its
defining query run in full on the consumed orders, at any moment asked for."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tern.operators import sales
from tern.sources import datagen
from tern.streaming.refresh import TABLES, SalesRefresh

DAY = dt.date(2024, 1, 10)
AS_OF = "2024-01-10 12:00:00"


def rows(df, drop=("rowcreationtime",)):
    cols = sorted(c for c in df.columns if c not in drop)
    return sorted(tuple(repr(r[c]) for c in cols) for r in df.select(*cols).collect())


def full_tables(job, orders, as_of=AS_OF):
    co = sales.customer_orders(job.customers, orders)
    sr = sales.sales_report(co, job.products)
    return {
        "customer_orders": co,
        "sales_report": sr,
        "cumulative_purchases": sales.cumulative_purchases(sr, as_of, job.months),
        "product_inventory_alert": sales.product_inventory_alert(sr, job.products, with_creation_time=False),
    }


def check(job, *batches, as_of=AS_OF, names=TABLES):
    """The tables equal the defining queries on the given batches."""
    orders = batches[0]
    for b in batches[1:]:
        orders = orders.unionByName(b)
    full = full_tables(job, orders, as_of)
    for name in names:
        assert rows(job.read(name, as_of)) == rows(full[name]), name


def make_job(spark, workdir, buckets=8, **how):
    customers = datagen.generate_customers(spark, 12)
    products = datagen.generate_products(spark, 6, DAY)
    return SalesRefresh(spark, os.path.join(workdir, "tables"), os.path.join(workdir, "landing"), customers, products, buckets, **how)


def land(spark, job, n, start, seed, name, day=DAY):
    df = datagen.generate_sales(spark, n, start, day, seed=seed, n_customers=14, n_products=7)
    datagen.write_json_batch(df, os.path.join(job.landing, name))
    return df


def run(job):
    job.start().awaitTermination()


def test_incremental_equals_full_with_replay(spark, workdir):
    job = make_job(spark, workdir)
    b0 = land(spark, job, 60, 1, 1, "b0")
    run(job)
    check(job, b0)
    b1 = land(spark, job, 40, 1000, 2, "b1")
    run(job)
    check(job, b0, b1)
    # the same micro-batch delivered again under its id: no change
    job.refresh_batch(b1, 1)
    check(job, b0, b1)
    # late, out-of-order dates re-rank following rows (LAG): still equal
    b2 = land(spark, job, 30, 5000, 3, "b2", DAY - dt.timedelta(days=5))
    run(job)
    check(job, b0, b1, b2)
    job.refresh_batch(b0, 0)  # an old one too
    check(job, b0, b1, b2)


def test_moments(spark, workdir):
    """Expired purchases are left out without a batch; at last none is left."""
    job = make_job(spark, workdir, buckets=4)
    b0 = land(spark, job, 50, 1, 4, "b0")
    run(job)
    for days, left in ((0, True), (150, True), (179, True), (600, False)):
        moment = (dt.datetime(2024, 1, 10, 12) + dt.timedelta(days=days)).isoformat(sep=" ")
        check(job, b0, as_of=moment, names=["cumulative_purchases"])
        assert (job.read("cumulative_purchases", moment).count() > 0) == left or days == 179
    assert job.read("cumulative_purchases").count() == 0  # now: years later


def test_stop_and_start(spark, workdir):
    """A stopped stream leaves the tables alone; started again it catches up."""
    job = make_job(spark, workdir)
    b0 = land(spark, job, 40, 1, 5, "b0")
    run(job)
    b1 = land(spark, job, 40, 1000, 6, "b1")
    b2 = land(spark, job, 10, 2000, 7, "b2")
    check(job, b0)
    again = make_job(spark, workdir)  # another process, the same tables
    run(again)
    check(again, b0, b1, b2)


def test_changed_static_input(spark, workdir):
    job = make_job(spark, workdir)
    b0 = land(spark, job, 40, 1, 5, "b0")
    run(job)
    job.products = datagen.generate_products(spark, 4, DAY, seed=9)
    b1 = land(spark, job, 10, 3000, 8, "b1")  # landed, not consumed
    job.full_refresh()
    check(job, b0)
    run(job)
    check(job, b0, b1)


def test_processing_time_trigger(spark, workdir):
    """The freshness target (LAG = '1 MINUTE') as a processing-time trigger:
    a running stream picks up files as they land."""
    job = make_job(spark, workdir, tables=["customer_orders"])
    b0 = land(spark, job, 30, 1, 9, "b0")
    q = job.start({"processingTime": "1 second"})
    try:
        q.processAllAvailable()
        b1 = land(spark, job, 20, 500, 10, "b1")
        q.processAllAvailable()
    finally:
        q.stop()
    check(job, b0, b1, names=["customer_orders"])
    assert job.orders().count() == 50
    with pytest.raises(KeyError):
        job.read("sales_report")
    with pytest.raises(ValueError):
        make_job(spark, workdir, tables=["sales_reports"])


@pytest.mark.parametrize("lost", ["customer_orders", "daily", "units"])
def test_failure_within_a_batch(spark, workdir, monkeypatch, lost):
    """A write fails half-way; the batch comes again under its number."""
    job = make_job(spark, workdir)
    b0, b1 = (land(spark, job, 30, 1 + 1000 * i, 31 + i, f"b{i}") for i in (0, 1))
    job.refresh_batch(b0, 0)
    write = job._replace

    def fails(name, *rest):
        if name == lost:
            raise OSError("lost")
        write(name, *rest)

    with monkeypatch.context() as m:
        m.setattr(job, "_replace", fails)
        with pytest.raises(OSError):
            job.refresh_batch(b1, 1)
    job.refresh_batch(b1, 1)
    check(job, b0, b1)


def test_empty_tables(spark, workdir):
    job = make_job(spark, workdir)
    job.refresh_batch(spark.createDataFrame([], "sales_data variant"), 0)
    for name in TABLES:
        assert job.read(name).count() == 0
    b1 = land(spark, job, 20, 1, 71, "b1")
    job.refresh_batch(b1, 1)
    check(job, b1)


def test_malformed_record_fails_the_batch(spark, workdir):
    job = make_job(spark, workdir)
    land(spark, job, 5, 1, 81, "b0")
    with open(os.path.join(job.landing, "b0", "bad.json"), "w") as f:
        f.write('{"order_id": 1,\n')
    with pytest.raises(Exception, match="MALFORMED"):
        run(job)


def test_a_batch_of_one_customer_rewrites_one_bucket(spark, workdir):
    job = make_job(spark, workdir, buckets=12)
    b0 = land(spark, job, 120, 1, 91, "b0")
    run(job)
    files = lambda: {b: {f for f in os.listdir(f"{job.path('sales_report')}/{b}")} for b in os.listdir(job.path("sales_report")) if b.startswith("bucket=")}
    old = files()
    one = b0.where(F.expr("variant_get(sales_data, '$.custid', 'bigint') = 1003")).limit(1)
    assert one.count() == 1 and len(old) > 4
    job.refresh_batch(one, 1)
    new = files()
    assert set(new) == set(old) and sum(new[b] != old[b] for b in old) == 1
    check(job, b0, one)


def test_a_batch_leaves_the_parts_of_earlier_ones(spark, workdir):
    """What adds up is written once per order, and the landed text is compressed;
    a product bought in two batches counts once."""
    job = make_job(spark, workdir, buckets=2)
    b0 = land(spark, job, 60, 1, 1, "b0")
    run(job)
    names = ("customer_orders", "daily", "last", "units")
    files = lambda: {p: sorted(os.listdir(p)) for n in names for b in range(2) if os.path.isdir(p := f"{job.path(n)}/bucket={b}/batch_id=0")}
    old = files()
    assert len(old) == 8
    job.refresh_batch(b0.limit(30), 1)
    assert files() == old
    check(job, b0, b0.limit(30))
    job.full_refresh()
    job.refresh_batch(b0, 0)
    check(job, b0, b0.limit(30))
    assert [f for f in os.listdir(f"{job.landing}/b0") if f.startswith("part-")] and all(f.endswith(".gz") for f in os.listdir(f"{job.landing}/b0") if f.startswith("part-"))


def test_a_batch_does_not_rewrite_the_settled_rows(spark, workdir):
    """Rows that later ones cannot change stay as they were written; the first
    rows of a customer and date are kept once, with late dates, a repeated batch
    and orders without a date or a product too."""
    job = make_job(spark, workdir, buckets=2, tables=["sales_report"])
    batches = [land(spark, job, 150, 1 + 1000 * i, 51 + i, f"b{i}", DAY - dt.timedelta(days=late)) for i, late in enumerate((2, 4, 1))]
    undated = spark.sql("""SELECT parse_json('{"order_id": 9, "custid": 1003, "purchase": {"product_id": 102, "quantity": 1, "order_total": 5.0}}') AS sales_data""")
    batches[0] = batches[0].unionByName(undated)
    settled = lambda n: {p: sorted(os.listdir(p)) for b in range(2) if os.path.isdir(p := f"{job.path('sales_report')}/bucket={b}/batch_id={n}/first=false")}
    old = {}
    for i, b in enumerate(batches):
        job.refresh_batch(b, i)
        check(job, *batches[: i + 1], names=["sales_report"])
        assert all(settled(n) == files for n, files in old.items())
        old[i] = settled(i)
        assert old[i]
        written = job.spark.read.parquet(job.path("sales_report"))
        assert written.count() == job.read("sales_report").count()
    for again in (2, 0):
        job.refresh_batch(batches[again], again)
        check(job, *batches, names=["sales_report"])


def test_batches_written_in_one_pass_land_one_by_one(spark, workdir):
    orders = datagen.generate_sales(spark, 30, 1, DAY, seed=3, n_customers=14, n_products=7).withColumn("batch", F.expr("variant_get(sales_data, '$.order_id', 'int') % 2"))
    written, landing = os.path.join(workdir, "written"), os.path.join(workdir, "landing")
    datagen.write_json_batch(orders, written, by=("batch",))
    for i, n in enumerate((15, 30, 30)):  # there is no third one
        datagen.land(spark, f"{written}/batch={i}", landing)
        assert spark.read.option("recursiveFileLookup", "true").text(landing).count() == n
