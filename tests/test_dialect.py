"""Scalar rules kept in tern.functions.dialect."""

import datetime as dt
from decimal import Decimal

import pytest

from tern.functions import dialect


def test_months_before_keeps_time_of_day(spark):
    df = spark.range(1).select(
        dialect.months_before("2024-07-15 12:30:00", 6).alias("a"),
        dialect.months_before(dt.datetime(2024, 3, 31, 8, 0), 1).alias("b"),
    )
    r = df.first()
    assert r.a == dt.datetime(2024, 1, 15, 12, 30) and r.b == dt.datetime(2024, 2, 29, 8, 0)


def test_division_types_and_zero(spark):
    df = spark.createDataFrame([(Decimal("100.01"), 3), (Decimal("5.00"), 0)], "t decimal(10,2), q long")
    out = df.select(dialect.divide("t", "q", lenient=True).alias("d")).collect()
    assert out[0].d == Decimal("33.33666667") and out[1].d is None
    assert df.select(dialect.divide("t", "q")).schema.fields[0].dataType.simpleString() == "decimal(36,8)"
    with pytest.raises(Exception):
        df.select(dialect.divide("t", "q")).collect()  # ANSI: a zero divisor raises


def test_thousands_text(spark):
    df = spark.createDataFrame([(5,), (1234567,), (999999999,), (1234567890,), (None,)], "n long")
    out = [r.t for r in df.select(dialect.to_char_thousands("n").alias("t")).collect()]
    assert out[:3] == ["          5", "  1,234,567", "999,999,999"]
    assert set(out[3].replace(",", "").replace(" ", "")) == {"#"} and out[4] is None


def test_days_between_and_hour(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 3, 1), dt.datetime(2024, 1, 1, 23, 59))],
                               "a date, b date, ts timestamp_ntz")
    r = df.select(dialect.days_between("a", "b").alias("d"), dialect.hour_of("ts").alias("h")).first()
    assert (r.d, r.h) == (60, 23)


def test_division_rounds_once_and_has_room(spark):
    df = spark.createDataFrame(
        [(Decimal("4999.999999"), 1000000), (Decimal("2000000000000"), 4), (Decimal("-0.005"), 1), (Decimal("10000000000000.05"), 3),
         (Decimal("5000"), 1000000)], "n decimal(30,9), d long")
    got = [r.q for r in df.select(dialect.divide("n", "d", 2).alias("q")).collect()]
    assert got == [Decimal("0.00"), Decimal("500000000000.00"), Decimal("-0.01"), Decimal("3333333333333.35"), Decimal("0.01")]
    assert [r.q for r in df.select(dialect.divide("n", "d", 0).alias("q")).collect()][:3] == [0, 500000000000, 0]
