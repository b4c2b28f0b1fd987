"""Weather rollups and report figures (FIXTURES §3: city_two_places,
weather_no_hours, rounding, speeds)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tern.functions import dialect
from tern.functions.geo import GEOGRAPHY_TYPE
from tern.operators import report, weather

WEATHER_SCHEMA = (
    "city_name string, latitude double, longitude double, datetime timestamp_ntz, humidity_relative double, "
    "minutes_of_precipitation double, minutes_of_rain double, precipitation_lwe double, precipitation_type int, "
    "rain_lwe double, temperature double, wind_gust double, wind_speed double"
)


def wrow(city, lat, lon, hour, rain_min, precip, temp, ptype=1):
    return (city, lat, lon, dt.datetime(2024, 1, 1, hour, 0), 50.0, rain_min, rain_min, precip, ptype,
            precip if ptype == 1 else 0.0, temp, 10.0, 5.0)


def seg(fid, lon, lat):
    return (fid, fid, ("LineString", [[(lon - 0.01, lat), (lon + 0.01, lat)]]))


def test_city_two_places_weighted(spark):
    # "A" has two coordinates: 2 segments near the first, 1 near the second,
    # none near "B" (which therefore drops out, as in the inner join).
    w = spark.createDataFrame([
        wrow("A", 10.0, 10.0, 3, 10.0, 0.10, 50.0),
        wrow("A", 12.0, 12.0, 3, 40.0, 0.30, 81.0),
        wrow("A", 12.0, 12.0, 3, None, 0.01, None),
        wrow("B", 30.0, 30.0, 3, 5.0, 0.50, 60.0),
        wrow("A", 10.0, 10.0, 4, 1.0, 0.20, 40.0, ptype=2),  # snow: not rain
    ], WEATHER_SCHEMA)
    hw = spark.createDataFrame([seg(1, 10.0, 10.0), seg(2, 10.001, 10.0), seg(3, 12.0, 12.0)],
                               f"fid long, object_id int, geography_linestring {GEOGRAPHY_TYPE}")
    out = weather.rain_by_city_hour(w, hw).collect()
    assert len(out) == 1
    r = out[0]
    # plain join rows: (10, 0.10, 50) x2, (40, 0.30, 81) x1, (NULL, 0.01, NULL) x1
    assert r.city_name == "A" and r.hour == 3
    assert r.minutes_of_rain == 20  # (10+10+40)/3
    assert r.total_precipitation == Decimal("0.51")
    assert r.avg_termperature == Decimal("60.33")  # (50+50+81)/3
    assert r.roadway_segments_impacted == 4


def test_weather_no_hours_keeps_segments(spark):
    w = spark.createDataFrame([wrow("A", 10.0, 10.0, 3, 10.0, 0.1, 50.0)], WEATHER_SCHEMA)
    sub = spark.createDataFrame([("A", 1, 5, 1000, "x"), ("A", 2, 6, 2000000, "y")],
                                "city_name string, fid long, speed_limit int, average_annual_daily_traffic int, geojson string")
    out = weather.highways_with_weather(sub, w, 8, 11).collect()
    assert len(out) == 2 and all(r.avg_temperature is None for r in out)
    assert sorted(r.average_annual_daily_traffic for r in out) == ["      1,000", "  2,000,000"]
    hit = weather.highways_with_weather(sub, w, 0, 3).collect()
    assert all(r.avg_temperature == Decimal("50.0") for r in hit)


def test_rounding_rules(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.255,), (2.345,)], "x double")
    out = df.select(dialect.round_to_int("x").alias("i"), F.col("x").cast("decimal(38,2)").alias("d")).collect()
    assert [r.i for r in out] == [3, -3, 0, 2]
    assert [str(r.d) for r in out] == ["2.50", "-2.50", "0.26", "2.35"]


def test_speeds(spark):
    sub = spark.createDataFrame(
        [("A", s, m) for s, m in [(55, 1.0), (65, 2.0), (55, 0.5), (65, 0.25), (0, 0.3), (None, 0.0)]],
        "city_name string, speed_limit int, miles double").withColumn("miles", F.col("miles").cast("decimal(38,2)")).withColumn(
        "year", F.lit(None).cast("int"))
    st = report.speed_stats(sub).first()
    assert (st.mode_speed, st.max_speed, st.min_speed) == (55, 65, 55)
    k = report.segment_kpis(sub).first()
    assert k.total_segments == 6 and k.avg_speed_limit == Decimal("60.00000000")
    assert k.records_with_year == 0 and str(k.total_miles) == "4.05"
    hist = {r.bin_start: r.n for r in report.histogram(sub, "speed_limit", 5).collect()}
    assert hist == {0: 1, 55: 2, 65: 2}  # 0 kept, NULL excluded
    mh = {str(r.bin_start): r.n for r in report.histogram(sub, "miles", 0.05, scale=2).collect()}
    assert mh["0.25"] == 1 and mh["0.30"] == 1 and mh["0.00"] == 1


def test_hourly_trends_and_summary(spark):
    w = spark.createDataFrame([
        wrow("A", 1.0, 1.0, 1, 1.0, 0.1, 50.0), wrow("A", 1.0, 1.0, 1, 2.0, 0.2, 51.0),
        wrow("A", 1.0, 1.0, 2, 3.0, 0.3, 60.0),
    ], WEATHER_SCHEMA)
    h = weather.hourly_trends(w)
    rows = {r.hour_of_day: r for r in h.collect()}
    assert rows[1].temperature == Decimal("50.50000000") and rows[1].rain_lwe == Decimal("0.30")
    s = weather.trend_summary(h).first()
    assert s.avg_temperature == Decimal("55.2500")  # mean of hourly means, not of rows
    assert s.total_precipitation == Decimal("0.60")


def test_fill_and_empty(spark):
    df = spark.createDataFrame([(None, None), ("x", 1.5)], "s string, d double")
    out = report.fill_for_display(df).collect()
    assert out[0].s == "N/A" and out[0].d == 0.0
    assert report.is_empty(df.where("d > 10")) and not report.is_empty(df)


def test_fine_measures_are_not_cut(spark):
    rows = [wrow("A", 1.0, 1.0, 3, 1.0, 0.004, 50.0005)] * 1000 + [wrow("B", 1.0, 1.0, 3, 1.0, 1e10, 1e10)] * 1000
    w = spark.createDataFrame(rows, WEATHER_SCHEMA)
    got = {r.city_name: r for r in weather.weather_summary(w).collect()}
    assert got["A"].total_precipitation == Decimal("4.00") and got["B"].total_precipitation == Decimal(10**13)
    assert got["A"].avg_temperature == Decimal("50.0") and got["B"].avg_temperature == Decimal(10**10)
    h = {r.city_name: r for r in weather.hourly_trends(w).collect()}
    assert h["A"].temperature == Decimal("50.0005") and h["A"].rain_lwe == Decimal("4")


def test_hourly_rows_of_one_city(spark):
    w = spark.createDataFrame([wrow("A", 1.0, 1.0, 5, 1.0, 0.1, 1.0), wrow("A", 1.0, 1.0, 2, 1.0, 0.1, 1.0), wrow("B", 1.0, 1.0, 3, 1.0, 0.1, 1.0),
                               wrow("A", 1.0, 1.0, 9, 1.0, 0.1, 1.0)], WEATHER_SCHEMA)
    out = weather.hourly_rows(w, 2, 5, "A")
    assert [r.hour_of_day for r in out.collect()] == [2, 5] and set(w.columns) <= set(out.columns)
