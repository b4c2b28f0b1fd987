"""Weather rollups joined to highway segments (J3, J7, A6, A7, A9,
A11, A12, P9, F5, F6, F10, F13).

Averages that the reference rounds are computed as exact decimal
``sum / count`` and rounded once (``dialect.divide``), HALF_UP on the true
value, whatever order partial sums are merged in.  Measures are summed with all
their decimals (``dialect.MEASURE``); only results are rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tern.functions import dialect
from tern.operators import spatial_join
from tern.operators.highways import TWENTY_MILES_M

RAIN = 1


def _sum(col: str) -> F.Column:
    return F.sum(F.col(col).cast(dialect.MEASURE))


def _exact_avg(col: str, scale: int) -> F.Column:
    """avg(col) rounded HALF_UP to ``scale`` decimals, exact; NULL if empty."""
    return dialect.divide(_sum(col), F.count(col), scale, lenient=True)


def rain_by_city_hour(weather: DataFrame, highways: DataFrame, meters: float = TWENTY_MILES_M) -> DataFrame:
    """Rain hours per city and hour with the segments in reach (J7 + A7).

    Reference semantics: every rain row joins every segment within
    ``meters`` of its point; then per (city, hour) avg(minutes_of_rain)::int,
    sum(precipitation_lwe)::numeric(38,2), avg(temperature)::numeric(38,2),
    count(segments).  Plan (SURVEY §4.2):

    * R1: the spatial join runs on the *distinct* locations only;
    * R2: weather rows are pre-aggregated per (city, location, hour) before
      any join; each location then carries n = segments in reach and the
      sums are weighted by n.  Locations with n = 0 drop out (inner join).
      Sums stay exact decimals, so the weighting is exact.

    ``total_precipitation`` counts a row's rain once per segment in reach, as
    the reference's join does; ``precipitation_once`` beside it counts it once.
    """
    rain = weather.where(F.col("precipitation_type") == RAIN)
    locs = rain.select("latitude", "longitude").distinct()
    near = spatial_join.dwithin_pairs(locs, ["latitude", "longitude"], highways, ["fid"], meters)
    n_loc = near.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("n"))
    pre = rain.groupBy("city_name", "latitude", "longitude", dialect.hour_of("datetime").alias("hour")).agg(
        _sum("minutes_of_rain").cast(dialect.DIV_OPERAND).alias("s_rain"),
        F.count("minutes_of_rain").alias("c_rain"),
        _sum("precipitation_lwe").cast(dialect.DIV_OPERAND).alias("s_precip"),
        _sum("temperature").cast(dialect.DIV_OPERAND).alias("s_temp"),
        F.count("temperature").alias("c_temp"),
        F.count(F.lit(1)).alias("rows"),
    )
    j = pre.join(n_loc, ["latitude", "longitude"], "inner")
    n = F.col("n").cast("decimal(10,0)")  # 27 + 10 + 1 digits: products keep all decimals
    agg = j.groupBy("city_name", "hour").agg(
        F.sum(F.col("s_rain") * n).alias("w_rain"),
        F.sum(F.col("c_rain") * F.col("n")).alias("wc_rain"),
        F.sum(F.col("s_precip") * n).alias("w_precip"),
        F.sum("s_precip").alias("precip"),
        F.sum(F.col("s_temp") * n).alias("w_temp"),
        F.sum(F.col("c_temp") * F.col("n")).alias("wc_temp"),
        F.sum(F.col("rows") * F.col("n")).alias("segments"),
    )
    return agg.select(
        "city_name",
        F.col("hour").cast("int").alias("hour"),
        dialect.divide("w_rain", F.nullif("wc_rain", F.lit(0)), 0).cast("int").alias("minutes_of_rain"),
        F.col("w_precip").cast("decimal(38,2)").alias("total_precipitation"),
        F.col("precip").cast("decimal(38,2)").alias("precipitation_once"),
        dialect.divide("w_temp", F.nullif("wc_temp", F.lit(0)), 2).cast("decimal(38,2)").alias("avg_termperature"),
        F.col("segments").cast("long").alias("roadway_segments_impacted"),
    ).orderBy("hour", "city_name")


def in_hours(weather: DataFrame, hour_start: int, hour_end: int) -> DataFrame:
    """``DATE_PART('HH', datetime) BETWEEN a AND b`` (P9, inclusive)."""
    return weather.where(dialect.hour_of("datetime").between(hour_start, hour_end))


def hourly_rows(weather: DataFrame, hour_start: int = 0, hour_end: int = 23, city: str | None = None) -> DataFrame:
    """The ordered hourly rows behind the trends (O2, P2): every column and the
    hour of day, for the chosen hours and city, oldest first."""
    w = in_hours(weather, hour_start, hour_end)
    if city is not None:
        w = w.where(F.col("city_name") == city)
    return w.withColumn("hour_of_day", dialect.hour_of("datetime").cast("int")).orderBy("datetime", "city_name")


def weather_summary(weather: DataFrame, hour_start: int = 0, hour_end: int = 23, city: str | None = None) -> DataFrame:
    """The ``weather_summary`` CTE (A9): per city over the chosen hours."""
    w = in_hours(weather, hour_start, hour_end)
    if city is not None:
        w = w.where(F.col("city_name") == city)
    return w.groupBy("city_name").agg(
        F.max(F.to_date("datetime")).alias("latest_date"),
        _exact_avg("humidity_relative", 1).alias("avg_humidity"),
        _sum("rain_lwe").cast("decimal(38,2)").alias("total_precipitation"),
        F.sum("minutes_of_precipitation").alias("total_precip_minutes"),
        _exact_avg("temperature", 1).alias("avg_temperature"),
        _exact_avg("wind_speed", 1).alias("avg_wind_speed"),
    )


def highways_with_weather(subset: DataFrame, weather: DataFrame, hour_start: int = 0, hour_end: int = 23, city: str | None = None) -> DataFrame:
    """``load_highway_data`` (J3, P4, F13): subset rows LEFT JOIN the weather
    summary on city; AADT is replaced by its formatted text, the raw number
    is kept beside it as ``aadt_value``."""
    h = subset if city is None else subset.where(F.col("city_name") == city)
    w = weather_summary(weather, hour_start, hour_end, city)
    return (
        h.join(w, "city_name", "left")
        .withColumn("geojson_geometry", F.col("geojson"))
        .withColumn("aadt_value", F.col("average_annual_daily_traffic"))
        .withColumn("average_annual_daily_traffic", dialect.to_char_thousands("average_annual_daily_traffic"))
    )


def hourly_trends(weather: DataFrame, hour_start: int = 0, hour_end: int = 23, city: str | None = None) -> DataFrame:
    """``load_weather_trends`` + the pandas hourly rollup (A11): per city and
    hour of day, means of humidity, temperature, wind speed and gust, sums
    of rain and precipitation minutes (an all-missing sum is 0)."""
    w = in_hours(weather, hour_start, hour_end)
    if city is not None:
        w = w.where(F.col("city_name") == city)
    return w.groupBy("city_name", dialect.hour_of("datetime").alias("hour_of_day")).agg(
        _exact_avg("humidity_relative", 8).alias("humidity_relative"),
        _exact_avg("temperature", 8).alias("temperature"),
        _exact_avg("wind_speed", 8).alias("wind_speed"),
        _exact_avg("wind_gust", 8).alias("wind_gust"),
        F.coalesce(_sum("rain_lwe"), F.lit(0).cast(dialect.MEASURE)).cast("decimal(38,9)").alias("rain_lwe"),
        F.coalesce(F.sum("minutes_of_precipitation"), F.lit(0.0)).alias("minutes_of_precipitation"),
    )


def trend_summary(hourly: DataFrame) -> DataFrame:
    """Weather summary tiles (A12): mean of the hourly means (not the row
    mean) and the sum of hourly rain, per city."""
    return hourly.groupBy("city_name").agg(
        _exact_avg("temperature", 4).alias("avg_temperature"),
        _exact_avg("humidity_relative", 4).alias("avg_humidity"),
        F.sum("rain_lwe").cast("decimal(38,2)").alias("total_precipitation"),
        _exact_avg("wind_speed", 4).alias("avg_wind_speed"),
    )
