"""Report data preparation on the highway subset (A13-A18, F19, F20,
P13-P15).  Everything is an aggregate or a per-row expression; only final,
small results are meant to reach the driver (``toPandas`` after these).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tern.functions import dialect, geo

# Fixed values of the map payload estimate: 16 bytes x 2 per coordinate,
# warn above 15 MB, error above 25 MB.
BYTES_PER_COORD = 16 * 2
WARN_MB = 15
ERROR_MB = 25


def _exact_mean(col, scale: int = 8):
    c = F.col(col) if isinstance(col, str) else col
    return dialect.divide(F.sum(c.cast(dialect.MEASURE)), F.count(c), scale, lenient=True)


def segment_kpis(subset: DataFrame, by: list[str] = ["city_name"]) -> DataFrame:
    """KPI tiles and segment statistics (A13, A14, P13) in one pass."""
    speed = F.col("speed_limit")
    return subset.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.sum("miles").cast("decimal(38,2)").alias("total_miles"),
        _exact_mean(F.when(speed > 0, speed)).alias("avg_speed_limit"),
        F.count("year").alias("records_with_year"),
        F.max("miles").alias("longest_segment"),
        F.min("miles").alias("shortest_segment"),
        _exact_mean("miles").alias("avg_segment"),
    )


def speed_stats(subset: DataFrame, by: list[str] = ["city_name"]) -> DataFrame:
    """Most common / highest / lowest positive speed limit (A15); the mode
    takes the smallest value on a tie.  Groups without a positive speed
    are absent (the report shows 'no data')."""
    pos = subset.where(F.col("speed_limit") > 0)
    return pos.groupBy(*by).agg(
        F.mode("speed_limit", deterministic=True).alias("mode_speed"),
        F.max("speed_limit").alias("max_speed"),
        F.min("speed_limit").alias("min_speed"),
    )


def histogram(df: DataFrame, col: str, width, by: list[str] = ["city_name"], scale: int = 0) -> DataFrame:
    """Histogram of ``col`` with fixed bin ``width`` (A16): bin lower bound
    and count; NULL values are excluded.  For decimal columns give ``scale``
    so binning is integer arithmetic on the scaled value."""
    c = F.col(col)
    if scale:
        unit = 10**scale
        w = int(round(width * unit))
        b = F.floor((c * unit).cast("long") / w).cast("long")
        lo = (b * w).cast(f"decimal(18,{scale})") / unit
        lo = lo.cast(f"decimal(18,{scale})")
    else:
        b = F.floor(c / width).cast("long")
        lo = (b * width).cast("long")
    return df.where(c.isNotNull()).groupBy(*by, lo.alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))


def bin_widths(df: DataFrame, col: str, by: list[str] = ["city_name"], scale: int = 0) -> DataFrame:
    """``by`` and ``width``, the bin width that the values ask for (A16 without
    a given width): twice the interquartile range over the cube root of their
    number, or, where half of the values are equal, the whole range over the
    bins of Sturges' rule; rounded up to 1, 2 or 5 times a power of ten, in
    units of ``10 ** -scale``, one unit at least.

    The quartiles come from a mergeable sketch, so a group of any size is
    combined before the shuffle; their rank is off by a 10,000th at most, and
    not at all in groups of up to 10,000 values.
    """
    v = (F.col(col) * 10**scale).cast("long")
    quarter = lambda q: F.percentile_approx(v, q, 10_000)
    n = F.col("_n").cast("double")
    stats = df.where(F.col(col).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), (quarter(0.75) - quarter(0.25)).alias("_iqr"), (F.max(v) - F.min(v)).alias("_range")
    )
    wanted = F.when(F.col("_iqr") > 0, 2 * F.col("_iqr") / F.cbrt(n)).otherwise(F.col("_range") / (1 + F.log2(n)))
    stats = stats.withColumn("_w", F.greatest(wanted, F.lit(1.0))).withColumn("_p", F.pow(F.lit(10.0), F.floor(F.log10("_w"))))
    lead = F.col("_w") / F.col("_p")
    nice = F.when(lead <= 1, 1).when(lead <= 2, 2).when(lead <= 5, 5).otherwise(10) * F.col("_p")
    return stats.select(*by, nice.cast("long").alias("width"))


def auto_histogram(df: DataFrame, col: str, by: list[str] = ["city_name"], scale: int = 0) -> DataFrame:
    """Histogram of ``col`` with each group's own width (``bin_widths``): the
    bin's width and lower bound, and the count; NULL values are excluded.  The
    second of two passes; the widths are one row per group."""
    widths = bin_widths(df, col, by, scale).withColumnsRenamed({c: f"_b_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]
    met = df.where(F.col(col).isNotNull()).join(widths, same)
    v = (F.col(col) * 10**scale).cast("long")
    low = F.floor(v / F.col("width")).cast("long") * F.col("width")
    counts = met.groupBy(*by, "width", low.alias("_low")).agg(F.count(F.lit(1)).alias("n"))
    value = lambda c: (F.col(c).cast(f"decimal(18,{scale})") / 10**scale).cast(f"decimal(18,{scale})") if scale else F.col(c)
    return counts.select(*by, value("width").alias("bin_width"), value("_low").alias("bin_start"), "n")


def with_paths(subset: DataFrame, geojson: str = "geojson") -> DataFrame:
    """Drawable paths (F19, F20, P14): path from the GeoJSON text, thinned;
    rows with an empty path removed."""
    # Staged projections: each step is computed once per row.
    out = subset.withColumn("_gj", F.try_parse_json(F.col(geojson)))
    out = out.withColumn("_path", geo.geojson_path_of_variant("_gj"))
    out = out.withColumn("_thin", geo.thin_path("_path"))
    # Keep rows with a non-empty path.  Written as a 0-or-1 element explode:
    # a Filter here would be pushed below the projections above and inline
    # the whole GeoJSON chain into its condition, once per reference.
    keep = F.when(F.size("_thin") > 0, F.array(F.col("_thin"))).otherwise(F.array().cast("array<array<array<double>>>"))
    cols = [c for c in out.columns if c not in ("_gj", "_path", "_thin")]
    return out.select(*cols, F.explode(keep).alias("path"))


def payload_estimate(paths: DataFrame, by: list[str] = ["city_name"]) -> DataFrame:
    """Map payload size (A17): total coordinates, estimated MB, level."""
    agg = paths.groupBy(*by).agg(F.sum(F.size("path")).cast("long").alias("total_coords"), F.count(F.lit(1)).alias("valid_paths"))
    mb = F.col("total_coords") * BYTES_PER_COORD / F.lit(1024.0 * 1024.0)
    level = F.when(mb > ERROR_MB, "error").when(mb > WARN_MB, "warn").otherwise("ok")
    return agg.select("*", mb.alias("estimated_size_mb"), level.alias("level"))


def fill_for_display(df: DataFrame) -> DataFrame:
    """NULL filling by type (P15): text -> 'N/A', numbers -> 0; dates become
    text first, so a missing one shows 'N/A' too."""
    dates = {f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}
    df = df.withColumns(dates) if dates else df
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    out = df.fillna("N/A", subset=text) if text else df
    return out.fillna(0, subset=nums) if nums else out


def is_empty(df: DataFrame) -> bool:
    """``if df.empty: stop`` (A18): reads at most one row."""
    return df.isEmpty()
