"""Spherical geography as Spark column expressions.

Geography value (SURVEY §1):
    struct<type: string, parts: array<array<struct<lon: double, lat: double>>>>
one part for LineString, n for MultiLineString.  Edges are great-circle arcs
on a sphere of radius R.  Every function returns a Column; higher-order array
functions keep the per-vertex work in the JVM (no Python UDF).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean Earth radius (m) and the touch tolerance of intersects.
EARTH_RADIUS_M = 6371008.8
TOUCH_TOLERANCE_M = 1e-3

GEOGRAPHY_TYPE = "struct<type:string,parts:array<array<struct<lon:double,lat:double>>>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- vectors


def unit_vector(lon, lat) -> Column:
    """``ST_POINT(lon, lat)`` as a 3-D unit vector struct<x, y, z>."""
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    return F.struct(
        (F.cos(la) * F.cos(lo)).alias("x"),
        (F.cos(la) * F.sin(lo)).alias("y"),
        F.sin(la).alias("z"),
    )


def vec_cols(name: str) -> list[str]:
    """A 3-vector ``name`` is stored as three double columns name_x/_y/_z
    (plain columns keep the generated code small; struct field access is
    much larger per use)."""
    return [f"{name}_{c}" for c in "xyz"]


def unit_vector_cols(lon, lat, name: str) -> list[Column]:
    """``ST_POINT(lon, lat)`` as the three columns of a unit vector."""
    u = unit_vector(lon, lat)
    return [u[c].alias(f"{name}_{c}") for c in "xyz"]


class V:
    """Tiny helper for 3-vector arithmetic over (x, y, z) Column triples."""

    def __init__(self, x: Column, y: Column, z: Column):
        self.x, self.y, self.z = x, y, z

    @classmethod
    def of(cls, name: str, alias: str | None = None) -> "V":
        q = f"{alias}." if alias else ""
        return cls(*[F.col(f"{q}{c}") for c in vec_cols(name)])

    def cols(self, name: str) -> list[Column]:
        return [self.x.alias(f"{name}_x"), self.y.alias(f"{name}_y"), self.z.alias(f"{name}_z")]

    def dot(self, o: "V") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "V") -> "V":
        return V(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def sub(self, o: "V") -> "V":
        return V(self.x - o.x, self.y - o.y, self.z - o.z)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))


def chord_angle(u: V, v: V) -> Column:
    """Central angle between two unit vectors, stable for small angles."""
    return F.lit(2.0) * F.asin(F.least(F.lit(1.0), u.sub(v).norm() / 2))


def with_arc_frame(df, a: str = "a", b: str = "b", prefix: str = "") -> "DataFrame":
    """Add the per-arc vectors the exact tests need, as columns:

    ``{prefix}nh``  unit normal of the arc's plane (zero for a degenerate arc)
    ``{prefix}ta``  n x a, points from a toward b
    ``{prefix}tb``  b x n, points from b toward a

    Computed once per arc in staged projections, so the refine expressions
    after a join stay small (no shared subtree is copied into them).
    """
    A, B = V.of(a), V.of(b)
    df = df.select("*", *A.cross(B).cols(f"{prefix}_n"))
    N = V.of(f"{prefix}_n")
    df = df.withColumn(f"{prefix}_nn", N.norm())
    nn = F.col(f"{prefix}_nn")
    scale = F.when(nn > 1e-15, F.lit(1.0) / nn).otherwise(F.lit(0.0))
    df = df.select("*", *V(N.x * scale, N.y * scale, N.z * scale).cols(f"{prefix}nh"))
    NH = V.of(f"{prefix}nh")
    df = df.select("*", *NH.cross(A).cols(f"{prefix}ta"), *B.cross(NH).cols(f"{prefix}tb"))
    return df.drop(*vec_cols(f"{prefix}_n"), f"{prefix}_nn")


def point_arc_within(p: V, a: V, b: V, nh: V, ta: V, tb: V, meters: float | Column) -> Column:
    """Whether point p lies within ``meters`` of the arc a->b, given the arc's
    frame (``with_arc_frame``), without inverse trigonometry.

    If p projects inside the arc the distance is to the great circle through
    a and b, else to the nearer endpoint; a degenerate arc (a = b, zero
    normal) is its endpoint.  Compared in the forward domain: the distance to
    the great circle is asin|n.p| <= d/R  <=>  |n.p| <= sin(d/R), and the
    endpoint distance 2 asin(|p-a|/2) <= d/R  <=>  |p-a|^2 <= (2 sin(d/2R))^2.
    Cheaper per candidate pair and much less generated code.
    """
    delta = meters / EARTH_RADIUS_M
    if isinstance(meters, Column):  # the row's own radius, below a quarter of the circle
        sin_d, chord2 = F.sin(delta), F.pow(2 * F.sin(delta / 2), 2)
    else:
        sin_d, chord2 = math.sin(delta), (2 * math.sin(delta / 2)) ** 2
    pa, pb = p.sub(a), p.sub(b)
    inside = (ta.dot(p) >= 0) & (tb.dot(p) >= 0) & ((nh.x != 0) | (nh.y != 0) | (nh.z != 0))
    return (inside & (F.abs(nh.dot(p)) <= sin_d)) | (pa.dot(pa) <= chord2) | (pb.dot(pb) <= chord2)


def arcs_cross(n1: V, a: V, b: V, n2: V, c: V, d: V) -> Column:
    """Proper crossing of arcs ab and cd (each shorter than a half circle),
    from their plane normals n1 (of ab) and n2 (of cd)."""
    n1c, n1d, n2a, n2b = n1.dot(c), n1.dot(d), n2.dot(a), n2.dot(b)
    return (n1c * n1d < 0) & (n2a * n2b < 0) & (n1c * n2b > 0)


# ------------------------------------------------------- GeoJSON <-> value


def to_geography(geometry, strict: bool = True) -> Column:
    """``TO_GEOGRAPHY(geojson variant)`` (F15) for LineString and
    MultiLineString.  NULL gives NULL; any other type raises when ``strict``,
    else gives NULL."""
    g = _c(geometry)
    typ = F.variant_get(g, "$.type", "string") if strict else F.try_variant_get(g, "$.type", "string")
    getter = F.variant_get if strict else F.try_variant_get

    def pts(arr):
        return F.transform(arr, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))

    line = F.array(pts(getter(g, "$.coordinates", "array<array<double>>")))
    multi = F.transform(getter(g, "$.coordinates", "array<array<array<double>>>"), pts)
    parts = F.when(typ == "LineString", line).when(typ == "MultiLineString", multi)
    known = typ.isin("LineString", "MultiLineString")
    out = F.when(known, F.struct(typ.alias("type"), parts.alias("parts")))
    if strict:
        out = F.when(
            g.isNull() | typ.isNull(), F.lit(None).cast(GEOGRAPHY_TYPE)
        ).when(known, out).otherwise(
            F.raise_error(F.concat(F.lit("unsupported geometry type: "), typ)).cast(GEOGRAPHY_TYPE)
        )
    return out.cast(GEOGRAPHY_TYPE)


def as_geojson(geog) -> Column:
    """``ST_ASGEOJSON(g)`` (F16): canonical GeoJSON text; round-trips with
    ``to_geography(parse_json(...))``."""
    g = _c(geog)

    def coords(part):
        return F.transform(part, lambda p: F.array(p["lon"], p["lat"]))

    line = F.to_json(F.struct(F.lit("LineString").alias("type"), coords(g["parts"][0]).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.transform(g["parts"], coords).alias("coordinates")))
    return F.when(g.isNull(), F.lit(None)).when(g["type"] == "LineString", line).otherwise(multi)


def geojson_path(geojson_text) -> Column:
    """Coordinate path for drawing (F19): LineString -> its coordinates;
    MultiLineString -> its first part; anything else, or text that does not
    parse, -> empty array.  Result array<array<double>>."""
    return geojson_path_of_variant(F.try_parse_json(_c(geojson_text)))


def geojson_path_of_variant(v) -> Column:
    """``geojson_path`` on an already parsed GeoJSON VARIANT column."""
    v = _c(v)
    typ = F.try_variant_get(v, "$.type", "string")
    line = F.try_variant_get(v, "$.coordinates", "array<array<double>>")
    first = F.try_variant_get(v, "$.coordinates[0]", "array<array<double>>")
    empty = F.array().cast("array<array<double>>")
    out = F.when(typ == "LineString", line).when(typ == "MultiLineString", first)
    return F.coalesce(out, empty)


def thin_path(path, over: int = 20, target: int = 10, keep_last: bool = False) -> Column:
    """Path thinning (F20): paths longer than ``over`` points keep every
    ``max(1, n // target)``-th point starting with the first.  ``keep_last``
    (our option) also keeps the final point."""
    p = _c(path)
    n = F.size(p)
    step = F.greatest(F.lit(1), F.floor(n / target).cast("int"))
    kept = F.filter(p, lambda x, i: (i % step) == 0)
    if keep_last:
        kept = F.when(
            (n > 0) & ((n - 1) % step != 0), F.concat(kept, F.array(F.element_at(p, -1)))
        ).otherwise(kept)
    return F.when(n > over, kept).otherwise(p)


# ------------------------------------------------------------ grid cover


def cells_per_circle(cell_deg: float) -> int:
    """Longitude cells around the globe; the cell size is snapped so this is
    an integer and cell ids wrap cleanly at the antimeridian."""
    return max(1, int(round(360.0 / cell_deg)))


def lat_cell(lat_deg: Column, g: float) -> Column:
    return F.floor(lat_deg / g).cast("long")


#: Latitude beyond which all longitudes are one cell (a cap per pole).
POLAR_LAT = 80.0


def cell_ranges(lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column, g: float, full_lon: Column):
    """Index ranges of the (lat, lon) cells covering a box: returns
    (lat0, lat1, lon0, lon1) long Columns, inclusive, and whether the box
    reaches the north and the south cap.

    ``lon_lo`` <= ``lon_hi`` in unwrapped degrees (``lon_hi`` may exceed 180
    for boxes across the antimeridian); longitude indices wrap modulo the
    cells per circle (``cell_id``).  ``full_lon`` (wider than the circle)
    covers every longitude cell.  What lies above ``POLAR_LAT`` is one cell,
    so a box there has one cell however many meridians it meets; the ranges
    hold the part below, lat0 > lat1 if there is none.
    """
    n = cells_per_circle(g)
    glat = 360.0 / n
    la0, la1 = lat_cell(F.greatest(lat_lo, F.lit(-POLAR_LAT)), glat), lat_cell(F.least(lat_hi, F.lit(POLAR_LAT)), glat)
    lo0 = F.floor(lon_lo / glat).cast("long")
    lo1 = F.floor(lon_hi / glat).cast("long")
    full = full_lon | (lo1 - lo0 + 1 >= n)
    lo0, lo1 = F.when(full, F.lit(0)).otherwise(lo0).cast("long"), F.when(full, F.lit(n - 1)).otherwise(lo1).cast("long")
    return la0, la1, lo0, lo1, lat_hi >= POLAR_LAT, lat_lo <= -POLAR_LAT


def cell_id(lat_idx: Column, lon_idx: Column, g: float) -> Column:
    n = cells_per_circle(g)
    return lat_idx * n + F.pmod(lon_idx, F.lit(n).cast("long"))


def explode_cells(df: "DataFrame", ranges, g: float, name: str = "cell") -> "DataFrame":
    """One row per covering cell, with two plain generators over index
    ranges (code-generated; no per-element lambdas)."""
    la0, la1, lo0, lo1, north, south = ranges
    n = cells_per_circle(g)
    none = F.array().cast("array<bigint>")
    cap = lambda at, idx: F.when(at, F.array(F.lit(idx).cast("long"))).otherwise(none)
    lats = F.concat(F.when(la0 <= la1, F.sequence(la0, la1)).otherwise(none), cap(north, n), cap(south, -n))
    df = df.select("*", F.explode(lats).alias("_cla"), lo0.alias("_clo0"), lo1.alias("_clo1"))
    capped = F.abs("_cla") == n  # a cap has one longitude
    lons = F.when(capped, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.col("_clo0"), F.col("_clo1")))
    df = df.select("*", F.explode(lons).alias("_clo"))
    return df.withColumn(name, cell_id(F.col("_cla"), F.col("_clo"), g)).drop("_cla", "_clo", "_clo0", "_clo1")


def point_cover_ranges(lon, lat, meters: float, g: float):
    """Cell index ranges any point within ``meters`` of (lon, lat) can fall
    in (latitude +- d, longitude +- asin(sin d / cos lat), every longitude
    near a pole)."""
    delta = meters / EARTH_RADIUS_M
    ddeg = math.degrees(delta)
    la, lo = _c(lat), _c(lon)
    cosphi = F.cos(F.radians(la))
    polar = (cosphi <= math.sin(delta)) | (la + ddeg >= 90) | (la - ddeg <= -90)
    dlon = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(delta)) / F.greatest(cosphi, F.lit(1e-12)))))
    return cell_ranges(la - ddeg, la + ddeg, lo - dlon, lo + dlon, g, polar)
