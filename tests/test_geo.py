"""Spatial functions and joins (FIXTURES §3: segments_distance,
segments_cross, features_edge, path_lengths) and the grid join against a
brute-force NumPy evaluation on random geometry."""

import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tern.functions import geo, variant
from tern.functions.geo import EARTH_RADIUS_M, GEOGRAPHY_TYPE
from tern.operators import highways, spatial_join

R = EARTH_RADIUS_M
D10 = 16093.4


def lines_df(spark, lines):
    """lines: [(fid, object_id, [[(lon, lat), ...], ...] or None)]"""
    rows = []
    for fid, oid, parts in lines:
        g = None
        if parts is not None:
            g = ("LineString" if len(parts) == 1 else "MultiLineString", [[(lo, la) for lo, la in p] for p in parts])
        rows.append((fid, oid, g))
    return spark.createDataFrame(rows, f"fid long, object_id int, geography_linestring {GEOGRAPHY_TYPE}")


def points_df(spark, pts):
    return spark.createDataFrame(pts, "pid long, longitude double, latitude double")


def near(spark, pts, lines, meters=D10, cell=None):
    out = spatial_join.dwithin_pairs(points_df(spark, pts), ["pid"], lines_df(spark, lines), ["fid"], meters, cell_deg=cell)
    return sorted((r.pid, r.fid) for r in out.collect())


def test_distance_boundaries(spark):
    d = math.degrees(D10 / R)
    d1 = math.degrees(1.0 / R)
    line = [(1, 1, [[(0.0, 0.0), (1.0, 0.0)]])]
    pts = [
        (1, 0.5, d - d1),  # interior, 1 m inside
        (2, 0.5, d + d1),  # interior, 1 m outside
        (3, 1.0 + d - d1, 0.0),  # beyond the end, inside
        (4, 1.0 + d + d1, 0.0),  # beyond the end, outside
        (5, -d + d1, 0.0),  # before the start, inside
    ]
    assert near(spark, pts, line) == [(1, 1), (3, 1), (5, 1)]
    # the same with a grid much finer than the radius
    assert near(spark, pts, line, cell=0.01) == [(1, 1), (3, 1), (5, 1)]


def test_antimeridian_and_long_arc(spark):
    lines = [
        (1, 1, [[(179.95, 10.0), (-179.95, 10.0)]]),  # crosses +-180
        (2, 2, [[(-100.0, 40.0), (-90.0, 45.0)]]),  # ~900 km arc: bulges poleward
        (3, 3, [[(5.0, 5.0), (5.0, 5.0), (5.0, 5.0)]]),  # repeated vertex only
        (4, 4, None),  # NULL geometry never joins
    ]
    a = np.array([math.cos(math.radians(40)) * math.cos(math.radians(-100)),
                  math.cos(math.radians(40)) * math.sin(math.radians(-100)), math.sin(math.radians(40))])
    b = np.array([math.cos(math.radians(45)) * math.cos(math.radians(-90)),
                  math.cos(math.radians(45)) * math.sin(math.radians(-90)), math.sin(math.radians(45))])
    m = (a + b) / np.linalg.norm(a + b)
    mlat, mlon = math.degrees(math.asin(m[2])), math.degrees(math.atan2(m[1], m[0]))
    pts = [
        (1, 180.0, 10.05),  # 5.6 km north of the antimeridian crossing
        (2, -179.99, 10.3),  # ~33 km away
        (3, mlon, mlat + math.degrees(1000.0 / R)),  # 1 km off the long arc's midpoint
        (4, 5.0, 5.0 + math.degrees(100.0 / R)),
    ]
    assert near(spark, pts, lines) == [(1, 1), (3, 2), (4, 3)]


def ordered_pairs(spark, lines):
    out = spatial_join.intersects_pairs(lines_df(spark, lines), "fid", "object_id")
    return sorted((r.fid_1, r.fid_2) for r in out.collect())


def test_segments_cross(spark):
    cases = {
        "x": ([[(0.0, 0.0), (1.0, 1.0)]], [[(0.0, 1.0), (1.0, 0.0)]], 2),
        "t": ([[(0.0, 0.0), (2.0, 0.0)]], [[(1.0, 0.0), (1.0, 1.0)]], 2),
        "shared_end": ([[(0.0, 0.0), (1.0, 0.0)]], [[(1.0, 0.0), (1.0, 1.0)]], 2),
        "parallel": ([[(0.0, 0.0), (1.0, 0.0)]], [[(0.0, 0.1), (1.0, 0.1)]], 0),
    }
    for name, (g1, g2, expect) in cases.items():
        got = ordered_pairs(spark, [(1, 1, g1), (2, 2, g2)])
        assert len(got) == expect, name
    # same object_id twice: never a pair; same geometry under two ids: a pair
    assert ordered_pairs(spark, [(1, 7, [[(0.0, 0.0), (1.0, 1.0)]]), (2, 7, [[(0.0, 1.0), (1.0, 0.0)]])]) == []
    same = [[(3.0, 3.0), (3.5, 3.2)]]
    assert ordered_pairs(spark, [(1, 1, same), (2, 2, same)]) == [(1, 2), (2, 1)]


def _unit(lon, lat):
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=-1)


def _brute_distance(p, a, b, samples=2001):
    """Distance by dense sampling along the arc (independent of the
    closed form used by the join)."""
    th = math.acos(max(-1.0, min(1.0, float(a @ b))))
    if th < 1e-15:
        pts = a[None, :]
    else:
        t = np.linspace(0.0, 1.0, samples)[:, None]
        pts = (np.sin((1 - t) * th) * a + np.sin(t * th) * b) / math.sin(th)
    return float(np.min(2 * np.arcsin(np.clip(np.linalg.norm(pts - p, axis=1) / 2, 0, 1)))) * R


def test_grid_join_equals_brute_force(spark):
    rnd = random.Random(3)
    lines, pts = [], []
    for fid in range(60):
        lon, lat = rnd.uniform(179.0, 181.0), rnd.uniform(-60.0, 60.0) if fid < 5 else rnd.uniform(20.0, 21.0)
        verts = []
        for _ in range(rnd.randint(1, 6)):
            verts.append((((lon + 180) % 360) - 180, lat))
            lon += rnd.uniform(-0.15, 0.15)
            lat += rnd.uniform(-0.15, 0.15)
        lines.append((fid, fid, [verts]))
    for pid in range(80):
        pts.append((pid, ((rnd.uniform(179.0, 181.0) + 180) % 360) - 180, rnd.uniform(20.0, 21.0)))
    got = near(spark, pts, lines)
    expect = []
    for pid, plon, plat in pts:
        p = _unit(plon, plat)
        for fid, _, parts in lines:
            v = parts[0]
            edges = [(v[i], v[i + 1]) for i in range(len(v) - 1)] or [(v[0], v[0])]
            d = min(_brute_distance(p, _unit(*e0), _unit(*e1)) for e0, e1 in edges)
            if abs(d - D10) < 5:  # too close to call for the sampled distance
                continue
            if d <= D10:
                expect.append((pid, fid))
    got_clear = [x for x in got if x in expect or not _borderline(x, pts, lines)]
    assert sorted(expect) == sorted(got_clear)


def _borderline(pair, pts, lines):
    pid, fid = pair
    _, plon, plat = pts[pid]
    v = lines[fid][2][0]
    p = _unit(plon, plat)
    edges = [(v[i], v[i + 1]) for i in range(len(v) - 1)] or [(v[0], v[0])]
    d = min(_brute_distance(p, _unit(*e0), _unit(*e1)) for e0, e1 in edges)
    return abs(d - D10) < 5


def test_geojson_roundtrip_and_features_edge(spark):
    docs = [
        {"type": "FeatureCollection", "features": []},
        {"type": "FeatureCollection"},
        {"type": "FeatureCollection", "features": [
            {"type": "Feature", "geometry": None, "properties": {"OBJECTID": 1, "MILES": 1.005}},
            {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]},
             "properties": {"OBJECTID": 2, "SPEED_LIMI": 55}},
            {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[5.5, 6.25]]},
             "properties": {"OBJECTID": 3}},
        ]},
    ]
    staging = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_id long, t string").select(
        "doc_id", variant.parse("t").alias("raw_data"))
    hw = highways.national_highway_system(staging)
    rows = {r.object_id: r for r in hw.collect()}
    assert sorted(rows) == [1, 2, 3]  # empty / missing features give no row
    assert rows[1].geography_linestring is None and rows[1].geojson is None
    assert str(rows[1].miles) == "1.01"  # numeric(38,2) rounds half up
    assert json.loads(rows[2].geojson) == {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}
    back = hw.select((geo.to_geography(variant.parse("geojson")) == F.col("geography_linestring")).alias("eq"))
    assert all(r.eq in (True, None) for r in back.collect())
    # a Point is rejected strictly, quarantined (NULL) leniently
    pt = spark.createDataFrame([('{"type":"Point","coordinates":[1,2]}',)], "t string").select(variant.parse("t").alias("g"))
    assert pt.select(geo.to_geography("g", strict=False).alias("x")).first().x is None
    try:
        pt.select(geo.to_geography("g", strict=True)).collect()
        raise AssertionError("strict TO_GEOGRAPHY accepted a Point")
    except Exception as e:  # noqa: BLE001
        assert "unsupported geometry type" in str(e)


def test_path_lengths(spark):
    ns = [0, 1, 20, 21, 29, 30, 200]
    rows = [(n, json.dumps({"type": "LineString", "coordinates": [[i, i] for i in range(n)]})) for n in ns]
    rows.append((-1, json.dumps({"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1], [2, 2]], [[9, 9], [8, 8]]]})))
    rows.append((-2, "not json"))
    df = spark.createDataFrame(rows, "n int, g string").select("n", geo.thin_path(geo.geojson_path("g")).alias("p"))
    got = {r.n: len(r.p) for r in df.collect()}
    assert [got[n] for n in ns] == [0, 1, 20, 11, 15, 10, 10]
    assert got[-1] == 3 and got[-2] == 0
    keep_last = spark.createDataFrame([(29,)], "n int").select(
        geo.thin_path(F.transform(F.sequence(F.lit(0), F.lit(28)), lambda i: F.array(i.cast("double"), i.cast("double"))),
                      keep_last=True).alias("p")).first().p
    assert keep_last[-1] == [28.0, 28.0] and len(keep_last) == 15


def _crosses(p, q):
    """Whether two arcs cross, by bisection along the first for a change of
    side of the second's plane (independent of the join's closed form)."""
    a, b, c, d = (_unit(*x) for x in (*p, *q))
    n = np.cross(c, d)
    if (a @ n) * (b @ n) > 0:
        return False
    lo, hi = a, b
    for _ in range(80):
        m = (lo + hi) / np.linalg.norm(lo + hi)
        lo, hi = (m, hi) if (m @ n) * (b @ n) <= 0 else (lo, m)
    m = (lo + hi) / np.linalg.norm(lo + hi)
    return bool(m @ (c + d) > 0 and np.cross(n, c) @ m >= 0 and np.cross(d, n) @ m >= 0)


def test_intersections_at_the_antimeridian_and_of_long_arcs(spark):
    # lines that meet at +-180, as seen from either side
    touch = [(1, 1, [[(179.9, 10.0), (180.0, 10.0)]]), (2, 2, [[(-180.0, 10.0), (-179.9, 10.2)]])]
    assert ordered_pairs(spark, touch) == [(1, 2), (2, 1)]
    for width, lat in ((10.0, 45.0), (30.0, 60.0), (120.0, 70.0)):
        arc = ((-width / 2, lat), (width / 2, lat))
        a, b = _unit(*arc[0]), _unit(*arc[1])
        top = math.degrees(math.asin(((a + b) / np.linalg.norm(a + b))[2]))  # where the arc is highest
        below = ((-0.01, top - 0.001), (0.01, top + 0.001))
        lines = [(1, 1, [list(arc)]), (2, 2, [list(below)]), (3, 3, [[(0.0, top + 0.5), (0.1, top + 0.5)]])]
        assert ordered_pairs(spark, lines) == [(1, 2), (2, 1)], width


def test_intersections_anywhere_equal_brute_force(spark):
    """Long and short arcs over the whole globe, poles included."""
    rnd = random.Random(5)
    lines = []
    for i in range(90):
        lon, lat = rnd.uniform(-180, 180), rnd.choice([rnd.uniform(-89.5, 89.5), rnd.uniform(78, 89.9), rnd.uniform(-89.9, -78)])
        step = rnd.choice([2.0, 60.0, 160.0])
        lines.append((i, i, [[(lon, lat), (((lon + rnd.uniform(-step, step) + 180) % 360) - 180, max(-89.9, min(89.9, lat + rnd.uniform(-step, step) / 4)))]]))
    expect = sorted((i, j) for i, _, p in lines for j, _, q in lines if i != j and _crosses(p[0], q[0]))
    assert len(expect) > 30 and ordered_pairs(spark, lines) == expect


def test_polar_cover_is_bounded(spark):
    """An arc near a pole has a handful of cells, and still finds its points."""
    lines = [(1, 1, [[(-170.0, 85.0), (10.0, 86.0)]]), (2, 2, [[(0.0, 79.9), (0.0, 80.1)]])]
    arcs = spatial_join.arc_table(lines_df(spark, lines), ["fid"])
    g = 360.0 / geo.cells_per_circle(0.05)
    per_fid = dict(spatial_join._edge_cells(arcs, g, 0.0).select("fid", "cell").distinct().groupBy("fid").count().collect())
    assert per_fid[1] == 1 and per_fid[2] < 60
    assert near(spark, [(1, 100.0, 89.9), (2, 0.1, 80.0), (3, 0.0, 70.0)], lines, 40000.0, 0.05) == [(1, 1), (2, 2)]


def test_left_side_restricts_the_self_join(spark):
    lines = [(1, 1, [[(0.0, 0.0), (1.0, 1.0)]]), (2, 2, [[(0.0, 1.0), (1.0, 0.0)]]), (3, 3, [[(0.5, 0.0), (0.5, 1.0)]])]
    L = lines_df(spark, lines)
    left = spark.createDataFrame([(2,), (2,)], "fid long")
    out = spatial_join.intersects_pairs(L, "fid", "object_id", left=left)
    assert sorted((r.fid_1, r.fid_2) for r in out.collect()) == [(2, 1), (2, 3)]
