"""The self-join's quadtree: dense cities, caps, and equality with all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tern.functions import geo
from tern.operators import spatial_join

from .test_geo import _crosses, lines_df

STREET = 0.0004  # degrees, about 40 m


def city(n, seed=1, side=0.045):
    """``n`` short streets within one grid cell."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        lon, lat, turn = -99.99 + r.uniform(0, side), 40.002 + r.uniform(0, side), r.uniform(0, 2 * math.pi)
        out.append((i, i, [[(lon, lat), (lon + STREET * math.cos(turn), lat + STREET * math.sin(turn))]]))
    return out


def candidates(spark, lines, dense):
    """Rows and candidate pairs of the leaves."""
    arcs = spatial_join.arc_table(lines_df(spark, lines), ["fid"])
    per = spatial_join.quadtree_cells(arcs, ["fid"], 0.05, dense).groupBy("cell").count()
    return tuple(per.agg(F.sum("count"), F.sum(F.col("count") * (F.col("count") - 1) / 2)).first())


def test_candidates_grow_with_the_arcs(spark):
    got = {n: candidates(spark, city(n), 32) for n in (1000, 2000, 4000)}
    for a, b in ((1000, 2000), (2000, 4000)):
        assert got[b][0] < 2.6 * got[a][0]
        assert got[b][1] < 3 * got[a][1]
    assert got[4000][1] < 4000 * 32  # all pairs of one cell: eight million
    assert candidates(spark, city(1000), 10**9)[1] > 390_000


@pytest.mark.parametrize("dense", [4, 10**9])
def test_pairs_do_not_depend_on_the_splits(spark, dense):
    """A dense city, a star of arcs through one point, and long arcs across it."""
    r = random.Random(2)
    lines = city(250, 3, 0.004)
    for i in range(30):
        turn = r.uniform(0, 2 * math.pi)
        lines.append((1000 + i, 1000 + i, [[(-99.97, 40.02), (-99.97 + 0.002 * math.cos(turn), 40.02 + 0.002 * math.sin(turn))]]))
    for i in range(10):
        lines.append((2000 + i, 2000 + i, [[(-100.5, 40.0 + r.uniform(0, 0.05)), (-99.5, 40.0 + r.uniform(0, 0.05))]]))
    got = spatial_join.intersects_pairs(lines_df(spark, lines), "fid", "object_id", dense=dense)
    got = {(x.fid_1, x.fid_2) for x in got.collect()}
    star = {(a, b) for a in range(1000, 1030) for b in range(1000, 1030) if a != b}
    expect = {(i, j) for i, _, p in lines for j, _, q in lines if i != j and _crosses(p[0], q[0])} | star
    assert got == expect and len(expect) > 900


def test_long_arcs_are_not_split_for_nothing(spark):
    """Parallel arcs through many cells: quarters would hold them all."""
    lines = [(i, i, [[(-100.4, 40.0 + i * 1e-6), (-99.6, 40.0 + i * 1e-6)]]) for i in range(60)]
    arcs = spatial_join.arc_table(lines_df(spark, lines), ["fid"])
    cells = spatial_join.quadtree_cells(arcs, ["fid"], 0.05, 8)
    whole = spatial_join.quadtree_cells(arcs, ["fid"], 0.05, 10**9)
    assert cells.count() <= 1.5 * whole.count()


def test_cells_over_the_pole_and_the_antimeridian(spark):
    lines = [(i, i, [[(179.99, 81.0 + i * 1e-4), (-179.99, 81.0 + i * 1e-4)]]) for i in range(20)]
    lines += [(100 + i, 100 + i, [[(179.999, -10.0 + i * 1e-5), (-179.999, -10.0 - i * 1e-5)]]) for i in range(20)]
    a = spatial_join.intersects_pairs(lines_df(spark, lines), "fid", "object_id", dense=2)
    b = spatial_join.intersects_pairs(lines_df(spark, lines), "fid", "object_id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and b.count() >= 20 * 19
    assert geo.POLAR_LAT == 80.0


def test_long_arcs_meet_in_a_few_cells(spark):
    """Parallel arcs through a hundred cells of the grid: a pair shares four at
    most, and cells that no shorter arc is in hold none of them."""
    lines = [(i, i, [[(-102.5, 40.0 + i * 1e-4), (-97.5, 40.0 + i * 1e-4)]]) for i in range(60)]
    arcs = spatial_join.arc_table(lines_df(spark, lines), ["fid"])
    arcs = arcs.withColumn("class", spatial_join._class_of(F.greatest(F.col("lat_hi") - F.col("lat_lo"), F.col("lon_width")), 0.05))
    classes = sorted(r[0] for r in arcs.select("class").distinct().collect())
    own, longer = spatial_join._long_cells(arcs, ["fid", "lat_lo", "lat_hi", "lon_lo", "lon_width"], 0.05, classes)
    assert own.count() <= 4 * 60 and longer.count() == 0


def test_arcs_of_all_lengths(spark):
    """Pairs of every two classes, both ways, and with only some on the left."""
    r = random.Random(7)
    lines = []
    for i in range(160):
        half, turn = r.choice([0.004, 0.05, 0.4, 3.0]) * r.uniform(0.5, 1), r.uniform(0, 2 * math.pi)
        lon, lat = 20.0 + r.uniform(-0.3, 0.3), 1.0 + r.uniform(-0.3, 0.3)
        lines.append((i, i, [[(lon - half * math.cos(turn), lat - half * math.sin(turn)), (lon + half * math.cos(turn), lat + half * math.sin(turn))]]))
    L = lines_df(spark, lines)
    expect = {(i, j) for i, _, p in lines for j, _, q in lines if i != j and _crosses(p[0], q[0])}
    got = [(x.fid_1, x.fid_2) for x in spatial_join.intersects_pairs(L, "fid", "object_id").collect()]
    assert set(got) == expect and len(got) == len(expect) > 1000
    left = L.where(F.col("fid") % 3 == 0).select("fid")
    got = [(x.fid_1, x.fid_2) for x in spatial_join.intersects_pairs(L, "fid", "object_id", left=left).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in expect if i % 3 == 0}


def test_arcs_are_written_narrow(spark):
    """What follows from an arc's ends is neither written nor shuffled."""
    arcs = spatial_join.arc_table(lines_df(spark, city(20)), ["fid"])
    written = spark.read.parquet(arcs.inputFiles()[0].rsplit("/", 1)[0])
    assert set(written.columns) == {"arc", "fid", "lon_a", "lat_a", "lon_b", "lat_b", "lat_lo", "lat_hi", "lon_lo", "lon_width"}
    rows, hot = spatial_join._quadtree(arcs, ["arc", "fid", "lon_a", "lat_a", "lon_b", "lat_b"], 0.05, 128)
    assert set(rows.columns) == {"arc", "fid", "lon_a", "lat_a", "lon_b", "lat_b", "cell"} and hot.count() == 0


def test_a_hot_leaf_is_many_blocks_with_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(spatial_join, "BLOCK", 20)
    rows = spark.range(130).select("id", F.when(F.col("id") < 100, 1).otherwise(F.col("id")).alias("cell"))
    hot = spark.createDataFrame([(100, 1)], "_c long, cell long")
    r = spatial_join._self_blocks(rows, hot, "id")
    assert r.groupBy("cell", "_i", "_j").count().agg(F.max("count")).first()[0] < 100
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("cell", "_i", "_j")]
    once = (F.least("l._part", "r._part") == F.col("l._i")) & (F.greatest("l._part", "r._part") == F.col("l._j"))
    met = r.alias("l").join(r.alias("r"), on).where(once & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    assert met.count() == met.distinct().count() == 100 * 99 / 2


def test_pairs_of_a_segment_are_counted_before_its_cities(spark, monkeypatch):
    """Two places of one name count apart; no pair is joined to a city."""
    from tern.operators import highways

    lines = [(i, i, [[(10.0 + 0.01 * i, 40.0), (10.0 + 0.01 * i, 40.02)]]) for i in range(4)] + [(9, 9, [[(9.99, 40.01), (10.05, 40.01)]])]
    cities = spark.createDataFrame([("a", 40.0, 10.0), ("a", 40.01, 10.01), ("b", 40.0, 10.02), ("c", 50.0, 10.0)], "city_name string, latitude double, longitude double")
    got = highways.city_intersections(lines_df(spark, lines), cities)
    assert [tuple(r) for r in got.collect()] == [("a", 16), ("b", 8)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sum(_pairs") < plan.index("count(1)")
