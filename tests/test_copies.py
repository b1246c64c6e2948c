"""Tables in which places, rings and shapes repeat: what is equal is met once, and results are those of every row."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from croplens import plans
from croplens.operators import polygons as P
from croplens.operators import shapes as H
from croplens.operators import tables as T
from croplens.streaming import events as E

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Tables whose keys repeat in all that places are made of: 15,300 is a multiple of each period but that of ring columns, which is 1,000."""
    folder = tmp_path_factory.mktemp("copies")
    for name, key, far in (("supplier", "s_suppkey", 306_000), ("part", "p_partkey", 19_000), ("customer", "c_custkey", 1_000)):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet").where(F.col(key) < 60)
        rows.unionAll(rows.withColumn(key, F.col(key) + far)).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["zonal_over_rings", "label_rasters", "point_in_polygon", "rasterize_pivots"])
def test_points_and_rings_are_met_once(spark, copies, monkeypatch, name):
    met, own = [], T.points_in_polygons

    def seen(points, polygons, *more):
        met.append((points.select("x", "y"), polygons.select(*[c for c in ("ring", "kind", "yr") if c in polygons.columns])))
        return own(points, polygons, *more)

    monkeypatch.setattr(T, "points_in_polygons", seen)
    plans.QUERIES[name](spark, copies)
    assert met and all(rows.count() == rows.distinct().count() for rows in met[0])


@pytest.mark.parametrize("name", ["pixels_in_shapes", "label_shapes", "zonal_over_shapes"])
def test_shapes_are_met_once(spark, copies, monkeypatch, name):
    met, own = [], H.scan_lines
    monkeypatch.setattr(H, "scan_lines", lambda shapes, *more: met.append(shapes) or own(shapes, *more))
    plans.QUERIES[name](spark, copies)
    more = [c for c in ("kind", "even") if c in met[0].columns]
    assert met[0].count() == met[0].select("shape", *more).distinct().count()


def test_pairs_stand_for_their_members(spark):
    own = spark.createDataFrame([(1, 1), (5, 1), (2, 2), (7, 2), (3, 3)], "id long, like long")
    met = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (1, 2)], "a long, b long")
    assert sorted(map(tuple, T.pairs_of_members(met, own).collect())) == [(1, 2), (1, 5), (1, 7), (2, 5), (2, 7), (5, 7)]


def test_meeting_pairs_equal_the_column_test(spark):
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    shapes = [[square(0.0, 0.0, 9.0), square(3.0, 3.0, 3.0)], [square(4.0, 4.0, 1.0)], [square(1.0, 1.0, 1.0)], [square(8.0, 8.0, 4.0)], [square(9.0, 0.0, 2.0)], [square(20.0, 0.0, 2.0)]]
    rows = spark.createDataFrame(list(enumerate(shapes)), "id long, s array<array<struct<x:double,y:double>>>")
    a, b = rows.toDF("a", "sa"), rows.toDF("b", "sb")
    want = {(r.a, r.b) for r in a.join(b, F.col("a") < F.col("b")).where(H.intersects(F.col("sa"), F.col("sb"))).collect()}
    got = [(r.a, r.b) for r in H.meeting(H.near(rows, "id", "s", 4.0), rows, "id", "s").collect()]
    assert want == {(0, 2), (0, 3), (0, 4)} and sorted(got) == sorted(want)


def test_greedy_choice_with_few_pairs_to_a_task(spark, tmp_path):
    rows = spark.range(40).select("id", F.col("id").alias("o"))
    met = rows.select(F.col("id").alias("a")).join(rows.select(F.col("id").alias("b")), (F.col("a") < F.col("b")) & ((F.col("a") + F.col("b")) % 3 > 0))
    pairs = {tuple(r) for r in met.collect()}
    kept = []
    for k in range(40):
        if not any((j, k) in pairs for j in kept):
            kept.append(k)
    assert sorted(r.id for r in P.apart(rows, met, "id", ["o"], f"file://{tmp_path}", links=200).collect()) == kept


def test_weighted_low_mean_and_majority(spark, tmp_path):
    each = [(1, v, c) for v, c in ((5.0, 1), (5.0, 1), (5.0, 2), (7.0, 2), (9.0, 2), (1.0, 3))] + [(2, 4.0, 1)]
    rows = spark.createDataFrame(each, "z int, v double, c int")
    laid = rows.groupBy("z", "v", "c").agg(F.count("*").alias("n"))
    one = sorted(map(tuple, T.low_mean(rows, "z", "v", 0.5, f"file://{tmp_path}").collect()))
    assert one == sorted(map(tuple, T.low_mean(laid, "z", "v", 0.5, f"file://{tmp_path}", "n").collect())) == [(1, 4.0, 5.0), (2, 4.0, 4.0)]
    assert sorted(map(tuple, T.majority(laid, "z", "c", "n").collect())) == [(1, 2, 0.5), (2, 1, 1.0)]


def test_season_keys_share_a_group(spark, tmp_path):
    rows = [(k, datetime(2019, 6, 1), float(k)) for k in range(20)] + [(99, datetime(2020, 6, 1), 1.0)]
    spark.createDataFrame(rows, "k long, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp, v double").parquet(str(tmp_path / "in"))
    out = E.drain(E.seasons(stream, "k", "ts", "v", groups=2), f"file://{tmp_path}/out", "append").collect()
    assert sorted((r.k, r.yr, r.mean_gs, r.max_gs) for r in out) == [(k, 2019, float(k), float(k)) for k in range(20)]
