"""Model search and inference, seasonal streams, catalogs, uniform sinks, ordinals and areas on small tables."""

import json
import math
import os
import time

import pytest
from pyspark.sql import functions as F

from croplens.operators import grids as G
from croplens.operators import models as M
from croplens.operators import stacks as K
from croplens.operators import tables as T
from croplens.sources import catalog, sinks
from croplens.streaming import events as E


def planted(spark, n=240):
    """A label that a tree of depth 1 cannot give."""
    a, b = F.col("id") % 4, F.floor(F.col("id") / 4) % 4
    return spark.range(n).select("id", a.cast("double").alias("a"), b.cast("double").alias("b"), (F.col("id") % 7).cast("double").alias("c"), a.isin(1, 2).cast("int").alias("label"))


def test_settings_of_the_search():
    grid, drawn = M.grid_settings(), M.random_settings(20, 3)
    assert len(grid) == 72 and len({str(g) for g in grid}) == 72 and len({str(d) for d in drawn}) == 20 and drawn == M.random_settings(20, 3) != M.random_settings(20, 4)
    assert all(set(d) == set(grid[0]) and d["features"] in range(1, 11) and d["split"] in range(2, 11) for d in drawn)
    assert len(M.random_settings(20, 0, {"maxDepth": (2, 3)})) == 2


def test_search_ranks_planted_settings(spark):
    settings = [{"maxDepth": 1, "features": 3, "split": 2, "bootstrap": False, "impurity": "gini"}, {"maxDepth": 8, "features": 3, "split": 2, "bootstrap": False, "impurity": "gini"}, {"maxDepth": 8, "features": 3, "split": 3, "bootstrap": False, "impurity": "entropy"}]
    found, model = M.search(planted(spark), ["a", "b", "c"], "label", "id", settings, folds=3, trees=3, top=3)
    assert [(r, s["maxDepth"]) for r, s, _, _ in found] == [(1, 8), (1, 8), (3, 1)] and found[0][2] == 1.0 and found[2][2] < 0.8
    assert model.bestModel.getMaxDepth() == 8 and all(len(row) == 4 for row in found)
    some, _ = M.search(planted(spark), ["a", "b", "gone"], "label", "id", settings, folds=2, trees=2, budget=5)
    assert len(some) == 2
    with pytest.raises(ValueError):
        M.search(planted(spark), ["a"], "label", "id", settings, folds=5, budget=4)


def test_holdout_and_certainty(spark):
    rows = planted(spark)
    out, wrong = M.holdout(rows, ["a", "b", "c"], "label", "id", trees=5, depth=8, bag=1.0)
    assert 40 < out.count() < 110 and wrong.count() == out.where("pred != label").count() < out.count() / 4
    model = M.train_forest(rows, ["a", "b"], "label", trees=9, depth=8, bag=1.0)
    moved = rows.withColumn("label", F.when(F.col("id") < 10, 1 - F.col("label")).when(F.col("id") == 11, None).otherwise(F.col("label")))
    got = M.infer(model, moved, ["a", "b"], "label", least=0.5).collect()
    assert {r.id for r in got if not r.static} == {*range(10), 11} and all(r.uncertain for r in got if not r.static)
    assert all(0.5 <= r.prob <= 1 for r in got)
    strict = M.infer(model, moved, ["a", "b"], "label", least=1.1).where("uncertain = 0").count()
    assert strict == 0
    two = M.infer(model, moved.withColumn("label", F.when(F.col("label") == 1, 3).otherwise(F.col("label"))), ["a", "b"], "label", classes=2)
    assert two.where("static = 0").count() == 11


def season_rows(spark, folder, parts):
    """Files that a stream reads one after the other."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double").select("k", F.col("ts").cast("timestamp").alias("ts"), "v").coalesce(1).write.parquet(f"{folder}/{n}")
        for name in os.listdir(f"{folder}/{n}"):
            os.utime(f"{folder}/{n}/{name}", (time.time() - 1000 + n * 100,) * 2)
    return spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_stream_of_seasons_closes_years_and_drops_late_rows(spark, tmp_path):
    from datetime import datetime as at

    parts = [
        [("a", at(2019, 6, 1), 1.0), ("a", at(2019, 8, 1), 3.0), ("b", at(2019, 12, 31, 12), 9.0), ("a", at(2019, 1, 5), 50.0), (None, at(2019, 6, 1), 1.0), ("a", at(2019, 6, 2), None)],
        [("a", at(2020, 5, 1), 10.0), ("b", at(2020, 7, 15), 4.0)],
        [("a", at(2019, 6, 3), 1000.0), ("a", at(2020, 5, 2), 20.0), ("c", at(2021, 3, 1), 2.0)],  # the first is behind the watermark by then
        [("z", at(2022, 6, 1), 1.0)],
        [("z", at(2022, 6, 2), 3.0)],
    ]
    rows = E.seasons(season_rows(spark, str(tmp_path / "in"), parts), "k", "ts", "v")
    out = {(r.k, r.yr): r for r in E.drain(rows, f"file://{tmp_path}/out", "append").collect()}
    assert sorted(out) == [("a", 2019), ("a", 2020), ("a", 2021), ("b", 2020), ("b", 2021), ("c", 2021)]  # 2022 is still open, as is what looks back from it
    a = out["a", 2019]
    assert (a.mean_gs, a.max_gs, a.mean_2, a.mean_3, a.mean_1, a.mean_m1) == (2.0, 3.0, 1.0, 3.0, None, None)
    b = out["a", 2020]
    assert (b.mean_gs, b.max_gs, b.mean_m1, b.max_3_m1, b.mean_m2) == (15.0, 20.0, 2.0, 3.0, None)
    c = out["a", 2021]
    assert (c.mean_gs, c.mean_m1, c.mean_m2, c.max_3_m2) == (None, 15.0, 2.0, 3.0)
    assert (out["b", 2020].mean_3, out["b", 2020].mean_gs, out["c", 2021].mean_1) == (4.0, 4.0, 2.0)
    assert {n for n, *_ in K.NORTH} == {c.removeprefix("mean_") for c in rows.columns if c.startswith("mean_")}


def test_catalog_is_listed_by_page(spark, tmp_path):
    root = tmp_path / "assets"
    want = set()
    for state in ("MT", "WA", "AZ"):
        for year in range(1990, 1994):
            if (state, year) == ("WA", 1992):
                continue
            (root / "comp" / state).mkdir(parents=True, exist_ok=True)
            said = {"id": f"id/{state}{year}", "name": f"comp/IM_{state}_{year}", "sizeBytes": str(year), "updateTime": "t", "properties": {"b": year, "a": "x", "none": None} if state == "MT" else {}}
            (root / "comp" / state / f"{state}_{year}.json").write_text(json.dumps(said))
            want.add((f"id/{state}{year}", state, year))
    (root / "loose.json").write_text("{}")
    (root / "comp" / "MT" / "MT_1980.json").write_text("{not json")
    (root / "comp" / "MT" / "note.txt").write_text("x")
    (root / "empty").mkdir()
    for page in (1, 100):
        listed = catalog.assets(spark, str(root), page)
        assert listed.rdd.getNumPartitions() == (3 if page == 1 else 1)
        assert {(r.asset_id, r.state, r.year) for r in listed.collect()} == want | {("loose", None, None), ("comp/MT/MT_1980", "MT", 1980)}
    table = catalog.harvest(spark, f"file://{root}", 2)
    assert table.columns == ["asset_id", "name", "state", "year", "sizeBytes", "updateTime", "a", "b", "error"]
    rows = table.collect()
    assert [(r.state, r.year) for r in rows[:5]] == [("AZ", y) for y in range(1990, 1994)] + [("MT", 1980)] and rows[-1].asset_id == "loose"
    assert [r.error is None for r in rows].count(False) == 1 and {r.b for r in rows} == {None, "1990", "1991", "1992", "1993"} and rows[0].sizeBytes == 1990
    found = {r.state: tuple(r)[1:] for r in catalog.summary(listed).collect()}
    assert found["WA"] == (3, 1990, 1993, 1, 0) and found["MT"] == (5, 1980, 1993, 9, 1) and found[None] == (1, None, None, None, 0)
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("catalog").load().count()


def test_uniform_sink_fails_on_mixed_systems(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit("EPSG:4326").alias("crs"))
    assert sinks.write_uniform(rows, "crs", f"file://{tmp_path}/one") == "EPSG:4326" and spark.read.parquet(f"file://{tmp_path}/one").count() == 100
    for crs in (F.when(F.col("id") == 77, "EPSG:5070").otherwise("EPSG:4326"), F.when(F.col("id") != 3, "EPSG:4326")):
        with pytest.raises(ValueError, match="does not agree"):
            sinks.write_uniform(rows.withColumn("crs", crs), "crs", f"file://{tmp_path}/two")
    assert sorted(os.listdir(tmp_path)) == ["one"]
    with pytest.raises(FileExistsError):
        sinks.write_uniform(rows, "crs", f"file://{tmp_path}/one")
    assert sinks.write_uniform(rows.where("false"), "crs", f"file://{tmp_path}/none") is None


def test_ordinals_merging_and_alignment(spark, tmp_path):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("é",), ("b",), ("Z",)], "c string")
    known = T.ordinals(rows, "c", f"file://{tmp_path}")
    assert {r.c: r.ordinal for r in known.collect()} == {"Z": 0, "a": 1, "b": 2, "é": 3}
    new = spark.createDataFrame([("b",), ("q",), (None,)], "c string")
    assert sorted((r.c or "", r.ordinal) for r in T.encode(new, "c", known, unseen=-1).collect()) == [("", -1), ("b", 2), ("q", -1)]
    assert T.ordinals(rows.where("false"), "c", f"file://{tmp_path}").count() == 0
    many = spark.range(3000).select((F.col("id") * 37 % 3000).cast("string").alias("c"))
    assert [r.c for r in T.ordinals(many, "c", f"file://{tmp_path}").orderBy("ordinal").collect()] == sorted(map(str, range(3000)))
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}), (None, {"x": "1"}), ({"a": "1"}, None)], "u map<string,string>, o map<string,string>")
    assert [r[0] for r in maps.select(T.merged(F.col("u"), F.col("o"))).collect()] == [{"a": "1", "b": "3"}, {"x": "1"}, {"a": "1"}]
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "k int, x int"), spark.createDataFrame([(2, 5), (3, 6)], "k int, y int")
    assert sorted(map(tuple, T.aligned(a, b, "k").collect()), key=str) == [(1, 2, None, 0), (2, 3, 5, 1), (3, None, 6, 0)]
    assert T.beside(a, 2) is not a and T.beside(a, 1) is a


def test_cell_areas_sum_to_the_ellipsoid(spark):
    a, f = G.WGS84
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    whole = 2 * math.pi * a * a * (1 + (1 - e2) / e * math.atanh(e))
    cells = spark.range(180).select(G.degree_cell(F.lit(0), F.col("id"), (-180.0, -90.0), 1.0).alias("c"))
    got = cells.agg(F.sum("c.area"), F.min("c.lat"), F.max("c.lat")).first()
    assert abs(got[0] * 360 / whole - 1) < 1e-12 and (got[1], got[2]) == (-89.5, 89.5)
    one = spark.range(1).select(G.zone_area(F.lit(40.0), F.lit(41.0), F.lit(1.0)), F.lit(0.0)).first()[0]
    parts = spark.range(64).select(G.zone_area(40 + F.col("id") / 64, 40 + (F.col("id") + 1) / 64, F.lit(1.0)).alias("a")).agg(F.sum("a")).first()[0]
    assert abs(one / parts - 1) < 1e-9 and 9.3e9 < one < 9.5e9


def test_csv_folder_is_read_once_in_order(spark, tmp_path):
    from croplens.sources import files

    for name, text in {"irr_b_2011.csv": 'k,v,"a, b"\n1,x,2.5\n2,"y, z",\n', "irr_a_2010.csv": "v,k\nq,7\n", "plain.csv": "k\n9\n\n10\n", "none_2009.csv": ""}.items():
        (tmp_path / name).write_text(text)
    rows = files.csv_folder(spark, str(tmp_path), in_order=True)
    assert rows.columns == ["k", "v", "a, b", "file_name"] or set(rows.columns) == {"k", "v", "a, b", "file_name"}
    assert [(r.k, r.v, r["a, b"], r.file_name) for r in rows.collect()] == [(7, "q", None, "irr_a_2010.csv"), (1, "x", 2.5, "irr_b_2011.csv"), (2, "y, z", None, "irr_b_2011.csv"), (9, None, None, "plain.csv"), (10, None, None, "plain.csv")]
    assert dict(rows.dtypes) == {"k": "bigint", "v": "string", "a, b": "double", "file_name": "string"}
    dated = files.dated_folder(spark, str(tmp_path))
    assert sorted(((r.source, r.year, r.k) for r in dated.collect()), key=str) == [("irr_a", 2010, 7), ("irr_b", 2011, 1), ("irr_b", 2011, 2), ("plain", None, 10), ("plain", None, 9)]
    path = str(tmp_path / "plain.csv")
    assert files.lookup(spark, path) is files.lookup(spark, path) and files.lookup(spark, path).count() == 2


def test_columns_by_name_and_year(spark):
    wide = spark.createDataFrame([(1, 5, None, 2.0, "z"), (2, None, None, None, "z")], "k int, IM_2018 int, IM_2020 int, Ct_2018 double, other string")
    assert T.by_name(wide, ["k"]).columns == ["k", "Ct_2018", "IM_2018", "IM_2020", "other"] and T.default_features(wide, ["k", "other"]) == ["IM_2018", "IM_2020", "Ct_2018"]
    assert [tuple(r) for r in T.years_to_rows(wide, ["k"], ["IM_", "Ct_"]).collect()] == [(1, 2018, 5, 2.0)]
    newer = spark.createDataFrame([(1, 9, 3), (1, 8, 4), (3, 1, 1)], "k int, IM_2018 int, n int")
    got = T.add_new_columns(wide, newer, "k")
    assert got.columns == [*wide.columns, "n"] and sorted((r.k, r.IM_2018, r.n) for r in got.collect()) == [(1, 5, 4), (2, None, None)]
    assert T.add_new_columns(wide, newer.drop("n"), "k") is wide


def test_pairs_folds_and_missing_properties(spark, tmp_path):
    from croplens.operators import accuracy as A
    from croplens.operators import layers as L

    rows = spark.createDataFrame([(float(i), float(-2 * i), 1.0, float(i % 2)) for i in range(10)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = {(r.a, r.b): r.r for r in A.pair_correlations(rows, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 6 and abs(got["a", "b"] + 1) < 1e-12 and got["a", "c"] is None and 0 < got["a", "d"] < 0.5
    out = M.out_of_fold(planted(spark), ["a", "b", "c"], "label", "id", folds=3, trees=5, depth=6, bag=1.0)
    assert out.count() == 240 and {r.fold for r in out.collect()} == {0, 1, 2} and out.where("pred = label").count() > 230
    assert [r.id for r in planted(spark).select("id", *A.splits(F.col("id"))).where("(third and not seventy) or (seventy and not eighty)").collect()] == []
    (tmp_path / "c").mkdir()
    for name, props in {"MT_2000": {"a": 1, "b": 2}, "MT_2001": {"a": 1}, "WA_2000": {}}.items():
        (tmp_path / "c" / f"{name}.json").write_text(json.dumps({"name": name, "properties": props}))
    found = catalog.missing_properties(catalog.assets(spark, str(tmp_path)))
    assert {tuple(r) for r in found.collect()} == {("MT", "b", 1), ("WA", "a", 1), ("WA", "b", 1)}
    still = spark.createDataFrame([(1, 10.0, 82, 30), (1, 9.0, 11, 0), (2, 5.0, 90, 25)], "p int, elevation double, landcover int, occurrence int")
    own = L.with_static(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "p int, n string"), still, "p")
    assert sorted(tuple(r) for r in own.collect())[:2] == [(1, "x", 10.0, 82, 1, 1), (2, "y", 5.0, 90, 0, 0)] and own.where("p = 3 and water is null").count() == 1


def test_allocation_runs_over_ranges(spark, tmp_path):
    from croplens.operators import layers as L

    rows = [(z, k, (k * 7) % 13 + 1) for z, size in (("big", 3000), ("small", 3), (None, 20)) for k in range(size)]
    want = []
    for z in ("big", "small", None):
        total, whole = 0, sum(r[2] for r in rows if r[0] == z)
        for _, k, area in (r for r in rows if r[0] == z):
            quota = max(1, math.ceil(area / whole * 500))
            total += quota
            want.append((z, k, quota, total))
            if total > 500:
                break
    got = L.allocate(spark.createDataFrame(rows, "z string, k int, area long"), "z", "k", "area", 500, f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 500
