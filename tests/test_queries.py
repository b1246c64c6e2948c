"""Every query with SQL against DuckDB, and fixed cases of rules, rings, filters and series."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from croplens import plans
from croplens.functions import scalar as S
from croplens.operators import rules
from croplens.operators import tables as T

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(plans.SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in found.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


def test_model_queries(spark):
    assert plans.QUERIES["pca"](spark, FOLDER).count() == 10
    rows = plans.QUERIES["rf_train_predict"](spark, FOLDER)
    assert rows.count() > 0 and rows.columns == ["vec_id", "label", "pred"]


def test_trees_as_text_and_bags(spark):
    from croplens.operators import models as M

    rows = spark.createDataFrame([(float(i % 2), float(i % 7), i % 2) for i in range(80)], "a double, b double, label int")
    model = M.train_forest(rows, ["a", "b", "gone"], "label", trees=4, bag=0.8, depth=2)
    texts = M.tree_texts(model)
    assert [t[0] for t in texts] == [0, 1, 2, 3] and model.getSubsamplingRate() == 0.8
    assert all(nodes == text.count("Predict:") * 2 - 1 and depth <= 2 for _, depth, nodes, text in texts)
    assert M.classify(model, rows, ["a", "b"]).where("pred != label").count() == 0
    assert {"rf_wide_bags", "forest_trees"} <= set(plans.QUERIES)


def test_forest_comparison(spark):
    from croplens.operators import accuracy as A

    rows = spark.createDataFrame([(i, float(i % 2), float(i % 7), i % 2) for i in range(80)], "k long, a double, b double, label int")
    best = A.compare_forests(rows, ["a", "b"], "label", "k", {"depth": [2], "trees": [3, 5]}, folds=2)
    assert [r[0] for r in best] == [1, 1] and best[0][2] > 0.9
    curve = A.feature_curve(rows, ["b", "a"], "label", "k", trees=5, depth=3)
    assert [c[:2] for c in curve] == [(1, "b"), (2, "a")] and curve[1][2] > 0.9


def test_thresholds_and_expressions():
    assert [rules.threshold("WA", y) for y in (2015, 2016, 2020, 2024, 2030)] == [5, 8, 4, 0, 0]
    assert [rules.threshold("CA", y) for y in (2015, 2016, 2020, 2022)] == [5, 4, 0, 0]
    assert rules.threshold("MT", 2030) == 6 and rules.threshold("ID", 2030) == 5
    assert [len(rules.expressions(s, y)) for s, y in (("MT", 2007), ("ID", 2010), ("WA", 2011), ("AZ", 2022))] == [1, 2, 1, 0]
    assert rules.expressions("WA", 2022)[1] == "(IRR != 0) && (NDVI > 0.68) && (PIVOT == 1) && (SUM > 2) ? 0: IRR"
    assert rules.expressions("MT", 2022)[0] == "(IRR == 1) && (NDVI > 0.75) && (SUM > 6) ? 0: (IRR == 0) && (SUM < 6) ? 1: (IRR == 0) && (SLOPE > 10) ? 3: IRR"
    assert rules.expressions("ID", 2022)[1] == "(IRR == 0) && (SLOPE > 6) ? 3: IRR"


def test_rule_nulls(spark):
    stack = spark.createDataFrame([(0, None, 0.7, 1.0, 0), (0, 9, 0.7, 12.0, 0), (1, 9, 0.8, 0.0, 0)], "IRR int, SUM int, NDVI double, SLOPE double, PIVOT int")
    assert [r.IRR for r in rules.postprocess(stack, "MT", 2000).collect()] == [None, 3, 0]
    assert [r.IRR for r in rules.postprocess(stack, "MT", 2000, True).collect()] == [0, 3, 0]


def test_label_filter_case(spark):
    rows = [("a", 0, 0.9), ("b", 0, 0.5), ("c", 1, 0.5), ("d", 4, 0.7), ("e", 4, 0.3), ("f", 2, 0.6), ("g", 3, 0.7), ("h", 0, None)]
    got = T.label_filter(spark.createDataFrame(rows, "i string, POINT_TYPE int, nd_max_gs double"))
    assert {r.i: r.POINT_TYPE for r in got.collect()} == {"a": 0, "c": 1, "e": 1, "f": 2, "g": 3, "h": 0}


def test_rings(spark):
    square = S.rectangle(F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    r = spark.range(1).select(S.ring_area(square), S.ring_length(square), S.compactness(square), S.within(F.lit(0.5), F.lit(0.5), square), S.within(F.lit(1.5), F.lit(0.5), square)).first()
    assert r[:2] == (1.0, 4.0) and abs(r[2] - 0.7853981633974483) < 1e-12 and r[3] and not r[4]


def test_union_and_numbers(spark):
    a, b = spark.createDataFrame([(1, 4), (2, 5)], "a int, b int"), spark.createDataFrame([(7,)], "a int")
    assert [(r.a, r.b) for r in T.union_tables(a, b).collect()] == [(1, 4), (2, 5), (7, None)]
    n = spark.createDataFrame([("1,234",), (" (D)",), (None,), ("x",)], "t string").select(S.number_or_null(F.col("t")))
    assert [r[0] for r in n.collect()] == [1234.0, None, None, None]


def test_confusion_ratios(spark):
    rows = [(0, 0)] * 8 + [(0, 1)] * 2 + [(1, 0)] + [(1, 1)] * 9
    got = {(r.t, r.p): (r.consumer, r.producer) for r in T.confusion(spark.createDataFrame(rows, "t int, p int"), "t", "p").collect()}
    assert got[0, 0] == (0.8, 8 / 9) and got[1, 1] == (0.9, 9 / 11)


def test_savgol_keeps_cubics_and_short_series(spark):
    rows = [(0, i, 1.0 + i - 0.5 * i**2 + 0.01 * i**3) for i in range(40)] + [(1, i, 1.0) for i in range(20)]
    got = T.savgol(spark.createDataFrame(rows, "k int, d int, v double"), "k", "d", "v").orderBy("k", "d").collect()
    assert np.allclose([r.v for r in got[:40]], [r[2] for r in rows[:40]], atol=1e-6) and all(r.v is None for r in got[40:])


def test_stratified_third_passes_small_tables(spark, tmp_path):
    rows = spark.createDataFrame([(0, i) for i in range(5)] + [(1, 9)], "c int, k int")
    assert T.stratified_third(rows, "c", ["k"], f"file://{tmp_path}").count() == 6


def test_ranks_of_a_class_spread_over_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(c, k * 7 % 1009, k) for c in (0, None) for k in range(1000)] + [(5, 1, 1)], "c int, v int, k int")
    out = T.ranked(rows, ["c"], ["v", "k"], "n", f"file://{tmp_path}")
    got = sorted(((r.c is None, r.c or 0, r.v, r.k, r.n) for r in out.collect()))
    want = [(c is None, c or 0, v, k, n) for c in (0, 5, None) for n, (v, k) in enumerate(sorted((v, k) for cc, v, k in [tuple(r) for r in rows.collect()] if cc == c), 1)]
    assert got == sorted(want)
    parts = out.where("c = 0").select(F.col("n"), F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 1


def test_fallback_join_repeats_no_row(spark):
    left = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, l string")
    right = spark.createDataFrame([("a", "q", 2), ("a", "q", 1), ("n", "y", 5)], "k string, l string, v int")
    assert sorted(tuple(r) for r in T.fallback_join(left, right, ("k", "k"), ("l", "l"), "v").collect()) == [("a", "x", 1), ("b", "y", 5)]


def test_apart_is_the_greedy_choice(spark, tmp_path):
    from croplens.operators import polygons as P

    order = [5, 3, 3, 9, 1, 4, 2, 8]
    meets = [(0, 1), (1, 2), (2, 4), (3, 5), (5, 6), (6, 7), (0, 7), (4, 4)]
    kept = []
    for k in sorted(range(8), key=lambda k: (order[k], k)):
        if not any((k, o) in meets or (o, k) in meets for o in kept):
            kept.append(k)
    rows = spark.createDataFrame(list(enumerate(order)), "id long, o int")
    pairs = spark.createDataFrame([*meets, (1, 0)], "a long, b long")
    assert sorted(r.id for r in P.apart(rows, pairs, "id", ["o"], f"file://{tmp_path}").collect()) == sorted(kept)
    assert P.apart(rows.limit(0), pairs, "id", ["o"], f"file://{tmp_path}").count() == 0


def test_albers_published_example(spark):
    from croplens.operators import polygons as P

    clarke = (6378206.4, 1 / 294.9786982)
    at = spark.range(1).select(P.albers(F.lit(-75.0), F.lit(35.0), ellipsoid=clarke).alias("p")).first().p
    assert abs(at.x - 1885472.7) < 0.5 and abs(at.y - 1535925.0) < 0.5


def test_rings_that_hold_or_touch(spark):
    from croplens.operators import polygons as P

    box = lambda x, y, w: S.rectangle(F.lit(x), F.lit(y), F.lit(w), F.lit(w))
    cases = [(0, 0, 9, 2, 2, 1, True), (0, 0, 2, 2, 2, 2, True), (0, 0, 2, 3, 0, 2, False), (2, 2, 1, 0, 0, 9, True)]
    for x, y, w, u, v, z, want in cases:
        assert spark.range(1).select(P.ring_intersects(box(x, y, w), box(u, v, z))).first()[0] is want
    far = spark.range(1).select(P.ring_distance(F.lit(5.0), F.lit(6.0), box(0, 0, 2)), P.ring_distance(F.lit(1.0), F.lit(1.0), box(0, 0, 2))).first()
    assert far[0] == 5.0 and far[1] == 0.0


def greedy(ids, order, pairs):
    near, kept = {}, set()
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i in sorted(ids, key=order):
        if not near.get(i, set()) & kept:
            kept.add(i)
    return kept


def test_greedy_choice_in_cells_equals_one_pass(spark, tmp_path):
    import random

    from croplens.operators import polygons as P

    rng = random.Random(4)
    spots = {i: (rng.random() * 30, rng.random() * 30) for i in range(400)}
    pairs = [(a, b) for a in spots for b in spots if a < b and abs(spots[a][0] - spots[b][0]) < 1.2 and abs(spots[a][1] - spots[b][1]) < 1.2]
    rows = spark.createDataFrame([(i, -(i % 17), (x, y, x + 1, y + 1)) for i, (x, y) in spots.items()], "id long, o long, box struct<x0:double,y0:double,x1:double,y1:double>")
    met = spark.createDataFrame(pairs + [(b, a) for a, b in pairs[:50]], "a long, b long")
    want = greedy(spots, lambda i: (-(i % 17), i), pairs)
    for cell, box in ((60, "box"), (10_000, "box"), (150, None)):
        got = P.apart(rows, met, "id", ["o"], f"file://{tmp_path}", box, cell)
        assert {r.id for r in got.collect()} == want and got.columns == rows.columns, (cell, box)
    assert P.apart(rows.where("false"), met.where("false"), "id", ["o"], f"file://{tmp_path}", "box").count() == 0
    assert P.apart(rows, met.where("false"), "id", ["o"], f"file://{tmp_path}", "box").count() == 400


def test_greedy_choice_of_a_path_takes_a_fixed_number_of_jobs(spark, tmp_path):
    from croplens.operators import polygons as P

    jobs = []
    for n in (100, 10_000):
        rows = spark.range(n).select("id", F.col("id").alias("o"), F.struct(F.col("id").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") + 1.0).alias("x1"), F.lit(1.0).alias("y1")).alias("box"))
        met = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        spark.sparkContext.setJobGroup(f"path{n}", "")
        kept = P.apart(rows, met, "id", ["o"], f"file://{tmp_path}", "box")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"path{n}")))
        assert kept.where("id % 2 = 1").count() == 0 and kept.count() == n // 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 3, jobs


def test_shapes_validity_and_runs(spark):
    import random

    from croplens.operators import shapes as H

    rng = random.Random(2)
    shape = lambda *rings: [[(float(x), float(y)) for x, y in ring] for ring in rings]
    box = lambda x, y, w: ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))
    cases = {
        1: (shape(box(0, 0, 9), box(2, 2, 3)), 72.0), 2: (shape(box(0, 0, 9), box(2, 2, 5), box(3, 3, 2)), 60.0), 3: (shape(((0, 0), (4, 4), (4, 0), (0, 4))), None),
        4: (shape(box(0, 0, 3), box(2, 2, 3)), None), 5: (shape(((0, 0), (4, 0), (2, 0), (2, 3))), None), 6: (shape(((0, 0), (1, 1))), None), 7: (None, None), 8: ([], None),
        9: (shape(box(0, 0, 3), box(3, 3, 2)), 13.0), 10: (shape(((0, 0), (4, 0), (4, 4), (2, 0), (0, 4))), None), 11: (shape(((0, 0), (0, 0), (3, 0), (3, 3), (3, 3))), 4.5), 12: ([[]], None),
    }
    kind = "id int, s array<array<struct<x:double,y:double>>>"
    rows = spark.createDataFrame([(i, s) for i, (s, _) in cases.items()], kind)
    got = {r.id: r.a for r in H.valid(rows, "id", "s").select("id", H.area(F.col("s")).alias("a")).collect()}
    assert got == {i: a for i, (_, a) in cases.items() if a is not None}
    stars = []
    for i in range(20):  # concave rings with a hole, corners on and off cell centres
        cx, cy, n = rng.uniform(10, 50), rng.uniform(10, 50), rng.randint(3, 12)
        turn = lambda r0, r1: [(cx + (r := rng.uniform(r0, r1)) * np.cos(2 * np.pi * k / n), cy + r * np.sin(2 * np.pi * k / n)) for k in range(n)]  # noqa: E731, B023
        stars.append((i, shape(turn(4, 15), turn(1, 3)) if i % 2 else shape(((i, 1.5), (i + 6.5, 1.5), (i + 6.5, 8), (i + 3, 4.5), (i, 8)))))
    stars = spark.createDataFrame(stars, kind)
    grid = (0.0, 0.0, 1.0)
    cells = spark.range(4900).select((F.col("id") % 70).alias("i"), F.floor(F.col("id") / 70).alias("j"))
    want = {(r.id, r.i, r.j) for r in cells.crossJoin(stars).where(H.contains(F.col("i") + 0.5, F.col("j") + 0.5, F.col("s"))).collect()}
    runs = H.scan_lines(stars, "id", "s", grid)
    assert {(r.id, r.i, r.j) for r in H.burn(runs, "id").collect()} == want and len(want) > 1000
    assert {(r.id, r.i, r.j) for r in H.covered(cells, runs).collect()} == want
    assert {(r.i, r.j) for r in H.clip(cells, stars, "id", "s", grid).collect()} == {w[1:] for w in want}
    painted = {(r.i, r.j): r.painted for r in H.paint(cells, stars, "id", "s", grid, F.col("id") + 1).collect()}
    assert painted == {(i, j): max((w[0] + 1 for w in want if w[1:] == (i, j)), default=0) for i in range(70) for j in range(70)}
