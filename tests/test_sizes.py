"""What is shuffled and read by steps that grew too fast, and their results on odd rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from croplens.operators import stacks as K

WINDOWS = (("gs", 0, 501, 930), ("early", 0, 101, 615), ("2", 0, 501, 715), ("3", 0, 715, 930), ("m1", 1, 501, 930), ("late_m2", 2, 615, 1231))


def band_rows(spark):
    """Masked and single bands, days on the ends of windows, a year apart, a row without a time and a pixel with that only."""
    at = lambda n, y, m, d: (n, dt.datetime(y, m, d)) if y else (n, None)
    keys = [at(1, 2000, 5, 1), at(1, 2000, 6, 14), at(1, 2000, 6, 15), at(1, 2000, 9, 30), at(1, 2000, 12, 31), at(1, 2003, 7, 15), at(1, 2003, 7, 14), at(1, 0, 0, 0), at(2, 2001, 1, 1), at(2, 2001, 8, 8), at(2, 2002, 8, 8), at(3, 0, 0, 0), (None, dt.datetime(2001, 7, 1))]
    rows = [(*k, *[None if (i + j) % 5 == 0 and i % 3 == 0 else round(0.125 * ((i * 7 + j * 3) % 11 + 1), 4) for j in range(7)]) for i, k in enumerate(keys)]
    rows.append((2, dt.datetime(2001, 8, 9), *[None] * 7))
    return spark.createDataFrame(rows, "pixel int, ts timestamp_ntz, " + ", ".join(f"{b} double" for b in K.BANDS)).withColumn("ts", F.col("ts").cast("timestamp")), rows


def test_stack_of_odd_rows(spark):
    rows, given = band_rows(spark)
    got = {(r.pixel, r.yr): r for r in K.seasonal_stack(rows, "pixel", "ts", WINDOWS).collect()}
    want = {(p, t.year + back if t else None) for p, t, *_ in given for back in range(3)}
    assert set(got) == want and (3, None) in want
    for (pixel, yr), r in got.items():
        for name, back, first, stop in WINDOWS:
            own = [dict(zip(K.BANDS, v)) for p, t, *v in given if p == pixel and t and yr is not None and t.year == yr - back and first <= t.month * 100 + t.day < stop]
            for b in K.BANDS if not back else ():
                known = [o[b] for o in own if o[b] is not None]
                assert r[f"{b}_{name}"] == (pytest.approx(sum(known) / len(known)) if known else None)
            nd = [(o["B5"] - o["B4"]) / (o["B5"] + o["B4"]) for o in own if o["B5"] is not None and o["B4"] is not None]
            if name in ("gs", "m1"):
                assert r[f"nd_max_{name}"] == (pytest.approx(max(nd)) if nd else None) and r[f"nd_mean_{name}"] == (pytest.approx(sum(nd) / len(nd)) if nd else None)
            else:
                assert r[f"nd_{name}"] == (pytest.approx(max(nd)) if nd else None)
            gi = [o["B5"] / o["B3"] for o in own if o["B5"] is not None and o["B3"] is not None]
            assert r[f"gi_{name}"] == (pytest.approx(max(gi)) if gi else None)


@pytest.mark.parametrize("windows", [K.NORTH, K.SOUTH])
def test_stack_shuffles_each_scene_once_with_its_bands_only(spark, windows):
    rows, _ = band_rows(spark)
    plan = K.seasonal_stack(rows, "pixel", "ts", windows)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "explode" not in text.split("Exchange hashpartitioning")[1]  # years are made after it
    (exchange,) = [line for line in text.split("\n") if "Exchange hashpartitioning" in line]
    assert "pixel" in exchange and "partial_" not in text.split("Exchange hashpartitioning")[1]


def test_rows_of_one_file_group_reach_several_training_tasks(spark, tmp_path, monkeypatch):
    from croplens.operators import models as M

    spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("label")).coalesce(1).write.parquet(f"file://{tmp_path}/t")
    rows = spark.read.parquet(f"file://{tmp_path}/t")
    assert rows.rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "TASK_ROWS", 400)
    known = M.dealt(rows)
    sizes = [r["n"] for r in known.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 3 and max(sizes) < 400 and sum(sizes) == 1000
    known.unpersist()
    monkeypatch.setattr(M, "TASK_ROWS", 1)
    known = M.dealt(rows)
    assert known.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    known.unpersist()
    assert M.dealt(rows.where("false")).count() == 0


def test_fits_run_side_by_side_in_order(spark, monkeypatch):
    import threading

    from croplens.operators import accuracy as A
    from croplens.operators import models as M

    rows = spark.range(300).select("id", (F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 2).cast("int").alias("label")).cache()
    gate, fit = threading.Barrier(2, timeout=60), M.fit_forest
    monkeypatch.setattr(M, "fit_forest", lambda *a, **k: (gate.wait(), fit(*a, **k))[1])  # breaks if one fit waits for another
    curve = A.feature_curve(rows, ["b", "a"], "label", "id", trees=3, depth=3)
    assert [c[:2] for c in curve] == [(1, "b"), (2, "a")] and curve[1][2] > 0.9
    found = M.importance(rows, ["a", "b"], "label", fits=2, trees=3, depth=3)
    assert found[0][0] == "a" and abs(sum(w for _, w in found) - 2) < 1e-9


def test_fits_side_by_side_use_all_cores_in_even_turns(spark, monkeypatch):
    import threading

    from croplens.operators import accuracy as A
    from croplens.operators import models as M

    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(300).select("id", (F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 2).cast("int").alias("label")).coalesce(1)
    gate, fit, tasks = threading.Barrier(5, timeout=60), M.fit_forest, []
    monkeypatch.setattr(M, "fit_forest", lambda given, *a, **k: (tasks.append(given.rdd.getNumPartitions()), gate.wait(), fit(given, *a, **k))[2])  # breaks unless ten fits run five at a time
    found = M.importance(rows, ["a", "b"], "label", fits=10, trees=2, depth=2)
    assert len(tasks) == 10 and all(5 * n >= cores for n in tasks) and abs(sum(w for _, w in found) - 10) < 1e-9
    tasks.clear()
    gate = threading.Barrier(2, timeout=60)
    curve = A.feature_curve(rows, ["b", "a"], "label", "id", trees=3, depth=3)
    assert [c[:2] for c in curve] == [(1, "b"), (2, "a")] and len(tasks) == 2 and all(2 * n >= cores for n in tasks)  # two fits have half of the cores each
    for fits, n in ((None, 1), (1, cores), (2, -(-cores // 2)), (50, -(-cores // 5))):
        known = M.dealt(rows, fits)
        assert known.rdd.getNumPartitions() == n and known.count() == 300
        known.unpersist()
    assert M.dealt(rows.where("false"), 2).count() == 0
