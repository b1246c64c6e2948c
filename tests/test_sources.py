"""Readers, writers, settings and grids on small files."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from croplens.operators import grids
from croplens.sources import files, settings, sinks


def test_csv_folder_unites_by_name_and_skips_empty_files(spark, tmp_path):
    for name, text in {"b_1.csv": "x,y\n1,2\n3,4\n", "b_2.csv": "x,y\n", "b_3.csv": "", "b_4.csv": "z,x\n9,5\n", "other.txt": "q\n1\n"}.items():
        (tmp_path / name).write_text(text)
    rows = files.csv_folder(spark, str(tmp_path), "b_*.csv").orderBy("file_name", "x").select("file_name", "x", "y", "z").collect()
    assert [tuple(r) for r in rows] == [("b_1.csv", 1, 2, None), ("b_1.csv", 3, 4, None), ("b_4.csv", 5, None, 9)]
    with pytest.raises(FileNotFoundError):
        files.csv_folder(spark, str(tmp_path), "none*.csv")


def test_tsv_falls_back_to_commas(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\tz\n1\t2\t3\n")
    (tmp_path / "b.tsv").write_text("x,y,z\n1,2,3\n")
    assert [files.tsv(spark, str(tmp_path / f)).columns for f in ("a.tsv", "b.tsv")] == [["x", "y", "z"]] * 2


def test_preamble_and_positions(spark, tmp_path):
    (tmp_path / "c.csv").write_text("t\nu\nv\nw\nDate,Value\n1990,1.5\n1991,2\n")
    assert [tuple(r) for r in files.csv_after(spark, str(tmp_path / "c.csv")).orderBy("Date").collect()] == [("1990", "1.5"), ("1991", "2")]
    (tmp_path / "i").write_text("L1,2000\nL2,2001\n")
    assert files.positional(spark, str(tmp_path / "i"), ["scene", "year"]).where("year = '2001'").first().scene == "L2"
    with pytest.raises(ValueError):
        files.csv_after(spark, str(tmp_path / "i"))


def test_partitions_skip_and_copy(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda s, y, v: spark.createDataFrame([(s, y, v)], "state string, year int, v int")
    sinks.write_missing(row("MT", 2020, 1), path, ["state", "year"])
    sinks.write_missing(row("MT", 2020, 2).union(row("ID", 2021, 3)), path, ["state", "year"])
    assert sorted((r.state, r.v) for r in spark.read.parquet(path).collect()) == [("ID", 3), ("MT", 1)]
    assert files.partition(spark, path, state="ID", year=2021).first().v == 3
    assert files.partitions(spark, path, "state").count() == 2
    sinks.copy_new(spark, path, str(tmp_path / "u"))
    with pytest.raises(AnalysisException):
        sinks.copy_new(spark, path, str(tmp_path / "u"))


def test_csv_and_line_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "n int, s string")
    sinks.write_csv(rows, str(tmp_path / "c"), ["s"])
    assert files.csv(spark, str(tmp_path / "c")).columns == ["s"]
    sinks.write_lines(rows, "s", str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first().value == "a"
    assert files.file_digests(spark, str(tmp_path / "l"), "*.txt").first().bytes == 2


def test_manifest_does_not_depend_on_order(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "k int, s string")
    assert sinks.manifest(rows, ["k"]).collect() == sinks.manifest(rows.orderBy(F.desc("s")), ["k"]).collect()


def test_settings():
    text = '[product]\nname="n"\nversion="1"\n[paths]\n[run]\nstates=["MT"]\nyears=[2020]\n[model]\n[export]\n[postproc.MT]\n'
    assert settings.load(text)["run"]["years"] == [2020]
    assert settings.digest({"a": 1, "b": 2}) == settings.digest({"b": 2, "a": 1})
    for bad in (text + "[odd]\n", text.replace("[model]\n", ""), text.replace('version="1"\n', ""), text.replace('"MT"', '"ID"')):
        with pytest.raises(ValueError):
            settings.load(bad)


def test_plane_has_constant_slope(spark):
    cells = spark.range(25).select(F.floor(F.col("id") / 5).alias("r"), (F.col("id") % 5).alias("c")).withColumn("e", F.col("c") * 30.0)
    rows = grids.slope_aspect(cells, "r", "c", "e", 30.0).collect()
    assert len(rows) == 9 and all(abs(r.slope - 45) < 1e-9 and abs(r.aspect - 270) < 1e-9 for r in rows)


def test_plan_execute_and_manifest(spark, tmp_path):
    import json

    from croplens.operators import rules
    from croplens.sources import runs

    settings = {"run": {"states": ["AZ", "MT", "WA"], "years": [2007, 2022]}, "product": {"name": "x", "version": "1"}}
    planned = {(r.state, r.year): r for r in runs.plan(spark, settings).collect()}
    assert len(planned) == 6 and planned["AZ", 2022].copied and planned["MT", 2007].steps == 1 and planned["WA", 2022].stamp == rules.expressions("WA", 2022)[-1]
    with pytest.raises(ValueError):
        runs.plan(spark, settings, ["TX"])
    rows = [(s, y, p, irr, n, nd, sl, pv) for s in ("AZ", "MT", "WA", "CO") for y in (2007, 2022) for p, (irr, n, nd, sl, pv) in enumerate([(1, 9, 0.8, 1.0, 0), (0, 1, 0.5, 1.0, 0), (0, 9, 0.5, 11.0, 0), (2, 9, 0.7, 1.0, 1), (1, None, 0.8, 1.0, 1)])]
    stack = spark.createDataFrame(rows, "state string, year int, pixel int, IRR int, SUM int, NDVI double, SLOPE double, PIVOT int")
    folder = f"file://{tmp_path}/maps"
    assert runs.execute(stack, settings, folder).count() == 6
    got = {(r.state, r.year, r.pixel): r.IRR for r in spark.read.parquet(folder).collect()}
    for state, year in planned:
        own = stack.where((stack.state == state) & (stack.year == year))
        assert {(state, year, r.pixel): r.IRR for r in rules.postprocess(own, state, year).collect()} == {k: v for k, v in got.items() if k[:2] == (state, year)}
    assert runs.pending(runs.plan(spark, settings), folder).isEmpty() and runs.execute(stack, settings, folder).isEmpty()
    a, b = (json.loads(runs.manifest(settings, "c", t)) for t in ("t1", "t2"))
    assert a["digest"] == b["digest"] and a["at"] != b["at"]
    runs.write_manifest(spark, runs.manifest(settings, "c", "t"), f"file://{tmp_path}/manifest")
    assert json.loads("\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/manifest").collect()))["settings"] == settings


def test_json_documents_and_property_columns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{\n "k": 1,\n "name": "x"\n}')
    (tmp_path / "in" / "b.json").write_text('[{"k": 2}, {"k": 3, "name": "y"}]')
    rows = files.json_documents(spark, str(tmp_path / "in"))
    assert sorted((r.k, r.name) for r in rows.collect()) == [(1, "x"), (2, None), (3, "y")]
    sinks.write_json(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    with pytest.raises(AnalysisException):
        sinks.write_json(rows, str(tmp_path / "out"))
    made = spark.createDataFrame([(1, '{"b": "2", "a": 1}'), (2, '{"id": "z"}'), (3, None)], "id int, props string")
    out = sinks.property_table(made, "props").orderBy("id")
    assert out.columns == ["id", "a", "b", "id_1"]
    assert [tuple(r) for r in out.collect()] == [(1, "1", "2", None), (2, None, None, "z"), (3, None, None, None)]


def published_text():
    """Settings of a whole run with the published rules, as a file has them."""
    from croplens.operators import rules

    states = ", ".join(f'"{s}"' for s in rules.PUBLISHED)
    lines = ["[product]", 'name = "n"', 'version = "1"', "[paths]", "[run]", f"states = [{states}]", f"years = {list(range(1985, 2026))}", "[model]", "[export]"]
    for state, own in rules.PUBLISHED.items():
        lines.append(f"[postproc.{state}]")
        if own.get("copy_only"):
            lines.append("copy_only = true")
            continue
        table = lambda entry: "{ " + ", ".join(f"{k} = {v!r}" if isinstance(v, int) else f"{k} = {str(v) if isinstance(v, list) else chr(34) + v + chr(34)}" for k, v in entry.items()) + " }"
        lines += [f"threshold = {table(own['threshold'])}", *(f"{name} = [{', '.join(map(table, own[name]))}]" for name in ("pivot_assets", "steps"))]
    return "\n".join(lines)


def test_settings_carry_the_rules():
    from croplens.operators import rules

    text = published_text()
    raw = settings.load_run(text)
    assert raw["postproc"] == rules.PUBLISHED and len(raw["run"]["years"]) == 41
    assert [rules.pivots("MT", y) for y in (2009, 2010, 2012, 2018, 2019)] == [f"pivots_{y}" for y in (2009, 2011, 2013, 2015, 2019)] and rules.pivots("AZ", 2000) is None
    for old, new in (
        ("(IRR == 1)", "(IRX == 1)"), ("? 0:", "? 0"), ("3: IRR", "3: IRR)"), ("3: IRR", "3: IRR IRR"), ("3: IRR", "3: IRR: 4"), ("(SUM < {t})", "(SUM < )"), ("(SUM < {t})", "(SUM < {t}"),
        ("(SUM < {t})", "(SUM % {t})"), ("(SUM < {t})", "(SUM < {u})"), ('"ramp"', '"slope"'), ("value = 6", "values = 6"), ("copy_only = true", "copy_only = true\nsteps = []"), ('asset = "pivots"', 'name = "pivots"'),
        ("min_year = 2012", "from_year = 2012"), ("'SLOPE']", "'NDWI']"), ("'SLOPE']", "'NDVI']"),
    ):
        assert old in text
        with pytest.raises(ValueError):
            settings.load_run(text.replace(old, new))


def test_expressions_are_read_as_written(spark):
    from croplens.operators import expressions as E

    rows = spark.createDataFrame([(1, 2.0, 3), (0, -1.5, 3), (5, 0.0, None)], "a int, b double, t int")
    texts = {
        "a > 0 && b > 0 || a == 0 ? 1: 2": [1, 1, 2], "a == 1 ? b > 1 ? 7: 8: a == 0 ? 9: 10": [7, 9, 10], "(a + {t}) * 2 - -1": [9, 7, None],
        "a < {t} ? 1: 0": [1, 1, None], "(a != 5) ? (b >= 2.0 ? 1: 2): 3": [1, 2, 3], "b <= 0.5 ? a / 2: 0": [0, 0.0, 2.5],
    }
    got = rows.select(*[E.column(t, {"a", "b", "{t}"}).alias(f"c{k}") for k, t in enumerate(texts)]).collect()
    assert [[r[k] for r in got] for k in range(len(texts))] == list(texts.values())
    assert [r[0] for r in rows.select(E.column("a < {t} ? 1: 0", {"a", "{t}"}, True)).collect()] == [1, 1, 0]


def test_run_of_all_states_and_years(spark, tmp_path):
    from croplens.operators import rules
    from croplens.sources import runs

    run = settings.load_run(published_text())
    assert runs.plan(spark, run).count() == 451
    pixels = spark.range(22).select((F.col("id") % 3).cast("int").alias("IRR"), (F.col("id") % 11).cast("int").alias("SUM"), (F.col("id") % 10 / 10).alias("NDVI"), (F.col("id") * 0.7).alias("SLOPE"), (F.col("id") % 2).cast("int").alias("PIVOT"), "id")
    stack = runs.plan(spark, run).select("state", "year").crossJoin(pixels)
    few = stack.where("state in ('WA', 'MT') and year in (2000, 2022)")

    def size(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("\n"), len(df._jdf.queryExecution().optimizedPlan().toString())

    plans = [size(rules.refine(few, rules.rule_table(spark, run["postproc"], states, years))) for states, years in ((["WA"], [1999, 2000, 2001]), (run["run"]["states"], run["run"]["years"]))]
    assert abs(plans[0][1] - plans[1][1]) < 100 and plans[0][0] == plans[1][0]
    folder = f"file://{tmp_path}/maps"
    assert runs.execute(stack, run, folder).count() == 451
    got = spark.read.parquet(folder)
    assert got.count() == 451 * 22 and runs.pending(runs.plan(spark, run), folder).isEmpty()
    for state, year in (("AZ", 1990), ("ID", 2010), ("ID", 2011), ("MT", 2008), ("CA", 2020), ("WA", 2025), ("UT", 1985)):
        own = {r.id: r.IRR for r in rules.postprocess(pixels, state, year).collect()}
        assert own == {r.id: r.IRR for r in got.where(f"state = '{state}' and year = {year}").collect()}, (state, year)
