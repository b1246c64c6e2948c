"""Whole feature stacks. Stand-in: lineitem rows are scenes of five sensors, dealt by l_orderkey; counts are made from the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stacks as K
from .registry import query, table

SENSORS = ("LT04", "LT05", "LE07", "LC08", "LC09")
_COUNT = {f"SR_B{i}": f"8000 + (l_partkey * {37 * i} + l_orderkey * 11 + l_linenumber * 101) % 12000" for i in range(1, 8)}
_COUNT |= {b: "40000 + (l_orderkey * 7 + l_partkey) % 9000" for b in ("ST_B6", "ST_B10")}
_QA = "CASE WHEN l_linenumber = 7 THEN 8 ELSE 1 END AS QA_PIXEL, CASE WHEN l_suppkey % 17 = 0 THEN 1 ELSE 0 END AS QA_RADSAT"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five collections, each with its own band names, united."""
    rows = table(spark, sf_dir, "lineitem")
    parts = {}
    for i, name in enumerate(SENSORS):
        bands = K.OLDER if i < 3 else K.NEWER
        own = rows.where(F.col("l_orderkey") % 5 == i).selectExpr("l_partkey AS pixel", "l_shipdate AS ts", _QA.split(", ")[0], _QA.split(", ")[1], *[f"{_COUNT[b]} AS {b}" for b in bands])
        parts[name] = (own, bands)
    return K.unite_sensors(parts, ["pixel", "ts"])


def _scenes_sql() -> str:
    number = lambda i: f"(8000 + (l_partkey * {37 * i} + l_orderkey * 11 + l_linenumber * 101) % 12000)"
    optical = ((1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (7, 7))
    bands = ", ".join(f"CASE WHEN ok THEN CASE WHEN l_orderkey % 5 < 3 THEN {number(a)} ELSE {number(b)} END * 2.75e-5::DOUBLE + -0.2::DOUBLE END AS {n}" for (a, b), n in zip(optical, K.BANDS))
    return f"""WITH l AS (SELECT *, l_linenumber <> 7 AND l_suppkey % 17 <> 0 AS ok FROM lineitem),
s AS (SELECT l_partkey AS pixel, l_shipdate AS ts, ['LT04', 'LT05', 'LE07', 'LC08', 'LC09'][l_orderkey % 5 + 1] AS sensor, {bands},
CASE WHEN ok THEN (40000 + (l_orderkey * 7 + l_partkey) % 9000) * 0.00341802::DOUBLE + 149.0::DOUBLE END AS B10 FROM l)"""


@query(_scenes_sql() + " SELECT sensor, year(ts) AS yr, count(*) AS n, count(B2) AS clear, " + ", ".join(f"round(sum({b}), 4) AS {b}" for b in K.BANDS) + " FROM s GROUP BY ALL")
def sensor_union(spark, sf_dir):
    """Scenes, clear pixels and band sums by sensor and year."""
    return scenes(spark, sf_dir).groupBy("sensor", F.year("ts").alias("yr")).agg(F.count("*").alias("n"), F.count("B2").alias("clear"), *[F.round(F.sum(b), 4).alias(b) for b in K.BANDS])


def _stack_sql(windows) -> str:
    nd = lambda a, b: f"CASE WHEN {a} >= 0 AND {b} >= 0 THEN ({a} - {b}) / nullif({a} + {b}, 0) END"
    index = {"nd": nd("B5", "B4"), "nw": nd("B5", "B6"), "evi": "2.5 * ((B5 - B4) / nullif(B5 + 6 * B4 - 7.5 * B2 + 1, 0))", "gi": "B5 / nullif(B3, 0)"}
    cols = []
    for name, back, first, stop in windows:
        if_ = f"FILTER (WHERE yr - own = {back} AND day >= {first} AND day < {stop})"
        cols += [f"round(avg({b}) {if_}, 12) AS {b}_{name}" for b in K.BANDS if not back]
        cols += [f"round(max(nd) {if_}, 12) AS nd_max_{name}", f"round(avg(nd) {if_}, 12) AS nd_mean_{name}"] if name in ("gs", "m1", "m2") else [f"round(max(nd) {if_}, 12) AS nd_{name}"]
        cols += [f"round(max({i}) {if_}, 12) AS {i}_{name}" for i in ("nw", "evi", "gi")]
    both = [f"CASE WHEN a.{i}_2 IS NOT NULL OR a.{i}_3 IS NOT NULL THEN coalesce(a.{i}_2, 0) + coalesce(a.{i}_3, 0) END AS {i}_int" for i in ("nd", "gi", "nw", "evi")]
    return f"""{_scenes_sql()}, d AS (SELECT pixel, year(ts) AS own, month(ts) * 100 + day(ts) AS day, {", ".join(K.BANDS)}, {", ".join(f"{c} AS {n}" for n, c in index.items())} FROM s),
e AS (SELECT *, own + back AS yr FROM d, range(3) b(back)), a AS (SELECT pixel, yr, {", ".join(cols)} FROM e GROUP BY pixel, yr) SELECT *, {", ".join(both)} FROM a"""


def _stack_query(name: str, windows) -> None:
    @query(_stack_sql(windows), name)
    def run(spark, sf_dir):
        out = K.seasonal_stack(scenes(spark, sf_dir), "pixel", "ts", windows)
        rounded = out.select("pixel", F.col("yr").cast("long").alias("yr"), *[F.round(c, 12).alias(c) for c in out.columns[2:] if not c.endswith("_int")])
        # sums of rounded values, so that both sides add the same numbers
        return K.with_sums(rounded)


_stack_query("feature_stack_north", K.NORTH)
_stack_query("feature_stack_south", K.SOUTH)


def _climate_sql() -> str:
    cols, more, usual = [], [], []
    for n, back, first, stop, a, b in K.CLIMATE:
        inside = f"(yr = own + 1 AND day >= {first} OR yr = own AND day < {stop})" if back else f"yr = own AND day >= {first} AND day < {stop}"
        if_ = f"FILTER (WHERE {inside})"
        cols += [f"avg(tmmn) {if_} + avg(tmmx) {if_} / 2 AS tmp_{n}", f"sum(pr) {if_} AS prec_tot_{n}", f"sum(eto) {if_} AS pet_tot_{n}"]
        months = f"month BETWEEN {a} AND {b}" if a <= b else f"(month >= {a} OR month <= {b})"
        usual += [f"sum(prec) FILTER (WHERE {months}) AS p_{n}", f"avg(tavg) FILTER (WHERE {months}) AS t_{n}"]
        parts = {f"tmp_{n}": f"tmp_{n}", f"prec_tot_{n}": f"prec_tot_{n}", f"pet_tot_{n}": f"pet_tot_{n}", f"cwd_{n}": f"prec_tot_{n} - pet_tot_{n}",
                 f"an_temp_{n}": f"tmp_{n} - t_{n}", f"prec_tot_{n}_1": f"prec_tot_{n} - p_{n}"}
        more += [f"round({v}, 5) AS {k}" for k, v in parts.items()]
    return f"""WITH e AS (SELECT l_partkey AS pixel, year(l_shipdate) AS own, year(l_shipdate) + back AS yr, month(l_shipdate) * 100 + day(l_shipdate) AS day,
l_discount * 10 AS pr, l_tax * 50 AS eto, l_quantity AS tmmn, l_quantity + l_tax * 100 AS tmmx FROM lineitem, range(2) b(back)),
u AS (SELECT p_partkey AS pixel, {", ".join(usual)} FROM (SELECT p_partkey, month, (p_partkey % 7 + month) * 0.1::DOUBLE AS prec, month + p_size * 0.1::DOUBLE AS tavg FROM part, range(1, 13) m(month)) GROUP BY p_partkey),
a AS (SELECT pixel, yr, {", ".join(cols)} FROM e GROUP BY pixel, yr) SELECT pixel, yr, {", ".join(more)} FROM a LEFT JOIN u USING (pixel)"""


@query(_climate_sql())
def climate_stack(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pixel"), F.col("l_shipdate").alias("ts"), (F.col("l_discount") * 10).alias("pr"), (F.col("l_tax") * 50).alias("eto"),
                                                   F.col("l_quantity").alias("tmmn"), (F.col("l_quantity") + F.col("l_tax") * 100).alias("tmmx"))
    months = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pixel"), "p_size", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    normals = months.select("pixel", "month", ((F.col("pixel") % 7 + F.col("month")) * 0.1).alias("prec"), (F.col("month") + F.col("p_size") * 0.1).alias("tavg"))
    out = K.climate_stack(rows, normals, "pixel", "ts")
    return out.select("pixel", F.col("yr").cast("long").alias("yr"), *[F.round(c, 5).alias(c) for c in out.columns[2:]])
