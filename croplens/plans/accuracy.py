"""Accuracy and preparation queries: joint counts, map differences, shares, series and table filters, schedules of windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import accuracy as A
from ..operators import models as M
from ..operators import tables as T
from .models import vectors
from .rasters import OBS, YEAR_MAP, observations, year_map
from .registry import query, scratch, table

_PAIRS = "WITH p AS (SELECT c_nationkey AS state, year(o_orderdate) AS yr, o_orderkey % 3 = 0 AS truth, o_custkey % 4 < 2 AS pred FROM orders JOIN customer ON o_custkey = c_custkey)"


def labelled(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_nationkey").alias("state"), F.year("o_orderdate").alias("yr"), (F.col("o_orderkey") % 3 == 0).alias("truth"), (F.col("o_custkey") % 4 < 2).alias("pred"))


@query(
    f"{_PAIRS}, c AS (SELECT state, yr, count(*) FILTER (WHERE truth AND pred) AS tp, count(*) FILTER (WHERE truth AND NOT pred) AS fn, count(*) FILTER (WHERE NOT truth AND pred) AS fp, "
    "count(*) FILTER (WHERE NOT truth AND NOT pred) AS tn FROM p GROUP BY state, yr) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS prec, round(tp / nullif(tp + fn, 0), 6) AS rec FROM c"
)
def accuracy_by_state_year(spark, sf_dir):
    out = A.joint_counts(labelled(spark, sf_dir), ["state", "yr"], F.col("truth"), F.col("pred"))
    return out.withColumns({c: F.round(c, 6) for c in ("prec", "rec")})


@query("SELECT c_nationkey AS state, c_mktsegment AS project, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def project_rollup(spark, sf_dir):
    """Count and sum per project of each state, per state with a null project, and over all."""
    money = F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total")
    return table(spark, sf_dir, "customer").rollup(F.col("c_nationkey").alias("state"), F.col("c_mktsegment").alias("project")).agg(F.count("*").alias("n"), money)


@query(
    f"{YEAR_MAP} SELECT a.irr AS before, b.irr AS after, count(*) AS n, a.irr <> b.irr AS differs FROM ym a JOIN ym b USING (pixel) WHERE a.yr = 2017 AND b.yr = 2018 GROUP BY ALL"
)
def differing_pixels(spark, sf_dir):
    """Pixels by class in two maps: both come from one grouping by pixel, without a join."""
    obs = observations(spark, sf_dir).where("yr IN (2017, 2018)")
    in_year = lambda y: F.max(F.when(F.col("yr") == y, F.col("cls")))
    both = obs.groupBy("pixel").agg(in_year(2017).alias("before"), in_year(2018).alias("after")).dropna()
    return both.groupBy("before", "after").agg(F.count("*").alias("n")).withColumn("differs", F.col("before") != F.col("after"))


@query(f"{YEAR_MAP} SELECT pixel, irr AS class FROM (SELECT pixel, irr, count(*) AS n FROM ym GROUP BY pixel, irr) QUALIFY row_number() OVER (PARTITION BY pixel ORDER BY n DESC, irr) = 1")
def mode_over_years(spark, sf_dir):
    return year_map(observations(spark, sf_dir)).groupBy("pixel").agg(F.mode("irr", True).alias("class"))


@query(
    f"{_PAIRS}, c AS (SELECT 1992 + n_nationkey % 12 AS yr, avg(n_nationkey) AS value FROM nation GROUP BY 1) "
    "SELECT DISTINCT state, CAST(yr AS BIGINT) AS yr, value, value - (SELECT avg(value) FROM c) AS anomaly FROM p JOIN c USING (yr)"
)
def climate_pairs(spark, sf_dir):
    """Climate value and anomaly of each state and year with training rows; years without climate drop out."""
    climate = table(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 12 + 1992).alias("yr")).agg(F.avg("n_nationkey").alias("value"))
    climate = climate.join(F.broadcast(climate.agg(F.avg("value").alias("mean"))))  # a row per year, and one row
    years = labelled(spark, sf_dir).select("state", "yr").distinct()
    return years.join(F.broadcast(climate), "yr").select("state", F.col("yr").cast("long").alias("yr"), "value", (F.col("value") - F.col("mean")).alias("anomaly"))


@query(
    "SELECT 'size' AS band, count(*) FILTER (WHERE p_size % 7 = 0) AS missing, count(*) AS n FROM part UNION ALL SELECT 'price', 0, count(*) FROM part "
    "UNION ALL SELECT 'brand', count(*) FILTER (WHERE p_partkey % 5 = 0), count(*) FROM part"
)
def missing_bands(spark, sf_dir):
    """Null count per band from one scan."""
    rows = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("brand")
    )
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])
    return counts.unpivot("n", rows.columns, "band", "missing").select("band", "missing", "n")


@query("SELECT p_partkey AS k, p_retailprice AS price, 0 AS slope FROM part")
def usable_columns(spark, sf_dir):
    """Columns with a null go, wanted ones that are absent are zero."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") % 2 == 0, 1).alias("odd"))
    return A.absent_as_zero(rows.select(*A.complete_columns(rows)), ["price", "slope"])


@query(
    "WITH a AS (SELECT c_nationkey AS k, sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS irr FROM customer WHERE c_nationkey % 6 > 0 GROUP BY 1), l AS (SELECT n_nationkey AS k, 1000 + n_nationkey AS land, n_nationkey % 4 AS water FROM nation) "
    "SELECT round(CAST(sum(irr) AS DOUBLE) / sum(land + water), 6) AS share, count(*) - count(irr) AS failed FROM l LEFT JOIN a USING (k)"
)
def land_share(spark, sf_dir):
    """Irrigated share of all land and water; areas without a figure count in the land and are reported."""
    irr = table(spark, sf_dir, "customer").where("c_nationkey % 6 > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("irr"))
    land = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") + 1000).alias("land"), (F.col("n_nationkey") % 4).alias("water"))
    both = land.join(irr, "k", "left")
    return both.agg(F.round(F.sum("irr").cast("double") / F.sum(F.col("land") + F.col("water")), 6).alias("share"), (F.count("*") - F.count("irr")).alias("failed"))


@query("SELECT year(o_orderdate) AS yr, o_orderpriority AS version, count(*) AS n FROM orders GROUP BY ALL")
def version_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("version")).agg(F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT user_id AS fid, CAST(ts AS DATE) + INTERVAL 31 DAY AS day, max(value) / 490 AS v FROM events GROUP BY ALL), c AS (SELECT fid, CAST(day AS DATE) AS day, CASE WHEN v >= 0.5 THEN v END AS v "
    "FROM s WHERE NOT (month(day) = 2 AND day(day) = 29)) SELECT fid, day, v FROM c WHERE fid IN (SELECT fid FROM c WHERE v IS NOT NULL)"
)
def usable_series(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("fid"), F.date_add(F.to_date("ts"), 31).alias("day")).agg((F.max("value") / 490).alias("v"))
    return A.usable_series(daily, "fid", "day", "v", 0.5).select("fid", "day", "v")


@query(
    "SELECT l_orderkey AS scene, l_linenumber AS line, dayofyear(l_shipdate) AS doy FROM lineitem WHERE l_suppkey IN (1, 2, 3) AND l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '2000-12-31' "
    "AND dayofyear(l_shipdate) > 59 AND dayofyear(l_shipdate) < 365"
)
def scene_index_filter(spark, sf_dir):
    """Scenes on listed paths, within strict date and day-of-year bounds."""
    doy, at = F.dayofyear("l_shipdate"), F.col("l_shipdate")
    bounds = (at > F.lit("1996-01-01").cast("timestamp_ntz")) & (at < F.lit("2000-12-31").cast("timestamp_ntz")) & (doy > 59) & (doy < 365)
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_suppkey").isin(1, 2, 3) & bounds)
    return rows.select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("line"), doy.alias("doy"))


@query(
    "SELECT o_orderpriority AS state, arg_max('t_' || strftime(o_orderdate, '%d%b%Y') || '.csv', CAST(o_orderdate AS DATE)) AS file FROM orders GROUP BY 1"
)
def latest_dated_file(spark, sf_dir):
    """Of the names with a date in them, the latest by that date; names without one are passed over."""
    name = F.concat(F.lit("t_"), F.date_format("o_orderdate", "ddMMMyyyy"), F.lit(".csv"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("state"), name.alias("file"))
    day = F.try_to_date(F.regexp_extract("file", r"_(\d{2}[A-Za-z]{3}\d{4})\.", 1), "ddMMMyyyy")
    return rows.groupBy("state").agg(F.max_by("file", day).alias("file"))


@query(
    "SELECT p_partkey AS k FROM part WHERE p_size % 5 < 4 QUALIFY row_number() OVER (PARTITION BY p_size % 5 ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) <= CASE p_size % 5 WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 5 END"
)
def sample_per_class(spark, sf_dir):
    """A stated number of rows of each class, in hash order."""
    cls = F.col("p_size") % 5
    wanted = F.when(cls == 0, 20).when(cls == 1, 10).otherwise(5)
    rows = table(spark, sf_dir, "part").where(cls < 4).select("p_partkey", cls.alias("cls"), F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("draw"), wanted.alias("wanted"))
    return T.ranked(rows, ["cls"], ["draw", "p_partkey"], "k", scratch(spark)).where("k <= wanted").select(F.col("p_partkey").alias("k"))


_SHARE = "CAST('0x' || substr(md5('{0}' || {1}), 1, 8) AS BIGINT) % {2}"


@query(f"SELECT p_partkey AS k, CAST({_SHARE.format('year', 'p_partkey', 8)} + 2017 AS BIGINT) AS new_year FROM part")
def year_choice(spark, sf_dir):
    """A year from 2017 to 2024 for each point, fixed by its key."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (A.share_of(F.col("p_partkey"), 8, "year") + 2017).alias("new_year"))


@query(f"SELECT p_partkey AS k, CASE WHEN {_SHARE.format('test', 'p_partkey', 100)} < 20 THEN 'test' WHEN {_SHARE.format('val', 'p_partkey', 100)} < 20 THEN 'validation' ELSE 'train' END AS part FROM part")
def nested_split(spark, sf_dir):
    """A fifth for the test, a fifth of the rest for validation."""
    in_share = lambda salt: A.share_of(F.col("p_partkey"), 100, salt) < 20
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(in_share("test"), "test").when(in_share("val"), "validation").otherwise("train").alias("part"))


@query(
    "WITH m AS (SELECT user_id AS k, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18, 2))) AS v FROM events GROUP BY ALL), d AS (SELECT k, day, CAST(v AS DOUBLE) AS v, CAST(sum(v) OVER (PARTITION BY k) AS DOUBLE) / count(*) OVER (PARTITION BY k) AS mean FROM m) "
    "SELECT k, day, CASE WHEN v < mean THEN v ELSE mean END AS base, abs(v - mean) AS height FROM d"
)
def signed_bars(spark, sf_dir):
    """Bars of a series about its mean: they stand on the value below it and on the mean above."""
    daily = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    own = Window.partitionBy("k")
    rows = daily.withColumn("mean", F.sum("v").over(own).cast("double") / F.count("*").over(own)).withColumn("v", F.col("v").cast("double"))
    return rows.select("k", "day", F.least("v", "mean").alias("base"), F.abs(F.col("v") - F.col("mean")).alias("height"))


@query(
    f"{OBS} SELECT supp AS fid, " + ", ".join(f"round(avg(nd) FILTER (WHERE yr = {y}), 6) AS nd_{y}, round(avg(slope) FILTER (WHERE yr = {y}), 6) AS slope_{y}" for y in (2016, 2017, 2018)) + " FROM obs WHERE yr IN (2016, 2017, 2018) GROUP BY supp"
)
def band_year_columns(spark, sf_dir):
    """Mean of each band and year of a polygon, one column each; the years are given, so the pivot needs no pass of its own."""
    years = [2016, 2017, 2018]
    rows = observations(spark, sf_dir).where(F.col("yr").isin(years))
    mean = {f"{b}_{y}": F.round(F.avg(F.when(F.col("yr") == y, F.col(b))), 6) for y in years for b in ("nd", "slope")}
    return rows.groupBy(F.col("supp").alias("fid")).agg(*[c.alias(n) for n, c in mean.items()])


@query(f"{OBS}, q AS (SELECT p_partkey AS pixel, least(p_size % 5, 3) AS truth FROM part), m AS (SELECT pixel, min(cls) AS pred FROM obs WHERE yr = 2018 GROUP BY pixel) SELECT q.pixel, truth, pred, CAST(truth = pred AS INT) AS static FROM q JOIN m USING (pixel)")
def static_points(spark, sf_dir):
    """Labelled points sampled from a class map, flagged where map and label agree; the two are joined by pixel."""
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pixel"), F.least(F.col("p_size") % 5, F.lit(3)).alias("truth"))
    made = observations(spark, sf_dir).where("yr = 2018").groupBy("pixel").agg(F.min("cls").alias("pred"))
    return points.join(made, "pixel").select("pixel", "truth", "pred", (F.col("truth") == F.col("pred")).cast("int").alias("static"))


_WINDOWS = (("gs", 0, "05-01", "09-30"), ("1", 0, "03-01", "05-01"), ("2", 0, "05-01", "07-15"), ("3", 0, "07-15", "09-30"), ("4", 0, "09-30", "12-31"),
            ("m1", 1, "05-01", "09-30"), ("3_m1", 1, "07-15", "09-30"), ("m2", 2, "05-01", "09-30"), ("3_m2", 2, "07-15", "09-30"))


@query(
    "WITH w AS (SELECT * FROM (VALUES " + ", ".join(map(str, _WINDOWS)) + ") t(name, back, a, b)), y AS (SELECT DISTINCT year(l_shipdate) AS yr FROM lineitem) "
    "SELECT yr, name, CAST((yr - back) || '-' || a AS DATE) AS start, CAST((yr - back) || '-' || b AS DATE) AS stop FROM y, w"
)
def season_windows(spark, sf_dir):
    """Windows of each year, the two years before included, as a table."""
    years = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("yr")).distinct()
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("back"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, k, a, b in _WINDOWS]))
    day = lambda c: F.to_date(F.concat_ws("-", F.col("yr") - F.col("w.back"), f"w.{c}"))
    return years.select("yr", each.alias("w")).select("yr", "w.name", day("a").alias("start"), day("b").alias("stop"))


@query()
def forest_search(spark, sf_dir):
    """The best of the first four settings of the grid over two folds; a forest's trees have no SQL form, so rows only."""
    names = [f"f{i}" for i in range(64)]
    found, _ = M.search(vectors(spark, sf_dir), names, "label", "vec_id", M.grid_settings(), folds=2, trees=10, budget=8)
    return spark.createDataFrame([(rank, str(one), mean, deviation) for rank, one, mean, deviation in found], "rank int, settings string, score double, deviation double")


@query()
def feature_curve(spark, sf_dir):
    """Score of class 0 with the first 1 to 5, 10, 20, 50 and all 64 features, one fit each."""
    names = [f"f{i}" for i in range(64)]
    found = A.feature_curve(vectors(spark, sf_dir), names, "label", "vec_id", counts=(1, 2, 3, 4, 5, 10, 20, 50, 64))
    return spark.createDataFrame(found, "n int, feature string, score double")
