"""Pixel queries. Stand-ins: lineitem rows are observations of a pixel (l_partkey) at l_shipdate;
nir is the price, red the quantity, the index ``nd`` ten times the discount, slope 200 times the tax.
Years are shifted by 20, so that 1995-2001 reads as 2015-2021."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import rules
from ..operators import tables as T
from .registry import query, scratch, table

OBS = """WITH obs AS (SELECT l_partkey AS pixel, l_shipdate AS ts, CAST(year(l_shipdate) + 20 AS BIGINT) AS yr, month(l_shipdate) AS mo,
 l_extendedprice AS nir, l_quantity * 1000 AS red, l_returnflag AS sensor, CAST(l_linenumber AS BIGINT) AS qa, CAST(l_linenumber % 4 AS BIGINT) AS cls,
 l_discount * 10 + 0.0 AS nd, l_tax * 200 + 0.0 AS slope, CAST(l_linestatus = 'F' AS BIGINT) AS piv, l_suppkey AS supp, l_orderkey AS ord FROM lineitem)"""
YEAR_MAP = OBS + """, ym AS (SELECT pixel, yr, max(cls) AS irr, max(nd) AS ndvi, max(slope) AS slope, max(piv) AS piv FROM obs GROUP BY pixel, yr),
freq AS (SELECT pixel, CAST(count(*) FILTER (WHERE irr = 0) AS BIGINT) AS s FROM ym GROUP BY pixel)"""
YEAR = 2018


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_partkey").alias("pixel"), c("l_shipdate").alias("ts"), (F.year("l_shipdate") + 20).cast("long").alias("yr"), F.month("l_shipdate").alias("mo"),
        c("l_extendedprice").alias("nir"), (c("l_quantity") * 1000).alias("red"), c("l_returnflag").alias("sensor"), c("l_linenumber").cast("long").alias("qa"),
        (c("l_linenumber") % 4).cast("long").alias("cls"), (c("l_discount") * 10 + 0.0).alias("nd"), (c("l_tax") * 200 + 0.0).alias("slope"),
        (c("l_linestatus") == "F").cast("long").alias("pivot"), c("l_suppkey").alias("supp"), c("l_orderkey").alias("ord"),
    )


def year_map(obs: DataFrame) -> DataFrame:
    """Class, index, slope and pivot by pixel and year; of several observations the highest counts."""
    return obs.groupBy("pixel", "yr").agg(F.max("cls").alias("irr"), F.max("nd").alias("ndvi"), F.max("slope").alias("slope"), F.max("pivot").alias("pivot"))


def stack(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """IRR, SUM (years in class 0), NDVI, SLOPE and PIVOT of a year.

    Observations are aggregated by pixel and year before any shuffle; the window goes
    over the map that is left, one row a pixel and year.
    """
    freq = F.count_if(F.col("irr") == 0).over(Window.partitionBy("pixel"))
    return year_map(observations(spark, sf_dir)).withColumn("SUM", freq).where(F.col("yr") == year).select(
        "pixel", F.col("irr").alias("IRR"), "SUM", F.col("ndvi").alias("NDVI"), F.col("slope").alias("SLOPE"), F.col("pivot").alias("PIVOT")
    )


#: Rule years: before and after each step's first year and the ramp's switch and end.
RULE_YEARS = (2007, 2008, 2010, 2011, 2012, 2015, 2018, 2022, 2025)


def _rule_sql(state: str) -> str:
    """The state's rules of each year over the map of YEAR, written out by hand apart from the operator."""
    horizon = {"MT": "6", "ID": "5", "CA": "CASE WHEN y < 2016 THEN 5 ELSE greatest(2020 - y, 0) END"}.get(state, "CASE WHEN y < 2016 THEN 5 ELSE greatest(2024 - y, 0) END")
    slope = 4 if state in ("CO", "WY", "UT") else 10
    rescue = {"MT": "y >= 2008", "ID": "y >= 2011 AND s > 5", "CO": "FALSE", "WY": "FALSE", "UT": "FALSE"}.get(state, "y >= 2012 AND s > t")
    one = f"CASE WHEN irr = 1 AND ndvi > 0.75 AND s > t THEN 0 WHEN irr = 0 AND s < t THEN 1 WHEN irr = 0 AND slope > {slope} THEN 3 ELSE irr END"
    if state == "ID":
        one = "CASE WHEN irr = 0 AND ndvi < 0.68 AND s > 5 THEN 1 WHEN irr <> 0 AND ndvi > 0.75 AND s > 5 THEN 0 WHEN irr = 0 AND s < 5 THEN 1 ELSE irr END"
        one = f"CASE WHEN ({one}) = 0 AND slope > 6 THEN 3 ELSE ({one}) END"
    years = ", ".join(f"({y})" for y in RULE_YEARS)
    return f"""{YEAR_MAP}, every AS (SELECT y, {horizon} AS t FROM (VALUES {years}) v(y)),
first AS (SELECT y, t, pixel, irr AS before, s, ndvi, piv, {one} AS irr FROM ym JOIN freq USING (pixel), every WHERE yr = {YEAR})
SELECT y AS year, pixel, before, CAST(s AS BIGINT) AS freq, CAST(CASE WHEN irr <> 0 AND ndvi > 0.68 AND piv = 1 AND {rescue} THEN 0 ELSE irr END AS BIGINT) AS class FROM first"""


def _rule_query(state: str) -> None:
    @query(_rule_sql(state), f"rule_postprocess_{state.lower()}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The map of YEAR under the rules of each year: one scan, a column per year, then a row per year."""
        out = stack(spark, sf_dir, YEAR)
        inputs = out.columns
        for y in RULE_YEARS:
            out = out.withColumn("first", F.col("IRR"))
            out = rules.postprocess(out, state, y).withColumnRenamed("IRR", f"c{y}").withColumnRenamed("first", "IRR")
            inputs.append(f"c{y}")
            out = out.select(*inputs)
        each = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"c{y}").cast("long").alias("class")) for y in RULE_YEARS]))
        return out.select("pixel", F.col("IRR").alias("before"), F.col("SUM").alias("freq"), each.alias("r")).select("r.year", "pixel", "before", "freq", "r.class")


for _state, (_, _steps) in rules.STATES.items():
    if _steps:
        _rule_query(_state)


@query(f"{YEAR_MAP} SELECT pixel, irr AS class FROM ym WHERE yr = {YEAR}")
def copy_only_state(spark, sf_dir):
    return rules.postprocess(stack(spark, sf_dir, YEAR), "AZ", YEAR).select("pixel", F.col("IRR").alias("class"))


def rule_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year of an observation, and those 7, 14 and 21 years before and 7 after."""
    years = observations(spark, sf_dir).select("yr").distinct()
    return years.select(F.explode(F.array(*[F.col("yr") + k for k in (-21, -14, -7, 0, 7)])).alias("yr")).distinct()


_YEARS = f"{OBS}, years AS (SELECT DISTINCT yr + k AS yr FROM obs, (VALUES (-21), (-14), (-7), (0), (7)) AS t(k))"


@query(f"""{_YEARS} SELECT yr, CAST(CASE WHEN yr < 2016 THEN 5 ELSE greatest(2025 - yr - 1, 0) END AS BIGINT) AS t_2025,
CAST(CASE WHEN yr < 2016 THEN 5 ELSE greatest(2021 - yr - 1, 0) END AS BIGINT) AS t_2021 FROM years""")
def rule_threshold_ramp(spark, sf_dir):
    t = lambda horizon: S.ramp(F.col("yr"), 5, 2016, horizon).cast("long")
    return rule_years(spark, sf_dir).select("yr", t(2025).alias("t_2025"), t(2021).alias("t_2021"))


@query(f"{_YEARS} SELECT yr, CASE WHEN yr < 2010 THEN '2009' WHEN yr < 2012 THEN '2011' WHEN yr < 2014 THEN '2013' WHEN yr < 2019 THEN '2015' ELSE '2019' END AS vintage FROM years")
def pivot_schedule(spark, sf_dir):
    return rule_years(spark, sf_dir).select("yr", S.schedule(F.col("yr"), rules.PIVOT_VINTAGES, rules.LAST_VINTAGE).alias("vintage"))


@query(f"""{YEAR_MAP}, own(k, state, slope_limit, fixed, horizon, since, needs) AS (VALUES
 (0, 'AZ', NULL, 0, NULL, NULL, FALSE), (1, 'CA', 10, NULL, 2021, 2012, TRUE), (2, 'CO', 4, NULL, 2025, NULL, FALSE), (3, 'ID', 6, 5, NULL, 2011, TRUE),
 (4, 'MT', 10, 6, NULL, 2008, FALSE), (5, 'NM', 10, NULL, 2025, 2012, TRUE), (6, 'NV', 10, NULL, 2025, 2012, TRUE), (7, 'OR', 10, NULL, 2025, 2012, TRUE),
 (8, 'UT', 4, NULL, 2025, NULL, FALSE), (9, 'WA', 10, NULL, 2025, 2012, TRUE), (10, 'WY', 4, NULL, 2025, NULL, FALSE)),
placed AS (SELECT ym.*, s, CAST(yr + 7 * (pixel % 3 - 1) AS INT) AS y FROM ym JOIN freq USING (pixel)),
ruled AS (SELECT placed.pixel, state, y, irr, s, ndvi, placed.slope, piv, slope_limit, since, needs, coalesce(fixed, CASE WHEN y < 2016 THEN 5 ELSE greatest(horizon - y - 1, 0) END) AS t
  FROM placed JOIN own ON pixel % 11 = k),
one AS (SELECT *, CASE WHEN state = 'AZ' THEN irr
  WHEN state = 'ID' THEN CASE WHEN irr = 0 AND ndvi < 0.68 AND s > t THEN 1 WHEN irr <> 0 AND ndvi > 0.75 AND s > t THEN 0 WHEN irr = 0 AND s < t THEN 1 ELSE irr END
  WHEN irr = 1 AND ndvi > 0.75 AND s > t THEN 0 WHEN irr = 0 AND s < t THEN 1 WHEN irr = 0 AND slope > slope_limit THEN 3 ELSE irr END AS c FROM ruled),
two AS (SELECT *, CASE WHEN state = 'ID' AND c = 0 AND slope > 6 THEN 3 ELSE c END AS d FROM one)
SELECT pixel, state, y AS year, CAST(CASE WHEN y >= since AND d <> 0 AND ndvi > 0.68 AND piv = 1 AND (s > t OR NOT needs) THEN 0 ELSE d END AS BIGINT) AS class FROM two""")
def rule_run(spark, sf_dir):
    """Every state and year in one plan, from the rules' texts. Pixels are dealt to the states and years by their number."""
    freq = F.count_if(F.col("irr") == 0).over(Window.partitionBy("pixel"))
    placed = year_map(observations(spark, sf_dir)).withColumn("SUM", freq).select(
        "pixel", F.element_at(F.array(*map(F.lit, sorted(rules.PUBLISHED))), (F.col("pixel") % 11 + 1).cast("int")).alias("state"),
        (F.col("yr") + (F.col("pixel") % 3 - 1) * 7).cast("int").alias("year"),
        F.col("irr").alias("IRR"), "SUM", F.col("ndvi").alias("NDVI"), F.col("slope").alias("SLOPE"), F.col("pivot").alias("PIVOT"),
    )
    every = rules.rule_table(spark, rules.checked(rules.PUBLISHED), rules.PUBLISHED, range(1985, 2041))
    return rules.refine(placed, every).select("pixel", "state", "year", F.col("IRR").alias("class"))


@query(f"""{OBS}, own(k, state, slope_limit, fixed, horizon, since, needs) AS (VALUES
 (0, 'AZ', NULL, 0, NULL, NULL, ''), (1, 'CA', 10, NULL, 2021, 2012, ' && (SUM > #)'), (2, 'CO', 4, NULL, 2025, NULL, ''), (3, 'ID', 6, 5, NULL, 2011, ' && (SUM > #)'),
 (4, 'MT', 10, 6, NULL, 2008, ''), (5, 'NM', 10, NULL, 2025, 2012, ' && (SUM > #)'), (6, 'NV', 10, NULL, 2025, 2012, ' && (SUM > #)'), (7, 'OR', 10, NULL, 2025, 2012, ' && (SUM > #)'),
 (8, 'UT', 4, NULL, 2025, NULL, ''), (9, 'WA', 10, NULL, 2025, 2012, ' && (SUM > #)'), (10, 'WY', 4, NULL, 2025, NULL, '')),
seen AS (SELECT DISTINCT state, CAST(yr + 7 * (pixel % 3 - 1) AS INT) AS y, slope_limit, since, needs, fixed, horizon FROM obs JOIN own ON pixel % 11 = k),
open_ AS (SELECT state, y, coalesce(fixed, CASE WHEN y < 2016 THEN 5 ELSE greatest(horizon - y - 1, 0) END) AS t, CASE WHEN state = 'AZ' THEN NULL
 WHEN y >= since THEN '(IRR != 0) && (NDVI > 0.68) && (PIVOT == 1)' || needs || ' ? 0: IRR' WHEN state = 'ID' THEN '(IRR == 0) && (SLOPE > 6) ? 3: IRR'
 ELSE '(IRR == 1) && (NDVI > 0.75) && (SUM > #) ? 0: (IRR == 0) && (SUM < #) ? 1: (IRR == 0) && (SLOPE > ' || slope_limit || ') ? 3: IRR' END AS text FROM seen)
SELECT state, y AS year, CAST(t AS INT) AS t, replace(text, '#', CAST(t AS VARCHAR)) AS stamp FROM open_""")
def rule_stamps(spark, sf_dir):
    """The threshold of each state and year that has pixels, and the text of its last rule with the threshold filled in."""
    years = observations(spark, sf_dir).select(
        F.element_at(F.array(*map(F.lit, sorted(rules.PUBLISHED))), (F.col("pixel") % 11 + 1).cast("int")).alias("state"), (F.col("yr") + (F.col("pixel") % 3 - 1) * 7).cast("int").alias("year")
    ).distinct()
    every = rules.rule_table(spark, rules.PUBLISHED, rules.PUBLISHED, range(1985, 2041))
    return years.join(F.broadcast(every), ["state", "year"]).select("state", "year", "t", "stamp")  # a row per state and year of a run


@query(f"{YEAR_MAP} SELECT pixel, s AS freq FROM freq")
def freq_sum(spark, sf_dir):
    return year_map(observations(spark, sf_dir)).groupBy("pixel").agg(F.count_if(F.col("irr") == 0).alias("freq"))


@query(f"{YEAR_MAP} SELECT pixel, CASE WHEN s >= 2 THEN s END AS freq FROM freq")
def freq_min_years(spark, sf_dir):
    return freq_sum(spark, sf_dir).select("pixel", F.when(F.col("freq") >= 2, F.col("freq")).alias("freq"))


@query(f"{YEAR_MAP} SELECT pixel, yr, CASE WHEN irr = 0 THEN irr END AS mask FROM ym")
def boolean_mask(spark, sf_dir):
    return year_map(observations(spark, sf_dir)).select("pixel", "yr", F.when(F.col("irr") == 0, F.col("irr")).alias("mask"))


@query(f"""{YEAR_MAP}, sums AS (SELECT pixel, count(*) FILTER (WHERE irr = 0 AND yr BETWEEN 2015 AND 2017) AS e,
count(*) FILTER (WHERE irr = 0 AND yr BETWEEN 2019 AND 2021) AS l, count(*) FILTER (WHERE irr = 0) AS a FROM ym GROUP BY pixel)
SELECT pixel, CAST(CASE WHEN a <= 5 THEN CAST(l >= 2 AS INT) - CAST(e >= 2 AS INT) + 2 END AS BIGINT) AS change FROM sums""")
def change_detect(spark, sf_dir):
    irr = lambda a, b: F.count_if((F.col("irr") == 0) & F.col("yr").between(a, b))
    sums = year_map(observations(spark, sf_dir)).groupBy("pixel").agg(irr(2015, 2017).alias("e"), irr(2019, 2021).alias("l"), irr(0, 9999).alias("a"))
    flag = lambda k: (F.col(k) >= 2).cast("long")
    return sums.select("pixel", F.when(F.col("a") <= 5, flag("l") - flag("e") + 2).alias("change"))


_ND = "CASE WHEN nir >= 0 AND red >= 0 THEN (nir - red) / nullif(nir + red, 0) END"


@query(f"{OBS} SELECT pixel, yr, max({_ND}) AS nd_max, max(nir / nullif(red, 0)) AS gi_max, max(2.5 * ((nir - red) / nullif(nir + 6 * red - 7.5 * red + 1, 0))) AS evi_max FROM obs GROUP BY pixel, yr")
def composite_max_indices(spark, sf_dir):
    n, r = F.col("nir"), F.col("red")
    return observations(spark, sf_dir).groupBy("pixel", "yr").agg(
        F.max(S.normalized_difference(n, r)).alias("nd_max"), F.max(S.ratio(n, r)).alias("gi_max"), F.max(S.evi(n, r, r)).alias("evi_max")
    )


@query(f"{OBS} SELECT pixel, yr, round(avg({_ND}), 6) AS nd_mean, round(avg(nd), 6) AS b_mean FROM obs GROUP BY pixel, yr")
def composite_mean_bands(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("pixel", "yr").agg(
        F.round(F.avg(S.normalized_difference(F.col("nir"), F.col("red"))), 6).alias("nd_mean"), F.round(F.avg("nd"), 6).alias("b_mean")
    )


#: Seasonal windows as (name, start, end exclusive), month * 100 + day.
NORTH = (("gs", 501, 930), ("1", 301, 501), ("2", 501, 715), ("3", 715, 930), ("4", 930, 1231))


@query(OBS + ", d AS (SELECT *, month(ts) * 100 + day(ts) AS md FROM obs) SELECT pixel, yr, " + ", ".join(f"max(nd) FILTER (WHERE md >= {a} AND md < {b}) AS nd_{n}" for n, a, b in NORTH) + " FROM d GROUP BY pixel, yr")
def seasonal_windows(spark, sf_dir):
    """All windows in one scan and one shuffle."""
    md = F.month("ts") * 100 + F.dayofmonth("ts")
    return observations(spark, sf_dir).groupBy("pixel", "yr").agg(*[F.max(F.when((md >= a) & (md < b), F.col("nd"))).alias(f"nd_{n}") for n, a, b in NORTH])


@query(OBS + """, w AS (SELECT pixel, yr, max(nd) FILTER (WHERE month(ts) * 100 + day(ts) >= 501 AND month(ts) * 100 + day(ts) < 715) AS a,
max(nd) FILTER (WHERE month(ts) * 100 + day(ts) >= 715 AND month(ts) * 100 + day(ts) < 930) AS b FROM obs GROUP BY pixel, yr)
SELECT pixel, yr, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END AS nd_int FROM w""")
def integrated_sum(spark, sf_dir):
    return seasonal_windows(spark, sf_dir).select("pixel", "yr", S.row_sum(F.col("nd_2"), F.col("nd_3")).alias("nd_int"))


@query(f"{OBS} SELECT pixel, ord, qa, (qa & 62) = 0 AS clear, CASE WHEN (qa & 62) = 0 THEN nd END AS nd FROM obs")
def qa_bitmask(spark, sf_dir):
    ok = S.clear(F.col("qa"))
    return observations(spark, sf_dir).select("pixel", "ord", "qa", ok.alias("clear"), F.when(ok, F.col("nd")).alias("nd"))


@query(f"{OBS} SELECT pixel, ord, qa, sensor, CASE sensor WHEN 'A' THEN nir * 2.75e-5 + -0.2 WHEN 'N' THEN red * 2.75e-5 + -0.2 ELSE nir * 0.00341802 + 149.0 END AS b FROM obs")
def sensor_mapping(spark, sf_dir):
    s = F.col("sensor")
    b = F.when(s == "A", S.rescale(F.col("nir"), S.OPTICAL)).when(s == "N", S.rescale(F.col("red"), S.OPTICAL)).otherwise(S.rescale(F.col("nir"), S.THERMAL))
    return observations(spark, sf_dir).select("pixel", "ord", "qa", "sensor", b.alias("b"))


@query(OBS + """ SELECT pixel, yr, round(sum(nd) FILTER (WHERE mo BETWEEN 3 AND 8), 6) AS prec_spr, round(sum(slope) FILTER (WHERE mo BETWEEN 3 AND 8), 6) AS pet_spr,
round(coalesce(sum(nd) FILTER (WHERE mo BETWEEN 3 AND 8), 0) - coalesce(sum(slope) FILTER (WHERE mo BETWEEN 3 AND 8), 0), 6) AS cwd_spr,
round(avg(nd) + avg(slope) / 2, 6) AS tmp FROM obs GROUP BY pixel, yr""")
def climate_windows(spark, sf_dir):
    """Precipitation, demand and deficit of a window; temperature halves the second mean only."""
    inside = lambda k: F.sum(F.when(F.col("mo").between(3, 8), F.col(k)))
    zero = F.lit(0.0)
    return observations(spark, sf_dir).groupBy("pixel", "yr").agg(
        F.round(inside("nd"), 6).alias("prec_spr"), F.round(inside("slope"), 6).alias("pet_spr"),
        F.round(F.coalesce(inside("nd"), zero) - F.coalesce(inside("slope"), zero), 6).alias("cwd_spr"), F.round(F.avg("nd") + F.avg("slope") / 2, 6).alias("tmp"),
    )


@query(f"{OBS} SELECT pixel, round(sum(nd), 6) AS prec, round(avg(slope), 6) AS tavg FROM obs WHERE mo IN (10, 11, 12, 1, 2, 3, 4, 5) GROUP BY pixel")
def climatology_wrap(spark, sf_dir):
    months = [*range(10, 13), *range(1, 6)]
    return observations(spark, sf_dir).where(F.col("mo").isin(months)).groupBy("pixel").agg(F.round(F.sum("nd"), 6).alias("prec"), F.round(F.avg("slope"), 6).alias("tavg"))


@query(f"{YEAR_MAP} SELECT pixel, round(avg(ndvi), 6) AS nd_lt_mn, max(ndvi) AS nd_lt_mx, round(stddev_pop(ndvi), 6) AS nd_lt_std FROM ym GROUP BY pixel")
def longterm_ndvi_stats(spark, sf_dir):
    return year_map(observations(spark, sf_dir)).groupBy("pixel").agg(
        F.round(F.avg("ndvi"), 6).alias("nd_lt_mn"), F.max("ndvi").alias("nd_lt_mx"), F.round(F.stddev_pop("ndvi"), 6).alias("nd_lt_std")
    )


@query(f"{OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY ts DESC, ord DESC, qa DESC) AS k FROM obs) SELECT pixel, cls AS class FROM r WHERE k = 1")
def mosaic_last(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("pixel").agg(F.max_by("cls", F.struct("ts", "ord", "qa")).alias("class"))


_ZONE = "JOIN supplier ON supp = s_suppkey JOIN nation ON s_nationkey = n_nationkey"


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their zone; the nations are few, suppliers are left to AQE."""
    zones = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("zone"))
    return observations(spark, sf_dir).join(zones, F.col("supp") == F.col("s_suppkey"))


@query(f"{OBS} SELECT n_name AS zone, yr, CAST(count(*) FILTER (WHERE cls = 0) AS BIGINT) * 900 / 4046.86 AS acres FROM obs {_ZONE} GROUP BY n_name, yr")
def zonal_sum_area(spark, sf_dir):
    return zoned(spark, sf_dir).groupBy("zone", "yr").agg((F.count_if(F.col("cls") == 0) * 900 / S.SQ_M_PER_ACRE).alias("acres"))


@query(f"{OBS} SELECT n_name AS zone, CAST(count(*) FILTER (WHERE cls = 0) AS DOUBLE) / count(*) AS frac FROM obs {_ZONE} GROUP BY n_name")
def zonal_mean_fraction(spark, sf_dir):
    return zoned(spark, sf_dir).groupBy("zone").agg((F.count_if(F.col("cls") == 0) / F.count("*")).alias("frac"))


@query(f"""{OBS}, n AS (SELECT n_name AS zone, cls, count(*) AS c FROM obs {_ZONE} GROUP BY n_name, cls),
r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY c DESC, cls) AS k, sum(c) OVER (PARTITION BY zone) AS total FROM n)
SELECT zone, cls AS majority, CAST(c AS DOUBLE) / total AS purity FROM r WHERE k = 1""")
def zonal_majority_purity(spark, sf_dir):
    """Ties go to the smallest class."""
    return T.majority(zoned(spark, sf_dir), "zone", "cls")


@query(f"""{YEAR_MAP}, z AS (SELECT DISTINCT pixel, n_name AS zone FROM obs {_ZONE}), n AS (SELECT zone, s, count(*) AS c FROM z JOIN freq USING (pixel) GROUP BY zone, s),
r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY c DESC, s) AS k FROM n) SELECT zone, s AS freq FROM r WHERE k = 1""")
def zonal_mode(spark, sf_dir):
    where = zoned(spark, sf_dir).select("pixel", "zone").distinct()
    n = where.join(freq_sum(spark, sf_dir), "pixel").groupBy("zone", "freq").agg(F.count("*").alias("c"))
    return n.groupBy("zone").agg(F.max_by("freq", F.struct(F.col("c"), -F.col("freq"))).alias("freq"))


@query(f"""{OBS}, z AS (SELECT n_name AS zone, nd FROM obs {_ZONE}), q AS (SELECT zone, quantile_cont(nd, 0.15) AS p15, median(nd) AS med FROM z GROUP BY zone)
SELECT zone, round(avg(nd), 6) AS trimmed, round(any_value(med), 6) AS med FROM z JOIN q USING (zone) WHERE nd <= p15 GROUP BY zone""")
def zonal_trimmed_mean(spark, sf_dir):
    """Mean of the values up to the 15th percentile, and median."""
    low = T.low_mean(zoned(spark, sf_dir), "zone", "nd", 0.15, scratch(spark))
    return low.select("zone", F.round("trimmed", 6).alias("trimmed"), F.round("med", 6).alias("med"))


@query(f"{OBS} SELECT sensor, yr, CAST(count(*) AS BIGINT) AS scenes FROM obs WHERE ts > TIMESTAMP '1995-02-01' AND ts < TIMESTAMP '2001-06-30' AND dayofyear(ts) > 59 AND dayofyear(ts) < 365 GROUP BY sensor, yr")
def scene_count_by_sensor(spark, sf_dir):
    day = F.dayofyear("ts")
    rows = observations(spark, sf_dir).where((F.col("ts") > F.lit("1995-02-01").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2001-06-30").cast("timestamp_ntz")) & (day > 59) & (day < 365))
    return rows.groupBy("sensor", "yr").agg(F.count("*").alias("scenes"))


_GRID = "WITH g AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, CAST(p_size AS DOUBLE) AS e FROM part)"


@query(f"{_GRID} SELECT a.r, a.c, a.e - avg(b.e) + 0.5 AS tpi FROM g a JOIN g b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 4 GROUP BY a.r, a.c, a.e")
def tpi_focal(spark, sf_dir):
    """Height over the mean of a circle of radius 2: each cell sends itself to its 13 neighbours, one equi-grouping.

    Stand-in: parts on a grid of 50 columns, their size as height.
    """
    g = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("r"), (F.col("p_partkey") % 50).alias("c"), F.col("p_size").cast("double").alias("e"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4])
    sent = g.select("*", F.explode(near).alias("o")).select((F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), "e", F.when((F.col("o.i") == 0) & (F.col("o.j") == 0), F.col("e")).alias("own"))
    return sent.groupBy("r", "c").agg(F.max("own").alias("own"), F.avg("e").alias("m")).where(F.col("own").isNotNull()).select("r", "c", (F.col("own") - F.col("m") + 0.5).alias("tpi"))
