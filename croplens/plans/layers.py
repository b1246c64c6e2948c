"""Layer modes, masks, allocation, inverse projection, window tables, name sets, units and two-model reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import layers as L
from ..operators import polygons as P
from ..operators import stacks as K
from ..operators import tables as T
from ..sources import sinks
from .rasters import YEAR_MAP, observations, year_map
from .registry import query, scratch, table

LAYERS = tuple(range(2015, 2020))
_MODE = f"(SELECT pixel, irr FROM (SELECT pixel, irr, count(*) AS n FROM ym WHERE yr BETWEEN {LAYERS[0]} AND {LAYERS[-1]} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pixel ORDER BY n DESC, irr) = 1)"


@query(
    f"{YEAR_MAP} SELECT 'documented' AS mode, CAST(2016 AS BIGINT) AS yr, pixel, irr FROM ym WHERE yr = 2016 UNION ALL SELECT 'compat', 2016, pixel, irr FROM ym WHERE yr = 2016 "
    f"UNION ALL SELECT 'documented', 2030, pixel, irr FROM {_MODE} UNION ALL SELECT 'compat', 2030, pixel, irr FROM ym WHERE yr = {LAYERS[-1]}"
)
def crop_layer_modes(spark, sf_dir):
    """The crop layer of a year with one and of a year without, in both modes."""
    rows = year_map(observations(spark, sf_dir))
    made = [
        L.crop_layer(rows, "pixel", "yr", "irr", LAYERS, y, m == "documented").select(F.lit(m).alias("mode"), F.lit(y).cast("long").alias("yr"), "pixel", "irr")
        for m in ("documented", "compat") for y in (2016, 2030)
    ]
    return T.union_tables(*made)


@query(
    f"{YEAR_MAP}, w AS (SELECT pixel, yr, CAST(irr = 0 AS BIGINT) AS f, sum(CAST(irr = 0 AS BIGINT)) OVER (PARTITION BY pixel) AS s, last_value(CAST(irr = 0 AS BIGINT)) OVER (PARTITION BY pixel ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM ym) "
    "SELECT pixel, yr, CASE WHEN s >= 1 THEN f END AS documented, CASE WHEN l < 1 THEN f END AS mosaic, CASE WHEN s < 1 THEN f ELSE 0 END AS moved FROM w"
)
def min_years_masks(spark, sf_dir):
    """Irrigated flags under each of three masks of at least one year."""
    rows = year_map(observations(spark, sf_dir))
    return L.min_years_masks(rows, "pixel", "yr", F.col("irr") == 0, 1).select("pixel", "yr", "documented", "mosaic", "moved")


@query(
    "WITH a AS (SELECT p_size AS g, p_partkey AS k, CAST(p_size * (p_partkey % 10 + 1) AS BIGINT) AS area FROM part), "
    "q AS (SELECT g, k, CAST(greatest(1, ceil(CAST(area AS DOUBLE) / sum(area) OVER (PARTITION BY g) * 10)) AS BIGINT) AS quota FROM a), "
    "c AS (SELECT g, k, quota, sum(quota) OVER (PARTITION BY g ORDER BY k) AS total FROM q) SELECT g, k, quota, CAST(total AS BIGINT) AS total FROM c WHERE total - quota <= 10"
)
def allocation_until_total(spark, sf_dir):
    """Points for each polygon by area until a zone has more than ten."""
    a = table(spark, sf_dir, "part").select(F.col("p_size").alias("g"), F.col("p_partkey").alias("k"), (F.col("p_size") * (F.col("p_partkey") % 10 + 1)).cast("long").alias("area"))
    return L.allocate(a, "g", "k", "area", 10, scratch(spark))


@query("SELECT p_partkey AS k, CAST(-125.0 + p_partkey % 60 AS DOUBLE) AS lon, CAST(25.0 + p_size * 0.5 AS DOUBLE) AS lat FROM part")
def albers_round_trip(spark, sf_dir):
    """Degrees to the equal-area grid and back."""
    at = P.albers(-125.0 + F.col("p_partkey") % 60, 25.0 + F.col("p_size") * 0.5)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), at.alias("at"))
    back = rows.select("k", P.albers_inverse(F.col("at.x"), F.col("at.y")).alias("b"))
    return back.select("k", F.round("b.lon", 6).alias("lon"), F.round("b.lat", 6).alias("lat"))


_GRID = "WITH g AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, CAST(p_size AS DOUBLE) AS e FROM part)"


@query(
    f"{_GRID}, n AS (SELECT a.r, a.c, a.e, b.e AS f, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS d FROM g a JOIN g b ON b.r BETWEEN a.r - 4 AND a.r + 4 AND b.c BETWEEN a.c - 4 AND a.c + 4) "
    "SELECT r, c, " + ", ".join(f"e - avg(f) FILTER (WHERE d <= {k * k}) + 0.5 AS tpi_{k}" for k in (1, 2, 4)) + " FROM n GROUP BY r, c, e"
)
def tpi_three_radii(spark, sf_dir):
    """Height over the mean of circles of radius 1, 2 and 4: cells are sent once, for the widest, and one grouping makes all three."""
    g = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("r"), (F.col("p_partkey") % 50).alias("c"), F.col("p_size").cast("double").alias("e"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * i + j * j).alias("d")) for i in range(-4, 5) for j in range(-4, 5) if i * i + j * j <= 16])
    sent = g.select("*", F.explode(near).alias("o")).select((F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), "e", "o.d")
    means = sent.groupBy("r", "c").agg(F.max(F.when(F.col("d") == 0, F.col("e"))).alias("own"), *[F.avg(F.when(F.col("d") <= k * k, F.col("e"))).alias(f"m{k}") for k in (1, 2, 4)])
    return means.where("own is not null").select("r", "c", *[(F.col("own") - F.col(f"m{k}") + 0.5).alias(f"tpi_{k}") for k in (1, 2, 4)])


_SETS = [(side, n, back, a, b) for side, ws in (("north", K.NORTH), ("south", K.SOUTH)) for n, back, a, b in ws]


@query(
    "WITH w AS (SELECT * FROM (VALUES " + ", ".join(map(str, _SETS)) + ") t(side, name, back, a, b)), y AS (SELECT DISTINCT year(l_shipdate) AS yr FROM lineitem) "
    "SELECT yr, side, name, make_date(yr - back, a // 100, a % 100) AS start, make_date(yr - back, b // 100, b % 100) AS stop, make_date(yr - 1, 10, 1) AS water_year FROM y, w"
)
def window_sets(spark, sf_dir):
    """Northern and southern windows of each year with the start of its water year."""
    years = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("yr")).distinct()
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("side", "name", "back", "a", "b"), s)]) for s in _SETS]))
    day = lambda c: F.make_date(F.col("yr") - F.col("w.back"), F.floor(F.col(f"w.{c}") / 100), F.col(f"w.{c}") % 100)
    rows = years.select("yr", each.alias("w"))
    return rows.select("yr", "w.side", "w.name", day("a").alias("start"), day("b").alias("stop"), F.make_date(F.col("yr") - 1, F.lit(10), F.lit(1)).alias("water_year"))


@query("SELECT s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 EXCEPT SELECT s_name FROM supplier WHERE s_suppkey % 3 = 0")
def names_missing(spark, sf_dir):
    """Names that the one list has and the other lacks."""
    s = table(spark, sf_dir, "supplier")
    return s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name")).subtract(s.where("s_suppkey % 3 = 0").select("s_name"))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def keys_shared(spark, sf_dir):
    """Keys that both tables have."""
    rows = table(spark, sf_dir, "lineitem")
    key = lambda flag: rows.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k"))
    return key("A").intersect(key("R"))


@query(f"SELECT l_partkey AS k, round(sum(l_quantity) * 900 / {S.SQ_M_PER_ACRE}::DOUBLE, 6) AS acres, round(sum(l_quantity) * 900 / {S.SQ_M_PER_ACRE}::DOUBLE / {S.ACRES_PER_SQ_KM}::DOUBLE, 9) AS km2 FROM lineitem GROUP BY 1")
def area_units(spark, sf_dir):
    """Pixels of 900 square metres as acres and square kilometres."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("n"))
    acres = F.col("n") * 900 / S.SQ_M_PER_ACRE
    return rows.select("k", F.round(acres, 6).alias("acres"), F.round(acres / S.ACRES_PER_SQ_KM, 9).alias("km2"))


_TWO = {"first": "t = a", "second": "t = b", "both": "t = a AND a = b", "neither": "t <> a AND t <> b", "agree": "a = b"}


@query(f"{YEAR_MAP}, m AS (SELECT t.irr AS t, a.irr AS a, b.irr AS b FROM ym t JOIN ym a ON a.pixel = t.pixel AND a.yr = 2017 JOIN ym b ON b.pixel = t.pixel AND b.yr = 2016 WHERE t.yr = 2018) "
       "SELECT t AS truth, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _TWO.items()) + " FROM m GROUP BY t")  # fmt: skip
def two_model_report(spark, sf_dir):
    """Pixels of each class of a year's map that two others, the maps of the two years before, have right: each, both or neither, and where they agree."""
    map_of = lambda yr, name: years.where(F.col("yr") == yr).select("pixel", F.col("irr").alias(name))
    years = year_map(observations(spark, sf_dir))
    both = map_of(2018, "t").join(map_of(2017, "a"), "pixel").join(map_of(2016, "b"), "pixel")
    return both.groupBy(F.col("t").alias("truth")).agg(F.count("*").alias("n"), *[F.count_if(F.expr(c.replace("<>", "!="))).alias(n) for n, c in _TWO.items()])


@query("SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events")
def asset_properties(spark, sf_dir):
    """A row per asset with a column for each key that any property map has."""
    return sinks.property_table(table(spark, sf_dir, "events").select("event_id", "user_id", "props"), "props")
