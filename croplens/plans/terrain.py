"""Grid, geometry and catalog queries: slopes, resampling, pyramids, point grids, rings in GeoJSON, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import grids as G
from ..operators import tables as T
from ..sources import files, sinks
from .registry import query, stored, table

_GRID = "WITH g AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, CAST(p_size AS DOUBLE) AS e FROM part)"


def heights(spark, sf_dir):
    """Stand-in: parts on a grid of 50 columns, their size as height."""
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("r"), (F.col("p_partkey") % 50).alias("c"), F.col("p_size").cast("double").alias("e"))


_STEP = " UNION ALL ".join(f"SELECT r + {-i} AS r, c + {-j} AS c, {j * (2 if i == 0 else 1)} * e AS gx, {i * (2 if j == 0 else 1)} * e AS gy, {int(i == j == 0)} AS own FROM g" for i in (-1, 0, 1) for j in (-1, 0, 1))


@query(
    f"{_GRID}, s AS (SELECT r, c, sum(gx) / 240 AS gx, sum(gy) / 240 AS gy FROM ({_STEP}) GROUP BY r, c HAVING count(*) = 9) "
    "SELECT r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope, CASE WHEN gx <> 0 OR gy <> 0 THEN round(degrees(atan2(gx, gy)) + 180, 6) END AS aspect FROM s"
)
def terrain_slope_aspect(spark, sf_dir):
    out = G.slope_aspect(heights(spark, sf_dir), "r", "c", "e", 30.0)
    return out.select("r", "c", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"))


@query(f"{_GRID} SELECT r // 3 AS r, c // 3 AS c, avg(e) AS e FROM g GROUP BY 1, 2")
def reduce_resolution(spark, sf_dir):
    return G.coarser(heights(spark, sf_dir), "r", "c", "e", 3)


@query(
    f"{_GRID}, q AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 11) / 4.0 AS y, (s_suppkey * 13 % 40) / 4.0 AS x FROM supplier), "
    "n AS (SELECT q.id, g.e, (1 - abs(q.y - g.r)) * (1 - abs(q.x - g.c)) AS w FROM q JOIN g ON abs(q.y - g.r) < 1 AND abs(q.x - g.c) < 1) "
    "SELECT id, round(sum(e * w) / sum(w), 6) AS e FROM n GROUP BY id"
)
def bilinear_resample(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 11 / 4.0).alias("y"), (F.col("s_suppkey") * 13 % 40 / 4.0).alias("x"))
    return G.bilinear(q, heights(spark, sf_dir), "id", "e").select("id", F.round("e", 6).alias("e"))


@query(
    f"{_GRID}, n AS (SELECT r // 2 AS r, c // 2 AS c, e, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT r, c, e FROM n QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY n DESC, e) = 1"
)
def pyramid_mode(spark, sf_dir):
    return sinks.pyramid(heights(spark, sf_dir), "r", "c", "e")


@query(
    "WITH z AS (SELECT n_nationkey AS id, n_nationkey % 5 * 10.0 AS x0, n_nationkey // 5 * 10.0 AS y0 FROM nation), a AS (SELECT unnest(range(9)) AS i), b AS (SELECT unnest(range(9)) AS j) "
    "SELECT id, x0 + i AS x, y0 + j AS y FROM z, a, b WHERE abs(i - 4) + abs(j - 4) < 4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY md5(id || ':' || i || ':' || j)) <= 5"
)
def point_grid(spark, sf_dir):
    """Five points of each zone's grid that lie in its diamond, in an order fixed by a hash."""
    key = F.col("n_nationkey")
    z = table(spark, sf_dir, "nation").select(key.alias("id"), (key % 5 * 10.0).alias("x0"), (F.floor(key / 5) * 10.0).alias("y0"))
    within = F.abs(F.col("i") - 4) + F.abs(F.col("j") - 4) < 4
    return G.grid_points(z, "id", 9, within, 5).select("id", (F.col("x0") + F.col("i")).alias("x"), (F.col("y0") + F.col("j")).alias("y"))


@query(
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_nationkey + 1 AS DOUBLE) * 2 END AS area, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey * 0.5 + 0.5 END AS cx, CASE WHEN s_suppkey % 3 > 0 THEN 1.0 END AS cy FROM supplier"
)
def geojson_rings(spark, sf_dir):
    """Area and centroid of rectangles in GeoJSON; a third has no coordinate list."""
    w = F.col("s_nationkey") + 1
    text = F.when(F.col("s_suppkey") % 3 > 0, F.format_string('{"type":"Polygon","coordinates":[[[0,0],[%d,0],[%d,2],[0,2]]]}', w, w)).otherwise('{"type":"Point","coordinates":7}')
    ring = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), files.geojson_ring(text).alias("ring"))
    return ring.select("id", S.ring_area(F.col("ring")).alias("area"), S.centroid(F.col("ring"))["x"].alias("cx"), S.centroid(F.col("ring"))["y"].alias("cy"))


@query("SELECT s_nationkey, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256('{\"s_nationkey\":' || s_nationkey || ',\"s_suppkey\":' || s_suppkey || '}'), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM supplier GROUP BY 1")
def archive_manifest(spark, sf_dir):
    return sinks.manifest(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"])


@query(
    "SELECT c_nationkey, count(*) AS n, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, count(DISTINCT year(o_orderdate)) AS years FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"
)
def coverage_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    year = F.year("o_orderdate")
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_distinct(year).alias("years"))


@query("SELECT k AS key, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def property_union(spark, sf_dir):
    """Which keys the property maps have, with their rows."""
    keys = F.explode(F.json_object_keys("props")).alias("key")
    return table(spark, sf_dir, "events").select("event_id", keys).groupBy("key").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(
    "WITH r AS (SELECT 'basin ' || p_size AS name, p_partkey AS k, p_brand AS st FROM part) "
    "SELECT k, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '_' || replace(st, ',', '_') ELSE name END AS name FROM r"
)
def name_disambiguation(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("basin "), "p_size").alias("name"), F.col("p_brand").alias("st"))
    repeats = rows.groupBy("name").agg(F.count("*").alias("dn_n"))
    full = F.concat_ws("_", "name", F.replace("st", F.lit(","), F.lit("_")))
    return rows.join(repeats, "name").select("k", F.when(F.col("dn_n") > 1, full).otherwise(F.col("name")).alias("name"))


@query(
    "WITH z AS (SELECT s_suppkey AS id, CAST(s_suppkey * 17 % 100 AS DOUBLE) AS x, CAST(s_suppkey * 29 % 100 AS DOUBLE) AS y FROM supplier) "
    "SELECT a.id FROM z a WHERE NOT EXISTS (SELECT 1 FROM z b WHERE b.id < a.id AND abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4)"
)
def boxes_without_overlap(spark, sf_dir):
    """Boxes of side 4 that touch none with a smaller id: spatial anti-join over grid cells."""
    key = F.col("s_suppkey")
    z = table(spark, sf_dir, "supplier").select(key.alias("id"), (key * 17 % 100).cast("double").alias("x"), (key * 29 % 100).cast("double").alias("y"))
    z = stored(T.firsts(z, "id", "x", "y"))  # the others of one place touch it
    boxes = z.withColumn("box", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 4).alias("x1"), (F.col("y") + 4).alias("y1")))
    met = G.box_pairs(boxes, boxes, "id", "box", 8.0).where("a < b").select(F.col("b").alias("id")).distinct()
    return z.join(met, "id", "left_anti").select("id")
