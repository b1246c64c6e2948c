"""Polygon queries: selections, merges, overlap, distance, projection and crop classes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import grids as G
from ..operators import polygons as P
from ..operators import tables as T
from .registry import query, scratch, stored, table

#: Crop codes (first, last) and their class: 1 grain, 2 vegetable, 3 forage, 4 orchard; every other code is 5.
CROP_CLASSES = (
    (1, 6, 1), (10, 10, 1), (12, 13, 1), (21, 35, 1), (38, 39, 1), (205, 205, 1), (225, 226, 1), (228, 228, 1), (234, 241, 1), (254, 254, 1),
    (11, 11, 2), (14, 14, 2), (41, 57, 2), (206, 211, 2), (213, 216, 2), (219, 219, 2), (221, 222, 2), (227, 227, 2), (229, 233, 2), (242, 250, 2),
    (36, 37, 3), (58, 62, 3), (212, 212, 3), (224, 224, 3),
    (66, 72, 4), (74, 77, 4), (204, 204, 4), (217, 218, 4), (220, 220, 4), (223, 223, 4),
)
#: Wetland types that count.
WETLANDS = ("Freshwater Emergent Wetland", "Freshwater Forested/Shrub Wetland", "Estuarine and Marine Wetland", "Estuarine and Marine Deepwater")

_BOX = (
    "WITH z AS (SELECT s_suppkey AS id, CAST(s_suppkey * 17 % 100 AS DOUBLE) AS x0, CAST(s_suppkey * 29 % 100 AS DOUBLE) AS y0, "
    "CAST(s_suppkey % 7 + 2 AS DOUBLE) AS w, CAST(s_suppkey % 5 + 2 AS DOUBLE) AS h FROM supplier)"
)


def boxes(spark, sf_dir):
    """Stand-in: a rectangle per supplier."""
    k = F.col("s_suppkey")
    z = table(spark, sf_dir, "supplier").select(
        k.alias("id"), (k * 17 % 100).cast("double").alias("x0"), (k * 29 % 100).cast("double").alias("y0"), (k % 7 + 2).cast("double").alias("w"), (k % 5 + 2).cast("double").alias("h")
    )
    return z.withColumn("ring", S.rectangle(F.col("x0"), F.col("y0"), F.col("w"), F.col("h")))


@query(
    f"{_BOX.replace('WITH', 'WITH RECURSIVE')}, o AS (SELECT *, row_number() OVER (ORDER BY w * h DESC, id) AS k FROM z WHERE w * h >= 8 AND pi() * w * h / ((w + h) * (w + h)) >= 0.3), "
    "g(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) UNION ALL "
    "SELECT o.k, CASE WHEN len(list_filter(kept, lambda b: b.x0 <= o.x0 + o.w AND o.x0 <= b.x1 AND b.y0 <= o.y0 + o.h AND o.y0 <= b.y1)) > 0 THEN kept "
    "ELSE list_append(kept, {'id': o.id, 'x0': o.x0, 'y0': o.y0, 'x1': o.x0 + o.w, 'y1': o.y0 + o.h}) END FROM g JOIN o ON o.k = g.k + 1) "
    "SELECT unnest(list_transform(kept, lambda b: b.id)) AS id FROM g WHERE k = (SELECT max(k) FROM g)"
)
def protected_areas(spark, sf_dir):
    """Large, compact, simple areas, each kept unless it meets a larger one kept before."""
    area = S.ring_area(F.col("ring"))
    z = boxes(spark, sf_dir).where((area >= 8) & (F.size("ring") <= 1000) & (S.compactness(F.col("ring")) >= 0.3))
    # of equal rings only that of the least id can be kept: the others meet it, or what it meets
    z = stored(T.firsts(z.select("id", (-area).alias("order"), S.bounds(F.col("ring")).alias("box"), "ring"), "id", "ring", "order", "box").drop("ring"))
    return P.apart(z, G.box_pairs(z, z, "id", "box", 8.0), "id", ["order"], scratch(spark), "box").select("id")


@query(f"{_BOX} SELECT a.id AS a, b.id AS b FROM z a JOIN z b ON a.id < b.id AND a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w AND a.y0 <= b.y0 + b.h AND b.y0 <= a.y0 + a.h")
def polygon_intersects(spark, sf_dir):
    """Pairs of rings that share a point: boxes meet in grid cells, then edges cross or one ring holds the other's first corner."""
    z = boxes(spark, sf_dir).select("id", "ring", S.bounds(F.col("ring")).alias("box"))
    kinds = stored(T.firsts(z, "id", "ring", "box"))
    pairs = G.box_pairs(kinds, kinds, "id", "box", 8.0).where("a <= b")  # a ring meets its equals
    left, right = kinds.select(F.col("id").alias("a"), F.col("ring").alias("ra")), kinds.select(F.col("id").alias("b"), F.col("ring").alias("rb"))
    met = pairs.join(left, "a").join(right, "b").where(P.ring_intersects(F.col("ra"), F.col("rb"))).select("a", "b")
    return T.pairs_of_members(stored(met), stored(T.members(z, kinds, "id", "ring", "box")))


@query(
    f"{_BOX} SELECT id, round(sqrt(power(greatest(x0 - 50, 50 - x0 - w, 0), 2) + power(greatest(y0 - 50, 50 - y0 - h, 0), 2)), 6) AS far FROM z "
    "WHERE power(greatest(x0 - 50, 50 - x0 - w, 0), 2) + power(greatest(y0 - 50, 50 - y0 - h, 0), 2) <= 400"
)
def point_buffer(spark, sf_dir):
    """Rings within 20 of the point (50, 50), with their distance: an exact buffer."""
    far = P.ring_distance(F.lit(50.0), F.lit(50.0), F.col("ring"))
    return boxes(spark, sf_dir).select("id", far.alias("far")).where("far <= 20").select("id", F.round("far", 6).alias("far"))


def _albers_sql() -> str:
    e2 = 0.0066943800229007876
    e = math.sqrt(e2)
    q = lambda s: f"({1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}))"
    m = lambda s: f"((1 - {s} * {s}) / (1 - {e2!r} * {s} * {s}))"
    return f"""WITH g AS (SELECT p_partkey AS k, -125.0 + p_partkey % 60 AS lon, 25.0 + p_size * 0.5 AS lat FROM part),
s AS (SELECT sin(radians(29.5)) AS s1, sin(radians(45.5)) AS s2, sin(radians(23.0)) AS s0),
n AS (SELECT ({m('s1')} - {m('s2')}) / ({q('s2')} - {q('s1')}) AS n, * FROM s),
c AS (SELECT n, {m('s1')} + n * {q('s1')} AS c, {q('s0')} AS q0 FROM n),
r AS (SELECT k, 6378137.0 * sqrt(c - n * {q('sin(radians(lat))')}) / n AS r, n * radians(lon + 96) AS t, 6378137.0 * sqrt(c - n * q0) / n AS r0 FROM g, c)
SELECT k, round(r * sin(t), 2) AS x, round(r0 - r * cos(t), 2) AS y FROM r"""


@query(_albers_sql())
def albers_projection(spark, sf_dir):
    at = P.albers(-125.0 + F.col("p_partkey") % 60, 25.0 + F.col("p_size") * 0.5)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), at.alias("at"))
    return rows.select("k", F.round("at.x", 2).alias("x"), F.round("at.y", 2).alias("y"))


@query(
    f"{_BOX} SELECT count(*) OVER (ORDER BY src, id ROWS UNBOUNDED PRECEDING) AS fid, src, id FROM "
    "(SELECT 'north' AS src, id, y0 FROM z UNION ALL SELECT 'south', id, y0 - 60 FROM z) JOIN (SELECT id, h FROM z) USING (id) WHERE abs(y0 + h / 2) <= 50"
)
def merge_sources(spark, sf_dir):
    """Two sources with their names, far centroids dropped, numbered anew."""
    z = boxes(spark, sf_dir)
    moved = z.withColumn("ring", F.transform("ring", lambda p: F.struct(p["x"].alias("x"), (p["y"] - 60).alias("y"))))
    both = z.withColumn("src", F.lit("north")).unionByName(moved.withColumn("src", F.lit("south"))).where(F.abs(S.centroid(F.col("ring"))["y"]) <= 50)
    # one group of all rows, so that numbers run through both sources
    return T.ranked(both.select("src", "id", F.lit(0).alias("one")), ["one"], ["src", "id"], "fid", scratch(spark)).select("fid", "src", "id")


@query(
    f"{_BOX}, p AS (SELECT id, w * h AS area, 0 AS part FROM z UNION ALL SELECT id, w + h, 1 FROM z WHERE id % 3 = 0) "
    "SELECT id, sum(area) AS area, max(area) AS largest, CAST(arg_max(part, area * 10 - part) AS INT) AS part FROM p GROUP BY id"
)
def multi_part_area(spark, sf_dir):
    """Parts of each shape: their summed area, and which is largest (the first of equals)."""
    other = S.rectangle(F.lit(0), F.lit(0), F.col("w") + F.col("h"), F.lit(1))
    parts = F.when(F.col("id") % 3 == 0, F.array("ring", other)).otherwise(F.array("ring"))
    areas = boxes(spark, sf_dir).select("id", F.transform(parts, S.ring_area).alias("areas"))
    total, largest = F.aggregate("areas", F.lit(0.0), lambda s, x: s + x), F.array_max("areas")
    return areas.select("id", total.alias("area"), largest.alias("largest"), (F.array_position("areas", largest) - 1).cast("int").alias("part"))


@query(f"{_BOX} SELECT sum(area) AS area, count(*) AS n FROM (SELECT DISTINCT w, h, w * h AS area FROM z)")
def deduped_area(spark, sf_dir):
    """Total area with repeated rings counted once."""
    z = boxes(spark, sf_dir).withColumn("ring", S.rectangle(F.lit(0), F.lit(0), F.col("w"), F.col("h")))
    return z.dropDuplicates(["ring"]).agg(F.sum(S.ring_area(F.col("ring"))).alias("area"), F.count("*").alias("n"))


def _class_sql(code: str) -> str:
    return f"CASE {' '.join(f'WHEN {code} BETWEEN {a} AND {b} THEN {c}' for a, b, c in CROP_CLASSES)} ELSE 5 END"


@query(f"SELECT code, CAST({_class_sql('code')} AS BIGINT) AS class, n FROM (SELECT p_partkey % 255 + 1 AS code, count(*) AS n FROM part GROUP BY 1)")
def crop_classes(spark, sf_dir):
    code = (F.col("p_partkey") % 255 + 1).alias("code")
    out = table(spark, sf_dir, "part").groupBy(code).agg(F.count("*").alias("n"))
    return out.select("code", P.class_of(F.col("code"), CROP_CLASSES, 5).cast("long").alias("class"), "n")


@query(f"SELECT p_partkey AS k FROM part WHERE {_class_sql('(p_partkey % 255 + 1)')} = 5")
def not_crops(spark, sf_dir):
    """Fields whose majority code is no crop."""
    code = F.col("p_partkey") % 255 + 1
    return table(spark, sf_dir, "part").where(P.class_of(code, CROP_CLASSES, 5) == 5).select(F.col("p_partkey").alias("k"))


@query(
    "WITH t AS (SELECT unnest(['" + "', '".join([*WETLANDS, "Riverine"]) + "']) AS t, unnest(range(5)) AS i), "
    f"{_BOX[5:]} SELECT id, t AS type FROM z JOIN t ON id % 5 = i WHERE t <> 'Riverine' AND pi() * w * h / ((w + h) * (w + h)) > 0.05 AND w * h > 10"
)
def wetland_filter(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, [*WETLANDS, "Riverine"])), (F.col("id") % 5 + 1).cast("int"))
    z = boxes(spark, sf_dir).withColumn("type", kind)
    return z.where(F.col("type").isin(*WETLANDS) & (S.compactness(F.col("ring")) > 0.05) & (S.ring_area(F.col("ring")) > 10)).select("id", "type")
