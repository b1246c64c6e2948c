"""Grid operators: neighbours by equi-keys, coarser and finer grids, candidate points and box joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables as T


#: Semi-major axis and flattening of the WGS84 ellipsoid.
WGS84 = (6378137.0, 1 / 298.257223563)


def slope_aspect(cells: DataFrame, r: str, c: str, e: str, size: float) -> DataFrame:
    """Slope and downslope direction in degrees by Horn's 3x3 weights; cells at the border have none.

    Each cell sends itself to its nine neighbours, so one grouping gives both gradients.
    """
    moves = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * (2 - abs(j))).alias("wy"), F.lit(j * (2 - abs(i))).alias("wx")) for i, j in moves])
    sent = cells.select(r, c, e, F.explode(near).alias("o")).select((F.col(r) - F.col("o.i")).alias(r), (F.col(c) - F.col("o.j")).alias(c), (F.col(e) * F.col("o.wx")).alias("gx"), (F.col(e) * F.col("o.wy")).alias("gy"))
    grad = sent.groupBy(r, c).agg((F.sum("gx") / (8 * size)).alias("gx"), (F.sum("gy") / (8 * size)).alias("gy"), F.count("*").alias("n")).where("n = 9")
    flat = (F.col("gx") == 0) & (F.col("gy") == 0)
    return grad.select(r, c, F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))).alias("slope"), F.when(~flat, F.degrees(F.atan2("gx", "gy")) + 180).alias("aspect"))


def coarser(cells: DataFrame, r: str, c: str, e: str, factor: int) -> DataFrame:
    return cells.groupBy(F.floor(F.col(r) / factor).alias(r), F.floor(F.col(c) / factor).alias(c)).agg(F.avg(e).alias(e))


def bilinear(points: DataFrame, cells: DataFrame, key: str, e: str, r: str = "r", c: str = "c") -> DataFrame:
    """Value at (y, x) from the four cells around it, by equi-join; missing cells leave their weight to the others."""
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    at = points.withColumn("o", corner).withColumns({r: F.floor("y") + F.col("o.i"), c: F.floor("x") + F.col("o.j")})
    w = (1 - F.abs(F.col("y") - F.col(r))) * (1 - F.abs(F.col("x") - F.col(c)))
    both = at.withColumn("w", w).where("w > 0").join(cells, [r, c])
    return both.groupBy(key).agg((F.sum(F.col(e) * F.col("w")) / F.sum("w")).alias(e))


def grid_points(zones: DataFrame, key: str, side: int, within: Column, n: int) -> DataFrame:
    """The first n places (i, j) of each zone's grid that satisfy within, ordered by a hash of zone and place."""
    step = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    places = zones.withColumn("i", step).withColumn("j", step).where(within)
    order = Window.partitionBy(key).orderBy(F.md5(F.concat_ws(":", key, "i", "j").cast("binary")))
    return places.withColumn("gp_n", F.row_number().over(order)).where(F.col("gp_n") <= n).drop("gp_n")


def box_pairs(left: DataFrame, right: DataFrame, key: str, box: str, cell: float) -> DataFrame:
    """Pairs (a, b) of keys whose boxes touch; boxes meet in grid cells, and a pair counts in its first common cell only."""

    def placed(rows: DataFrame, name: str) -> DataFrame:
        span = lambda k: F.explode(F.sequence(F.floor(F.col(f"{box}.{k}0") / cell), F.floor(F.col(f"{box}.{k}1") / cell)))
        return rows.select(F.col(key).alias(name), F.col(box).alias(f"box_{name}"), span("x").alias("ci"), box).withColumn("cj", span("y")).drop(box)

    a, b = (lambda k: F.col(f"box_a.{k}")), (lambda k: F.col(f"box_b.{k}"))
    touch = (a("x0") <= b("x1")) & (b("x0") <= a("x1")) & (a("y0") <= b("y1")) & (b("y0") <= a("y1"))
    first = (F.col("ci") == F.floor(F.greatest(a("x0"), b("x0")) / cell)) & (F.col("cj") == F.floor(F.greatest(a("y0"), b("y0")) / cell))
    return T.spread(placed(left, "a"), "ci", "cj", "a").join(placed(right, "b"), ["ci", "cj"]).where(touch & first).select("a", "b")


def zone_area(south: Column, north: Column, width: Column, ellipsoid: tuple[float, float] = WGS84) -> Column:
    """Square metres of the ellipsoid between two latitudes and a width of longitude, all in degrees."""
    a, f = ellipsoid
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    s = lambda lat: F.sin(F.radians(lat))
    q = lambda lat: (s(lat) / (1 - s(lat) * s(lat) * e2) - F.log((1 - s(lat) * e) / (1 + s(lat) * e)) / (2 * e)) * (1 - e2)
    return (q(north) - q(south)) * F.radians(width) * (a * a / 2)


def degree_cell(i: Column, j: Column, origin: tuple[float, float], step: float) -> Column:
    """(lon, lat, area) of cell (i, j) of a grid of degrees that begins at origin (lon, lat): its centre and its square metres."""
    west, south = i * step + origin[0], j * step + origin[1]
    return F.struct((west + step / 2).alias("lon"), (south + step / 2).alias("lat"), zone_area(south, south + step, F.lit(step)).alias("area"))
