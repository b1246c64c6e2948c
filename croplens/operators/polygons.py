"""Polygon selection: greedy choice without overlap, exact ring tests, map projection and code classes."""

from __future__ import annotations

import math
import operator
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import tables as T

#: Semi-major axis and flattening of the GRS80 ellipsoid.
GRS80 = (6378137.0, 1 / 298.257222101)
#: Standard parallels, origin latitude and central meridian of the conterminous Albers grid.
CONUS_ALBERS = (29.5, 45.5, 23.0, -96.0)


#: Open rows that one task decides together.
CELL = 50_000
#: Pairs of rows that meet, on average, in what one task decides.
LINKS = 1_000_000


def along_curve(box: str, extent: tuple[float, float, float]) -> Column:
    """Place of a box's centre on a curve through a square (x0, y0, side) that keeps neighbours near each other: its two coordinates, bit by bit."""
    x0, y0, side = extent
    grid = lambda k, start: F.floor(((F.col(f"{box}.{k}0") + F.col(f"{box}.{k}1")) / 2 - start) / side * 32767).cast("long")
    x, y = grid("x", x0), grid("y", y0)
    bit = lambda v, k: F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1)), k)
    return reduce(operator.add, [F.shiftleft(bit(x, k), k) + F.shiftleft(bit(y, k), k + 1) for k in range(15)])


def decided(cell: pd.DataFrame) -> pd.DataFrame:
    """(pos, kept) of the rows of a cell that hang on no open row outside it, taken in order.

    Rows with lo -1 name the cell's rows, with lo -2 those that have an open neighbour
    before them outside; the others are pairs within the cell.
    """
    lo, hi = cell["lo"].to_numpy(), cell["hi"].to_numpy()
    pos, inner = np.sort(hi[lo == -1]), lo >= 0
    waits = np.isin(pos, hi[lo == -2])
    b = np.searchsorted(pos, hi[inner]).astype("int32")
    order = np.argsort(b, kind="stable")
    a, ends = np.searchsorted(pos, lo[inner]).astype("int32")[order], np.searchsorted(b[order], np.arange(len(pos) + 1))
    said = np.full(len(pos), -1, "int8")  # 1 kept, 0 not, -1 open
    for p in range(len(pos)):
        earlier = said[a[ends[p] : ends[p + 1]]]
        said[p] = 0 if (earlier == 1).any() else -1 if waits[p] or (earlier == -1).any() else 1
    known = said >= 0
    return pd.DataFrame({"pos": pos[known].astype("int64"), "kept": said[known] == 1})


def apart(rows: DataFrame, pairs: DataFrame, key: str, order: Sequence[str], folder: str, box: str | None = None, cell: int = CELL, links: int = LINKS) -> DataFrame:
    """The rows that a greedy pass keeps: each, in the given order, that meets no row kept before it.

    pairs lists the (a, b) of keys that meet, in either direction. Rows are numbered in
    their order and dealt to cells of about `cell` rows, neighbours by box together. A
    round decides in each cell all rows that hang on no open row of another cell, closes
    the neighbours of kept rows everywhere, and deals what is open anew. Once no more than
    `cell` rows are open one task decides them, so a chain of that length takes one
    round; longer ones take a round per cell that they run through in order. Where more
    than `links` pairs are open there are more and smaller cells, so that rows that meet
    many others don't fill a task. Tables of a
    round are written below folder, which the executors share, and deleted after the next.
    """
    spark = rows.sparkSession
    own = [F.col(key).alias("k"), *[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], *([F.col(box).alias("b")] if box else [])]
    names = [f"o{n}" for n in range(len(order))]
    ids = rows.select(*own).groupBy("k").agg(F.min(F.struct(*names)).alias("o"), *([F.first("b").alias("b")] if box else []))
    ids = T.ranked(ids, [], ["o", "k"], "pos", folder)
    z = F.xxhash64("k")
    if box:
        e = ids.agg(F.min("b.x0"), F.min("b.y0"), F.greatest(F.max("b.x1") - F.min("b.x0"), F.max("b.y1") - F.min("b.y0"))).first()
        if e[0] is not None:
            z = along_curve("b", (e[0], e[1], e[2] or 1.0))

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}/{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    ids = stored(ids.select("k", "pos", z.alias("z")), "rows")
    a, b = ids.select(F.col("k").alias("a"), F.col("pos").alias("pa")), ids.select(F.col("k").alias("b"), F.col("pos").alias("pb"))
    edges = stored(pairs.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("lo"), F.greatest("pa", "pb").alias("hi")).distinct(), "edges")
    met = edges.select(F.explode(F.array("lo", "hi")).alias("pos")).distinct()
    opened = stored(ids.select("pos", "z").join(met, "pos", "left_semi"), "open")
    lost: list[DataFrame] = []  # of each round
    while n := opened.count():
        parts = max(math.ceil(1.3 * n / cell) if n > cell else 1, min(n, math.ceil(edges.count() / links)))
        dealt = opened.repartitionByRange(parts, "z", "pos").withColumn("cell", F.spark_partition_id()) if parts > 1 else opened.withColumn("cell", F.lit(0))
        dealt = stored(dealt.select("pos", "cell"), "cells")
        at = lambda end, dealt=dealt: dealt.select(F.col("pos").alias(end), F.col("cell").alias(f"{end}_cell"))
        both = edges.join(at("lo"), "lo").join(at("hi"), "hi")
        inner, outer = both.where("lo_cell = hi_cell"), both.where("lo_cell <> hi_cell")
        parts = dealt.select(F.lit(-1).cast("long").alias("lo"), F.col("pos").alias("hi"), "cell")
        parts = parts.unionAll(inner.select("lo", "hi", F.col("hi_cell").alias("cell"))).unionAll(outer.select(F.lit(-2).cast("long"), "hi", "hi_cell").distinct())
        known = stored(parts.groupBy("cell").applyInPandas(decided, "pos long, kept boolean"), "known")
        closed = edges.join(known.where("kept").select(F.col("pos").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("pos"))
        lost.append(stored(closed.unionAll(known.where("not kept").select("pos")).distinct(), "closed"))
        gone = known.select("pos").unionAll(lost[-1])
        left = stored(edges.join(gone.withColumnRenamed("pos", "lo"), "lo", "left_anti").join(gone.withColumnRenamed("pos", "hi"), "hi", "left_anti"), "edges")
        still = stored(opened.join(gone, "pos", "left_anti"), "open")
        T.drop_tables(edges, opened, dealt, known)
        edges, opened = left, still
    closed = reduce(DataFrame.unionAll, lost, ids.select("pos").limit(0))
    out = ids.join(closed, "pos", "left_semi").select(F.col("k").alias(key))
    return rows.join(out, key, "left_anti")


def crosses(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Whether the segments pq and rs share a point."""
    side = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    apart_ = lambda k: (F.greatest(p[k], q[k]) < F.least(r[k], s[k])) | (F.greatest(r[k], s[k]) < F.least(p[k], q[k]))
    return (side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0) & ~apart_("x") & ~apart_("y")


def segment_distance(x: Column, y: Column, p: Column, q: Column) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    along = F.coalesce(((x - p["x"]) * dx + (y - p["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)


def ring_intersects(a: Column, b: Column) -> Column:
    """Whether two rings share a point, the inner areas included."""
    inside = lambda ring, other: S.within(F.get(ring, 0)["x"], F.get(ring, 0)["y"], other)
    meet = F.exists(S.edges(a), lambda e: F.exists(S.edges(b), lambda f: crosses(e["a"], e["b"], f["a"], f["b"])))
    return meet | inside(a, b) | inside(b, a)


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point to a ring's area; zero inside."""
    return F.when(S.within(x, y, ring), 0.0).otherwise(F.array_min(F.transform(S.edges(ring), lambda e: segment_distance(x, y, e["a"], e["b"]))))


def buffered_inside(x: Column, y: Column, ring: Column, distance: float) -> Column:
    """Whether a point lies in the ring's area widened by the distance, or narrowed by it where it is negative."""
    edge = F.array_min(F.transform(S.edges(ring), lambda e: segment_distance(x, y, e["a"], e["b"])))
    return (S.within(x, y, ring) | (edge <= distance)) if distance >= 0 else (S.within(x, y, ring) & (edge >= -distance))


def authalic(s: float, e2: float) -> float:
    e = math.sqrt(e2)
    return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def cone(grid: Sequence[float], e2: float) -> tuple[float, float, float]:
    """(n, c, q0) of an equal-area cone: its constant, the squared radius at the equator in n, the origin's authalic value."""
    sines = [math.sin(math.radians(d)) for d in grid[:3]]
    m1, m2 = [(1 - s * s) / (1 - e2 * s * s) for s in sines[:2]]  # squares of the parallels' radii
    q1, q2, q0 = [authalic(s, e2) for s in sines]
    n = (m1 - m2) / (q2 - q1) if grid[0] != grid[1] else sines[0]
    return n, m1 + n * q1, q0


def albers(lon: Column, lat: Column, grid: Sequence[float] = CONUS_ALBERS, ellipsoid: tuple[float, float] = GRS80) -> Column:
    """(x, y) of degrees in an equal-area conic projection with two standard parallels."""
    a, f = ellipsoid
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    n, c, q0 = cone(grid, e2)
    s = F.sin(F.radians(lat))
    q = (s / (1 - s * s * e2) - F.log((1 - s * e) / (1 + s * e)) / (2 * e)) * (1 - e2)
    radius = F.sqrt(F.lit(c) - q * n) * (a / n)
    angle = F.radians(lon - grid[3]) * n
    return F.struct((radius * F.sin(angle)).alias("x"), (F.lit(a * math.sqrt(c - n * q0) / n) - radius * F.cos(angle)).alias("y"))


def albers_inverse(x: Column, y: Column, grid: Sequence[float] = CONUS_ALBERS, ellipsoid: tuple[float, float] = GRS80) -> Column:
    """(lon, lat) in degrees of a point of the projection; latitudes by the series in the authalic latitude, good to 1e-8 degrees."""
    a, f = ellipsoid
    e2 = f * (2 - f)
    n, c, q0 = cone(grid, e2)
    down = F.lit(a * math.sqrt(c - n * q0) / n) - y
    q = (F.lit(c) - (x * x + down * down) * (n / a) ** 2) / n
    b = F.asin(F.greatest(F.least(q / authalic(1.0, e2), F.lit(1.0)), F.lit(-1.0)))
    terms = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
    lat = b + F.sin(b * 2) * terms[0] + F.sin(b * 4) * terms[1] + F.sin(b * 6) * terms[2]
    lon = F.atan2(x, down) / n if n > 0 else F.atan2(-x, -down) / n
    return F.struct((F.degrees(lon) + grid[3]).alias("lon"), F.degrees(lat).alias("lat"))


def class_of(code: Column, ranges: Sequence[tuple[int, int, int]], other: int) -> Column:
    """Class of a code by ranges (first, last, class); ``other`` outside of them, null for null."""
    out = F.when(code.isNotNull(), other)
    for first, last, cls in ranges:
        out = F.when(code.between(first, last), cls).otherwise(out)
    return out
