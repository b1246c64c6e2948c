"""Column functions: spectral indices, masks, keys, year schedules and planar rings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit factors.
SQ_M_PER_ACRE = 4046.86
ACRES_PER_SQ_KM = 247.105
#: Scale and offset of optical and thermal counts.
OPTICAL = (2.75e-5, -0.2)
THERMAL = (0.00341802, 149.0)
#: Fixed value: quality bits 1 to 5, any of which masks a pixel.
QA_BITS = 62


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where either is negative or both are zero."""
    return F.when((a >= 0) & (b >= 0), ratio(a - b, a + b))


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return ratio(nir - red, nir + red * 6.0 - blue * 7.5 + 1.0) * 2.5


def rescale(count: Column, kind: tuple[float, float]) -> Column:
    return count * kind[0] + kind[1]


def clear(qa: Column, saturation: Column | None = None) -> Column:
    """Whether no quality bit and no saturation masks the pixel."""
    ok = qa.bitwiseAND(QA_BITS) == 0
    return ok if saturation is None else ok & (saturation <= 0)


def row_sum(*cols: Column) -> Column:
    """Sum over the columns that are not null; null where all are."""
    return F.when(F.coalesce(*cols).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols]))


def ramp(year: Column, before: int, switch: int, horizon: int) -> Column:
    """``before`` until the switch year, then the years that are left to the horizon, never below zero."""
    return F.when(year < switch, before).otherwise(F.greatest(horizon - year - 1, F.lit(0)))


def schedule(year: Column, bounds: Sequence[tuple[int, str]], last: str) -> Column:
    """The first entry whose bound lies above the year, else the last one."""
    return reduce(lambda out, b: F.when(year < b[0], b[1]).otherwise(out), sorted(bounds, reverse=True), F.lit(last))


def number_or_null(text: Column) -> Column:
    """Thousands separators are dropped; suppressed values, marked by a D, are null."""
    return F.when(~text.contains("D"), F.regexp_replace(text, ",", "").try_cast("double"))


def county_key(state: Column, county: Column) -> Column:
    return F.concat(F.lpad(state.cast("string"), 2, "0"), F.lpad(county.cast("string"), 3, "0"))


def edges(ring: Column) -> Column:
    """Pairs of neighbouring points; the ring is closed if it isn't."""
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of (x, y) points."""
    cross = F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def centroid(ring: Column) -> Column:
    """Centre of mass as an (x, y) struct; null for rings without area."""

    def moment(k: str) -> Column:
        cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
        both = F.transform(edges(ring), lambda e: F.struct(((e["a"][k] + e["b"][k]) * cross(e)).alias("m"), cross(e).alias("c")))
        total = lambda f: F.aggregate(F.transform(both, lambda v: v[f]), F.lit(0.0), lambda s, v: s + v)
        return ratio(total("m"), total("c") * 3)

    return F.struct(moment("x").alias("x"), moment("y").alias("y"))


def ring_length(ring: Column) -> Column:
    far = F.transform(edges(ring), lambda e: F.hypot(e["a"]["x"] - e["b"]["x"], e["a"]["y"] - e["b"]["y"]))
    return F.aggregate(far, F.lit(0.0), lambda s, c: s + c)


def compactness(ring: Column) -> Column:
    return ratio(ring_area(ring) * 4 * math.pi, ring_length(ring) * ring_length(ring))


def bounds(ring: Column) -> Column:
    pick = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return F.struct(
        pick(F.array_min, "x").alias("x0"), pick(F.array_min, "y").alias("y0"), pick(F.array_max, "x").alias("x1"), pick(F.array_max, "y").alias("y1")
    )


def within(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting; points on an edge count by the half-open rule."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < ratio((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def rectangle(x0: Column, y0: Column, w: Column, h: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x0 + w, y0), point(x0 + w, y0 + h), point(x0, y0 + h))


def share_of(key: Column, parts: int = 100, salt: str = "") -> Column:
    """A number under ``parts`` fixed by a hash of the key: the same row falls in the same share in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % parts
