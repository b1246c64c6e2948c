"""Polygons of several rings: parts and holes, by even-odd containment, their validity, and their rows of grid cells.

A shape is an array of rings, a ring an array of (x, y), closed or not. A point is
inside where a ray from it crosses the rings an odd number of times. Grids are
(x0, y0, step): the cell (i, j) has its centre at x0 + (i + 0.5) step, y0 + (j + 0.5) step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import grids as G
from . import polygons as P
from . import tables as T

Grid = tuple[float, float, float]
#: Cells of a row that share a join key.
BLOCK = 256


def contains(x: Column, y: Column, shape: Column) -> Column:
    """Whether a point lies inside; points on an edge count by the half-open rule."""
    return F.size(F.filter(shape, lambda ring: S.within(x, y, ring))) % 2 == 1


def area(shape: Column) -> Column:
    """Area by even-odd containment: rings at an odd depth are holes."""

    def signed(ring: Column, k: Column) -> Column:
        around = F.filter(shape, lambda other, n: (n != k) & S.within(F.get(ring, 0)["x"], F.get(ring, 0)["y"], other))
        return F.when(F.size(around) % 2 == 0, S.ring_area(ring)).otherwise(-S.ring_area(ring))

    return F.aggregate(F.transform(shape, signed), F.lit(0.0), lambda total, a: total + a)


def intersects(a: Column, b: Column) -> Column:
    """Whether two shapes share a point; one that lies in a hole of the other does not."""
    first = lambda ring, other: contains(F.get(ring, 0)["x"], F.get(ring, 0)["y"], other)
    flat = lambda shape: F.flatten(F.transform(shape, S.edges))
    meet = F.exists(flat(a), lambda e: F.exists(flat(b), lambda f: P.crosses(e["a"], e["b"], f["a"], f["b"])))
    return meet | F.exists(a, lambda ring: first(ring, b)) | F.exists(b, lambda ring: first(ring, a))


def near(shapes: DataFrame, key: str, shape: str, cell: float) -> DataFrame:
    """(a, b), a < b: keys of shapes whose boxes touch."""
    z = shapes.select(key, bounds(F.col(shape)).alias("sh_box"))
    return G.box_pairs(z, z, key, "sh_box", cell).where("a < b")


def meeting(pairs: DataFrame, shapes: DataFrame, key: str, shape: str) -> DataFrame:
    """The pairs (a, b) of keys whose shapes share a point, as intersects() says; pairs are read twice, so they should be stored.

    Edges are laid out as rows, those outside the other shape's box dropped; only pairs
    without crossing edges are asked whether one shape holds a corner of the other.
    """
    flat = F.flatten(F.transform(shape, S.edges))
    z = shapes.select(F.col(key).alias("sh_k"), flat.alias("sh_e"), bounds(F.col(shape)).alias("sh_b"), F.col(shape).alias("sh_s"))
    side = lambda n, *cols: z.select(F.col("sh_k").alias(n), *[F.col(c).alias(f"{c}{n}") for c in cols])
    both = T.spread(pairs, "a", "b").join(side("a", "sh_e"), "a").join(side("b", "sh_e", "sh_b"), "b")
    p, q, box = F.col("e.a"), F.col("e.b"), F.col("sh_bb")
    reach = lambda k: (F.least(p[k], q[k]) <= box[f"{k}1"]) & (F.greatest(p[k], q[k]) >= box[f"{k}0"])
    ahead = both.select("a", "b", "sh_eb", "sh_bb", F.explode("sh_ea").alias("e")).where(reach("x") & reach("y")).select("a", "b", "sh_eb", "e")
    crossed = ahead.select("a", "b", "e", F.explode("sh_eb").alias("f")).where(P.crosses(p, q, F.col("f.a"), F.col("f.b"))).select("a", "b").distinct()
    rest = pairs.join(crossed, ["a", "b"], "left_anti")
    held = T.spread(rest, "a", "b").join(side("a", "sh_s", "sh_b"), "a").join(side("b", "sh_s", "sh_b"), "b")
    return crossed.unionAll(held.where(_holds("sh_sa", "sh_sb", "sh_bb") | _holds("sh_sb", "sh_sa", "sh_ba")).select("a", "b"))


def _holds(inner: str, outer: str, box: str) -> Column:
    """Whether a first corner of inner's rings lies in outer, which no line of points above or below its box does."""

    def one(ring: Column) -> Column:
        x, y = F.get(ring, 0)["x"], F.get(ring, 0)["y"]
        return (y >= F.col(box)["y0"]) & (y < F.col(box)["y1"]) & contains(x, y, F.col(outer))

    return F.exists(inner, one)


def buffered(x: Column, y: Column, shape: Column, distance: float) -> Column:
    """Whether a point lies in the shape widened by the distance, or narrowed by it where it is negative; edges of holes count like outer ones."""
    edge = F.array_min(F.transform(F.flatten(F.transform(shape, S.edges)), lambda e: P.segment_distance(x, y, e["a"], e["b"])))
    return (contains(x, y, shape) | (edge <= distance)) if distance >= 0 else (contains(x, y, shape) & (edge >= -distance))


def bounds(shape: Column) -> Column:
    return S.bounds(F.flatten(shape))


def edge_rows(shapes: DataFrame, key: str, shape: str, *more: str) -> DataFrame:
    """(key, r, n, e, a, b, *more): edge e of the n of ring r, without those of no length."""
    rings = shapes.select(key, *more, F.posexplode(shape).alias("r", "ring"))
    rings = rings.withColumn("ring", F.filter(S.edges(F.col("ring")), lambda e: e["a"] != e["b"]))
    return rings.select(key, *more, "r", F.size("ring").alias("n"), F.posexplode("ring").alias("e", "s")).select(key, *more, "r", "n", "e", F.col("s.a").alias("a"), F.col("s.b").alias("b"))


def faulty(shapes: DataFrame, key: str, shape: str) -> DataFrame:
    """Keys of shapes that are no polygons: without rings, a ring of under three edges or folded back, or edges that cross or touch within a ring, or cross between rings.

    Each shape's height is cut into as many bands as the root of its edges; edges meet in
    the bands they reach, so a shape of many edges is spread over many keys.
    """
    sides = shapes.select(key, shape, F.size(F.flatten(shape)).alias("sh_m"), bounds(F.col(shape)).alias("sh_b"))
    tall = (F.col("sh_b.y1") - F.col("sh_b.y0")) / F.ceil(F.sqrt("sh_m"))
    edges = edge_rows(sides.withColumns({"sh_h": F.when(tall > 0, tall).otherwise(1.0), "sh_y": F.col("sh_b.y0")}), key, shape, "sh_h", "sh_y")
    band = lambda f: F.floor((f(F.col("a.y"), F.col("b.y")) - F.col("sh_y")) / F.col("sh_h"))
    placed = edges.withColumn("band", F.explode(F.sequence(band(F.least), band(F.greatest)))).select(key, "band", "r", "n", "e", "a", "b")
    other = placed.select(key, "band", *[F.col(c).alias(f"o_{c}") for c in ("r", "e", "a", "b")])
    a, b, c, d = (F.col(x) for x in ("a", "b", "o_a", "o_b"))
    near = (F.least(a["x"], b["x"]) <= F.greatest(c["x"], d["x"])) & (F.least(c["x"], d["x"]) <= F.greatest(a["x"], b["x"]))
    pairs = placed.join(other, [key, "band"]).where(((F.col("r") < F.col("o_r")) | ((F.col("r") == F.col("o_r")) & (F.col("e") < F.col("o_e")))) & near)
    side = lambda p, q, s: (q["x"] - p["x"]) * (s["y"] - p["y"]) - (q["y"] - p["y"]) * (s["x"] - p["x"])
    through = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
    apart = F.col("o_e") - F.col("e")
    ahead = (b["x"] - a["x"]) * (d["x"] - c["x"]) + (b["y"] - a["y"]) * (d["y"] - c["y"])
    folded = (F.when(apart == 1, side(a, b, d)).otherwise(side(c, d, b)) == 0) & (ahead < 0)
    next_to = (apart == 1) | (apart == F.col("n") - 1)
    wrong = pairs.where(F.when(F.col("r") != F.col("o_r"), through).when(next_to, folded).otherwise(P.crosses(a, b, c, d)))
    short = edges.where("n < 3").select(key)
    whole = F.coalesce(F.size(shape), F.lit(0)) == F.size(F.filter(F.coalesce(shape, F.array()), lambda ring: F.size(ring) >= 3))
    bare = shapes.where(~whole | (F.coalesce(F.size(shape), F.lit(0)) < 1)).select(key)
    return wrong.select(key).unionAll(short).unionAll(bare).distinct()


def valid(shapes: DataFrame, key: str, shape: str) -> DataFrame:
    """The shapes that are polygons; null and empty ones are not."""
    return shapes.join(faulty(shapes, key, shape), key, "left_anti")


def _place(v: Column, start: float, step: float) -> Column:
    """Number of the first cell whose centre is not below v."""
    g = F.ceil((v - start) / step - 0.5)
    at = lambda k: F.lit(start) + (k + 0.5) * step
    return F.when(at(g - 1) >= v, g - 1).when(at(g) < v, g + 1).otherwise(g)


def scan_lines(shapes: DataFrame, key: str, shape: str, grid: Grid) -> DataFrame:
    """(key, j, i0, i1): the runs of cells of each grid line whose centres lie inside, the same cells as contains() finds.

    A line's crossings with the edges, in order, begin and end its runs by turns, so
    no cell is tested against an edge. A group holds one shape's crossings of one line.
    """
    x0, y0, step = grid
    e = edge_rows(shapes, key, shape)
    a, b = F.col("a"), F.col("b")
    e = e.withColumns({"j0": _place(F.least(a["y"], b["y"]), y0, step), "j1": _place(F.greatest(a["y"], b["y"]), y0, step) - 1}).where("j0 <= j1")
    e = e.withColumn("j", F.explode(F.sequence("j0", "j1")))
    y = F.lit(y0) + (F.col("j") + 0.5) * step
    crossed = e.select(key, "j", ((b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).alias("x"))
    lines = crossed.groupBy(key, "j").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    k = lines.select(key, "j", "xs", F.explode(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1)).alias("k"))
    runs = k.select(key, "j", _place(F.get("xs", F.col("k") * 2), x0, step).alias("i0"), (_place(F.get("xs", F.col("k") * 2 + 1), x0, step) - 1).alias("i1"))
    return runs.where("i0 <= i1")


def burn(runs: DataFrame, key: str) -> DataFrame:
    """(key, i, j): a row for each cell of the runs."""
    return runs.select(key, F.explode(F.sequence("i0", "i1")).alias("i"), "j")


def covered(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """cells (i, j, ...) with the key of each run that covers them, in a row each.

    Runs meet cells by line and block of BLOCK cells, so a shape of any size is spread
    over many keys. Cells that no run covers drop out.
    """
    at = lambda c: F.floor(F.col(c) / BLOCK)
    blocks = runs.withColumn("sh_i", F.explode(F.sequence(at("i0"), at("i1"))))
    both = cells.withColumn("sh_i", at("i")).join(blocks, ["j", "sh_i"]).where(F.col("i").between(F.col("i0"), F.col("i1")))
    return both.drop("sh_i", "i0", "i1")


def clip(cells: DataFrame, shapes: DataFrame, key: str, shape: str, grid: Grid) -> DataFrame:
    """The cells (i, j, ...) that any shape covers, with all their columns, each once."""
    at = lambda c: F.floor(F.col(c) / BLOCK)
    blocks = scan_lines(T.firsts(shapes, key, shape), key, shape, grid).select(F.col("j").alias("sh_j"), "i0", "i1", F.explode(F.sequence(at("i0"), at("i1"))).alias("sh_i"))
    return cells.join(blocks, (F.col("j") == F.col("sh_j")) & (at("i") == F.col("sh_i")) & F.col("i").between(F.col("i0"), F.col("i1")), "left_semi")


def paint(cells: DataFrame, shapes: DataFrame, key: str, shape: str, grid: Grid, value: Column, name: str = "painted") -> DataFrame:
    """cells (i, j, ...) with the greatest value of the shapes that cover them in a column of the name, 0 where none does; one row per cell."""
    own = T.firsts(shapes.select(key, shape, value.alias("sh_v")), key, shape, "sh_v")
    runs = scan_lines(own.select(F.struct(key, "sh_v").alias("sh_k"), shape), "sh_k", shape, grid)
    places = covered(cells.select("i", "j").distinct(), runs).groupBy("i", "j").agg(F.max("sh_k.sh_v").alias(name))
    return cells.join(places, ["i", "j"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
