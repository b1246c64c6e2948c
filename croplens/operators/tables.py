"""Training-table operators: label filters, sampling by class, joins with fallback, rank and fill windows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


#: Rows of a table that is sent to every task.
BESIDE = 100_000


def beside(rows: DataFrame, most: int = BESIDE) -> DataFrame:
    """rows, marked for a broadcast if they are few; a longer table is shuffled by the join. Counting reads at most so many rows."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def drop_tables(*tables: DataFrame) -> None:
    """Delete Parquet tables that were written for a step and are read no more."""
    for rows in tables:
        spark = rows.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over as many tasks as shuffles have, for steps that make many rows of few: small tables would be joined in one task or two."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def firsts(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, *columns): rows that are equal in the columns once, under their least key."""
    return rows.groupBy(*columns).agg(F.min(key).alias(key)).select(key, *columns)


def members(rows: DataFrame, found: DataFrame, key: str, *columns: str, name: str = "like") -> DataFrame:
    """(key, name): each key of rows with that of the row of found that is equal to it in the columns; keys without one drop out."""
    own = found.select(F.col(key).alias(name), *columns)
    return rows.select(key, *columns).join(own, [*columns]).select(key, name)


def pairs_of_members(met: DataFrame, own: DataFrame, name: str = "like") -> DataFrame:
    """(a, b), a < b: the pairs of rows behind pairs (a, b) of kinds, each of which is there in one direction; a kind that is paired with itself gives the pairs of its rows."""
    key = next(c for c in own.columns if c != name)
    side = lambda k: own.select(F.col(name).alias(k), F.col(key).alias(f"pm_{k}"))
    both = spread(met, "a", "b").join(side("a"), "a").join(side("b"), "b").where((F.col("a") != F.col("b")) | (F.col("pm_a") < F.col("pm_b")))
    return both.select(F.least("pm_a", "pm_b").alias("a"), F.greatest("pm_a", "pm_b").alias("b"))


def label_filter(rows: DataFrame, label: str = "POINT_TYPE", nd: str = "nd_max_gs") -> DataFrame:
    """Drops irrigated points that are too brown and fallow points that are too green; fallow joins class 1."""
    bad = ((F.col(label) == 0) & (F.col(nd) < 0.68)) | ((F.col(label) == 4) & (F.col(nd) > 0.6))
    return rows.where(~F.coalesce(bad, F.lit(False))).withColumn(label, F.when(F.col(label) == 4, 1).otherwise(F.col(label)))


def drop_containing(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    return rows.select(*[c for c in rows.columns if not any(p in c for p in parts)])


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, folder: str, value: str | None = None) -> DataFrame:
    """rows with their number from 1 within each group of keys, in the given order of columns; with value, the running sum of that column of longs instead.

    The table is written in ranges of (keys, order) below folder, which the executors
    share; each range is numbered alone and the counts of the ranges before it are
    added, so that a group of any size is spread over many tasks. The counts have a row
    per range and group in it; they are sent to every task only if they are few.
    """
    path, part, begin = f"{folder}/{uuid.uuid4().hex}", "tb_part", "tb_begin"
    ranges = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, *order)
    ranges.withColumn(part, F.spark_partition_id()).write.parquet(path)
    written = rows.sparkSession.read.schema(StructType([*rows.schema.fields]).add(part, IntegerType())).parquet(path)
    sizes = written.groupBy(*keys, part).agg((F.sum(value) if value else F.count("*")).alias("tb_n"))
    before = sizes.withColumn(begin, F.sum("tb_n").over(Window.partitionBy(*keys).orderBy(part)) - F.col("tb_n"))
    before = before.select(*[F.col(k).alias(f"tb_{i}") for i, k in enumerate(keys)], F.col(part).alias("tb_p"), begin)
    before.write.parquet(f"{path}-counts")
    before = rows.sparkSession.read.schema(before.schema).parquet(f"{path}-counts")
    own = Window.partitionBy(*keys, part).orderBy(*order)
    number = F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)) if value else F.row_number().over(own)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"tb_{i}")) for i, k in enumerate(keys)], F.col(part) == F.col("tb_p"))
    both = written.withColumn(name, number).join(beside(before), same).withColumn(name, (F.col(name) + F.col(begin)).cast("long"))
    return both.select(*rows.columns, name)


def by_name(rows: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """rows with the given columns first and the others in order of name."""
    return rows.select(*first, *sorted(c for c in rows.columns if c not in first))


def default_features(rows: DataFrame, labels: Sequence[str]) -> list[str]:
    """All columns but the labels, in their order."""
    return [c for c in rows.columns if c not in labels]


def years_to_rows(wide: DataFrame, keys: Sequence[str], prefixes: Sequence[str], year: str = "year") -> DataFrame:
    """A row per key and year from columns named by prefix and year, such as IM_2019: one column per prefix; years that a prefix lacks are null.

    Rows in which every value is null drop out; other columns do too.
    """
    places = {p: {int(c.removeprefix(p)): c for c in wide.columns if c.startswith(p) and c.removeprefix(p).isdigit()} for p in prefixes}
    years = sorted({y for own in places.values() for y in own})
    cell = lambda p, y: F.col(f"`{places[p][y]}`") if y in places[p] else F.lit(None)
    kinds = {p: next((wide.schema[c].dataType for c in own.values()), None) for p, own in places.items()}
    each = F.array(*[F.struct(F.lit(y).alias(year), *[(cell(p, y) if kinds[p] is None else cell(p, y).cast(kinds[p])).alias(p.rstrip("_")) for p in prefixes]) for y in years])
    long = wide.select(*keys, F.inline(each))
    return long.where(reduce(lambda a, b: a | b, [F.col(p.rstrip("_")).isNotNull() for p in prefixes]))


def add_new_columns(old: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """old with the columns that only newer has, filled where the key is in both; columns of both keep the old values.

    Of rows of newer that repeat a key one counts, that with the greatest values in order of the columns.
    """
    names = [c for c in newer.columns if c not in old.columns]
    if not names:
        return old
    own = newer.groupBy(F.col(key).alias("nc_key")).agg(F.max(F.struct(*names)).alias("nc_v"))
    both = old.join(own, F.col(key) == F.col("nc_key"), "left")
    return both.select(*[F.col(f"`{c}`") for c in old.columns], *[F.col("nc_v")[c].alias(c) for c in names])


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right side by side by key, with paired: 1 where both have the key, else 0; keys must not repeat within a side."""
    a, b = left.withColumn("al_a", F.lit(1)), right.withColumn("al_b", F.lit(1))
    return a.join(b, key, "full").withColumn("paired", F.coalesce(F.col("al_a") * F.col("al_b"), F.lit(0))).drop("al_a", "al_b")


def merged(under: Column, over: Column) -> Column:
    """A map with another one's entries set over it; null values set over nothing, null maps are empty."""
    under, over = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (under, over))
    over = F.map_filter(over, lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.map_contains_key(over, k)), over)


def ordinals(rows: DataFrame, column: str, folder: str, name: str = "ordinal") -> DataFrame:
    """(column, ordinal): the distinct values of a column in order, numbered from 0 over ranges; nulls have none.

    No task and not the driver holds the set of values.
    """
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return ranked(values, [], [column], name, folder).withColumn(name, F.col(name) - 1)


def encode(rows: DataFrame, column: str, known: DataFrame, name: str = "ordinal", unseen: int = 0) -> DataFrame:
    """rows with the ordinal of a column's value; unseen for values without one, and for nulls."""
    own = known.select(F.col(column).alias("en_v"), F.col(name).alias("en_n"))
    both = rows.join(beside(own), F.col(column) == F.col("en_v"), "left")
    return both.withColumn(name, F.coalesce("en_n", F.lit(unseen))).drop("en_v", "en_n")


def low_mean(rows: DataFrame, zone: str, value: str, share: float, folder: str, times: str | None = None) -> DataFrame:
    """(zone, trimmed, med): the mean of each zone's values up to the given percentile, and the median; nulls don't count.

    times is a column of how often a row counts, once without it; equal values of a zone are laid together first.

    Zones are numbered over ranges of (zone, value); percentiles are drawn between two
    neighbouring places, so no zone's values are held together.
    """
    once = rows.where(F.col(value).isNotNull()).groupBy(zone, value).agg((F.sum(times) if times else F.count("*")).alias("lm_c"))
    z = ranked(once, [zone], [value], "lm_k", folder, "lm_c")
    sizes = z.groupBy(F.col(zone).alias("lm_z")).agg(F.sum("lm_c").alias("lm_n"))
    at, k, v = (lambda q: (F.col("lm_n") - 1) * q + 1), F.col("lm_k"), F.col(value)
    holds = lambda place: (place > k - F.col("lm_c")) & (place <= k)
    over = lambda q: at(q) - F.floor(at(q))
    near = lambda q: F.sum(F.when(holds(F.floor(at(q))), v * (1 - over(q)))) + F.coalesce(F.sum(F.when(holds(F.floor(at(q)) + 1), v * over(q))), F.lit(0.0))
    same = F.col(zone).eqNullSafe(F.col("lm_z"))
    cuts = z.join(beside(sizes), same).groupBy("lm_z").agg(near(share).alias("lm_p"), near(0.5).alias("med"))
    low = z.join(beside(cuts), same).where(v <= F.col("lm_p") + 1e-9)
    return low.groupBy(zone).agg((F.sum(v * F.col("lm_c")) / F.sum("lm_c")).alias("trimmed"), F.any_value("med").alias("med"))


def majority(rows: DataFrame, zone: str, value: str, times: str | None = None) -> DataFrame:
    """(zone, majority, purity): the most frequent value of each zone, the smallest of equals, and its share; nulls don't count, rows as often as times says."""
    n = rows.where(F.col(value).isNotNull()).groupBy(zone, value).agg((F.sum(times) if times else F.count("*")).alias("mj_n"))
    return n.groupBy(zone).agg(F.max_by(value, F.struct("mj_n", -F.col(value))).alias("majority"), (F.max("mj_n") / F.sum("mj_n")).alias("purity"))


def first_per(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order, n being small: Spark drops rows over n before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("tb_rank", rank).where(F.col("tb_rank") <= n).drop("tb_rank")


def stratified_third(rows: DataFrame, label: str, order: Sequence[str], folder: str) -> DataFrame:
    """Class 0 whole and a third of its count of each other class; classes with fewer rows are left out.

    With fewer than six rows of class 0 the table passes as it is.
    """
    sizes = rows.groupBy(F.col(label).alias("tb_label")).agg(F.count("*").alias("tb_n"))
    zero = rows.agg(F.count_if(F.col(label) == 0).alias("tb_zero"))
    both = ranked(rows, [label], order, "tb_rank", folder).join(beside(sizes), F.col(label).eqNullSafe(F.col("tb_label"))).join(F.broadcast(zero))  # zero is one row
    third = F.floor(F.col("tb_zero") / 3)
    keep = (F.col("tb_zero") < 6) | (F.col(label) == 0) | ((F.col("tb_n") >= third) & (F.col("tb_rank") <= third))
    return both.where(keep).select(*rows.columns)


def fallback_join(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], value: str) -> DataFrame:
    """left with value of right, by the first pair of keys or else by the second; rows without either drop out.

    Of right rows that repeat a key the least value counts, so no row of left is multiplied.
    """
    a = right.groupBy(F.col(first[1]).alias("fb_a")).agg(F.min(value).alias("fb_va"))
    b = right.groupBy(F.col(second[1]).alias("fb_b")).agg(F.min(value).alias("fb_vb"))
    both = left.join(a, F.col(first[0]) == F.col("fb_a"), "left").join(b, F.col(second[0]) == F.col("fb_b"), "left")
    out = both.withColumn(value, F.coalesce("fb_va", "fb_vb")).where(F.col(value).isNotNull())
    return out.drop("fb_a", "fb_b", "fb_va", "fb_vb")


def suffixed(names: Sequence[str]) -> list[str]:
    """The names, repeats with _1, _2, ... after them in order."""
    return [n if not (k := list(names[:i]).count(n)) else f"{n}_{k}" for i, n in enumerate(names)]


def union_tables(*tables: DataFrame) -> DataFrame:
    """Union by name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def confusion(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n, consumer, producer): each cell with its share of the truth row and of the prediction column."""
    cells = rows.groupBy(truth, pred).agg(F.count("*").alias("n"))
    whole = lambda k: F.sum("n").over(Window.partitionBy(k))
    return cells.withColumns({"consumer": F.col("n") / whole(truth), "producer": F.col("n") / whole(pred)})


def calendar_fill(daily: DataFrame, key: str, day: str, value: str, start: str, stop: str) -> DataFrame:
    """One row per key and day from start to stop; gaps take the last value before, else the next one, else 0."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(stop).cast("date"))).alias(day)
    full = daily.select(key).distinct().select(key, days).join(daily, [key, day], "left")
    w = Window.partitionBy(key).orderBy(day)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return full.withColumn(value, F.coalesce(before, after, F.lit(0.0)))


def savgol_matrix(window: int = 21, order: int = 3) -> list[list[float]]:
    """Row r fits the polynomial to a window and evaluates it at place r; the middle row is the interior filter."""
    v = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return (v @ np.linalg.pinv(v)).tolist()


def savgol(series: DataFrame, key: str, day: str, value: str, window: int = 21, order: int = 3) -> DataFrame:
    """Smoothed value per row; edges are evaluated on the first and last full window, shorter series are null.

    Each row reads the one window it needs from its own series, whose length a calendar bounds.
    """
    half = window // 2
    w = Window.partitionBy(key)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(day)) - 1
    begin = F.greatest(F.least(F.col("sg_i") - half, F.col("sg_n") - window), F.lit(0))
    row = F.when(F.col("sg_n") >= window, F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in savgol_matrix(window, order)]), (F.col("sg_i") - begin + 1).cast("int")))
    near = F.collect_list(value).over(w.orderBy(day).rowsBetween(-window + 1, window - 1))
    first = F.greatest(F.col("sg_i") - window + 1, F.lit(0))  # row number of the first one collected
    dot = F.aggregate(F.zip_with(row, F.slice(F.col("sg_near"), (begin - first + 1).cast("int"), F.lit(window)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return series.withColumns({"sg_n": n, "sg_i": i, "sg_near": near}).withColumn(value, dot).drop("sg_n", "sg_i", "sg_near")


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, within: Column, box: Column) -> DataFrame:
    """Pairs (point, polygon) by an equi-join on grid cells, then the exact test.

    points has x and y; box is the polygon's bounds struct. A polygon is listed in
    each cell that its bounds touch; points outside of them, with room for rounding,
    are not tested. Points and polygons that repeat should be given once.
    """
    at = lambda v: F.floor(v / cell)
    cells = polygons.withColumn("gp_box", box)
    cells = cells.withColumn("gp_i", F.explode(F.sequence(at(F.col("gp_box.x0")), at(F.col("gp_box.x1")))))
    cells = cells.withColumn("gp_j", F.explode(F.sequence(at(F.col("gp_box.y0")), at(F.col("gp_box.y1")))))
    placed = spread(points.withColumns({"gp_i": at(F.col("x")), "gp_j": at(F.col("y"))}), "gp_i", "gp_j", "x", "y")
    room = lambda k: (F.abs(F.col(f"gp_box.{k}0")) + F.abs(F.col(f"gp_box.{k}1"))) * 1e-9
    close = lambda k: F.col(k).between(F.col(f"gp_box.{k}0") - room(k), F.col(f"gp_box.{k}1") + room(k))
    return placed.join(cells, ["gp_i", "gp_j"]).where(close("x") & close("y") & within).drop("gp_i", "gp_j", "gp_box")
