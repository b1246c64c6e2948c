"""Accuracy tables, label filters of series and points, deterministic shares and forest comparison."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import share_of
from . import models


def joint_counts(rows: DataFrame, keys: Sequence[str], truth: Column, pred: Column) -> DataFrame:
    """True and false positives and negatives per group, precision and recall; null where nothing was claimed or true."""
    cells = {"tp": truth & pred, "fn": truth & ~pred, "fp": ~truth & pred, "tn": ~truth & ~pred}
    out = rows.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    share = lambda miss: F.col("tp") / F.nullif(F.col("tp") + F.col(miss), F.lit(0))
    return out.withColumns({"prec": share("fp"), "rec": share("fn")})


def usable_series(rows: DataFrame, key: str, day: str, value: str, least: float = 0.05) -> DataFrame:
    """Values under ``least`` become null; leap days go, and so do series of nulls only."""
    leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    out = rows.withColumn(value, F.when(F.col(value) >= least, F.col(value))).where(~leap)
    return out.join(out.groupBy(key).agg(F.count(value).alias("us_n")).where("us_n > 0").select(key), key, "left_semi")


def complete_columns(rows: DataFrame) -> list[str]:
    """Columns without a null, by one aggregate over the table."""
    nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns]).first()
    return [c for c in rows.columns if not nulls[c]]


def absent_as_zero(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return rows.select("*", *[F.lit(0).alias(c) for c in wanted if c not in rows.columns])


def compare_forests(rows: DataFrame, features: Sequence[str], label: str, key: str, grid: Mapping[str, Sequence], folds: int = 5, top: int = 3) -> list[tuple]:
    """(rank, settings, mean accuracy) of the best combinations of depth and trees over hash-made folds; ties share a rank."""
    to = {"depth": "maxDepth", "trees": "numTrees"}
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    found, _ = models.search(rows, features, label, key, [{to[k]: v for k, v in one.items()} for one in every], folds, top=top)
    back = {v: k for k, v in to.items()}
    return sorted((rank, str({back[k]: v for k, v in one.items()}), score) for rank, one, score, _ in found)


def feature_curve(rows: DataFrame, features: Sequence[str], label: str, key: str, cls: int = 0, counts: Sequence[int] | None = None, **settings) -> list[tuple[int, str, float | None]]:
    """(features used, last one, share of the class's held-out rows found) for the first features, as many as counts says or 1 to all."""
    held = share_of(F.col(key)) < 33
    counts = counts or range(1, len(features) + 1)
    known = models.dealt(rows.select(key, label, *dict.fromkeys(features)), len(counts))

    def score(n: int) -> tuple[int, str, float | None]:
        model = models.fit_forest(known.where(~held), features[:n], label, **settings)
        out = models.classify(model, known.where(held & (F.col(label) == cls)), features[:n])
        return n, features[n - 1], out.agg(F.avg((F.col("pred") == cls).cast("double"))).first()[0]

    try:
        return models.side_by_side(known, score, counts)
    finally:
        known.unpersist()


def pair_correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, a before b, from one pass over the rows; rows with a null in any of them don't count, constant columns have a null r.

    The matrix of sums is as wide as the list of columns, whatever the number of rows.
    """
    from pyspark.ml.stat import Correlation

    known = models.assemble(rows.select(*columns).dropna(), columns).select("md_x")
    found = Correlation.corr(known, "md_x").first()[0].toArray()
    pairs = [(a, b, float(found[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    out = rows.sparkSession.createDataFrame(pairs, "a string, b string, r double")
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def splits(key: Column, shares: Mapping[str, int] = {"third": 67, "seventy": 70, "eighty": 80}) -> list[Column]:
    """Columns that say for each named split whether a row is in its training share of so many in a hundred; the shares of one key are nested."""
    return [(share_of(key) < least).alias(name) for name, least in shares.items()]
