"""Forests, their search by cross-validation, predictions with their certainty, variable importance and principal components with MLlib."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.scalar import share_of

#: The deepest trees that the library grows; they stand for trees without a limit.
DEEPEST = 30
#: Rows that a fit gives to a task. Every task of a fit holds and sends the sums of all nodes that are split at a time, however few its rows are.
TASK_ROWS = 60_000
#: Fits that run side by side: ten take two even turns. The driver holds the trees of each, so they are not more.
FITS = 5
#: The grid that is searched whole, and the ranges that random settings are drawn from.
GRID = {"maxDepth": (3, DEEPEST), "features": (1, 3, 10), "split": (2, 3, 10), "bootstrap": (True, False), "impurity": ("gini", "entropy")}
RANGES = {"maxDepth": (3, DEEPEST), "features": range(1, 11), "split": range(2, 11), "bootstrap": (True, False), "impurity": ("gini", "entropy")}


def usable(rows: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted features that the table has, in order."""
    return [c for c in wanted if c in rows.columns]


def assemble(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=usable(rows, features), outputCol="md_x", handleInvalid="skip").transform(rows)


def dealt(rows: DataFrame, fits: int | None = None) -> DataFrame:
    """rows, cached, over as many tasks as a fit needs, up to one a core: as they are read, a file's row group of a million rows is one task.

    Where several fits run side by side each has its share of the cores at least, however
    few the rows: as many tasks as hold rows also look for the best splits of all nodes.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    share = -(-cores // min(fits, FITS)) if fits else 1
    tasks = min(max(-(-rows.count() // TASK_ROWS), share), cores)
    return (rows.repartition(tasks) if tasks > 1 else rows.coalesce(1)).cache()


def side_by_side(rows: DataFrame, job: Callable[[Any], Any], items: Iterable[Any]) -> list[Any]:
    """The job's results for the items in their order, a few at a time as jobs of their own over the same rows."""
    with ThreadPool(FITS) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(job), items, chunksize=1)


def train_forest(rows: DataFrame, features: Sequence[str], label: str, **settings):
    """A forest of the rows; they are read and dealt out once for it."""
    known = dealt(rows.select(*usable(rows, features), label))
    try:
        return fit_forest(known, features, label, **settings)
    finally:
        known.unpersist()


def fit_forest(rows: DataFrame, features: Sequence[str], label: str, trees: int = 150, bag: float = 0.5, depth: int = 10, seed: int = 1):
    """A forest of rows that have been dealt out."""
    forest = RandomForestClassifier(
        featuresCol="md_x", labelCol=label, predictionCol="pred", numTrees=trees, minInstancesPerNode=1, subsamplingRate=bag, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed
    )
    return forest.fit(assemble(rows, features))


def grid_settings(grid: Mapping[str, Sequence] = GRID) -> list[dict[str, Any]]:
    """Every combination of the grid's values: 72 by default."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def random_settings(n: int = 20, seed: int = 0, ranges: Mapping[str, Sequence] = RANGES) -> list[dict[str, Any]]:
    """n different draws from the ranges, the same for the same seed."""
    rng, out = random.Random(seed), []
    room = 1
    for values in ranges.values():
        room *= len(values)
    while len(out) < min(n, room):
        one = {name: rng.choice(values) for name, values in ranges.items()}
        if one not in out:
            out.append(one)
    return out


def search(
    rows: DataFrame, features: Sequence[str], label: str, key: str, settings: Sequence[Mapping[str, Any]], folds: int = 5, trees: int = 100, top: int = 3, parallelism: int = 4, budget: int | None = None, seed: int = 1
) -> tuple[list[tuple[int, dict[str, Any], float, float]], CrossValidatorModel]:
    """(rank, setting, mean accuracy, its deviation over the folds) of the best settings, equal means sharing a rank, and the model of the best one.

    Rows fall into folds by a hash of their key. A setting may name maxDepth, features
    (tried at each node), split (the least rows of a node that is split: here half as many
    in each of its children), bootstrap, impurity and numTrees. budget bounds the
    number of fits; settings beyond it are left out from the end, so a search can be
    taken up again with the rest. Fits run side by side as jobs of their own.
    """
    if budget is not None:
        settings = settings[: budget // folds]
    if not settings:
        raise ValueError("no setting within the budget")
    forest = RandomForestClassifier(featuresCol="md_x", labelCol=label, predictionCol="pred", numTrees=trees, seed=seed)
    param = {"maxDepth": (forest.maxDepth, int), "features": (forest.featureSubsetStrategy, str), "split": (forest.minInstancesPerNode, lambda v: -(-v // 2)), "bootstrap": (forest.bootstrap, bool), "impurity": (forest.impurity, str), "numTrees": (forest.numTrees, int)}
    maps = [{param[name][0]: param[name][1](value) for name, value in one.items()} for one in settings]
    score = MulticlassClassificationEvaluator(labelCol=label, predictionCol="pred", metricName="accuracy")
    over = CrossValidator(estimator=forest, estimatorParamMaps=maps, evaluator=score, numFolds=folds, foldCol="md_fold", parallelism=parallelism)
    known = assemble(rows, features).select("md_x", label, share_of(F.col(key), folds).cast("int").alias("md_fold")).cache()
    try:
        model = over.fit(known)
    finally:
        known.unpersist()
    means = [round(float(m), 12) for m in model.avgMetrics]
    found = [(1 + sum(other > mean for other in means), dict(one), mean, float(deviation)) for one, mean, deviation in zip(settings, means, model.stdMetrics)]
    return sorted((f for f in found if f[0] <= top), key=lambda f: (f[0], str(f[1]))), model


def holdout(rows: DataFrame, features: Sequence[str], label: str, key: str, share: int = 70, **settings) -> tuple[DataFrame, DataFrame]:
    """The rows outside a share of the table that a forest learns from, with its predictions, and those of them that it has wrong."""
    held = share_of(F.col(key)) >= share
    out = classify(train_forest(rows.where(~held), features, label, **settings), rows.where(held), features)
    return out, out.where(F.col("pred") != F.col(label))


def out_of_fold(rows: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 2, **settings) -> DataFrame:
    """Every row with fold and pred, the class given by a forest of the other folds; folds are shares of a hash of the key and leave no row out."""
    fold = share_of(F.col(key), folds)
    parts = [classify(train_forest(rows.where(fold != k), features, label, **settings), rows.where(fold == k), features).withColumn("fold", F.lit(k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def infer(model, rows: DataFrame, features: Sequence[str], label: str, classes: int = 4, least: float = 0.6) -> DataFrame:
    """rows with pred, prob (that of the class given), static and uncertain.

    static says that class and label agree; with two classes every label over 0 counts as
    1 first. Points that changed or whose class has a probability under `least` are
    uncertain. Rows with a null feature drop out; a null label is not static.
    """
    out = model.transform(assemble(rows, features)).withColumn("prob", F.array_max(vector_to_array("probability")))
    own = F.when(F.col(label) > 0, 1).otherwise(F.col(label)) if classes == 2 else F.col(label)
    static = F.coalesce((own == F.col("pred")).cast("int"), F.lit(0))
    out = out.withColumns({"pred": F.col("pred").cast("int"), "static": static, "uncertain": ((static == 0) | (F.col("prob") < least)).cast("int")})
    return out.drop("md_x", "rawPrediction", "probability")


def classify(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    out = model.transform(assemble(rows, features))
    return out.drop("md_x", "rawPrediction", "probability")


def tree_texts(model) -> list[tuple[int, int, int, str]]:
    """(tree, depth, nodes, text) of each tree of a forest; the model bounds their size."""
    return [(n, tree.depth, tree.numNodes, tree.toDebugString) for n, tree in enumerate(model.trees)]


def importance(rows: DataFrame, features: Sequence[str], label: str, fits: int = 10, top: int = 50, **kw) -> list[tuple[str, float]]:
    """Importances summed over fits on random 67 % shares, largest first."""
    total = dict.fromkeys(usable(rows, features), 0.0)
    known = dealt(rows.select(*total, label), fits)
    fit = lambda n: fit_forest(known.sample(0.67, seed=n), features, label, seed=n, **kw).featureImportances.toArray().tolist()
    try:
        found = side_by_side(known, fit, range(fits))
    finally:
        known.unpersist()
    for weights in found:
        for name, weight in zip(total, weights):
            total[name] += weight
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))[:top]


def explained_variance(rows: DataFrame, features: Sequence[str], k: int) -> list[float]:
    """Share of the variance of the first k components."""
    return PCA(k=k, inputCol="md_x", outputCol="md_pc").fit(assemble(rows, features)).explainedVariance.toArray().tolist()


def from_vectors(rows: DataFrame, array: str, size: int) -> DataFrame:
    """The array's elements as columns f0, f1, ..."""
    return rows.select("*", *[F.get(array, i).cast("double").alias(f"f{i}") for i in range(size)])


