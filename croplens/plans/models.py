"""Model queries over the embedding stack; a forest's trees have no SQL form, so rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accuracy as A
from ..operators import models as M
from ..operators import tables as T
from .registry import query, table

FEATURES = [f"f{i}" for i in range(64)]


def vectors(spark, sf_dir):
    return M.from_vectors(table(spark, sf_dir, "embeddings"), "embedding", 64).drop("embedding")


@query()
def rf_train_predict(spark, sf_dir):
    """Forest of two thirds of the rows, applied to the others."""
    rows = vectors(spark, sf_dir)
    model = M.train_forest(rows.where("vec_id % 3 != 0"), FEATURES, "label", trees=150)
    return M.classify(model, rows.where("vec_id % 3 = 0"), FEATURES).select("vec_id", "label", F.col("pred").cast("int").alias("pred"))


@query()
def rf_wide_bags(spark, sf_dir):
    """The same forest with four fifths of the rows in each tree's bag."""
    rows = vectors(spark, sf_dir)
    model = M.train_forest(rows.where("vec_id % 3 != 0"), FEATURES, "label", trees=150, bag=0.8)
    return M.classify(model, rows.where("vec_id % 3 = 0"), FEATURES).select("vec_id", "label", F.col("pred").cast("int").alias("pred"))


@query()
def inferred_points(spark, sf_dir):
    """Every point's class from a forest of the even ones, with its certainty, and whether it kept its label."""
    rows = vectors(spark, sf_dir)
    model = M.train_forest(rows.where("vec_id % 2 = 0"), FEATURES, "label", trees=150)
    return M.infer(model, rows, FEATURES, "label").select("vec_id", "label", "pred", F.round("prob", 6).alias("prob"), "static", "uncertain")


@query()
def holdout_errors(spark, sf_dir):
    """The points of a third of the table that a forest of the rest has wrong."""
    _, wrong = M.holdout(vectors(spark, sf_dir), FEATURES, "label", "vec_id", trees=50)
    return wrong.select("vec_id", "label", F.col("pred").cast("int").alias("pred"))


@query()
def forest_trees(spark, sf_dir):
    """The trees of a forest of all rows, written out as conditions."""
    found = M.tree_texts(M.train_forest(vectors(spark, sf_dir), FEATURES, "label"))
    return spark.createDataFrame(found, "tree int, depth int, nodes int, conditions string")


@query()
def forest_importance(spark, sf_dir):
    """Importances of all features, summed over ten fits on two thirds of the rows, the greatest 50."""
    found = M.importance(vectors(spark, sf_dir), FEATURES, "label")
    return spark.createDataFrame(found, "feature string, weight double")


@query("""WITH v AS (SELECT vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS t(i))
SELECT 'f' || a.i AS a, 'f' || b.i AS b, round(corr(a.x, b.x), 8) AS r FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i""")
def all_pair_correlations(spark, sf_dir):
    """Every pair of the 64 features, from one pass."""
    return A.pair_correlations(vectors(spark, sf_dir), FEATURES).withColumn("r", F.round("r", 8))


@query("""WITH v AS (SELECT label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS t(i)),
c AS (SELECT i, label, count(*) AS n, avg(x) AS m FROM v GROUP BY i, label), g AS (SELECT i, avg(x) AS m, var_pop(x) AS s FROM v GROUP BY i)
SELECT 'f' || i AS feature, round(sum(n * (c.m - g.m) * (c.m - g.m)) / sum(n) / any_value(s), 8) AS weight FROM c JOIN g USING (i) GROUP BY i ORDER BY weight DESC, feature LIMIT 50""")
def separating_features(spark, sf_dir):
    """The 50 features whose class means lie furthest apart: the share of a feature's variance between the classes."""
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.transform("embedding", lambda v: v.cast("double"))).alias("i", "x"))
    c = x.groupBy("i", "label").agg(F.count("*").alias("n"), F.avg("x").alias("m"))
    g = x.groupBy("i").agg(F.avg("x").alias("all"), F.var_pop("x").alias("s"))
    apart = F.sum(F.col("n") * F.pow(F.col("m") - F.col("all"), 2)) / F.sum("n") / F.any_value("s")
    found = c.join(g, "i").groupBy(F.concat(F.lit("f"), F.col("i")).alias("feature")).agg(F.round(apart, 8).alias("weight"))
    return found.orderBy(F.desc("weight"), "feature").limit(50)


@query()
def fold_confusion(spark, sf_dir):
    """Labels against the classes that a forest of the other fold gives, over two folds."""
    out = M.out_of_fold(vectors(spark, sf_dir), FEATURES, "label", "vec_id", folds=2, trees=50)
    return T.confusion(out.withColumn("pred", F.col("pred").cast("int")), "label", "pred")


@query()
def pca(spark, sf_dir):
    shares = M.explained_variance(vectors(spark, sf_dir), FEATURES, 10)
    return spark.createDataFrame(list(enumerate(shares)), "component int, share double")
