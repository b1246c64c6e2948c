"""Writers that never overwrite, skip what is there, and describe what they wrote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    rows.select(*(columns or rows.columns)).write.csv(path, header=True, mode="error")


def write_missing(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends the partitions that path lacks. Existing ones stay as they are, so that a job can be repeated.

    Rows are brought together by key, and a key with many rows is split over as many tasks as its size asks for.
    """
    try:
        there = rows.sparkSession.read.parquet(path).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
        rows = rows.alias("r").join(there.alias("t"), same, "left_anti")
    rows.hint("rebalance", *keys).write.partitionBy(*keys).parquet(path, mode="append")


def copy_new(spark: SparkSession, source: str, target: str) -> None:
    """Copies a Parquet table; fails where the target is there."""
    spark.read.parquet(source).write.parquet(target, mode="error")


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string")).write.text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON document per line; fails where the path is there."""
    rows.write.json(path, mode="error")


def property_table(rows: DataFrame, props: str) -> DataFrame:
    """A row per row with a string column for each key that any JSON map in props has, in order of name; absent ones are null.

    The keys become the schema, so their names alone reach the driver. A key that is a column already gets _1 after it.
    """
    keys = [r[0] for r in rows.select(F.explode(F.json_object_keys(props))).distinct().collect()]
    fixed = [c for c in rows.columns if c != props]
    parsed = F.from_json(props, "map<string,string>")
    return rows.select(*fixed, parsed.alias("pt_m")).select(*fixed, *[F.col("pt_m")[k].alias(k if k not in fixed else f"{k}_1") for k in sorted(keys)])


def manifest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and an order-free digest per key: 60 bits of each row's SHA-256 over its JSON, summed."""
    names = sorted(rows.columns)
    bits = F.conv(F.substring(F.sha2(F.to_json(F.struct(*names)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(bits).cast("string").alias("digest"))


def pyramid(pixels: DataFrame, x: str, y: str, value: str, factor: int = 2) -> DataFrame:
    """The most frequent value of each coarser cell, the smallest of equals; nulls don't count."""
    cell = [F.floor(F.col(c) / factor).alias(c) for c in (x, y)]
    counts = pixels.where(F.col(value).isNotNull()).groupBy(*cell, value).agg(F.count("*").alias("py_n"))
    return counts.groupBy(x, y).agg(F.max_by(value, F.struct("py_n", -F.col(value))).alias(value))


def write_uniform(rows: DataFrame, column: str, path: str) -> str | None:
    """Writes rows that must agree in a column, such as their reference system, and returns its value; fails where path is there.

    Rows are written once, into a folder beside path; that one column of it, a few bytes a
    file, is then looked through. The folder takes the name of path only if the rows
    agree; several values, or nulls among others, are an error and leave nothing behind.
    (Metrics observed while writing would do without the look, but a session that has
    observed any can no longer apply forests: their summary holds the session.)
    """
    fs, at = rows.sparkSession._jvm.org.apache.hadoop.fs, f"{path.rstrip('/')}.unchecked"
    target, beside = fs.Path(path), fs.Path(at)
    store = target.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    if store.exists(target):
        raise FileExistsError(path)
    rows.write.parquet(at, mode="overwrite")
    bare = F.count_if(F.col(column).isNull()).alias("bare")
    got = rows.sparkSession.read.schema(rows.schema).parquet(at).agg(F.min(column).alias("least"), F.max(column).alias("most"), bare, F.count("*").alias("n")).first()
    if got["least"] != got["most"] or 0 < got["bare"] < got["n"]:
        store.delete(beside, True)
        raise ValueError(f"{column} does not agree: {got['least']} and {got['most']}, {got['bare']} without one")
    store.rename(beside, target)
    return got["least"]
