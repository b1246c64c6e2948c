"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``; every executor can read them there, so a lost
executor costs a re-read and never a recomputed shuffle.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode with the setting empty, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = f"file://{tempfile.mkdtemp(prefix='croplens-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/croplens/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    The shuffle files that made it are released at once, which bounds the disk
    that one operator holds.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or the name with underscores after it, so that it is no column of df (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame, first: int = 42) -> Column:
    """Hash of all columns of a row, maps aside, to tell rows apart that share an id."""
    return F.xxhash64(F.lit(first), *[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"])


def drop_rows(docs: DataFrame, id_col: str, members: DataFrame, group: list[str], how: str | None = None) -> DataFrame:
    """docs with one row of each group.

    members: (id, hash, kept, *group) of every row in a group of several, hash being
    row_hash(docs). Rows that are not kept go; where several are (they share an id), the
    one with the greatest hash stays, and of rows equal in every column one. how is a join
    hint; without one Spark broadcasts a short list of rows that go and shuffles docs for a longer one.
    """
    members = materialize(members, "members")
    twice = materialize(members.where("kept").groupBy(*group).agg(F.count("*").alias("n"), F.max("hash").alias("win")).where("n > 1"), "twice")
    lost, spare = members.where("not kept").select("id", "hash"), None
    if not twice.isEmpty():
        again = members.where("kept").join(twice.drop("n"), group)
        lost = lost.unionAll(again.where("hash != win").select("id", "hash"))
        spare = materialize(again.where("hash = win").groupBy("id", "hash", *group).agg(F.count("*").alias("n")).where("n > 1").select("id", "hash"), "spare")
        if spare.isEmpty():
            spare = None
        else:
            lost = lost.unionAll(spare)
    i, h, v = (fresh(docs, x) for x in ("lost_id", "lost_hash", "lost_row"))
    same = F.col(id_col).eqNullSafe(F.col(i)) & (row_hash(docs) == F.col(h))
    named = lambda df: df.select(F.col("id").alias(i), F.col("hash").alias(h))
    lost = materialize(named(lost), "lost")
    discard(members, twice)
    kept = docs.join(lost.hint(how) if how else lost, same, "left_anti")
    if spare is None:
        return kept
    rows = docs.join(named(spare), same).groupBy(i, h).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(v))
    return kept.unionAll(rows.select(*[F.col(v).getField(c).alias(c) for c in docs.columns]))


def digest(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free hash of (u, v), to see whether two edge tables are equal."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the component's least node.

    Alternates large-star and small-star steps, O(log n) rounds as a rule. Each
    step reads written tables, so both join inputs are plain exchanges and AQE
    can split a hub's neighbours over many tasks. Null ends and loops are
    ignored; an empty input gives an empty result.
    """
    u, v = F.col("u"), F.col("v")
    cur = materialize(
        edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges"
    )
    seen = digest(cur)
    while seen[0]:
        both = cur.unionAll(cur.select(v.alias("u"), u.alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        after = materialize(
            large.join(small, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
            .unionAll(small.select("u", F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
        now = digest(after)
        discard(cur, least, large, small)
        cur = after
        if now == seen:
            break
        seen = now
    return cur.select(u.alias("node"), v.alias("root")).unionAll(cur.select(v.alias("node"), v.alias("root")).distinct())
