"""Readers of text folders, indexes, partitions and GeoJSON columns."""

from __future__ import annotations

from csv import reader as csv_reader
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import beside


def csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated file, or comma-separated where tabs give two columns at most."""
    rows = csv(spark, path, "\t")
    return rows if len(rows.columns) > 2 else csv(spark, path)


def lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, line, text, block, place): line counts from 0 in each file's first split, the only one that is numbered; null beyond it.

    Row ids grow by one along a split, so a line's number is its id less the file's
    smallest; (block, place) orders the lines of a file whatever its splits.
    """
    meta = F.col("_metadata")
    rows = spark.read.option("pathGlobFilter", glob).text(path).select(
        meta["file_path"].alias("file"), F.col("value").alias("text"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place")
    )
    first = rows.where("block = 0").groupBy("file").agg(F.min("place").alias("fl_first"))
    return rows.join(first, "file").select("file", F.when(F.col("block") == 0, F.col("place") - F.col("fl_first")).alias("line"), "text", "block", "place")


def narrowed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """String columns as long or double where every value of theirs is one, by one aggregate; empty strings are nulls."""
    if not columns:
        return rows
    held = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in columns}
    odd = lambda c, kind: F.count_if(held[c].isNotNull() & held[c].try_cast(kind).isNull())
    found = rows.agg(*[odd(c, kind).alias(f"{kind}{n}") for n, c in enumerate(columns) for kind in ("bigint", "double")]).first()
    to = {c: "bigint" if not found[f"bigint{n}"] else "double" if not found[f"double{n}"] else "string" for n, c in enumerate(columns)}
    return rows.select(*[held[c].cast(to[c]).alias(c) if c in to else F.col(f"`{c}`") for c in rows.columns])


def csv_folder(spark: SparkSession, folder: str, glob: str = "*.csv", in_order: bool = False) -> DataFrame:
    """Files of a folder, united by column name, with the column file_name; files without a line give no rows.

    The folder is read once: each line is taken apart by its own file's header, so the
    driver sees the different headers and no file names. A record takes one line. Columns
    become numbers where all their values are. in_order: sorted by file name, and by line within a file.
    """
    every = lines(spark, folder, glob)
    head = every.where("line = 0").select("file", F.col("text").alias("fl_head"))
    heads = sorted(r.fl_head for r in head.select("fl_head").distinct().collect())
    if not heads:
        raise FileNotFoundError(f"no file with lines in {folder} fits {glob}")
    names = {h: [n.strip() for n in next(csv_reader([h]))] for h in heads}
    wide, columns = max(map(len, names.values())), list(dict.fromkeys(n for h in heads for n in names[h]))
    rows = every.where("line is null or line > 0").join(beside(head), "file")
    cell = F.from_csv("text", ", ".join(f"c{k} string" for k in range(wide)))
    rows = rows.where(F.length("text") > 0).select("file", "fl_head", "block", "place", cell.alias("fl_c"))
    pick = lambda name: F.coalesce(*[F.when(F.col("fl_head") == h, F.col(f"fl_c.c{names[h].index(name)}")) for h in heads if name in names[h]])
    out = rows.select(*[pick(n).alias(n) for n in columns], F.element_at(F.split("file", "/"), -1).alias("file_name"), "file", "block", "place")
    out = narrowed(out, columns)
    return (out.orderBy("file_name", "file", "block", "place") if in_order else out).drop("file", "block", "place")


def dated_folder(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """csv_folder() of files named like ``source_2019.csv``: with year, and source, the name without its last five signs; files without a year give a null one and their whole name."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    year = F.regexp_extract(stem, r"_(\d{4})$", 1)
    rows = csv_folder(spark, folder, glob).withColumns({"year": F.nullif(year, F.lit("")).cast("int"), "source": F.when(year == "", stem).otherwise(F.substring(stem, F.lit(1), F.length(stem) - 5))})
    return rows.drop("file_name")


_LOOKUPS: dict[tuple[str, str], DataFrame] = {}


def lookup(spark: SparkSession, path: str) -> DataFrame:
    """A small CSV table of codes that is read once in an application and then kept, whoever asks for it."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _LOOKUPS:
        _LOOKUPS[key] = csv(spark, path).cache()
    return _LOOKUPS[key]


def csv_after(spark: SparkSession, path: str, skip: int = 4) -> DataFrame:
    """File whose header follows skip other lines; all columns are strings."""
    rows = lines(spark, path)
    head = rows.where(F.col("line") == skip).select("text").first()
    if head is None:
        raise ValueError(f"{path} has no line {skip}")
    schema = ", ".join(f"`{name.strip()}` string" for name in head.text.split(","))
    return rows.where(F.col("line").isNull() | (F.col("line") > skip)).select(F.from_csv("text", schema).alias("r")).select("r.*")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold a JSON document or a list of them each; a file has to fit a task's memory."""
    return spark.read.json(path, multiLine=True)


def positional(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Header-less file whose columns are named by place, all strings."""
    return spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in names))


def partition(spark: SparkSession, path: str, **keys: object) -> DataFrame:
    """Rows of the partitions with the given key values; others are never listed for reading."""
    return reduce(lambda rows, kv: rows.where(F.col(kv[0]) == kv[1]), keys.items(), spark.read.parquet(path))


def partitions(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Which partitions there are, by name; no data column is read."""
    return spark.read.parquet(path).select(*keys).distinct()


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, bytes, sha256) of each file; a file has to fit a task's memory."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return rows.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def geojson_ring(text: Column) -> Column:
    """Outer ring of a GeoJSON polygon as (x, y) structs; null where the coordinates are not lists."""
    ring = F.get(F.from_json(text, "coordinates array<array<array<double>>>")["coordinates"], 0)
    return F.transform(ring, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
