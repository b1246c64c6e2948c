"""Catalogs of assets as a table: a folder tree of JSON descriptions, listed page by page by the tasks that read it.

``spark.read.format("catalog")`` takes the root as path, and as options page (children
of the root in a task) and suffix. Folders are walked by the tasks; the driver sees
the names of the root's own children only. A description that can't be read gives a
row with its error and does not stop the listing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import sinks

SCHEMA = "asset_id string, name string, state string, year int, sizeBytes long, updateTime string, properties string, error string"
STATE_YEAR = re.compile(r"([A-Z]{2})_(\d{4})$")


@dataclass
class Page(InputPartition):
    names: list[str]


def state_year(name: str) -> tuple[str | None, int | None]:
    """State and year at the end of the last part of a name, None without them."""
    found = STATE_YEAR.search(name.rstrip("/").split("/")[-1])
    return (found[1], int(found[2])) if found else (None, None)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("a catalog needs a path")
        self.root, self.page, self.suffix = options["path"], int(options.get("page", 100)), options.get("suffix", ".json")

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, top = self.store()
        names = sorted(f.path for f in files.get_file_info(fs.FileSelector(top)))
        return [Page(names[at : at + self.page]) for at in range(0, len(names), self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        from pyarrow import fs

        files, top = self.store()
        for name in partition.names:
            info = files.get_file_info(name)
            found = files.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else [info]
            for f in sorted(found, key=lambda f: f.path):
                if f.type == fs.FileType.File and f.path.endswith(self.suffix):
                    yield self.row(files, top, f.path)

    def row(self, files, top: str, path: str) -> tuple:
        own = path.removeprefix(top.rstrip("/") + "/").removesuffix(self.suffix)
        try:
            with files.open_input_stream(path) as stream:
                said = json.loads(stream.read())
            name = str(said.get("name") or own)
            props = said.get("properties") or {}
            props = json.dumps({k: v if isinstance(v, str) else json.dumps(v) for k, v in props.items() if v is not None}, sort_keys=True)
            size = said.get("sizeBytes")
            return (str(said.get("id") or own), name, *state_year(name), None if size is None else int(size), said.get("updateTime"), props, None)
        except (OSError, ValueError, TypeError, AttributeError) as e:
            return (own, None, *state_year(own), None, None, None, f"{type(e).__name__}: {e}"[:200])


class Catalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def assets(spark: SparkSession, path: str, page: int = 100) -> DataFrame:
    """A row per asset below path; ids and names are given without the path."""
    spark.dataSource.register(Catalog)
    return spark.read.format("catalog").option("page", page).load(path)


def harvest(spark: SparkSession, path: str, page: int = 100) -> DataFrame:
    """assets() with a column per property, in order of state and year, nulls last."""
    table = sinks.property_table(assets(spark, path, page), "properties")
    first = ["asset_id", "name", "state", "year", "sizeBytes", "updateTime"]
    return table.select(*first, *[c for c in table.columns if c not in (*first, "error")], "error").orderBy(F.asc_nulls_last("state"), F.asc_nulls_last("year"), "asset_id")


def summary(listed: DataFrame) -> DataFrame:
    """(state, n, first, last, missing, failed): assets of each state, its years, how many years between them have none, and unread descriptions."""
    n, years = F.count("*").alias("n"), F.count_distinct("year")
    gap = F.max("year") - F.min("year") + 1 - years
    return listed.groupBy("state").agg(n, F.min("year").alias("first"), F.max("year").alias("last"), gap.cast("int").alias("missing"), F.count("error").alias("failed"))


def missing_properties(listed: DataFrame) -> DataFrame:
    """(state, property, n): how many assets of a state lack a property that some asset of the catalog has; nothing for those that all have."""
    has = listed.select("state", F.explode_outer(F.json_object_keys("properties")).alias("property"))
    held = has.where("property is not null").groupBy("state", "property").agg(F.count("*").alias("held"))
    every = listed.groupBy("state").agg(F.count("*").alias("all")).join(F.broadcast(held.select("property").distinct()))  # property names become columns elsewhere: they are few
    both = every.alias("e").join(held.alias("h"), F.col("e.state").eqNullSafe(F.col("h.state")) & (F.col("e.property") == F.col("h.property")), "left")
    return both.select("e.state", "e.property", (F.col("all") - F.coalesce("held", F.lit(0))).alias("n")).where("n > 0")
