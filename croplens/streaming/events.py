"""Streaming forms of the daily and frequency aggregates, and their drain into a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType

from ..operators import stacks as K

BATCH = "st_batch"


def read(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Parquet files of a folder as a stream; the schema comes from those that are there."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def daily_max(stream: DataFrame, key: str, ts: str, value: str, late: str = "2 days") -> DataFrame:
    """Largest value per key and day. State is dropped once the watermark has passed its window."""
    timed = stream.withColumn("day", F.to_date(ts)).withColumn("st_ts", F.col(ts).cast("timestamp")).withWatermark("st_ts", late)
    return timed.groupBy(F.window("st_ts", "1 day"), "day", key).agg(F.max(value).alias(value)).drop("window")


def running_count(stream: DataFrame, *keys: str) -> DataFrame:
    """Rows per key so far; state grows with the keys, not with the rows."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def once(stream: DataFrame, key: str, ts: str, late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark, for sinks that must not repeat."""
    return stream.withColumn("st_ts", F.col(ts).cast("timestamp")).withWatermark("st_ts", late).dropDuplicatesWithinWatermark([key]).drop("st_ts")


def seasons(stream: DataFrame, key: str, ts: str, value: str, windows: Sequence[tuple[str, int, int, int]] = K.NORTH, late: str = "2 days", groups: int = 1024) -> DataFrame:
    """A row per key and year with mean and greatest value of each window, those of the two years before among them.

    Windows are uneven and look back, so sums per key and window of the last years are
    kept, with a timer for the first year that is still open. Keys are held in groups by
    their hash, whose state is one table, so a call serves many keys. The row of a year
    is sent once the watermark has passed the year's last window; what no later year
    looks back on is forgotten then. Rows behind the watermark are dropped, as are null
    values, null keys and rows in no window.
    """
    spans = list(dict.fromkeys((first, stop) for _, _, first, stop in windows))
    last, furthest = max(stop for _, back, _, stop in windows if not back), max(back for _, back, _, _ in windows)
    zone = ZoneInfo(stream.sparkSession.conf.get("spark.sql.session.timeZone"))
    columns = [f"{what}_{name}" for name, *_ in windows for what in ("mean", "max")]
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, yr int, " + ", ".join(f"{c} double" for c in columns)

    def closes(year: int) -> int:
        return int(datetime(year, last // 100, last % 100, tzinfo=zone).timestamp() * 1000)

    at = ["k", "year", "span"]

    def summed(*parts: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([p for p in parts if len(p)] or parts[:1]).groupby(at, as_index=False, sort=False).agg(n=("n", "sum"), total=("total", "sum"), top=("top", "max"))

    def cells(rows: pd.DataFrame) -> pd.DataFrame:
        inside = [rows[(rows["day"] >= first) & (rows["day"] < stop)].assign(span=k) for k, (first, stop) in enumerate(spans)]
        each = pd.concat(inside).rename(columns={key: "k", "own": "year"})
        return each.groupby(at, as_index=False, sort=False).agg(n=("v", "size"), total=("v", "sum"), top=("v", "max"))

    def year_rows(own: pd.DataFrame, year: int) -> pd.DataFrame:
        made = {}
        for name, back, first, stop in windows:
            c = own[(own["year"] == year - back) & (own["span"] == spans.index((first, stop)))].set_index("k")
            made |= {f"mean_{name}": c["total"] / c["n"], f"max_{name}": c["top"]}
        return pd.DataFrame(made).rename_axis(key).reset_index().assign(yr=year)[[key, "yr", *columns]]

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = state.get if state.exists else (None, -(10**6))
        own = pa.ipc.open_stream(held).read_pandas() if held is not None else None  # a row per key, year and span
        for rows in frames:
            if len(rows):
                own = cells(rows) if own is None else summed(own, cells(rows))
        mark, made = state.getCurrentWatermarkMs(), []
        if own is not None:
            year = datetime.fromtimestamp(mark / 1000, zone).year
            shut = year if closes(year) <= mark else year - 1  # the last year that is closed
            opened = sorted({int(y) + back for _, back, *span in windows for y in own.loc[own["span"] == spans.index(tuple(span)), "year"].unique()})
            made = [year_rows(own, y) for y in opened if done < y <= shut]
            opened, own = [y for y in opened if y > shut], own[own["year"] > shut - furthest]
            if opened:
                table = pa.Table.from_pandas(own, preserve_index=False)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                state.update((sink.getvalue().to_pybytes(), max(done, shut)))
                state.setTimeoutTimestamp(max(closes(opened[0]), mark + 1))
            elif state.exists:
                state.remove()
        yield pd.concat(made) if made else pd.DataFrame({c: [] for c in [key, "yr", *columns]})

    timed = stream.select(key, F.col(ts).cast("timestamp").alias("st_ts"), F.col(value).cast("double").alias("v")).where(F.col(key).isNotNull() & F.col("v").isNotNull())
    timed = timed.withWatermark("st_ts", late).withColumns({"own": F.year("st_ts"), "day": K.day_of("st_ts")})
    timed = timed.withColumn("st_group", F.pmod(F.xxhash64(key), F.lit(groups)))
    return timed.groupBy("st_group").applyInPandasWithState(run, schema, "held binary, done int", "append", GroupStateTimeout.EventTimeTimeout)


def drain(updates: DataFrame, folder: str, mode: str = "update", seconds: int = 3600) -> DataFrame:
    """Runs what is there to its end and returns the updates with their batch number.

    A batch that is repeated after a failure overwrites its own folder; after `seconds`
    the stream is stopped with an error.
    """

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.parquet(f"{folder}/out/{BATCH}={batch}", mode="overwrite")

    query = updates.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream still running after {seconds} s")
    return updates.sparkSession.read.schema(updates.schema.add(BATCH, IntegerType())).parquet(f"{folder}/out")
