"""Streams over the events table, drained to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stacks as K
from ..streaming import events as E
from .registry import query, scratch


@query("SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY ALL")
def stream_daily_max(spark, sf_dir):
    """A window may be updated in several batches; its largest value counts."""
    rows = E.drain(E.daily_max(E.read(spark, sf_dir, "events.parquet"), "user_id", "ts", "value"), scratch(spark))
    return rows.groupBy("user_id", "day").agg(F.max("value").alias("value"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_frequency(spark, sf_dir):
    """The last update of each key counts."""
    rows = E.drain(E.running_count(E.read(spark, sf_dir, "events.parquet"), "user_id", "event_type"), scratch(spark))
    return rows.groupBy("user_id", "event_type").agg(F.max_by("n", E.BATCH).alias("n"))


@query("SELECT event_id, user_id, value FROM events")
def stream_once(spark, sf_dir):
    """The table is read twice over as a stream; each event arrives once."""
    stream = E.read(spark, sf_dir, "events.parquet")
    return E.drain(E.once(stream.unionByName(stream), "event_id", "ts").select("event_id", "user_id", "value"), scratch(spark), "append").drop(E.BATCH)


def _seasons_sql() -> str:
    inside = lambda back, first, stop: f"FILTER (WHERE yr - own = {back} AND day >= {first} AND day < {stop})"
    cols = [f"round(avg(v) {inside(*w)}, 4) AS mean_{n}, max(v) {inside(*w)} AS max_{n}" for n, *w in K.NORTH]
    some = " OR ".join(f"(yr - own = {back} AND day >= {first} AND day < {stop})" for _, back, first, stop in K.NORTH)
    return f"""WITH e AS (SELECT o_custkey AS cust, CAST(year(o_orderdate) + back AS INT) AS yr, year(o_orderdate) AS own, month(o_orderdate) * 100 + day(o_orderdate) AS day, CAST(o_totalprice AS DOUBLE) AS v FROM orders, range(3) b(back)),
m AS (SELECT max(o_orderdate) - INTERVAL 2 DAY AS mark FROM orders)
SELECT cust, yr, {", ".join(cols)} FROM e, m WHERE ({some}) AND make_date(yr, 12, 31) <= mark GROUP BY cust, yr"""


@query(_seasons_sql())
def stream_seasons(spark, sf_dir):
    """Seasonal windows of each customer's orders, as the stream closes the years."""
    stream = E.read(spark, sf_dir, "orders.parquet").withColumnRenamed("o_custkey", "cust")
    rows = E.drain(E.seasons(stream, "cust", "o_orderdate", "o_totalprice"), scratch(spark), "append").drop(E.BATCH)
    return rows.select("cust", "yr", *[F.round(c, 4).alias(c) if c.startswith("mean") else c for c in rows.columns[2:]])
