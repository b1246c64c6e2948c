"""Class layers of several years: modes and masks, as documented or as the published tables were made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables as T


def layer_of_years(rows: DataFrame, key: str, year: str, value: str, years: Sequence[int], documented: bool = True) -> DataFrame:
    """(key, value): the most frequent value over the years, the least of equals; not documented: that of the last year alone."""
    if not documented:
        return rows.where(F.col(year) == max(years)).select(key, value)
    counts = rows.where(F.col(year).isin(*years)).groupBy(key, value).agg(F.count("*").alias("ly_n"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("ly_n", -F.col(value))).alias(value))


def crop_layer(rows: DataFrame, key: str, year: str, value: str, years: Sequence[int], wanted: int, documented: bool = True) -> DataFrame:
    """(key, value) of the wanted year, or of all years where it has no layer."""
    if wanted in years:
        return rows.where(F.col(year) == wanted).select(key, value)
    return layer_of_years(rows, key, year, value, years, documented)


def min_years_masks(rows: DataFrame, key: str, year: str, irrigated: Column, least: int) -> DataFrame:
    """rows, one per key and year, with ``documented``, ``mosaic`` and ``moved``, each the flag under a mask.

    documented keeps keys irrigated in at least so many years; mosaic keeps those whose
    last year counts less than ``least`` (so all, where it is over 1); moved keeps those
    with fewer years than it and turns the others to 0.
    """
    own = Window.partitionBy(key)
    flag = irrigated.cast("long")
    total, last = F.sum(flag).over(own), F.max_by(flag, year).over(own)
    out = rows.withColumns({"ly_f": flag, "ly_s": total, "ly_l": last})
    masks = {"documented": F.col("ly_s") >= least, "mosaic": F.col("ly_l") < least}
    return out.withColumns({n: F.when(c, F.col("ly_f")) for n, c in masks.items()} | {"moved": F.when(F.col("ly_s") < least, F.col("ly_f")).otherwise(0)}).drop("ly_f", "ly_s", "ly_l")


#: The landcover class of cultivated crops, and the water occurrence in percent over which a pixel counts as water.
CULTIVATED, WET = 82, 25


def with_static(rows: DataFrame, still: DataFrame, pixel: str) -> DataFrame:
    """rows with the layers of a static table (pixel, elevation, landcover, occurrence): elevation, landcover, cultivated and water as 0 or 1; null for pixels without them.

    A pixel is there once: of several static rows the greatest counts.
    """
    one = still.groupBy(pixel).agg(F.max(F.struct("elevation", "landcover", "occurrence")).alias("ly_s"))
    s = F.col("ly_s")
    made = [s["elevation"].alias("elevation"), s["landcover"].alias("landcover"), (s["landcover"] == CULTIVATED).cast("int").alias("cultivated"), (s["occurrence"] > WET).cast("int").alias("water")]
    return rows.join(one, pixel, "left").select(*rows.columns, *made)


def allocate(polygons: DataFrame, zone: str, key: str, area: str, n: int, folder: str) -> DataFrame:
    """(zone, key, quota, total): points for each polygon by its share of the zone's area, one at least, in order of key until a zone has more than n.

    The running total goes over ranges of (zone, key), so a zone of any size is spread over many tasks.
    """
    whole = polygons.groupBy(F.col(zone).alias("al_z")).agg(F.sum(area).alias("al_a"))
    quota = F.greatest(F.lit(1), F.ceil(F.col(area) / F.col("al_a") * n)).cast("long")
    each = polygons.join(T.beside(whole), F.col(zone).eqNullSafe(F.col("al_z"))).select(zone, key, quota.alias("quota"))
    return T.ranked(each, [zone], [key], "total", folder, "quota").where(F.col("total") - F.col("quota") <= n)
