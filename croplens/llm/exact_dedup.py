"""Exact deduplication with an extendible-hash index (built-in functions only).

1. The directory starts with one bucket. While a bucket holds more than
   ``bucket_capacity`` distinct keys it is split by the next bits of the key, and the
   directory doubles to the greatest local depth; ``LEVELS`` doublings share a job.
   Only the keys of overfull buckets are read again.
2. Every text is inserted at its slot, where whole texts are compared: unequal texts
   with one key stay apart, and copies combine map-side, so that a text that fills a
   third of all rows reaches the shuffle once per task. Texts are shuffled here only.
3. Owner tasks take ranges of buckets, chain the entries of each key and write the
   index to the shared folder.
4. Documents look up their slot's bucket in the directory and walk the chain there by
   digest; keep_id and group_size are read from the entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, drop_rows, materialize, row_hash

BUCKET_CAPACITY = 4096
#: Doublings of the directory per job.
LEVELS = 8


def slot_of(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of the key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def split_buckets(keys: DataFrame, capacity: int, levels: int = LEVELS) -> DataFrame:
    """(depth, prefix) of each bucket: the shortest prefixes under which at most ``capacity`` of the distinct keys (dd_key) stand."""
    settled, overfull, base = None, None, 0
    while True:
        top = min(64, base + levels)
        rows = keys.withColumn("prefix", slot_of(F.col("dd_key"), base))
        rows = rows if overfull is None else rows.join(overfull, "prefix", "left_semi")
        slots = rows.groupBy(slot_of(F.col("dd_key"), top).alias("slot")).agg(F.count("*").alias("n"))
        tries = slots.select("slot", "n", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        tries = tries.withColumn("prefix", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned(slot, {top} - depth)")))
        fits = tries.groupBy("depth", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") <= capacity).select("depth", "prefix")
        least = tries.join(fits, ["depth", "prefix"]).groupBy("slot").agg(F.min(F.struct("depth", "prefix")).alias("b"))
        found = materialize(slots.join(least, "slot", "left").select("slot", "b.depth", "b.prefix"), "buckets")
        own = found.where("depth is not null").select("depth", "prefix").distinct()
        settled = own if settled is None else settled.unionByName(own)
        overfull = found.where("depth is null").select(F.col("slot").alias("prefix"))
        if overfull.isEmpty():
            return settled
        base = top


class Index:
    """Directory and entries of the distinct texts of docs."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, capacity: int = BUCKET_CAPACITY):
        text = F.coalesce(F.col(text_col), F.lit(""))
        keys = materialize(docs.select(F.xxhash64(text).alias("dd_key")).distinct(), "keys")
        buckets = split_buckets(keys, capacity)
        self.depth = depth = buckets.agg(F.max("depth")).first()[0] or 0
        # a bucket of local depth d owns 2 ** (depth - d) neighbouring slots of the directory
        wide = F.expr(f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix, {depth} - depth) + shiftleft(1L, {depth} - depth) - 1)")
        self.directory = materialize(buckets.select(F.explode(wide).alias("slot"), F.concat_ws(":", F.col("depth"), F.hex("prefix")).alias("bucket")), "directory")
        entries = (
            docs.select(F.col(id_col).alias("dd_id"), text.alias("dd_text")).withColumn("dd_key", F.xxhash64("dd_text"))
            .groupBy(slot_of(F.col("dd_key"), depth).alias("slot"), "dd_key", "dd_text").agg(F.max("dd_id").alias("keep_id"), F.count("*").alias("group_size"))
            .select("slot", "dd_key", F.sha2("dd_text", 256).alias("text_sha256"), "keep_id", "group_size")
        )
        entries = materialize(entries, "entries")
        chain = Window.partitionBy("bucket", "dd_key").orderBy("text_sha256")
        owned = entries.join(self.directory, "slot").repartitionByRange("bucket", "dd_key").withColumn("chain", F.row_number().over(chain))
        self.entries = materialize(owned.select("bucket", "dd_key", "chain", "text_sha256", "keep_id", "group_size"), "index")
        discard(keys, entries)

    def probe(self, rows: DataFrame) -> DataFrame:
        """rows (dd_key, text_sha256, ...) with their entry's bucket, chain, keep_id and group_size."""
        at = rows.withColumn("slot", slot_of(F.col("dd_key"), self.depth)).join(self.directory, "slot").drop("slot")
        return at.join(self.entries, ["bucket", "dd_key", "text_sha256"])


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = BUCKET_CAPACITY
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Null text counts as the empty text. Of equal texts the largest id stays; a group
    whose ids are all null has a null keep_id and all its rows kept. Rows repeated
    with one id share their flags. An empty table gives an empty result; other
    columns are ignored. bucket is depth:prefix, chain the place in its key's chain.
    """
    index = Index(docs, id_col, text_col, bucket_capacity)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = index.probe(docs.select(F.col(id_col).alias("dd_id"), F.xxhash64(text).alias("dd_key"), F.sha2(text, 256).alias("text_sha256")))
    return found.select(
        F.col("dd_id").alias(id_col), "keep_id", "group_size",
        F.col("dd_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """One row of docs per distinct text, with all its columns: that with the largest id.

    Null text counts as the empty text, null ids as less than any other. Of rows that
    share the largest id, that with the greatest hash stays, and of wholly equal rows
    one. An empty table gives an empty result; columns may have any names.
    """
    index = Index(docs, id_col, text_col, bucket_capacity)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), row_hash(docs).alias("hash"), F.xxhash64(text).alias("dd_key"), F.sha2(text, 256).alias("text_sha256"))
    copies = index.probe(rows).where("group_size > 1")
    copies = copies.select("id", "hash", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "dd_key", "text_sha256")
    # copies are a fixed share of the rows, so their list outgrows any broadcast: the join is the same at every size
    return drop_rows(docs, id_col, copies, ["dd_key", "text_sha256"], "merge")
