"""Document fingerprints from improbable features.

Every window of WINDOW bytes has an entropy class; a class is the rarer the fewer windows
of the whole corpus have it. In each run of RUN neighbouring windows the rarest wins, and
windows that win POPULAR times are the document's features. They are inserted into Bloom
filters of FILTER_BITS bits, a new one being chained on once a filter holds FILL features.
Two documents are compared by the bits that filters share beyond chance.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import fresh

WINDOW = 32
RUN = 32
POPULAR = 8
CLASSES = 1001
#: Windows of a lower class hardly say anything (rows of one sign).
LEAST_CLASS = 100
FILTER_BITS, FILL, BITS_EACH = 2048, 160, 5
#: Bytes that are worked on at once.
PIECE = 1 << 16
NEVER = CLASSES + 1
#: k log2 k in fixed point, and its steps, so that sums are exact.
_LOAD = np.round([k * np.log2(k) * (1 << 20) if k else 0 for k in range(WINDOW + 1)]).astype(np.int64)
_STEP = np.diff(_LOAD)
_MOST = int(_LOAD[WINDOW])
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.float32)


def classes(x: np.ndarray) -> np.ndarray:
    """Entropy class of each window of an array of bytes: 0 for one sign, CLASSES - 1 for WINDOW different ones.

    A window is the one before it without its first byte and with one more; what that
    changes depends on how often the two bytes stand within WINDOW - 1 places.
    """
    if len(x) < WINDOW:
        return np.zeros(0, np.int32)
    before, after = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    for lag in range(1, WINDOW):
        same = (x[lag:] == x[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    load = np.cumsum(_STEP[before])[WINDOW - 1 :]
    load[1:] -= np.cumsum(_STEP[after[: len(load) - 1]])
    return ((CLASSES - 1) * (_MOST - load) // _MOST).astype(np.int32)


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each ends."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def own_windows(ends: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Whether the windows that begin at lo to hi - 1 end within the same text."""
    at = np.arange(lo, hi)
    return at + WINDOW <= ends[np.minimum(np.searchsorted(ends, at, "right"), len(ends) - 1)]


def class_counts(texts: Sequence[bytes]) -> np.ndarray:
    """Windows of all texts in each class."""
    x, ends = joined(texts)
    out = np.zeros(CLASSES, np.int64)
    for lo in range(0, max(0, len(x) - WINDOW + 1), PIECE):
        found = classes(x[lo : lo + PIECE + WINDOW - 1])
        out += np.bincount(found[own_windows(ends, lo, lo + len(found))], minlength=CLASSES)
    return out


def features(texts: Sequence[bytes], ranks: np.ndarray) -> list[list[bytes]]:
    """The distinct feature hashes of each text in order; a text shorter than a window, or without a popular one, is one feature itself."""
    x, ends = joined(texts)
    data, windows = x.tobytes(), max(0, len(x) - WINDOW + 1)
    found: list[dict[bytes, None]] = [{} for _ in texts]
    for start in range(0, windows, PIECE):
        lo, hi = max(0, start - RUN + 1), min(windows, start + PIECE + RUN - 1)
        own = own_windows(ends, lo, hi)
        rank = np.where(own, ranks[classes(x[lo : hi + WINDOW - 1])], NEVER)
        key = np.full(hi - lo + RUN - 1, NEVER << 20, np.int32)
        key[: hi - lo] = (rank << 20) + np.arange(hi - lo)
        span = 1
        while span < RUN:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        key = key[own]  # runs that begin in a text
        wins = np.bincount(key[key < NEVER << 20] & ((1 << 20) - 1), minlength=hi - lo)
        at = np.flatnonzero(wins[start - lo : start - lo + PIECE] >= POPULAR) + start
        for place, text in zip(at.tolist(), np.searchsorted(ends, at, "right").tolist()):
            found[text][hashlib.blake2b(data[place : place + WINDOW], digest_size=8).digest()] = None
    return [list(f) or ([hashlib.blake2b(t, digest_size=8).digest()] if t else []) for f, t in zip(found, texts)]


def chained(hashes: Sequence[bytes]) -> bytes:
    """The features' Bloom filters one after the other; nothing for no feature."""
    count = -(-len(hashes) // FILL)
    code = np.frombuffer(b"".join(hashes), "<u8")
    bits = np.zeros(count * FILTER_BITS, np.uint8)
    for k in range(BITS_EACH):
        bits[np.arange(len(code)) // FILL * FILTER_BITS + ((code >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def digests(texts: Sequence[bytes], ranks: np.ndarray) -> list[bytes]:
    return [chained(f) for f in features(texts, ranks)]


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: how far the filters of the one with fewer bits lie within the best of the other's, weighed by their bits.

    Shared bits count from two standard deviations above what chance gives. Equal
    fingerprints have 1, two empty ones too; an empty and another 0.
    """
    if a == b:
        return 1.0
    sides = [np.frombuffer(s, np.uint8).reshape(-1, FILTER_BITS // 8) for s in sorted((a, b))]
    if not len(sides[0]) or not len(sides[1]):
        return 0.0
    sizes = [_POPCOUNT[s].sum(1) for s in sides]
    if sizes[0].sum() > sizes[1].sum():
        sides, sizes = sides[::-1], sizes[::-1]
    best = np.zeros(len(sides[0]), np.float32)
    spread = [lambda s=s, k=k: np.unpackbits(s[k : k + 256], axis=1).astype(np.float32) for s in sides for k in range(0, len(s), 256)]  # 256 filters at once
    cuts = -(-len(sides[0]) // 256)
    for i, left in enumerate(spread[:cuts]):
        own = slice(256 * i, 256 * i + 256)
        rows, n = left(), sizes[0][own][:, None]
        for j, right in enumerate(spread[cuts:]):
            m = sizes[1][256 * j : 256 * j + 256][None, :]
            shared, most, chance = rows @ right().T, np.minimum(n, m), n * m / FILTER_BITS
            floor = chance + 2 * np.sqrt(chance * (1 - most / FILTER_BITS))
            best[own] = np.maximum(best[own], np.where(most > floor, (shared - floor) / np.maximum(most - floor, 1e-6), 0).max(1))
    return float(np.clip((best * sizes[0]).sum() / sizes[0].sum(), 0, 1))


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy class, rarest first, by the windows of all texts; classes under LEAST_CLASS never win. A table of CLASSES numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for texts in sliced(batch.column(0)):
                total += class_counts(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["k", "n"])

    counts = np.zeros(CLASSES, np.int64)
    for row in docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row per class
        counts[row.k] = row.n
    ranks = np.empty(CLASSES, np.int32)
    ranks[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    ranks[:LEAST_CLASS] = NEVER
    return ranks


def sliced(column: pa.Array, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts of a binary column, null as empty, in lists of about so many bytes."""
    part, size = [], 0
    for value in column:
        part.append(value.as_py() or b"")
        size += len(part[-1])
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", ranks: np.ndarray | None = None) -> DataFrame:
    """docs with the fingerprint of each text added, as hex of its chained filters.

    ranks: rarity() of a corpus, that of docs by default; fingerprints compare only under
    the same ranks. Equal texts have equal fingerprints, null and empty ones an empty
    string. Repeated rows stay repeated, an empty table gives an empty result; a column
    of docs named out_col is replaced, others may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs, text_col) if ranks is None else ranks)
    held, kept = fresh(docs, "fg_text"), [c for c in docs.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                *cols, texts = batch.slice(at, 1000).columns
                prints = [d.hex() for part in sliced(texts) for d in digests(part, shared.value)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(prints, pa.string())], [*kept, out_col])

    schema = StructType([docs.schema[c] for c in kept]).add(out_col, StringType())
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("binary").alias(held)).mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many characters of the following text, or all of them."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_FOUND = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())


def compared(texts: list[str], ranks: np.ndarray) -> list[pa.Array]:
    """The columns of _FOUND for each text but the last, from it and the text after it."""
    own = digests([t.encode() for t in texts], ranks)
    changed = [edited(t, after).encode() for t, after in zip(texts, texts[1:])]
    new = digests(changed, ranks)
    columns = (
        [len(t) for t in texts[:-1]], [hashlib.sha256(c).digest() for c in changed], own[:-1], new,
        [likeness(a, b) for a, b in zip(own, new)], [likeness(a, b) for a, b in zip(own, own[1:])],
    )
    return [pa.array(c, k) for c, k in zip(columns, _KINDS)]


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows (id, h, text) in ranges of (id, h), one to a partition and sorted there; the first row of the next range stands last with guard true.

    The ranges begin at keys of a layout of the ids alone, one for each partition, so the texts are
    shuffled once. The last range has the first row of all as its guard.
    """
    first = rows.select("id", "h").repartitionByRange(parts, "id", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct(F.col("id").isNotNull(), "id", "h")).alias("k"))
    begin = rows.sparkSession.sparkContext.broadcast(sorted(tuple(r.k) for r in first.collect()))  # a key per range

    @F.arrow_udf("struct<part:int,guard:int>")
    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        keys, at = begin.value, []
        for i, h in zip(ids.to_pylist(), hashes.to_pylist()):
            k = bisect_right(keys, (i is not None, i, h)) - 1
            at.append((k, (k - 1) % len(keys) if keys[k] == (i is not None, i, h) else None))
        return pa.StructArray.from_arrays([pa.array([p for p, _ in at], pa.int32()), pa.array([g for _, g in at], pa.int32())], ["part", "guard"])

    seats = F.filter(F.array(F.struct(F.col("at.part").alias("part"), F.lit(False).alias("guard")), F.struct(F.col("at.guard").alias("part"), F.lit(True).alias("guard"))), lambda s: s["part"].isNotNull())
    placed = rows.withColumn("at", place("id", "h")).select("id", "h", "text", F.inline(seats))
    return placed.repartitionById(parts, "part").sortWithinPartitions("guard", "id", "h", "text")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Rows are laid out once in ranges of (id, text), each with the row that follows it. The row
    after the last is the first; a single row follows itself. Null ids come first, null
    texts count as empty, repeated rows are in turn each other's next, and an empty table
    gives an empty result. Other columns of docs may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs, text_col))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", *[x.split(" ")[0] for x in _FOUND.split(", ")]]
    laid = dealt(rows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("id", "text", "guard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, over = None, [], False  # the rows that wait for their next one; over: a guard has come
        for batch in batches:
            begin, guards = 0, batch.column(2).to_pylist()
            for chunk in sliced(batch.column(1).cast(pa.binary())):
                stop = begin + len(chunk)
                while not over and begin < stop:
                    cut = next((k + 1 for k in range(begin, stop) if guards[k]), stop)  # up to the first guard; later ones repeat it
                    over = guards[cut - 1]
                    own, part = batch.column(0).slice(begin, cut - begin), [t.decode() for t in chunk[: cut - begin]]
                    ids, texts, begin = own if ids is None else pa.concat_arrays([ids, own]), [*texts, *part], cut
                    if (n := len(texts) - 1) > 0:
                        yield pa.RecordBatch.from_arrays([ids.slice(0, n), *compared(texts, shared.value)], names)
                        ids, texts = ids.slice(n), texts[n:]
                begin = stop

    found = laid.mapInArrow(run, f"id {kind}, {_FOUND}")
    return found.select(F.col("id").alias(id_col), *[F.lower(F.hex(c)).alias(c) if "binary" in t else c for c, t in found.dtypes[1:]])
