"""Target-distribution importance resampling over hashed n-grams.

A feature's bucket is the CRC-32 of its words joined by a space. CRCs compose: that of
A followed by B is the CRC of A shifted by the length of B, plus that of B, where a shift
by one byte is a matrix over GF(2) and its powers of two give every length. So each word's
CRC is computed once and n-grams are never built as strings. Log ratios of bucket shares
in the target and in the corpus weigh documents; a hash of the id adds Gumbel noise, and
the highest sums are a draw without replacement.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..operators.tables import ranked
from .common import fresh, materialize, new_path

BUCKETS = 10_000
MAX_N = 2
MIN_WORDS = 20
SEED = 2024
#: Bytes of a text whose words are in memory at a time.
PIECE = 1 << 20
#: Words are runs of digits, letters a-z and non-ASCII; everything else becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_SPACE = zlib.crc32(b" ")


def apply(matrix: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """Products of a 32 x 32 matrix over GF(2), held as its values for each byte of the register, with many CRCs."""
    return matrix[0][crcs & 255] ^ matrix[1][(crcs >> 8) & 255] ^ matrix[2][(crcs >> 16) & 255] ^ matrix[3][crcs >> 24]


def _powers(count: int = 31) -> list[np.ndarray]:
    """Matrices that shift a CRC by 1, 2, 4, ... bytes of zeros."""
    values = np.arange(256, dtype=np.uint32)
    one = np.stack([values << np.uint32(8 * k) for k in range(4)])
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ np.where(one & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    out = [one]
    while len(out) < count:
        out.append(apply(out[-1], out[-1]))
    return out


_SHIFTS = _powers()


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC shifted by its own number of bytes."""
    out = crcs.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        on = (lengths >> k) & 1 == 1
        out[on] = apply(_SHIFTS[k], out[on])
    return out


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about PIECE bytes."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        if words := text[at:end].translate(_FOLD).split():
            yield words
        at = end


def gram_crcs(text: bytes, max_n: int) -> Iterator[np.ndarray]:
    """CRC-32 of every run of 1 to max_n words joined by a space, in arrays by n and piece of the text."""
    tail, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)  # of the last max_n - 1 words of the pieces before
    for words in word_lists(text):
        own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        yield own
        if max_n == 1:
            continue
        known = len(tail)
        crcs, sizes = np.concatenate([tail, own]), np.concatenate([sizes, np.fromiter(map(len, words), np.int64, len(words))])
        spaced = shift(np.full(len(crcs), _SPACE, np.uint32), sizes) ^ crcs  # of a space and the word
        grams = crcs
        for n in range(2, min(max_n, len(crcs)) + 1):
            grams = shift(grams[:-1], sizes[n - 1 :] + 1) ^ spaced[n - 1 :]
            yield grams[max(0, known - n + 1) :]
        tail, sizes = crcs[-(max_n - 1) :], sizes[-(max_n - 1) :]


def bucket_counts(docs: DataFrame, text_col: str, max_n: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket; tasks send one sum a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for crcs in gram_crcs(text.as_py() or b"", max_n):
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    parts = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row per bucket
        out[row.bucket] = row.n
    return out


def fit(docs: DataFrame, target: DataFrame, text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: 1000 times the log ratio of its smoothed shares in target and docs, rounded down."""
    have, want = bucket_counts(docs, text_col, max_n, buckets).tolist(), bucket_counts(target, text_col, max_n, buckets).tolist()
    of, out_of = float(sum(have) + buckets), float(sum(want) + buckets)
    return np.array([math.floor(1000 * math.log(float(t + 1) * of / (float(s + 1) * out_of))) for s, t in zip(have, want)], np.int64)


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate drawn from a hash of seed and id, rounded down; null ids draw as empty ones."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, gains: np.ndarray, text_col: str = "text", max_n: int = MAX_N, names: tuple[str, str, str] = ("n_words", "n_features", "weight")) -> DataFrame:
    """docs with three columns added: words, features, and the floored mean of the features' gains (none: 0).

    Null and empty texts have no words. Columns of docs under the three names are
    replaced; others may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # a number a bucket
    held, kept = fresh(docs, "ir_text"), [c for c in docs.columns if c not in names]
    schema = StructType([docs.schema[c] for c in kept])
    for name in names:
        schema = schema.add(name, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                *cols, texts = batch.slice(at, 1000).columns
                out = np.zeros((3, len(texts)), np.int64)
                for row, text in enumerate(texts):
                    total = 0
                    text = text.as_py() or b""
                    for crcs in gram_crcs(text, max_n):
                        out[1, row] += len(crcs)
                        total += int(gains[crcs % np.uint32(len(gains))].sum())
                    out[0, row] = out[1, row] if max_n == 1 else sum(map(len, word_lists(text)))
                    out[2, row] = total // max(1, int(out[1, row]))
                yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, out)], [*kept, *names])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("binary").alias(held)).mapInArrow(run, schema)


def scores(docs: DataFrame, target: DataFrame, percent: int = 10, id_col: str = "doc_id", text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank is null for rows that are not drawn.

    Of the N rows with at least min_words words the floor(N * percent / 100) highest
    scores are drawn, ties to the smaller id, then the smaller weight and fewer features.
    Null and empty texts have no features and weight 0; repeated rows stay repeated and
    are ranked each; an empty table gives an empty result. Ranking is spread over ranges.
    """
    gains = fit(docs, target, text_col, max_n, buckets)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("ir_doc"))
    found = weigh(rows, gains, "ir_doc", max_n).drop("ir_doc").withColumn("score", F.col("weight") + gumbel("id", seed))
    found = materialize(found, "scores")
    able = found.where(F.col("n_words") >= min_words)
    draw = able.count() * percent // 100
    order = ["ir_low", "id", "weight", "n_features"]
    first = ranked(able.withColumn("ir_low", -F.col("score")), [], order, "rank", new_path(docs.sparkSession, "ranked"))
    first = first.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = found.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return first.select(rest.columns).unionAll(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, id_col: str = "doc_id", text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, with all their columns.

    The draw of scores(), by the score and id of its last row, so no text is shuffled.
    Rows that repeat the id and score of that last row are all kept. An empty table
    gives an empty result, as does a percentage that draws no row.
    """
    last = scores(docs, target, percent, id_col, text_col, max_n, buckets, min_words, seed).where("rank is not null").orderBy(F.desc("rank")).first()
    if last is None:
        return docs.limit(0)
    names = tuple(fresh(docs, x) for x in ("ir_words", "ir_features", "ir_weight"))
    weighed = weigh(docs, fit(docs, target, text_col, max_n, buckets), text_col, max_n, names)
    score, own = F.col(names[2]) + gumbel(id_col, seed), F.col(f"`{id_col}`")
    smaller = own.isNull() if last[id_col] is None else F.coalesce(own <= last[id_col], F.lit(True))
    return weighed.where((F.col(names[0]) >= min_words) & ((score > last.score) | ((score == last.score) & smaller))).drop(*names)
