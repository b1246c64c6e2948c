"""Language identification with a blended-spectrum string kernel.

The kernel counts the character n-grams (n = 1..MAX_N, presence only) that two texts
share, over the norm of both. Landmark texts give its Nystroem features
K(x, L) K(L, L)^-1/2, and one-versus-rest kernel ridge regression is solved on them.
Scoring is two matrix products per batch: presence rows by landmarks, then by weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import fresh

MAX_N = 3
#: n-grams that the kernel looks at: the most frequent of the training sample.
GRAMS = 8192
LANDMARKS = 128
RIDGE = 1e-2
#: Bound of the training sample: documents per language, in all (or one per language, where those are more),
#: and characters of each that are learned from.
SAMPLE_DOCS = 400
SAMPLE_TOTAL = 8000
SAMPLE_CHARS = 5000
SLOTS = 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> list[np.ndarray]:
    """Codes of the n-grams of the lower-cased text, by n."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code, out = np.zeros(len(points), np.uint64), []
    for n in range(1, min(MAX_N, len(points)) + 1):
        code = code[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(1)
        out.append(code)
    return out


def slots(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(44)).astype(np.int64)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # slot of an n-gram -> its column, GRAMS where it has none
    landmarks: np.ndarray  # columns by landmarks, normalised
    weights: np.ndarray  # landmarks by labels

    def presence(self, texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), len(self.landmarks) + 1), np.float32)
        for row, text in zip(rows, texts):
            for code in grams(text):
                row[self.table[slots(code)]] = 1
        return rows[:, :-1]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.presence(texts)
        norm = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return (x @ self.landmarks / norm) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Labels and scores from 0 to 1; UNKNOWN and 0 where a text is null or has no letter."""
        known = [n for n, t in enumerate(texts) if t and _LETTER.search(t)]
        labels, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for at in range(0, len(known) if self.labels else 0, 256):  # 8 MB of presence rows
            part = known[at : at + 256]
            s = self.scores([texts[n] for n in part])
            best = s.argmax(1)
            for n, b, v in zip(part, best.tolist(), s.max(1).tolist()):
                labels[n], sure[n] = self.labels[b], min(1.0, max(0.0, v))
        return labels, sure


def train(rows: list[tuple[str, str]]) -> Model:
    """Model of (text, label) rows; without rows it knows no label."""
    labels = sorted({y for _, y in rows})
    seen: dict[int, int] = {}
    for text, _ in rows:
        for code in set(np.concatenate([slots(c) for c in grams(text)] or [np.zeros(0, np.int64)]).tolist()):
            seen[code] = seen.get(code, 0) + 1
    top = sorted(seen, key=lambda c: (-seen[c], c))[:GRAMS]
    table = np.full(SLOTS, len(top), np.int32)
    table[top] = np.arange(len(top))
    model = Model(labels, table, np.zeros((len(top), 0), np.float32), np.zeros((0, len(labels)), np.float32))
    if not rows:
        return model
    x = model.presence([t for t, _ in rows])
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    by_label = [[n for n, (_, y) in enumerate(rows) if y == label] for label in labels]
    chosen = [n for own in by_label for n in own[: max(1, LANDMARKS // len(labels))]]
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    k = (x @ marks.T) @ root
    y = np.array([[1.0 if label == own else 0.0 for label in labels] for _, own in rows])
    balance = np.array([[len(rows) / len(labels) / len(by_label[labels.index(own)])] for _, own in rows])
    beta = np.linalg.solve(k.T @ (k * balance) + RIDGE * np.eye(len(chosen)), k.T @ (y * balance))
    model.landmarks, model.weights = marks.T.astype(np.float32).copy(), (root @ beta).astype(np.float32)
    return model


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_on: Column) -> list[tuple[str, str]]:
    """(text, label) of labelled rows, those of each language with the smallest hashes; every language of the table has some.

    At most about SAMPLE_DOCS a language and SAMPLE_TOTAL in all, of long texts the first
    SAMPLE_CHARS characters. The driver holds the list of languages.
    """
    rows = docs.where(train_on & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.select(F.substring(text_col, 1, SAMPLE_CHARS).alias("t"), F.col(lang_col).cast("string").alias("y"), place.alias("p"))
    counts = rows.groupBy("y").agg(F.count("*").alias("n"), F.min("p").alias("least")).collect()
    if not counts:
        return []
    each = max(1, min(SAMPLE_DOCS, SAMPLE_TOTAL // len(counts)))
    limits = docs.sparkSession.createDataFrame([(r.y, max(r.least, each / r.n)) for r in counts], "ly string, bound double")
    picked = rows.join(F.broadcast(limits), (F.col("y") == F.col("ly")) & (F.col("p") <= F.col("bound"))).select("t", "y", "p")
    return [(r.t, r.y) for r in picked.orderBy("p", "t").limit(2 * each * len(counts)).collect()]


def fit(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of a bounded sample of the labelled rows for which train_on holds; one that knows no label where there are none."""
    return train(sample(docs, id_col, text_col, lang_col, train_on))


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "li_pred", score_col: str = "li_score") -> DataFrame:
    """docs with the columns pred_col and score_col added; nothing but the text is looked at.

    Null texts and texts without a letter are UNKNOWN with score 0, as is everything for
    a model without labels. Repeated rows stay repeated; an empty table gives an empty
    result. Columns of docs under the two names are replaced; others may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most GRAMS floats a landmark and the slot table
    held, names = fresh(docs, "li_text"), [c for c in docs.columns if c not in (pred_col, score_col)]
    schema = StructType([docs.schema[c] for c in names]).add(pred_col, StringType()).add(score_col, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                *cols, text = batch.slice(at, 1000).columns
                labels, sure = shared.value.predict(text.to_pylist())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(labels, pa.string()), pa.array(sure)], [*names, pred_col, score_col])

    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias(held)).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is held out: crc32 of its id as text leaves 1 when divided by 3; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score. Trained on the rows that are not held out.

    Null texts and texts without a letter are UNKNOWN with score 0, as is everything
    when no row is labelled. Repeated rows stay repeated; an empty table gives an
    empty result.
    """
    model = fit(docs, ~held_out(id_col), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("li_doc"))
    return predict(rows, model, "li_doc").select(id_col, "held_out", F.col("li_pred").alias("lang_pred"), F.col("li_score").alias("score"))
