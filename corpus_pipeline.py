"""Corpus pipeline: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage is written as Parquet and read again as the next one's documents. In every
stage null and empty texts, repeated rows, null ids, very long texts and extra columns
of any name pass as its docstring says, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from croplens.llm import decontaminate, exact_dedup, language_id, packing, simhash_dedup
from croplens.llm.common import discard, fresh, materialize
from croplens.llm.queries import table, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in which a language is recognised, with all their columns.

    Null texts and texts without a letter go, and all rows where none is labelled;
    repeated rows stay repeated.
    """
    model = language_id.fit(docs, ~language_id.held_out())
    pred, score = fresh(docs, "li_pred"), fresh(docs, "li_score")
    return language_id.predict(docs, model, pred_col=pred, score_col=score).where(F.col(pred) != language_id.UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per distinct text, that with the largest id; null counts as empty, and of rows that repeat that id one stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per group of near copies, that with the least id; blank texts are one group, and of rows that repeat that id one stays."""
    return simhash_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a passage of the benchmark; null and empty texts stay, repeated rows stay repeated."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences that hold every row's tokens; null and empty texts have the end token, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("packing", pack),
]

#: Kernel classification, fingerprints, alignment and tokenisation have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of documents; a stage's table is deleted once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return docs
