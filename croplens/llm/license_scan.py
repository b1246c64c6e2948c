"""License scan by an exact set-similarity join (built-in functions only).

Text blocks join license templates on shared tokens: sentences within a line, and
overlapping runs of words within a paragraph, so that a notice wrapped over lines lies
whole in a block. Tokens
are ordered by global document frequency, rarest first. A block that holds at least
``threshold`` of a template's tokens must hold one of the template's first
n - need + 1 (prefix filter), must have at least ``need`` tokens (length filter), and
from the first shared prefix token on must have enough tokens left on both sides
(positional filter). Survivors are verified by intersecting the token sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose places are counted, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Paragraphs of public licenses and the notices that name them, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
THRESHOLD = 0.8
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LINES = r"[\r\n]+|(?<=[.!?])\s+"
#: Between paragraphs: a blank line.
BLOCKS = r"(?:\r\n|\n|\r(?!\n))[ \t]*(?:\r\n|\n|\r(?!\n))\s*"


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAPS, -1), lambda w: w != "")


def template_tokens(templates: Sequence[tuple[str, str]]) -> list[list[str]]:
    return [sorted(set(re.findall(r"[0-9a-z]+", t.lower()))) for _, t in templates]


def run_length(templates: Sequence[tuple[str, str]]) -> int:
    """Words in a run: twice the longest template's, at least 4."""
    return 2 * max([2, *[len(re.findall(r"[0-9a-z]+", t.lower())) for _, t in templates]])


def runs(w: Column, length: int) -> Column:
    """Overlapping runs of words, a quarter of their length apart: every three quarters of a run lie whole in one."""
    step = max(1, length // 4)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - length + step - 1), F.lit(step))
    return F.transform(starts, lambda i: F.slice(w, i + 1, F.lit(length)))


def places(found: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand consecutively."""
    parts = phrase.split()
    fits = lambda i: F.array(*[F.get(found, i + k) for k in range(len(parts))]) == F.array(*map(F.lit, parts))
    at = F.when(F.size(found) >= len(parts), F.sequence(F.lit(0), F.size(found) - len(parts))).otherwise(F.array().cast("array<int>"))
    return F.filter(at, fits)


def labelled(found: Column, phrase: str, label: str) -> Column:
    return F.transform(places(found, phrase), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def may_stand(low: Column, phrase: str) -> Column:
    """Whether the phrase's words follow each other in lower-cased text, ends of words aside: needed for a place."""
    return low.rlike(GAPS.join(re.escape(w) for w in phrase.split()))


def containments(blocks: DataFrame, templates: Sequence[tuple[str, str]], freq: Mapping[str, int], threshold: float) -> DataFrame:
    """(ls_id, ls_hash, block, label, containment) of all pairs at or over the threshold.

    blocks: (ls_id, ls_hash, block, tokens) with distinct tokens. The templates are
    a parameter; their prefix index is a broadcast of a few rows each.
    """
    rank = lambda w: (freq.get(w, 0), w)
    vocab = sorted({w for t in template_tokens(templates) for w in t}, key=rank)
    index = []
    for t, tokens in enumerate(template_tokens(templates)):
        tokens = sorted(tokens, key=rank)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        index += [(w, t, templates[t][0], tokens, need, i) for i, w in enumerate(tokens[: len(tokens) - need + 1])]
    spark = blocks.sparkSession
    prefix = spark.createDataFrame(index, "tok string, t int, label string, wanted array<string>, need int, i int")
    # template tokens of the block in global order; tokens outside the vocabulary cannot match
    held = F.array_intersect(F.array(*map(F.lit, vocab)), "tokens")
    rows = blocks.select("ls_id", "ls_hash", "block", F.size("tokens").alias("n"), held.alias("held"))
    rows = rows.select("*", F.posexplode("held").alias("j", "tok"))
    pairs = rows.join(F.broadcast(prefix), "tok").where(F.col("n") >= F.col("need"))
    first = F.least(F.size("wanted") - F.col("i"), F.size("held") - F.col("j"))
    before = F.least("i", "j")
    pairs = pairs.where(first + before >= F.col("need"))
    share = F.size(F.array_intersect("held", "wanted"))
    return pairs.where(share >= F.col("need")).select("ls_id", "ls_hash", "block", "label", (share / F.size("wanted")).alias("containment"))


def scan_licenses(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_words, phrase places (array of start, label), template labels and best containment.

    A notice is found across line breaks and sentence ends within a paragraph if it
    stands in one and a half times the longest template's words; blank lines end it.
    Null text counts as empty: no words, no labels, score 0. Rows repeated with one
    id and text stay repeated with equal results; null ids are kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    vocab = sorted({w for t in template_tokens(templates) for w in t})
    each = docs.select(F.col(id_col).alias("ls_id"), F.xxhash64(text).alias("ls_hash"), text.alias("ls_text"), words(low).alias("w"))
    seen = F.array_intersect("w", F.array(*map(F.lit, vocab)))
    may = F.lit(False)
    for tokens in template_tokens(templates):
        may = may | (F.size(F.array_intersect("seen", F.array(*map(F.lit, tokens)))) >= math.ceil(threshold * len(tokens) - 1e-9))
    exact = words(F.translate("ls_text", UPPER, LOWER))
    low2 = F.lower("ls_text")
    each = each.withColumns({"seen": seen, "n_words": F.size("w").cast("long"), "named": F.array(*[may_stand(low2, p) for p in phrases])})
    each = each.withColumn("x", F.when(F.array_contains("named", True), exact).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<struct<start:int,label:string>>")
    base = [F.when(F.get("named", i), labelled(F.col("x"), p, label)).otherwise(none) for i, (p, label) in enumerate(phrases.items())]
    each = materialize(
        each.select("ls_id", "ls_hash", "n_words", "seen", F.concat(*base).alias("base"), F.when(may, F.col("ls_text")).alias("maybe")), "license_words"
    )
    counts = each.select(F.explode("seen").alias("tok")).groupBy("tok").agg(F.count("*").alias("n")).collect()  # a row per template token
    rows = each.where(F.col("maybe").isNotNull())
    lines = rows.select("ls_id", "ls_hash", F.explode(F.split("maybe", LINES)).alias("block"))
    lines = lines.withColumn("tokens", F.array_distinct(words(F.lower("block"))))
    spans = rows.select("ls_id", "ls_hash", F.explode(F.split("maybe", BLOCKS)).alias("part")).where(F.col("part").rlike(r"[\r\n]|[.!?]\s"))
    spans = spans.select("ls_id", "ls_hash", words(F.lower("part")).alias("w"))
    spans = spans.select("ls_id", "ls_hash", F.explode(runs(F.col("w"), run_length(templates))).alias("run"))
    blocks = lines.unionByName(spans.select("ls_id", "ls_hash", F.array_join("run", " ").alias("block"), F.array_distinct("run").alias("tokens")))
    found = containments(blocks, templates, {r.tok: r.n for r in counts}, threshold)
    found = found.groupBy("ls_id", "ls_hash").agg(F.collect_set("label").alias("labels"), F.max("containment").alias("score"))
    found = materialize(found.select(F.col("ls_id").alias("f_id"), F.col("ls_hash").alias("f_hash"), "labels", "score"), "license_labels")
    both = each.ls_id.eqNullSafe(found.f_id) & (each.ls_hash == found.f_hash)
    return each.join(found, both, "left").select(
        F.col("ls_id").alias(id_col), "n_words", "base", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
