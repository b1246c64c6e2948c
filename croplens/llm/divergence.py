"""Source divergence audit: how far the term shares of each source lie from those of the others.

Within a language every pair of sources is compared over all kept terms by the sum of
|p - q|. Terms are split by the number of sources that have them. A term with no
occurrence has the same share in a source whatever the term, so each pair starts from
(kept terms) x |base - base|. Frequent terms correct that in dense numpy tiles of
(sources x terms); rare terms correct it from their short posting lists, once for the
two sources alone and once for each pair that share the term. All sums are of integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MIN_DOCS = 30
TOP = 50
PRIOR = 5
UNIT = 1_000_000_000
#: Sources that may share a term for it to count as rare: at most 15 pairs a term.
RARE = 6
#: Sides of a dense tile, in sources and terms.
TILE, TERMS = 32, 1024
#: Distinct terms that a task counts before it sends them on.
FLUSH = 200_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
PIECE = 1 << 20


def text_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, lower-cased, in lists of about PIECE bytes: runs of a-z and non-ASCII."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def count_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs) of all rows, and a row with term '' for each group; sums of what tasks have counted."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, own) in groups.items():
                terms = [b"", *n]
                for at in range(0, len(terms), 50_000):
                    part = terms[at : at + 50_000]
                    cols = [[lang] * len(part), [source] * len(part), pa.array(part, pa.binary()).cast(pa.string()), [n[t] for t in part], [own[t] for t in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), None, pa.int64(), pa.int64()))], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3))):
                n, own = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in text_terms(text.as_py() or b""):
                    n.update(terms)
                    seen.update(terms)
                own.update(seen)
                held += len(n) - before
                if held > FLUSH or len(groups) > FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = docs.select(key(lang_col).alias("lang"), key(source_col).alias("source"), F.col(text_col).cast("binary").alias("text"))
    sent = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * kept)), exact for counts of any size; 1 where nothing is kept."""
    over = (total + PRIOR * kept).cast("decimal(19,0)")
    whole = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)"), F.when(over > 0, over))
    return F.coalesce(whole, F.lit(0)) + 1


def kept_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (lang, source, term, n, p, q, groups, ...) of kept terms that occur, and (lang, source, kept, rare, sources, base) of groups."""
    own = Window.partitionBy("lang", "term")
    counted = count_terms(docs, text_col, lang_col, source_col).withColumns(
        {"df": F.sum("docs").over(own), "lang_n": F.sum("n").over(own), "groups": F.count("*").over(own), "one": F.min("source").over(own) == F.col("source")}
    )
    counted = materialize(counted.where((F.col("df") >= min_docs) | (F.col("term") == "")).drop("df", "docs"), "counts")
    term = F.col("term") != ""
    groups = counted.groupBy("lang", "source").agg(
        F.sum(F.when(term, F.col("n")).otherwise(0)).alias("total"), F.count_if(term & F.col("one")).alias("new"),
        F.count_if(term & F.col("one") & (F.col("groups") > RARE)).alias("new_dense"),
    )
    groups = materialize(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("new").alias("kept"), F.sum("new_dense").alias("dense"), F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    groups = materialize(groups.drop("new", "new_dense").join(langs, "lang").withColumn("base", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))), "groups")
    rows = counted.where(term).join(groups, ["lang", "source"])
    rows = rows.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))})
    return materialize(rows.select("lang", "source", "term", "n", "p", "q", "groups", "dense", "sources", "base"), "kept"), groups


def tile_sums(tile: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, v) of the pairs of sources in a tile of one block of terms.

    kind 0: a source with its base share, and in block 0 the number of kept terms;
    kind 1: a dense term's share; kind 2: a share of n rare terms.
    """
    lang, block, i, j = tile["lang"].iat[0], tile["block"].iat[0], tile["i"].iat[0], tile["j"].iat[0]
    base = tile[tile["kind"] == 0].sort_values("source")
    names, own, b = base["source"].to_numpy(), base["tile"].to_numpy(), base["p"].to_numpy(np.int64)
    place = {s: k for k, s in enumerate(names)}
    gap = np.abs(b[:, None] - b[None, :])
    out = np.zeros((len(b), len(b)), np.int64)
    if block == 0:
        out += gap * base["n"].to_numpy(np.int64)[:, None]
        rare = tile[tile["kind"] == 2].sort_values("p")
        for source, part in rare.groupby("source", sort=False):  # the source's rare terms against the base of every other
            a, p, n = place[source], part["p"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
            count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * p)])
            k = np.searchsorted(p, b, "right")
            moved = b * count[k] - total[k] + (total[-1] - total[k]) - b * (count[-1] - count[k]) - count[-1] * gap[a]
            out[a] += moved
            out[:, a] += moved
    else:
        dense = tile[tile["kind"] == 1]
        at, terms = pd.factorize(dense["term"])
        x = np.repeat(b[:, None], len(terms), 1)
        x[dense["source"].map(place).to_numpy(), at] = dense["p"].to_numpy(np.int64)
        for a in range(len(b)):
            out[a] = np.abs(x - x[a]).sum(1)
        out -= gap * len(terms)
    a, c = np.nonzero(np.triu(np.ones_like(out), 1))
    if i != j:
        across = own[a] != own[c]
        a, c = a[across], c[across]
    return pd.DataFrame({"lang": lang, "a": names[a], "b": names[c], "v": out[a, c]})


def pair_sums(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, v) of every pair of sources a < b of a language: the sum of |p - q| over its kept terms."""
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    blocks = F.ceil(F.col("dense") / TERMS).cast("int")
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.greatest(n, F.lit(1))).cast("int")
    none = F.lit(None).cast("string")
    base = groups.select("lang", F.explode(F.sequence(F.lit(0), blocks)).alias("block"), F.lit(0).alias("kind"), "source", none.alias("term"), F.col("base").alias("p"), F.col("kept").alias("n"), tiles.alias("tiles"))
    dense = rows.where(F.col("groups") > RARE).select("lang", (spread("term", blocks) + 1).alias("block"), F.lit(1).alias("kind"), "source", "term", "p", F.lit(1).cast("long").alias("n"), tiles.alias("tiles"))
    few = rows.where(F.col("groups") <= RARE)
    rare = few.groupBy("lang", "source", "p", tiles.alias("tiles")).agg(F.count("*").alias("n"))
    rare = rare.select("lang", F.lit(0).alias("block"), F.lit(2).alias("kind"), "source", none.alias("term"), "p", "n", "tiles")
    placed = base.unionAll(dense).unionAll(rare).withColumn("tile", spread("source", F.col("tiles"))).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.withColumns({"i": F.least("tile", "t"), "j": F.greatest("tile", "t")}).drop("t", "tiles")
    whole = placed.groupBy("lang", "block", "i", "j").applyInPandas(tile_sums, "lang string, a string, b string, v long")
    lists = few.where(F.col("groups") > 1).groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "base"))).alias("l"))  # at most RARE entries
    both = F.flatten(F.transform("l", lambda x, k: F.transform(F.slice("l", k + 2, RARE), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    x, y = F.col("xy.x"), F.col("xy.y")
    moved = F.abs(x.p - y.p) - F.abs(x.p - y.base) - F.abs(y.p - x.base) + F.abs(x.base - y.base)
    shared = lists.select("lang", F.explode(both).alias("xy")).select("lang", x.source.alias("a"), y.source.alias("b"), moved.alias("v"))
    return whole.unionAll(shared).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance to the others of its language, and its most over-used terms.

    Part `pair` has a row per other source, part `term` up to top terms whose share in
    the source exceeds that in the language. Null texts, languages and sources count as
    ''; repeated rows count each; a language without kept terms has pairs of value 0; an
    empty table gives an empty result. Other columns of docs may have any name.
    """
    rows, groups = kept_terms(docs, text_col, lang_col, source_col, min_docs)
    found = pair_sums(rows, groups)
    pairs = found.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e"), F.col("v").alias("value"))
    pairs = pairs.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    over = rows.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionAll(over.withColumn("rank", rank).where(F.col("rank") <= top))
