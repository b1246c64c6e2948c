"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments. If a segment of n characters
stands in a text with at most e edits, n - q + 1 - q * e of its q-grams stand there on
diagonals at most e apart. So q-gram hits are counted in overlapping diagonal bands
of width 2e; regions that meet the bound go to a banded edit-distance alignment,
which decides.

Every verbatim quotation of SEGMENT + STEP - 1 = 79 normalised characters or more
holds a segment; of shorter ones, down to SEGMENT, some do, and of those under it none,
whole shorter items aside. An item under WHOLE characters ("yes", "the cat is") is no
evidence inside a text: it is found in documents that consist of it alone.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .common import fresh, materialize

Q = 8
SEGMENT = 64
STEP = 16
#: Edits allowed per character of a segment.
EDIT_RATE = 0.1
#: Normalised characters from which an item is looked for inside texts.
WHOLE = 2 * Q
#: Benchmark characters indexed at once; a larger benchmark is taken slice by slice. A slice's index takes some 70 bytes a character.
SLICE_CHARS = 2_000_000
BITS = 22
#: Diagonals of a text that are searched at once, and pairs of a place and an index entry that are counted at once.
BLOCK, ENTRIES = 1 << 14, 1 << 20
#: Regions of a block from which equal ones are looked for.
MANY = 200
#: Rows whose hits leave a task together.
ROWS = 500
#: Everything but a single space between letters or digits.
_GAP = re.compile(r"(?:[^\w ]|_)[\W_]*| [\W_]+")
HIT = ("item_id", "segment", "start", "distance")


def normalize(text: str | None) -> str:
    """Lower case, every run of other than letters and digits as one space."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def codes(text: str) -> np.ndarray:
    """Hash of each q-gram (Q is a power of two: pairs of halves are joined)."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    power, span = 0x9E3779B97F4A7C15, 1
    while span < Q and len(code) > span:
        code = code[:-span] * np.uint64(power) + code[span:]
        power, span = power * power % (1 << 64), span * 2
    return code if span == Q else code[:0]


def edits(n: int) -> int:
    """Edit budget of a segment; short ones get less, so that the bound stays positive."""
    return max(0, min(int(n * EDIT_RATE), (n - Q) // Q))


def slot(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - BITS)).astype(np.int64)


def best(hits: np.ndarray) -> np.ndarray:
    """Of the (segment, place, distance) in columns the best one of each segment in any SEGMENT characters, in order."""
    if hits.shape[1] < 2:
        return hits
    hits = hits[:, np.lexsort((hits[1], hits[2], hits[1] // SEGMENT, hits[0]))]
    new = np.ones(hits.shape[1], bool)
    new[1:] = (hits[0, 1:] != hits[0, :-1]) | (hits[1, 1:] // SEGMENT != hits[1, :-1] // SEGMENT)
    return hits[:, new]


class Index:
    """Segments of the items (item_id, text) with their q-grams."""

    def __init__(self, items: list[tuple[Any, str]]):
        self.segments: list[tuple[Any, int, str]] = []
        self.short: dict[str, list] = {}
        for item, raw in items:
            text = normalize(raw)
            if len(text) < WHOLE:
                if text:
                    self.short.setdefault(text, []).append(item)
                continue
            last = max(0, len(text) - SEGMENT)
            for at in sorted({*range(0, last, STEP), last}):
                self.segments.append((item, at, text[at : at + SEGMENT]))
        grams = [codes(s) for _, _, s in self.segments]
        code = np.concatenate([*grams, np.zeros(0, np.uint64)])
        seg = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
        size = np.array([len(s) for _, _, s in self.segments], np.int64)
        self.size, self.chars = size, np.full((len(size), SEGMENT), -2, np.int32)
        for n, (_, _, t) in enumerate(self.segments):
            self.chars[n, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.edits = np.array([edits(n) for n in size.tolist()], np.int64)
        self.need = size - Q + 1 - Q * self.edits
        # Each segment leaves out its most frequent q-grams, a quarter of those that it needs, and needs as many less:
        # the bound still holds, and the q-grams that most texts share are not looked up.
        place = slot(code)
        often = np.bincount(place, minlength=1 << BITS)[place]
        order = np.lexsort((-often, seg))
        rank = np.empty(len(seg), np.int64)
        rank[order] = np.arange(len(seg)) - np.searchsorted(seg[order], seg[order])
        spare = self.need // 4
        keep = rank >= spare[seg] if len(seg) else np.zeros(0, bool)
        self.need = self.need - spare
        place, seg, pos = place[keep], seg[keep], pos[keep]
        order = np.argsort(place, kind="stable")
        place, self.seg, self.pos = place[order], seg[order], pos[order]
        # entries by slot: two q-grams in one slot only add hits, which the alignment sorts out
        own, first, times = np.unique(place, return_index=True, return_counts=True)
        self.first, self.times, self.entry = np.append(0, first), np.append(0, times), np.zeros(1 << BITS, np.int32)
        self.entry[own] = np.arange(1, len(own) + 1)
        self.least = int(self.need.min()) if len(size) else 0
        self.most = int((size + self.edits).max()) if len(size) else 0
        self.width = max(1, int(self.edits.max())) if len(size) else 1

    def find(self, raw: str | None) -> list[tuple[Any, int, int, int]]:
        """(item_id, segment start, start in the normalised text, distance) of every segment in the text."""
        short, seg, place, distance = self.locate(raw)
        long = [(self.segments[s][0], self.segments[s][1], p, d) for s, p, d in zip(seg.tolist(), place.tolist(), distance.tolist())]
        return [(item, 0, 0, 0) for item in short] + long

    def locate(self, raw: str | None, first: bool = False) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """The short items that the text consists of, and segments, places and distances of the hits, each segment's best one in any SEGMENT characters.

        Diagonals are gone through BLOCK at a time, so that a text of any length, and one that
        repeats an item throughout, needs a bounded table. first: stop after a block with hits.
        """
        text = normalize(raw)
        short, nothing = list(self.short.get(text, ())), np.zeros((3, 0), np.int64)
        entry = self.entry[slot(codes(text))]
        at = np.flatnonzero(entry)
        if not self.least or len(at) < self.least or (at[self.least - 1 :] - at[: len(at) - self.least + 1]).min() >= self.most or (first and short):
            return short, *nothing
        chars, found = None, []
        block = BLOCK // self.width * self.width  # bands begin at the same places whatever the block
        for start in range(-SEGMENT, len(text), block):
            lo, hi = np.searchsorted(at, (start, start + block + SEGMENT + 2 * self.width)) if len(text) + SEGMENT > block else (0, len(at))
            seg, low = self.regions(at[lo:hi], entry[at[lo:hi]], start, block // self.width)
            if not len(seg):
                continue
            chars = self.padded(text) if chars is None else chars
            distance, place = self.align(seg, chars, low)
            good = distance <= self.edits[seg]
            if good.any():
                found.append(best(np.stack([seg[good], place[good], distance[good]])))
                if first:
                    break
        return short, *(best(np.concatenate(found, 1)) if len(found) > 1 else found[0] if found else nothing)

    def regions(self, at: np.ndarray, entry: np.ndarray, start: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
        """Segments and first diagonals of the bands that hold as many q-grams as the bound asks, of so many bands from the diagonal start on."""
        n = self.times[entry]
        first, ends = self.first[entry], np.cumsum(n)
        if not len(n):
            return n, n

        def pairs(own: slice) -> tuple[np.ndarray, np.ndarray]:
            m = n[own]
            take = np.repeat(first[own] - np.cumsum(m) + m, m) + np.arange(m.sum())
            band = (np.repeat(at[own], m) - self.pos[take] - start) // self.width
            key = self.seg[take] * (bands + 1) + band
            return np.unique(key[(band >= 0) & (band <= bands)], return_counts=True)

        if ends[-1] <= ENTRIES:
            key, count = pairs(slice(None))
        else:  # ENTRIES pairs of place and entry at once
            cuts = [0, *(np.flatnonzero(np.diff(ends // ENTRIES)) + 1).tolist(), len(n)]
            parts = [pairs(slice(a, b)) for a, b in itertools.pairwise(cuts)]
            key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            count = np.bincount(back, np.concatenate([c for _, c in parts]), len(key)).astype(np.int64)
        both = count.copy()  # a band and the next one: bands of double width that overlap by half
        both[:-1] += np.where((key[1:] == key[:-1] + 1) & (key[1:] % (bands + 1) > 0), count[1:], 0)
        seg, band = key // (bands + 1), key % (bands + 1)
        stays = (both >= self.need[seg]) & (band < bands)
        return seg[stays], band[stays] * self.width + start

    def padded(self, text: str) -> np.ndarray:
        """The text's characters with room on both sides: text position p is at p + the margin of align()."""
        wide = 4 * self.width + 1
        chars = np.full(len(text) + 2 * (SEGMENT + wide) + self.width, -1, np.int32)
        chars[SEGMENT + self.width :][: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return chars

    def align(self, seg: np.ndarray, chars: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each segment against any part of the text on the diagonals from start to start + 2 * width, give or take its edits; and the part's start.

        Where there are many, regions that read the same characters for the same segment are aligned once.
        """
        read = chars[(start + SEGMENT)[:, None] + np.arange(SEGMENT + 4 * self.width + 1)]  # all that a region's rows look at, from its lowest diagonal on
        if len(seg) < MANY:
            distance, offset = self.aligned(seg, read)
            return distance, np.maximum(start - self.width + offset, 0)
        own = np.concatenate([seg.astype(np.int32)[:, None], read], 1)
        _, one, back = np.unique(own.view(np.dtype((np.void, own.dtype.itemsize * own.shape[1]))).ravel(), return_index=True, return_inverse=True)
        distance, offset = self.aligned(seg[one], read[one])
        return distance[back], np.maximum(start - self.width + offset[back], 0)

    def aligned(self, seg: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each segment in the characters of its region, and the diagonal of its start.

        All regions go through the rows of the banded table together. A region whose
        every diagonal is over its limit leaves them; it has more edits than that.
        """
        wide = 4 * self.width + 1
        done, place = np.full(len(seg), SEGMENT + 1, np.int64), np.zeros(len(seg), np.int64)
        steps, live = np.arange(wide, dtype=np.int32), np.arange(len(seg))
        row = np.zeros((len(seg), wide), np.int32)  # cost on each diagonal before the first character: a start is free
        for i in range(int(self.size[seg].max(initial=0))):
            ended = self.size[seg[live]] == i
            if ended.any():
                done[live[ended]], place[live[ended]] = row[ended].min(1), row[ended].argmin(1)
                live, row = live[~ended], row[~ended]
            sub = row + (read[live, i : i + wide] != self.chars[seg[live], i][:, None])
            sub[:, :-1] = np.minimum(sub[:, :-1], row[:, 1:] + 1)  # a segment character is missing in the text
            row = np.minimum.accumulate(sub - steps, 1) + steps  # the text has characters more
            if i % 8 == 7:
                stays = row.min(1) <= self.edits[seg[live]]
                live, row = live[stays], row[stays]
            if not len(live):
                break
        if len(live):
            done[live], place[live] = row.min(1), row.argmin(1)
        return done, place


def _search(shared, kind: pa.DataType, name: str, first: bool):
    """Adds the hits in each batch's last column, the text, in its place."""
    fields = [pa.field(HIT[0], kind), *[pa.field(n, pa.int32()) for n in HIT[1:]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                *cols, text = batch.slice(at, ROWS).columns
                ends, items, rest = [0], [], []
                for t in text:
                    short, seg, place, distance = index.locate(t.as_py(), first)
                    if short or len(seg):
                        own = seg.tolist()
                        items += [*short, *[index.segments[s][0] for s in own]]
                        rest.append(np.concatenate([np.zeros((3, len(short)), np.int64), [[index.segments[s][1] for s in own], place, distance]], 1).astype(np.int32))
                    ends.append(len(items))
                parts = np.concatenate([*rest, np.zeros((3, 0), np.int32)], 1)
                found = pa.StructArray.from_arrays([pa.array(items, kind), *map(pa.array, parts)], fields=fields)
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], [*batch.schema.names[:-1], name])

    return run


def with_hits(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", hits_col: str = "dc_hits", slice_chars: int = SLICE_CHARS, first: bool = False
) -> DataFrame:
    """docs with the column hits_col: array of (item_id, segment, start, distance), the benchmark segments found in each text.

    One slice of the benchmark is indexed and broadcast at a time. With one slice a row
    only streams by; with more, each slice's pass over the texts writes the hits it
    found before the next begins, once for all rows of one text, and they are joined to the
    rows by the hash of the text. first: any hits of a text that has some, not all of them.
    """
    spark, item = docs.sparkSession, benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where(F.length("text") > 0)
    slices = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // slice_chars))
    held, kind = fresh(docs, "dc_text"), f"array<struct<item_id:{item},segment:int,start:int,distance:int>>"
    names = [F.col(f"`{c}`") for c in docs.columns]

    def search(rows: DataFrame, n: int):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == n).toArrow()  # about SLICE_CHARS
        shared = spark.sparkContext.broadcast(Index(list(zip(own.column(0).to_pylist(), own.column(1).to_pylist()))))
        schema = StructType(rows.schema.fields[:-1]).add(hits_col, DataType.fromDDL(kind))
        return rows.mapInArrow(_search(shared, own.schema.field(0).type, hits_col, first), schema), shared

    if slices == 1:
        return search(docs.select(*names, F.col(text_col).alias(held)), 0)[0]
    texts, parts = docs.select(F.xxhash64(text_col).alias("dc_hash"), F.col(text_col).alias(held)).where(F.length(text_col) > 0), []
    for n in range(slices):
        found, shared = search(texts, n)
        once = found.where(F.size(hits_col) > 0).groupBy("dc_hash").agg(F.first(hits_col).alias(hits_col))  # tasks send one row per text
        parts.append(materialize(once, "hits"))
        shared.destroy()
    every = functools.reduce(DataFrame.unionAll, parts).groupBy("dc_hash").agg(F.flatten(F.collect_list(hits_col)).alias(hits_col))  # a row per slice
    mark = fresh(docs, "dc_mark")
    every = every.withColumnRenamed("dc_hash", mark)
    both = docs.join(every, F.xxhash64(docs[text_col]) == F.col(mark), "left")
    return both.select(*[docs[f"`{c}`"] for c in docs.columns], F.coalesce(every[hits_col], F.array().cast(kind)).alias(hits_col))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per document: id, contaminated, hits (item, segment start, place in the normalised text, distance).

    Null and empty texts have no hits; null or empty items find nothing; an empty
    benchmark leaves every document clean. Item ids may be of any type. Repeated rows
    stay repeated; other columns are ignored.
    """
    rows = with_hits(docs.select(F.col(id_col), F.col(text_col).alias("dc_doc")), benchmark, "dc_doc", slice_chars=slice_chars)
    return rows.select(id_col, (F.size("dc_hits") > 0).alias("contaminated"), F.col("dc_hits").alias("hits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without hits, with all their columns, whatever their names.

    Null and empty texts, repeated rows and null ids stay; an empty benchmark drops
    nothing; an empty table gives an empty result.
    """
    hits = fresh(docs, "dc_hits")
    return with_hits(docs, benchmark, text_col, hits_col=hits, first=True).where(F.size(hits) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
