"""Substring deduplication with suffix automata of reference shards.

A word goes if a window of ``WINDOW`` words that covers it also starts in a document
with a smaller id. Equal windows have the same minimizer (the least-hashed shingle
of ``K`` words in them), so it routes every occurrence to one shard:

1. Each chunk of documents sends its minimizers, packed, to the tasks that own them;
   those seen in one document only drop out. A minimizer that a chunk holds in
   several documents is sent once, so frequent ones don't pile up.
2. The runs of windows that still have a shared minimizer go to its shard. Runs that
   are equal within a chunk go once, for the least id; the others are removed at
   once. Minimizers of over ``HOT_DOCS`` documents are split into their windows, each
   with a shard of its own, which is as exact, so that no shard grows with the table.
3. Tasks hold one shard at a time, whose rows come in order of id: each document is
   streamed through the suffix automaton of those before it, and positions whose
   matching statistic reaches ``WINDOW`` end a removed span; then its new runs join the
   automaton.

A document is known by its id and the hash of its text, so rows that share an id stay
apart.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

WINDOW = 13
K = 5
#: Documents that share a minimizer before its windows get shards of their own.
HOT_DOCS = 2000
#: Rows of the list of such minimizers that is broadcast; a longer one is joined by shuffle.
HOT_LIST = 100_000
#: Bytes of text whose minimizers one owner resolves at a time.
PART_BYTES = 64 << 20
PACKED = "part long, codes binary, ids binary, reps binary, counts binary, known_codes binary, known_ids binary"


class Automaton:
    """Suffix automaton over words of all strings added; strings are kept apart by a separator."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.last, self.marks = [-1], [0], 0, 0

    def push(self, c) -> None:
        nxt, link, size = self.next, self.link, self.len
        cur, p = len(nxt), self.last
        nxt.append({})
        size.append(size[p] + 1)
        link.append(0)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def add(self, words: list[bytes]) -> None:
        for w in words:
            self.push(w)
        self.marks += 1
        self.push(self.marks)  # no word equals a number

    def statistics(self, words: list[bytes]) -> Iterator[int]:
        """Length of the longest match that ends at each word."""
        state = size = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.len[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            yield size


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def minimizers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code, place) of the minimizer of each window; empty below WINDOW words."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    code, mul = h[: len(h) - K + 1].copy(), np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, K):
        code = code * mul + h[k : len(h) - K + 1 + k]
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xFF51AFD7ED558CCD)
    code ^= code >> np.uint64(29)
    place = np.lib.stride_tricks.sliding_window_view(code, WINDOW - K + 1).argmin(1) + np.arange(len(words) - WINDOW + 1)
    return code[place], place


def _announce(parts: int):
    """Chunks of documents -> packed minimizers for each owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.unique(minimizers(words_of(text.as_py()))[0])
                codes.append(own)
                ids.append(np.full(len(own), doc, np.int64))
            code, doc = np.concatenate([*codes, np.zeros(0, np.uint64)]), np.concatenate([*ids, np.zeros(0, np.int64)])
            order = np.argsort(code, kind="stable")
            code, doc = code[order], doc[order]
            first = np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1]))
            size = np.diff(np.concatenate((np.flatnonzero(first), [len(code)])))
            single = np.repeat(size == 1, size)
            part = (code % np.uint64(parts)).astype(np.int64)
            spread = ((code ^ doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)
            rep = first & ~single
            columns = {
                "codes": (part[single], code[single]), "ids": (part[single], doc[single]), "reps": (part[rep], code[rep]),
                "counts": (part[rep], size[size > 1]), "known_codes": (spread[~single], code[~single]), "known_ids": (spread[~single], doc[~single]),
            }
            met = np.unique(np.concatenate([p for p, _ in columns.values()]))  # no more rows than codes, however many parts
            cut = [pa.array(_cut(p, v, met), pa.binary()) for p, v in columns.values()]
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), *cut], ["part", *columns])

    return run


def _cut(part: np.ndarray, values: np.ndarray, met: np.ndarray) -> list[bytes]:
    """The values of each part in ``met``."""
    order = np.argsort(part, kind="stable")
    values, part = values[order], part[order]
    return [values[a:b].tobytes() for a, b in zip(np.searchsorted(part, met, "left").tolist(), np.searchsorted(part, met, "right").tolist())]


def _resolve(hot_docs: int):
    """Packed minimizers in order of their part -> (id, code) of those that are shared, and the codes over hot_docs under a null id.

    One part is held at a time.
    """

    def resolved(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        read = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        codes, ids, reps = read("codes", np.uint64), read("ids", np.int64), read("reps", np.uint64)
        every, place, times = np.unique(np.concatenate((codes, reps)), return_inverse=True, return_counts=True)
        docs = np.bincount(place, np.concatenate((np.ones(len(codes)), read("counts", np.int64))), len(every)) if len(every) else np.zeros(0)
        shared = times[place[: len(codes)]] > 1
        code = np.concatenate((codes[shared], read("known_codes", np.uint64)))
        doc = np.concatenate((ids[shared], read("known_ids", np.int64)))
        hot = every[docs > hot_docs]
        for at in range(0, len(code), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array(code[part].view(np.int64))], ["sd_id", "sd_code"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), pa.int64()), pa.array(hot.view(np.int64))], ["sd_id", "sd_code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, 64) for r in b.slice(at, 64).to_pylist())
        for _, own in itertools.groupby(rows, key=lambda r: r["part"]):
            yield from resolved(list(own))

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hash, text, shared codes, hot ones) -> rows for the shards, and spans that are removed for sure (null words)."""
    for batch in batches:
        least: dict[tuple[int, bytes], tuple[int, dict[int, list[int]]]] = {}
        out: list[tuple] = []
        for doc, mark, text, blobs, tops in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *[batch.column(i) for i in (2, 3, 4)]):
            words = words_of(text.as_py())
            code, place = minimizers(words)
            shared, hot = (np.isin(code, x.values.to_numpy().view(np.uint64)) for x in (blobs, tops))
            new = np.concatenate(([True], (place[1:] != place[:-1]) | hot[1:])) if len(place) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(place)) - 1 + WINDOW
            ends, starts = ends[shared[starts]], starts[shared[starts]]
            for a, b, key, one in zip(starts.tolist(), ends.tolist(), code[starts].tolist(), hot[starts].tolist()):
                run_words = b" ".join(words[a:b])
                key = xxhash.xxh64_intdigest(run_words) if one else key
                held = least.get((key, run_words))
                if held and held[0] == doc:
                    held[1].setdefault(mark, []).append(a)
                elif held and held[0] < doc:
                    out.append((_any_shard(key, doc), doc, mark, [a], b - a, None))
                else:
                    if held:
                        out += [(_any_shard(key, held[0]), held[0], m, at, b - a, None) for m, at in held[1].items()]
                    least[key, run_words] = (doc, {mark: [a]})
        out += [(key, doc, m, at, words.count(b" ") + 1, words) for (key, words), (doc, own) in least.items() for m, at in own.items()]
        cols = list(zip(*out)) or [()] * 6
        key = pa.array(np.array(cols[0], np.uint64).view(np.int64))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([key, *[pa.array(c, k) for c, k in zip(cols[1:], kinds)]], ["shard", "sd_id", "sd_hash", "starts", "size", "words"])


def _any_shard(key: int, doc: int) -> int:
    return (key ^ doc * 0x9E3779B97F4A7C15) % (1 << 64)


def shard_spans(rows: Iterable[tuple[int, int, list[int], bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """(id, hash, start, end) of the removed spans of one shard's runs (id, hash, starts, words), which come in order of id."""
    known: set[bytes] = set()
    automaton, waiting = Automaton(), []  # runs join the automaton when some other run is to be streamed
    for doc, group in itertools.groupby(rows, key=lambda r: r[0]):
        fresh: dict[bytes, list[bytes]] = {}
        for _, mark, starts, joined in group:
            words = joined.split(b" ")
            if joined in known:
                yield from ((doc, mark, s, s + len(words)) for s in starts)
                continue
            until, whole = -1, len(known) > 0
            if known:
                begin = 0
                while waiting:
                    automaton.add(waiting.pop())
                for i, size in enumerate(automaton.statistics(words)):
                    if size >= WINDOW:
                        if i - WINDOW + 1 > until and until >= 0:
                            yield from ((doc, mark, s + begin, s + until) for s in starts)
                        if until < 0 or i - WINDOW + 1 > until:
                            begin = i - WINDOW + 1
                        until = i + 1
                    elif i >= WINDOW - 1:
                        whole = False
                if until >= 0:
                    yield from ((doc, mark, s + begin, s + until) for s in starts)
            if not whole:
                fresh[joined] = words
        for joined, words in fresh.items():
            waiting.append(words)
            known.add(joined)


SPANS = ["sd_id", "sd_hash", "start", "stop"]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of (shard, id) -> spans; nothing but the automaton of the shard at hand is kept."""

    def rows() -> Iterator[tuple[int, int, int, list[int], int, bytes | None]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield from zip(*[c.to_pylist() for c in batch.slice(at, 2000).columns])

    def found() -> Iterator[tuple[int, int, int, int]]:
        for _, own in itertools.groupby(rows(), key=lambda r: r[0]):
            head = next(own)
            second = next(own, None)
            for r in (r for r in (head, second) if r and r[5] is None):
                yield from ((r[1], r[2], s, s + r[4]) for s in r[3])
            if second is None:
                continue  # nothing to compare with
            sure: list[tuple[int, int, int, int]] = []

            def rest() -> Iterator[tuple[int, int, list[int], bytes]]:
                for r in itertools.chain([x for x in (head, second) if x[5] is not None], own):
                    if r[5] is None:
                        sure.extend((r[1], r[2], s, s + r[4]) for s in r[3])
                    else:
                        yield r[1], r[2], r[3], r[5]

            yield from shard_spans(rest())
            yield from sure

    spans = found()
    while part := list(itertools.islice(spans, 1 << 14)):
        every = np.array(part, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(every[:, i]) for i in range(4)], SPANS)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, kept = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            words = words_of(text.as_py())
            drop = np.zeros(len(words) + 1, np.int64)
            for s in spans or ():
                drop[s["start"]] += 1
                drop[s["stop"]] -= 1
            out = np.cumsum(drop[:-1]) > 0
            total.append(len(words))
            gone.append(int(out.sum()))
            kept.append(b" ".join(itertools.compress(words, ~out)).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["sd_id", "n_words", "n_removed", "kept"])


def removed_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sd_id, sd_hash, spans): the removed spans, as word numbers, of the documents that have any.

    sd_hash is the xxhash64 of the text. Null ids and texts have none, an empty table
    gives an empty result; other columns are ignored.
    """
    rows = _keyed(docs, id_col, text_col).where(F.col("sd_id").isNotNull())
    size = rows.agg(F.sum(F.octet_length("sd_text"))).first()[0] or 0
    parts = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    owned = rows.select("sd_id", "sd_text").mapInArrow(_announce(parts), PACKED).repartition("part").sortWithinPartitions("part")
    shared = materialize(owned.mapInArrow(_resolve(HOT_DOCS), "sd_id long, sd_code long"), "minimizers")
    hot = shared.where("sd_id is null").select(F.col("sd_code").alias("hot_code"))
    hot = F.broadcast(hot) if hot.count() <= HOT_LIST else hot
    codes = shared.where("sd_id is not null").join(hot, F.col("sd_code") == F.col("hot_code"), "left")
    by_doc = codes.groupBy(F.col("sd_id").alias("sd_doc")).agg(F.collect_list("sd_code").alias("sd_codes"), F.collect_list("hot_code").alias("sd_hot"))
    met = rows.join(by_doc, rows.sd_id == by_doc.sd_doc).select("sd_id", "sd_hash", "sd_text", "sd_codes", "sd_hot")
    runs = met.mapInArrow(_runs, "shard long, sd_id long, sd_hash long, starts array<long>, size long, words binary")
    runs = runs.repartition("shard").sortWithinPartitions("shard", "sd_id")
    spans = runs.mapInArrow(_shards, "sd_id long, sd_hash long, start long, stop long")
    out = materialize(spans.groupBy("sd_id", "sd_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "removed")
    discard(shared)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("sd_id"), F.xxhash64(text).alias("sd_hash"), text.alias("sd_text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words that stay, joined by one space).

    Null text has no words. Ids are integers; a document with a null id is never a
    reference and keeps all its words. Rows that share an id are no references for each
    other, and each loses only what stands in a document with a smaller id. An empty
    table gives an empty result; other columns are ignored.
    """
    spans = removed_spans(docs, id_col, text_col)
    rows = _keyed(docs, id_col, text_col)
    both = rows.join(spans, ["sd_id", "sd_hash"], "left").select("sd_id", "sd_text", "spans")
    return both.mapInArrow(_keep, "sd_id long, n_words long, n_removed long, kept string").withColumnRenamed("sd_id", id_col)
