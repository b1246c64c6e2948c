"""Sequence packing planned by non-negative least squares.

Documents are tokenised chunk by chunk inside each task, no shuffle. Whole windows
are cut off first. The tails' lengths form a histogram of ``BINS`` bins; shallow
combinations of bins that fill a window are enumerated, non-negative least squares
gives how often to use each, and the rounded plan is filled. Residual tails are cut
greedily into the gaps and then into new windows; the last tokens of a chunk are cut
at powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
BINS = 16
DEPTH = 3
#: Tokens planned together in a task; bounds its memory.
CHUNK_TOKENS = 4_000_000
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Fixed value: how the byte-level vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def tokenizer_file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def added_tokens(path: str) -> list[dict]:
    """The file's added tokens; those that take spaces with them or need a word's edges are refused, not misread."""
    found = [t for t in tokenizer_file(path).get("added_tokens") or [] if t["content"]]
    if odd := [t["content"] for t in found if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]:
        raise ValueError(f"added tokens with single_word, lstrip or rstrip: {odd}")
    return found


@functools.cache
def encoding(path: str):
    """The byte-level BPE of a tokenizers file as a tiktoken encoding: equal ids, several times as fast.

    The file writes each byte as a printable character: printable bytes as
    themselves, the others as 256, 257, ... in order.
    """
    import tiktoken

    vocab = tokenizer_file(path)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    own = {t["content"] for t in added_tokens(path)}
    ranks = {bytes(byte_of[c] for c in word): n for word, n in vocab.items() if word not in own and all(c in byte_of for c in word)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space that the pattern's search cannot take at once: it remembers every character of a run.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def ordinary_encoder(path: str):
    """Text without added tokens to ids; of a long run of white space all but the last character, or at the text's end the whole, is one piece of the pattern."""
    enc = encoding(path)

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for m in _LONG_SPACE.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += enc.encode_ordinary(text[at : m.start()]) + enc._encode_single_piece(text[m.start() : end])
            at = end
        return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)

    return encode


@functools.cache
def encoder(path: str):
    """Text to ids: texts are split at the file's added tokens, the longest first, and the parts between are encoded alone."""
    ordinary, ids = ordinary_encoder(path), {t["content"]: t["id"] for t in added_tokens(path)}
    if not ids:
        return ordinary
    marker = re.compile("|".join(re.escape(t) for t in sorted(ids, key=len, reverse=True)))

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for m in marker.finditer(text):
            out += [*ordinary(text[at : m.start()]), ids[m[0]]]
            at = m.end()
        return out + ordinary(text[at:]) if at else ordinary(text)

    return encode


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 that makes |ax - b| least, by coordinate descent."""
    gram, rhs, x = a.T @ a, a.T @ b, np.zeros(a.shape[1])
    for _ in range(rounds):
        before = x.copy()
        for j in range(len(x)):
            x[j] = max(0.0, x[j] + (rhs[j] - gram[j] @ x) / gram[j, j])
        if np.abs(x - before).max(initial=0) < 1e-3:
            break
    return x


@functools.cache
def combinations(bins: int = BINS, depth: int = DEPTH) -> tuple[tuple[int, ...], ...]:
    """Multisets of at most depth bins whose upper lengths add up to a window."""
    return tuple(c for k in range(1, depth + 1) for c in itertools.combinations_with_replacement(range(1, bins + 1), k) if sum(c) == bins)


def plan(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document number, start, length) that hold every token of every document once."""
    out: list[list[tuple[int, int, int]]] = []
    for n in np.flatnonzero(lengths >= window).tolist():
        out += [[(n, s, window)] for s in range(0, int(lengths[n]) - window + 1, window)]
    tails = lengths % window
    unit = window // BINS
    bins = -(-tails // unit)
    stacks = {k: np.flatnonzero(bins == k).tolist() for k in range(1, BINS + 1)}
    combos = combinations()
    a = np.zeros((BINS, len(combos)))
    for j, c in enumerate(combos):
        for k in c:
            a[k - 1, j] += 1
    times = np.floor(nnls(a, np.array([len(stacks[k]) for k in range(1, BINS + 1)], float)) + 1e-6).astype(int)
    piece = lambda n: (n, int(lengths[n] - tails[n]), int(tails[n]))
    planned = []
    for c, t in zip(combos, times.tolist()):
        for _ in range(t):
            if all(len(stacks[k]) >= c.count(k) for k in c):
                planned.append([piece(stacks[k].pop()) for k in c])
    rest = [piece(n) for k in range(BINS, 0, -1) for n in stacks[k]]
    spare, gaps = sum(p[2] for p in rest), sum(window - sum(p[2] for p in s) for s in planned)
    while planned and gaps > spare:  # too little left to fill the gaps: give up a planned sequence
        s = planned.pop()
        held = sum(p[2] for p in s)
        rest, spare, gaps = rest + s, spare + held, gaps - (window - held)
    rest.reverse()

    def fill(seq: list[tuple[int, int, int]], room: int) -> list[tuple[int, int, int]]:
        while room and rest:
            n, s, size = rest.pop()
            take = min(size, room)
            seq.append((n, s, take))
            room -= take
            if take < size:
                rest.append((n, s + take, size - take))
        return seq

    for s in planned:
        out.append(fill(s, window - sum(p[2] for p in s)))
    left = sum(p[2] for p in rest)
    while left:
        room = min(window, 1 << (left.bit_length() - 1))
        out.append(fill([], room))
        left -= room
    return out


def _pack(path: str, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, number = encoder(path), (TaskContext.get().partitionId() if TaskContext.get() else 0), 0
        held: list[np.ndarray] = []
        keys: list[pa.Array] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            lengths = np.array([len(h) for h in held], np.int64)
            rows = []
            for seq in plan(lengths):
                at = 0
                for n, s, size in seq:
                    rows.append((n, s, size, zlib.crc32(held[n][s : s + size].astype("<u4").tobytes()), lengths[n], (task << 32) + number, at))
                    at += size
                number += 1
            cols = list(zip(*rows))
            doc = pa.concat_arrays(keys).take(pa.array(cols[0], pa.int64()))
            return pa.RecordBatch.from_arrays([doc, *[pa.array(c, pa.int64()) for c in cols[1:]]], [id_name, *[c.split()[0] for c in SCHEMA.split(", ")]])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [np.array([*encode(t or ""), END_ID], np.uint32) for t in part.column(1).to_pylist()]
                held += got
                keys.append(part.column(0))
                tokens += sum(map(len, got))
                if tokens >= CHUNK_TOKENS:
                    yield flush()
                    held, keys, tokens = [], [], 0
        if held:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends in END_ID, so null and empty texts have one token. Repeated
    rows are packed each, so pieces of rows that share an id stand side by side; null
    ids are kept; an empty table gives an empty result; other columns are ignored.
    Texts of any length are encoded whole. sequence_id is unique, not dense.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("pk_id"), F.col(text_col).alias("pk_text")).mapInArrow(_pack(tokenizer, "pk_id"), f"pk_id {kind}, {SCHEMA}")
    return rows.withColumnRenamed("pk_id", id_col)
