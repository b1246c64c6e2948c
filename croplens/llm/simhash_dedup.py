"""SimHash near-duplicates found with BK-trees.

Fingerprints that differ in at most ``radius`` bits agree on some choice of blocks
(pigeonhole), so one shard tree per agreeing block value sees every link. A shard
over the cap is divided by further blocks; what stays over it is cut in pieces, and
each piece and each pair of pieces gets a tree of its own: nothing is capped or dropped.
A pair's tree gives only what joins groups of its two pieces, so links stay in
proportion to the fingerprints, however dense a family is. A tree's
children are keyed by their integer Hamming distance to the parent and a search
follows only edges within the radius of the distance to the node.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, drop_rows, materialize, row_hash

RADIUS = 4
SHINGLE = 4
#: Fingerprints in one shard tree before the shard is divided.
SHARD_CAP = 1024
#: Rows of a list of divided shards that is broadcast; a longer one is joined by shuffle.
MAX_HOT = 50_000


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the k-word shingles; 0 without words, one shingle below k words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    if len(words) >= k:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        part = [h(joined[s:e], 42) for s, e in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    over = np.packbits(total * 2 > len(starts), bitorder="little")
    return int(over.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64))], ["sh_id", "sh_hash", "fp"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sh_id, sh_hash, fp): id, hash of the whole row, and the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("sh_id"), row_hash(docs).alias("sh_hash"), F.col(text_col).alias("sh_text"))
    return rows.mapInArrow(_fingerprints, f"sh_id {kind}, sh_hash long, fp long")


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks such that two prints within the radius agree on at least one; more blocks as n grows.

    radius + j blocks, of which any j are tried: a shard of evenly spread bits then holds about 256 prints
    or fewer, up to a million million prints, where j ends at 4.
    """
    for j in itertools.count(1):
        blocks = radius + j
        cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
        if n >> (min(b - a for a, b in itertools.pairwise(cuts)) * j) <= 256 or j == 4:
            break
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(parts, j)]


def tree_links(prints: list[int], sides: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join every two prints within the radius, found with one BK-tree; of two pieces (sides 0 and 1) only those needed between the groups that each has of its own."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    children: list[dict[int, int]] = [{} for _ in prints]
    across = array("q")
    for i in range(1, len(prints)):
        x, todo, place = prints[i], [0], 0
        while todo:
            node = todo.pop()
            d = (prints[node] ^ x).bit_count()
            if d <= radius:
                a, b = find(node), find(i)
                if sides[node] == sides[i]:
                    root[max(a, b)] = min(a, b)
                elif a != b:
                    across.extend((node, i))
            todo += [c for e, c in children[node].items() if d - radius <= e <= d + radius]
        while (c := children[place].setdefault((prints[place] ^ x).bit_count(), i)) != i:
            place = c
    if len(set(sides)) == 1:
        return [(prints[i], prints[find(i)]) for i in range(len(prints)) if find(i) != i]
    out = []
    for i, j in zip(across[::2], across[1::2]):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((prints[i], prints[j]))
    return out


def _shard_links(radius: int):
    """Rows (shard, fp, side) in order -> links; one shard is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            found: list[tuple[int, int]] = []
            shard, fp, side = nothing if batch is None else (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy())
            cuts = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(fp)])).tolist()
            for a, b in itertools.pairwise(cuts):
                if a == b or shard[a] != key:
                    own, first = np.unique(np.concatenate([h[0] for h in held] or [nothing[1]]), return_index=True)
                    if len(own) > 1:
                        found += tree_links(own.tolist(), np.concatenate([h[1] for h in held])[first].tolist(), radius)
                    held, key = [], shard[a] if a < b else None
                held.append((fp[a:b], side[a:b]))
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["u", "v"])

    return run


def sub_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks over the bits outside ``mask``, cut in radius + 2 blocks of which two prints within the radius agree on two."""
    free = [i for i in range(64) if not mask >> i & 1]
    blocks = [sum(1 << i for i in free[k :: radius + 2]) for k in range(radius + 2)]
    return [a | b for a, b in itertools.combinations(blocks, 2)]


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def marked(rows: DataFrame, keys: list[str], cap: int, name: str) -> DataFrame:
    """rows with the column ``name``: the size of their group where it is over the cap, else null.

    The list of such groups is broadcast while it has at most MAX_HOT rows and joined by shuffle beyond.
    """
    hot = materialize(rows.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > cap), "hot")
    return rows.join(F.broadcast(hot) if hot.count() <= MAX_HOT else hot, keys, "left")


def links(prints: DataFrame, radius: int = RADIUS, cap: int = SHARD_CAP) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (column fp) whose components are those of all links.

    A shard of over ``cap`` prints is divided by further blocks of its own; what is
    still over the cap is cut in pieces, and each pair of pieces is searched.
    """
    masks = block_masks(prints.count(), radius)
    under = lambda masks: F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("v")) for i, m in enumerate(masks)])
    rows = marked(prints.select("fp", F.explode(under(masks)).alias("s")).select("fp", "s.c", "s.v"), ["c", "v"], cap, "n")
    whole = F.array(F.struct(F.lit(-1).alias("c"), F.lit(0).cast("long").alias("v")))
    further = whole
    for i, m in enumerate(masks):
        further = F.when(F.col("n").isNotNull() & (F.col("c") == i), under(sub_masks(m, radius))).otherwise(further)
    rows = rows.select("fp", "c", "v", F.explode(further).alias("s")).select("fp", "c", "v", F.col("s.c").alias("c2"), F.col("s.v").alias("v2"))
    rows = marked(rows.where("c2 >= 0"), ["c", "v", "c2", "v2"], cap, "n").unionByName(rows.where("c2 < 0").withColumn("n", F.lit(None).cast("long")))
    pieces = F.ceil(F.col("n") / cap).cast("int")
    cut = rows.withColumn("pieces", pieces).withColumn("p", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"), F.lit(0)))
    other = F.expr("if(pieces is null, array(0), sequence(0, pieces - 1))")
    pairs = cut.select("c", "v", "c2", "v2", "fp", "p", F.explode(other).alias("q"))
    two = (F.col("p") != F.col("q")).cast("long")  # in the last bit: shards of one piece and of two never share a hash
    shard = F.shiftleft(F.xxhash64("c", "v", "c2", "v2", F.least("p", "q"), F.greatest("p", "q")), 1).bitwiseOR(two).alias("shard")
    rows = pairs.select(shard, "fp", (F.col("p") > F.col("q")).cast("long").alias("side"))
    return rows.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_shard_links(radius), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    component_id is the least id reachable over links of at most ``radius`` differing
    bits. Null and blank texts have fingerprint zero and link like any other; rows
    with a null id get the component of their fingerprint. Repeated rows give
    repeated rows; an empty table an empty result; other columns are ignored.
    """
    each = materialize(with_fingerprints(docs.select(id_col, text_col), id_col, text_col), "fingerprints")
    member = component_map(each, radius)
    return each.join(member, "fp").select(
        F.col("sh_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def component_map(each: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) for the distinct fingerprints of (sh_id, fp); root is the component's least fingerprint."""
    prints = materialize(each.groupBy("fp").agg(F.min("sh_id").alias("first_id")), "prints")
    edges = materialize(links(prints, radius), "links")
    roots = materialize(connected_components(edges), "roots")
    rooted = materialize(
        prints.join(roots, prints.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    member = materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "members")
    discard(prints, edges, roots, rooted, least)
    return member


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of docs per component, with all its columns: that with the least id, null ids after all others.

    Null and blank texts are one group. Of rows that share the least id, that with the
    greatest hash stays, and of wholly equal rows one; a row whose text is near no
    other stays whatever its id. An empty table gives an empty result; columns may
    have any names.
    """
    each = materialize(with_fingerprints(docs, id_col, text_col), "fingerprints")
    member = component_map(each, radius)
    groups = each.join(member, "fp").select(F.col("sh_id").alias("id"), F.col("sh_hash").alias("hash"), F.col("sh_id").eqNullSafe(F.col("component_id")).alias("kept"), "root")
    kept = drop_rows(docs, id_col, groups, ["root"])
    discard(each, member)
    return kept
