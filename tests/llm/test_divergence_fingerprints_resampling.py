"""Source divergence, document fingerprints and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from croplens.llm import divergence, fingerprints, queries, resampling

FOLDER = "/root/testdata/sf0.001"
EDGE = [None, "", " ", "é", "word " * 30_000, "same text here", "same text here", "Zürich x\x00y", "A1b2 ÀB", "a" * 400_000]


def table(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns under names that the operators use themselves."""
    rows = [(i, t, lang, source, "f", 3, "p", 7) for i, t, lang, source in zip(ids or range(1, len(texts) + 1), texts, langs or [None] * len(texts), sources or [None] * len(texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fingerprint string, n long, term string, weight long")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# 11
def plain_divergence(rows, min_docs=30, top=50):
    """All pairs and terms by the definition."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df, whole = Counter(t for _, _, ts in own for t in set(ts)), Counter(t for _, _, ts in own for t in ts)
        kept = {t for t, n in df.items() if n >= min_docs}
        count = {}
        for _, source, ts in own:
            count.setdefault(source, Counter()).update(t for t in ts if t in kept)
        share = lambda n, total: 1 + 1_000_000_000 * (n + 5) // (total + 5 * len(kept))  # noqa: E731, B023
        p = {s: {t: share(c[t], sum(c.values())) for t in kept} for s, c in count.items()}
        q = {t: share(whole[t], sum(whole[k] for k in kept)) for t in kept}
        for s in count:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count if o != s)
            out |= {(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)}
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:top], 1)}
    return out


@pytest.mark.parametrize("sizes", [(6, 32, 1024, 200_000), (2, 3, 4, 5), (0, 2, 5, 1), (99, 4, 8, 50)])
def test_divergence_equals_all_pairs(spark, monkeypatch, sizes):
    """Dense tiles only, sparse lists only, and both, with several tiles and blocks."""
    for name, value in zip(("RARE", "TILE", "TERMS", "FLUSH"), sizes):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(5)
    words = ["der", "Die", "und", "wÖrt", "x", "tail", *(f"t{chr(97 + k)}" for k in range(20))]
    rows = []
    for k in range(160):
        source = rng.choice(["a", "b", "c", "d", "é", "z", None, "lone"])
        some = words[: rng.randint(1, len(words))] if source != "lone" else words[:1]
        rows.append((" ".join(rng.choice(some) for _ in range(rng.randint(0, 30))) + rng.choice(["", " 12 ", "\x00und"]), rng.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "nulls"), ("", "xx", "a"), ("one", "xx", "b"), ("und und", "yy", "only"), ("Und " * 40_000, "en", "a"), rows[0], rows[0]]
    d = table(spark, [r[0] for r in rows], None, [r[1] for r in rows], [r[2] for r in rows])
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(d, min_docs=6, top=5).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, 6, 5)


def test_divergence_of_no_rows_and_of_rare_terms(spark):
    d = table(spark, ["a b", "b c"], None, ["en", "en"], ["s", "t"])
    assert divergence.audit(d.where("false")).count() == 0
    assert {tuple(r) for r in divergence.audit(d).collect()} == {("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)}


def test_shares_are_exact_for_counts_of_any_size(spark):
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(10**15, 3 * 10**17, 10**6), (0, 7, 3), (5, 0, 0)], "n long, total long, kept long")
    got = [r[0] for r in big.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (10**15 + 5) // (3 * 10**17 + 5 * 10**6), 1 + 10**9 * 5 // 22, 1]


# 12
def plain_classes(data):
    load = [round(k * math.log2(k) * (1 << 20)) if k else 0 for k in range(fingerprints.WINDOW + 1)]
    most = load[fingerprints.WINDOW]
    spans = (Counter(data[i : i + fingerprints.WINDOW]) for i in range(len(data) - fingerprints.WINDOW + 1))
    return [(fingerprints.CLASSES - 1) * (most - sum(load[n] for n in c.values())) // most for c in spans]


def plain_features(data, ranks):
    """Windows that are the leftmost rarest of POPULAR or more runs."""
    rank, wins = [int(ranks[c]) for c in plain_classes(data)], Counter()
    for j in range(len(rank)):
        run = rank[j : j + fingerprints.RUN]
        if min(run) < fingerprints.NEVER:
            wins[j + run.index(min(run))] += 1
    picked = [data[i : i + fingerprints.WINDOW] for i in sorted(wins) if wins[i] >= fingerprints.POPULAR] or ([data] if data else [])
    return list(dict.fromkeys(hashlib.blake2b(p, digest_size=8).digest() for p in picked))


def plain_chain(hashes):
    out = b""
    for at in range(0, len(hashes), fingerprints.FILL):
        bits = ["0"] * fingerprints.FILTER_BITS
        for h in hashes[at : at + fingerprints.FILL]:
            for k in range(fingerprints.BITS_EACH):
                bits[(int.from_bytes(h, "little") >> 11 * k) % fingerprints.FILTER_BITS] = "1"
        out += int("".join(bits), 2).to_bytes(fingerprints.FILTER_BITS // 8, "big")
    return out


def corpus(n=40):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 400))) + rng.choice(["", "-" * 90, "\n0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0"]) for _ in range(n)]
    return [*texts, *EDGE, texts[3], "short", "x" * 31, "x" * 32, "ab" * 40]


@pytest.mark.parametrize("piece", [1 << 16, 37, 64])
def test_features_equal_the_plain_version(monkeypatch, piece):
    monkeypatch.setattr(fingerprints, "PIECE", piece)
    texts = [(t or "").encode() for t in corpus(14) if len(t or "") < 2500]
    counts = sum((np.bincount(plain_classes(t), minlength=fingerprints.CLASSES) for t in texts if len(t) >= fingerprints.WINDOW), np.zeros(fingerprints.CLASSES, int))
    assert (fingerprints.class_counts(texts) == counts).all()
    ranks = np.random.default_rng(1).permutation(fingerprints.CLASSES).astype(np.int32)
    ranks[: fingerprints.LEAST_CLASS] = fingerprints.NEVER
    assert fingerprints.features(texts, ranks) == [plain_features(t, ranks) for t in texts]
    assert fingerprints.digests(texts, ranks) == [plain_chain(plain_features(t, ranks)) for t in texts]


def test_neighbours_equal_the_plain_version(spark):
    texts = [t for t in corpus() if len(t or "") < 3000]
    ids = [None, None, *range(-5, len(texts) - 9), 4, 4]
    d = table(spark, texts, ids[: len(texts)]).repartition(7)
    rows = sorted(((r.doc_id is not None, r.doc_id, h, r.text or "") for r, h in ((r, r.h) for r in d.selectExpr("*", "xxhash64(coalesce(text, '')) h").collect())), key=lambda r: (r[0], r[1] or 0, r[2]))
    ranks = fingerprints.rarity(d)
    prints = [plain_chain(plain_features(r[3].encode(), ranks)) for r in rows]
    want = []
    for k, (_, i, _, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][3]
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        changed = plain_chain(plain_features(new.encode(), ranks))
        nxt = prints[(k + 1) % len(rows)]
        want.append((i or 0, len(text), hashlib.sha256(new.encode()).hexdigest(), prints[k].hex(), changed.hex(), fingerprints.likeness(prints[k], changed), fingerprints.likeness(prints[k], nxt)))
    got = [(r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.neighbours(d).collect()]
    assert sorted(got) == sorted(want)
    assert {r.text: r.fingerprint for r in fingerprints.fingerprints(d, ranks=ranks).collect() if r.text} == {r[3]: p.hex() for r, p in zip(rows, prints) if r[3]}


def test_neighbours_of_few_and_edge_rows(spark):
    assert fingerprints.neighbours(table(spark, ["x"]).where("false")).count() == 0
    one = fingerprints.neighbours(table(spark, ["abcdefgh"])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0
    same = fingerprints.neighbours(table(spark, ["same"] * 300, [None] * 300)).collect()
    assert len(same) == 300 and {r.near_next for r in same} == {1.0}
    rows = {r.doc_id: r for r in fingerprints.neighbours(table(spark, EDGE)).collect()}
    assert sorted(rows) == list(range(1, len(EDGE) + 1)) and rows[6].fingerprint == rows[7].fingerprint and rows[1].fingerprint == "" and rows[5].n_chars == 150_000
    wide = fingerprints.fingerprints(table(spark, EDGE), out_col="fg_text")
    assert wide.columns[-1] == "fg_text" and wide.count() == len(EDGE)


def test_likeness_of_edited_and_other_texts(spark):
    rows = queries.op12_fingerprints(spark, FOLDER).where("n_chars > 400").collect()
    edited, following = [r.near_edited for r in rows], [r.near_next for r in rows]
    assert np.mean(edited) > 0.6 and np.mean([e > 0.4 for e in edited]) > 0.97 and np.median(following) < 0.1
    assert all(0 <= v <= 1 for v in edited + following)
    a, b = (fingerprints.chained([hashlib.blake2b(f"{s}{k}".encode(), digest_size=8).digest() for k in range(n)]) for s, n in (("a", 900), ("a", 300)))
    assert fingerprints.likeness(a, b) == fingerprints.likeness(b, a) > 0.8 and fingerprints.likeness(b"", a) == 0.0 and fingerprints.likeness(b"", b"") == 1.0


# 13
def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


@pytest.mark.parametrize("piece", [1 << 20, 7, 40])
def test_composed_crcs_equal_those_of_the_strings(monkeypatch, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    rng = random.Random(piece)
    for trial in range(40):
        text = "".join(rng.choice("abZ9é漢 \x00.-\n") for _ in range(rng.randint(0, 300))) + "long" * rng.choice([0, 900])
        words = [w.encode() for w in plain_words(text)]
        for n in (1, 2, 4):
            want = Counter(zlib.crc32(b" ".join(words[i : i + k])) for k in range(1, n + 1) for i in range(len(words) - k + 1))
            assert Counter(int(c) for crcs in resampling.gram_crcs(text.encode(), n) for c in crcs) == want, (trial, n)


def plain_scores(texts, ids, target, percent, max_n, buckets, min_words):
    grams = lambda text: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for w in [plain_words(text)] for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(b for x in texts for b in grams(x)), Counter(b for x in target for b in grams(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    rows = []
    for i, x in zip(ids, texts):
        f = grams(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // max(1, len(f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x)) >= min_words])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] if r[0] is not None else -99, r[2], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r.append(k)
    return sorted((tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in rows), key=repr)


def test_scores_equal_the_plain_version(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "Bb", "ccc", "é", "9", "ddd", "und", "the"]) + rng.choice(["", "x", "y"])
    texts = [*(" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(120)), *EDGE[:9], "the the " * 20]
    ids = [None, None, *range(len(texts) - 4), 5, 5]
    target = ["the und the", None, "", "Und THE x"]
    d, t = table(spark, texts, ids), spark.createDataFrame([(x,) for x in target], "text string")
    for percent, max_n, buckets, least in ((10, 1, 10_000, 20), (50, 2, 64, 5), (100, 3, 500, 0), (0, 1, 100, 1)):
        out = resampling.scores(d, t, percent, max_n=max_n, buckets=buckets, min_words=least)
        want = plain_scores(texts, ids, target, percent, max_n, buckets, least)
        assert sorted((tuple(r) for r in out.collect()), key=repr) == want, percent
        drawn = resampling.resample(d, t, percent, max_n=max_n, buckets=buckets, min_words=least)
        assert drawn.columns == d.columns and sorted((r.doc_id if r.doc_id is not None else -1) for r in drawn.collect()) == sorted((r[0] if r[0] is not None else -1) for r in want if r[4] is not None)
    assert resampling.scores(d.where("false"), t).count() == 0 and resampling.resample(d.where("false"), t).count() == 0
    assert resampling.scores(d, t.where("false")).count() == len(texts)


def test_resampling_draws_towards_the_target(spark):
    rng = random.Random(3)
    near, far = ["field", "water", "crop", "soil"], ["bank", "loan", "share", "stock"]
    texts = [" ".join(rng.choice(near if k % 4 == 0 else far) for _ in range(40)) for k in range(400)]
    target = spark.createDataFrame([(" ".join(rng.choice(near) for _ in range(30)),) for _ in range(50)], "text string")
    drawn = resampling.resample(table(spark, texts), target, 10, buckets=500)
    ids = [r.doc_id for r in drawn.collect()]
    assert len(ids) == 40 and sum((i - 1) % 4 == 0 for i in ids) > 30


@pytest.mark.parametrize("name", ["op11_divergence", "op13_resampling"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    found = con.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    want = sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) == want and len(want) > 100
    assert sorted(names) == sorted(df.columns)


def test_pairs_of_sources_are_symmetric(spark):
    rows = queries.op11_divergence(spark, FOLDER).where("part = 'pair'").collect()
    value = {(r.lang, r.source, r.item): r.value for r in rows}
    assert all(value[lang, b, a] == v for (lang, a, b), v in value.items())
    for lang in {r.lang for r in rows}:
        sources = {r.source for r in rows if r.lang == lang}
        assert all((lang, a, b) in value for a, b in combinations(sorted(sources), 2))
