"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, divergence, exact_dedup, fingerprints, language_id, license_scan, packing, resampling,
    secret_scan, simhash_dedup, substring_dedup, url_filter, warc_writer,
)

#: The URL rules of op2, as (verdict, host and path).
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return found.select(
        "doc_id", "contaminated", F.size("hits").cast("long").alias("n_hits"), F.array_join(items, ",").alias("item_ids"),
        F.array_min(F.transform("hits", lambda h: h["distance"])).cast("long").alias("min_distance"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
        secret_scan.joined(F.concat("base", "random")).alias("spans"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc_writer.roundtrip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["start"])
    names = F.array_distinct(F.transform("base", lambda b: b["label"]))
    listed = lambda labels: F.array_join(F.array_sort(labels), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), listed(names).alias("base_labels"),
        listed(F.array_union(names, F.col("labels"))).alias("labels"), F.greatest("score", F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, max_n=1)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_url_filter, op3_exact_dedup, op4_secret_scan, op5_language_id,
        op6_substring_dedup, op7_warc, op8_license_scan, op9_simhash, op10_packing,
        op11_divergence, op12_fingerprints, op13_resampling,
    )
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _op2_sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    arms = lambda pick: " ".join(
        f"WHEN {fits(*_parts(rule))} THEN '{pick(said, rule)}'" for said, rule in sorted(URL_RULES, key=lambda r: -len(r[1]))
    )
    address = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    judged = lambda url: (
        f"translate(coalesce(regexp_extract({url}, '{address}', 1), ''), {_LOWER}) AS host, coalesce(regexp_extract({url}, '{address}', 2), '') AS path"
    )
    said, rule = f"CASE {arms(lambda s, r: s)} END", f"CASE {arms(lambda s, r: r)} END"
    return rf"""
WITH RECURSIVE raw AS (
  SELECT url, {_decoded(r"regexp_extract(regexp_extract(html, '(?is)(<base\b[^>]*[\s\"''/]href\s*=[^>]*>)', 1), '(?is)[\s\"''/]href\s*=\s*[\"'']?([^\"''\s>]+)', 1)")} AS base,
    {_decoded(r"""unnest([
      regexp_extract(regexp_extract(html, '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1), '(?is)[\s"''/]href\s*=\s*["'']?([^"''\s>]+)', 1),
      regexp_extract(regexp_extract(html, '(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)])""")} AS t
  FROM pages),
found AS (SELECT split_part(url, '#', 1) AS u, t, coalesce(CASE WHEN length(base) > 0 THEN {_resolved("url", "base")} END, url) AS stand FROM raw WHERE length(t) > 0),
edges AS (SELECT u, split_part({_resolved("stand", "t")}, '#', 1) AS v FROM found),
both_ways AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach(a, b) AS (SELECT u, u FROM both_ways UNION SELECT reach.a, both_ways.v FROM reach JOIN both_ways ON reach.b = both_ways.u),
nodes AS (SELECT b, {judged('b')} FROM (SELECT DISTINCT b FROM reach)),
sides AS (SELECT b, {said} AS said FROM nodes),
carried AS (SELECT a, CASE WHEN bool_or(said = 'block') AND NOT coalesce(bool_or(said = 'allow'), false) THEN 'block' ELSE 'allow' END AS said FROM reach JOIN sides USING (b) GROUP BY a),
judged AS (SELECT page_id, split_part(url, '#', 1) AS node, {judged('url')} FROM pages)
SELECT page_id, host, path, {rule} AS rule, coalesce({said}, carried.said, 'allow') AS verdict
FROM judged LEFT JOIN carried ON judged.node = carried.a
"""


def _decoded(value: str) -> str:
    """SQL of a value with the most usual entities decoded, & last."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        value = f"replace({value}, '{entity}', '{sign}')"
    return value


def _resolved(base: str, to: str) -> str:
    """SQL of a link target on a page, null where it has no address."""
    part = lambda pattern, of=base: f"coalesce(regexp_extract({of}, '(?s){pattern}', 1), '')"
    scheme, host = part("^(.*?:)//"), part("^.*?:(//[^/?#]*)")
    path, query = part("^.*?://[^/?#]*([^?#]*)"), part(r"^.*?://[^/?#]*[^?#]*(\?[^#]*)")
    asked, rest = part("^([^?#]*)", to), part("^[^?#]*(.*)$", to)
    steps = f"string_split(CASE WHEN {to} LIKE '/%' THEN {asked} ELSE {part('^(.*)/', path)} || '/' || {asked} END, '/')[2:]"
    walked = f"list_reduce(list_prepend([]::VARCHAR[], list_transform({steps}, lambda x: [x])), lambda a, s: CASE WHEN s[1] = '..' THEN a[:-2] WHEN s[1] = '.' THEN a ELSE a || s END)"
    last = f"CASE WHEN len({walked}) > 0 AND ({steps})[-1] IN ('.', '..') THEN '/' ELSE '' END"
    return f"""CASE WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {to} END
      WHEN {host} = '' THEN NULL WHEN {to} LIKE '//%' THEN {scheme} || {to}
      WHEN {asked} = '' THEN {scheme} || {host} || {path} || CASE WHEN {to} LIKE '?%' THEN {rest} ELSE {query} END
      ELSE {scheme} || {host} || '/' || array_to_string({walked}, '/') || {last} || {rest} END"""


def _parts(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, "/" + path


SQL = {
    "op2_url_filter": _op2_sql(),
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op6_substring_dedup": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM docs, unnest(range(1, greatest(len(ws) - 11, 1))) AS t(i)),
firsts AS (SELECT g, min(doc_id) AS lo FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (g), range(13) AS r(k) WHERE lo < doc_id),
words AS (SELECT doc_id, p, ws[p] AS w FROM docs, unnest(range(1, len(ws) + 1)) AS t(p)),
left_over AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT docs.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (doc_id)
""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, strlen(body) AS payload_bytes, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
""",
    "op11_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
words AS (SELECT r, lang, source, unnest(ts) AS t FROM d),
kept AS (SELECT lang, t, count(*) AS c FROM words GROUP BY lang, t HAVING count(DISTINCT r) >= 30),
seen AS (SELECT lang, source, t, count(*) AS c FROM words SEMI JOIN kept USING (lang, t) GROUP BY lang, source, t),
pairs AS (SELECT DISTINCT lang, source FROM d),
vs AS (SELECT lang, count(t) AS v, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
ns AS (SELECT pairs.lang, pairs.source, coalesce(sum(c), 0) AS n FROM pairs LEFT JOIN seen USING (lang, source) GROUP BY ALL),
p AS (SELECT ns.lang, ns.source, kept.t, coalesce(seen.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(seen.c, 0) + 5)) // (ns.n + 5 * vs.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (kept.c + 5)) // (vs.n + 5 * vs.v)::HUGEINT AS q
  FROM ns JOIN vs USING (lang) JOIN kept USING (lang) LEFT JOIN seen ON seen.lang = ns.lang AND seen.source = ns.source AND seen.t = kept.t),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', t, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM rows QUALIFY part = 'pair' OR rank <= 50
""",
    "op13_resampling": rf"""
WITH bits AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS crcs FROM range(256) AS t(i)),
split AS (SELECT row_number() OVER () AS r, 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT row_number() OVER (), 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
words AS (SELECT r, side, unnest(ws) AS w FROM split),
hexes AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM words),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
  lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexes, bits),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN hashed USING (w) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
means AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN means USING (r) WHERE side = 'd'),
ranks AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN k END AS rank FROM ranks
""",
}
