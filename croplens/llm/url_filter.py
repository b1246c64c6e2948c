"""URL rules with verdicts carried over redirect and canonical-link equivalence.

Longest matching (host, path) rule decides first. Pages without a rule take the
verdict of their alias component: allow if any address in it has an allow rule
(explicit allow precedence), else block if any has a block rule, else allow.
Components come from a distributed star algorithm over link edges; a page without
links is its own component.
"""

from __future__ import annotations

import html.entities
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?canonical\b"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?is)[\s\"'/]href\s*=\s*[\"']?([^\"'\s>]+)"
BASE = r"(?is)[\s\"'/]href\s*="
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def first_tag(body: Column, name: str, wanted: str) -> Column:
    """The first whole tag of a name that holds a pattern, else null.

    Tags are cut out in one pass: one that is never closed reaches to the end of the page,
    so no character is looked at from more than one beginning.
    """
    tags = F.regexp_extract_all(body, F.lit(rf"(?is)<{name}\b[^>]*+>?"), F.lit(0))
    return F.get(F.filter(tags, lambda t: t.endswith(">") & t.rlike(wanted)), 0)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def pick_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does. rules: (verdict, host + path)."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def node_of(url: Column) -> Column:
    """Address without fragment, the name of a node."""
    return F.substring_index(url, "#", 1)


_PARTS = re.compile(r"^(.*?:)(//[^/?#]*)([^?#]*)(\?[^#]*)?", re.S)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_ENTITY = re.compile(r"&(#[xX][0-9a-fA-F]++;?|#[0-9]++;?|[A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))")


def unescaped(value: str) -> str:
    """An attribute's value with its entities decoded; a name without semicolon only if no letter, digit or = follows."""
    return _ENTITY.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] in html.entities.html5 else m[0], value)


def without_dots(path: str) -> str:
    """The path with its . and .. segments carried out."""
    out: list[str] = []
    parts = path.split("/")[1:]
    for p in parts:
        if p == "..":
            out = out[:-1]
        elif p != ".":
            out.append(p)
    return "/" + "/".join([*out, ""] if out and parts[-1] in (".", "..") else out)


def resolve(base: str | None, target: str) -> str | None:
    """The address of a target on a page, written as its base is; None where it has none (no base, or javascript: and such)."""
    if scheme := _SCHEME.match(target):
        return target if target.startswith("//", scheme.end()) else None
    if not (m := _PARTS.match(base or "")):
        return None
    scheme, host, path, query = m.groups("")
    if target.startswith("//"):
        return scheme + target
    to, mark, rest = re.fullmatch(r"(?s)([^?#]*)([?#]?)(.*)", target).groups()
    if not to:
        return scheme + host + path + (mark + rest if mark == "?" else query)
    if not to.startswith("/"):
        to = (path.rpartition("/")[0] if path else "") + "/" + to
    return scheme + host + without_dots(to) + mark + rest


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for own, url, base, to in zip(*[c.to_pylist() for c in batch.columns]):
            at = (resolve(url, unescaped(base)) if base else None) or url
            found.append((own, resolve(at, unescaped(to))))
        found = [(u, v.partition("#")[0]) for u, v in found if v is not None]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["u", "v"])


def link_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Edges (u, v) between a page's address and its canonical or refresh target.

    Targets are unescaped and resolved against the page's <base> or its url; those
    without an address (relative ones on a page without, javascript:) are no edges.
    """
    url, body = F.col(url_col), F.col(html_col)
    part = lambda name, wanted, value: F.coalesce(F.regexp_extract(first_tag(body, name, wanted), value, 1), F.lit(""))
    canonical, refresh = part("link", CANONICAL, HREF), part("meta", REFRESH, TARGET)
    base = F.when(F.length(canonical) + F.length(refresh) > 0, part("base", BASE, HREF))
    found = pages.select(node_of(url).alias("u"), url.alias("o"), base.alias("b"), F.explode(F.array(canonical, refresh)).alias("to"))
    return found.where(F.length("to") > 0).mapInArrow(_resolved, "u string, v string")


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    Null urls and urls without ``://`` have empty host and path, match no rule and
    belong to no component unless they carry links. Repeated rows stay repeated; an
    empty table gives an empty result. rules is a short parameter list, not data.
    """
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rule, verdict = pick_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(id_col), node_of(url).alias("uf_node"), host.alias("host"), path.alias("path"))
    judged = judged.withColumns({"rule": rule, "uf_own": verdict})
    edges = materialize(link_edges(pages, url_col, html_col), "url_links")
    roots = materialize(connected_components(edges), "url_roots")
    _, said = pick_rule(F.col("h"), F.col("p"), rules)
    nodes = roots.select("node", "root", host_of(F.col("node")).alias("h"), path_of(F.col("node")).alias("p")).withColumn("said", said)
    decided = nodes.groupBy("root").agg(F.bool_or(F.col("said") == "allow").alias("ok"), F.bool_or(F.col("said") == "block").alias("bad"))
    decided = materialize(decided, "url_components")
    carried = materialize(roots.join(decided, "root").select("node", F.expr("if(coalesce(bad, false) and not coalesce(ok, false), 'block', 'allow')").alias("uf_said")), "url_verdicts")
    discard(edges, roots, decided)
    return judged.join(carried, judged.uf_node == carried.node, "left").select(
        id_col, "host", "path", "rule", F.coalesce("uf_own", "uf_said", F.lit("allow")).alias("verdict")
    )
