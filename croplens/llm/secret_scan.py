"""Secret scan: fixed patterns plus a randomness test battery (built-in functions only).

Long alphanumeric runs are read in the encoding that their characters imply (hex,
base32 or base64). Each gets a chi-squared test of alphabet uniformity, a runs test
about the alphabet's middle and a lag-1 serial-correlation test; Fisher's method
combines the three into one p-value p of the hypothesis "uniformly random".

A run is reported if p is at least ALPHA and at least its class's limit. Classes are
(encoding, length): lengths from 2**k to 2**(k+1) - 1 are one. Of m random runs,
m (1 - t) have a p over t; m is estimated, a standard error upwards, from the number
of runs with p over a half. What a class has over t beyond that counts as false alarms. Its limit is the least
t at which that excess is within FDR of the runs over t, so the estimated share of
non-random runs among the reported ones is held at FDR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
RUN = r"([A-Za-z0-9+/_-]{20,})"
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Least length at which the battery has power, by encoding.
LEAST = {"hex": 32, "base32": 26, "base64": 24}
#: Share of false alarms among the reported runs of a class.
FDR = 0.05
#: Runs with a smaller p are never reported, however few their class has: so is this share of the random ones.
ALPHA = 0.01
#: Bins of p, by quarter-powers of two; the last holds all under 2**-10, which ALPHA leaves out.
BINS = 40
#: Spans of a text that are gathered before they join the rest.
PART = 256
SPAN = "array<struct<start:int,stop:int,kind:int,text:string>>"


def spans(text: Column, pattern: str, kind: int, least: int, value: int = 2) -> Column:
    """Leftmost matches of pattern (its group 1) whose group ``value - 1`` has the least length, with code-point spans.

    Each match is taken with the gap before it, so positions are running sums of
    lengths; ``\\G`` keeps the engine from starting anew inside the last gap.
    """
    whole = F.lit(r"(?s)\G(.*?)" + pattern)
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"),
        F.regexp_extract_all(text, whole, F.lit(2)).alias("hit"),
        F.regexp_extract_all(text, whole, F.lit(value)).alias("val"),
    )
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("pos"), F.array(none).alias("done"), none.alias("part"))  # spans in parts of PART, so that adding one copies few

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        one = F.struct(begin.alias("start"), end.alias("stop"), F.lit(kind).alias("kind"), x["hit"].alias("text"))
        long, full = F.length(x["val"]) >= least, F.size(acc["part"]) >= PART
        part = F.when(~long, acc["part"]).when(full, F.array(one)).otherwise(F.array_append(acc["part"], one))
        return F.struct(end.alias("pos"), F.when(long & full, F.array_append(acc["done"], acc["part"])).otherwise(acc["done"]).alias("done"), part.alias("part"))

    return F.aggregate(zipped, start, step, lambda acc: F.flatten(F.array_append(acc["done"], acc["part"])))


def tail(z: Column) -> Column:
    """Upper normal tail, by the logistic approximation of the normal distribution."""
    z = F.least(F.greatest(z, F.lit(-6.0)), F.lit(6.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(z * 1.5976 + z * z * z * 0.07056))


def encoding_of(token: Column) -> Column:
    """Null for runs of one letter case only or of digits only: words and numbers, no encoding."""
    return (
        F.when(token.rlike("^(?:[a-z]+|[A-Z]+|[0-9]+|[A-Z][a-z]+|[-_/+]+)$"), None)
        .when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .otherwise(F.when(token.rlike("[0-9]") & token.rlike("[A-Za-z]"), "base64"))
    )


def battery(token: Column, encoding: Column) -> Column:
    """Fisher-combined p-value of the three tests."""
    alphabet = (
        F.when(encoding == "hex", "0123456789abcdef")
        .when(encoding == "base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
        .otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    )
    same = F.when(encoding == "hex", F.lower(token)).otherwise(F.translate(token, "-_", "+/"))
    k = F.length(alphabet).cast("double")
    without = lambda text, part: F.length(text) - F.length(F.replace(text, part, F.lit("")))

    def counted(text: Column) -> Column:
        """What the sums are made of: length, count of each symbol, symbols of the upper half, changes of half, products of neighbours, first and last code."""
        code = lambda c: (F.instr(alphabet, c) - 1).cast("double")
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("last"))
        lag = lambda acc, c: let(code(c), lambda v: F.struct((acc["sum"] + acc["last"] * v).alias("sum"), v.alias("last")))
        halves = F.call_function("translate", text, alphabet, F.concat(F.repeat(F.lit("l"), (k / 2).cast("int")), F.repeat(F.lit("h"), (k / 2).cast("int"))))
        sides = let(halves, lambda h: F.struct(without(h, F.lit("h")).alias("high"), ((without(h, F.lit("lh")) + without(h, F.lit("hl"))) / 2).alias("turns")))
        return F.struct(
            F.length(text).cast("double").alias("n"), F.transform(F.split(alphabet, ""), lambda c: without(text, c).cast("double")).alias("counts"), sides.alias("sides"),
            F.aggregate(F.split(text, ""), start, lag, lambda acc: acc["sum"]).alias("products"), code(F.substring(text, 1, 1)).alias("first"), code(F.substring(text, -1, 1)).alias("final"),
        )

    def summed(x: Column) -> Column:
        over = lambda f: F.aggregate(F.transform(x["counts"], f), F.lit(0.0), lambda a, v: a + v)
        n = x["n"]

        def around(total: Column) -> Column:
            centre = total / n
            return F.struct(
                n.alias("n"), (k - 1).alias("df"), (over(lambda c: c * c) * k / n - n).alias("chi"),
                x["sides"]["high"].cast("double").alias("high"), (x["sides"]["turns"] + 1.0).alias("runs"),
                over(lambda c, i: c * (i - centre) * (i - centre)).alias("power"),
                (x["products"] - centre * (total * 2 - x["first"] - x["final"]) + (n - 1) * centre * centre).alias("lagged"),
            )

        return let(over(lambda c, i: c * i), around)

    def tests(s: Column) -> Column:
        ninth = F.lit(2.0) / (s["df"] * 9)
        chi_z = (F.pow(F.greatest(s["chi"], F.lit(0.0)) / s["df"], F.lit(1 / 3)) - 1 + ninth) / F.sqrt(ninth)
        mean = s["high"] * (s["n"] - s["high"]) * 2 / s["n"] + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (s["n"] - 1), F.lit(1e-9)))
        serial = s["lagged"] / F.greatest(s["power"], F.lit(1e-9)) * F.sqrt(s["n"])
        zs = F.array(chi_z, F.abs((s["runs"] - mean) / spread), F.abs(serial))
        ps = F.transform(zs, lambda z, i: F.log(F.least(tail(z) * F.when(i == 0, 1.0).otherwise(2.0), F.lit(1.0))))
        half = -F.aggregate(ps, F.lit(0.0), lambda a, p: a + p)  # half of Fisher's statistic, which has six degrees of freedom
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return let(same, lambda text: let(counted(text), lambda x: let(summed(x), tests)))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def limits(tests: DataFrame, fdr: float) -> DataFrame:
    """(class, limit) from (class, p): least p that is reported; one aggregate of at most BINS + 1 rows a class."""
    binned = tests.select("class", F.least(F.floor(-F.log2(F.greatest("p", F.lit(1e-9))) * 4), F.lit(BINS)).cast("int").alias("bin"))
    held = binned.groupBy("class", "bin").agg(F.count("*").alias("n"))
    every = held.select("class").distinct().select("class", F.explode(F.sequence(F.lit(0), F.lit(BINS))).alias("bin")).join(held, ["class", "bin"], "left")
    whole = Window.partitionBy("class")
    half = F.sum(F.when(F.col("bin") < 4, F.col("n"))).over(whole)  # bins 0 to 3: p over a half
    over = every.withColumns({"over": F.coalesce(F.sum("n").over(whole.orderBy("bin")), F.lit(0)), "half": F.coalesce(half, F.lit(0))})
    random, edge = 2 * (F.col("half") + F.sqrt("half") + 1), F.pow(F.lit(2.0), -(F.col("bin") + 1) / 4)  # bin b holds p over 2 ** (-(b + 1) / 4)
    fits = F.col("over") - random * (1 - edge) <= F.col("over") * fdr
    return over.groupBy("class").agg(F.coalesce(F.min(F.when(fits, edge)), F.lit(1.0)).alias("limit"))


def joined(found: Column) -> Column:
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: id, base spans, random spans (arrays of start, stop, kind, text).

    Null text counts as empty and has no spans. Repeated rows and null ids stay; an
    empty table gives an empty result; other columns are ignored. The limits of the
    randomness battery come from every run of the table, so what else a table holds
    can change a run's verdict, but never that of a run under ALPHA.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "api"):
        named = named | low.contains(word)
    none = F.array().cast(SPAN)
    assign = F.when(named, spans(text, ASSIGN, 0, 8, 3)).otherwise(none)
    access = F.when(text.contains("AKIA"), spans(text, ACCESS, 1, 16)).otherwise(none)
    hexes = F.when(text.rlike("[0-9a-f]{32}"), spans(text, HEX.replace("+", "{32,}"), 2, 32)).otherwise(none)
    runs = F.when(text.rlike("[A-Za-z0-9+/_-]{20}"), spans(text, RUN, 3, 20)).otherwise(none)
    enc = F.transform(runs, lambda s: F.struct(s.alias("span"), encoding_of(s["text"]).alias("enc")))
    least = F.create_map(*[F.lit(x) for pair in LEAST.items() for x in pair])
    enc = F.filter(enc, lambda s: s["enc"].isNotNull() & (F.length(s["span"]["text"]) >= F.element_at(least, s["enc"])))

    def measured(s: Column) -> Column:
        cls = F.concat(s["enc"], F.lit("-"), F.floor(F.log2(F.length(s["span"]["text"]).cast("double"))).cast("string"))
        return F.struct(s["span"].alias("span"), cls.alias("class"), battery(s["span"]["text"], s["enc"]).alias("p"))

    each = docs.select(F.col(id_col).alias("ss_id"), F.concat(assign, access, hexes).alias("base"), F.transform(enc, measured).alias("runs"))
    each = materialize(each, "spans")
    found = limits(each.select(F.explode("runs").alias("r")).select("r.class", "r.p"), fdr).collect()  # a row per class, under 100
    limit = F.create_map(*[F.lit(x) for r in found for x in (r["class"], r["limit"])]) if found else F.create_map().cast("map<string,double>")
    stays = lambda r: (r["p"] >= ALPHA) & (r["p"] >= F.try_element_at(limit, r["class"]))
    return each.select(F.col("ss_id").alias(id_col), "base", F.transform(F.filter("runs", stays), lambda r: r["span"]).alias("random"))
