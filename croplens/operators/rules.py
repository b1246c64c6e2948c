"""Year rules that refine a class map, step by step, as CASE expressions.

Rules are settings: by state a threshold by year, and steps of an expression text over
IRR, SUM, NDVI, SLOPE, PIVOT and the threshold {t}, each from a year on. A pixel that
fits no arm keeps its class. Each step sees the IRR of the step before it; the other
columns keep their first values. Steep irrigated pixels become class 3.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import expressions as E

T = "{t}"
INPUTS = ("IRR", "SUM", "NDVI", "SLOPE", "PIVOT")
NAMES = (*INPUTS, T)

#: Arms of the published steps, as (conditions, class).
GREEN_BUT_DRY = ((("IRR", "==", 1), ("NDVI", ">", 0.75), ("SUM", ">", T)), 0)
SELDOM = ((("IRR", "==", 0), ("SUM", "<", T)), 1)
RESCUE = ((("IRR", "!=", 0), ("NDVI", ">", 0.68), ("PIVOT", "==", 1), ("SUM", ">", T)), 0)


def steep(limit: int):
    return (("IRR", "==", 0), ("SLOPE", ">", limit)), 3


PLAIN_10 = (0, (GREEN_BUT_DRY, SELDOM, steep(10)))
PLAIN_4 = (0, (GREEN_BUT_DRY, SELDOM, steep(4)))
#: By state, the threshold as (before, switch year, horizon) and the steps as (first year, arms); without steps a state is copied.
STATES: dict[str, tuple[tuple[int, int, int], tuple]] = {
    "AZ": ((0, 9999, 9999), ()),
    "CA": ((5, 2016, 2021), (PLAIN_10, (2012, (RESCUE,)))),
    "CO": ((5, 2016, 2025), (PLAIN_4,)),
    "ID": (
        (5, 9999, 9999),
        (
            (0, (((("IRR", "==", 0), ("NDVI", "<", 0.68), ("SUM", ">", T)), 1), ((("IRR", "!=", 0), ("NDVI", ">", 0.75), ("SUM", ">", T)), 0), SELDOM)),
            (0, (steep(6),)),
            (2011, (RESCUE,)),
        ),
    ),
    "MT": ((6, 9999, 9999), (PLAIN_10, (2008, (((("IRR", "!=", 0), ("NDVI", ">", 0.68), ("PIVOT", "==", 1)), 0),)))),
    "NM": ((5, 2016, 2025), (PLAIN_10, (2012, (RESCUE,)))),
    "NV": ((5, 2016, 2025), (PLAIN_10, (2012, (RESCUE,)))),
    "OR": ((5, 2016, 2025), (PLAIN_10, (2012, (RESCUE,)))),
    "UT": ((5, 2016, 2025), (PLAIN_4,)),
    "WA": ((5, 2016, 2025), (PLAIN_10, (2012, (RESCUE,)))),
    "WY": ((5, 2016, 2025), (PLAIN_4,)),
}
#: Years from which another survey of pivots is used in MT.
PIVOT_VINTAGES = ((2010, "2009"), (2012, "2011"), (2014, "2013"), (2019, "2015"))
LAST_VINTAGE = "2019"
KEYS = {"copy_only", "threshold", "pivot_assets", "steps"}


def text_of(arms: tuple) -> str:
    """The step as a chain of conditions, as settings and stamps have it."""
    return "".join(f"{' && '.join(f'({name} {sign} {value})' for name, sign, value in when)} ? {then}: " for when, then in arms) + "IRR"


def published() -> dict[str, Any]:
    """The rules of STATES as a section of settings."""
    out: dict[str, Any] = {}
    for state, ((before, switch, horizon), steps) in STATES.items():
        limit = {"type": "fixed", "value": before} if switch == 9999 else {"type": "ramp", "before": before, "switch_year": switch, "horizon": horizon}
        vintages = [*({"before": y, "asset": f"pivots_{v}"} for y, v in PIVOT_VINTAGES), {"asset": f"pivots_{LAST_VINTAGE}"}] if state == "MT" else [{"asset": "pivots"}]
        texts = [{"expression": text_of(arms), "variables": [n for n in INPUTS if n in {w[0] for when, _ in arms for w in when}]} | ({"min_year": first} if first else {}) for first, arms in steps]
        out[state] = {"threshold": limit, "pivot_assets": vintages, "steps": texts} if steps else {"copy_only": True}
    return out


PUBLISHED = published()


def checked(rules: Mapping[str, Any]) -> Mapping[str, Any]:
    """The rules of all states, after every key, threshold, survey and expression has been looked at; a fault is an error that names the state."""
    for state, own in rules.items():
        wrong = lambda what, state=state: ValueError(f"rules of {state}: {what}")
        if odd := set(own) - KEYS:
            raise wrong(f"unknown {sorted(odd)}")
        if own.get("copy_only"):
            if len(own) > 1:
                raise wrong("a copied state has no other keys")
            continue
        limit = own.get("threshold", {})
        wanted = {"fixed": {"type", "value"}, "ramp": {"type", "before", "switch_year", "horizon"}}.get(limit.get("type"))
        if wanted is None or set(limit) != wanted:
            raise wrong("the threshold is fixed with a value, or a ramp with before, switch_year and horizon")
        if not own.get("steps"):
            raise wrong("no steps")
        for step in own["steps"]:
            if not {"expression", "variables"} <= set(step) <= {"expression", "variables", "min_year"}:
                raise wrong(f"keys of a step: {sorted(step)}")
            if odd := set(step["variables"]) - set(INPUTS):
                raise wrong(f"unknown variables {sorted(odd)}")
            try:
                E.to_sql(step["expression"], {*step["variables"], T})
            except ValueError as e:
                raise wrong(str(e)) from e
        if not own.get("pivot_assets") or any(not set(p) <= {"before", "asset"} or "asset" not in p for p in own["pivot_assets"]):
            raise wrong("pivot_assets are entries of an asset and the year it ends before")
    return rules


def threshold(state: str, year: int, rules: Mapping[str, Any] = PUBLISHED) -> int:
    limit = rules[state].get("threshold", {"type": "fixed", "value": 0})
    if limit["type"] == "fixed":
        return limit["value"]
    return max(0, limit["before"] if year < limit["switch_year"] else limit["horizon"] - year - 1)


def steps_in(state: str, year: int, rules: Mapping[str, Any] = PUBLISHED) -> list[str | None]:
    """The text of each step, threshold open; None for one that does not apply in the year."""
    return [s["expression"] if year >= s.get("min_year", year) else None for s in rules[state].get("steps", ())]


def expressions(state: str, year: int, rules: Mapping[str, Any] = PUBLISHED) -> list[str]:
    """The texts of the steps that apply in a year, the threshold filled in."""
    return [text.replace(T, str(threshold(state, year, rules))) for text in steps_in(state, year, rules) if text is not None]


def pivots(state: str, year: int, rules: Mapping[str, Any] = PUBLISHED) -> str | None:
    """The survey of pivots that a year uses: the first that does not end before it."""
    return next((p["asset"] for p in rules[state].get("pivot_assets", ()) if year < p.get("before", year + 1)), None)


def postprocess(stack: DataFrame, state: str, year: int, else_on_null: bool = False, rules: Mapping[str, Any] = PUBLISHED) -> DataFrame:
    """stack (with IRR, SUM, NDVI, SLOPE, PIVOT) with IRR refined by the state's steps; null where a column that a step reads is null, unless else_on_null."""
    for text in expressions(state, year, rules):
        stack = stack.withColumn("IRR", E.column(text, INPUTS, else_on_null))
    return stack


def slots(rules: Mapping[str, Any]) -> list[list[str]]:
    """The different texts of the first, second, ... steps of all states."""
    texts = [[s["expression"] for s in own.get("steps", ())] for own in rules.values()]
    return [sorted({t[k] for t in texts if k < len(t)}) for k in range(max(map(len, texts), default=0))]


def rule_table(spark: SparkSession, rules: Mapping[str, Any], states: Iterable[str], years: Sequence[int]) -> DataFrame:
    """(state, year, t, forms, steps, stamp, pivots, copied) for every state and year; forms has the place of each step's text in slots(), null where it does not apply."""
    known, rows = slots(rules), []
    for state in states:
        for year in map(int, years):
            texts, filled = steps_in(state, year, rules), expressions(state, year, rules)
            forms = [None if text is None else known[k].index(text) for k, text in enumerate(texts)]
            rows.append((state, year, threshold(state, year, rules), forms, len(filled), filled[-1] if filled else None, pivots(state, year, rules), not texts))
    return spark.createDataFrame(rows, "state string, year int, t int, forms array<int>, steps int, stamp string, pivots string, copied boolean")


def refine(stack: DataFrame, table: DataFrame, rules: Mapping[str, Any] = PUBLISHED, else_on_null: bool = False) -> DataFrame:
    """The rows of stack (state, year and INPUTS) whose state and year are in a rule_table(), IRR refined by their own steps.

    The table is joined for the threshold and the steps in use, one CASE over the different
    texts for each place, so the plan is the same for any number of states and years.
    The broadcast has a row per state and year of a run.
    """
    own = F.broadcast(table.select("state", "year", F.col("t").alias("t"), F.col("forms").alias("ru_forms")))
    out, names = stack.drop("t").join(own, ["state", "year"]), [c for c in stack.columns if c != "t"]
    for k, texts in enumerate(slots(rules)):
        done: Column = F.col("IRR")
        for n, text in enumerate(texts):
            done = F.when(F.get("ru_forms", F.lit(k)) == n, E.column(text, NAMES, else_on_null)).otherwise(done)
        out = out.withColumn("IRR", done)
    return out.select(*names)
