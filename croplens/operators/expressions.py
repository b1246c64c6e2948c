"""Class expressions of a run's settings, as columns.

A text such as ``(IRR == 0) && (SUM < {t}) ? 1: IRR`` is turned into Spark SQL word by
word, its choices into CASE, and Spark parses that. Only listed names are let through.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*|\{[A-Za-z_]\w*\})|(?P<sign>&&|\|\||==|!=|<=|>=|[<>?:()+*/-]))")
SQL = {"&&": "AND", "||": "OR", "==": "=", "!=": "<>"}


def words(text: str, names: Collection[str]) -> list[tuple[str, str]]:
    """(kind, word) of a text; a name that is not listed and a sign that no expression has are errors."""
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        found = WORD.match(text, at)
        if not found:
            raise ValueError(f"no word of an expression at {at} in {text!r}")
        kind, word, at = found.lastgroup, found[found.lastgroup], found.end()
        if kind == "name" and word not in names:
            raise ValueError(f"unknown name {word} in {text!r}")
        out.append((kind, word))
    return out


def choice(given: list[tuple[str, str]], at: int) -> tuple[str, int]:
    """SQL of the value, or of the chain of choices, that begins at a word, and where it ends."""
    sql, full = [], False  # full: what stands there is a whole value
    while at < len(given) and given[at][1] not in ("?", ":", ")"):
        kind, word = given[at]
        if kind != "sign" or word == "(":
            if full:
                raise ValueError(f"no sign before {word}")
            if word == "(":
                inner, at = choice(given, at + 1)
                if at == len(given) or given[at][1] != ")":
                    raise ValueError("a bracket is not closed")
                word = f"({inner})"
            elif kind == "number":
                word += "D" * ("." in word)
            else:
                word = f"`{word.strip('{}')}`"
            full = True
        elif full:
            word, full = SQL.get(word, word), False
        elif word != "-":
            raise ValueError(f"no value before {word}")
        sql.append(word)
        at += 1
    if not full:
        raise ValueError("a value is missing")
    if at < len(given) and given[at][1] == "?":
        yes, at = choice(given, at + 1)
        if at == len(given) or given[at][1] != ":":
            raise ValueError("a choice lacks its second value")
        no, at = choice(given, at + 1)
        return f"CASE WHEN {' '.join(sql)} THEN {yes} ELSE {no} END", at
    return " ".join(sql), at


def to_sql(text: str, names: Collection[str]) -> str:
    given = words(text, names)
    sql, at = choice(given, 0)
    if at < len(given):
        raise ValueError(f"{given[at][1]} is one too many in {text!r}")
    return sql


def column(text: str, names: Collection[str], else_on_null: bool = False) -> Column:
    """The text as a column over the columns it names, {t} being column t; null where one of those is null, unless else_on_null."""
    sql, used = F.expr(to_sql(text, names)), {w.strip("{}") for k, w in words(text, names) if k == "name"}
    if else_on_null or not used:
        return sql
    return F.when(reduce(operator.and_, [F.col(f"`{name}`").isNotNull() for name in sorted(used)]), sql)
