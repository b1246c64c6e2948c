"""Runs planned from settings: what would be written, the writing itself, and a manifest of it."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators import rules
from . import settings as settings_file
from . import sinks


def rules_of(settings: Mapping[str, Any]) -> Mapping[str, Any]:
    """The checked rules of the settings, or the published ones where they name none."""
    return rules.checked(settings["postproc"]) if settings.get("postproc") else rules.PUBLISHED


def plan(spark: SparkSession, settings: Mapping[str, Any], states: Sequence[str] | None = None) -> DataFrame:
    """A row per state and year with threshold, steps, stamp (the last rule's text), survey of pivots, and whether the state is only copied.

    This is the whole of a dry run: nothing is read or written. States outside the
    settings are an error.
    """
    known = settings["run"]["states"]
    if odd := set(states or ()) - set(known):
        raise ValueError(f"states outside the run: {sorted(odd)}")
    return rules.rule_table(spark, rules_of(settings), states or known, settings["run"]["years"])


def pending(planned: DataFrame, folder: str) -> DataFrame:
    """The planned rows whose state and year folder does not hold yet."""
    try:
        there = planned.sparkSession.read.parquet(folder).select("state", "year").distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return planned
    return planned.join(there, ["state", "year"], "left_anti")


def execute(stack: DataFrame, settings: Mapping[str, Any], folder: str, states: Sequence[str] | None = None) -> DataFrame:
    """Refines stack (state, year and the rules' inputs) and writes the states and years that folder lacks; returns the manifest's rows.

    One job whose plan does not grow with the run: the stack is scanned once and joined
    with the rows that are pending, at most one per state and year of the settings.
    """
    spark = stack.sparkSession
    planned = plan(spark, settings, states)
    rows = pending(planned, folder).collect()
    todo = spark.createDataFrame(rows, planned.schema)
    sinks.write_missing(rules.refine(stack, todo, rules_of(settings)), folder, ["state", "year"])
    return todo.select("state", "year", "stamp")


def manifest(settings: dict[str, Any], code: str, at: str) -> str:
    """JSON of the settings, their digest, the code's version and the time; the digest hangs on the settings alone."""
    return json.dumps({"settings": settings, "digest": settings_file.digest(settings), "code": code, "at": at}, sort_keys=True, indent=1)


def write_manifest(spark: SparkSession, text: str, path: str) -> None:
    """One JSON file's worth of lines in a new folder; an existing one is an error."""
    sinks.write_lines(spark.createDataFrame([(text,)], "t string").coalesce(1), "t", path)
