"""Run settings in TOML, checked before a job starts, with their digest."""

from __future__ import annotations

import hashlib
import json
import tomllib
from typing import Any

from ..operators import rules

SECTIONS = {"product": {"name", "version"}, "paths": None, "run": {"states", "years"}, "model": None, "export": None, "postproc": None}


def load(text: str) -> dict[str, Any]:
    """Sections of a run; unknown or missing sections, missing keys and states without rules are errors."""
    raw = tomllib.loads(text)
    if odd := set(raw) ^ set(SECTIONS):
        raise ValueError(f"unknown or missing sections: {sorted(odd)}")
    for section, wanted in SECTIONS.items():
        if wanted and (gone := wanted - set(raw[section])):
            raise ValueError(f"{section} lacks {sorted(gone)}")
    if bare := set(raw["run"]["states"]) - set(raw["postproc"]):
        raise ValueError(f"states without rules: {sorted(bare)}")
    return raw


def load_run(text: str) -> dict[str, Any]:
    """Settings whose rules are complete too: thresholds, surveys and expression texts of every state."""
    raw = load(text)
    rules.checked(raw["postproc"])
    return raw


def digest(settings: dict[str, Any]) -> str:
    """The same for equal settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()
