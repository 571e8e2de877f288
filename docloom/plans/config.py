"""Configuration beside a document: which checks run, in order, and what some of them need.

A YAML file with an optional list ``checks`` and a mapping or list a check. No list of checks means
the default ones, an empty one that none run. Unknown keys are told as warnings.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import yaml

from docloom.operators.checks import CHECKS

EXTENSION, SUFFIX = ".docloom.yaml", "_docloom"
#: Keys of an older form, of which only a warning is given.
OLD_KEYS = ("skip-checks", "only-checks", "include-checks", "role-map", "artifact-patterns")


@dataclass
class Config:
    present: bool = False
    checks: list[str] | None = None
    by_check: dict[str, dict[str, str]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def plain(name: str) -> str:
    """A check's name without the ending that it may carry in files."""
    return name.removesuffix("Check")


def comma_separated(text: str | None) -> list[str]:
    """Trimmed parts, each once, in order; empty ones don't count."""
    return list(dict.fromkeys(p for p in map(str.strip, (text or "").split(",")) if p))


def beside(path: str) -> str:
    """The configuration's place for a document; results of a former run share that of their source."""
    folder, name = os.path.split(path)
    return os.path.join(folder, re.sub(rf"({SUFFIX})*\.[^.]+$", "", name) + EXTENSION)


def parse(text: str) -> Config:
    data = yaml.safe_load(text)
    out = Config(present=True)
    if data is None:
        return out
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping")
    for key, value in data.items():
        if key == "checks":
            if value is not None and not isinstance(value, list):
                raise ValueError("checks must be a list of names")
            out.checks = [plain(x.strip()) for x in value or [] if isinstance(x, str) and x.strip()]
        elif plain(key) not in CHECKS:
            out.warnings.append(f"{key} is no longer supported" if key in OLD_KEYS else f"unknown key {key}")
        elif isinstance(value, list):
            if not all(isinstance(x, str) for x in value):
                raise ValueError(f"items of {key} must be strings")
            out.by_check[plain(key)] = {str(i): x.strip() for i, x in enumerate(value)}
        elif value is None or isinstance(value, dict):
            out.by_check[plain(key)] = {str(k): str(v).strip() for k, v in (value or {}).items() if v is not None}
        else:
            raise ValueError(f"{key} must be a mapping or a list")
    return out


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def for_document(path: str) -> Config:
    """The configuration beside a document, or an empty one."""
    found = beside(path)
    return load(found) if os.path.exists(found) else Config()


def options(config: Config) -> dict:
    """What the checks that can be configured read from their context."""
    by = config.by_check
    out: dict = {}
    if by.get("MistaggedArtifact"):
        out["artifact_patterns"] = by["MistaggedArtifact"]
    if by.get("ReorderWebCaptures"):
        out["urls"] = list(by["ReorderWebCaptures"].values())
    if by.get("ReplaceRoleMap"):
        out["role_map"] = by["ReplaceRoleMap"]
    if (scope := by.get("StaleScribble", {}).get("scope")) is not None:
        if scope not in ("ALL", "TOOL_AUTHORED"):
            raise ValueError(f"no scope of notes: {scope}")
        out["scribble_scope"] = scope
    return out


def template(path: str) -> str:
    """Write a configuration of comments beside a document; its place."""
    name = os.path.basename(path)
    lines = [f"# Configuration of {name}", "", "# Checks in order; without this list the default ones run.", "#checks:"]
    lines += [f"#  - {n}" for n, c in CHECKS.items() if c.default] + ["# Others:"] + [f"#  - {n}" for n, c in CHECKS.items() if not c.default]
    lines += ["", "#MistaggedArtifact:", "#  name: 'pattern'", "", "#ReorderWebCaptures:", "#  - part of a URL", "", "#ReplaceRoleMap:", "#  Role: StandardRole", "", "#StaleScribble:", "#  scope: TOOL_AUTHORED   # or ALL"]
    with open(beside(path), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return beside(path)
