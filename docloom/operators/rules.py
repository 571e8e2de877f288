"""The role schema as a table, and its own consistency."""

from __future__ import annotations

import re

import yaml
from pyspark.sql import DataFrame, SparkSession

from docloom import constants as K
from docloom.operators.patterns import child_regex

SCHEMA = "role string, parent_must_be array<string>, allowed array<string>, required array<string>, min_c int, max_c int, pattern string"
Rule = dict


def default_rules() -> dict[str, Rule]:
    return complete({r: {"allowed": a.split(), "required": K.REQUIRED.get(r, []), "pattern": K.PATTERNS.get(r)} for r, a in K.ALLOWED.items()})


def complete(rules: dict[str, Rule]) -> dict[str, Rule]:
    """Roles that are named but have no rule of their own get one without constraints."""
    out = {r: {"parent_must_be": [], "allowed": [], "required": [], "min_c": None, "max_c": None, "pattern": None} | x for r, x in rules.items()}
    for x in list(out.values()):
        for r in [*x["parent_must_be"], *x["allowed"], *x["required"]]:
            out.setdefault(r, {"parent_must_be": [], "allowed": [], "required": [], "min_c": None, "max_c": None, "pattern": None})
    return out


def parse(text: str) -> dict[str, Rule]:
    """Rules from YAML: a mapping of roles, or one under ``roles``, to their constraints."""
    data = yaml.safe_load(text) or {}
    data = data.get("roles", data)
    if not isinstance(data, dict):
        raise ValueError("rules are a mapping of roles")
    names = {"parent_must_be": "parent_must_be", "allowed_children": "allowed", "required_children": "required"}
    out: dict[str, Rule] = {}
    for role, given in data.items():
        given = given or {}
        lists = {to: [given[n]] if isinstance(given.get(n), str) else list(given.get(n) or []) for n, to in names.items()}
        out[role] = lists | {"min_c": given.get("min_children"), "max_c": given.get("max_children"), "pattern": given.get("child_pattern")}
    return complete(out)


def load(path: str) -> dict[str, Rule]:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def parse_patterns(text: str) -> dict[str, str]:
    """Artifact patterns from YAML, by name; each must be a pattern."""
    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict) or not all(isinstance(v, str) for v in data.values()):
        raise ValueError("patterns are a mapping of names to texts")
    for v in data.values():
        re.compile(v)
    return {str(k): v for k, v in data.items()}


def table(spark: SparkSession, rules: dict[str, Rule] | None = None) -> DataFrame:
    """One row a role; patterns are compiled."""
    rules = default_rules() if rules is None else rules
    rows = [(r, x["parent_must_be"], x["allowed"], x["required"], x["min_c"], x["max_c"], child_regex(x["pattern"]) if x["pattern"] else None) for r, x in sorted(rules.items())]
    return spark.createDataFrame(rows, SCHEMA)


def lint(rules: dict[str, Rule]) -> list[str]:
    """What the rules say against each other."""
    out = []
    for role, x in sorted(rules.items()):
        allowed, required = set(x["allowed"]), set(x["required"])
        if allowed and (missing := required - allowed):
            out.append(f"{role} requires {sorted(missing)} but doesn't allow them")
        if x["min_c"] is not None and x["max_c"] is not None and x["min_c"] > x["max_c"]:
            out.append(f"{role} needs at least {x['min_c']} and at most {x['max_c']} children")
        if x["max_c"] is not None and len(required) > x["max_c"]:
            out.append(f"{role} requires more roles than it may have children")
        for child in sorted(allowed):
            if (up := rules.get(child, {}).get("parent_must_be")) and role not in up:
                out.append(f"{role} allows {child}, whose parent can't be {role}")
        for up in sorted(x["parent_must_be"]):
            if (kids := rules.get(up, {}).get("allowed")) and role not in kids:
                out.append(f"{role} must stand in {up}, which doesn't allow it")
        if x["pattern"]:
            named = set(re.findall(r"[A-Za-z0-9]+", x["pattern"]))
            if allowed and named - allowed:
                out.append(f"{role}'s pattern names {sorted(named - allowed)}, which it doesn't allow")
    return out
