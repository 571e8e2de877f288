"""Small grammars read on the driver: role trees in brackets, child patterns, outlines, instructions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Node:
    role: str
    kids: list[Node] = field(default_factory=list)

    def __str__(self) -> str:
        return f"{self.role}[{','.join(map(str, self.kids))}]" if self.kids else f"{self.role}[]"


def parse_tree(text: str) -> Node:
    """``A[B[],C[]]``; brackets of a leaf may be left out."""
    nodes, rest = _siblings(re.findall(r"[^\s,\[\]]+|[\[\]]", text), 0, 0)
    if rest[0] != rest[1] or len(nodes) != 1:
        raise ValueError(f"not one tree: {text!r}")
    return nodes[0]


def _siblings(tokens: list[str], at: int, depth: int) -> tuple[list[Node], tuple[int, int]]:
    out: list[Node] = []
    opened = False
    while at < len(tokens):
        t = tokens[at]
        if t == "]":
            if not depth:
                raise ValueError("a bracket too many")
            return out, (at + 1, len(tokens))
        if t == "[":
            if not out or opened:
                raise ValueError("a role without a name")
            out[-1].kids, (at, _) = _siblings(tokens, at + 1, depth + 1)
            opened = True
        else:
            out.append(Node(t))
            at, opened = at + 1, False
    if depth:
        raise ValueError("an open bracket")
    return out, (at, len(tokens))


def child_regex(pattern: str) -> str:
    """A child pattern as a regex over roles each followed by a blank.

    Matching never goes back, so quantifiers are possessive. A starred or plussed body
    that may be empty is refused.
    """
    tokens = re.findall(r"[A-Za-z0-9]+|[()?*+]", pattern)
    out, at = _pattern(tokens, 0)
    return "^" + "".join(x for x, _ in out) + "$"


def _pattern(tokens: list[str], at: int) -> tuple[list[tuple[str, bool]], int]:
    out: list[tuple[str, bool]] = []
    while at < len(tokens) and tokens[at] != ")":
        t = tokens[at]
        if t == "(":
            body, at = _pattern(tokens, at + 1)
            out.append((f"(?:{''.join(x for x, _ in body)})", all(e for _, e in body)))
        elif t in "?*+":
            if not out:
                raise ValueError(f"nothing before {t}")
            body, empty = out[-1]
            if empty and t in "*+":
                raise ValueError(f"what may be empty can't be repeated: {body}")
            out[-1] = (f"{body}{t}+", t != "+" or empty)
        else:
            out.append((f"(?:{re.escape(t)} )", False))
        at += 1
    return out, at


# Fixed value: a bookmark line ends in its page.
SIGIL = re.compile(r"(.*?)\s+@(\?|\d+)\s*$")


def parse_outline(text: str) -> tuple[list[dict], list[str]]:
    """Rows (node, parent, depth, title, page) and errors; reading goes on after an error."""
    rows, errors, stack = [], [], []
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        body = line.lstrip(" \t")
        indent = line[: len(line) - len(body)]
        if "\t" in indent:
            errors.append(f"line {n}: tab in indentation")
            continue
        if len(indent) % 2:
            errors.append(f"line {n}: odd indentation")
            continue
        depth = len(indent) // 2
        if depth > len(stack):
            errors.append(f"line {n}: depth jumps to {depth}")
            continue
        m = SIGIL.match(body)
        if not m:
            errors.append(f"line {n}: no page")
            continue
        if m[2] == "?":
            errors.append(f"line {n}: unresolved page")
            continue
        if int(m[2]) < 1:
            errors.append(f"line {n}: page below 1")
            continue
        del stack[depth:]
        rows.append({"node": len(rows), "parent": stack[-1] if stack else None, "depth": depth, "title": m[1], "page": int(m[2])})
        stack.append(rows[-1]["node"])
    return rows, errors


# Fixed value: an element's line in a diagram, but not an annotation's in angle brackets.
DIAGRAM_LINE = re.compile(r"^\W*(?<!<)(\w+)\s+#(\d+)(?:\s+\"([^\"]*)\")?.*$", re.ASCII)


def parse_diagram(text: str) -> tuple[dict[tuple[str, int], str | None], list[str]]:
    """Notes by role and object number; the last line wins, and differing ones are told."""
    notes: dict[tuple[str, int], str | None] = {}
    warnings = []
    for line in text.splitlines():
        if m := DIAGRAM_LINE.match(line):
            key = (m[1], int(m[2]))
            if key in notes and notes[key] != m[3]:
                warnings.append(f"{m[1]} #{m[2]} is annotated twice")
            notes[key] = m[3]
    return notes, warnings


@dataclass
class Instruction:
    verb: str
    argument: str


# Verbs of the instruction language, and other spellings.
VERBS = {"ADD_CHILD": "ADD_CHILD", "ADD_CHILDREN": "ADD_CHILD", "ADD_PARENT": "ADD_PARENT", "ADD_PARENTS": "ADD_PARENT", "ARTIFACT": "ARTIFACT", "REORDER_KIDS": "REORDER_KIDS", "REORDER": "REORDER", "SET_ROLE": "SET_ROLE", "SPLIT_LINES": "SPLIT_LINES", "UNLINK": "UNLINK", "UNWRAP_LIST": "UNWRAP_LIST"}
RANGE = re.compile(r"^([A-Za-z0-9]+)(?:\[(\d+)(?:\.\.(\d*))?\])?$")


def parse_instruction(segment: str) -> Instruction:
    verb, _, rest = segment.strip().removeprefix("!").partition(" ")
    if not segment.strip().startswith("!") or verb not in VERBS:
        raise ValueError(f"no instruction: {segment!r}")
    return Instruction(VERBS[verb], rest.strip())


def parent_chain(argument: str) -> list[str]:
    """Roles from the outermost; each may have one child at most."""
    node, out = parse_tree(argument), []
    while True:
        out.append(node.role)
        if len(node.kids) > 1:
            raise ValueError("a parent chain can't branch")
        if not node.kids:
            return out
        node = node.kids[0]


def child_ranges(argument: str, n: int) -> list[tuple[str, int, int]]:
    """(role, first, last) of the wrappers; ranges ascend, leave no gap and cover all n kids, or there are none (0, 0)."""
    out, at = [], 0
    parts = [p.strip() for p in argument.split(",") if p.strip()]
    for p in parts:
        m = RANGE.match(p.replace("[]", ""))
        if not m:
            raise ValueError(f"not a wrapper: {p!r}")
        if m[2] is None:
            out.append((m[1], 0, 0))
            continue
        first = int(m[2])
        last = n if m[3] == "" else int(m[3]) if m[3] else first
        if first != at + 1 or last < first or last > n:
            raise ValueError(f"kids {first} to {last} after {at} of {n}")
        out.append((m[1], first, last))
        at = last
    if any(r[1] for r in out) and at != n:
        raise ValueError(f"only {at} of {n} kids are covered")
    return out
