"""Canonical tables from bracket trees and rows."""

from docloom.operators.patterns import parse_tree
from docloom.sources.tables import SCHEMAS


def tables(spark, *trees, content=(), **rows):
    """trees: one document each, ids in pre-order from 1. content: (doc, owner, page, mcid, text, kinds, box[, size])."""
    elem, kid, doc = [], [], []
    for d, t in enumerate(trees, 1):
        doc.append((d, "p", 1, True, True, False, "en", True, None, "S", False, False))
        if not t:
            continue
        n = 0

        def walk(node, up, order, d=d):
            nonlocal n
            n += 1
            own = n
            role, _, title = node.role.partition("=")
            elem.append((d, own, up, order, role, None, title.replace("_", " ").replace("~", "__") or None, None, None))
            if up:
                kid.append((d, up, order, "elem", own, None, None, None))
            for i, k in enumerate(node.kids, 1):
                walk(k, own, i)

        walk(parse_tree(t), None, 1)
    first: dict = {}
    for d, owner, page, *_ in content:
        first.setdefault((d, owner), page)
    elem = [(*e[:5], first.get((e[0], e[1])), *e[6:]) for e in elem]
    made, span = [], []
    for d, owner, page, mcid, text, kinds, box, *size in content:
        kid.append((d, owner, 100 + mcid, "mcr_num", None, mcid, page, None))
        made.append((d, page, mcid, text, list(kinds), *map(float, box)))
        if size:
            span.append((d, page, mcid, 1, "F", float(size[0]), text))
    data = {"doc": doc, "elem": elem, "kid": kid, "content": made, "span": span}
    for k, v in rows.items():
        data[k] = v if k in ("doc", "elem") else data.get(k, []) + list(v)
    return {n: spark.createDataFrame(data.get(n, []), s) for n, s in SCHEMAS.items()}
