"""Trees as tables: paths, pre-order numbers, subtrees, subtree hiding and pruning.

Elements are dealt by document and sorted within it once; a document's tree is then walked
where its rows are, in one pass over Arrow batches, so that deep trees cost no more jobs
than flat ones. A document's elements are held by one task at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import exprs
from docloom.sources.tables import dealt


def settled(table: DataFrame) -> DataFrame:
    """A step's result, computed once: later steps read it several times, and their plans would multiply.

    It is checkpointed in the session's folder if there is one, else kept in memory.
    """
    return dealt(table.checkpoint() if table.sparkSession.sparkContext.getCheckpointDir() else table.persist())


def numbered(elem: DataFrame, hide_verified: bool = True) -> DataFrame:
    """elem with path, ids (of ancestors and itself), depth, pre and last (the pre-order number of its subtree's last element).

    A verified element and all below it are left out before numbers are given. Elements
    that no root leads to, as those below a missing parent or in a circle, get no number;
    lost() tells them.
    """
    rows = elem.where(~F.coalesce(exprs.is_verified(F.col("title")), F.lit(False))) if hide_verified else elem
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "kid_ord", "elem_id")
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            doc = batch.column("doc_id")
            # The last document of a batch may go on in the next.
            last = doc[len(doc) - 1]
            cut = len(doc)
            while cut and doc[cut - 1] == last:
                cut -= 1
            if held and (cut or held[0].column("doc_id")[0] != last):
                held.append(batch.slice(0, cut))
                yield from walked(held, names)
                held = []
            elif cut:
                yield from walked([batch.slice(0, cut)], names)
            held.append(batch.slice(cut))
        if held:
            yield from walked(held, names)

    return rows.mapInArrow(run, f"{schema}, path array<int>, ids array<int>, depth int, pre int, last int")


def walked(batches: list[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of whole documents in pre-order with their numbers."""
    table = pa.Table.from_batches(batches).combine_chunks()
    doc, elem, parent, place = (table.column(c).to_pylist() for c in ("doc_id", "elem_id", "parent_id", "kid_ord"))
    order, paths, ids, pre, last = [], [], [], [], []
    i = 0
    while i < len(doc):
        j = i
        below: dict[int | None, list[int]] = {}
        while j < len(doc) and doc[j] == doc[i]:
            below.setdefault(parent[j], []).append(j)
            j += 1
        number, seen = 0, set()
        stack: list[tuple[int, tuple, tuple]] = [(r, (), ()) for r in reversed(below.get(None, []))]
        while stack:
            r, path, up = stack.pop()
            if r < 0:
                last[~r] = number
                continue
            if r in seen:
                continue
            seen.add(r)
            number += 1
            path, up = (*path, int(place[r])), (*up, elem[r])
            order.append(r)
            paths.append(path)
            ids.append(up)
            pre.append(number)
            last.append(number)
            stack.append((~(len(order) - 1), (), ()))
            stack += [(k, path, up) for k in reversed(below.get(elem[r], []))]
        i = j
    depth = np.array([len(p) for p in paths], np.int32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(depth)]), pa.int32())
    flat = lambda x: pa.ListArray.from_arrays(offsets, pa.array([v for y in x for v in y], pa.int32()))
    out = table.select(names).take(pa.array(order, pa.int64())).combine_chunks()
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns]
    columns = [*columns, flat(paths), flat(ids), pa.array(depth), pa.array(pre, pa.int32()), pa.array(last, pa.int32())]
    if order:
        yield pa.RecordBatch.from_arrays(columns, [*names, "path", "ids", "depth", "pre", "last"])


def lost(elem: DataFrame) -> DataFrame:
    """doc_id, elem_id, parent_id of elements that no root leads to."""
    seen = numbered(elem.select("doc_id", "elem_id", "parent_id", "kid_ord"), hide_verified=False).select("doc_id", "elem_id")
    return elem.select("doc_id", "elem_id", "parent_id").join(dealt(seen), ["doc_id", "elem_id"], "left_anti")


def closure(numbers: DataFrame) -> DataFrame:
    """doc_id, elem_id, anc_id, dist for each element and each of its ancestors, itself at distance 0."""
    return numbers.select("doc_id", "elem_id", "depth", F.posexplode("ids").alias("at", "anc_id")).select("doc_id", "elem_id", "anc_id", (F.col("depth") - 1 - F.col("at")).alias("dist"))


def outermost(hits: DataFrame, numbers: DataFrame) -> DataFrame:
    """Of hits (doc_id, elem_id) those without a hit among their ancestors."""
    up = closure(numbers).where("dist > 0").join(dealt(hits.select("doc_id", F.col("elem_id").alias("anc_id"))), ["doc_id", "anc_id"])
    return dealt(hits.join(dealt(up.select("doc_id", "elem_id").distinct()), ["doc_id", "elem_id"], "left_anti"))


def pages(numbers: DataFrame) -> DataFrame:
    """doc_id, elem_id, page: an element's own page, else that of the first element below it that has one, else 0."""
    own = closure(numbers).join(dealt(numbers.where("pg > 0").select("doc_id", "elem_id", "pre", "pg")), ["doc_id", "elem_id"]).groupBy("doc_id", F.col("anc_id").alias("elem_id")).agg(F.min_by("pg", "pre").alias("first"))
    return dealt(numbers.join(dealt(own), ["doc_id", "elem_id"], "left").select("doc_id", "elem_id", F.coalesce("pg", "first", F.lit(0)).alias("page")))


def prune_empty(numbers: DataFrame, leaves: DataFrame, kept: tuple[str, ...] = ("Document",)) -> DataFrame:
    """Elements that hold a leaf of any kind somewhere below, or have a kept role. leaves: doc_id, elem_id."""
    full = closure(numbers).join(dealt(leaves.select("doc_id", "elem_id").distinct()), ["doc_id", "elem_id"]).select("doc_id", F.col("anc_id").alias("elem_id")).distinct()
    return numbers.join(dealt(full.withColumn("full", F.lit(True))), ["doc_id", "elem_id"], "left").where(F.col("full").isNotNull() | F.col("role").isin(*kept)).drop("full")


def first_leaf_page(numbers: DataFrame, kid: DataFrame) -> DataFrame:
    """doc_id, elem_id, page: that of the first content below an element, in order of the tree, that has one."""
    leaf = kid.where("kind <> 'elem' and page_num > 0").select("doc_id", F.col("owner_id").alias("elem_id"), "kid_ord", "page_num")
    at = leaf.join(dealt(numbers.select("doc_id", "elem_id", "path")), ["doc_id", "elem_id"]).withColumn("at", F.concat("path", F.array("kid_ord")))
    return at.join(dealt(closure(numbers)), ["doc_id", "elem_id"]).groupBy("doc_id", F.col("anc_id").alias("elem_id")).agg(F.min_by("page_num", "at").alias("page"))


def display_path(numbers: DataFrame) -> DataFrame:
    """doc_id, elem_id, shown: /Role[index].Role[index]... with pre-order numbers."""
    up = closure(numbers).join(dealt(numbers.select("doc_id", F.col("elem_id").alias("anc_id"), "pre", "role")), ["doc_id", "anc_id"])
    steps = F.transform(F.array_sort(F.collect_list(F.struct("pre", "role"))), lambda s: F.concat(s["role"], F.lit("["), s["pre"].cast("string"), F.lit("]")))
    return up.groupBy("doc_id", "elem_id").agg(F.concat(F.lit("/"), F.array_join(steps, ".")).alias("shown"))
