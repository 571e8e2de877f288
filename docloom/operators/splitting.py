"""Marked blocks by lines and sizes: the state of text operators, and repairs that split blocks.

Operators of a block come in order; what they say of position and size is folded in one pass
over sorted rows. A block that is split keeps its number for the first part; further parts get
numbers beyond all of their page.
"""

from __future__ import annotations

from collections.abc import Callable
from math import hypot

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom import constants as K
from docloom.functions import exprs
from docloom.operators import restructure, runs
from docloom.sources.tables import dealt

OPERATORS = "doc_id long, page_num int, mcid int, op_ord int, op string, operands array<string>"
#: Operators that show text.
SHOWS = ("Tj", "TJ", "'", '"')


def text_state() -> Callable[[str, list[str] | None], list[float] | None]:
    """A step takes an operator and its operands; for one that shows text it gives the baseline's move since the last such one, and the size."""
    line, matrix = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    size, leading, before = 0.0, 0.0, None

    def move(x: float, y: float) -> None:
        nonlocal line, matrix
        a, b, c, d, e, f = line
        line = [a, b, c, d, e + x * a + y * c, f + x * b + y * d]
        matrix = list(line)

    def step(op: str, operands: list[str] | None) -> list[float] | None:
        nonlocal line, matrix, size, leading, before
        numbers = [float(x) for x in operands or [] if x.replace(".", "", 1).replace("-", "", 1).isdigit()]
        if op == "BT":
            line, matrix = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
        elif op == "Tm" and len(numbers) == 6:
            line, matrix = list(numbers), list(numbers)
        elif op in ("Td", "TD") and len(numbers) == 2:
            leading = -numbers[1] if op == "TD" else leading
            move(*numbers)
        elif op == "TL" and numbers:
            leading = numbers[0]
        elif op == "Tf" and numbers:
            size = numbers[-1]
        elif op in ("T*", "'", '"'):
            move(0.0, -leading)
        if op not in SHOWS:
            return None
        fell = 0.0 if before is None else matrix[5] - before
        before = matrix[5]
        return [fell, size * hypot(matrix[2], matrix[3])]

    return step


def shown(operators: DataFrame) -> DataFrame:
    """The op table (doc_id, page_num, mcid, op_ord, kind, dy, size, text) of blocks' text operators (OPERATORS)."""
    state = runs.scan(operators, ["doc_id", "page_num", "mcid"], ["op_ord"], ["op", "operands"], text_state, "state", "array<double>")
    text = F.coalesce(F.element_at("operands", -1), F.lit(""))
    return state.where("state is not null").select("doc_id", "page_num", "mcid", "op_ord", F.lit("show").alias("kind"), F.col("state")[0].alias("dy"), F.col("state")[1].alias("size"), text.alias("text"))


def lines(op: DataFrame) -> DataFrame:
    """Shown texts with their line, from 1, and whether the line begins in another size than the one before ended."""
    w = Window.partitionBy("doc_id", "page_num", "mcid").orderBy("op_ord")
    s = op.where("kind = 'show'").withColumn("fell", F.coalesce(F.col("dy") < -K.BASELINE_DROP, F.lit(False)) & (F.row_number().over(w) > 1)).withColumn("was", F.lag("size").over(w))
    s = s.withColumn("changes", F.col("fell") & (F.abs(F.col("size") - F.col("was")) > K.SIZE_CHANGE))
    return s.withColumn("line", F.sum(F.col("fell").cast("int")).over(w).cast("int") + 1).drop("was", "fell")


def split_blocks(tables: dict[str, DataFrame], parts: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """content, span and op with blocks cut: parts are doc_id, page_num, mcid, op_ord, part (from 0).

    The second result tells doc_id, page_num, mcid, part, to: each part's number. A part's box is its
    share of the block's height by lines, from the top.
    """
    top = tables["content"].groupBy("doc_id", "page_num").agg(F.max("mcid").alias("top"))
    each = parts.select("doc_id", "page_num", "mcid", "part").distinct()
    new = each.where("part > 0").join(dealt(top), ["doc_id", "page_num"]).withColumn("to", F.col("top") + F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy("mcid", "part")))
    number = each.join(dealt(new.select("doc_id", "page_num", "mcid", "part", "to")), ["doc_id", "page_num", "mcid", "part"], "left").withColumn("to", F.coalesce("to", "mcid").cast("int"))
    key = ["doc_id", "page_num", "mcid"]
    at = parts.select(*key, "op_ord", "part").join(dealt(number), [*key, "part"]).select(*key, "op_ord", "part", "to")
    placed = tables["op"].join(dealt(at), [*key, "op_ord"], "left")
    op = placed.withColumn("mcid", F.coalesce("to", "mcid")).select(*tables["op"].columns)
    span = tables["span"].join(dealt(at.withColumnRenamed("op_ord", "span_ord")), [*key, "span_ord"], "left").withColumn("mcid", F.coalesce("to", "mcid")).select(*tables["span"].columns)
    said = placed.where("part is not null").groupBy(*key, "part", "to").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_ord", "text"))), lambda s: s["text"]), " ").alias("said"), F.count("*").alias("n"))
    w = Window.partitionBy(*key)
    said = said.withColumn("all", F.sum("n").over(w)).withColumn("before", F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    cut = tables["content"].join(dealt(said), key)
    high = (F.col("y1") - F.col("y0")) / F.col("all")
    made = cut.select("doc_id", "page_num", F.col("to").alias("mcid"), F.col("said").alias("text"), "kinds", "x0", (F.col("y1") - high * (F.col("before") + F.col("n"))).alias("y0"), "x1", (F.col("y1") - high * F.col("before")).alias("y1"))
    rest = tables["content"].join(dealt(parts.select(*key).distinct()), key, "left_anti").select(*tables["content"].columns)
    return {"content": rest.unionByName(made.select(*tables["content"].columns)), "span": span, "op": op}, number


def siblings(elem: DataFrame, kid: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New elements beside others: made are doc_id, beside (elem_id), part, role_raw, title, page_num, to (the block each holds)."""
    at = made.join(dealt(elem.select("doc_id", F.col("elem_id").alias("beside"), "parent_id", "kid_ord")), ["doc_id", "beside"])
    new = restructure.fresh(elem, at, ["beside", "part"]).withColumn("place", F.col("kid_ord") + F.col("part") / 1000.0).withColumn("pg", F.col("page_num"))
    refs = new.select("doc_id", F.col("elem_id").alias("owner_id"), F.lit(0).alias("kid_ord"), F.lit("mcr_num").alias("kind"), F.lit(None).cast("int").alias("child_id"), F.col("to").alias("mcid"), "page_num", F.lit(None).cast("int").alias("annot_id"))
    return restructure.added(elem, new), kid.unionByName(refs.select(*kid.columns))


def split_by_size(tables: dict[str, DataFrame], hits: DataFrame) -> dict[str, DataFrame]:
    """Elements of hits (doc_id, elem_id) with one block: a sibling of their role for each stretch of lines of one size.

    The element keeps the first stretch; all are stamped. A block of one size stays as it is.
    """
    sole = tables["kid"].groupBy("doc_id", F.col("owner_id").alias("elem_id")).agg(F.count("*").alias("n"), F.min("kind").alias("kind"), F.min("page_num").alias("page_num"), F.min("mcid").alias("mcid")).where("n = 1 and kind in ('mcr_num', 'mcr_dict')")
    own = hits.select("doc_id", "elem_id").distinct().join(dealt(sole), ["doc_id", "elem_id"]).join(dealt(tables["elem"].where("parent_id is not null").select("doc_id", "elem_id", "role_raw", "title")), ["doc_id", "elem_id"])
    w = Window.partitionBy("doc_id", "page_num", "mcid").orderBy("op_ord")
    cut = lines(tables["op"]).join(dealt(own.select("doc_id", "page_num", "mcid")), ["doc_id", "page_num", "mcid"]).withColumn("part", F.sum(F.col("changes").cast("int")).over(w).cast("int"))
    several = cut.where("part > 0").select("doc_id", "page_num", "mcid").distinct()
    parts = restructure.settled(cut.join(dealt(several), ["doc_id", "page_num", "mcid"]).select("doc_id", "page_num", "mcid", "op_ord", "part"))
    out, number = split_blocks(tables, parts)
    stamp = exprs.add_note(F.col("title"), F.lit("SPLIT"))
    made = number.where("part > 0").join(dealt(own), ["doc_id", "page_num", "mcid"]).select("doc_id", F.col("elem_id").alias("beside"), "part", "role_raw", exprs.add_note(F.lit(None).cast("string"), F.lit("SPLIT")).alias("title"), "page_num", "to")
    done = own.join(dealt(several), ["doc_id", "page_num", "mcid"]).select("doc_id", "elem_id", F.lit(True).alias("done"))
    told = F.exists(exprs.segments(F.col("title")), lambda s: F.trim(s) == "SPLIT")
    elem = tables["elem"].join(dealt(done), ["doc_id", "elem_id"], "left").withColumn("title", F.when(F.col("done") & ~told, stamp).otherwise(F.col("title"))).select(*tables["elem"].columns)
    elem, kid = siblings(elem, tables["kid"], made)
    return out | {"elem": elem, "kid": kid}


def split_lines(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``!SPLIT_LINES [N or N,N...]``: an element's lines as items of a list.

    Without an argument each line is an item; N asks for N lines, an item each; a list of
    numbers gives each item's lines. Numbers that don't fit the lines, fewer than two items,
    and lists of parts over more than one block are refused.
    """
    elem, kid = tables["elem"], tables["kid"]
    told = restructure.told(elem, "SPLIT_LINES").where("parent_id is not null").select("doc_id", "elem_id", "said")
    blocks = kid.groupBy("doc_id", F.col("owner_id").alias("elem_id")).agg(F.count("*").alias("n"), F.min("kind").alias("kind"), F.min("page_num").alias("page_num"), F.min("mcid").alias("mcid")).where("n = 1 and kind in ('mcr_num', 'mcr_dict')")
    own = told.join(dealt(blocks), ["doc_id", "elem_id"])
    line = lines(tables["op"]).join(dealt(own.select("doc_id", "elem_id", "said", "page_num", "mcid")), ["doc_id", "page_num", "mcid"])
    count = line.groupBy("doc_id", "elem_id", "page_num", "mcid", "said").agg(F.max("line").alias("n_lines"))
    sizes = F.transform(F.filter(F.split("said", r"\s*,\s*"), lambda x: x != ""), lambda x: x.try_cast("int"))
    asked = count.withColumn("asked", sizes)
    asked = asked.withColumn("items", F.when(F.size("asked") == 0, F.array_repeat(F.lit(1), F.col("n_lines"))).when((F.size("asked") == 1) & (F.col("asked")[0] == F.col("n_lines")), F.array_repeat(F.lit(1), F.col("n_lines"))).when(F.size("asked") > 1, F.col("asked")))
    good = asked.where("items is not null and size(items) >= 2 and forall(items, x -> x > 0) and aggregate(items, 0, (a, x) -> a + x) = n_lines")
    good = restructure.settled(good.select("doc_id", "elem_id", "page_num", "mcid", F.expr("transform(items, (x, i) -> aggregate(slice(items, 1, i), 0, (a, y) -> a + y))").alias("starts")))
    if good.isEmpty():
        return {n: tables[n] for n in ("elem", "kid", "content", "span", "op")}
    part = (F.size(F.filter("starts", lambda s: s < F.col("line"))) - 1).cast("int")
    parts = restructure.settled(line.join(dealt(good.select("doc_id", "elem_id", "starts")), ["doc_id", "elem_id"]).select("doc_id", "page_num", "mcid", "op_ord", part.alias("part")))
    out, number = split_blocks(tables, parts)
    made = number.where("part > 0").join(dealt(good), ["doc_id", "page_num", "mcid"]).join(dealt(elem.select("doc_id", "elem_id", "role_raw")), ["doc_id", "elem_id"])
    made = made.select("doc_id", F.col("elem_id").alias("beside"), "part", "role_raw", F.lit(None).cast("string").alias("title"), "page_num", "to")
    bare = restructure.cleared(elem, good, "!SPLIT_LINES")
    known = bare.select("doc_id", "elem_id", F.lit(True).alias("old"))
    elem, kid = siblings(bare, kid, made)
    # All parts stand in a row and are the items of one list.
    fresh = elem.join(dealt(known), ["doc_id", "elem_id"], "left").where("old is null").join(dealt(kid.where("kind = 'mcr_num'").select("doc_id", F.col("owner_id").alias("elem_id"), "page_num", F.col("mcid").alias("to"))), ["doc_id", "elem_id"])
    fresh = fresh.join(dealt(number.select("doc_id", "page_num", "mcid", "to")), ["doc_id", "page_num", "to"]).join(dealt(good.select("doc_id", "page_num", "mcid", F.col("elem_id").alias("run"))), ["doc_id", "page_num", "mcid"])
    members = fresh.select("doc_id", "elem_id", "run").unionByName(good.select("doc_id", "elem_id", F.col("elem_id").alias("run")))
    n = members.groupBy("doc_id", "run").agg(F.count("*").alias("n"))
    note = exprs.add_note(F.lit(None).cast("string"), F.concat(F.col("n").cast("string"), F.lit(" items")))
    members = members.join(dealt(n), ["doc_id", "run"]).select("doc_id", "elem_id", "run", restructure.roles("L").alias("outer"), restructure.roles("LI", "LBody").alias("inner"), note.alias("title"))
    return out | {"elem": restructure.wrap(elem, members), "kid": kid}
