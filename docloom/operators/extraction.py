"""Content tables from what a renderer reports: marked content, spans, boxes, bullets, blocks.

A renderer's events are rows in the order of drawing: text with its font, the lines of its
ascent and descent; images with their matrix; paths with the points of their segments. Each
table below is an aggregate or one streamed fold over them; nothing is gathered beyond a
block's pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import constants as K
from docloom.functions import exprs
from docloom.operators import runs
from docloom.sources.tables import dealt

#: kind TEXT, IMAGE or PATH; mcid below 0 for unmarked content; ctm are six numbers; points are x, y pairs of a path's segments; curves counts its curves.
EVENTS = "doc_id long, page_num int, event_ord int, kind string, mcid int, text string, font string, asc_x double, asc_y double, desc_x double, desc_y double, points array<double>, curves int, painted boolean, ctm array<double>"
KEY = ["doc_id", "page_num", "mcid"]


def shows_text(text: str = "text") -> Column:
    return F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))) > 0


def effective_size(events: DataFrame) -> DataFrame:
    """events with size: the distance between the starts of ascent and descent lines."""
    return events.withColumn("size", F.sqrt(F.pow(F.col("asc_x") - F.col("desc_x"), 2) + F.pow(F.col("asc_y") - F.col("desc_y"), 2)).cast("float").cast("double"))


def through(ctm: str, x: Column, y: Column) -> tuple[Column, Column]:
    """A point in the space of the page."""
    m = [F.get(F.col(ctm), F.lit(i)) for i in range(6)]
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def boxed(events: DataFrame) -> DataFrame:
    """events with x0..y1: of text and paths their points' bounds, of images the unit square through the matrix."""
    corners = [through("ctm", F.lit(float(a)), F.lit(float(b))) for a in (0, 1) for b in (0, 1)]
    axis = lambda i: F.expr(f"filter(points, (v, i) -> i % 2 = {i})")
    image = F.col("kind") == "IMAGE"
    out = {}
    for i, (lo, hi) in enumerate((("x0", "x1"), ("y0", "y1"))):
        of = [c[i] for c in corners]
        out[lo], out[hi] = F.when(image, F.least(*of)).otherwise(F.array_min(axis(i))), F.when(image, F.greatest(*of)).otherwise(F.array_max(axis(i)))
    return events.withColumns(out)


def drawn(events: DataFrame) -> DataFrame:
    """Events of marked content that count: text that isn't blank, images, painted paths."""
    return events.where((F.col("mcid") >= 0) & F.when(F.col("kind") == "TEXT", shows_text()).when(F.col("kind") == "PATH", F.coalesce("painted", F.lit(False))).otherwise(F.col("kind") == "IMAGE"))


def same_font() -> Callable[[str | None, float | None], int]:
    """Number of the stretch of one font; its first size is the one that others are held against."""
    font, size, n = None, 0.0, 0

    def step(name: str | None, of: float | None) -> int:
        nonlocal font, size, n
        of = of or 0.0
        if n == 0 or name != font or not abs(of - size) < K.FONT_EPS:
            font, size, n = name, of, n + 1
        return n

    return step


def spans(events: DataFrame) -> DataFrame:
    """The span table: consecutive texts of one font and size joined by single blanks."""
    text = effective_size(drawn(events).where("kind = 'TEXT'")).select(*KEY, "event_ord", "font", "size", "text")
    n = runs.scan(text, KEY, ["event_ord"], ["font", "size"], same_font, "span_ord", "int")
    pieces = F.array_sort(F.collect_list(F.struct("event_ord", "text")))
    joined = F.array_join(F.transform(pieces, lambda p: F.trim(p["text"])), " ")
    return n.groupBy(*KEY, "span_ord").agg(F.min_by("font", "event_ord").alias("font"), F.min_by("size", "event_ord").alias("size"), joined.alias("text")).select(*KEY, "span_ord", "font", "size", "text")


def contents(events: DataFrame) -> DataFrame:
    """The content table: text (cleaned), kinds and box of each marked block; blocks that show nothing are left out."""
    e = boxed(drawn(events))
    pieces = F.array_sort(F.collect_list(F.when(F.col("kind") == "TEXT", F.struct("event_ord", "text"))))
    text = exprs.clean_text(F.array_join(F.transform(pieces, lambda p: p["text"]), " "))
    bounds = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return e.groupBy(*KEY).agg(F.when(F.size(pieces) > 0, text).alias("text"), F.array_sort(F.collect_set("kind")).alias("kinds"), *bounds)


def bullets(events: DataFrame) -> DataFrame:
    """The bullet table: painted unmarked paths of two curves, of a bullet's size; those within a point of one before are the same."""
    e = boxed(events.where("kind = 'PATH' and mcid < 0 and painted and curves = 2"))
    near = lambda lo, hi, size: F.abs(F.col(hi) - F.col(lo) - size) <= K.BULLET_SLACK
    x, y = through("ctm", F.get("points", F.lit(0)), F.get("points", F.lit(1)))
    e = e.where(near("x0", "x1", K.BULLET_WIDTH) & near("y0", "y1", K.BULLET_HEIGHT)).select("doc_id", "page_num", F.col("event_ord").alias("ord"), x.alias("x"), y.alias("y"))
    return runs.scan(e, ["doc_id", "page_num"], ["ord"], ["x", "y"], runs.sieve(1.0), "kept", "boolean").where("kept").drop("kept")


def document_flags(doc: DataFrame, events: DataFrame) -> DataFrame:
    """doc with has_text and has_image as its events tell."""
    told = events.groupBy("doc_id").agg(F.bool_or((F.col("kind") == "TEXT") & shows_text()).alias("t"), F.bool_or(F.col("kind") == "IMAGE").alias("i"))
    return doc.join(dealt(told), "doc_id", "left").withColumns({"has_text": F.coalesce("t", F.lit(False)), "has_image": F.coalesce("i", F.lit(False))}).select(*doc.columns)


def mcid_of(operands: str = "operands") -> Column:
    """A marked block's number as its operator's inline properties tell; null without one."""
    found = F.regexp_extract(F.array_join(F.slice(operands, 2, 1), " "), r"/MCID\s+(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def tag_of(operands: str = "operands") -> Column:
    return F.regexp_replace(F.get(operands, F.lit(0)), "^/", "")


def nesting() -> Callable[[str], list[float] | None]:
    """Of each operator the number of the outermost marked block that it stands in, and its depth there; null outside."""
    depth, n = 0, 0

    def step(op: str) -> list[float] | None:
        nonlocal depth, n
        if op in ("BDC", "BMC"):
            depth += 1
            n += depth == 1
            return [float(n), float(depth)]
        if op == "EMC":
            depth = max(0, depth - 1)
            return None
        return [float(n), float(depth)] if depth else None

    return step


def blocks(operators: DataFrame) -> DataFrame:
    """The block table from a page's operators (doc_id, page_num, op_ord, op, operands): outermost marked blocks in order, artifacts without a number, with the text they show."""
    at = runs.scan(operators, ["doc_id", "page_num"], ["op_ord"], ["op"], nesting, "at", "array<double>").where("at is not null")
    at = at.withColumn("block_ord", F.col("at")[0].cast("int"))
    opens = F.col("op").isin("BDC", "BMC") & (F.col("at")[1] == 1)
    shown = F.array_sort(F.collect_list(F.when(F.col("op").isin("Tj", "TJ", "'", '"'), F.struct("op_ord", F.element_at("operands", -1).alias("text")))))
    g = at.groupBy("doc_id", "page_num", "block_ord").agg(F.max(F.when(opens, mcid_of())).alias("mcid"), F.max(F.when(opens, tag_of())).alias("tag"), F.array_join(F.transform(shown, lambda s: s["text"]), "").alias("text"))
    return g.where("mcid is not null or tag = 'Artifact'").select("doc_id", "page_num", "block_ord", "mcid", "text")
