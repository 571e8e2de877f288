"""Rectangles: unions, similarity, best overlap, interval matches. Joins always carry an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import constants as K
from docloom.functions.exprs import intersects
from docloom.sources.tables import dealt

#: Points of height that share a bin in interval joins.
BIN = 64
UNION = (F.min, F.min, F.max, F.max)


def union_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[f(c).alias(c) for f, c in zip(UNION, ("x0", "y0", "x1", "y1"), strict=True)])


def area(a: str) -> Column:
    c = F.col
    return F.greatest(F.lit(0.0), c(f"{a}x1") - c(f"{a}x0")) * F.greatest(F.lit(0.0), c(f"{a}y1") - c(f"{a}y0"))


def shared(a: str, b: str) -> Column:
    c = F.col
    wide = F.least(c(f"{a}x1"), c(f"{b}x1")) - F.greatest(c(f"{a}x0"), c(f"{b}x0"))
    high = F.least(c(f"{a}y1"), c(f"{b}y1")) - F.greatest(c(f"{a}y0"), c(f"{b}y0"))
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def similar(a: str, b: str) -> Column:
    ratio = area(a) / area(b)
    return intersects(a, b) & ratio.between(*K.AREA_RATIO)


def equal(a: str, b: str) -> Column:
    out = F.lit(True)
    for s in ("x0", "y0", "x1", "y1"):
        out = out & (F.abs(F.col(f"{a}{s}") - F.col(f"{b}{s}")) <= K.RECT_TOLERANCE)
    return out


def best_overlap(annots: DataFrame, elems: DataFrame, least: float = K.LINK_MIN_SCORE, apart: bool = False) -> DataFrame:
    """Each annotation's best enclosing element on its page: score, then depth, then smaller area, then pre-order.

    annots: doc_id, page_num, annot_id, x0..y1. elems: doc_id, page_num, elem_id, depth, pre, x0..y1.
    apart: an element isn't its own annotation, as where both come from one table.
    """
    a = annots.select("doc_id", "page_num", "annot_id", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    e = elems.select("doc_id", "page_num", "elem_id", "depth", "pre", *[F.col(c).alias(f"e_{c}") for c in ("x0", "y0", "x1", "y1")])
    both = a.join(dealt(e), ["doc_id", "page_num"]).where(intersects("a_", "e_")).withColumn("score", F.round(shared("a_", "e_") / area("a_"), 6)).where(F.col("score") >= least)
    if apart:
        both = both.where("annot_id <> elem_id")
    w = Window.partitionBy("doc_id", "annot_id").orderBy(F.desc("score"), F.desc("depth"), area("e_"), "pre")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "page_num", "annot_id", "elem_id", "score")


def first_in_interval(boxes: DataFrame, points: DataFrame, margin: float = K.BULLET_Y) -> DataFrame:
    """Each box's first point by extraction order whose y lies within its height and a margin."""
    # A box meets the points of the bins it touches only, not all of its page.
    reach = [F.floor((F.col("y0") - margin) / BIN), F.floor((F.col("y1") + margin) / BIN)]
    p = points.select("doc_id", "page_num", F.struct("ord", "x", "y").alias("bullet"), F.floor(F.col("y") / BIN).alias("bin"))
    near = boxes.withColumn("bin", F.explode(F.sequence(*reach))).join(dealt(p), ["doc_id", "page_num", "bin"]).where((F.col("bullet.y") >= F.col("y0") - margin) & (F.col("bullet.y") <= F.col("y1") + margin))
    return near.groupBy("doc_id", "page_num", "elem_id").agg(F.min("bullet").alias("bullet"))
