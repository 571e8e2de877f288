"""HTML pages as a tree of elements: one scan, one shuffle by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tags that open and close, and the role each stands for.
ROLES = {"html": "Root", "head": "NonStruct", "title": "Title", "body": "Document", "nav": "Sect", "div": "Div", "article": "Art", "footer": "Div", "ul": "L", "li": "LI", "a": "Link", "h1": "H1", "p": "P"}
TAG = r"<(/?)(html|head|title|body|nav|div|article|footer|ul|li|a|h1|p)(\s[^>]*)?>"


def clean(html):
    """Without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, pos, tag, closing, href, depth (of an opened element). A paragraph is a leaf where it opens."""
    t = pages.select("page_id", F.posexplode(F.regexp_extract_all(clean(F.col("html")), F.lit(TAG), F.lit(0))).alias("pos", "token"))
    t = t.withColumn("tag", F.regexp_extract("token", TAG, 2)).withColumn("closing", F.startswith("token", F.lit("</")))
    t = t.where(~((F.col("tag") == "p") & F.col("closing")))
    step = F.when(F.col("tag") == "p", 0).when(F.col("closing"), -1).otherwise(1)
    level = F.sum(step).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    href = F.when(F.col("token").contains('href="'), F.regexp_extract("token", 'href="([^"]*)"', 1))
    return t.withColumn("depth", level + F.when(F.col("tag") == "p", 1).otherwise(0)).withColumn("href", href).select("page_id", F.col("pos").cast("long").alias("pos"), "tag", "closing", "href", "depth")


def tree(pages: DataFrame) -> DataFrame:
    """page_id, pos (pre-order), depth, tag, role, href, parent_pos, parent_role, kid_ord.

    An element's parent is the last one opened before it one level up. Each element
    stands once as a parent of its level and once as a child of the level above, so
    that one window finds all parents.
    """
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.col("tag")]
    opened = tokens(pages).where(~F.col("closing")).withColumn("role", role)
    side = F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(True).alias("as_parent")), F.struct((F.col("depth") - 1).alias("level"), F.lit(False).alias("as_parent")))).alias("s")
    w = Window.partitionBy("page_id", "s.level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    up = F.last(F.when(F.col("s.as_parent") & (F.col("tag") != "p"), F.struct("pos", "role")), ignorenulls=True).over(w)
    found = opened.select("*", side).withColumn("up", up).where(~F.col("s.as_parent"))
    kids = Window.partitionBy("page_id", "parent_pos").orderBy("pos")
    return found.select("page_id", "pos", "depth", "tag", "role", "href", F.col("up.pos").alias("parent_pos"), F.col("up.role").alias("parent_role")).withColumn("kid_ord", F.row_number().over(kids).cast("long"))
