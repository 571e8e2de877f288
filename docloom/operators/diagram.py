"""Trees as diagrams that people read and annotate, and annotations read back; outlines replaced from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import exprs
from docloom.operators import hierarchy, patterns
from docloom.operators.checks import Context
from docloom.sources.tables import dealt

#: Roles whose text is shown in full.
IN_FULL = ("Link", "H1", "H2", "H3", "H4", "H5", "H6")
BRANCH, LAST, GO_ON, GAP = "├─ ", "└─ ", "│  ", "   "


def note_shown(title: Column) -> Column:
    return F.coalesce(F.concat(F.lit(' "'), F.when(exprs.note_body(title).isNotNull(), title), F.lit('"')), F.lit(""))


def dump(ctx: Context, box: bool = False) -> DataFrame:
    """doc_id, at (order), line: elements with their id and note, content with its kinds and text, annotations with where they lead, and a line where a page begins.

    box: lines drawn with branches instead of blanks.
    """
    e = ctx.numbers.select("doc_id", "elem_id", "parent_id", "role", "title", "path", "depth", "kid_ord")
    w = Window.partitionBy("doc_id", "parent_id").orderBy("kid_ord")
    later = F.lead("elem_id").over(w).isNotNull()
    drawn = e.withColumn("more", later)
    if box:
        up = hierarchy.closure(ctx.numbers).join(dealt(drawn.select("doc_id", F.col("elem_id").alias("anc_id"), F.col("more").alias("a_more"), F.col("depth").alias("a_depth"))), ["doc_id", "anc_id"])
        stems = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("dist") > 0) & (F.col("a_depth") > 1), F.struct("a_depth", "a_more")))), lambda s: F.when(s["a_more"], GO_ON).otherwise(GAP)), "")
        drawn = drawn.join(dealt(up.groupBy("doc_id", "elem_id").agg(stems.alias("stems"))), ["doc_id", "elem_id"])
        lead = F.when(F.col("depth") == 1, "").otherwise(F.concat("stems", F.when(F.col("more"), BRANCH).otherwise(LAST)))
        inner = F.when(F.col("depth") == 1, GAP).otherwise(F.concat("stems", F.when(F.col("more"), GO_ON).otherwise(GAP)))
    else:
        lead, inner = F.expr("repeat('  ', depth - 1)"), F.expr("repeat('  ', depth)")
    own = drawn.withColumns({"lead": lead, "inner": inner})
    label = F.concat("lead", "role", F.lit(" #"), F.col("elem_id").cast("string"), note_shown(F.col("title")))
    elems = own.select("doc_id", F.col("path").alias("at"), F.lit(0).alias("page"), label.alias("line"))
    at = F.concat("path", F.array("o"))
    m = ctx.owned.where("page_num is not null").select("doc_id", "elem_id", F.col("kid_ord").alias("o"), "page_num", "mcid", "text", "kinds")
    m = m.join(dealt(own.select("doc_id", "elem_id", "path", "inner", "role")), ["doc_id", "elem_id"])
    kinds = F.array_join(F.transform(F.array_sort(F.coalesce("kinds", F.array())), F.lower), ",")
    text = F.coalesce(F.concat(F.lit(" `"), F.when(F.col("role").isin(*IN_FULL), F.col("text")).otherwise(exprs.truncate(F.col("text"))), F.lit("`")), F.lit(""))
    content = m.select("doc_id", at.alias("at"), F.col("page_num").alias("page"), F.concat("inner", F.lit("["), kinds, F.lit(" &"), F.col("mcid").cast("string"), F.lit("]"), text).alias("line"))
    k = ctx.links.select("doc_id", "elem_id", F.col("kid_ord").alias("o"), "annot_id", "dest").join(dealt(own.select("doc_id", "elem_id", "path", "inner")), ["doc_id", "elem_id"])
    links = k.select("doc_id", at.alias("at"), F.lit(0).alias("page"), F.concat("inner", F.lit("<link #"), F.col("annot_id").cast("string"), F.lit("> "), F.coalesce("dest", F.lit("?"))).alias("line"))
    every = elems.unionByName(content).unionByName(links)
    # A page begins with the first content that stands on another one than what came before it.
    order = Window.partitionBy("doc_id").orderBy("at")
    before = F.last(F.when(F.col("page") > 0, F.col("page")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = every.withColumn("before", before)
    breaks = marked.where("page > 0 and (before is null or before <> page)").select("doc_id", "at", F.lit(0).alias("sub"), F.concat(F.lit("--- page "), F.col("page").cast("string"), F.lit(" ---")).alias("line"))
    return marked.select("doc_id", "at", F.lit(1).alias("sub"), "line").unionByName(breaks)


def read(lines: DataFrame) -> DataFrame:
    """doc_id, role, elem_id, note, twice: annotated lines (doc_id, line_no, line); of lines of one element the last counts, twice tells of differing ones."""
    rx = patterns.DIAGRAM_LINE.pattern
    hit = lines.where(F.col("line").rlike(rx))
    parts = hit.select("doc_id", "line_no", F.regexp_extract("line", rx, 1).alias("role"), F.regexp_extract("line", rx, 2).cast("int").alias("elem_id"), F.when(F.col("line").rlike(r'^\W*\w+\s+#\d+\s+"[^"]*"'), F.regexp_extract("line", rx, 3)).alias("note"))
    return parts.groupBy("doc_id", "role", "elem_id").agg(F.max_by("note", "line_no").alias("note"), (F.count_distinct(F.coalesce(F.concat(F.lit("n"), "note"), F.lit("-"))) > 1).alias("twice"))


def reconcile(elem: DataFrame, roles: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, elem_id, role, status, title (as it should be) of all elements and lines of the documents that have lines.

    roles: doc_id, elem_id, role (mapped). wanted: as of read(). status: updated, cleared, unchanged,
    unmatched line (no such element, or of another role), unmatched element (no line for it). Only notes are
    ever cleared, no plain titles.
    """
    docs = wanted.select("doc_id").distinct()
    e = elem.select("doc_id", "elem_id", "title").join(dealt(roles.select("doc_id", "elem_id", "role")), ["doc_id", "elem_id"]).join(dealt(docs), "doc_id")
    key = ["doc_id", "elem_id", "role"]
    both = e.withColumn("is_elem", F.lit(True)).join(dealt(wanted.select(*key, "note").withColumn("is_line", F.lit(True))), key, "full_outer")
    noted = exprs.note_body(F.col("title")).isNotNull()
    same = F.when(F.col("note").isNotNull(), F.when(noted & (F.col("note") == F.col("title")), "unchanged").otherwise("updated")).when(noted, "cleared").otherwise("unchanged")
    status = F.when(F.col("is_elem").isNull(), "unmatched line").when(F.col("is_line").isNull(), "unmatched element").otherwise(same)
    title = F.when(F.col("is_line").isNull() | F.col("is_elem").isNull(), F.col("title")).when(F.col("note").isNotNull(), F.col("note")).when(~noted, F.col("title"))
    return both.select(*key, status.alias("status"), title.alias("title"))


def annotate(elem: DataFrame, roles: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """elem with the notes of an annotated diagram, and the number of each status a document."""
    got = reconcile(elem, roles, read(lines))
    new = got.where("status in ('updated', 'cleared')").select("doc_id", "elem_id", F.struct("title").alias("new"))
    out = elem.join(dealt(new), ["doc_id", "elem_id"], "left").withColumn("title", F.when(F.col("new").isNotNull(), F.col("new.title")).otherwise(F.col("title"))).select(*elem.columns)
    return out, got.groupBy("doc_id", "status").agg(F.count("*").alias("n"))


def outline_from(text: str) -> tuple[list[tuple[int, int | None, int, str, int]], list[str]]:
    """Rows node_id, parent_id, ord, title, page of an outline's text, and its errors."""
    rows, errors = patterns.parse_outline(text)
    count: dict[int | None, int] = {}
    out = []
    for r in rows:
        count[r["parent"]] = count.get(r["parent"], 0) + 1
        out.append((r["node"], r["parent"], count[r["parent"]], r["title"], r["page"]))
    return out, errors


def replace_outline(outline: DataFrame, doc: DataFrame, new: DataFrame) -> DataFrame:
    """outline with new rows for their documents; an entry whose page the document lacks goes, with all below it."""
    fits = new.join(dealt(doc.select("doc_id", "n_pages")), "doc_id").withColumn("bad", (F.col("page") < 1) | (F.col("page") > F.col("n_pages")))
    tree = fits.select("doc_id", F.col("node_id").alias("elem_id"), "parent_id", F.col("ord").alias("kid_ord"), "bad")
    gone = hierarchy.closure(hierarchy.numbered(tree.drop("bad"), hide_verified=False)).join(dealt(tree.where("bad").select("doc_id", F.col("elem_id").alias("anc_id"))), ["doc_id", "anc_id"]).select("doc_id", F.col("elem_id").alias("node_id")).distinct()
    kept = fits.join(dealt(gone), ["doc_id", "node_id"], "left_anti").select(*outline.columns)
    return outline.join(dealt(new.select("doc_id").distinct()), "doc_id", "left_anti").unionByName(kept)
