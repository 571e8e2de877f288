"""Fixes as edits of the element table: nothing is changed in place.

An edit is doc_id, kind, elem_id, parent_id, kid_ord and value:

* ``set_role``, ``set_title``: value for elem_id;
* ``delete``: elem_id goes, with all below it;
* ``splice``: elem_id goes, its children stand in its place;
* ``move``: elem_id goes to parent_id, behind its last child, or to the place kid_ord;
* ``insert``: a new element of role value under parent_id, at place kid_ord.

Edits of one check are applied together, then children are numbered anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import exprs
from docloom.operators.hierarchy import closure, numbered, prune_empty, settled
from docloom.sources.tables import dealt

EDIT = "doc_id long, kind string, elem_id int, parent_id int, kid_ord double, value string"
COLUMNS = ["doc_id", "elem_id", "parent_id", "kid_ord", "role_raw", "pg", "title", "alt", "actual_text"]


def edits(rows: DataFrame, kind: str, elem_id: str | Column | None = "elem_id", parent_id: str | Column | None = None, kid_ord: Column | None = None, value: Column | None = None) -> DataFrame:
    col = lambda x: F.lit(None) if x is None else F.col(x) if isinstance(x, str) else x
    return rows.select("doc_id", F.lit(kind).alias("kind"), col(elem_id).cast("int").alias("elem_id"), col(parent_id).cast("int").alias("parent_id"), col(kid_ord).cast("double").alias("kid_ord"), col(value).cast("string").alias("value"))


def renumber(elem: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "parent_id").orderBy("place", "elem_id")
    return elem.withColumn("kid_ord", F.row_number().over(w)).select(*COLUMNS)


def apply_edits(elem: DataFrame, log: DataFrame) -> DataFrame:
    """elem with the edits of one check. A spliced element's children go up to the nearest element that stays."""
    log = settled(log)  # read once for each kind
    pick = lambda kind: log.where(F.col("kind") == kind)
    one = log.where("kind in ('set_role', 'set_title', 'move')").groupBy("doc_id", F.col("elem_id").alias("e_id")).agg(
        F.max(F.when(F.col("kind") == "set_role", F.col("value"))).alias("new_role"),
        F.max(F.when(F.col("kind") == "set_title", F.struct(F.lit(1).alias("has"), "value"))).alias("new_title"),
        F.max(F.when(F.col("kind") == "move", F.struct("parent_id", "kid_ord"))).alias("to"),
    )
    numbers = settled(numbered(elem.select("doc_id", "elem_id", "parent_id", "kid_ord"), hide_verified=False))
    tree = closure(numbers)
    gone = tree.join(dealt(pick("delete").select("doc_id", F.col("elem_id").alias("anc_id"))), ["doc_id", "anc_id"]).select("doc_id", "elem_id").distinct()
    out = elem.join(dealt(gone), ["doc_id", "elem_id"], "left_anti")

    # The path below the nearest ancestor that stays orders what was spliced.
    spliced = pick("splice").select("doc_id", F.col("elem_id").alias("anc_id"), F.lit(True).alias("out")).distinct()
    up = tree.where("dist > 0").join(dealt(spliced), ["doc_id", "anc_id"], "left").where("out is null").groupBy("doc_id", "elem_id").agg(F.min_by("anc_id", "dist").alias("stays"))
    out = out.join(dealt(spliced.withColumnRenamed("anc_id", "elem_id")), ["doc_id", "elem_id"], "left").where("out is null").drop("out")
    out = out.join(dealt(up), ["doc_id", "elem_id"], "left").join(dealt(numbers.select("doc_id", "elem_id", "pre")), ["doc_id", "elem_id"]).withColumn("lifted", ~F.col("parent_id").eqNullSafe(F.col("stays")))
    w = Window.partitionBy("doc_id", "stays")
    out = out.withColumn("place", F.when(F.max("lifted").over(w), F.col("pre").cast("double")).otherwise(F.col("kid_ord").cast("double"))).withColumn("parent_id", F.col("stays"))

    new = pick("insert").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_id", "kid_ord", "value")))
    top = elem.groupBy("doc_id").agg(F.max("elem_id").alias("top"))
    made = new.drop("elem_id").join(dealt(top), "doc_id").select("doc_id", (F.col("top") + F.col("n")).cast("int").alias("elem_id"), "parent_id", F.col("value").alias("role_raw"), F.lit(None).cast("int").alias("pg"), *[F.lit(None).cast("string").alias(c) for c in ("title", "alt", "actual_text")], F.col("kid_ord").alias("place"))

    out = out.join(dealt(one.withColumnRenamed("e_id", "elem_id")), ["doc_id", "elem_id"], "left")
    far = 1e9 + F.col("pre")
    out = out.select(
        "doc_id", "elem_id", F.when(F.col("to").isNotNull(), F.col("to.parent_id")).otherwise(F.col("parent_id")).alias("parent_id"), F.coalesce("new_role", "role_raw").alias("role_raw"), "pg",
        F.when(F.col("new_title").isNotNull(), F.col("new_title.value")).otherwise(F.col("title")).alias("title"), "alt", "actual_text", F.when(F.col("to").isNotNull(), F.coalesce("to.kid_ord", far)).otherwise(F.col("place")).alias("place"),
    )
    return renumber(out.unionByName(made))


# Fixes of documents: the doc table with defaults filled in.


def fix_documents(doc: DataFrame) -> DataFrame:
    return doc.withColumns({"lang": F.coalesce("lang", F.lit("en-US")), "tab_order_p1": F.coalesce("tab_order_p1", F.lit("S")), "marked": F.lit(True), "ua_part": F.lit(None).cast("int")})


def inline_destinations(annot: DataFrame, dest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """annot with named destinations resolved to pages; and orphans, names without a page, by number."""
    known = dest.groupBy("doc_id", F.col("name").alias("goto_name")).agg(F.min("page").alias("named_page"))
    out = annot.join(dealt(known), ["doc_id", "goto_name"], "left")
    orphans = out.where("goto_name is not null and named_page is null").groupBy("doc_id", "goto_name").agg(F.count("*").alias("n"))
    fixed = out.withColumn("goto_page", F.coalesce("goto_page", "named_page")).withColumn("goto_name", F.when(F.col("named_page").isNull(), F.col("goto_name"))).drop("named_page")
    return fixed.select(*annot.columns), orphans


def fix_ligatures(font_map: DataFrame) -> DataFrame:
    return font_map.withColumn("mapped", F.coalesce(exprs.ligature(F.col("code"), F.col("mapped"), F.col("base_font")), F.col("mapped")))


def replace_role_map(role_map: DataFrame, desired: dict[str, str]) -> DataFrame:
    """Each document's role map; an empty one removes all. Blank roles are refused."""
    clean = {k.strip().removeprefix("/"): v.strip().removeprefix("/") for k, v in desired.items()}
    if not all(clean) or not all(clean.values()):
        raise ValueError("a role is blank")
    docs = role_map.select("doc_id").distinct()
    if not clean:
        return role_map.limit(0)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.lit(v).alias("mapped")) for k, v in sorted(clean.items())]))
    return docs.select("doc_id", rows.alias("r")).select("doc_id", "r.*")


# Fixes of trees, each from the issues of its check (doc_id, elem_id).


def missing_document(elem: DataFrame, hits: DataFrame) -> DataFrame:
    """A Document around all roots."""
    roots = elem.where("parent_id is null").join(dealt(hits.select("doc_id").distinct()), "doc_id")
    with_new = apply_edits(elem, edits(roots.select("doc_id").distinct(), "insert", None, None, F.lit(0), F.lit("Document")))
    new = with_new.where("parent_id is null and role_raw = 'Document'").select("doc_id", F.col("elem_id").alias("new_id"))
    others = roots.select("doc_id", "elem_id").join(dealt(new), "doc_id")
    return apply_edits(with_new, edits(others, "move", "elem_id", "new_id"))


def reading_order(elem: DataFrame, positions: DataFrame, hits: DataFrame) -> DataFrame:
    """Children of the hit parents by first content. positions: doc_id, elem_id, page_num, mcid."""
    kids = elem.join(dealt(hits.select("doc_id", F.col("elem_id").alias("parent_id")).distinct()), ["doc_id", "parent_id"]).select("doc_id", "elem_id", "parent_id", "kid_ord")
    at = positions.groupBy("doc_id", "elem_id").agg(F.min(F.struct("page_num", "mcid")).alias("at"))
    w = Window.partitionBy("doc_id", "parent_id").orderBy(F.col("at").asc_nulls_last(), "kid_ord")
    ranked = kids.join(dealt(at), ["doc_id", "elem_id"], "left").withColumn("r", F.row_number().over(w))
    return apply_edits(elem, edits(ranked, "move", "elem_id", "parent_id", F.col("r")))


def needless_nesting(elem: DataFrame, grouping: tuple[str, ...]) -> DataFrame:
    return apply_edits(elem, edits(elem.where(F.col("role_raw").isin(*grouping) & ~((F.col("role_raw") == "Part") & F.col("pg").isNotNull()) & F.col("parent_id").isNotNull()), "splice"))


def set_roles(elem: DataFrame, hits: DataFrame, role: Column) -> DataFrame:
    return apply_edits(elem, edits(hits, "set_role", value=role))


def note_headings(elem: DataFrame, hits: DataFrame) -> DataFrame:
    """Tool notes with the instruction to set the role; instructions are executed by a later check."""
    new = elem.join(dealt(hits.select("doc_id", "elem_id", "detail")), ["doc_id", "elem_id"]).withColumn("note", exprs.add_note(F.col("title"), F.concat(F.lit("!SET_ROLE "), "detail")))
    return apply_edits(elem, edits(new, "set_title", value=F.col("note")))


def execute_set_role(elem: DataFrame) -> DataFrame:
    """``!SET_ROLE r`` notes carried out and replaced by what was done."""
    order = F.get(F.filter(exprs.segments(F.col("title")), lambda s: F.startswith(s, F.lit("!SET_ROLE "))), F.lit(0))
    hits = elem.withColumn("to", F.trim(F.substring(order, F.lit(11), F.length(order)))).where("to <> ''")
    done = F.concat(F.lit("__:INST OK (was: "), "role_raw", F.lit(")"))
    return apply_edits(elem, edits(hits, "set_role", value=F.col("to")).unionByName(edits(hits, "set_title", value=done)))


def clear_notes(elem: DataFrame, tool_only: bool = False) -> DataFrame:
    mine = exprs.tool_authored(F.col("title")) if tool_only else F.lit(True)
    return elem.withColumn("title", F.when(~(exprs.note_body(F.col("title")).isNotNull() & mine), F.col("title")))


def empty_elements(elem: DataFrame, leaves: DataFrame) -> DataFrame:
    """Without elements that hold nothing, and those that this empties."""
    n = prune_empty(numbered(elem.withColumn("role", F.col("role_raw")), hide_verified=False), leaves)
    return renumber(n.withColumn("place", F.col("kid_ord")))


def merge_split_links(elem: DataFrame, kid: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kids of a run's later Links go to its first, annotations first. runs: doc_id, first_id, elem_id (the run's members)."""
    to = runs.select("doc_id", F.col("elem_id").alias("owner_id"), "first_id")
    moved = kid.join(dealt(to), ["doc_id", "owner_id"], "left").withColumn("new_owner", F.coalesce("first_id", "owner_id"))
    w = Window.partitionBy("doc_id", "new_owner").orderBy((F.col("kind") != "objr") & F.col("first_id").isNotNull(), "owner_id", "kid_ord")
    late = runs.where("elem_id <> first_id")
    gone = late.select("doc_id", F.col("elem_id").alias("child_id"), F.lit(True).alias("gone"))
    moved = moved.join(dealt(gone), ["doc_id", "child_id"], "left").where("gone is null").withColumn("kid_ord", F.row_number().over(w)).withColumn("owner_id", F.col("new_owner"))
    return apply_edits(elem, edits(late, "splice")), moved.select(*kid.columns)
