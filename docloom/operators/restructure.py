"""Repairs that make elements or move content: lists, tables of contents, page parts, links, web captures, instructions.

``wrap`` makes the new elements; the repairs pick members and roles for it. Functions take and
return whole tables, all documents at once. What a repair refuses stays as it was; a refused
instruction stays in its title, which is how ``refused`` finds it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import exprs
from docloom.operators import patterns, runs
from docloom.operators.hierarchy import closure, numbered, settled
from docloom.operators.repair import apply_edits, edits, renumber
from docloom.sources.tables import dealt

FAR = 1e9  # behind all children
CONTENT = ("mcr_num", "mcr_dict", "objr")


def edited(elem: DataFrame, log: DataFrame) -> DataFrame:
    return settled(apply_edits(elem, log))


def _tree(elem: DataFrame) -> DataFrame:
    return closure(numbered(elem.withColumn("role", F.col("role_raw")), hide_verified=False))


def fresh(elem: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with an elem_id beyond all of their document, in the order given."""
    top = elem.groupBy("doc_id").agg(F.max("elem_id").alias("top"))
    return rows.join(dealt(top), "doc_id").withColumn("elem_id", (F.col("top") + F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).cast("int")).drop("top")


def added(elem: DataFrame, rows: DataFrame) -> DataFrame:
    """elem and new rows: doc_id, elem_id, parent_id, role_raw, place; title and pg if they have one."""
    new = rows.select("doc_id", "elem_id", "parent_id", "role_raw", F.col("place").cast("double").alias("place"), *[c for c in ("title", "pg") if c in rows.columns])
    return settled(renumber(elem.withColumn("place", F.col("kid_ord").cast("double")).unionByName(new, allowMissingColumns=True)))


def wrap(elem: DataFrame, members: DataFrame) -> DataFrame:
    """Members (doc_id, elem_id, run, outer, inner) within new elements.

    The members of a run are siblings. outer, a run's array of roles from the outermost, is made
    once at its first member's place; inner is made around each member. A member's ``at``, if
    there is such a column, gives its place in the run; ``title`` names the outermost element.
    """
    members = settled(members)
    m = members.join(dealt(elem.select("doc_id", "elem_id", "parent_id", "kid_ord")), ["doc_id", "elem_id"])
    m = m.withColumn("at", F.coalesce(F.col("at") if "at" in members.columns else F.lit(None), F.col("kid_ord")).cast("double")).withColumn("title", F.col("title") if "title" in members.columns else F.lit(None).cast("string"))
    top = elem.groupBy("doc_id").agg(F.max("elem_id").alias("top"))
    run = m.groupBy("doc_id", "run").agg(F.min_by("outer", "kid_ord").alias("outer"), F.min_by("parent_id", "kid_ord").alias("parent_id"), F.min("kid_ord").cast("double").alias("place"), F.max("title").alias("title"))
    run = run.join(dealt(top), "doc_id").withColumn("n", F.size("outer")).withColumn("base", F.col("top") + F.sum("n").over(Window.partitionBy("doc_id").orderBy("run")) - F.col("n"))
    used = run.groupBy("doc_id").agg(F.max(F.col("base") + F.col("n")).alias("used"))
    m = m.select("doc_id", "elem_id", "run", "inner", "at").join(dealt(run.select("doc_id", "run", "base", "n", "parent_id")), ["doc_id", "run"]).join(dealt(used), "doc_id").withColumn("k", F.size("inner"))
    m = m.withColumn("own", F.col("used") + F.sum("k").over(Window.partitionBy("doc_id").orderBy("elem_id")) - F.col("k")).withColumn("holder", F.when(F.col("n") > 0, F.col("base") + F.col("n")).otherwise(F.col("parent_id")))

    def chain(rows: DataFrame, roles: str, base: str, up: str, place: str, title: Column) -> DataFrame:
        r = rows.select("*", F.posexplode(roles).alias("i", "role_raw"))
        first = F.col("i") == 0
        return r.select("doc_id", (F.col(base) + F.col("i") + 1).cast("int").alias("elem_id"), F.when(first, F.col(up)).otherwise(F.col(base) + F.col("i")).cast("int").alias("parent_id"), "role_raw", F.when(first, F.col(place)).otherwise(1.0).alias("place"), F.when(first, title).alias("title"))

    made = chain(run, "outer", "base", "parent_id", "place", F.col("title")).unionByName(chain(m, "inner", "own", "holder", "at", F.lit(None).cast("string")))
    wrapped = F.col("k") > 0
    to = m.select("doc_id", "elem_id", F.when(wrapped, F.col("own") + F.col("k")).otherwise(F.col("holder")).cast("int").alias("to"), F.when(wrapped, 1.0).otherwise(F.col("at")).alias("place"), F.lit(True).alias("moved"))
    old = elem.join(dealt(to), ["doc_id", "elem_id"], "left").withColumn("parent_id", F.when(F.col("moved"), F.col("to")).otherwise(F.col("parent_id"))).withColumn("place", F.coalesce("place", F.col("kid_ord").cast("double"))).drop("to", "moved")
    return settled(renumber(old.unionByName(made, allowMissingColumns=True)))


def roles(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def prune_above(elem: DataFrame, kid: DataFrame, emptied: DataFrame) -> DataFrame:
    """Without emptied elements (doc_id, elem_id) and ancestors that this leaves empty; roots stay.

    Whatever isn't among them keeps its ancestors, be it empty or not.
    """
    tree = _tree(elem)
    touched = tree.join(dealt(emptied.select("doc_id", "elem_id").distinct()), ["doc_id", "elem_id"]).select("doc_id", F.col("anc_id").alias("elem_id")).distinct()
    holds = kid.where(F.col("kind").isin(*CONTENT)).select("doc_id", F.col("owner_id").alias("elem_id")).unionByName(elem.select("doc_id", "elem_id").join(dealt(touched), ["doc_id", "elem_id"], "left_anti")).distinct()
    full = tree.join(dealt(holds), ["doc_id", "elem_id"]).select("doc_id", F.col("anc_id").alias("elem_id")).distinct()
    gone = touched.join(dealt(full), ["doc_id", "elem_id"], "left_anti").join(dealt(elem.where("parent_id is null").select("doc_id", "elem_id")), ["doc_id", "elem_id"], "left_anti")
    return settled(renumber(elem.join(dealt(gone), ["doc_id", "elem_id"], "left_anti").withColumn("place", F.col("kid_ord"))))


# Content and annotations


def drop_orphaned(elem: DataFrame, kid: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without marked content of hits (doc_id, elem_id, page_num, mcid), and elements that this empties."""
    left = kid.join(dealt(hits.select("doc_id", F.col("elem_id").alias("owner_id"), "page_num", "mcid").distinct()), ["doc_id", "owner_id", "page_num", "mcid"], "left_anti").select(*kid.columns)
    return prune_above(elem, left, hits), left


def drop_widgets(elem: DataFrame, kid: DataFrame, annot: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the annotations of hits (doc_id, annot_id), what refers to them, and field parents left without a child."""
    bad = hits.select("doc_id", "annot_id").distinct()
    rest = annot.join(dealt(bad), ["doc_id", "annot_id"], "left_anti")
    parents = annot.join(dealt(bad), ["doc_id", "annot_id"]).where("parent_id is not null").select("doc_id", F.col("parent_id").alias("annot_id")).distinct()
    still = rest.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("annot_id")).distinct()
    emptied_fields = parents.join(dealt(still), ["doc_id", "annot_id"], "left_anti")
    refs = kid.where("kind = 'objr'").join(dealt(bad), ["doc_id", "annot_id"])
    left = kid.join(dealt(bad.withColumn("kind", F.lit("objr"))), ["doc_id", "annot_id", "kind"], "left_anti").select(*kid.columns)
    return prune_above(elem, left, refs.select("doc_id", F.col("owner_id").alias("elem_id"))), left, rest.join(dealt(emptied_fields), ["doc_id", "annot_id"], "left_anti").select(*annot.columns)


def to_artifact(elem: DataFrame, kid: DataFrame, annot: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Subtrees of hits as artifacts: (elem, kid, annot, marks); marks are the (doc_id, page_num, mcid) now artifacts.

    Their content leaves the tree and their Link annotations go, with elements that this empties.
    """
    under = _tree(elem).join(dealt(hits.select("doc_id", F.col("elem_id").alias("anc_id")).distinct()), ["doc_id", "anc_id"]).select("doc_id", F.col("elem_id").alias("owner_id")).distinct()
    mine = kid.join(dealt(under), ["doc_id", "owner_id"])
    marks = mine.where("kind in ('mcr_num', 'mcr_dict')").select("doc_id", "page_num", "mcid").distinct()
    links = mine.where("kind = 'objr'").join(dealt(annot.where("subtype = 'Link'").select("doc_id", "annot_id")), ["doc_id", "annot_id"]).select("doc_id", "annot_id").distinct()
    refs = links.withColumn("kind", F.lit("objr"))
    left = kid.join(dealt(refs), ["doc_id", "annot_id", "kind"], "left_anti").join(dealt(under.withColumn("in_it", F.lit(True))), ["doc_id", "owner_id"], "left").where("in_it is null or kind = 'objr' or kind = 'elem'").select(*kid.columns)
    return prune_above(elem, left, under.withColumnRenamed("owner_id", "elem_id")), left, annot.join(dealt(links), ["doc_id", "annot_id"], "left_anti").select(*annot.columns), marks


def mark_links(elem: DataFrame, kid: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A new Link with its annotation, for hits (doc_id, page_num, annot_id, parent_id), behind the parent's children.

    Without a parent the first Document root takes it, or else the Document of the smallest id
    anywhere below; without that the document is left alone.
    """
    first = F.struct(F.col("parent_id").isNotNull().alias("below"), F.when(F.col("parent_id").isNull(), F.col("kid_ord")).alias("place"), "elem_id")
    root = elem.where("role_raw = 'Document'").groupBy("doc_id").agg(F.min_by("elem_id", first).alias("root_id"))
    new = hits.join(dealt(root), "doc_id", "left").withColumn("parent_id", F.coalesce("parent_id", "root_id")).where("parent_id is not null")
    new = fresh(elem, new, ["page_num", "annot_id"]).select("doc_id", "elem_id", "parent_id", F.lit("Link").alias("role_raw"), (F.lit(FAR) + F.col("elem_id")).alias("place"), F.col("page_num").alias("pg"), "annot_id")
    last = kid.groupBy("doc_id", F.col("owner_id").alias("parent_id")).agg(F.max("kid_ord").alias("last"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("elem_id"))
    slots = new.join(dealt(last), ["doc_id", "parent_id"], "left").select("doc_id", F.col("parent_id").alias("owner_id"), (F.coalesce("last", F.lit(0)) + rank).cast("int").alias("kid_ord"), F.lit("elem").alias("kind"), F.col("elem_id").alias("child_id"))
    refs = new.select("doc_id", F.col("elem_id").alias("owner_id"), F.lit(1).alias("kid_ord"), F.lit("objr").alias("kind"), F.col("pg").alias("page_num"), "annot_id")
    return added(elem, new), kid.unionByName(slots, allowMissingColumns=True).unionByName(refs, allowMissingColumns=True)


def fill_empty_links(kid: DataFrame, hits: DataFrame) -> DataFrame:
    """The marked content right before each Link of hits (doc_id, elem_id, mcid) becomes the Link's first kid.

    Only a Link that holds an annotation and no content, and only if that content is still right before it.
    """
    w = Window.partitionBy("doc_id", "owner_id").orderBy("kid_ord")
    before = kid.withColumn("b", F.lag(F.struct("kind", "mcid", "kid_ord")).over(w)).where("kind = 'elem'").select("doc_id", F.col("child_id").alias("elem_id"), "owner_id", "b")
    holds = kid.groupBy("doc_id", F.col("owner_id").alias("elem_id")).agg(F.count_if(F.col("kind").isin("mcr_num", "mcr_dict")).alias("n_mcr"), F.count_if(F.col("kind") == "objr").alias("n_objr"))
    ok = hits.select("doc_id", "elem_id", "mcid").distinct().join(dealt(before), ["doc_id", "elem_id"]).join(dealt(holds), ["doc_id", "elem_id"]).where("n_mcr = 0 and n_objr > 0 and b.kind in ('mcr_num', 'mcr_dict') and b.mcid = mcid")
    ok = ok.select("doc_id", "owner_id", F.col("b.kid_ord").alias("kid_ord"), F.col("elem_id").alias("link_id"))
    out = kid.join(dealt(ok), ["doc_id", "owner_id", "kid_ord"], "left").withColumn("kid_ord", F.when(F.col("link_id").isNotNull(), 0).otherwise(F.col("kid_ord"))).withColumn("owner_id", F.coalesce("link_id", "owner_id"))
    return out.withColumn("kid_ord", F.row_number().over(w)).select(*kid.columns)


def signposts(elem: DataFrame, hits: DataFrame) -> DataFrame:
    """An Lbl that tells of misartifacted text before each neighbour (doc_id, elem_id, text), unless a sibling tells it already."""
    note = F.concat(F.lit("misartifacted "), "text")
    want = hits.join(dealt(elem.select("doc_id", "elem_id", "parent_id", "kid_ord")), ["doc_id", "elem_id"]).where("parent_id is not null").withColumn("says", note)
    told = elem.select("doc_id", "parent_id", exprs.note_body(F.col("title")).alias("says")).where("says is not null").distinct()
    new = want.join(dealt(told), ["doc_id", "parent_id", "says"], "left_anti").groupBy("doc_id", "parent_id", "says").agg(F.min("kid_ord").alias("before"))
    new = fresh(elem, new, ["parent_id", "before", "says"]).select("doc_id", "elem_id", "parent_id", F.lit("Lbl").alias("role_raw"), (F.col("before") - 0.5).alias("place"), exprs.add_note(F.lit(None).cast("string"), F.col("says")).alias("title"))
    return added(elem, new)


# Lists


def paragraphs_to_list(elem: DataFrame, members: DataFrame) -> DataFrame:
    """Runs of paragraphs (doc_id, elem_id, run) as lists, an item each."""
    return wrap(elem, members.select("doc_id", "elem_id", "run", roles("L").alias("outer"), roles("LI", "LBody").alias("inner")))


def links_to_list(elem: DataFrame, hits: DataFrame) -> DataFrame:
    """Paragraphs of links (doc_id, elem_id) as lists; each Link is an item."""
    links = elem.where("role_raw = 'Link'").join(dealt(hits.select("doc_id", F.col("elem_id").alias("parent_id")).distinct()), ["doc_id", "parent_id"])
    listed = edited(elem, edits(hits, "set_role", value=F.lit("L")))
    return wrap(listed, links.select("doc_id", "elem_id", F.col("elem_id").alias("run"), roles().alias("outer"), roles("LI", "LBody").alias("inner")))


def merge_adjacent_lists(elem: DataFrame, kid: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Children of lists that stand right behind another list go to the first of the row.

    Lists that hold content themselves aren't merged. only: (doc_id, elem_id) of lists that may join the one before.
    """
    direct = kid.where(F.col("kind").isin(*CONTENT)).select("doc_id", F.col("owner_id").alias("elem_id"), F.lit(True).alias("direct")).distinct()
    may = elem.select("doc_id", "elem_id", F.lit(True).alias("may")) if only is None else only.select("doc_id", "elem_id", F.lit(True).alias("may")).distinct()
    plain = elem.join(dealt(direct), ["doc_id", "elem_id"], "left").join(dealt(may), ["doc_id", "elem_id"], "left").withColumn("list", (F.col("role_raw") == "L") & F.col("direct").isNull() & F.col("parent_id").isNotNull())
    w = Window.partitionBy("doc_id", "parent_id").orderBy("kid_ord")
    joins = plain.withColumn("joins", F.col("list") & F.coalesce(F.lag("list").over(w), F.lit(False)) & F.coalesce("may", F.lit(False)))
    rows = joins.withColumn("run", F.sum((~F.col("joins")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("first_id", F.first("elem_id").over(Window.partitionBy("doc_id", "parent_id", "run").orderBy("kid_ord")))
    late = rows.where("joins").select("doc_id", "elem_id", "first_id")
    kids = elem.join(dealt(late.select("doc_id", F.col("elem_id").alias("parent_id"), "first_id")), ["doc_id", "parent_id"])
    return edited(elem, edits(late, "splice").unionByName(edits(kids, "move", "elem_id", "first_id")))


def bullets_to_list(elem: DataFrame, kid: DataFrame, members: DataFrame) -> DataFrame:
    """Siblings beside bullets (doc_id, elem_id, run, page_num, y) as items by page, then from the top; joined to a list next to them."""
    at = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("page_num", F.desc("y"), "elem_id"))
    known = elem.select("doc_id", "elem_id").withColumn("old", F.lit(True))
    out = wrap(elem, members.select("doc_id", "elem_id", "run", at.alias("at"), roles("L").alias("outer"), roles("LI", "LBody").alias("inner")))
    fresh_lists = out.where("role_raw = 'L'").join(dealt(known), ["doc_id", "elem_id"], "left_anti").select("doc_id", "parent_id", F.col("kid_ord").alias("at"))
    # A new list may join the one before it, and the one after may join it.
    near = out.join(dealt(fresh_lists), ["doc_id", "parent_id"]).where("kid_ord in (at, at + 1)").select("doc_id", "elem_id")
    return merge_adjacent_lists(out, kid, near)


# Tables of contents, page parts, web captures


def toc_lines(leaves: DataFrame) -> DataFrame:
    """Lines and levels of a table's leaves: (doc_id, toc_id, elem_id, line, level).

    leaves: doc_id, toc_id, elem_id, pre, page_num, x0, y0, x1, y1. Leaves on one page that overlap
    by over 3 points in height share a line, as do those without a box; indents make the levels.
    """

    def step(g: pd.DataFrame) -> pd.DataFrame:
        line, at, box = [], -1, None
        for r in g.itertuples():
            if pd.isna(r.y0):
                at = max(at, 0)
            elif box is None or r.page_num != box[0] or min(r.y1, box[2]) - max(r.y0, box[1]) <= 3:
                at, box = at + (box is not None or at < 0), (r.page_num, r.y0, r.y1)
            else:
                box = (box[0], min(box[1], r.y0), max(box[2], r.y1))
            line.append(at)
        g = g.assign(line=line)
        edges = g.groupby("line")["x0"].min().ffill().fillna(0.0)
        levels = dict(zip(edges.index, runs.ladder(list(edges)), strict=True))
        return g.assign(level=g["line"].map(levels))[["doc_id", "toc_id", "elem_id", "line", "level"]]

    return runs.fold(leaves, ["doc_id", "toc_id"], ["pre"], step, "doc_id long, toc_id int, elem_id int, line int, level int")


def rebuild_toc(elem: DataFrame, leaves: DataFrame) -> DataFrame:
    """Tables of contents as TOCI > P a line, deeper lines in a TOC behind the entry above them.

    leaves as in toc_lines: the elements that stay; all other elements between them and their table go.
    """
    lines = settled(toc_lines(leaves))
    tree = _tree(elem)
    inside = tree.where("dist > 0").join(dealt(lines.select("doc_id", F.col("toc_id").alias("anc_id")).distinct()), ["doc_id", "anc_id"]).select("doc_id", "elem_id").distinct()
    below = tree.join(dealt(lines.select("doc_id", F.col("elem_id").alias("anc_id"))), ["doc_id", "anc_id"]).select("doc_id", "elem_id").distinct()
    flat = edited(elem, edits(inside.join(dealt(below), ["doc_id", "elem_id"], "left_anti"), "splice"))
    run = F.struct("toc_id", F.col("line").alias("at"))
    out = wrap(flat, lines.select("doc_id", "elem_id", run.alias("run"), roles("TOCI", "P").alias("outer"), roles().alias("inner")))
    # Entries of one level or deeper in a row stand in one nested table, from the outermost level in.
    entry = lines.join(dealt(out.select("doc_id", "elem_id", F.col("parent_id").alias("p_id"))), ["doc_id", "elem_id"]).join(dealt(out.select("doc_id", F.col("elem_id").alias("p_id"), F.col("parent_id").alias("entry_id"))), ["doc_id", "p_id"])
    entry = entry.groupBy("doc_id", "toc_id", "line").agg(F.min("entry_id").alias("elem_id"), F.min("level").alias("level"))
    entry = settled(entry)
    # A step a level of the deepest table: rungs are 10 points apart, and pages are narrow.
    highest = entry.agg(F.max("level")).first()[0] or 0
    w = Window.partitionBy("doc_id", "toc_id").orderBy("line")
    for depth in range(1, highest + 1):
        breaks = F.sum((F.col("level") < depth).cast("int")).over(w)
        deeper = entry.withColumn("run", F.struct("toc_id", breaks.alias("at"))).where(F.col("level") >= depth)
        out = wrap(out, deeper.select("doc_id", "elem_id", "run", roles("TOC").alias("outer"), roles().alias("inner")))
    return out


def page_parts(elem: DataFrame, doc: DataFrame, pages: DataFrame) -> DataFrame:
    """A Part for each page behind the Document's children; other children go to their page's Part.

    pages: doc_id, elem_id, page. Documents of one page or without a Document root stay as they are.
    """
    root = elem.where("parent_id is null and role_raw = 'Document'").groupBy("doc_id").agg(F.min_by("elem_id", "kid_ord").alias("root_id")).join(dealt(doc.where("n_pages >= 2").select("doc_id", "n_pages")), "doc_id")
    kids = elem.join(dealt(root), "doc_id").where("parent_id = root_id")
    have = kids.where("role_raw = 'Part' and pg is not null").groupBy("doc_id", "pg").agg(F.min_by("elem_id", "kid_ord").alias("part_id"))
    lacking = root.select("doc_id", "root_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("pg")).join(dealt(have), ["doc_id", "pg"], "left_anti")
    new = fresh(elem, lacking, ["pg"]).select("doc_id", "elem_id", F.col("root_id").alias("parent_id"), F.lit("Part").alias("role_raw"), (F.lit(FAR) + F.col("pg")).alias("place"), F.concat(F.lit("p. "), "pg").alias("title"), "pg")
    parts = have.unionByName(new.select("doc_id", "pg", F.col("elem_id").alias("part_id")))
    move = kids.where("role_raw <> 'Part'").select("doc_id", "elem_id", "kid_ord").join(dealt(pages.select("doc_id", "elem_id", F.col("page").alias("pg"))), ["doc_id", "elem_id"]).join(dealt(parts), ["doc_id", "pg"])
    return edited(added(elem, new), edits(move, "move", "elem_id", "part_id", F.lit(FAR) + F.col("kid_ord")))


def capture_order(doc: DataFrame, url_page: DataFrame, wanted: list[str]) -> DataFrame:
    """doc_id, page_num, to: pages of the wanted captures first, as configured, then the others as they stood.

    A pattern means the shortest URL that holds it; a page counts for the first capture that claims it.
    """
    said = F.array_compact(F.array(F.lit(None).cast("int"), *[F.when(F.contains(F.col("url"), F.lit(p)), F.lit(i)) for i, p in enumerate(wanted)]))
    pick = url_page.select("doc_id", "url", "url_ord", F.explode(said).alias("want")).groupBy("doc_id", "want").agg(F.min_by("url_ord", F.struct(F.length("url"), "url_ord")).alias("url_ord"))
    claim = url_page.join(dealt(pick), ["doc_id", "url_ord"]).groupBy("doc_id", "page_num").agg(F.min(F.struct("want", "page_ord")).alias("claim"))
    pages = doc.select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest("n_pages", F.lit(1)))).alias("page_num")).join(dealt(claim), ["doc_id", "page_num"], "left")
    return pages.select("doc_id", "page_num", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("claim").asc_nulls_last(), "page_num")).alias("to"))


def reorder_pages(table: DataFrame, order: DataFrame, page: str = "page_num") -> DataFrame:
    """Any table with its pages renumbered as capture_order says."""
    to = order.select("doc_id", F.col("page_num").alias(page), "to")
    return table.join(dealt(to), ["doc_id", page], "left").withColumn(page, F.coalesce("to", page)).select(*table.columns)


def wrap_captures(elem: DataFrame, url_page: DataFrame, pages: DataFrame) -> DataFrame:
    """An Art for each URL around the Document's children whose page is its own; the first URL has a page, and Art children stay."""
    root = elem.where("parent_id is null and role_raw = 'Document'").groupBy("doc_id").agg(F.min_by("elem_id", "kid_ord").alias("parent_id"))
    owner = url_page.groupBy("doc_id", F.col("page_num").alias("page")).agg(F.min("url_ord").alias("run"))
    kids = elem.where("role_raw <> 'Art'").join(dealt(root), ["doc_id", "parent_id"]).select("doc_id", "elem_id").join(dealt(pages.select("doc_id", "elem_id", "page")), ["doc_id", "elem_id"]).join(dealt(owner), ["doc_id", "page"])
    return wrap(elem, kids.select("doc_id", "elem_id", "run", roles("Art").alias("outer"), roles().alias("inner")))


# Instructions


def _said(verb: str) -> Column:
    """The argument of the first instruction of this verb in a title; null without one."""
    order = F.get(F.filter(exprs.segments(F.col("title")), lambda s: F.rlike(s, F.lit(rf"^!{verb}(\s|$)"))), F.lit(0))
    return F.trim(F.regexp_replace(order, rf"^!{verb}", ""))


def told(elem: DataFrame, verb: str) -> DataFrame:
    return elem.withColumn("said", _said(verb)).where("said is not null")


def cleared(elem: DataFrame, done: DataFrame, *tags: str) -> DataFrame:
    """elem without notes of these tags on the elements of done (doc_id, elem_id)."""
    title = F.col("title")
    for t in tags:
        title = exprs.clear_notes(title, t)
    return settled(elem.join(dealt(done.select("doc_id", "elem_id", F.lit(True).alias("done")).distinct()), ["doc_id", "elem_id"], "left").withColumn("title", F.when(F.col("done"), title).otherwise(F.col("title"))).drop("done").select(*elem.columns))


def refused(elem: DataFrame) -> DataFrame:
    """doc_id, elem_id, note: instructions that are still there."""
    left = F.filter(exprs.segments(F.col("title")), lambda s: F.startswith(s, F.lit("!")))
    return elem.select("doc_id", "elem_id", F.explode(left).alias("note"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _chain(said: pd.Series) -> pd.Series:
    def one(s: str) -> list[str] | None:
        try:
            return patterns.parent_chain(s)
        except ValueError:
            return None

    return said.map(one)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))
def _ranges(said: pd.Series, n: pd.Series) -> pd.Series:
    def one(s: str, k: int) -> list[dict] | None:
        try:
            return [{"role": r, "first": a, "last": b} for r, a, b in patterns.child_ranges(s, k)]
        except ValueError:
            return None

    return pd.Series([one(s, int(k)) for s, k in zip(said, n, strict=True)], dtype=object)


def add_parents(elem: DataFrame) -> DataFrame:
    """``!ADD_PARENT chain``: the element within a chain of new ones."""
    hits = told(elem, "ADD_PARENTS?").where("said <> ''").withColumn("outer", _chain("said")).where("outer is not null and size(outer) > 0").select("doc_id", "elem_id", F.col("elem_id").alias("run"), "outer", roles().alias("inner"))
    hits = settled(hits)
    return wrap(cleared(elem, hits, "!ADD_PARENT", "!ADD_PARENTS"), hits)


def add_children(elem: DataFrame) -> DataFrame:
    """``!ADD_CHILD wrappers``: ranges of children within new ones, or new empty ones behind them."""
    n = elem.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("elem_id")).agg(F.count("*").cast("int").alias("n"))
    hits = told(elem, "ADD_CHILD(?:REN)?").where("said <> ''").join(dealt(n), ["doc_id", "elem_id"], "left").fillna(0, ["n"]).withColumn("to", _ranges("said", "n")).where("size(to) > 0")
    hits = settled(hits)
    each = hits.select("doc_id", F.col("elem_id").alias("parent_id"), F.posexplode("to").alias("i", "w")).select("doc_id", "parent_id", "i", "w.*")
    rank = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("kid_ord", "elem_id"))
    kids = elem.where("parent_id is not null").withColumn("at", rank).select("doc_id", "parent_id", "elem_id", "at")
    spans = kids.join(dealt(each.where("first > 0")), ["doc_id", "parent_id"]).where("at between first and last")
    out = wrap(cleared(elem, hits, "!ADD_CHILD", "!ADD_CHILDREN"), spans.select("doc_id", "elem_id", F.struct("parent_id", "i").alias("run"), F.array("role").alias("outer"), roles().alias("inner")))
    new = fresh(out, each.where("first = 0"), ["parent_id", "i"]).select("doc_id", "elem_id", "parent_id", F.col("role").alias("role_raw"), (F.lit(FAR) + F.col("i")).alias("place"))
    return added(out, new)


def reorder_kids(elem: DataFrame) -> DataFrame:
    """``!REORDER_KIDS``: children with ``!REORDER n`` first, by n, then the others as they stood; moves are noted."""
    hits = told(elem, "REORDER_KIDS").select("doc_id", "elem_id")
    kids = elem.join(dealt(hits.select("doc_id", F.col("elem_id").alias("parent_id"))), ["doc_id", "parent_id"]).withColumn("pos", F.try_to_number(F.regexp_extract(_said("REORDER"), r"^(\d{1,9})", 1), F.lit("999999999")).cast("int"))
    w = Window.partitionBy("doc_id", "parent_id")
    kids = kids.withColumn("old", F.row_number().over(w.orderBy("kid_ord"))).withColumn("new", F.row_number().over(w.orderBy(F.col("pos").asc_nulls_last(), "kid_ord")))
    bare = exprs.clear_notes(exprs.clear_notes(F.col("title"), "!REORDER"), "MOVE")
    note = F.concat(F.lit("MOVE "), F.col("old").cast("string"), F.lit(" -> "), F.col("new").cast("string"))
    kids = kids.withColumn("value", F.when(F.col("old") != F.col("new"), exprs.add_note(bare, note)).otherwise(bare))
    log = edits(kids, "move", "elem_id", "parent_id", F.col("new")).unionByName(edits(kids.where("pos is not null"), "set_title", value=F.col("value")))
    return cleared(edited(elem, log), hits, "!REORDER_KIDS")


def artifacts(elem: DataFrame, kid: DataFrame, annot: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``!ARTIFACT``: the element and all below it."""
    hits = told(elem, "ARTIFACT")
    return to_artifact(cleared(elem, hits, "!ARTIFACT"), kid, annot, hits)


def unlink(elem: DataFrame, kid: DataFrame, annot: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``!UNLINK`` on a Link below another element: what it holds goes to its parent, at its place, and its annotations go."""
    hits = told(elem, "UNLINK").where("role_raw = 'Link' and parent_id is not null").select("doc_id", "elem_id", "parent_id")
    mine = hits.select("doc_id", F.col("elem_id").alias("owner_id"), F.col("parent_id").alias("up"))
    bad = kid.where("kind = 'objr'").join(dealt(mine), ["doc_id", "owner_id"]).select("doc_id", "annot_id").distinct()
    slot = kid.where("kind = 'elem'").join(dealt(hits.select("doc_id", F.col("elem_id").alias("child_id"))), ["doc_id", "child_id"]).select("doc_id", F.col("child_id").alias("owner_id"), F.col("kid_ord").alias("slot"))
    out = kid.join(dealt(mine), ["doc_id", "owner_id"], "left").join(dealt(slot), ["doc_id", "owner_id"], "left").where("up is null or kind <> 'objr'")
    out = out.join(dealt(hits.select("doc_id", F.col("elem_id").alias("child_id"), F.lit(True).alias("gone"))), ["doc_id", "child_id"], "left").where("gone is null")
    out = out.withColumn("a", F.coalesce("slot", "kid_ord")).withColumn("owner_id", F.coalesce("up", "owner_id")).withColumn("kid_ord", F.row_number().over(Window.partitionBy("doc_id", "owner_id").orderBy("a", "kid_ord")))
    return edited(elem, edits(hits, "splice")), out.select(*kid.columns), annot.join(dealt(bad), ["doc_id", "annot_id"], "left_anti").select(*annot.columns)


def unwrap_lists(elem: DataFrame, kid: DataFrame) -> DataFrame:
    """``!UNWRAP_LIST`` on an L below another element: what its items' bodies hold takes its place.

    Refused unless all its children are LI, theirs are LBody, and none of the three holds content itself.
    """
    hits = told(elem, "UNWRAP_LIST").where("role_raw = 'L' and parent_id is not null").select("doc_id", "elem_id")
    parts = _tree(elem).where("dist <= 2").join(dealt(hits.select("doc_id", F.col("elem_id").alias("anc_id"))), ["doc_id", "anc_id"]).join(dealt(elem.select("doc_id", "elem_id", "role_raw")), ["doc_id", "elem_id"])
    direct = kid.where(F.col("kind").isin(*CONTENT)).select("doc_id", F.col("owner_id").alias("elem_id"), F.lit(True).alias("direct")).distinct()
    want = F.element_at(roles("L", "LI", "LBody"), F.col("dist") + 1)
    parts = parts.join(dealt(direct), ["doc_id", "elem_id"], "left").withColumn("ok", (F.col("role_raw") == want) & F.col("direct").isNull())
    good = parts.groupBy("doc_id", "anc_id").agg(F.bool_and("ok").alias("ok")).where("ok").select("doc_id", "anc_id")
    return edited(elem, edits(parts.join(dealt(good), ["doc_id", "anc_id"]), "splice"))
