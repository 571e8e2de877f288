"""Detect, repair, next check: each check runs on what the repairs of those before it left.

Of each check's findings the fixes go by priority; those that an earlier one makes needless
are superseded, those that a repair refuses are failed. Tables that a step changed are
written before the next one reads them, so that plans stay short. A document with a fatal
finding is left as it is from there on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import constants as K
from docloom.operators import geometry, hierarchy, repair, restructure, splitting
from docloom.operators.checks import CHECKS, Context, issue_rows, link_runs, list_evidence
from docloom.operators.patterns import VERBS
from docloom.plans.pipeline import resolve, validate_prereqs
from docloom.sources.tables import bounds, dealt, delete, scratch, write

Tables = dict[str, DataFrame]
#: What a repair returns: changed tables, and under "failed" (doc_id, seq) of findings that it refused.
FIXES: dict[str, Callable[[Context, DataFrame], Tables]] = {}


def fix(*kinds: str) -> Callable:
    def put(f: Callable) -> Callable:
        FIXES.update(dict.fromkeys(kinds, f))
        return f

    return put


def resynced(before: DataFrame, elem: DataFrame, kid: DataFrame) -> Tables:
    """elem and kid with slots that agree after elements were made, moved or removed.

    The i-th child of an element takes the i-th slot that children had in it; further ones
    stand behind all it holds. What a removed element held goes to its nearest ancestor that
    stays, behind all that holds, so that no content is lost.
    """
    slots = kid.where("kind = 'elem'").groupBy("doc_id", F.col("owner_id").alias("parent_id")).agg(F.sort_array(F.collect_list("kid_ord")).alias("slots"))
    top = kid.groupBy("doc_id", F.col("owner_id").alias("parent_id")).agg(F.max("kid_ord").alias("top"))
    i = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("kid_ord", "elem_id"))
    placed = elem.withColumn("i", i).join(dealt(slots), ["doc_id", "parent_id"], "left").join(dealt(top), ["doc_id", "parent_id"], "left")
    n = F.coalesce(F.size("slots"), F.lit(0))
    slot = F.when(F.col("parent_id").isNull(), F.col("i")).otherwise(F.coalesce(F.get("slots", F.col("i") - 1), F.coalesce("top", F.lit(0)) + F.col("i") - F.greatest(n, F.lit(0))))
    out = placed.withColumn("kid_ord", slot.cast("int")).select(*elem.columns)
    own = out.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("owner_id"), "kid_ord", F.lit("elem").alias("kind"), F.col("elem_id").alias("child_id"), *[F.lit(None).cast("int").alias(c) for c in ("mcid", "page_num", "annot_id")])

    stays = elem.select("doc_id", F.col("elem_id").alias("anc_id"))
    heirs = hierarchy.closure(hierarchy.numbered(before, hide_verified=False)).join(dealt(stays), ["doc_id", "anc_id"]).groupBy("doc_id", F.col("elem_id").alias("owner_id")).agg(F.min_by("anc_id", "dist").alias("heir"))
    # Owners made by the repair have no heir and need none.
    rest = kid.where("kind <> 'elem'").join(dealt(heirs), ["doc_id", "owner_id"], "left").join(dealt(stays.select("doc_id", F.col("anc_id").alias("owner_id"), F.lit(True).alias("stays"))), ["doc_id", "owner_id"], "left")
    rest = rest.where("stays or heir is not null").withColumn("kid_ord", F.when(F.col("stays"), F.col("kid_ord")).otherwise(F.col("kid_ord") + 1_000_000)).withColumn("owner_id", F.when(F.col("stays"), F.col("owner_id")).otherwise(F.col("heir")))
    return {"elem": out, "kid": rest.select(*kid.columns).unionByName(own.select(*kid.columns))}


def changed(ctx: Context, elem: DataFrame, kid: DataFrame | None = None) -> Tables:
    """resynced() reads elem and kid several times: they are computed once, else their plans would multiply and fill the driver."""
    return resynced(ctx["elem"], ctx.settled(elem, "edited"), ctx["kid"] if kid is None else ctx.settled(kid, "edited"))


def _documents(ctx: Context, hits: DataFrame, **values: object) -> Tables:
    hit = hits.select("doc_id").distinct().withColumn("hit", F.lit(True))
    doc = ctx["doc"].join(dealt(hit), "doc_id", "left")
    for c, v in values.items():
        doc = doc.withColumn(c, F.when(F.col("hit"), F.lit(v).cast(ctx["doc"].schema[c].dataType)).otherwise(F.col(c)))
    return {"doc": doc.select(*ctx["doc"].columns)}


@fix("Language")
def language(ctx: Context, hits: DataFrame) -> Tables:
    return _documents(ctx, hits, lang="en-US")


@fix("TabOrder")
def tab_order(ctx: Context, hits: DataFrame) -> Tables:
    return _documents(ctx, hits, tab_order_p1="S")


@fix("TaggedPdf")
def tagged(ctx: Context, hits: DataFrame) -> Tables:
    return _documents(ctx, hits, marked=True)


@fix("PdfUaConformance")
def conformance(ctx: Context, hits: DataFrame) -> Tables:
    return _documents(ctx, hits, ua_part=None)


@fix("MissingDocument")
def missing_document(ctx: Context, hits: DataFrame) -> Tables:
    return changed(ctx, repair.missing_document(ctx["elem"], hits))


@fix("StructTreeOrder")
def struct_tree_order(ctx: Context, hits: DataFrame) -> Tables:
    return changed(ctx, repair.reading_order(ctx["elem"], ctx.below.select("doc_id", "elem_id", "page_num", "mcid"), hits))


@fix("UnmarkedLink")
def unmarked_link(ctx: Context, hits: DataFrame) -> Tables:
    """Each annotation in a new Link below the element that it overlaps best."""
    bad = hits.select("doc_id", F.col("detail").cast("int").alias("annot_id"))
    box = bounds(ctx["annot"]).join(dealt(bad), ["doc_id", "annot_id"]).select("doc_id", "page_num", "annot_id", "x0", "y0", "x1", "y1")
    may = ctx.elem.where(~F.col("role").isin("Link", "Reference")).select("doc_id", "elem_id", "depth", "pre")
    elems = may.join(dealt(ctx.text.select("doc_id", "elem_id", "page_num", "x0", "y0", "x1", "y1")), ["doc_id", "elem_id"])
    best = geometry.best_overlap(box, elems).select("doc_id", "annot_id", F.col("elem_id").alias("parent_id"))
    elem, kid = restructure.mark_links(ctx["elem"], ctx["kid"], box.select("doc_id", "page_num", "annot_id").join(dealt(best), ["doc_id", "annot_id"], "left"))
    marked = kid.where("kind = 'objr'").select("doc_id", "annot_id", F.col("owner_id").alias("now")).join(dealt(bad), ["doc_id", "annot_id"])
    annot = ctx["annot"].join(dealt(marked), ["doc_id", "annot_id"], "left").withColumn("struct_parent", F.coalesce("struct_parent", "now")).select(*ctx["annot"].columns)
    failed = hits.withColumn("annot_id", F.col("detail").cast("int")).join(dealt(marked), ["doc_id", "annot_id"], "left_anti").select("doc_id", "seq")
    return changed(ctx, elem, kid) | {"annot": annot, "failed": failed}


@fix("UnexpectedWidget")
def unexpected_widget(ctx: Context, hits: DataFrame) -> Tables:
    elem, kid, annot = restructure.drop_widgets(ctx["elem"], ctx["kid"], ctx["annot"], hits.select("doc_id", F.col("detail").cast("int").alias("annot_id")))
    return changed(ctx, elem, kid) | {"annot": annot}


@fix("BadlyMappedLigature")
def ligatures(ctx: Context, hits: DataFrame) -> Tables:
    hit = hits.select("doc_id").distinct()
    bad = ctx["font_map"].join(dealt(hit), "doc_id")
    return {"font_map": ctx["font_map"].join(dealt(hit), "doc_id", "left_anti").unionByName(repair.fix_ligatures(bad).select(*ctx["font_map"].columns))}


@fix("OrphanedContent")
def orphaned_content(ctx: Context, hits: DataFrame) -> Tables:
    bad = hits.select("doc_id", F.col("elem_id").alias("owner_id"), F.col("detail").cast("int").alias("kid_ord")).distinct()
    kid = ctx["kid"].join(dealt(bad), ["doc_id", "owner_id", "kid_ord"], "left_anti").select(*ctx["kid"].columns)
    return changed(ctx, restructure.prune_above(ctx["elem"], kid, hits), kid)


@fix("NeedlessNesting")
def needless_nesting(ctx: Context, hits: DataFrame) -> Tables:
    """Grouping elements go, also those that the role map makes such; a root stays."""
    group = ctx.elem.where(F.col("role").isin(*K.GROUPING) & ~((F.col("role_raw") == "Part") & F.col("pg").isNotNull()) & F.col("parent_id").isNotNull())
    return changed(ctx, repair.apply_edits(ctx["elem"], repair.edits(group.join(dealt(hits.select("doc_id").distinct()), "doc_id"), "splice")))


@fix("MissingPageParts")
def page_parts(ctx: Context, hits: DataFrame) -> Tables:
    docs = ctx["doc"].join(dealt(hits.select("doc_id").distinct()), "doc_id")
    root = ctx["elem"].where("parent_id is null and role_raw = 'Document'").select("doc_id").distinct()
    return changed(ctx, restructure.page_parts(ctx["elem"], docs, hierarchy.pages(ctx.numbers))) | {"failed": hits.join(dealt(root), "doc_id", "left_anti").select("doc_id", "seq")}


@fix("MistaggedArtifact")
def mistagged_artifact(ctx: Context, hits: DataFrame) -> Tables:
    whole, part = hits.where("detail = 'element'"), hits.where("detail <> 'element'")
    one = part.select("doc_id", F.col("elem_id").alias("owner_id"), F.col("detail").cast("int").alias("mcid")).distinct().withColumn("kind", F.lit("mcr_num"))
    kid = ctx["kid"].join(dealt(one), ["doc_id", "owner_id", "mcid", "kind"], "left_anti").select(*ctx["kid"].columns)
    elem = restructure.prune_above(ctx["elem"], kid, part) if not part.isEmpty() else ctx["elem"]
    elem, kid, annot, _ = restructure.to_artifact(elem, kid, ctx["annot"], whole)
    return changed(ctx, elem, kid) | {"annot": annot}


@fix("FigureWithText")
def figure_with_text(ctx: Context, hits: DataFrame) -> Tables:
    return changed(ctx, repair.set_roles(ctx["elem"], hits, F.lit("P")))


@fix("EmptyLinkTag")
def empty_link(ctx: Context, hits: DataFrame) -> Tables:
    w = Window.partitionBy("doc_id", "owner_id").orderBy("kid_ord")
    before = ctx["kid"].select("doc_id", F.col("child_id").alias("elem_id"), F.lag("mcid").over(w).alias("mcid")).where("elem_id is not null and mcid is not null")
    kid = restructure.fill_empty_links(ctx["kid"], hits.select("doc_id", "elem_id").join(dealt(before), ["doc_id", "elem_id"]))
    order = kid.where("kind = 'elem'").select("doc_id", F.col("child_id").alias("elem_id"), F.col("kid_ord").alias("slot"))
    elem = ctx["elem"].join(dealt(order), ["doc_id", "elem_id"], "left").withColumn("kid_ord", F.coalesce("slot", "kid_ord").cast("int")).select(*ctx["elem"].columns)
    return {"elem": elem, "kid": kid}


@fix("MergeSplitLinks")
def split_links(ctx: Context, hits: DataFrame) -> Tables:
    runs = link_runs(ctx).join(dealt(hits.select("doc_id", F.col("elem_id").alias("first_id"))), ["doc_id", "first_id"]).select("doc_id", "first_id", F.col("child_id").alias("elem_id"))
    elem, kid = repair.merge_split_links(ctx["elem"], ctx["kid"], ctx.settled(runs, "runs"))
    elem = ctx.settled(elem, "merged")
    stamp = hits.select("doc_id", "elem_id").join(dealt(elem), ["doc_id", "elem_id"])
    note = repair.edits(stamp, "set_title", value=repair.exprs.add_note(F.col("title"), F.lit("merged split links")))
    return changed(ctx, repair.apply_edits(elem, note), kid)


@fix("WrapParagraphRunInList")
def wrap_runs(ctx: Context, hits: DataFrame) -> Tables:
    """Runs as lists; a sublist stands in the body of the last item of the list before it, if there is such a body."""
    found = list_evidence(ctx)
    hit = hits.select("doc_id", F.col("elem_id").alias("first_id")).distinct()
    rows = found["bulleted"].select("doc_id", F.col("elem_id").alias("first_id"), "own", F.when(F.col("sub"), F.col("before.elem_id")).alias("host"))
    rows = rows.unionByName(found["indented"].select("doc_id", F.col("elem_id").alias("first_id"), "own", F.lit(None).cast("int").alias("host"))).join(dealt(hit), ["doc_id", "first_id"])
    members = rows.select("doc_id", F.col("first_id").alias("run"), "host", F.explode("own").alias("elem_id"))
    elem = restructure.paragraphs_to_list(ctx["elem"], members)
    lists = elem.where("role_raw = 'LI'").select("doc_id", F.col("elem_id").alias("li"), F.col("parent_id").alias("list_id"), F.col("kid_ord").alias("li_ord"))
    bodies = elem.where("role_raw = 'LBody'").select("doc_id", F.col("elem_id").alias("body"), F.col("parent_id").alias("li"), F.col("kid_ord").alias("body_ord"))
    last = lists.groupBy("doc_id", "list_id").agg(F.max_by("li", "li_ord").alias("li")).join(dealt(bodies), ["doc_id", "li"]).groupBy("doc_id", "list_id").agg(F.max_by("body", "body_ord").alias("body"))
    # The new list of a run is three levels above its members.
    up = elem.select("doc_id", "elem_id", "parent_id")
    own = members.where("host is not null").groupBy("doc_id", "run", "host").agg(F.min("elem_id").alias("elem_id")).join(dealt(up), ["doc_id", "elem_id"])
    for _ in range(2):
        own = own.select("doc_id", "host", F.col("parent_id").alias("elem_id")).join(dealt(up), ["doc_id", "elem_id"])
    nest = own.select("doc_id", "host", F.col("parent_id").alias("elem_id")).join(dealt(last.withColumnRenamed("list_id", "host")), ["doc_id", "host"])
    return changed(ctx, restructure.edited(elem, repair.edits(nest, "move", "elem_id", "body")))


@fix("ParagraphOfLinks")
def paragraph_of_links(ctx: Context, hits: DataFrame) -> Tables:
    return changed(ctx, restructure.links_to_list(ctx["elem"], hits.select("doc_id", "elem_id")))


@fix("WrapBulletAlignedKidsInLBody")
def aligned_kids(ctx: Context, hits: DataFrame) -> Tables:
    """Groups of elements beside a bullet as items; groups that hold bare content are refused."""
    inside = list_evidence(ctx)["inside"].join(dealt(hits.select("doc_id", "elem_id").distinct()), ["doc_id", "elem_id"])
    each = inside.select("doc_id", F.col("elem_id").alias("owner_id"), "group", "page_num", "y", "n", F.explode("kids").alias("kid_ord")).join(dealt(ctx["kid"].where("kind = 'elem'").select("doc_id", "owner_id", "kid_ord", "child_id")), ["doc_id", "owner_id", "kid_ord"])
    whole = each.withColumn("got", F.count("*").over(Window.partitionBy("doc_id", "owner_id", "group"))).where("got = n")
    members = whole.select("doc_id", F.col("child_id").alias("elem_id"), F.col("owner_id").alias("run"), "page_num", "y")
    failed = hits.join(dealt(whole.select("doc_id", F.col("owner_id").alias("elem_id")).distinct()), ["doc_id", "elem_id"], "left_anti").select("doc_id", "seq")
    return changed(ctx, restructure.bullets_to_list(ctx["elem"], ctx["kid"], members)) | {"failed": failed}


@fix("MergeAdjacentLists")
def merge_lists(ctx: Context, hits: DataFrame) -> Tables:
    return changed(ctx, restructure.merge_adjacent_lists(ctx["elem"], ctx["kid"], hits.select("doc_id", "elem_id")))


@fix("IrregularToc")
def irregular_toc(ctx: Context, hits: DataFrame) -> Tables:
    toc = hits.select("doc_id", F.col("elem_id").alias("toc_id")).distinct()
    under = ctx.closure.where("dist > 0").join(dealt(toc.withColumnRenamed("toc_id", "anc_id")), ["doc_id", "anc_id"])
    leaf = ctx.elem.where("size(child_roles) = 0").select("doc_id", "elem_id", "pre", F.col("page").alias("page_num"))
    leaves = under.join(dealt(leaf), ["doc_id", "elem_id"]).join(dealt(ctx.text.select("doc_id", "elem_id", "x0", "y0", "x1", "y1")), ["doc_id", "elem_id"], "left")
    return changed(ctx, restructure.rebuild_toc(ctx["elem"], leaves.select("doc_id", F.col("anc_id").alias("toc_id"), "elem_id", "pre", "page_num", "x0", "y0", "x1", "y1")))


@fix("SplitMarkedContent")
def split_content(ctx: Context, hits: DataFrame) -> Tables:
    out = splitting.split_by_size(ctx.tables, hits)
    return out | changed(ctx, out["elem"], out["kid"])


@fix("MistaggedHeading")
def mistagged_heading(ctx: Context, hits: DataFrame) -> Tables:
    return {"elem": repair.note_headings(ctx["elem"], hits)}


@fix("EmptyElement")
def empty_element(ctx: Context, hits: DataFrame) -> Tables:
    holds = ctx["kid"].where("kind <> 'elem'").select("doc_id", F.col("owner_id").alias("elem_id"))
    return changed(ctx, repair.empty_elements(ctx["elem"], holds))


@fix("ScribbledInstruction")
def instructions(ctx: Context, hits: DataFrame) -> Tables:
    """Notes of the language, verb by verb; what is still there afterwards was refused."""
    t = {n: ctx[n] for n in ("elem", "kid", "annot", "content", "op", "span")}

    def step(elem: DataFrame, kid: DataFrame | None = None) -> None:
        t.update(resynced(t["elem"], elem, t["kid"] if kid is None else kid))
        t["elem"], t["kid"] = restructure.settled(t["elem"]), restructure.settled(t["kid"])

    # Only verbs that occur; there are as many at most as the language has.
    said = restructure.refused(t["elem"]).select(F.regexp_extract("note", r"^!(\w+)", 1).alias("verb")).where(F.col("verb").isin(*VERBS)).distinct().collect()
    verbs = {VERBS[r.verb] for r in said}
    plain = {"SET_ROLE": repair.execute_set_role, "ADD_PARENT": restructure.add_parents, "ADD_CHILD": restructure.add_children, "REORDER_KIDS": restructure.reorder_kids}
    for verb, apply in plain.items():
        if verb in verbs:
            step(apply(t["elem"]))
    if "UNWRAP_LIST" in verbs:
        step(restructure.unwrap_lists(t["elem"], t["kid"]))
    if "UNLINK" in verbs:
        elem, kid, t["annot"] = restructure.unlink(t["elem"], t["kid"], t["annot"])
        step(elem, kid)
    if "SPLIT_LINES" in verbs:
        before, out = t["elem"], splitting.split_lines(t)
        t.update({n: out[n] for n in ("content", "span", "op")})
        t["elem"] = before
        step(out["elem"], out["kid"])
    if "ARTIFACT" in verbs:
        elem, kid, t["annot"], _ = restructure.artifacts(t["elem"], t["kid"], t["annot"])
        step(elem, kid)
    left = restructure.refused(t["elem"]).select("doc_id", "elem_id").distinct()
    return t | {"failed": hits.join(dealt(left), ["doc_id", "elem_id"]).select("doc_id", "seq")}


@fix("StaleScribble")
def stale_scribble(ctx: Context, hits: DataFrame) -> Tables:
    return {"elem": repair.apply_edits(ctx["elem"], repair.edits(hits, "set_title", value=F.lit(None)))}


@fix("ClearRoleMap")
def clear_roles(ctx: Context, hits: DataFrame) -> Tables:
    hit = hits.select("doc_id").distinct()
    return _documents(ctx, hits, has_rolemap=False) | {"role_map": ctx["role_map"].join(dealt(hit), "doc_id", "left_anti")}


@fix("ReplaceRoleMap")
def replace_roles(ctx: Context, hits: DataFrame) -> Tables:
    """The configured roles as each document's map; none clear it."""
    wanted = {k.strip().removeprefix("/"): v.strip().removeprefix("/") for k, v in ctx.options.get("role_map", {}).items()}
    if not all(wanted) or not all(wanted.values()):
        raise ValueError("a role is blank")
    hit = hits.select("doc_id").distinct()
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.lit(v).alias("mapped")) for k, v in sorted(wanted.items())])) if wanted else None
    new = hit.select("doc_id", rows.alias("r")).select("doc_id", "r.*") if wanted else ctx["role_map"].limit(0)
    return _documents(ctx, hits, has_rolemap=bool(wanted)) | {"role_map": ctx["role_map"].join(dealt(hit), "doc_id", "left_anti").unionByName(new)}


@fix("InconsistentParentTree")
def parent_tree(ctx: Context, hits: DataFrame) -> Tables:
    """The reverse index made anew from the elements that own the content; of several the last."""
    own = ctx.owned.join(dealt(ctx.elem.select("doc_id", "elem_id", "pre")), ["doc_id", "elem_id"]).groupBy("doc_id", "page_num", "mcid").agg(F.max_by("elem_id", "pre").alias("owner_id"))
    return {"parent_tree": own}


@fix("InlineDestinations")
def inline_destinations(ctx: Context, hits: DataFrame) -> Tables:
    annot, _ = repair.inline_destinations(ctx["annot"], ctx["dest"])
    return {"annot": annot, "dest": ctx["dest"].join(dealt(hits.select("doc_id").distinct()), "doc_id", "left_anti")}


@fix("MisartifactedText")
def misartifacted(ctx: Context, hits: DataFrame) -> Tables:
    shown = ctx["block"].select("doc_id", F.col("block_ord").cast("string").alias("detail"), "page_num", "text")
    said = hits.join(dealt(shown), (hits.doc_id == shown.doc_id) & (hits.detail == shown.detail) & (hits.page == shown.page_num)).select(hits.doc_id, "elem_id", "text")
    return changed(ctx, restructure.signposts(ctx["elem"], said))


@fix("ReorderWebCaptures")
def reorder_captures(ctx: Context, hits: DataFrame) -> Tables:
    docs = ctx["doc"].join(dealt(hits.select("doc_id").distinct()), "doc_id")
    order = restructure.capture_order(docs, ctx["url_page"], ctx.options.get("urls", []))
    names = {"content": "page_num", "span": "page_num", "bullet": "page_num", "annot": "page_num", "kid": "page_num", "op": "page_num", "block": "page_num", "parent_tree": "page_num", "url_page": "page_num", "elem": "pg", "dest": "page"}
    return {n: restructure.reorder_pages(ctx[n], order, c) for n, c in names.items()}


@fix("WrapWebCaptures")
def wrap_captures(ctx: Context, hits: DataFrame) -> Tables:
    return changed(ctx, restructure.wrap_captures(ctx["elem"], ctx["url_page"], hierarchy.pages(ctx.numbers)))


@dataclass
class Result:
    """Tables after all repairs, findings with their status, and folders that may be deleted afterwards."""

    spark: SparkSession
    tables: Tables
    issues: DataFrame
    errors: dict[str, str] = field(default_factory=dict)
    paths: list[str] = field(default_factory=list)

    def release(self) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())


def remediate(spark: SparkSession, tables: Tables, names: list[str] | None = None, options: dict | None = None) -> Result:
    """Each named check's findings repaired before the next check runs; errors tell fixes that raised, by kind."""
    names = [n for n, c in CHECKS.items() if c.default] if names is None else names
    validate_prereqs(names, {n: CHECKS[n].needs for n in names})
    out = Result(spark, dict(tables), None)

    def saved(df: DataFrame, name: str) -> DataFrame:
        path = f"{scratch(spark)}/docloom/{name}-{uuid.uuid4().hex}"
        write(df, path)
        out.paths.append(path)
        return dealt(spark.read.schema(df.schema).parquet(path))

    parts: list[DataFrame] = []
    stopped: DataFrame | None = None
    w = Window.partitionBy("doc_id").orderBy("ord", "type", "elem_id", "page", "detail")
    for i, name in enumerate(names):
        ctx = Context(spark, out.tables, options or {}, deep=True)
        found = issue_rows(CHECKS[name].run(ctx), CHECKS[name], i)
        if stopped is not None:
            found = found.join(dealt(stopped), "doc_id", "left_anti").select(*found.columns)
        # resolve() reads findings several times.
        found = ctx.settled(found.withColumn("seq", F.row_number().over(w)), "found")
        found = saved(resolve(found, ctx.closure), "issues")
        todo = found.where("status = 'resolved'")
        # As many rows as there are kinds of fixes.
        kinds = sorted((r.fix_priority, r.fix_kind) for r in todo.select("fix_priority", "fix_kind").distinct().collect())
        if found.where("severity = 'FATAL'").limit(1).count():
            fatal = found.where("severity = 'FATAL'").select("doc_id").distinct()
            stopped = fatal if stopped is None else stopped.unionByName(fatal).distinct()
        for _, kind in kinds:
            hits = todo.where(F.col("fix_kind") == kind)
            step = Context(spark, out.tables, options or {}, deep=True)
            try:
                new = FIXES[kind](step, hits)
                failed = new.pop("failed", None)
                out.tables |= {n: saved(df, n) for n, df in new.items()}
            except ValueError as e:
                out.errors[kind] = str(e)
                failed = hits.select("doc_id", "seq")
            if failed is not None:
                bad = saved(failed.distinct().withColumn("kind", F.lit(kind)), "failed").withColumnRenamed("kind", "fix_kind")
                found = found.join(dealt(bad.withColumn("refused", F.lit(True))), ["doc_id", "seq", "fix_kind"], "left").withColumn("status", F.when(F.col("refused") & (F.col("status") == "resolved"), "failed").otherwise(F.col("status"))).select(*found.columns)
            step.release()
        parts.append(saved(found, "done"))
        ctx.release()
    out.issues = reduce(DataFrame.unionByName, parts)
    return out
