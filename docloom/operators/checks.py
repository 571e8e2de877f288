"""The checks: each a query over the canonical tables of all documents that yields issues.

An issue is doc_id, check, check_ord, type, severity, elem_id, page, detail, order (the
element's place in emission), fix_kind and fix_priority.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import constants as K
from docloom.functions import exprs
from docloom.operators import hierarchy, rules, runs
from docloom.sources.tables import bounds, dealt, delete, scratch, write

ISSUE = ["doc_id", "check", "check_ord", "type", "severity", "elem_id", "page", "detail", "ord", "fix_kind", "fix_priority"]


@dataclass
class Check:
    name: str
    run: Callable[[Context], DataFrame]
    type: str
    severity: str
    fix: str | None
    needs: set[str]
    default: bool
    priority: int = 0


CHECKS: dict[str, Check] = {}


def check(type: str, severity: str = "WARNING", fix: str | None = None, needs: tuple[str, ...] = (), default: bool = True, priority: int = 0) -> Callable:
    """Register a query; its rows may override type, severity and fix_kind."""

    def put(f: Callable) -> Callable:
        name = "".join(w.capitalize() for w in f.__name__.split("_"))
        CHECKS[name] = Check(name, f, type, severity, fix, set(needs), default, priority)
        return f

    return put


@dataclass
class Context:
    """Tables, and what several checks derive from them; keep: what is read several times is written once, deep: elem too, which repairs read again and again."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    options: dict = field(default_factory=dict)
    keep: bool = True
    deep: bool = False
    _paths: list[str] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def settled(self, df: DataFrame, name: str) -> DataFrame:
        """df, computed once: written to the shared folder and read again, until release()."""
        if not self.keep:
            return df
        path = f"{scratch(self.spark)}/docloom/{name}-{uuid.uuid4().hex}"
        write(df, path)
        self._paths.append(path)
        return dealt(self.spark.read.schema(df.schema).parquet(path))

    def release(self) -> None:
        """Delete derived tables that were written."""
        while self._paths:
            delete(self.spark, self._paths.pop())

    @cached_property
    def numbers(self) -> DataFrame:
        """Visible elements with their mapped role and numbers."""
        roles = self["role_map"].groupBy("doc_id", F.col("role").alias("role_raw")).agg(F.min("mapped").alias("mapped"))
        e = self["elem"].join(dealt(roles), ["doc_id", "role_raw"], "left").select(self["elem"]["*"], F.coalesce("mapped", "role_raw").alias("role"))
        return self.settled(hierarchy.numbered(e), "numbers")

    @cached_property
    def elem(self) -> DataFrame:
        """Visible elements with role, page, path, pre, last, parent_role, child_roles, n_elem, n_mcr, n_objr."""
        n = self.numbers
        kids = self["kid"].groupBy("doc_id", F.col("owner_id").alias("elem_id")).agg(
            F.count_if(F.col("kind").isin("mcr_num", "mcr_dict")).alias("n_mcr"), F.count_if(F.col("kind") == "objr").alias("n_objr"), F.count("*").alias("n_kid")
        )
        roles = F.array_sort(F.collect_list(F.struct("kid_ord", "role", "elem_id")))
        child = n.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("elem_id")).agg(roles.alias("children"))
        up = n.select("doc_id", F.col("elem_id").alias("parent_id"), F.col("role").alias("parent_role"), F.col("pre").alias("parent_pre"))
        out = n.join(dealt(kids), ["doc_id", "elem_id"], "left").join(dealt(child), ["doc_id", "elem_id"], "left").join(dealt(up), ["doc_id", "parent_id"], "left")
        out = out.fillna(0, ["n_mcr", "n_objr", "n_kid"]).withColumn("child_roles", F.coalesce(F.transform("children", lambda c: c["role"]), F.array().cast("array<string>")))
        out = out.join(dealt(hierarchy.pages(n)), ["doc_id", "elem_id"])
        return self.settled(out, "elem") if self.deep else dealt(out)

    @cached_property
    def closure(self) -> DataFrame:
        return hierarchy.closure(self.numbers)

    @cached_property
    def owned(self) -> DataFrame:
        """Marked content of each element itself: doc_id, elem_id, kid_ord, kind, page_num, mcid, text, kinds, x0..y1."""
        mcr = self["kid"].where(F.col("kind").isin("mcr_num", "mcr_dict")).select("doc_id", F.col("owner_id").alias("elem_id"), "kid_ord", "kind", "page_num", "mcid")
        return dealt(mcr.join(dealt(self["content"]), ["doc_id", "page_num", "mcid"], "left"))

    @cached_property
    def below(self) -> DataFrame:
        """Marked content under each element: as owned, elem_id being the ancestor or itself."""
        return dealt(self.owned.join(dealt(self.closure), ["doc_id", "elem_id"]).drop("elem_id").withColumnRenamed("anc_id", "elem_id"))

    @cached_property
    def text(self) -> DataFrame:
        """doc_id, elem_id, text, box and kinds of the content under an element, looked up on the element's own page.

        Text comes in the order of the tree, from numbered content only; what stands on
        other pages is sought on the element's, as its reader does. kinds are those of its
        content wherever it is.
        """
        mcr = self["kid"].where(F.col("kind").isin("mcr_num", "mcr_dict")).select("doc_id", F.col("owner_id").alias("elem_id"), "kid_ord", "kind", "page_num", "mcid")
        placed = mcr.join(dealt(self.numbers.select("doc_id", "elem_id", "path")), ["doc_id", "elem_id"]).withColumn("at", F.concat("path", F.array("kid_ord")))
        under = placed.join(dealt(self.closure), ["doc_id", "elem_id"]).drop("elem_id").withColumnRenamed("anc_id", "elem_id")
        under = under.join(dealt(hierarchy.pages(self.numbers)), ["doc_id", "elem_id"]).where("page > 0")
        shown = self["content"].select("doc_id", F.col("page_num").alias("page"), "mcid", "text", "kinds", "x0", "y0", "x1", "y1")
        seen = under.join(dealt(shown), ["doc_id", "page", "mcid"])
        pieces = F.array_sort(F.collect_list(F.when((F.col("kind") == "mcr_num") & F.col("text").isNotNull(), F.struct("at", "text"))))
        every = seen.groupBy("doc_id", "elem_id").agg(
            F.array_join(F.transform(pieces, lambda p: p["text"]), " ").alias("text"),
            F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"), F.min("page").alias("page_num"),
        )
        return self.settled(every, "text")

    @cached_property
    def links(self) -> DataFrame:
        """Annotations under Link elements: doc_id, elem_id, kid_ord, annot_id, dest, uri."""
        objr = self["kid"].where("kind = 'objr'").select("doc_id", F.col("owner_id").alias("elem_id"), "kid_ord", "annot_id")
        uri = F.coalesce("pa_uri", F.when(F.col("action") == "URI", F.col("uri")))
        dest = F.when(F.col("pa_uri").isNotNull(), F.concat(F.lit("uri:"), "pa_uri")).when(F.col("action") == "URI", F.concat(F.lit("uri:"), "uri")).when(
            F.col("action").isNull() | (F.col("action") == "GoTo"), F.coalesce(F.concat(F.lit("page:"), F.col("goto_page").cast("string")), F.concat(F.lit("name:"), "goto_name"))
        )
        return dealt(objr.join(dealt(self["annot"].select("doc_id", "annot_id", uri.alias("uri"), dest.alias("dest"))), ["doc_id", "annot_id"]))


def issue_rows(found: DataFrame, c: Check, order: int) -> DataFrame:
    have = set(found.columns)
    pick = lambda name, other: F.col(name) if name in have else other
    return found.select(
        "doc_id", F.lit(c.name).alias("check"), F.lit(order).alias("check_ord"), pick("type", F.lit(c.type)).alias("type"), pick("severity", F.lit(c.severity)).alias("severity"),
        pick("elem_id", F.lit(None)).cast("int").alias("elem_id"), pick("page", F.lit(0)).cast("int").alias("page"), pick("detail", F.lit("")).cast("string").alias("detail"),
        pick("pre", F.lit(0)).cast("int").alias("ord"), pick("fix_kind", F.lit(c.fix)).cast("string").alias("fix_kind"), pick("fix_priority", F.lit(c.priority)).cast("int").alias("fix_priority"),
    )


def run_checks(ctx: Context, names: list[str] | None = None) -> DataFrame:
    """All issues of the named checks, in order of checks and, within one, of emission."""
    from docloom.plans.pipeline import stop_at_fatal, validate_prereqs

    names = [n for n, c in CHECKS.items() if c.default] if names is None else names
    validate_prereqs(names, {n: CHECKS[n].needs for n in names})
    parts = [issue_rows(CHECKS[n].run(ctx), CHECKS[n], i) for i, n in enumerate(names)]
    every = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("doc_id", "check_ord").orderBy("ord", "type", "elem_id", "page", "detail")
    return stop_at_fatal(every.withColumn("seq", F.row_number().over(w)))


def flagged(condition: str) -> Callable[[Context], DataFrame]:
    return lambda ctx: ctx["doc"].where(condition).select("doc_id")


# Documents


@check("IMAGE_ONLY_DOCUMENT", "FATAL")
def image_only_document(ctx: Context) -> DataFrame:
    return flagged("not has_struct_root and not has_text and has_image")(ctx)


@check("NO_STRUCT_TREE", "FATAL")
def structure_tree_exists(ctx: Context) -> DataFrame:
    return flagged("not has_struct_root")(ctx)


@check("MISSING_DOCUMENT_ELEMENT", "ERROR", "MissingDocument")
def missing_document(ctx: Context) -> DataFrame:
    return ctx["elem"].where("parent_id is null").groupBy("doc_id").agg(F.bool_or(F.col("role_raw") == "Document").alias("has")).where("not has").select("doc_id")


@check("STRUCT_TREE_OUT_OF_ORDER", fix="StructTreeOrder")
def struct_tree_order(ctx: Context) -> DataFrame:
    """Parents of at least two elements whose first content goes back; parents come after their children."""
    last = F.lit(2**31 - 1)
    at = ctx.below.groupBy("doc_id", "elem_id").agg(F.min(F.struct("page_num", "mcid")).alias("at"))
    e = ctx.elem.select("doc_id", "elem_id", "parent_id", "kid_ord").join(dealt(at), ["doc_id", "elem_id"], "left").withColumn("at", F.coalesce("at", F.struct(last.alias("page_num"), last.alias("mcid"))))
    back = e.withColumn("before", F.lag("at").over(Window.partitionBy("doc_id", "parent_id").orderBy("kid_ord"))).where("parent_id is not null and at < before")
    hits = back.select("doc_id", F.col("parent_id").alias("elem_id")).distinct()
    return hits.join(dealt(ctx.elem.select("doc_id", "elem_id", F.col("last").alias("pre"), "page")), ["doc_id", "elem_id"])


@check("UNMARKED_LINK", "ERROR", "UnmarkedLink")
def unmarked_link(ctx: Context) -> DataFrame:
    return ctx["annot"].where("subtype = 'Link' and struct_parent is null").select("doc_id", F.col("page_num").alias("page"), F.col("annot_id").alias("detail"))


@check("UNEXPECTED_WIDGET", "ERROR", "UnexpectedWidget")
def unexpected_widget(ctx: Context) -> DataFrame:
    """Push buttons; type and flags come from the nearest parent that has them."""
    a = ctx["annot"].select("doc_id", "page_num", "annot_id", "subtype", "ft", "ff", "parent_id")
    known = a.select("doc_id", F.col("annot_id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    # A field whose parent is missing is the top of its own chain.
    tree = a.join(dealt(known), ["doc_id", "parent_id"], "left").select("doc_id", F.col("annot_id").alias("elem_id"), F.when(F.col("known"), F.col("parent_id")).alias("parent_id"), F.col("annot_id").alias("kid_ord"))
    chain = hierarchy.closure(hierarchy.numbered(tree.dropDuplicates(["doc_id", "elem_id"]), hide_verified=False)).withColumnRenamed("elem_id", "annot_id")
    up = a.select("doc_id", F.col("annot_id").alias("anc_id"), F.col("ft").alias("u_ft"), F.col("ff").alias("u_ff"))
    got = chain.join(dealt(up), ["doc_id", "anc_id"]).groupBy("doc_id", "annot_id").agg(F.min(F.when(F.col("u_ft").isNotNull(), F.struct("dist", "u_ft")))["u_ft"].alias("i_ft"), F.min(F.when(F.col("u_ff").isNotNull(), F.struct("dist", "u_ff")))["u_ff"].alias("i_ff"))
    w = a.where("subtype = 'Widget'").join(dealt(got), ["doc_id", "annot_id"], "left").where("coalesce(i_ft, ft) = 'Btn' and (coalesce(i_ff, ff) & 65536) <> 0")
    return w.select("doc_id", F.col("page_num").alias("page"), F.col("annot_id").alias("detail"))


@check("LIGATURE_MAPPING_BROKEN", fix="BadlyMappedLigature")
def badly_mapped_ligature(ctx: Context) -> DataFrame:
    bad = ctx["font_map"].where(exprs.ligature(F.col("code"), F.col("mapped"), F.col("base_font")).isNotNull())
    return bad.groupBy("doc_id", "font_id").agg(F.min("first_page").alias("page"), F.count("*").cast("string").alias("detail"))


@check("LANGUAGE_NOT_SET", "ERROR", "Language")
def language_set(ctx: Context) -> DataFrame:
    return flagged("lang is null")(ctx)


@check("TAB_ORDER_NOT_SET", "ERROR", "TabOrder")
def tab_order(ctx: Context) -> DataFrame:
    return flagged("tab_order_p1 is null")(ctx)


@check("NOT_TAGGED_PDF", "ERROR", "TaggedPdf")
def tagged_pdf(ctx: Context) -> DataFrame:
    return flagged("not coalesce(marked, false)")(ctx)


@check("FALSE_PDFUA_CONFORMANCE", "ERROR", "PdfUaConformance")
def pdf_ua_conformance(ctx: Context) -> DataFrame:
    return flagged("ua_part is not null")(ctx)


# Trees


@check("ORPHANED_CONTENT", fix="OrphanedContent")
def orphaned_content(ctx: Context) -> DataFrame:
    lost = ctx["kid"].where("kind <> 'elem' and coalesce(page_num, 0) = 0").select("doc_id", F.col("owner_id").alias("elem_id"), F.col("kid_ord").cast("string").alias("detail"))
    return lost.join(dealt(ctx.elem.select("doc_id", "elem_id", "pre")), ["doc_id", "elem_id"])


@check("NEEDLESS_NESTING", fix="NeedlessNesting")
def needless_nesting(ctx: Context) -> DataFrame:
    group = ctx.elem.where(F.col("role").isin(*K.GROUPING) & ~((F.col("role_raw") == "Part") & F.col("pg").isNotNull()))
    return group.groupBy("doc_id").agg(F.count("*").cast("string").alias("detail"))


@check("PAGE_PARTS_NOT_NORMALIZED", fix="MissingPageParts", needs=("NeedlessNesting",))
def missing_page_parts(ctx: Context) -> DataFrame:
    """Documents of five pages or more where a page lacks its Part, or other children of Document have pages."""
    docs = ctx["doc"].where("n_pages >= 5").select("doc_id", "n_pages")
    roots = ctx.elem.where("parent_id is null").select("doc_id", F.col("elem_id").alias("root"), "role_raw")
    head = roots.groupBy("doc_id").agg(F.count("*").alias("n_roots"), F.min(F.when(F.col("role_raw") == "Document", F.col("root"))).alias("document"))
    kids = ctx.elem.select("doc_id", "parent_id", F.col("role_raw").alias("kid_role"), "pg")
    seen = head.join(dealt(kids), (head.doc_id == kids.doc_id) & (F.col("document") == F.col("parent_id"))).groupBy(head.doc_id).agg(
        F.count_distinct(F.when((F.col("kid_role") == "Part") & (F.col("pg") > 0), F.col("pg"))).alias("parts"), F.count_if((F.col("kid_role") != "Part") & (F.col("pg") > 0)).alias("loose")
    )
    every = docs.join(dealt(head), "doc_id").join(dealt(seen), "doc_id", "left")
    return every.where("document is null and n_roots > 0 or document is not null and (coalesce(parts, 0) < n_pages or coalesce(loose, 0) > 0)").select("doc_id")


@check("MISTAGGED_ARTIFACT", fix="MistaggedArtifact")
def mistagged_artifact(ctx: Context) -> DataFrame:
    """Texts of artifacts, blank leaves, and small images and paths; below the first two nothing more is said."""
    patterns = ctx.options.get("artifact_patterns", K.ARTIFACTS)
    match = reduce(Column.__or__, [F.col("text").rlike(f"(?i){p}") for p in patterns.values()], F.lit(False))
    # Both are read several times: their plans would multiply.
    e = ctx.settled(ctx.elem.where(F.col("role").isin(*K.ARTIFACT_ROLES)).select("doc_id", "elem_id", "pre", "page", "role_raw", "alt", "n_mcr", "n_kid"), "candidates")
    t = e.join(dealt(ctx.text.select("doc_id", "elem_id", "text", "kinds")), ["doc_id", "elem_id"], "left")
    blank = (F.col("n_kid") > 0) & (F.col("n_kid") == F.col("n_mcr")) & (F.size(F.coalesce("kinds", F.array())) == 0)
    whole = t.where(F.coalesce(match, F.lit(False)) | blank).select("doc_id", "elem_id", "pre", "page")
    whole = ctx.settled(hierarchy.outermost(ctx.settled(whole, "hits"), ctx.numbers), "whole")
    under = ctx.closure.join(dealt(whole.select("doc_id", F.col("elem_id").alias("anc_id"))), ["doc_id", "anc_id"]).select("doc_id", "elem_id").distinct()
    small = ~F.coalesce(exprs.meaningful(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), F.lit(False))
    mcr = e.join(dealt(ctx.owned.select("doc_id", "elem_id", "mcid", "text", "kinds", "x0", "y0", "x1", "y1")), ["doc_id", "elem_id"]).where(F.col("text").isNull() & (F.size("kinds") > 0) & small & ~((F.col("role_raw") == "Figure") & F.col("alt").isNotNull()))
    mcr = mcr.join(dealt(under), ["doc_id", "elem_id"], "left_anti")
    return whole.withColumn("detail", F.lit("element")).unionByName(mcr.select("doc_id", "elem_id", "pre", "page", F.col("mcid").cast("string").alias("detail")))


@check("FIGURE_WITH_TEXT", fix="FigureWithText")
def figure_with_text(ctx: Context) -> DataFrame:
    return ctx.elem.where("role_raw = 'Figure' and page > 0").join(dealt(ctx.text), ["doc_id", "elem_id"]).where("length(text) > 1").select("doc_id", "elem_id", "pre", "page", exprs.truncate(F.col("text")).alias("detail"))


@check("FIGURE_MISSING_ALT")
def missing_alt_text(ctx: Context) -> DataFrame:
    big = exprs.meaningful(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return ctx.elem.where("role_raw = 'Figure' and alt is null and page <> 0").join(dealt(ctx.text), ["doc_id", "elem_id"]).where(F.array_contains("kinds", "IMAGE") & big).select("doc_id", "elem_id", "pre", "page")


@check("EMPTY_LINK_TAG", fix="EmptyLinkTag")
def empty_link_tag(ctx: Context) -> DataFrame:
    """Links without content right after marked content that their annotation covers."""
    w = Window.partitionBy("doc_id", "owner_id").orderBy("kid_ord")
    k = ctx["kid"].select("doc_id", "owner_id", "child_id", F.lag(F.struct("kind", "page_num", "mcid")).over(w).alias("before")).where("child_id is not null and before.kind in ('mcr_num', 'mcr_dict')")
    link = ctx.elem.where("role_raw = 'Link' and n_mcr = 0 and size(child_roles) = 0 and n_objr > 0").select("doc_id", "elem_id", "pre", "page")
    k = k.join(dealt(link), (k.doc_id == link.doc_id) & (k.child_id == link.elem_id)).select(link["*"], F.col("before.page_num").alias("page_num"), F.col("before.mcid").alias("mcid"))
    box = bounds(ctx["annot"]).select("doc_id", "annot_id", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    near = k.join(dealt(ctx["content"]), ["doc_id", "page_num", "mcid"]).join(dealt(ctx.links.select("doc_id", "elem_id", "annot_id")), ["doc_id", "elem_id"]).join(dealt(box), ["doc_id", "annot_id"])
    from docloom.operators.geometry import similar

    near = near.withColumnsRenamed({c: f"m_{c}" for c in ("x0", "y0", "x1", "y1")})
    return near.where(similar("m_", "a_")).select("doc_id", "elem_id", "pre", F.col("page_num").alias("page")).distinct()


@check("INVALID_LINK_URI")
def invalid_link_uri(ctx: Context) -> DataFrame:
    first = ctx.links.groupBy("doc_id", "elem_id").agg(F.min_by("uri", "kid_ord").alias("uri"))
    return ctx.elem.where("role_raw = 'Link'").join(dealt(first), ["doc_id", "elem_id"]).where(F.col("uri").isNotNull() & ~exprs.valid_web_uri(F.col("uri"))).select("doc_id", "elem_id", "pre", "page", F.col("uri").alias("detail"))


def link_dest(ctx: Context) -> DataFrame:
    """Each Link's one destination; null if it has none or several."""
    one = F.when((F.count_distinct("dest") == 1) & (F.count("dest") == F.count("*")), F.min("dest"))
    return ctx.links.groupBy("doc_id", "elem_id").agg(one.alias("dest"))


def link_runs(ctx: Context) -> DataFrame:
    """doc_id, owner_id, run, child_id, pre, page, first_id: neighbouring Links of one parent with one destination, two or more."""
    e = ctx.elem.select("doc_id", F.col("elem_id").alias("child_id"), "pre", "page", "role_raw", "alt", "actual_text")
    k = ctx["kid"].join(dealt(e), ["doc_id", "child_id"], "left").join(dealt(link_dest(ctx).withColumnRenamed("elem_id", "child_id")), ["doc_id", "child_id"], "left")
    key = F.when((F.col("role_raw") == "Link") & F.col("alt").isNull() & F.col("actual_text").isNull(), F.col("dest"))
    r = runs.islands(k.withColumn("key", key), ["doc_id", "owner_id"], ["kid_ord"], F.coalesce("key", F.concat(F.lit("\0"), F.col("kid_ord").cast("string"))))
    w = Window.partitionBy("doc_id", "owner_id", "run")
    r = r.where("key is not null").withColumn("n", F.count("*").over(w)).withColumn("first_id", F.first("child_id").over(w.orderBy("kid_ord")))
    return r.where("n >= 2").select("doc_id", "owner_id", "run", "child_id", "pre", "page", "first_id")


@check("LINK_SPLIT_ACROSS_TAGS", fix="MergeSplitLinks")
def badly_split_link(ctx: Context) -> DataFrame:
    """Neighbouring Links of one parent with one destination; other kids between them part them."""
    g = link_runs(ctx).groupBy("doc_id", F.col("first_id").alias("elem_id")).agg(F.count("*").alias("n"), F.min("pre").alias("pre"), F.min("page").alias("page"))
    return g.select("doc_id", "elem_id", "pre", "page", F.col("n").cast("string").alias("detail"))


def aligned_kids(ctx: Context, tall: DataFrame, shown: DataFrame) -> DataFrame:
    """doc_id, elem_id, pre, group, page_num, y, n, kids: stretches of an element's kids beside one bullet; kids without bounds don't part them.

    shown: doc_id, elem_id, page, y0, y1 of elements with content.
    """
    from docloom.operators.geometry import first_in_interval

    own = tall.select("doc_id", F.col("elem_id").alias("owner_id"), "pre")
    kid = ctx["kid"].select("doc_id", "owner_id", "kid_ord", "child_id", "page_num", "mcid", "kind").join(dealt(own), ["doc_id", "owner_id"])
    mark = kid.where("kind in ('mcr_num', 'mcr_dict')").join(dealt(ctx["content"].select("doc_id", "page_num", "mcid", "y0", "y1")), ["doc_id", "page_num", "mcid"]).where("y0 is not null")
    sub = shown.select("doc_id", F.col("elem_id").alias("child_id"), "page", "y0", "y1")
    part = kid.where("kind = 'elem'").drop("page_num").join(dealt(sub), ["doc_id", "child_id"]).withColumnRenamed("page", "page_num")
    cols = ["doc_id", "page_num", "owner_id", "kid_ord", "pre", "y0", "y1"]
    boxes = ctx.settled(mark.select(*cols).unionByName(part.select(*cols)).withColumn("elem_id", F.struct("owner_id", "kid_ord")), "boxes")
    met = first_in_interval(boxes, ctx["bullet"]).select("doc_id", "elem_id", F.col("bullet.y").alias("y"))
    seen = boxes.join(dealt(met), ["doc_id", "elem_id"], "left").drop("elem_id")
    w = Window.partitionBy("doc_id", "owner_id").orderBy("kid_ord")
    was = F.lag(F.struct("y", "page_num")).over(w)
    seen = seen.withColumn("was", was).withColumn("new", (~F.coalesce((F.col("was.page_num") == F.col("page_num")) & (F.abs(F.col("was.y") - F.col("y")) < K.BULLET_Y), F.lit(False))).cast("int"))
    seen = seen.withColumn("group", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where("y is not null").groupBy("doc_id", F.col("owner_id").alias("elem_id"), "pre", "group").agg(F.min("page_num").alias("page_num"), F.max_by("y", "kid_ord").alias("y"), F.count("*").alias("n"), F.sort_array(F.collect_list("kid_ord")).alias("kids"))


def list_evidence(ctx: Context) -> dict[str, DataFrame]:
    """Runs with bullets (bulleted, with their members own), lists that a sublist splits, kids beside bullets (inside), runs by indent (indented, own), parents of links (only).

    What one claims the next leaves.
    """
    from docloom.operators.geometry import first_in_interval

    box = ctx.text.select("doc_id", "elem_id", "x0", "y0", "x1", "y1", F.lit(True).alias("shown"))
    e = ctx.elem.select("doc_id", "elem_id", "parent_id", "kid_ord", "role", "role_raw", "pre", "page", "n_kid", F.col("parent_role").isin(*K.LIST_PARENTS).alias("sought")).join(dealt(box), ["doc_id", "elem_id"], "left")
    e = ctx.settled(e, "boxed")
    b = first_in_interval(e.where("x0 is not null").select("doc_id", F.col("page").alias("page_num"), "elem_id", "y0", "y1"), ctx["bullet"])
    e = ctx.settled(e.join(dealt(b.select("doc_id", "elem_id", "bullet")), ["doc_id", "elem_id"], "left"), "members")
    high = F.col("y1") - F.col("y0")
    skipped = F.col("role").isin(*K.NO_LIST_MEMBERS)
    mark = F.coalesce(~skipped & F.col("bullet").isNotNull() & (high <= K.BULLET_MAX_HEIGHT), F.lit(False))
    # Where a list's first and last items have their bullets.
    item = e.where("role = 'LI'").groupBy("doc_id", F.col("parent_id").alias("list_id")).agg(F.min_by("bullet.x", "kid_ord").alias("first_x"), F.max_by("bullet.x", "kid_ord").alias("last_x"))
    r = runs.islands(e.where("sought").withColumn("mark", mark), ["doc_id", "parent_id"], ["kid_ord"], F.col("mark"))
    w = Window.partitionBy("doc_id", "parent_id").orderBy("kid_ord")
    side = F.struct("role", "elem_id", "pre", "page")
    r = r.withColumn("before", F.lag(side).over(w)).withColumn("after", F.lead(side).over(w))
    bulleted = r.where("mark").groupBy("doc_id", "parent_id", "run").agg(F.min("pre").alias("pre"), F.min_by("page", "kid_ord").alias("page"), F.count("*").alias("n"), F.min_by("elem_id", "kid_ord").alias("elem_id"), F.min_by("before", "kid_ord").alias("before"), F.max_by("after", "kid_ord").alias("after"), F.min_by("bullet", "kid_ord").alias("first"), F.collect_list("elem_id").alias("own"), F.max("bullet.x").alias("hi"), F.min("bullet.x").alias("lo"))
    bulleted = bulleted.join(dealt(item.select("doc_id", F.col("list_id").alias("b_id"), F.col("last_x").alias("before_x"))), (bulleted.doc_id == item.doc_id) & (F.col("before.elem_id") == F.col("b_id")), "left").select(bulleted["*"], "before_x")
    bulleted = bulleted.join(dealt(item.select("doc_id", F.col("list_id").alias("a_id"), F.col("first_x").alias("after_x"))), (bulleted.doc_id == item.doc_id) & (F.col("after.elem_id") == F.col("a_id")), "left").select(bulleted["*"], "after_x")
    even = (F.col("hi") - F.col("first.x") <= K.BULLET_X) & (F.col("first.x") - F.col("lo") <= K.BULLET_X)
    sub = F.coalesce(even & (F.col("before.role") == "L") & (F.col("first.x") - F.col("before_x") >= K.INDENT), F.lit(False))
    bulleted = ctx.settled(bulleted.withColumn("sub", sub), "bulleted")
    # A run that nests in the list before it leaves the two lists round it as one, if they stand alike.
    split = bulleted.where((F.col("after.role") == "L") & F.col("sub") & (F.abs(F.col("before_x") - F.col("after_x")) <= K.BULLET_X))
    inside = ctx.settled(aligned_kids(ctx, e.where(~skipped & F.col("sought") & (high > K.BULLET_MAX_HEIGHT)), e.where("shown")), "inside")
    claimed = dealt(bulleted.select("doc_id", F.explode("own").alias("elem_id")).unionByName(inside.select("doc_id", "elem_id")).distinct())
    free = e.join(dealt(claimed.withColumn("taken", F.lit(True))), ["doc_id", "elem_id"], "left").where("sought").withColumn("p", F.coalesce((F.col("role") == "P") & F.col("taken").isNull(), F.lit(False)))
    free = runs.islands(free, ["doc_id", "parent_id"], ["kid_ord"], F.col("p"))
    n = F.count("*").over(Window.partitionBy("doc_id", "parent_id", "run"))
    wide = F.when(F.col("x1") > F.col("x0"), F.col("x0"))

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs of three or more left edges, 10 beyond the siblings' least edge outside of them."""
        rows = []
        for _, own in pdf[pdf["p"]].groupby("run", sort=True):
            own = own[own["x0"].notna()]
            if len(own) < 3:
                continue
            own = own.assign(sub=runs.anchored(own["x0"].tolist(), K.EDGE_TOLERANCE))
            for _, part in own.groupby("sub", sort=True):
                rest = pdf.loc[~pdf["elem_id"].isin(part["elem_id"]) & pdf["wide"].notna(), "wide"]
                if len(part) >= 3 and len(rest) and rest.min() >= 0 and part["x0"].iloc[0] - rest.min() >= K.INDENT:
                    rows.append((part["doc_id"].iloc[0], part["elem_id"].iloc[0], part["pre"].iloc[0], part["page"].iloc[0], str(len(part)), part["elem_id"].tolist()))
        return pd.DataFrame(rows, columns=["doc_id", "elem_id", "pre", "page", "detail", "own"])

    some = free.withColumn("n", n).withColumn("wide", wide).withColumn("hope", F.max(F.col("p") & (F.col("n") >= 3)).over(Window.partitionBy("doc_id", "parent_id"))).where("hope")
    some = some.select("doc_id", "parent_id", "kid_ord", "elem_id", "pre", "page", "p", "run", "x0", "wide")
    indented = runs.fold(some, ["doc_id", "parent_id"], ["kid_ord"], edges, "doc_id long, elem_id int, pre int, page int, detail string, own array<int>")
    kids = e.join(dealt(link_dest(ctx)), ["doc_id", "elem_id"], "left").where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("elem_id")).agg(F.count("*").alias("n"), F.bool_and(F.col("role_raw") == "Link").alias("links"), F.count_distinct("dest").alias("dests"), F.count("dest").alias("known"))
    only = kids.where("n >= 2 and links and not (dests = 1 and known = n)").join(dealt(e.select("doc_id", "elem_id", "pre", "page")), ["doc_id", "elem_id"])
    mixed = ctx["kid"].where("kind <> 'elem'").select("doc_id", F.col("owner_id").alias("elem_id")).distinct()
    only = only.join(dealt(mixed), ["doc_id", "elem_id"], "left_anti").join(dealt(claimed), ["doc_id", "elem_id"], "left_anti")
    return {"bulleted": bulleted, "split": split, "inside": inside, "indented": indented, "only": only}


@check("LIST_TAGGED_AS_PARAGRAPHS", fix="WrapParagraphRunInList", priority=10)
def mistagged_list(ctx: Context) -> DataFrame:
    """Runs with bullets and bullets within tall elements, then runs of indented paragraphs, then parents of links only; what one claims the next leaves."""
    found = list_evidence(ctx)
    out = found["bulleted"].select("doc_id", "elem_id", "pre", "page", F.when(F.col("sub"), "SUBLIST_TAGGED_AS_PARAGRAPHS").otherwise("LIST_TAGGED_AS_PARAGRAPHS").alias("type"), F.col("n").cast("string").alias("detail"), F.lit("WrapParagraphRunInList").alias("fix_kind"), F.lit(10).alias("fix_priority"))
    out = out.unionByName(found["split"].select("doc_id", "after.elem_id", "after.pre", "after.page", F.lit("LIST_SPLIT_BY_SUBLIST").alias("type"), F.col("before.elem_id").cast("string").alias("detail"), F.lit("MergeAdjacentLists").alias("fix_kind"), F.lit(30).alias("fix_priority")))
    out = out.unionByName(found["inside"].select("doc_id", "elem_id", "pre", F.col("page_num").alias("page"), F.lit("BULLET_ALIGNED_KIDS_IN_ELEMENT").alias("type"), F.col("n").cast("string").alias("detail"), F.lit("WrapBulletAlignedKidsInLBody").alias("fix_kind"), F.lit(20).alias("fix_priority")))
    out = out.unionByName(found["indented"].drop("own").withColumn("type", F.lit("LIST_TAGGED_AS_PARAGRAPHS")).withColumn("fix_kind", F.lit("WrapParagraphRunInList")).withColumn("fix_priority", F.lit(10)))
    return out.withColumn("severity", F.lit("WARNING")).unionByName(found["only"].select("doc_id", "elem_id", "pre", "page", F.lit("PARAGRAPH_OF_LINKS").alias("type"), F.col("n").cast("string").alias("detail"), F.lit("ParagraphOfLinks").alias("fix_kind"), F.lit(10).alias("fix_priority"), F.lit("ERROR").alias("severity")))


@check("IRREGULAR_TOC", fix="IrregularToc")
def irregular_toc(ctx: Context) -> DataFrame:
    bad = ctx.elem.where((F.col("role") == "TOC") & F.exists("child_roles", lambda r: ~r.isin(*K.TOC_CHILDREN))).select("doc_id", "elem_id", "pre", "page")
    return hierarchy.outermost(bad, ctx.elem)


@check("MIXED_FONT_MARKED_CONTENT", fix="SplitMarkedContent")
def badly_marked_content(ctx: Context) -> DataFrame:
    """Paragraphs and headings of one marked block whose lines differ in size. op: shown texts in order, dy the fall of the baseline."""
    from docloom.operators.splitting import lines

    change = lines(ctx["op"]).where("changes").groupBy("doc_id", "page_num", "mcid").agg(F.count("*").cast("string").alias("detail"))
    sole = ctx.elem.where(F.col("role").isin(*K.HEADINGS) & (F.col("n_mcr") == 1) & (F.size("child_roles") == 0) & (F.col("n_objr") == 0)).select("doc_id", "elem_id", "pre", "page")
    return sole.join(dealt(ctx.owned.select("doc_id", "elem_id", "page_num", "mcid")), ["doc_id", "elem_id"]).join(dealt(change), ["doc_id", "page_num", "mcid"]).select("doc_id", "elem_id", "pre", "page", "detail")


@check("MISTAGGED_HEADING", fix="MistaggedHeading")
def mistagged_heading(ctx: Context) -> DataFrame:
    """Sizes of text make heading levels in each scope: the innermost Art, or the document with all its content."""
    size = exprs.round_quarter(F.col("size"))
    span = ctx["span"].withColumn("size", size).withColumn("weight", F.length("text"))
    art = ctx.elem.where("role = 'Art'").select("doc_id", F.col("elem_id").alias("anc_id"))
    scopes = ctx.closure.join(dealt(art), ["doc_id", "anc_id"]).groupBy("doc_id", "elem_id").agg(F.min_by("anc_id", "dist").alias("scope"))
    whole = span.groupBy("doc_id", F.lit(-1).alias("scope"), "size").agg(F.sum("weight").alias("weight"))
    under = ctx.below.select("doc_id", "elem_id", "page_num", "mcid").distinct().join(dealt(span), ["doc_id", "page_num", "mcid"]).groupBy("doc_id", "elem_id", "size").agg(F.sum("weight").alias("weight"))
    inner = under.join(dealt(art.withColumnRenamed("anc_id", "elem_id")), ["doc_id", "elem_id"]).select("doc_id", F.col("elem_id").alias("scope"), "size", "weight")
    hist = whole.unionByName(inner)
    most = F.max_by("size", F.struct("weight", -F.col("size")))
    body = hist.groupBy("doc_id", "scope").agg(most.alias("body"))
    level = F.dense_rank().over(Window.partitionBy("doc_id", "scope").orderBy(F.desc("size")))
    levels = hist.join(dealt(body), ["doc_id", "scope"]).where(F.col("size") > F.col("body") + K.HEADING_ABOVE_BODY).withColumn("level", level).where(F.col("level") <= K.HEADING_LEVELS).select("doc_id", "scope", "size", "level")
    own = under.groupBy("doc_id", "elem_id").agg(most.alias("size"))
    e = ctx.elem.where(F.col("role").isin(*K.HEADINGS)).select("doc_id", "elem_id", "pre", "page", "role").join(dealt(own), ["doc_id", "elem_id"]).join(dealt(scopes), ["doc_id", "elem_id"], "left").withColumn("scope", F.coalesce("scope", F.lit(-1)))
    e = e.join(dealt(levels), ["doc_id", "scope", "size"])

    e = e.select("doc_id", "scope", "elem_id", "pre", "page", "role", F.col("level").cast("long").alias("level"), "size")
    found = runs.scan(e, ["doc_id", "scope"], ["pre"], ["level", "size"], runs.heading, "got", "long").withColumn("target", F.concat(F.lit("H"), F.col("got").cast("string")))
    found = found.where("target is null or role <> target")
    deep = F.col("target").isNull()
    return found.select("doc_id", "elem_id", "pre", "page", F.coalesce("target", F.lit("too deep to open")).alias("detail"), F.when(deep, "IMPROPERLY_NESTED_HEADING").otherwise("MISTAGGED_HEADING").alias("type"), F.when(~deep, "MistaggedHeading").alias("fix_kind"))


@check("EMPTY_ELEMENT", fix="EmptyElement")
def empty_element(ctx: Context) -> DataFrame:
    none = ctx.elem.where("n_kid = 0 and size(child_roles) = 0")
    return none.groupBy("doc_id").agg(F.count("*").cast("string").alias("detail"))


@check("SCRIBBLED_INSTRUCTION", fix="ScribbledInstruction")
def scribbled_instruction(ctx: Context) -> DataFrame:
    """First instruction of each note; below an element to be an artifact nothing more is said."""
    e = ctx.elem.withColumn("detail", F.get(F.filter(exprs.segments(F.col("title")), lambda s: F.startswith(s, F.lit("!"))), F.lit(0))).where("detail is not null")
    gone = e.where("detail like '!ARTIFACT%'").select("doc_id", F.col("elem_id").alias("anc_id"))
    hidden = ctx.closure.where("dist > 0").join(dealt(gone), ["doc_id", "anc_id"]).select("doc_id", "elem_id").distinct()
    return e.select("doc_id", "elem_id", "pre", "page", "detail").join(dealt(hidden), ["doc_id", "elem_id"], "left_anti")


@check("TAG_WRONG_CHILD", "ERROR")
def schema_validation(ctx: Context) -> DataFrame:
    """Unknown roles, wrong parents, counts, children and orders of children."""
    known = ctx.options.get("rules") or rules.default_rules()
    e = ctx.elem.join(F.broadcast(rules.table(ctx.spark, known)), "role", "left")
    n = F.size("child_roles")
    roles = F.array_join(F.transform("child_roles", lambda r: F.concat(r, F.lit(" "))), "")
    tests = {
        "TAG_UNKNOWN_ROLE": F.col("allowed").isNull(),
        "TAG_WRONG_PARENT": (F.size("parent_must_be") > 0) & F.col("parent_role").isNotNull() & ~F.array_contains("parent_must_be", F.col("parent_role")),
        "TAG_WRONG_CHILD_COUNT": (n < F.col("min_c")) | (n > F.col("max_c")),
        "TAG_WRONG_CHILD_PATTERN": F.col("pattern").isNotNull() & ~F.expr("rlike(array_join(transform(child_roles, r -> concat(r, ' ')), ''), pattern)"),
    }
    own = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for t, c in tests.items()]))
    first = e.select("doc_id", "elem_id", "pre", "page", F.explode(own).alias("type"), roles.alias("detail"))
    up = rules.table(ctx.spark, known).where(F.size("allowed") > 0).select(F.col("role").alias("parent_role"), F.col("allowed").alias("may"))
    child = ctx.elem.join(F.broadcast(up), "parent_role").where(~F.array_contains("may", F.col("role"))).select("doc_id", "elem_id", F.col("parent_pre").alias("pre"), "page", F.lit("TAG_WRONG_CHILD").alias("type"), F.col("role").alias("detail"))
    return first.unionByName(child)


@check("STALE_SCRIBBLE", fix="StaleScribble")
def stale_scribble(ctx: Context) -> DataFrame:
    mine = exprs.tool_authored(F.col("title")) if ctx.options.get("scribble_scope") == "TOOL_AUTHORED" else F.lit(True)
    return ctx.elem.where(exprs.note_body(F.col("title")).isNotNull() & mine).select("doc_id", "elem_id", "pre", "page", exprs.note_body(F.col("title")).alias("detail"))


# Optional ones


@check("ROLEMAP_PRESENT", "INFO", "ClearRoleMap", default=False)
def clear_role_map(ctx: Context) -> DataFrame:
    return flagged("has_rolemap")(ctx)


@check("ROLEMAP_PRESENT", "INFO", "ReplaceRoleMap", default=False)
def replace_role_map(ctx: Context) -> DataFrame:
    return ctx["doc"].select("doc_id")


@check("INCONSISTENT_PARENT_TREE", fix="InconsistentParentTree", default=False)
def inconsistent_parent_tree(ctx: Context) -> DataFrame:
    tree = ctx["parent_tree"].select("doc_id", "page_num", "mcid", F.col("owner_id").alias("told"))
    bad = ctx.owned.select("doc_id", "elem_id", "page_num", "mcid").join(dealt(tree), ["doc_id", "page_num", "mcid"], "left").where("told is null or told <> elem_id")
    return bad.groupBy("doc_id", "elem_id").agg(F.count("*").cast("string").alias("detail")).join(dealt(ctx.elem.select("doc_id", "elem_id", F.col("last").alias("pre"), "page")), ["doc_id", "elem_id"])


@check("NAMED_DESTINATIONS_PRESENT", "INFO", "InlineDestinations", default=False)
def inline_destinations(ctx: Context) -> DataFrame:
    return ctx["dest"].groupBy("doc_id").agg(F.count("*").cast("string").alias("detail"))


@check("MISARTIFACTED_TEXT", fix="MisartifactedText", default=False)
def misartifacted_text(ctx: Context) -> DataFrame:
    """Digits in artifact blocks, with the nearest block that an element owns; the one before wins ties."""
    owner = ctx.owned.join(dealt(ctx.elem.select("doc_id", "elem_id", "pre")), ["doc_id", "elem_id"]).groupBy("doc_id", "page_num", "mcid").agg(F.max_by("elem_id", "pre").alias("owner"))
    right = ctx["block"].join(dealt(owner), ["doc_id", "page_num", "mcid"]).select("doc_id", "page_num", F.col("block_ord").alias("at"), F.col("owner").alias("id"))
    left = ctx["block"].where(F.col("mcid").isNull() & F.trim("text").rlike(r"^\d+$")).select("doc_id", "page_num", F.col("block_ord").alias("at"), F.col("block_ord").alias("id"))
    return runs.nearest(left, right, ["doc_id", "page_num"], "at").select("doc_id", F.col("near_id").alias("elem_id"), F.col("page_num").alias("page"), F.col("at").alias("pre"), F.col("id").cast("string").alias("detail"))


@check("WEB_CAPTURES_BADLY_ORDERED", "INFO", "ReorderWebCaptures", default=False)
def reorder_web_captures(ctx: Context) -> DataFrame:
    """Pages out of place for the configured order of URLs; a pattern means the shortest URL that holds it."""
    wanted = ctx.options.get("urls", [])
    hits = F.array_compact(F.array(F.lit(None).cast("int"), *[F.when(F.contains(F.col("url"), F.lit(p)), F.lit(i)) for i, p in enumerate(wanted)]))
    pick = ctx["url_page"].select("doc_id", "url", "url_ord", F.explode(hits).alias("want")).groupBy("doc_id", "want").agg(F.min_by("url_ord", F.struct(F.length("url"), "url_ord")).alias("url_ord"))
    pages = ctx["url_page"].join(dealt(pick), ["doc_id", "url_ord"])
    to = F.row_number().over(Window.partitionBy("doc_id").orderBy("want", "page_ord"))
    return pages.withColumn("to", to).groupBy("doc_id").agg(F.count_if(F.col("to") != F.col("page_num")).alias("n")).where("n > 0").select("doc_id", F.col("n").cast("string").alias("detail"))


@check("WEB_CAPTURES_NOT_GROUPED", "INFO", "WrapWebCaptures", default=False)
def wrap_web_captures(ctx: Context) -> DataFrame:
    return ctx["url_page"].groupBy("doc_id").agg(F.count_distinct("url_ord").cast("string").alias("detail"))
