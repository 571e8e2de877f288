"""Reports and dumps, as DataFrames of lines in order."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import constants as K
from docloom.functions import exprs
from docloom.operators.checks import Context
from docloom.sources.tables import dealt

GROUP_FROM = 3
#: Types whose one issue a document tells how many elements it is about.
BATCHED = ("NEEDLESS_NESTING", "EMPTY_ELEMENT")


def summary(issues: DataFrame) -> DataFrame:
    """Per document: detected, resolved, failed, remaining."""
    s = F.col("status")
    return issues.groupBy("doc_id").agg(F.count("*").alias("detected"), F.count_if(s.isin("resolved", "superseded")).alias("resolved"), F.count_if(s == "failed").alias("failed"), F.count_if(~s.isin("resolved", "superseded")).alias("remaining"))


def groups(issues: DataFrame) -> DataFrame:
    """Issues of a document by type, in order of first sight; groups of three or more are shown as one line with their pages."""
    first = F.min(F.struct("check_ord", "seq"))
    g = issues.groupBy("doc_id", "type").agg(F.count("*").alias("n"), first.alias("first"), exprs.page_range(F.collect_set(F.when(F.col("page") > 0, F.col("page")))).alias("pages"))
    line = F.when((F.col("n") >= GROUP_FROM) & (F.col("pages") != ""), F.format_string("%d %s (p. %s)", "n", "type", "pages")).otherwise(F.format_string("%d %s", "n", "type"))
    return g.select("doc_id", "type", "n", "pages", "first", line.alias("line"))


def breakdown(issues: DataFrame) -> DataFrame:
    """Per type: detected, resolved, failed, remaining, and the items that resolved fixes dealt with (a batch's number, else one)."""
    s = F.col("status")
    done = s.isin("resolved", "superseded")
    items = F.coalesce(F.when(F.col("type").isin(*BATCHED), F.try_to_number("detail", F.lit("999999999"))).cast("long"), F.lit(1))
    return issues.groupBy("type").agg(F.count("*").alias("detected"), F.count_if(done).alias("resolved"), F.count_if(s == "failed").alias("failed"), F.count_if(~done).alias("remaining"), F.coalesce(F.sum(F.when(done, items)), F.lit(0)).cast("long").alias("items"))


def location() -> Column:
    """Where an issue is: its element, annotation or page, as far as they are known."""
    elem = F.concat(F.lit(" (#"), F.col("elem_id").cast("string"), F.when(F.col("page") > 0, F.concat(F.lit(", p. "), F.col("page").cast("string"))).otherwise(F.lit("")), F.lit(")"))
    page = F.when(F.col("page") > 0, F.concat(F.lit(" (p. "), F.col("page").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return F.coalesce(elem, page)


def log_location() -> Column:
    """As location(), in the form of logs: kind and keys."""
    elem = F.concat(F.lit("elem="), F.col("elem_id").cast("string"))
    page = F.when(F.col("page") > 0, F.concat(F.lit("page="), F.col("page").cast("string")))
    return F.when(elem.isNull() & page.isNull(), F.lit("document")).otherwise(F.concat_ws(" ", elem, page))


def message() -> Column:
    """What an issue's line in a report says: its detail, or its kind where there is none."""
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in K.LABELS.items() for x in kv]), F.col("type"))
    return F.coalesce(F.when(F.col("detail") != "", F.col("detail")), label, F.col("type"))


def resolution() -> Column:
    """What was done about a resolved issue."""
    done = F.when(F.col("status") == "superseded", F.lit("Skipped: resolved by higher priority fix")).otherwise(F.concat("fix_kind", F.lit(": "), message()))
    return F.concat(done, location())


def documents(issues: DataFrame, doc: DataFrame, date: str, output: Column | None = None) -> DataFrame:
    """doc_id, at (order), line: each document's report of issues with their status.

    A header, a summary, what was resolved by kind with the items that fixes dealt with, and the
    issues grouped by kind in order of first sight: resolved ones with what was done, failed and
    remaining ones with what they say and where.
    """
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in K.LABELS.items() for x in kv]), F.col("type")), F.col("type"))
    done = F.col("status").isin("resolved", "superseded")
    items = F.coalesce(F.when(F.col("type").isin(*BATCHED), F.try_to_number("detail", F.lit("999999999"))).cast("long"), F.lit(1))
    each = issues.withColumns({"label": label, "items": items, "state": F.when(done, "[RESOLVED]").when(F.col("status") == "failed", "[FAILED]").otherwise("[REMAINING]")})
    each = each.withColumn("rank", F.when(F.col("state") == "[RESOLVED]", 0).when(F.col("state") == "[FAILED]", 1).otherwise(2))
    first = each.groupBy("doc_id", "type").agg(F.min(F.struct("check_ord", "seq")).alias("first"))
    each = each.join(dealt(first), ["doc_id", "type"])
    place = F.struct(F.col("first.check_ord").alias("a"), F.col("first.seq").alias("b"), F.col("rank").alias("c"))

    def lines(df: DataFrame, part: int, line: Column, place: Column | None = None, seq: Column | None = None) -> DataFrame:
        none = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
        return df.select("doc_id", F.struct(F.lit(part).alias("part"), (none if place is None else place).alias("group"), (F.lit(0) if seq is None else seq).cast("int").alias("seq")).alias("at"), line.alias("line"))

    def fixed(part: int, *texts: str | Column) -> DataFrame:
        """Lines that each document has; null ones are left out."""
        cols = F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])
        d = doc.withColumn("x", cols).select("doc_id", F.posexplode("x").alias("i", "line"))
        return lines(d.where("line is not null"), part, F.col("line"), None, F.col("i"))

    head = fixed(0, "Accessibility report", "====================", F.concat(F.lit("Input:    "), F.coalesce("path", F.lit(""))), F.concat(F.lit("Output:   "), F.lit(None).cast("string") if output is None else output), f"Date:     {date}", "", "Summary", "-------")
    n = doc.select("doc_id").join(dealt(summary(issues)), "doc_id", "left").fillna(0)
    told = n.select("doc_id", F.posexplode(F.array(*[F.concat(F.lit(t), F.col(c).cast("string")) for t, c in (("Issues detected:  ", "detected"), ("Issues resolved:  ", "resolved"), ("Issues remaining: ", "remaining"))], F.lit(""))).alias("i", "line"))
    none = lines(n.where("detected = 0"), 6, F.lit("No accessibility issues were detected."))
    some = n.where("resolved > 0").select("doc_id", F.posexplode(F.array(F.lit("Resolved Breakdown"), F.lit("------------------"))).alias("i", "line"))
    by = each.where(done).groupBy("doc_id", "type", "label", "first").agg(F.sum("items").alias("n"))
    broken = lines(by, 3, F.concat(F.lit("[RESOLVED] "), F.col("n").cast("string"), F.lit(" "), "label"), F.struct(F.col("first.check_ord").alias("a"), F.col("first.seq").alias("b"), F.lit(0).alias("c")))
    title = n.where("detected > 0").select("doc_id", F.posexplode(F.array(F.lit(""), F.lit("Issues"), F.lit("------"))).alias("i", "line"))
    groups_ = each.groupBy("doc_id", "type", "label", "first", "state", "rank").agg(F.when(F.col("state") == "[RESOLVED]", F.sum("items")).otherwise(F.count("*")).alias("n"))
    heads = lines(groups_, 5, F.concat("state", F.lit(" "), F.col("n").cast("string"), F.lit(" "), "label"), place)
    says = F.when(done, F.concat(F.lit("  -> "), resolution())).otherwise(F.concat(F.lit("  - "), message(), location()))
    order = F.row_number().over(Window.partitionBy("doc_id", "type", "state").orderBy("check_ord", "seq"))
    body = lines(each.withColumn("n", order), 5, says, place, F.col("n"))
    parts = [head, lines(told, 1, F.col("line"), None, F.col("i")), lines(some, 2, F.col("line"), None, F.col("i")), broken, lines(title, 4, F.col("line"), None, F.col("i")), heads, body, none]
    return reduce(DataFrame.unionByName, parts)


def table_lines(ctx: Context) -> DataFrame:
    """doc_id, pre, line: a fixed-width table of index, role, page, id and text; a Span without children isn't shown."""
    e = ctx.elem.join(dealt(ctx.text.select("doc_id", "elem_id", "text")), ["doc_id", "elem_id"], "left").where("not (role = 'Span' and size(child_roles) = 0)")
    line = F.format_string("%5d  %-30s %5d %7d  %s", F.col("pre"), F.concat(F.expr("repeat(' ', depth - 1)"), "role"), F.col("page"), F.col("elem_id"), F.coalesce(exprs.truncate(F.col("text")), F.lit("")))
    return e.select("doc_id", "pre", line.alias("line"))


def keep_result(issues: DataFrame, dirty: bool, force: bool = False) -> bool:
    """Whether results are worth writing: something was resolved, or notes changed, or it is asked for."""
    return force or dirty or not issues.where("status in ('resolved', 'superseded')").isEmpty()


def tree_lines(numbers: DataFrame, detailed: bool = True) -> DataFrame:
    """doc_id, pre, line: roles indented by depth, with ids and notes if asked for."""
    note = F.coalesce(F.concat(F.lit(' "'), exprs.note_body(F.col("title")), F.lit('"')), F.lit(""))
    body = F.concat("role", F.lit(" #"), F.col("elem_id").cast("string"), note) if detailed else F.col("role")
    return numbers.select("doc_id", "pre", F.concat(F.expr("repeat('  ', depth - 1)"), body).alias("line"))


def role_brackets(numbers: DataFrame) -> DataFrame:
    """doc_id, tree: each document as nested brackets, from depths in pre-order."""
    rows = F.array_sort(F.collect_list(F.struct("pre", "depth", "role")))
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("d"))

    def put(a, x):
        close = F.when(x["depth"] <= a["d"], F.concat(F.repeat(F.lit("]"), a["d"] - x["depth"] + 1), F.lit(",")))
        return F.struct(F.concat(a["s"], F.coalesce(F.when(a["s"] == "", ""), close, F.lit("")), x["role"], F.lit("[")).alias("s"), x["depth"].alias("d"))

    return numbers.groupBy("doc_id").agg(F.aggregate(rows, start, put, lambda a: F.concat(a["s"], F.repeat(F.lit("]"), a["d"]))).alias("tree"))


def outline_lines(outline: DataFrame) -> DataFrame:
    """doc_id, path, line of a bookmark tree: title and page, unresolved ones as a question mark."""
    from docloom.operators.hierarchy import numbered

    n = numbered(outline.select("doc_id", F.col("node_id").alias("elem_id"), "parent_id", F.col("ord").alias("kid_ord"), "title", "page", F.lit("").alias("role")), hide_verified=False)
    return n.select("doc_id", "pre", F.concat(F.expr("repeat('  ', depth - 1)"), exprs.sanitize_title(F.col("title")), F.lit("  @"), F.coalesce(F.col("page").cast("string"), F.lit("?"))).alias("line"))


def destination_lines(dest: DataFrame) -> DataFrame:
    """doc_id, page, name, line; unresolved destinations are on page 0."""
    page, name = F.coalesce("page", F.lit(0)), F.regexp_replace("name", r"[\x00-\x1F\x7F]", "?")
    return dest.select("doc_id", page.alias("page"), name.alias("name"), F.format_string("%03d  %s", page, name).alias("line"))


def write_text(lines: list[str], path: str) -> None:
    """A report file, seen only once it is whole."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    os.replace(part, path)
