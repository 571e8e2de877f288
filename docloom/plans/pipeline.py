"""Which checks run, in which order, and which of their findings hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.tables import dealt


def select_checks(default: list[str], optional: list[str], only: set[str] | None = None, include: set[str] = frozenset(), skip: set[str] = frozenset(), replace: dict[str, str] | None = None) -> list[str]:
    """``only`` without ``skip``, or the default ones and ``include`` without ``skip``; a replacement takes the place. Unknown names are ignored."""
    known = [*default, *optional]
    wanted = only if only else {*default, *include}
    return [(replace or {}).get(n, n) for n in known if n in wanted and n not in skip]


def resolve_ordered(names: list[str], known: set[str]) -> list[str]:
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"unknown checks: {', '.join(missing)}")
    return names


def inject_check(names: list[str], name: str) -> list[str]:
    """One more check behind those selected."""
    return [*names, name]


def validate_prereqs(names: list[str], needs: dict[str, set[str]]) -> None:
    """Whatever a check needs must run before it."""
    done: set[str] = set()
    for n in names:
        if missing := needs.get(n, set()) - done:
            raise ValueError(f"{n} needs {', '.join(sorted(missing))} before it")
        done.add(n)


def stop_at_fatal(issues: DataFrame) -> DataFrame:
    """Without what checks after a document's first fatal one found."""
    first = issues.where("severity = 'FATAL'").groupBy("doc_id").agg(F.min("check_ord").alias("fatal_at"))
    return issues.join(dealt(first), "doc_id", "left").where("fatal_at is null or check_ord <= fatal_at").drop("fatal_at")


def resolve(issues: DataFrame, closure: DataFrame) -> DataFrame:
    """issues with status: open without a fix, superseded where an earlier fix makes it needless, else resolved.

    Fixes of a check go by priority, then as they were found. An artifact's fix makes later ones
    below its element needless, and on the element itself if it takes the whole element. One
    repair of a font serves all findings of that font. closure: doc_id, elem_id, anc_id, dist.
    """
    order = ["fix_priority", "check_ord", "seq"]
    fixes = issues.where("fix_kind = 'MistaggedArtifact'").select("doc_id", "check_ord", "elem_id", F.struct(*order).alias("at"), (F.col("detail") == "element").alias("whole"))
    above = fixes.select("doc_id", "check_ord", F.col("elem_id").alias("anc_id"), F.col("at").alias("a_at"), "whole")
    later = fixes.drop("whole").join(dealt(closure), ["doc_id", "elem_id"]).join(dealt(above), ["doc_id", "check_ord", "anc_id"]).where((F.col("a_at") < F.col("at")) & ((F.col("dist") > 0) | F.col("whole")))
    needless = later.select("doc_id", "check_ord", F.col("at.seq").alias("seq")).distinct().withColumn("needless", F.lit(True))
    again = F.row_number().over(Window.partitionBy("doc_id", "check_ord", "detail", "page", F.col("fix_kind") == "BadlyMappedLigature").orderBy(*order)) > 1
    out = issues.withColumn("again", (F.col("fix_kind") == "BadlyMappedLigature") & again).join(dealt(needless), ["doc_id", "check_ord", "seq"], "left")
    status = F.when(F.col("fix_kind").isNull(), "open").when(F.col("needless") | F.coalesce("again", F.lit(False)), "superseded").otherwise("resolved")
    return out.withColumn("status", status).drop("needless", "again").select(*issues.columns, "status")
