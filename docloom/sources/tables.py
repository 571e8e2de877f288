"""Canonical document tables: what a reader of tagged documents shreds them into."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "doc": "doc_id long, path string, n_pages int, has_struct_root boolean, has_text boolean, has_image boolean, lang string, marked boolean, ua_part int, tab_order_p1 string, has_rolemap boolean, is_encrypted boolean",
    "elem": "doc_id long, elem_id int, parent_id int, kid_ord int, role_raw string, pg int, title string, alt string, actual_text string",
    "kid": "doc_id long, owner_id int, kid_ord int, kind string, child_id int, mcid int, page_num int, annot_id int",
    "content": "doc_id long, page_num int, mcid int, text string, kinds array<string>, x0 double, y0 double, x1 double, y1 double",
    "span": "doc_id long, page_num int, mcid int, span_ord int, font string, size double, text string",
    "bullet": "doc_id long, page_num int, ord int, x double, y double",
    "annot": "doc_id long, page_num int, annot_id int, subtype string, rect array<double>, quad array<double>, struct_parent int, action string, uri string, goto_page int, goto_name string, pa_uri string, ft string, ff int, parent_id int",
    "font_map": "doc_id long, font_id int, first_page int, base_font string, code int, mapped string",
    "role_map": "doc_id long, role string, mapped string",
    "dest": "doc_id long, name string, page int",
    "outline": "doc_id long, node_id int, parent_id int, ord int, title string, page int",
    "url_page": "doc_id long, url_ord int, url string, page_ord int, page_num int",
    "op": "doc_id long, page_num int, mcid int, op_ord int, kind string, dy double, size double, text string",
    "block": "doc_id long, page_num int, block_ord int, mcid int, text string",
    "parent_tree": "doc_id long, page_num int, mcid int, owner_id int",
}

#: Bytes of a row group.
GROUP = 16 << 20


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of a folder, one Parquet each; columns a query doesn't use aren't read."""
    return {n: dealt(spark.read.schema(s).parquet(f"{folder}/{n}.parquet")) for n, s in SCHEMAS.items()}


def bounds(annot: DataFrame) -> DataFrame:
    """annot with x0..y1: the box of the quad points if there are four, else the rectangle, put in order."""
    return annot.selectExpr(
        "*",
        *[
            f"CASE WHEN size(quad) >= 8 THEN array_{f}(filter(quad, (v, i) -> i % 2 = {i})) ELSE {g}(rect[{i}], rect[{i + 2}]) END AS {c}"
            for c, f, g, i in (("x0", "min", "least", 0), ("y0", "min", "least", 1), ("x1", "max", "greatest", 0), ("y1", "max", "greatest", 1))
        ],
    )


def dealt(table: DataFrame) -> DataFrame:
    """table, whose joins deal both sides by their keys, whatever it seems to take.

    Spark goes by the size of the columns' files, which for nested or repetitive rows is a small
    part of their size in memory, and would gather tables that grow with the input on the driver.
    The mark holds for what is made of table without a join, so each join of documents' tables marks
    one of its sides.
    """
    return table.hint("merge")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share; a local one for a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def write(table: DataFrame, path: str, rows: int | None = None) -> None:
    """table as Parquet in small row groups, of at most ``rows`` rows.

    A writer's task holds a whole row group, a reader's task 4,096 rows of one at once: where rows are
    long, groups of Spark's own size fill the memory of a process that runs several tasks.
    """
    out = table.write.option("parquet.block.size", GROUP)
    (out.option("parquet.block.row.count.limit", rows) if rows else out).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
