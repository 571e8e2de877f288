"""Queries over shredded pages of what the checks and repairs are made from, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import constants as K
from docloom.functions import exprs
from docloom.operators import extraction, geometry, hierarchy, restructure, splitting
from docloom.operators.checks import CHECKS, Context, run_checks
from docloom.plans import check_queries, remediate, report
from docloom.plans.check_queries import CANON, SPANS, tables
from docloom.sources import layout
from docloom.sources.tables import bounds, dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def context(spark: SparkSession, sf_dir: str) -> Context:
    return Context(spark, tables(spark, sf_dir))


def by_id(text: str = "text") -> str:
    return f"SELECT doc_id, {text} FROM documents"


@query(CANON + "SELECT doc_id, elem_id::INTEGER AS elem_id, text, x0, y0, x1, y1 FROM txt")
def element_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and box of all that stands under an element, on its page."""
    return context(spark, sf_dir).text.select("doc_id", "elem_id", "text", "x0", "y0", "x1", "y1")


@query(CANON + "SELECT doc_id, elem_id::INTEGER AS elem_id, page FROM v")
def element_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.pages(context(spark, sf_dir).numbers)


@query(CANON + """SELECT a.doc_id, a.anc_id::INTEGER AS elem_id, arg_min(k.page_num, list_append(o.path, k.kid_ord))::INTEGER AS page
FROM anc a JOIN v0 o ON o.doc_id = a.doc_id AND o.elem_id = a.elem_id JOIN kid k ON k.doc_id = a.doc_id AND k.owner_id = a.elem_id WHERE k.kind <> 'elem' AND k.page_num > 0 GROUP BY 1, 2""")
def first_leaf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page of the first content or annotation below an element."""
    ctx = context(spark, sf_dir)
    return hierarchy.first_leaf_page(ctx.numbers, ctx["kid"])


@query(CANON + "SELECT doc_id, elem_id::INTEGER AS elem_id, anc_id::INTEGER AS anc_id, dist::INTEGER AS dist FROM anc")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir).closure


@query(CANON + "SELECT a.doc_id, a.elem_id::INTEGER AS elem_id, '/' || string_agg(h.role || '[' || h.pre || ']', '.' ORDER BY a.dist DESC) AS shown FROM anc a JOIN v0 h ON h.doc_id = a.doc_id AND h.elem_id = a.anc_id GROUP BY 1, 2")
def display_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.display_path(context(spark, sf_dir).numbers)


@query(CANON + """, d AS (SELECT doc_id, pre, role, len(path) AS depth, lead(len(path)) OVER (PARTITION BY doc_id ORDER BY pre) AS nxt FROM v0)
SELECT doc_id, string_agg(role || '[' || CASE WHEN nxt IS NULL THEN repeat(']', depth) WHEN nxt <= depth THEN repeat(']', depth - nxt + 1) || ',' ELSE '' END, '' ORDER BY pre) AS tree FROM d GROUP BY 1""")
def role_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's roles as nested brackets."""
    return report.role_brackets(context(spark, sf_dir).numbers)


@query(CANON + "SELECT doc_id, pre::INTEGER AS pre, repeat('  ', len(path) - 1) || role || ' #' || elem_id || coalesce(' \"' || CASE WHEN starts_with(title, '__') THEN ltrim(substr(title, 3), ':') END || '\"', '') AS line FROM v0")
def role_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tree_lines(context(spark, sf_dir).numbers)


@query(CANON + f""", t AS (SELECT v.*, t.text AS t, CASE WHEN contains(left(t.text, 29), ' ') AND 29 - instr(reverse(left(t.text, 29)), ' ') >= 15 THEN left(t.text, (29 - instr(reverse(left(t.text, 29)), ' '))::INT) ELSE left(t.text, 29) END AS h FROM v LEFT JOIN txt t ON t.doc_id = v.doc_id AND t.elem_id = v.elem_id)
SELECT doc_id, pre::INTEGER AS pre, printf('%5d  %-30s %5d %7d  %s', pre, repeat(' ', len(path) - 1) || role, page, elem_id, coalesce({check_queries.EXCERPT}, '')) AS line FROM t
WHERE NOT (role = 'Span' AND NOT EXISTS (SELECT 1 FROM v c WHERE c.doc_id = t.doc_id AND c.parent_id = t.elem_id))""")
def structure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.table_lines(context(spark, sf_dir))


@query(CANON + "SELECT doc_id, here AS page, replace(lower(text), ' ', '-') AS name, printf('%03d  %s', here, replace(lower(text), ' ', '-')) AS line FROM el WHERE tag = 'h1' AND run")
def destination_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.destination_lines(tables(spark, sf_dir)["dest"])


@query(CANON + "SELECT doc_id, elem_id::INTEGER AS elem_id, annot_id::INTEGER AS annot_id, 'uri:' || uri AS dest FROM links")
def link_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir).links.select("doc_id", "elem_id", "annot_id", "dest")


@query(CANON + "SELECT doc_id, annot_id::INTEGER AS annot_id, x0, y0, x1, y1 FROM links")
def annotation_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(tables(spark, sf_dir)["annot"].where("subtype = 'Link' and struct_parent is not null")).select("doc_id", "annot_id", "x0", "y0", "x1", "y1")


@query(CANON + f""", auto AS (SELECT doc_id, page_num, {layout.AUTO} + pos AS annot_id, x0, y0, x1, y1 FROM box WHERE tag <> 'a' AND regexp_matches(text, '{layout.HOST}')
), s AS (SELECT a.doc_id, a.annot_id, t.elem_id, round((least(a.x1, t.x1) - greatest(a.x0, t.x0)) * (least(a.y1, t.y1) - greatest(a.y0, t.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)), 6) AS score, len(v.path) AS depth, (t.x1 - t.x0) * (t.y1 - t.y0) AS area, v.pre
  FROM auto a JOIN txt t ON t.doc_id = a.doc_id AND t.page = a.page_num AND a.x0 < t.x1 AND t.x0 < a.x1 AND a.y0 < t.y1 AND t.y0 < a.y1 JOIN v ON v.doc_id = t.doc_id AND v.elem_id = t.elem_id WHERE v.role NOT IN ('Link', 'Reference'))
SELECT doc_id, annot_id::INTEGER AS annot_id, elem_id::INTEGER AS elem_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, annot_id ORDER BY score DESC, depth DESC, area, pre) AS r FROM s WHERE score >= {K.LINK_MIN_SCORE}) WHERE r = 1""")
def unmarked_link_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element that an untagged annotation overlaps best."""
    ctx = context(spark, sf_dir)
    auto = bounds(ctx["annot"].where("subtype = 'Link' and struct_parent is null"))
    elems = ctx.numbers.where("role not in ('Link', 'Reference')").select("doc_id", "elem_id", "depth", "pre").join(dealt(ctx.text.select("doc_id", "elem_id", "page_num", "x0", "y0", "x1", "y1")), ["doc_id", "elem_id"])
    return geometry.best_overlap(auto, elems).select("doc_id", "annot_id", "elem_id", "score")


@query(CANON + SPANS + f"""SELECT doc_id, page_num, mcid::INTEGER AS mcid, i::INTEGER AS op_ord, (1 + sum(CASE WHEN i > 1 AND 1.2 * base > {K.BASELINE_DROP} THEN 1 ELSE 0 END) OVER w)::INTEGER AS line,
i > 1 AND 1.2 * base > {K.BASELINE_DROP} AND abs(size - lag(size) OVER w) > {K.SIZE_CHANGE} AS changes FROM sized WINDOW w AS (PARTITION BY doc_id, page_num, mcid ORDER BY i)""")
def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of marked blocks and where a line begins in another size."""
    return splitting.lines(tables(spark, sf_dir)["op"]).select("doc_id", "page_num", "mcid", "op_ord", "line", "changes")


@query("SELECT doc_id, CASE WHEN starts_with(t, '__') AND length(trim(regexp_replace(substr(t, 3), '^:', ''))) > 0 THEN t || ' // seen' ELSE '__:seen' END AS added FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN '__' || text ELSE text END AS t FROM documents)")
def notes_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool's note on titles, of which those of English texts are notes."""
    title = F.when(F.col("lang") == "en", F.concat(F.lit("__"), "text")).otherwise(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", exprs.add_note(title, F.lit("seen")).alias("added"))


@query("""SELECT doc_id, CASE WHEN len(k) > 0 THEN '__' || array_to_string(k, ' // ') END AS kept FROM (SELECT doc_id, list_filter(string_split(regexp_replace(replace(text, '. ', ' // '), '( // )+$', ''), ' // '), lambda s: split_part(s, ' ', 1) <> 'The') AS k FROM documents WHERE length(trim(text)) > 0 AND NOT starts_with(text, ':'))""")
def notes_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of texts as a note's segments, without those that begin with a word."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(trim(text)) > 0 and not startswith(text, ':')")
    title = F.concat(F.lit("__"), F.replace("text", F.lit(". "), F.lit(" // ")))
    return d.select("doc_id", exprs.clear_notes(title, "The").alias("kept"))


@query(r"""SELECT doc_id, coalesce(list_reduce(w, lambda a, x: CASE WHEN length(split_part(a, chr(10), -1)) + 1 + length(x) <= 80 THEN a || ' ' || x ELSE a || chr(10) || x END), '') AS wrapped FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0""")
def wrapped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").rlike(r"\S"))
    return d.select("doc_id", exprs.word_wrap(F.col("text")).alias("wrapped"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(url || chr(9) || ' x', '[\x00-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages")
def sanitized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", exprs.sanitize_title(F.concat("url", F.lit("\t x"))).alias("title"))


@query(CANON + f"""SELECT a.doc_id, a.pos::INTEGER AS pos, b.pos::INTEGER AS other, coalesce(a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND (a.x1 - a.x0) * (a.y1 - a.y0) / ((b.x1 - b.x0) * (b.y1 - b.y0)) BETWEEN 0.5 AND 2, false) AS alike,
abs(a.x0 - b.x0) <= 0.5 AND abs(a.y0 - b.y0) <= 0.5 AND abs(a.x1 - b.x1) <= 0.5 AND abs(a.y1 - b.y1) <= 0.5 AS same, a.x1 - a.x0 > {K.MIN_WIDTH} AND a.y1 - a.y0 > {K.MIN_HEIGHT} AS large FROM box a JOIN box b ON b.doc_id = a.doc_id AND b.mcid = a.mcid AND a.pos < b.pos""")
def boxes_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a document at the same place of two pages: whether they are alike, equal, of meaningful size."""
    t = tables(spark, sf_dir)
    at = t["block"].where("mcid is not null").select("doc_id", "page_num", "mcid", F.col("block_ord").alias("pos"))
    b = t["content"].join(dealt(at), ["doc_id", "page_num", "mcid"]).select("doc_id", "mcid", "pos", "x0", "y0", "x1", "y1")
    side = lambda p: b.select("doc_id", "mcid", F.col("pos").alias(f"{p}pos"), *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")])
    both = side("a_").join(dealt(side("b_")), ["doc_id", "mcid"]).where("a_pos < b_pos")
    large = exprs.meaningful(*[F.col(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    return both.select("doc_id", F.col("a_pos").alias("pos"), F.col("b_pos").alias("other"), F.coalesce(geometry.similar("a_", "b_"), F.lit(False)).alias("alike"), geometry.equal("a_", "b_").alias("same"), large.alias("large"))


@query(check_queries.CAPTURES + f""", pick AS (SELECT doc_id, i, arg_min(n, struct_pack(a := length(url), b := n)) AS n FROM named JOIN (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(check_queries.WANTED))}) w(i, p) ON contains(url, p) GROUP BY 1, 2
), claim AS (SELECT doc_id, n, min(i) AS i FROM pick GROUP BY 1, 2)
SELECT m.doc_id, m.n::INTEGER AS page_num, row_number() OVER (PARTITION BY m.doc_id ORDER BY c.i NULLS LAST, m.n)::INTEGER AS "to" FROM named m LEFT JOIN claim c ON c.doc_id = m.doc_id AND c.n = m.n""")
def capture_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of hosts in the configured order of captures."""
    urls = layout.captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    doc = urls.groupBy("doc_id").agg(F.max("page_num").alias("n_pages"))
    return restructure.capture_order(doc, urls, check_queries.WANTED).select("doc_id", "page_num", "to")


EVENT = "l_orderkey AS doc_id, 1 AS page_num, CASE l_linenumber % 3 WHEN 0 THEN 'IMAGE' WHEN 1 THEN 'TEXT' ELSE 'PATH' END AS kind, l_linenumber % 2 AS mcid, l_returnflag AS text, l_linestatus AS font, floor(l_quantity / 10) AS size, l_quantity AS px, l_discount * 100 AS py, l_linestatus = 'O' AS painted, l_tax * 100 AS iy"
LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
EVENTS = f"""WITH e AS (SELECT {EVENT}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER})::INTEGER AS event_ord FROM lineitem
), d AS (SELECT *, px AS x0, px + 10 AS x1, CASE WHEN kind = 'IMAGE' THEN iy ELSE py END AS y0, CASE WHEN kind = 'IMAGE' THEN iy ELSE py END + 5 AS y1 FROM e WHERE kind <> 'PATH' OR painted)
"""


def drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a renderer's events: a page an order, texts, images and paths by line number."""
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER.split(", ")))
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("event_ord", order).selectExpr(*[f"{x}" for x in EVENT.split(", ")], "event_ord")
    zero = F.lit(0.0)
    ctm = F.array(F.lit(10.0), zero, zero, F.lit(5.0), "px", "iy")
    return e.select("doc_id", "page_num", "event_ord", "kind", "mcid", "text", "font", zero.alias("asc_x"), F.col("size").cast("double").alias("asc_y"), zero.alias("desc_x"), zero.alias("desc_y"), F.array("px", "py", F.col("px") + 10, F.col("py") + 5).alias("points"), F.lit(0).alias("curves"), "painted", ctm.alias("ctm"))


@query(EVENTS + """SELECT doc_id, mcid::INTEGER AS mcid, string_agg(text, ' ' ORDER BY event_ord) FILTER (kind = 'TEXT') AS raw, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM d GROUP BY 1, 2""")
def drawn_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked blocks of events: text, kinds, boxes. Texts of single letters are cleaned of blanks, so that raw joins their spans."""
    events = drawing(spark, sf_dir)
    raw = extraction.spans(events).groupBy("doc_id", "mcid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_ord", "text"))), lambda x: x["text"]), " ").alias("raw"))
    return extraction.contents(events).join(dealt(raw), ["doc_id", "mcid"], "left").select("doc_id", F.col("mcid").cast("int").alias("mcid"), "raw", F.array_join("kinds", ",").alias("kinds"), "x0", "y0", "x1", "y1")


@query(EVENTS + """, t AS (SELECT *, CASE WHEN font = lag(font) OVER w AND size = lag(size) OVER w THEN 0 ELSE 1 END AS new FROM d WHERE kind = 'TEXT' WINDOW w AS (PARTITION BY doc_id, mcid ORDER BY event_ord)
), n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, mcid ORDER BY event_ord)::INTEGER AS span_ord FROM t)
SELECT doc_id, mcid::INTEGER AS mcid, span_ord, any_value(font) AS font, any_value(size)::DOUBLE AS size, string_agg(text, ' ' ORDER BY event_ord) AS text FROM n GROUP BY 1, 2, 3""")
def drawn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive texts of one font and size."""
    return extraction.spans(drawing(spark, sf_dir)).select("doc_id", F.col("mcid").cast("int").alias("mcid"), "span_ord", "font", "size", "text")


def put_fix(name: str, left: str = "0", options: dict | None = None) -> None:
    """Register a repair's query: findings of a check, and those left when it runs again on the repaired tables."""
    check = f"check_{CHECKS[name].run.__name__}"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [*sorted(CHECKS[name].needs), name]
        done = remediate.remediate(spark, tables(spark, sf_dir), names, options)
        again = run_checks(Context(spark, done.tables, options or {}), names).where(F.col("check") == name).groupBy("type").agg(F.count("*").alias("left"))
        was = done.issues.where(F.col("check") == name)
        fixed = F.col("status").isin("resolved", "superseded")
        return was.groupBy("type").agg(F.count("*").alias("detected"), F.count_if(fixed).alias("resolved")).join(again, "type", "left").select("type", "detected", "resolved", F.coalesce("left", F.lit(0)).cast("long").alias("left"))

    query.__doc__ = f"{name}: found, repaired, left after the repair."
    QUERIES[key := f"fix_{CHECKS[name].run.__name__}"] = query
    ORACLES[key] = f"SELECT type, count(*) AS detected, count(fix_kind) AS resolved, ({left})::BIGINT AS \"left\" FROM ({check_queries.ORACLES[check]}) GROUP BY 1"


# Repairs of remediation() aren't repeated here.
for _name in ("StructTreeOrder", "UnmarkedLink", "UnexpectedWidget", "OrphanedContent", "NeedlessNesting", "EmptyLinkTag", "BadlySplitLink", "IrregularToc", "BadlyMarkedContent", "EmptyElement", "ScribbledInstruction", "InconsistentParentTree", "InlineDestinations"):
    put_fix(_name)
put_fix("MistaggedArtifact", options={"artifact_patterns": {"short-word": check_queries.SHORT_WORD}})
# What these write is carried out, or read by people, later; a second run finds the same.
put_fix("MistaggedHeading", "count(*)")
put_fix("MisartifactedText", "count(*)")


DOCUMENT_FIXES = ["LanguageSet", "TabOrder", "TaggedPdf", "PdfUaConformance", "MissingDocument", "FigureWithText", "StaleScribble"]


@query("SELECT type, count(*) AS detected, count(fix_kind) AS resolved, count(*) - count(fix_kind) AS remaining FROM (" + " UNION ALL ".join(f"SELECT * FROM ({check_queries.ORACLES[f'check_{CHECKS[n].run.__name__}']}) WHERE doc_id >= 0" for n in DOCUMENT_FIXES) + ") GROUP BY 1")
def remediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several checks one after another, each on what the repairs before it left."""
    done = remediate.remediate(spark, tables(spark, sf_dir), DOCUMENT_FIXES)
    return report.breakdown(done.issues).select("type", "detected", "resolved", "remaining")
