"""Queries over the driver's tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import constants as K
from docloom.functions import exprs
from docloom.operators import geometry, runs
from docloom.operators.checks import CHECKS, Context, run_checks
from docloom.operators.patterns import child_regex
from docloom.plans import check_queries, pipeline, report
from docloom.plans.check_queries import folded
from docloom.sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its SQL if it has one."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINES = ", ".join(LINE_ORDER)

# The tree of pages in SQL, as html.tree() gives it.
TREE = r"""
WITH RECURSIVE toks AS (
  SELECT page_id, unnest(list_zip(range(len(x)), x)) AS z
  FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
    '<(/?)(html|head|title|body|nav|div|article|footer|ul|li|a|h1|p)(\s[^>]*)?>') AS x FROM pages)
), tagged AS (
  SELECT page_id, z[1]::BIGINT AS pos, z[2] AS token, regexp_extract(z[2], '^</?([a-z0-9]+)', 1) AS tag, starts_with(z[2], '</') AS closing FROM toks
), kept AS (SELECT * FROM tagged WHERE NOT (tag = 'p' AND closing)
), leveled AS (
  SELECT *, sum(CASE WHEN tag = 'p' THEN 0 WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos)::BIGINT AS lvl FROM kept
), opened AS (
  SELECT page_id, pos, tag, lvl + CASE WHEN tag = 'p' THEN 1 ELSE 0 END AS depth,
    CASE WHEN contains(token, 'href="') THEN regexp_extract(token, 'href="([^"]*)"', 1) END AS href,
    CASE tag WHEN 'html' THEN 'Root' WHEN 'head' THEN 'NonStruct' WHEN 'title' THEN 'Title' WHEN 'body' THEN 'Document' WHEN 'nav' THEN 'Sect' WHEN 'div' THEN 'Div'
      WHEN 'article' THEN 'Art' WHEN 'footer' THEN 'Div' WHEN 'ul' THEN 'L' WHEN 'li' THEN 'LI' WHEN 'a' THEN 'Link' WHEN 'h1' THEN 'H1' ELSE 'P' END AS role
  FROM leveled WHERE NOT closing
), up AS (
  SELECT c.page_id, c.pos, max(p.pos) AS parent_pos FROM opened c JOIN opened p ON p.page_id = c.page_id AND p.depth = c.depth - 1 AND p.pos < c.pos AND p.tag <> 'p' GROUP BY 1, 2
), tree AS (
  SELECT o.page_id, o.pos, o.depth, o.tag, o.role, o.href, u.parent_pos, p.role AS parent_role,
    row_number() OVER (PARTITION BY o.page_id, u.parent_pos ORDER BY o.pos) AS kid_ord
  FROM opened o LEFT JOIN up u ON u.page_id = o.page_id AND u.pos = o.pos LEFT JOIN opened p ON p.page_id = u.page_id AND p.pos = u.parent_pos
)
"""
RULES = ", ".join(f"('{r}', '{c}')" for r, kids in sorted(K.ALLOWED.items()) for c in kids.split())


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.tree(t(spark, sf_dir, "pages"))


def allowed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, kids.split()) for r, kids in sorted(K.ALLOWED.items())], "role string, allowed array<string>")


@query(TREE + "SELECT page_id, pos, tag, role, depth, parent_pos, parent_role, kid_ord, href FROM tree")
def dom_tokens_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).select("page_id", "pos", "tag", "role", "depth", "parent_pos", "parent_role", "kid_ord", "href")


@query(TREE + f"""SELECT page_id, pos, role, parent_role FROM tree WHERE parent_role IN (SELECT r FROM (VALUES {RULES}) v(r, c)) AND (parent_role, role) NOT IN (SELECT (r, c) FROM (VALUES {RULES}) v(r, c))""")
def schema_wrong_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that their parent's rule doesn't allow."""
    rules = allowed(spark).where(F.size("allowed") > 0).withColumnRenamed("role", "r")
    bad = tree(spark, sf_dir).join(F.broadcast(rules), F.col("parent_role") == F.col("r")).where(~F.array_contains("allowed", F.col("role")))
    return bad.select("page_id", "pos", "role", "parent_role")


@query(TREE + "SELECT page_id, pos, role FROM tree WHERE role NOT IN (" + ", ".join(f"'{r}'" for r in sorted(K.ALLOWED)) + ")")
def schema_unknown_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).join(F.broadcast(allowed(spark)), "role", "left_anti").select("page_id", "pos", "role")


@query(TREE + """, n AS (SELECT page_id, parent_pos, parent_role, count(*) AS n_kids FROM tree WHERE parent_pos IS NOT NULL GROUP BY 1, 2, 3)
SELECT n.page_id, n.parent_pos AS pos, n.parent_role AS role, n_kids, CASE WHEN n_kids < lo THEN 'few' ELSE 'many' END AS fault
FROM n JOIN (VALUES ('L', 2, 5), ('LI', 1, 1), ('Art', 1, 6)) v(role, lo, hi) ON v.role = n.parent_role WHERE n_kids < lo OR n_kids > hi""")
def schema_child_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([("L", 2, 5), ("LI", 1, 1), ("Art", 1, 6)], "role string, lo int, hi int")
    n = tree(spark, sf_dir).where("parent_pos is not null").groupBy("page_id", F.col("parent_pos").alias("pos"), F.col("parent_role").alias("role")).agg(F.count("*").alias("n_kids"))
    return n.join(F.broadcast(limits), "role").where("n_kids < lo or n_kids > hi").select("page_id", "pos", "role", "n_kids", F.when(F.col("n_kids") < F.col("lo"), "few").otherwise("many").alias("fault"))


@query(TREE + "SELECT page_id, pos, role, parent_role FROM tree WHERE parent_role IS NOT NULL AND (role = 'LI' AND parent_role <> 'L' OR role = 'Link' AND parent_role NOT IN ('P', 'Span', 'LBody') OR role = 'H1' AND parent_role NOT IN ('Document', 'Art', 'Sect', 'Div'))")
def schema_wrong_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = spark.createDataFrame([("LI", ["L"]), ("Link", ["P", "Span", "LBody"]), ("H1", ["Document", "Art", "Sect", "Div"])], "role string, parents array<string>")
    return tree(spark, sf_dir).join(F.broadcast(need), "role").where(F.col("parent_role").isNotNull() & ~F.array_contains("parents", F.col("parent_role"))).select("page_id", "pos", "role", "parent_role")


@query(TREE + "SELECT page_id, count(*) FILTER (role IN ('Part', 'Sect', 'Art', 'Div')) AS n_grouping, min(pos) FILTER (role IN ('Part', 'Sect', 'Art', 'Div')) AS first_pos FROM tree GROUP BY page_id")
def needless_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.col("role").isin(*K.GROUPING)
    return tree(spark, sf_dir).groupBy("page_id").agg(F.count_if(group).alias("n_grouping"), F.min(F.when(group, F.col("pos"))).alias("first_pos"))


@query(TREE + """, walk AS (
  SELECT page_id, pos, lpad(kid_ord::VARCHAR, 4, '0') AS path FROM tree WHERE parent_pos IS NULL
  UNION ALL SELECT c.page_id, c.pos, w.path || '.' || lpad(c.kid_ord::VARCHAR, 4, '0') FROM walk w JOIN tree c ON c.page_id = w.page_id AND c.parent_pos = w.pos)
SELECT page_id, pos, path, row_number() OVER (PARTITION BY page_id ORDER BY path) AS pre FROM walk""")
def preorder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by walking levels; pages' trees are numbered as any other."""
    from docloom.operators.hierarchy import numbered

    elem = tree(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.col("pos").alias("elem_id"), F.col("parent_pos").alias("parent_id"), "kid_ord", F.lit(None).cast("string").alias("title"), "role")
    steps = F.array_join(F.transform("path", lambda k: F.lpad(k.cast("string"), 4, "0")), ".")
    return numbered(elem).select(F.col("doc_id").alias("page_id"), F.col("elem_id").alias("pos"), steps.alias("path"), F.col("pre").cast("long").alias("pre"))


@query(TREE + """SELECT page_id, pos, href FROM tree WHERE tag = 'a' AND NOT coalesce(regexp_matches(href, '^[Hh][Tt][Tt][Pp][Ss]?://([^\\s/?#@\\[\\]]*@)?([^\\s/?#@:\\[\\]]+\\.)+\\p{L}{2,}(:\\d*)?([/?#][^\\s<>"{}|\\\\^`\\[\\]]*)?$'), false)""".replace("\\\\", "\\"))
def invalid_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).where((F.col("tag") == "a") & ~exprs.valid_web_uri(F.col("href"))).select("page_id", "pos", "href")


@query(TREE + "SELECT page_id, pos, href, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM tree WHERE tag = 'a'")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("pos")
    return tree(spark, sf_dir).where("tag = 'a'").select("page_id", "pos", "href", F.row_number().over(w).cast("long").alias("n"))


@query(TREE + """, a AS (SELECT page_id, pos, href AS dest, CASE WHEN href IS NOT NULL AND lag(href) OVER w = href THEN 0 ELSE 1 END AS new
  FROM tree WHERE tag = 'a' WINDOW w AS (PARTITION BY page_id ORDER BY pos)), b AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY pos)::BIGINT AS run FROM a)
SELECT page_id, run, dest, count(*) AS n_links, min(pos) AS first_pos FROM b WHERE dest IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def split_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of links of a page, one after another, that have one destination."""
    a = tree(spark, sf_dir).where("tag = 'a'").select("page_id", "pos", F.col("href").alias("dest"))
    r = runs.islands(a, ["page_id"], ["pos"], F.coalesce("dest", F.concat(F.lit("\0"), F.col("pos").cast("string"))))
    return r.where("dest is not null").groupBy("page_id", "run", "dest").agg(F.count("*").alias("n_links"), F.min("pos").alias("first_pos")).where("n_links >= 2")


@query(TREE + """, kids AS (SELECT page_id, parent_pos AS pos, any_value(parent_role) AS role, count(*) AS n, bool_and(role = 'Link') AS links FROM tree WHERE parent_pos IS NOT NULL GROUP BY 1, 2
), lists AS (SELECT t.page_id, t.parent_pos AS pos, count(*) AS n, bool_and(t.role = 'LI' AND coalesce(k.links, false)) AS links FROM tree t LEFT JOIN kids k ON k.page_id = t.page_id AND k.pos = t.pos WHERE t.parent_role = 'L' GROUP BY 1, 2)
SELECT page_id, pos, 'LI' AS role, n AS n_kids FROM kids WHERE role = 'LI' AND links UNION ALL SELECT page_id, pos, 'L', n FROM lists WHERE links""")
def link_only_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that hold links only, and lists of such items only."""
    n = tree(spark, sf_dir).where("parent_pos is not null")
    kids = n.groupBy("page_id", F.col("parent_pos").alias("pos")).agg(F.first("parent_role").alias("role"), F.count("*").alias("n_kids"), F.bool_and(F.col("role") == "Link").alias("links"))
    items = n.where("parent_role = 'L'").join(kids.select("page_id", "pos", "links"), ["page_id", "pos"], "left")
    lists = items.groupBy("page_id", F.col("parent_pos").alias("pos")).agg(F.count("*").alias("n_kids"), F.bool_and((F.col("role") == "LI") & F.coalesce("links", F.lit(False))).alias("links"))
    return kids.where("role = 'LI' and links").select("page_id", "pos", "role", "n_kids").unionByName(lists.where("links").select("page_id", "pos", F.lit("L").alias("role"), "n_kids"))


@query(r"""SELECT page_id, NOT regexp_matches(html, '<html[^>]*\slang="[^"]+"') AS no_lang, NOT contains(html, '<h1') AS no_h1, NOT contains(html, '<body') AS no_document FROM pages""")
def missing_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return t(spark, sf_dir, "pages").select("page_id", (~h.rlike(r'<html[^>]*\slang="[^"]+"')).alias("no_lang"), (~h.contains("<h1")).alias("no_h1"), (~h.contains("<body")).alias("no_document"))


@query("SELECT page_id, NOT contains(html, '<h1') AS no_h1, NOT contains(html, '<h1') OR regexp_matches(html, '<h1[^>]*>\\s*</h1>') AS nothing_told FROM pages")
def missing_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a heading, and those whose heading says nothing."""
    h = F.col("html")
    return t(spark, sf_dir, "pages").select("page_id", (~h.contains("<h1")).alias("no_h1"), (~h.contains("<h1") | h.rlike(r"<h1[^>]*>\s*</h1>")).alias("nothing_told"))


@query(TREE + "SELECT page_id, bool_or(role = 'Document') AS has_document, count(*) FILTER (parent_pos IS NULL) AS n_roots FROM tree GROUP BY 1")
def has_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).groupBy("page_id").agg(F.bool_or(F.col("role") == "Document").alias("has_document"), F.count_if(F.col("parent_pos").isNull()).alias("n_roots"))


@query(TREE + """, nxt AS (SELECT page_id, pos, tag, closing, lead(closing) OVER w AS c, lead(tag) OVER w AS n FROM kept WINDOW w AS (PARTITION BY page_id ORDER BY pos))
SELECT page_id, tag, count(*) AS n_empty FROM nxt WHERE NOT closing AND c AND n = tag AND tag <> 'p' GROUP BY 1, 2""")
def empty_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements without element children, by page and tag."""
    w = Window.partitionBy("page_id").orderBy("pos")
    n = html.tokens(t(spark, sf_dir, "pages")).withColumn("c", F.lead("closing").over(w)).withColumn("n", F.lead("tag").over(w))
    return n.where("not closing and c and n = tag and tag <> 'p'").groupBy("page_id", "tag").agg(F.count("*").alias("n_empty"))


@query("""WITH a AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM a) SELECT conv_id, run, role, count(*) AS n_turns, min(turn) AS first_turn FROM b GROUP BY 1, 2, 3""")
def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs.islands(t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], F.col("role"))
    return r.groupBy("conv_id", "run", "role").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"))


@query("SELECT conv_id, count(*) AS n_turns, regexp_full_match(string_agg(role || ' ', '' ORDER BY turn), '(system )?(user assistant )+(user )?') AS fits FROM conversations GROUP BY conv_id")
def child_pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as children, the conversation's rule as a child pattern."""
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: F.concat(s["role"], F.lit(" "))), "")
    c = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), roles.alias("roles"))
    return c.select("conv_id", "n_turns", F.col("roles").rlike(child_regex("system? (user assistant)+ user?")).alias("fits"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 30 THEN text ELSE rtrim(k, ' ') || '…+' || (length(text) - length(rtrim(k, ' '))) END AS excerpt FROM (
SELECT doc_id, text, CASE WHEN contains(left(text, 29), ' ') AND 29 - instr(reverse(left(text, 29)), ' ') >= 15 THEN left(text, (29 - instr(reverse(left(text, 29)), ' '))::INT) ELSE left(text, 29) END AS k FROM documents)""")
def truncate_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", exprs.truncate(F.col("text")).alias("excerpt"))


@query("""WITH h AS (SELECT lang, floor(n_chars / 100.0 * 4 + 0.5) / 4 AS size, sum(length(text))::BIGINT AS weight FROM documents GROUP BY 1, 2),
b AS (SELECT lang, arg_max(size, struct_pack(a := weight, b := -size)) AS body FROM h GROUP BY lang)
SELECT h.lang, size::DOUBLE AS size, level FROM (SELECT h.lang, size, dense_rank() OVER (PARTITION BY h.lang ORDER BY size DESC) AS level FROM h JOIN b ON b.lang = h.lang WHERE size > body + 0.5) h WHERE level <= 6""")
def size_histogram_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest size is body text, the six largest above it are heading levels; the language is the scope."""
    h = t(spark, sf_dir, "documents").groupBy("lang", exprs.round_quarter(F.col("n_chars") / 100).alias("size")).agg(F.sum(F.length("text")).alias("weight"))
    body = h.groupBy("lang").agg(F.max_by("size", F.struct("weight", -F.col("size"))).alias("body"))
    level = F.dense_rank().over(Window.partitionBy("lang").orderBy(F.desc("size"))).cast("long")
    return h.join(F.broadcast(body), "lang").where(F.col("size") > F.col("body") + K.HEADING_ABOVE_BODY).withColumn("level", level).where(F.col("level") <= K.HEADING_LEVELS).select("lang", "size", "level")


@query(r"SELECT doc_id, n_words, n_single, n_words >= 2 AND n_single > n_words * 0.3 AS spaced FROM (SELECT doc_id, len(w)::BIGINT AS n_words, len(list_filter(w, lambda x: length(x) = 1))::BIGINT AS n_single FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents))")
def artificial_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    one = F.filter(w, lambda x: F.length(x) == 1)
    return t(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(one).cast("long").alias("n_single"), exprs.artificial_spacing(F.col("text")).alias("spaced"))


HITS = {"symbols": r"[#$%&*]{3}", "shouting": r"[A-Z]{3,}!!", "table-row": r"\w+ \| \w+", **K.ARTIFACTS}


@query("SELECT doc_id, name FROM documents JOIN (VALUES " + ", ".join(f"('{n}', '(?i){p}')" for n, p in sorted(HITS.items())) + ") v(name, regex) ON regexp_matches(text, regex)")
def artifact_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the patterns they match; the patterns are a fixed list, tested in one pass."""
    names = F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), F.lit(n)) for n, p in sorted(HITS.items())])
    return t(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_compact(names)).alias("name"))


@query("SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines, coalesce(sum(round(l_extendedprice * 100)::BIGINT), 0)::BIGINT AS cents FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def subtree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over subtrees; lines are summed by order and orders by customer before they meet."""
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.sum("cents").alias("cents"))
    by = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), *[F.sum(c).alias(c) for c in ("orders", "lines", "cents")])
    top = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(by, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return top.select("r_name", "n_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("customers", "orders", "lines", "cents")])


BOX = "l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 10 AS x1, l_discount * 100 + 5 AS y1"


@query(f"""WITH b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINES}) AS id, {BOX} FROM lineitem),
s AS (SELECT a.l_orderkey, a.id, e.id AS best, (e.x1 - e.x0) * (e.y1 - e.y0) AS area, round((least(a.x1, e.x1) - greatest(a.x0, e.x0)) * (least(a.y1, e.y1) - greatest(a.y0, e.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)), 6) AS score FROM b a JOIN b e ON a.l_orderkey = e.l_orderkey AND a.id <> e.id
  AND a.x0 < e.x1 AND e.x0 < a.x1 AND a.y0 < e.y1 AND e.y0 < a.y1)
SELECT l_orderkey, id, best, score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, id ORDER BY score DESC, area, best) AS r FROM s WHERE score >= 0.3) WHERE r = 1""")
def rect_overlap_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box's best overlapping other box of its order: boxes are annotations and, as a table of their own, elements."""
    own = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    b = t(spark, sf_dir, "lineitem").withColumn("id", F.row_number().over(own).cast("long")).selectExpr("l_orderkey AS doc_id", "1 AS page_num", "id", *BOX.split(", "))
    elems = b.withColumnRenamed("id", "elem_id").withColumns({"depth": F.lit(1), "pre": F.col("elem_id")})
    best = geometry.best_overlap(b.withColumnRenamed("id", "annot_id"), elems, apart=True)
    return best.select(F.col("doc_id").alias("l_orderkey"), F.col("annot_id").alias("id"), F.col("elem_id").alias("best"), "score")


@query("SELECT l_orderkey, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT l_orderkey, " + BOX + " FROM lineitem) GROUP BY 1")
def rect_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.union_of(t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", *BOX.split(", ")), ["l_orderkey"])


@query("""SELECT a.event_id, min(b.event_id) AS first_match FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'click' AND b.value >= a.value - 3 AND b.value <= a.value + 3 WHERE a.event_type = 'purchase' GROUP BY 1""")
def interval_match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase's first click of its user within 3 of its value: purchases are boxes of no height, clicks are bullets."""
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page_num"), "event_id", "event_type", "value")
    boxes = e.where("event_type = 'purchase'").select("doc_id", "page_num", F.col("event_id").alias("elem_id"), F.col("value").alias("y0"), F.col("value").alias("y1"))
    points = e.where("event_type = 'click'").select("doc_id", "page_num", F.col("event_id").alias("ord"), F.col("value").alias("x"), F.col("value").alias("y"))
    return geometry.first_in_interval(boxes, points).select(F.col("elem_id").alias("event_id"), F.col("bullet.ord").alias("first_match"))


@query("""WITH a AS (SELECT * FROM events WHERE event_type = 'error'), b AS (SELECT * FROM events WHERE event_type = 'view')
SELECT event_id, near_id FROM (SELECT a.event_id, b.event_id AS near_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), b.ts > a.ts, CASE WHEN b.ts > a.ts THEN b.event_id ELSE -b.event_id END) AS r
FROM a JOIN b ON a.user_id = b.user_id) WHERE r = 1""")
def nearest_neighbour_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.expr("unix_micros(cast(ts as timestamp))").alias("at"), "event_type")
    return runs.nearest(e.where("event_type = 'error'"), e.where("event_type = 'view'"), ["user_id"], "at").select(F.col("id").alias("event_id"), "near_id")


@query(f"SELECT l_orderkey, count(*) FILTER (l_quantity < p) AS inversions FROM (SELECT l_orderkey, l_quantity, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {LINES}) AS p FROM lineitem) GROUP BY 1 HAVING count(*) FILTER (l_quantity < p) > 0")
def reading_order_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return t(spark, sf_dir, "lineitem").withColumn("p", F.lag("l_quantity").over(w)).groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") < F.col("p")).alias("inversions")).where("inversions > 0")


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, {LINES}) AS slot FROM lineitem")
def reading_order_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_quantity", *LINE_ORDER)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.row_number().over(w).cast("long").alias("slot"))


FOLD = """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, value AS first, 1::BIGINT AS run FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN abs(e.value - w.first) <= 100 THEN w.first ELSE e.value END, w.run + CASE WHEN abs(e.value - w.first) <= 100 THEN 0 ELSE 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")


@query(FOLD + "SELECT user_id, event_id, run FROM w")
def left_edge_subruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs anchored to their first value."""
    return runs.scan(events(spark, sf_dir), ["user_id"], ["event_id"], ["value"], runs.anchor(100), "run", "long").select("user_id", "event_id", "run")


LEVELS = """h AS (SELECT lang, floor(n_chars / 100.0 * 4 + 0.5) / 4 AS size, sum(length(text))::BIGINT AS weight FROM documents GROUP BY 1, 2
), b AS (SELECT lang, arg_max(size, struct_pack(a := weight, b := -size)) AS body FROM h GROUP BY lang
), levels AS (SELECT lang, size, level FROM (SELECT h.lang, size, dense_rank() OVER (PARTITION BY h.lang ORDER BY size DESC) AS level FROM h JOIN b ON b.lang IS NOT DISTINCT FROM h.lang WHERE size > body + 0.5) WHERE level <= 6
), ranked AS (SELECT d.lang, d.source, d.doc_id // 1000 AS part, d.doc_id, l.size, l.level FROM documents d JOIN levels l ON l.lang = d.lang AND l.size = floor(d.n_chars / 100.0 * 4 + 0.5) / 4)"""


@query("WITH RECURSIVE " + LEVELS + folded(["lang", "source", "part"], "doc_id") + "SELECT f.lang, f.doc_id, f.size::DOUBLE AS size, 'H' || s.out AS role FROM f JOIN state s ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source AND s.part = f.part AND s.i = f.i")
def heading_level_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order as paragraphs; a thousand ids of one language and source are a scope."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.floor(F.col("doc_id") / 1000).alias("part"), exprs.round_quarter(F.col("n_chars") / 100).alias("size"))
    ranked = docs.join(F.broadcast(size_histogram_levels(spark, sf_dir)), ["lang", "size"])
    out = runs.scan(ranked, ["lang", "source", "part"], ["doc_id"], ["level", "size"], runs.heading, "got", "long")
    return out.select("lang", "doc_id", "size", F.concat(F.lit("H"), F.col("got").cast("string")).alias("role"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, [value] AS rungs, NULL::DOUBLE AS size FROM e WHERE i = 1
  UNION ALL SELECT user_id, event_id, i, CASE WHEN opens THEN list_append(kept, value) ELSE kept END, CASE WHEN opens AND size IS NULL THEN value - kept[-1] ELSE size END
  FROM (SELECT *, value - kept[-1] >= 10 AND (size IS NULL OR abs(value - kept[-1] - size) <= 2) AS opens FROM (
    SELECT e.user_id, e.event_id, e.i, e.value, w.size, list_filter(w.rungs, lambda r, j: j = 1 OR e.value >= r - 2) AS kept FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)))
SELECT user_id, event_id, len(rungs)::BIGINT - 1 AS level FROM w""")
def toc_ladder_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.scan(events(spark, sf_dir), ["user_id"], ["event_id"], ["value"], runs.rungs(), "level", "long").select("user_id", "event_id", "level")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events),
w AS (SELECT user_id, event_type, event_id, value, i, true AS ok, [value] AS kept FROM e WHERE i = 1
  UNION ALL SELECT user_id, event_type, event_id, value, i, ok, CASE WHEN ok THEN list_append(kept, value) ELSE kept END FROM (
    SELECT e.*, w.kept, len(list_filter(w.kept, lambda k: abs(k - e.value) <= 1)) = 0 AS ok FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.i = w.i + 1))
SELECT user_id, event_type, event_id, value FROM w WHERE ok""")
def dedupe_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events of a type those farther than 1 from all kept before."""
    return runs.scan(events(spark, sf_dir), ["user_id", "event_type"], ["event_id"], ["value"], runs.sieve(1.0), "ok", "boolean").where("ok").drop("ok")


GROUPED = ["NeedlessNesting", "MissingAltText", "InvalidLinkUri", "EmptyElement", "StaleScribble"]


def found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Context]:
    """Issues of some checks over pages."""
    ctx = Context(spark, check_queries.tables(spark, sf_dir))
    return run_checks(ctx, GROUPED), ctx


ISSUES = check_queries.CANON + ", issues AS (" + " UNION ALL ".join(f"SELECT *, {i} AS check_ord FROM ({check_queries.ORACLES[f'check_{CHECKS[n].run.__name__}'].removeprefix(check_queries.CANON)})" for i, n in enumerate(GROUPED)) + ")\n"


@query(ISSUES + """, g AS (SELECT doc_id, type, count(*) AS n, min(check_ord) AS o, list_sort(list_distinct(list(page) FILTER (page > 0))) AS p FROM issues GROUP BY 1, 2
), s AS (SELECT doc_id, type, n, rank() OVER (PARTITION BY doc_id ORDER BY o) AS place, CASE WHEN coalesce(len(p), 0) = 0 THEN '' WHEN len(p) = 1 THEN p[1]::VARCHAR WHEN p[-1] - p[1] + 1 = len(p) THEN p[1] || '-' || p[-1] ELSE array_to_string(p, ', ') END AS pages FROM g)
SELECT doc_id, type, n, place, CASE WHEN n >= 3 AND pages <> '' THEN n || ' ' || type || ' (p. ' || pages || ')' ELSE n || ' ' || type END AS line FROM s""")
def issue_group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of pages as the report groups them."""
    g = report.groups(found(spark, sf_dir)[0])
    return g.select("doc_id", "type", "n", F.rank().over(Window.partitionBy("doc_id").orderBy("first")).cast("long").alias("place"), "line")


@query(ISSUES + """SELECT type, count(*) AS detected, count(fix_kind) AS resolved, 0::BIGINT AS failed, count(*) - count(fix_kind) AS remaining,
coalesce(sum(CASE WHEN type IN ('NEEDLESS_NESTING', 'EMPTY_ELEMENT') THEN detail::BIGINT ELSE 1 END) FILTER (fix_kind IS NOT NULL), 0)::BIGINT AS items FROM issues GROUP BY 1""")
def resolved_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixes of the issues resolve, by type."""
    issues, ctx = found(spark, sf_dir)
    return report.breakdown(pipeline.resolve(issues, ctx.closure))


@query(check_queries.CANON + """SELECT v.doc_id, v.elem_id::INTEGER AS elem_id, CASE WHEN EXISTS (SELECT 1 FROM anc a JOIN v h ON h.doc_id = a.doc_id AND h.elem_id = a.anc_id WHERE a.doc_id = v.doc_id AND a.elem_id = v.elem_id AND a.dist > 0 AND h.role IN ('L', 'LI', 'Link')) THEN 'superseded' ELSE 'resolved' END AS status
FROM v WHERE role IN ('L', 'LI', 'Link')""")
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, their items and links as artifacts, in order: what stands below one that is taken is needless."""
    ctx = Context(spark, check_queries.tables(spark, sf_dir))
    each = ctx.numbers.where("role in ('L', 'LI', 'Link')").select("doc_id", "elem_id", F.lit("MISTAGGED_ARTIFACT").alias("type"), F.lit(0).alias("check_ord"), F.lit(0).alias("fix_priority"), F.col("pre").alias("seq"), F.lit("element").alias("detail"), F.lit(0).alias("page"), F.lit("MistaggedArtifact").alias("fix_kind"))
    return pipeline.resolve(each, ctx.closure).select("doc_id", "elem_id", "status")


@query("""SELECT conv_id, CASE WHEN count(*) = 1 THEN min(turn)::VARCHAR WHEN max(turn) - min(turn) + 1 = count(*) THEN min(turn) || '-' || max(turn) ELSE string_agg(turn::VARCHAR, ', ' ORDER BY turn) END AS pages FROM conversations GROUP BY conv_id""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(exprs.page_range(F.collect_list("turn")).alias("pages"))


@query("SELECT l_orderkey, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS median_edge, min(l_quantity) FILTER (l_quantity > 10) AS left_edge FROM lineitem GROUP BY 1")
def median_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.median(q).alias("median_edge"), F.min(F.when(q > 10, q)).alias("left_edge"))


@query("SELECT (floor(l_extendedprice * 4 + 0.5) / 4)::DOUBLE AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def bucket_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy(exprs.round_quarter(F.col("l_extendedprice")).alias("bucket")).agg(F.count("*").alias("n"))


OWNER = "struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey, d := l_shipdate, e := l_extendedprice)"


def _owner(spark: SparkSession, sf_dir: str, pick: Callable) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice")
    return t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(pick("l_orderkey", order).alias("owner"), pick("l_suppkey", order).alias("supplier"))


@query(f"SELECT l_partkey, arg_min(l_orderkey, {OWNER}) AS owner, arg_min(l_suppkey, {OWNER}) AS supplier FROM lineitem GROUP BY 1")
def first_owner_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owner(spark, sf_dir, F.min_by)


@query(f"SELECT l_partkey, arg_max(l_orderkey, {OWNER}) AS owner, arg_max(l_suppkey, {OWNER}) AS supplier FROM lineitem GROUP BY 1")
def last_owner_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owner(spark, sf_dir, F.max_by)


URL_PATTERNS = [(1, "example.com/de"), (2, "/fr/"), (3, "blog."), (4, "nowhere.example")]


@query("SELECT n, pattern, arg_min(url, struct_pack(a := length(url), b := page_id)) AS shortest, count(*) AS hits FROM pages JOIN (VALUES " + ", ".join(f"({n}, '{p}')" for n, p in URL_PATTERNS) + ") v(n, pattern) ON contains(url, pattern) GROUP BY 1, 2")
def pattern_shortest_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(F.contains(F.col("url"), F.lit(p)), F.struct(F.lit(n).alias("n"), F.lit(p).alias("pattern"))) for n, p in URL_PATTERNS]))
    found = t(spark, sf_dir, "pages").select("page_id", "url", F.explode(hits).alias("h"))
    return found.groupBy("h.n", "h.pattern").agg(F.min_by("url", F.struct(F.length("url"), F.col("page_id"))).alias("shortest"), F.count("*").alias("hits"))


HOST = r"^https?://([^/]+)"


@query(f"SELECT host, count(*) AS n_pages, count(*) FILTER (now_at <> want_at) AS moved FROM (SELECT host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS now_at, row_number() OVER (PARTITION BY host ORDER BY url, page_id) AS want_at FROM (SELECT page_id, url, regexp_extract(url, '{HOST}', 1) AS host FROM pages)) GROUP BY 1")
def reorder_out_of_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", HOST, 1).alias("host"))
    p = p.withColumn("now_at", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).withColumn("want_at", F.row_number().over(Window.partitionBy("host").orderBy("url", "page_id")))
    return p.groupBy("host").agg(F.count("*").alias("n_pages"), F.count_if(F.col("now_at") != F.col("want_at")).alias("moved"))


@query("""SELECT CASE WHEN a.o_orderkey IS NULL THEN 'unmatched element' WHEN b.o_orderkey IS NULL THEN 'unmatched line' WHEN a.o_orderpriority = b.o_orderpriority THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n
FROM (SELECT o_orderkey, left(o_orderpriority, 1) AS o_orderpriority FROM orders WHERE o_orderstatus <> 'F') a FULL JOIN (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN '1' ELSE left(o_orderpriority, 1) END AS o_orderpriority FROM orders WHERE o_orderstatus <> 'O') b ON a.o_orderkey = b.o_orderkey GROUP BY 1""")
def diagram_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    a = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("a"), first.alias("ap"))
    b = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("b"), F.when(F.col("o_totalprice") > 200000, "1").otherwise(first).alias("bp"))
    status = F.when(F.col("a").isNull(), "unmatched element").when(F.col("b").isNull(), "unmatched line").when(F.col("ap") == F.col("bp"), "unchanged").otherwise("updated")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, d.lang FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id")
def unmatched_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    return t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


SLUG = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s, '^[A-Za-z]+://', ''), '\.html?$', ''), '[^A-Za-z0-9_]', '-', 'g'), '-+', '-', 'g'), '-')"


@query("SELECT page_id, CASE WHEN s = '' THEN 'index' ELSE s END AS slug FROM (SELECT page_id, " + SLUG % "url" + " AS s FROM pages)")
def sanitize_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", exprs.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, base || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS name FROM (SELECT page_id, base, row_number() OVER (PARTITION BY base ORDER BY page_id) AS n FROM (SELECT page_id, " + SLUG % f"regexp_extract(url, '{HOST}', 1)" + " AS base FROM pages))")
def dup_name_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select("page_id", exprs.slug(F.regexp_extract("url", HOST, 1)).alias("base"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("page_id"))
    return p.withColumn("n", n).select("page_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("name"))


@query(r"""SELECT doc_id, len(s)::BIGINT AS n_segments, s[1] AS first_segment, len(list_filter(s, lambda x: trim(x) = 'OK')) > 0 AS verified FROM (SELECT doc_id, string_split(regexp_replace(replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '. ', ' // '), '( // )+$', ''), ' // ') AS s FROM documents WHERE length(trim(text)) > 0)""")
def note_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of whole texts as segments of a note."""
    # A tool's mark is no part of a note, so that a text may begin with one.
    d = t(spark, sf_dir, "documents").where("length(trim(text)) > 0").select("doc_id", F.concat(F.lit("__"), F.when(F.startswith("text", F.lit(":")), F.lit(":")).otherwise(F.lit("")), F.replace("text", F.lit(". "), F.lit(" // "))).alias("title"))
    s = exprs.segments(F.col("title"))
    return d.select("doc_id", F.size(s).cast("long").alias("n_segments"), F.element_at(s, 1).alias("first_segment"), exprs.is_verified(F.col("title")).alias("verified"))


CODES = [(1, 0xFB00), (2, 0xFB01), (3, 0xFB03), (4, 65), (5, 0xFB06), (6, 0x4E00)]


@query("SELECT v.code, m.point, coalesce(x.mapped, chr(m.point)) AS mapped, x.mapped IS NOT NULL AS broken FROM (VALUES " + ", ".join(f"({c})" for c, _ in CODES) + ") v(code) JOIN (VALUES " + ", ".join(f"({c}, {p})" for c, p in CODES) + ") m(code, point) ON m.code = v.code LEFT JOIN (VALUES " + ", ".join(f"({p}, '{s}')" for p, s in sorted(K.LIGATURES.items())) + ") x(point, mapped) ON x.point = m.point")
def ligature_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    font = spark.createDataFrame([(c, p, chr(p)) for c, p in CODES], "code int, point int, was string")
    known = spark.createDataFrame(sorted(K.LIGATURES.items()), "point int, mapped string")
    return font.join(F.broadcast(known), "point", "left").select("code", "point", F.coalesce("mapped", "was").alias("mapped"), F.col("mapped").isNotNull().alias("broken"))


SELECTION = """WITH known(i, name, std) AS (VALUES (1, 'TaggedPdf', true), (2, 'Language', true), (3, 'EmptyElement', true), (4, 'ClearRoleMap', false), (5, 'InlineDestinations', false)), asked(name, how) AS (VALUES ('ClearRoleMap', 'include'), ('TaggedPdf', 'skip'), ('Nothing', 'include'))
SELECT row_number() OVER (ORDER BY i)::INTEGER AS check_ord, name FROM known WHERE (std OR name IN (SELECT name FROM asked WHERE how = 'include')) AND name NOT IN (SELECT name FROM asked WHERE how = 'skip')"""


@query(SELECTION)
def check_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = pipeline.select_checks(["TaggedPdf", "Language", "EmptyElement"], ["ClearRoleMap", "InlineDestinations"], include={"ClearRoleMap", "Nothing"}, skip={"TaggedPdf"})
    return spark.createDataFrame(list(enumerate(names, 1)), "check_ord int, name string")
