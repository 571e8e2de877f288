"""The checks as queries over pages shredded into canonical tables, and their SQL.

``CANON`` builds the same tables from ``pages`` by the layout's rules, in SQL; each check's
SQL works on those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import constants as K
from docloom.operators import rules
from docloom.operators.checks import CHECKS, Context, run_checks
from docloom.sources import layout
from docloom.sources.tables import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COLUMNS = ["doc_id", "type", "severity", "elem_id", "page", "detail", "fix_kind"]

_PRE = layout.PER_PAGE
ROLE = " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in layout.ROLES.items())
MAPPED = " ".join(f"WHEN '{r}' THEN '{m}'" for r, m in layout.ROLE_MAP.items())
SIZE = " ".join(f"WHEN '{t}' THEN {s}" for t, s in layout.SIZES.items())
NOTE = " ".join(f"WHEN '{m}' THEN '{n}'" for m, n in layout.NOTES.items())
LEAF = "('p', 'meta')"
CANON = rf"""
WITH RECURSIVE raw AS (
  SELECT page_id AS doc_id, coalesce(url, '') AS url, coalesce(html, '') AS html, regexp_replace(coalesce(html, ''), '{layout.DROP}', '', 'g') AS clean FROM pages
), split AS (
  SELECT doc_id, regexp_extract_all(clean, '{layout.TOKEN}') AS toks, string_split_regex(clean, '{layout.TOKEN}') AS rest FROM raw
), toks AS (
  SELECT doc_id, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS token, unnest(rest[2:]) AS piece FROM split
), read AS (
  SELECT *, starts_with(token, '<!--') AS comment, starts_with(token, '</') AS closing, regexp_extract(token, '^</?([a-z0-9]+)', 1) AS tag,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(piece, '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS text FROM toks
), leveled AS (
  SELECT *, NOT comment AND NOT closing AS opens, sum(CASE WHEN comment OR tag IN {LEAF} THEN 0 WHEN closing THEN -1 ELSE 1 END) OVER w AS lvl,
    coalesce(sum(CASE WHEN NOT comment AND NOT closing AND text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k
  FROM read WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), opened AS (
  SELECT *, lvl + CASE WHEN tag IN {LEAF} THEN 1 ELSE 0 END AS depth, (1 + k // {_PRE})::INTEGER AS here, CASE WHEN tag = 'div' AND contains(token, 'class="ad"') THEN 'Figure' ELSE CASE tag {ROLE} END END AS role,
    CASE WHEN tag = 'a' AND contains(token, 'href="') THEN regexp_extract(token, 'href="([^"]*)"', 1) END AS href FROM leveled WHERE opens
), up AS (
  SELECT c.doc_id, c.pos, max(p.pos) AS parent FROM opened c JOIN opened p ON p.doc_id = c.doc_id AND p.depth = c.depth - 1 AND p.pos < c.pos AND p.tag NOT IN {LEAF} GROUP BY 1, 2
), el0 AS (
  SELECT o.*, u.parent, CASE WHEN u.parent IS NULL THEN 1 ELSE 4 * row_number() OVER (PARTITION BY o.doc_id, u.parent ORDER BY o.pos) END AS ord FROM opened o LEFT JOIN up u ON u.doc_id = o.doc_id AND u.pos = o.pos
), el AS (
  SELECT *, tag = 'a' AND parent IS NOT NULL AND coalesce(length(href), 99) <= {layout.SHORT_HREF} AS outside, tag = 'a' AND parent IS NOT NULL AND length(text) > {layout.ONE_LINK} AS again, text <> '' AS run, k % {_PRE} AS mcid,
    (CASE tag {SIZE} ELSE 9.0 END + CASE WHEN tag = 'p' AND starts_with(piece, '<b>') THEN 2 ELSE 0 END)::DOUBLE AS size, tag = 'p' AND length(text) <= {layout.SHORT_P} AS short,
    CASE WHEN tag = 'p' THEN CASE regexp_extract(text, '{layout.MARK}') {NOTE} END END AS note FROM el0
), box AS (
  SELECT doc_id, pos, tag, role, text, here AS page_num, mcid, size, x0, y1 - CASE WHEN role = 'Figure' THEN 90 ELSE size * ceil(length(text) * size * 0.5 / {layout.WIDTH}) END AS y0,
    x0 + CASE WHEN role = 'Figure' THEN 8 * length(text) ELSE least({layout.WIDTH}, length(text) * size * 0.5) END AS x1, y1
  FROM (SELECT *, (10 * depth + CASE WHEN short THEN 20 ELSE 0 END)::DOUBLE AS x0, (800 - {layout.STEP} * mcid)::DOUBLE AS y1 FROM el WHERE run)
), content AS (
  SELECT doc_id, page_num, mcid, text, true AS is_text, role = 'Figure' AS is_image, x0, y0, x1, y1 FROM box UNION ALL SELECT doc_id, page_num, 100 + mcid, NULL, false, true, x0, y1 - 10, x0 + 20, y1 FROM box WHERE role = 'Figure'
), elem AS (
  SELECT doc_id, pos AS elem_id, parent AS parent_id, ord AS kid_ord, role AS role_raw, CASE WHEN run THEN here END AS pg, note AS title FROM el
  UNION ALL SELECT doc_id, {layout.AGAIN} + pos, parent, ord + 1, 'Link', here, NULL FROM el WHERE again
), kid AS (
  SELECT doc_id, parent_id AS owner_id, kid_ord, 'elem' AS kind, elem_id AS child_id, NULL AS mcid, NULL AS page_num, NULL AS annot_id FROM elem WHERE parent_id IS NOT NULL
  UNION ALL SELECT doc_id, CASE WHEN outside THEN parent ELSE pos END, CASE WHEN outside THEN ord - 1 ELSE 0 END, 'mcr', NULL, mcid, here, NULL FROM el WHERE run
  UNION ALL SELECT doc_id, pos, 1, 'mcr', NULL, 100 + mcid, here, NULL FROM el WHERE run AND role = 'Figure'
  UNION ALL SELECT doc_id, pos, 2, 'objr', NULL, NULL, CASE WHEN href IS NULL OR length(href) = strlen(href) THEN here END, pos FROM el WHERE tag = 'a'
  UNION ALL SELECT doc_id, {layout.AGAIN} + pos, 2, 'objr', NULL, NULL, here, {layout.AGAIN} + pos FROM el WHERE again
), links AS (
  SELECT e.doc_id, e.pos AS elem_id, e.pos AS annot_id, href AS uri, b.x0, b.y0, b.x1, b.y1 FROM el e LEFT JOIN box b ON b.doc_id = e.doc_id AND b.pos = e.pos WHERE e.tag = 'a'
  UNION ALL SELECT e.doc_id, {layout.AGAIN} + e.pos, {layout.AGAIN} + e.pos, rtrim(href, ',.'), b.x0, b.y0, b.x1, b.y1 FROM el e JOIN box b ON b.doc_id = e.doc_id AND b.pos = e.pos WHERE again
), walk AS (
  SELECT doc_id, elem_id, [kid_ord] AS path, [elem_id] AS ids FROM elem WHERE parent_id IS NULL AND title IS DISTINCT FROM '__OK'
  UNION ALL SELECT e.doc_id, e.elem_id, list_append(w.path, e.kid_ord), list_append(w.ids, e.elem_id) FROM walk w JOIN elem e ON e.doc_id = w.doc_id AND e.parent_id = w.elem_id WHERE e.title IS DISTINCT FROM '__OK'
), v0 AS (
  SELECT e.*, w.path, w.ids, CASE role_raw {MAPPED} ELSE role_raw END AS role, row_number() OVER (PARTITION BY e.doc_id ORDER BY w.path) AS pre FROM walk w JOIN elem e ON e.doc_id = w.doc_id AND e.elem_id = w.elem_id
), anc AS (
  SELECT doc_id, elem_id, pre, pg, unnest(ids) AS anc_id, len(ids) - unnest(range(1, len(ids) + 1)) AS dist FROM v0
), first_page AS (
  SELECT doc_id, anc_id AS elem_id, arg_min(pg, pre) AS first FROM anc WHERE pg > 0 GROUP BY 1, 2
), v AS (
  SELECT e.*, coalesce(e.pg, f.first, 0)::INTEGER AS page FROM v0 e LEFT JOIN first_page f ON f.doc_id = e.doc_id AND f.elem_id = e.elem_id
), txt AS (
  SELECT a.doc_id, a.anc_id AS elem_id, any_value(h.page) AS page, coalesce(string_agg(c.text, ' ' ORDER BY list_append(o.path, k.kid_ord)) FILTER (c.text IS NOT NULL), '') AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, bool_or(is_image) AS is_image
  FROM anc a JOIN v h ON h.doc_id = a.doc_id AND h.elem_id = a.anc_id JOIN v0 o ON o.doc_id = a.doc_id AND o.elem_id = a.elem_id JOIN kid k ON k.doc_id = a.doc_id AND k.owner_id = a.elem_id AND k.kind = 'mcr'
  JOIN content c ON c.doc_id = a.doc_id AND c.mcid = k.mcid AND c.page_num = h.page GROUP BY 1, 2
)
"""


def issue(type_: str, source: str, severity: str = "WARNING", fix: str | None = None, elem: str = "NULL", page: str = "0", detail: str = "''", distinct: bool = False) -> str:
    return f"SELECT {'DISTINCT ' if distinct else ''}doc_id::BIGINT AS doc_id, '{type_}' AS type, '{severity}' AS severity, ({elem})::INTEGER AS elem_id, ({page})::INTEGER AS page, ({detail})::VARCHAR AS detail, {repr(fix) if fix else 'NULL'} AS fix_kind FROM {source}"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return layout.tables(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def all_documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of pages, and beside their documents those of plain texts."""
    t = tables(spark, sf_dir)
    return t | {"doc": dealt(t["doc"].unionByName(layout.plain_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))))}


def put(name: str, sql: str, load: Callable[[SparkSession, str], dict[str, DataFrame]] = tables, options: dict | None = None) -> None:
    """Register a check's query; what it needs runs before it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = run_checks(Context(spark, load(spark, sf_dir), options or {}), [*sorted(CHECKS[name].needs), name])
        return found.where(F.col("check") == name).select(*COLUMNS)

    query.__doc__ = CHECKS[name].run.__doc__
    QUERIES[key := f"check_{CHECKS[name].run.__name__}"] = query
    ORACLES[key] = sql


DOCS = r""", doc AS (
  SELECT doc_id, (1 + greatest(0, count(*) FILTER (run) - 1) // 4)::INTEGER AS n_pages, false AS plain, false AS blank, any_value(lang) AS lang, any_value(marked) AS marked, any_value(ua) AS ua, any_value(tabs) AS tabs, bool_or(role IN ('Article', 'Footer')) AS mapped
  FROM el JOIN (SELECT doc_id, nullif(regexp_extract(html, '<html[^>]*\slang="([^"]+)"', 1), '') AS lang, contains(html, '</html>') AS marked, starts_with(url, 'https') AS ua, contains(html, '</body>') AS tabs FROM raw) USING (doc_id) GROUP BY 1
  UNION ALL SELECT -1 - doc_id, 1, true, coalesce(length(text), 0) = 0 OR length(regexp_replace(text, '[^\p{L}]', '', 'g')) * 10 < length(text) * 7, NULL, false, false, false, false FROM documents
)"""

put("ImageOnlyDocument", CANON + DOCS + issue("IMAGE_ONLY_DOCUMENT", "doc WHERE plain AND blank", "FATAL"), all_documents)
put("StructureTreeExists", CANON + DOCS + issue("NO_STRUCT_TREE", "doc WHERE plain", "FATAL"), all_documents)
put("LanguageSet", CANON + DOCS + issue("LANGUAGE_NOT_SET", "doc WHERE lang IS NULL", "ERROR", "Language"), all_documents)
put("TabOrder", CANON + DOCS + issue("TAB_ORDER_NOT_SET", "doc WHERE NOT tabs", "ERROR", "TabOrder"), all_documents)
put("TaggedPdf", CANON + DOCS + issue("NOT_TAGGED_PDF", "doc WHERE NOT marked", "ERROR", "TaggedPdf"), all_documents)
put("PdfUaConformance", CANON + DOCS + issue("FALSE_PDFUA_CONFORMANCE", "doc WHERE ua", "ERROR", "PdfUaConformance"), all_documents)
put("ClearRoleMap", CANON + DOCS + issue("ROLEMAP_PRESENT", "doc WHERE mapped", "INFO", "ClearRoleMap"), all_documents)
put("ReplaceRoleMap", CANON + DOCS + issue("ROLEMAP_PRESENT", "doc", "INFO", "ReplaceRoleMap"), all_documents)
put("MissingDocument", CANON + issue("MISSING_DOCUMENT_ELEMENT", "(SELECT doc_id FROM elem WHERE parent_id IS NULL GROUP BY 1 HAVING NOT bool_or(role_raw = 'Document'))", "ERROR", "MissingDocument"))
put("StructTreeOrder", CANON + """, seat AS (SELECT a.doc_id, a.anc_id AS elem_id, min(k.page_num * 100000 + k.mcid) AS seat FROM anc a JOIN kid k ON k.doc_id = a.doc_id AND k.owner_id = a.elem_id AND k.kind = 'mcr' GROUP BY 1, 2
), back AS (SELECT v.doc_id, v.parent_id, coalesce(seat, 1e15) AS seat, lag(coalesce(seat, 1e15)) OVER (PARTITION BY v.doc_id, v.parent_id ORDER BY kid_ord) AS was FROM v LEFT JOIN seat USING (doc_id, elem_id) WHERE v.parent_id IS NOT NULL)
""" + issue("STRUCT_TREE_OUT_OF_ORDER", "(SELECT DISTINCT doc_id, parent_id AS elem_id FROM back WHERE seat < was) JOIN v USING (doc_id, elem_id)", fix="StructTreeOrder", elem="elem_id", page="page"))
put("UnmarkedLink", CANON + issue("UNMARKED_LINK", f"el WHERE run AND tag <> 'a' AND regexp_matches(text, '{layout.HOST}')", "ERROR", "UnmarkedLink", page="here", detail=f"{layout.AUTO} + pos"))
put("UnexpectedWidget", CANON + issue("UNEXPECTED_WIDGET", "(SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS q FROM (SELECT doc_id, string_split(substr(url, instr(url, '?') + 1), '&') AS p FROM raw WHERE contains(url, '?'))) WHERE split_part(q, '=', 1) = 'page'", "ERROR", "UnexpectedWidget", page="1", detail=f"{layout.FIELD} + 2 * i + 1"))
put("OrphanedContent", CANON + issue("ORPHANED_CONTENT", "kid k JOIN v ON v.doc_id = k.doc_id AND v.elem_id = k.owner_id WHERE kind <> 'elem' AND coalesce(page_num, 0) = 0", fix="OrphanedContent", elem="owner_id", detail="k.kid_ord").replace("doc_id::BIGINT", "k.doc_id::BIGINT", 1))
put("NeedlessNesting", CANON + issue("NEEDLESS_NESTING", "v WHERE role IN ('Part', 'Sect', 'Art', 'Div') AND NOT (role_raw = 'Part' AND pg IS NOT NULL) GROUP BY doc_id", fix="NeedlessNesting", detail="count(*)"))
put("MissingPageParts", CANON + DOCS + """, head AS (SELECT doc_id, min(elem_id) FILTER (role_raw = 'Document') AS document FROM v WHERE parent_id IS NULL GROUP BY 1
), seen AS (SELECT h.doc_id, count(DISTINCT v.pg) FILTER (v.role_raw = 'Part' AND v.pg > 0) AS parts, count(*) FILTER (v.role_raw <> 'Part' AND v.pg > 0) AS loose FROM head h JOIN v ON v.doc_id = h.doc_id AND v.parent_id = h.document GROUP BY 1)
""" + issue("PAGE_PARTS_NOT_NORMALIZED", "doc JOIN head USING (doc_id) LEFT JOIN seen USING (doc_id) WHERE n_pages >= 5 AND (document IS NULL OR coalesce(parts, 0) < n_pages OR coalesce(loose, 0) > 0)", fix="MissingPageParts"), all_documents)
SHORT_WORD = r"^\S{1,3}$"
put("MistaggedArtifact", CANON + f""", hit AS (SELECT v.doc_id, v.elem_id, v.page FROM v JOIN txt t ON t.doc_id = v.doc_id AND t.elem_id = v.elem_id WHERE role IN {K.ARTIFACT_ROLES} AND regexp_matches(t.text, '(?i){SHORT_WORD}')
), under AS (SELECT DISTINCT a.doc_id, a.elem_id, dist > 0 AS inner FROM anc a JOIN hit h ON h.doc_id = a.doc_id AND h.elem_id = a.anc_id
), found AS (SELECT h.doc_id, h.elem_id, h.page, 'element' AS detail FROM hit h WHERE NOT EXISTS (SELECT 1 FROM under u WHERE u.doc_id = h.doc_id AND u.elem_id = h.elem_id AND u.inner)
  UNION ALL SELECT v.doc_id, v.elem_id, v.page, c.mcid::VARCHAR FROM v JOIN kid k ON k.doc_id = v.doc_id AND k.owner_id = v.elem_id AND k.kind = 'mcr' JOIN content c ON c.doc_id = k.doc_id AND c.page_num = k.page_num AND c.mcid = k.mcid
  WHERE v.role IN {K.ARTIFACT_ROLES} AND c.text IS NULL AND NOT (c.x1 - c.x0 > {K.MIN_WIDTH} AND c.y1 - c.y0 > {K.MIN_HEIGHT}) AND NOT EXISTS (SELECT 1 FROM under u WHERE u.doc_id = v.doc_id AND u.elem_id = v.elem_id))
""" + issue("MISTAGGED_ARTIFACT", "found", fix="MistaggedArtifact", elem="elem_id", page="page", detail="detail"), options={"artifact_patterns": {"short-word": SHORT_WORD}})
EXCERPT = """CASE WHEN length(t) <= 30 THEN t ELSE rtrim(h, ' ') || '…+' || (length(t) - length(rtrim(h, ' '))) END"""
put("FigureWithText", CANON + """, fig AS (SELECT v.doc_id, v.elem_id, v.page, text AS t, CASE WHEN contains(left(text, 29), ' ') AND 29 - instr(reverse(left(text, 29)), ' ') >= 15 THEN left(text, (29 - instr(reverse(left(text, 29)), ' '))::INT) ELSE left(text, 29) END AS h
  FROM v JOIN txt USING (doc_id, elem_id) WHERE role_raw = 'Figure' AND v.page > 0 AND length(text) > 1)
""" + issue("FIGURE_WITH_TEXT", "fig", fix="FigureWithText", elem="elem_id", page="page", detail=EXCERPT))
put("MissingAltText", CANON + issue("FIGURE_MISSING_ALT", f"v JOIN txt USING (doc_id, elem_id) WHERE role_raw = 'Figure' AND v.page <> 0 AND is_image AND x1 - x0 > {K.MIN_WIDTH} AND y1 - y0 > {K.MIN_HEIGHT}", elem="elem_id", page="v.page"))
put("EmptyLinkTag", CANON + """, pairs AS (SELECT doc_id, owner_id, child_id, lag(kind) OVER w AS was, lag(page_num) OVER w AS page_num, lag(mcid) OVER w AS mcid FROM kid WINDOW w AS (PARTITION BY doc_id, owner_id ORDER BY kid_ord)
), near AS (SELECT DISTINCT v.doc_id, v.elem_id, p.page_num FROM pairs p JOIN v ON v.doc_id = p.doc_id AND v.elem_id = p.child_id JOIN content c ON c.doc_id = p.doc_id AND c.page_num = p.page_num AND c.mcid = p.mcid JOIN links l ON l.doc_id = v.doc_id AND l.elem_id = v.elem_id
  WHERE p.was = 'mcr' AND v.role_raw = 'Link' AND NOT EXISTS (SELECT 1 FROM kid k WHERE k.doc_id = v.doc_id AND k.owner_id = v.elem_id AND k.kind <> 'objr')
  AND l.x0 < c.x1 AND c.x0 < l.x1 AND l.y0 < c.y1 AND c.y0 < l.y1 AND (c.x1 - c.x0) * (c.y1 - c.y0) / ((l.x1 - l.x0) * (l.y1 - l.y0)) BETWEEN 0.5 AND 2)
""" + issue("EMPTY_LINK_TAG", "near", fix="EmptyLinkTag", elem="elem_id", page="page_num"))
WEB = r"""'^[Hh][Tt][Tt][Pp][Ss]?://([^\s/?#@\[\]]*@)?([^\s/?#@:\[\]]+\.)+\p{L}{2,}(:\d*)?([/?#][^\s<>"{}|\\^`\[\]]*)?$'"""
put("InvalidLinkUri", CANON + issue("INVALID_LINK_URI", f"links JOIN v USING (doc_id, elem_id) WHERE role_raw = 'Link' AND uri IS NOT NULL AND NOT regexp_matches(uri, {WEB})", elem="elem_id", page="page", detail="uri"))
put("BadlySplitLink", CANON + """, keyed AS (SELECT k.doc_id, k.owner_id, k.kid_ord, k.child_id, v.pre, v.page, CASE WHEN v.role_raw = 'Link' THEN l.uri END AS dest FROM kid k LEFT JOIN v ON v.doc_id = k.doc_id AND v.elem_id = k.child_id LEFT JOIN links l ON l.doc_id = k.doc_id AND l.elem_id = k.child_id
), marked AS (SELECT *, CASE WHEN dest IS NOT NULL AND dest = lag(dest) OVER (PARTITION BY doc_id, owner_id ORDER BY kid_ord) THEN 0 ELSE 1 END AS new FROM keyed
), runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, owner_id ORDER BY kid_ord) AS run FROM marked
), met AS (SELECT doc_id, owner_id, run, count(*) AS n, arg_min(child_id, pre) AS elem_id, min(page) AS page FROM runs WHERE dest IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2)
""" + issue("LINK_SPLIT_ACROSS_TAGS", "met", fix="MergeSplitLinks", elem="elem_id", page="page", detail="n"))

BULLETS = f""", bullet AS (SELECT doc_id, page_num, b.pos AS ord, x0 - 12 AS x, (y0 + y1) / 2 AS y FROM box b WHERE tag = 'p' AND length(text) <= {layout.SHORT_P}
), e AS (SELECT v.doc_id, v.elem_id, v.parent_id, v.kid_ord, v.role, v.role_raw, v.pre, v.page, t.x0, t.y0, t.x1, t.y1, v.role IN {K.NO_LIST_MEMBERS} AS skipped, coalesce(p.role IN {K.LIST_PARENTS}, false) AS sought,
  (SELECT arg_min(struct_pack(x := b.x, y := b.y), b.ord) FROM bullet b WHERE b.doc_id = v.doc_id AND b.page_num = v.page AND b.y >= t.y0 - 3 AND b.y <= t.y1 + 3) AS bullet FROM v LEFT JOIN txt t ON t.doc_id = v.doc_id AND t.elem_id = v.elem_id LEFT JOIN v p ON p.doc_id = v.doc_id AND p.elem_id = v.parent_id
), m AS (SELECT *, coalesce(NOT skipped AND bullet IS NOT NULL AND y1 - y0 <= 30, false) AS mark, lag(role) OVER w AS before_role, lag(elem_id) OVER w AS before_id FROM e WHERE sought WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY kid_ord)
), n AS (SELECT *, sum(CASE WHEN mark IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, parent_id ORDER BY kid_ord) AS run FROM (SELECT *, lag(mark) OVER (PARTITION BY doc_id, parent_id ORDER BY kid_ord) AS was FROM m)
), bulleted AS (SELECT doc_id, parent_id, run, count(*) AS n, arg_min(elem_id, kid_ord) AS elem_id, arg_min(page, kid_ord) AS page, list(elem_id) AS own FROM n WHERE mark GROUP BY 1, 2, 3
), tall AS (SELECT doc_id, elem_id, pre FROM e WHERE NOT skipped AND sought AND y1 - y0 > 30
), kb AS (SELECT k.doc_id, k.owner_id, k.kid_ord, coalesce(k.page_num, s.page) AS page_num, coalesce(c.y0, s.y0) AS y0, coalesce(c.y1, s.y1) AS y1 FROM kid k JOIN tall t ON t.doc_id = k.doc_id AND t.elem_id = k.owner_id
  LEFT JOIN content c ON c.doc_id = k.doc_id AND c.page_num = k.page_num AND c.mcid = k.mcid AND k.kind = 'mcr' LEFT JOIN (SELECT v.doc_id, v.elem_id, v.page, t.y0, t.y1 FROM v JOIN txt t ON t.doc_id = v.doc_id AND t.elem_id = v.elem_id) s ON s.doc_id = k.doc_id AND s.elem_id = k.child_id WHERE coalesce(c.y0, s.y0) IS NOT NULL
), km AS (SELECT *, (SELECT arg_min(b.y, b.ord) FROM bullet b WHERE b.doc_id = kb.doc_id AND b.page_num = kb.page_num AND b.y >= kb.y0 - 3 AND b.y <= kb.y1 + 3) AS y FROM kb
), kg AS (SELECT *, sum(CASE WHEN pp = page_num AND abs(py - y) < 3 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, owner_id ORDER BY kid_ord) AS grp FROM (SELECT *, lag(y) OVER w AS py, lag(page_num) OVER w AS pp FROM km WINDOW w AS (PARTITION BY doc_id, owner_id ORDER BY kid_ord))
), aligned AS (SELECT doc_id, owner_id AS elem_id, grp, min(page_num) AS page, count(*) AS n FROM kg WHERE y IS NOT NULL GROUP BY 1, 2, 3
), claimed AS (SELECT doc_id, unnest(own) AS elem_id FROM bulleted UNION SELECT doc_id, elem_id FROM aligned
), lone AS (SELECT e.doc_id, e.parent_id AS elem_id, count(*) AS n, bool_and(e.role_raw = 'Link') AS links, count(DISTINCT l.uri) AS dests, count(l.uri) AS known FROM e LEFT JOIN links l ON l.doc_id = e.doc_id AND l.elem_id = e.elem_id WHERE e.parent_id IS NOT NULL GROUP BY 1, 2)
"""
put("MistaggedList", CANON + BULLETS + " UNION ALL ".join([
    issue("LIST_TAGGED_AS_PARAGRAPHS", "bulleted", fix="WrapParagraphRunInList", elem="elem_id", page="page", detail="n"),
    issue("BULLET_ALIGNED_KIDS_IN_ELEMENT", "aligned", fix="WrapBulletAlignedKidsInLBody", elem="elem_id", page="page", detail="n"),
    issue("PARAGRAPH_OF_LINKS", "lone JOIN v USING (doc_id, elem_id) WHERE n >= 2 AND links AND NOT (dests = 1 AND known = n) AND (doc_id, elem_id) NOT IN (SELECT (doc_id, elem_id) FROM claimed) AND NOT EXISTS (SELECT 1 FROM kid k WHERE k.doc_id = lone.doc_id AND k.owner_id = lone.elem_id AND k.kind <> 'elem')", "ERROR", "ParagraphOfLinks", elem="elem_id", page="page", detail="n"),
]))
put("IrregularToc", CANON + """, bad AS (SELECT DISTINCT v.doc_id, v.elem_id, v.page FROM v JOIN v c ON c.doc_id = v.doc_id AND c.parent_id = v.elem_id WHERE v.role = 'TOC' AND c.role NOT IN ('Caption', 'TOC', 'TOCI'))
""" + issue("IRREGULAR_TOC", "bad WHERE NOT EXISTS (SELECT 1 FROM anc a JOIN bad b ON b.doc_id = a.doc_id AND b.elem_id = a.anc_id WHERE a.doc_id = bad.doc_id AND a.elem_id = bad.elem_id AND a.dist > 0)", fix="IrregularToc", elem="elem_id", page="page"))
SPANS = f""", span AS (SELECT doc_id, pos, page_num, mcid, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS text, size AS base, tag IN ('p', 'h1') AND length(text) > {layout.LONG} AS larger FROM (SELECT *, string_split(text, '. ') AS parts FROM box)
), sized AS (SELECT *, base + CASE WHEN larger AND i = 1 THEN 2 ELSE 0 END AS size FROM span)"""
put("BadlyMarkedContent", CANON + SPANS + f""", change AS (SELECT doc_id, page_num, mcid, count(*) AS n FROM (SELECT *, lag(size) OVER (PARTITION BY doc_id, page_num, mcid ORDER BY i) AS was FROM sized) WHERE i > 1 AND 1.2 * base > {K.BASELINE_DROP} AND abs(size - was) > {K.SIZE_CHANGE} GROUP BY 1, 2, 3
), sole AS (SELECT v.doc_id, v.elem_id, v.page, min(k.page_num) AS page_num, min(k.mcid) AS mcid FROM v JOIN kid k ON k.doc_id = v.doc_id AND k.owner_id = v.elem_id WHERE role IN {K.HEADINGS} GROUP BY 1, 2, 3 HAVING count(*) = 1 AND min(kind) = 'mcr')
""" + issue("MIXED_FONT_MARKED_CONTENT", "sole JOIN change USING (doc_id, page_num, mcid)", fix="SplitMarkedContent", elem="elem_id", page="page", detail="n"))
FOLDED = """, f AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i FROM ranked
), state AS (SELECT {keys}, 0::BIGINT AS i, 0::BIGINT AS prev, false AS had, []::DOUBLE[] AS at, []::BIGINT[] AS gaps, NULL::BIGINT AS out FROM ranked GROUP BY ALL
  UNION ALL SELECT {qualified}, z.i, CASE WHEN z.deep THEN z.prev ELSE least(z.lvl, z.prev + 1) END, z.had OR z.lvl1 = 1, CASE WHEN z.lvl > z.prev + 1 AND NOT z.deep THEN list_append(z.at, z.size) ELSE z.at END,
    CASE WHEN z.lvl > z.prev + 1 AND NOT z.deep THEN list_append(z.gaps, z.lvl - z.prev - 1) ELSE z.gaps END, CASE WHEN NOT z.deep THEN least(z.lvl, z.prev + 1) END
  FROM (SELECT *, lvl > prev + 1 AND prev = 0 AS deep FROM (SELECT *, CASE WHEN lvl1 = 1 AND had THEN 2 ELSE lvl1 END AS lvl FROM (
    SELECT {fkeys}, f.i, f.size, s.prev, s.had, s.at, s.gaps, greatest(1, f.level - coalesce(list_sum(list_transform(range(1, len(s.at) + 1), lambda j: CASE WHEN f.size <= s.at[j] THEN s.gaps[j] ELSE 0 END)), 0))::BIGINT AS lvl1
    FROM state s JOIN f ON {on} AND f.i = s.i + 1))) z)
"""


def folded(keys: list[str], order: str) -> str:
    """SQL of the heading fold over ``ranked`` (keys, order, size, level): the state after each row, out being its level."""
    return FOLDED.format(keys=", ".join(keys), order=order, qualified=", ".join(f"z.{k}" for k in keys), fkeys=", ".join(f"f.{k}" for k in keys), on=" AND ".join(f"f.{k} IS NOT DISTINCT FROM s.{k}" for k in keys))


put("MistaggedHeading", CANON + SPANS + f""", q AS (SELECT doc_id, page_num, mcid, floor(size * 4 + 0.5) / 4 AS size, length(text) AS weight FROM sized
), own AS (SELECT DISTINCT a.doc_id, a.anc_id AS elem_id, k.page_num, k.mcid FROM anc a JOIN kid k ON k.doc_id = a.doc_id AND k.owner_id = a.elem_id AND k.kind = 'mcr'
), below AS (SELECT o.doc_id, o.elem_id, size, sum(weight) AS weight FROM own o JOIN q ON q.doc_id = o.doc_id AND q.page_num = o.page_num AND q.mcid = o.mcid GROUP BY 1, 2, 3
), hist AS (SELECT doc_id, -1 AS scope, size, sum(weight) AS weight FROM q GROUP BY 1, 3 UNION ALL SELECT b.doc_id, b.elem_id, size, weight FROM below b JOIN v ON v.doc_id = b.doc_id AND v.elem_id = b.elem_id WHERE v.role = 'Art'
), body AS (SELECT doc_id, scope, arg_max(size, struct_pack(a := weight, b := -size)) AS body FROM hist GROUP BY 1, 2
), levels AS (SELECT doc_id, scope, size, level FROM (SELECT h.doc_id, h.scope, size, dense_rank() OVER (PARTITION BY h.doc_id, h.scope ORDER BY size DESC) AS level FROM hist h JOIN body b ON b.doc_id = h.doc_id AND b.scope = h.scope WHERE size > body + 0.5) WHERE level <= 6
), inner_art AS (SELECT a.doc_id, a.elem_id, arg_min(a.anc_id, a.dist) AS scope FROM anc a JOIN v ON v.doc_id = a.doc_id AND v.elem_id = a.anc_id WHERE v.role = 'Art' GROUP BY 1, 2
), mine AS (SELECT doc_id, elem_id, arg_max(size, struct_pack(a := weight, b := -size)) AS size FROM below GROUP BY 1, 2
), ranked AS (SELECT v.doc_id, coalesce(s.scope, -1) AS scope, v.pre, v.elem_id, v.page, v.role, m.size, l.level FROM v JOIN mine m ON m.doc_id = v.doc_id AND m.elem_id = v.elem_id LEFT JOIN inner_art s ON s.doc_id = v.doc_id AND s.elem_id = v.elem_id
  JOIN levels l ON l.doc_id = v.doc_id AND l.scope = coalesce(s.scope, -1) AND l.size = m.size WHERE v.role IN {K.HEADINGS})
""" + folded(["doc_id", "scope"], "pre") + """, done AS (SELECT f.*, s.out FROM f JOIN state s ON s.doc_id = f.doc_id AND s.scope = f.scope AND s.i = f.i)
SELECT doc_id::BIGINT AS doc_id, CASE WHEN out IS NULL THEN 'IMPROPERLY_NESTED_HEADING' ELSE 'MISTAGGED_HEADING' END AS type, 'WARNING' AS severity, elem_id::INTEGER AS elem_id, page::INTEGER AS page, coalesce('H' || out, 'too deep to open') AS detail, CASE WHEN out IS NOT NULL THEN 'MistaggedHeading' END AS fix_kind FROM done WHERE out IS NULL OR role <> 'H' || out""")
put("EmptyElement", CANON + issue("EMPTY_ELEMENT", "v WHERE NOT EXISTS (SELECT 1 FROM kid k WHERE k.doc_id = v.doc_id AND k.owner_id = v.elem_id) GROUP BY doc_id", fix="EmptyElement", detail="count(*)"))
put("ScribbledInstruction", CANON + issue("SCRIBBLED_INSTRUCTION", "v WHERE starts_with(title, '__!') AND NOT EXISTS (SELECT 1 FROM anc a JOIN v h ON h.doc_id = a.doc_id AND h.elem_id = a.anc_id WHERE a.doc_id = v.doc_id AND a.elem_id = v.elem_id AND a.dist > 0 AND h.title = '__!ARTIFACT')", fix="ScribbledInstruction", elem="elem_id", page="page", detail="substr(title, 3)"))
put("StaleScribble", CANON + issue("STALE_SCRIBBLE", "v WHERE starts_with(title, '__')", fix="StaleScribble", elem="elem_id", page="page", detail="ltrim(substr(title, 3), ':')"))
_RULES = rules.default_rules()
_KNOWN = ", ".join(f"'{r}'" for r in sorted(_RULES))
_MAY = ", ".join(f"('{r}', '{c}')" for r, x in sorted(_RULES.items()) for c in x["allowed"])
put("SchemaValidation", CANON + f""", may(parent, child) AS (VALUES {_MAY}), kids AS (SELECT doc_id, parent_id AS elem_id, string_agg(role || ' ', '' ORDER BY kid_ord) AS roles FROM v WHERE parent_id IS NOT NULL GROUP BY 1, 2)
""" + " UNION ALL ".join([
    issue("TAG_UNKNOWN_ROLE", f"v LEFT JOIN kids USING (doc_id, elem_id) WHERE role NOT IN ({_KNOWN})", "ERROR", elem="elem_id", page="page", detail="coalesce(roles, '')"),
    issue("TAG_WRONG_CHILD_PATTERN", "v LEFT JOIN kids USING (doc_id, elem_id) WHERE role = 'LI' AND NOT regexp_full_match(coalesce(roles, ''), '(Lbl )?LBody ')", "ERROR", elem="elem_id", page="page", detail="coalesce(roles, '')"),
    issue("TAG_WRONG_CHILD", "(SELECT c.*, p.role AS up FROM v c JOIN v p ON p.doc_id = c.doc_id AND p.elem_id = c.parent_id) WHERE up IN (SELECT parent FROM may) AND (up, role) NOT IN (SELECT (parent, child) FROM may)", "ERROR", elem="elem_id", page="page", detail="role"),
]))
put("InconsistentParentTree", CANON + """, told AS (SELECT doc_id, here AS page_num, mcid, CASE WHEN tag = 'a' AND parent IS NOT NULL THEN parent ELSE pos END AS told FROM el WHERE run UNION ALL SELECT doc_id, here, 100 + mcid, pos FROM el WHERE run AND role = 'Figure')
""" + issue("INCONSISTENT_PARENT_TREE", "(SELECT v.doc_id, v.elem_id, v.page, count(*) AS n FROM v JOIN kid k ON k.doc_id = v.doc_id AND k.owner_id = v.elem_id AND k.kind = 'mcr' LEFT JOIN told t ON t.doc_id = k.doc_id AND t.page_num = k.page_num AND t.mcid = k.mcid WHERE told IS DISTINCT FROM v.elem_id GROUP BY 1, 2, 3)", fix="InconsistentParentTree", elem="elem_id", page="page", detail="n"))
put("InlineDestinations", CANON + issue("NAMED_DESTINATIONS_PRESENT", "el WHERE tag = 'h1' AND run GROUP BY doc_id", "INFO", "InlineDestinations", detail="count(*)"))
put("MisartifactedText", CANON + """, note AS (SELECT doc_id, (1 + k // 4) AS page, pos, trim(regexp_replace(substr(token, 5, length(token) - 7), '[A-Za-z]', '', 'g'), ' ') AS shown FROM leveled WHERE comment
), owner AS (SELECT k.doc_id, k.page_num, k.mcid, arg_max(v.elem_id, v.pre) AS owner FROM kid k JOIN v ON v.doc_id = k.doc_id AND v.elem_id = k.owner_id WHERE k.kind = 'mcr' GROUP BY 1, 2, 3
), near AS (SELECT n.doc_id, n.page, n.pos, o.owner, row_number() OVER (PARTITION BY n.doc_id, n.pos ORDER BY abs(e.pos - n.pos), e.pos > n.pos) AS r FROM note n JOIN el e ON e.doc_id = n.doc_id AND e.here = n.page AND e.run JOIN owner o ON o.doc_id = e.doc_id AND o.page_num = e.here AND o.mcid = e.mcid WHERE regexp_matches(shown, '^[0-9]+$'))
""" + issue("MISARTIFACTED_TEXT", "near WHERE r = 1", fix="MisartifactedText", elem="owner", page="page", detail="pos"))


def hosts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from docloom.sources.tables import empty

    return empty(spark) | {"url_page": layout.captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))}


CAPTURES = r"""WITH hosted AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), named AS (SELECT *, min(page_id) OVER (PARTITION BY host) AS doc_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM hosted)
"""
WANTED = ["/de/", "/fr/", "/en/", "/es/"]
put("ReorderWebCaptures", CAPTURES + ", pick AS (SELECT doc_id, i, arg_min(n, struct_pack(a := length(url), b := n)) AS n FROM named JOIN (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(WANTED)) + ") w(i, p) ON contains(url, p) GROUP BY 1, 2), placed AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS want FROM pick) "
    + issue("WEB_CAPTURES_BADLY_ORDERED", "(SELECT doc_id, count(*) FILTER (want <> n) AS moved FROM placed GROUP BY 1) WHERE moved > 0", "INFO", "ReorderWebCaptures", detail="moved"), hosts, {"urls": WANTED})
put("WrapWebCaptures", CAPTURES + issue("WEB_CAPTURES_NOT_GROUPED", "named GROUP BY doc_id", "INFO", "WrapWebCaptures", detail="count(*)"), hosts)


def fonts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Parts as fonts: a code by size, mapped to a ligature's sign or to a letter."""
    from docloom.sources.tables import empty

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    code = F.element_at(F.array(*map(F.lit, K.ARIAL_CODES)), (F.col("p_size") % 3 + 1).cast("int"))
    signs = F.element_at(F.array(*[F.lit(chr(0xFB00 + i)) for i in range(10)]), (F.col("p_size") % 10 + 1).cast("int"))
    rows = p.select((F.col("p_partkey") % 50).alias("doc_id"), F.col("p_partkey").cast("int").alias("font_id"), F.col("p_size").cast("int").alias("first_page"), F.when(F.col("p_size") % 2 == 0, "ArialMT").otherwise(F.col("p_brand")).alias("base_font"), code.alias("code"), F.when(F.col("p_size") % 4 == 0, "f").otherwise(signs).alias("mapped"))
    return empty(spark) | {"font_map": rows}


_AT = "[" + ", ".join(map(str, K.ARIAL_CODES)) + "]"
_ARIAL = " ".join(f"WHEN {c} THEN '{t}'" for c, t in K.ARIAL_CODES.items())
put("BadlyMappedLigature", f"""WITH fonts AS (SELECT p_partkey % 50 AS doc_id, p_partkey AS font_id, p_size AS page, p_size % 2 = 0 OR contains(lower(p_brand), 'arial') AS arial, {_AT}[p_size % 3 + 1] AS code, CASE WHEN p_size % 4 = 0 THEN 'f' ELSE chr((64256 + p_size % 10)::INT) END AS mapped FROM part
), bad AS (SELECT * FROM fonts WHERE unicode(mapped) BETWEEN 64256 AND 64262 OR arial AND left(CASE code {_ARIAL} END, 1) = mapped)
""" + issue("LIGATURE_MAPPING_BROKEN", "bad GROUP BY doc_id, font_id", fix="BadlyMappedLigature", page="min(page)", detail="count(*)"), fonts)
