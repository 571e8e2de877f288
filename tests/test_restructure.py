from build import tables
from pyspark.sql import functions as F

from docloom.operators import restructure as R


BOX = (0, 0, 1, 1)


def shape(e):
    """Each document's tree as brackets, put together here: one job."""
    below, heads = {}, {}
    for r in e.select("doc_id", "elem_id", "parent_id", "kid_ord", "role_raw").collect():
        (below.setdefault((r.doc_id, r.parent_id), []) if r.parent_id else heads.setdefault(r.doc_id, [])).append((r.kid_ord, r.elem_id, r.role_raw))

    def text(doc, members):
        return ",".join(role + (f"[{text(doc, below[doc, i])}]" if (doc, i) in below else "") for _, i, role in sorted(members))

    return [text(d, heads[d]) for d in sorted(heads)]


def told(e, **titles):
    known = F.create_map(*[F.lit(x) for k, v in titles.items() for x in (int(k[1:]), v)])
    return e.withColumn("title", F.coalesce(F.try_element_at(known, F.col("elem_id")), F.col("title")))


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def kids(kid, owner):
    return [(r.kind, r.mcid or r.annot_id or r.child_id) for r in kid.where(f"owner_id = {owner}").orderBy("kid_ord").collect()]


def test_lists(spark):
    run = "doc_id long, elem_id int, run int"
    e = tables(spark, "Document[H1,P,P,H2,P]", "Document[P]")["elem"]
    assert shape(R.paragraphs_to_list(e, rows(spark, run, (1, 3, 1), (1, 4, 1), (1, 6, 2)))) == ["Document[H1,L[LI[LBody[P]],LI[LBody[P]]],H2,L[LI[LBody[P]]]]", "Document[P]"]
    assert shape(R.paragraphs_to_list(e, rows(spark, run))) == shape(e)
    e = tables(spark, "Document[P[Link,Link[Span]],P[Link]]")["elem"]
    assert shape(R.links_to_list(e, rows(spark, "doc_id long, elem_id int", (1, 2)))) == ["Document[L[LI[LBody[Link]],LI[LBody[Link[Span]]]],P[Link]]"]
    t = tables(spark, "Document[L[LI],L[LI,LI[LBody]],L[LI],P,L[LI]]", "Document[L[LI],L[LI]]", content=[(2, 4, 1, 1, "x", ["TEXT"], BOX)])
    assert shape(R.merge_adjacent_lists(t["elem"], t["kid"])) == ["Document[L[LI,LI,LI[LBody],LI],P,L[LI]]", "Document[L[LI],L[LI]]"]
    t = tables(spark, "Document[L[LI],P,Span,H1]")
    seen = rows(spark, "doc_id long, elem_id int, run int, page_num int, y double", (1, 5, 1, 1, 50.0), (1, 6, 1, 1, 90.0))
    assert shape(R.bullets_to_list(t["elem"], t["kid"], seen.where("elem_id = 5"))) == ["Document[L[LI],P,L[LI[LBody[Span]]],H1]"]
    assert shape(R.bullets_to_list(t["elem"], t["kid"], seen)) == ["Document[L[LI],P,L[LI[LBody[H1]],LI[LBody[Span]]]]"]
    t = tables(spark, "Document[L[LI],P]")
    assert shape(R.bullets_to_list(t["elem"], t["kid"], rows(spark, seen.schema, (1, 4, 1, 1, 5.0)))) == ["Document[L[LI,LI[LBody[P]]]]"]


def test_tables_of_contents(spark):
    e = tables(spark, "Document[TOC[P[Link],P[Link,Link],Div[Link],Link,Link],P]")["elem"]
    at = "doc_id long, toc_id int, elem_id int, pre int, page_num int, x0 double, y0 double, x1 double, y1 double"
    links = [r.elem_id for r in e.where("role_raw = 'Link'").orderBy("elem_id").collect()]
    boxes = [(0, 90), (20, 70), (90, 70), (40, 50), (20, 30), (0, 10)]
    leaves = rows(spark, at, *[(1, 2, i, i, 1, float(x), float(y), x + 50.0, y + 10.0) for i, (x, y) in zip(links, boxes, strict=True)])
    assert shape(R.rebuild_toc(e, leaves)) == ["Document[TOC[TOCI[P[Link]],TOC[TOCI[P[Link,Link]],TOC[TOCI[P[Link]]],TOCI[P[Link]]],TOCI[P[Link]]],P]"]
    assert shape(R.rebuild_toc(e, leaves.limit(0))) == shape(e)


def test_parts_and_captures(spark):
    t = tables(spark, "Document[P,H1,P,Span]", "Document[P]")
    doc = rows(spark, "doc_id long, n_pages int", (1, 3), (2, 1))
    pages = rows(spark, "doc_id long, elem_id int, page int", (1, 2, 1), (1, 3, 2), (1, 4, 1), (1, 5, 0), (2, 2, 1))
    out = R.page_parts(t["elem"], doc, pages)
    assert shape(out) == ["Document[Span,Part[P,P],Part[H1],Part]", "Document[P]"]
    assert [(r.pg, r.title) for r in out.where("role_raw = 'Part'").orderBy("kid_ord").collect()] == [(1, "p. 1"), (2, "p. 2"), (3, "p. 3")]
    assert shape(R.page_parts(out, doc, pages)) == shape(out)
    urls = rows(spark, "doc_id long, url_ord int, url string, page_ord int, page_num int", (1, 1, "http://a.org/x", 1, 1), (1, 2, "http://b.org", 1, 3), (1, 2, "http://b.org", 2, 1), (1, 3, "http://b.org/long", 1, 2))
    order = R.capture_order(doc, urls, ["b.org", "none"])
    assert {(r.doc_id, r.page_num): r.to for r in order.collect()} == {(1, 3): 1, (1, 1): 2, (1, 2): 3, (2, 1): 1}
    assert {(r.elem_id, r.page) for r in R.reorder_pages(pages, order, "page").where("doc_id = 1").collect()} == {(2, 2), (3, 3), (4, 2), (5, 0)}
    assert shape(R.wrap_captures(t["elem"], urls, pages)) == ["Document[Art[P,P],Art[H1],Span]", "Document[P]"]


def test_content_and_annotations(spark):
    mark = "doc_id long, elem_id int, page_num int, mcid int"
    t = tables(spark, "Document[Sect[P[Span]],P]", content=[(1, 4, 1, 1, "a", ["TEXT"], BOX), (1, 5, 1, 2, "b", ["TEXT"], BOX)])
    e, k = R.drop_orphaned(t["elem"], t["kid"], rows(spark, mark, (1, 4, 1, 1)))
    assert shape(e) == ["Document[P]"] and kids(k, 4) == []
    objr = (1, 3, 1, "objr", None, None, 1, 9)
    ann = [(1, 1, 9, "Link", None, None, 1, None, None, None, None, None, None, None, 8), (1, 1, 8, "Widget", None, None, None, None, None, None, None, None, None, None, None)]
    t = tables(spark, "Document[P[Link],P]", content=[(1, 4, 1, 2, "b", ["TEXT"], BOX)], kid=[objr], annot=ann)
    e, k, a = R.drop_widgets(t["elem"], t["kid"], t["annot"], rows(spark, "doc_id long, annot_id int", (1, 9)))
    assert shape(e) == ["Document[P]"] and a.count() == 0 and kids(k, 3) == []
    assert shape(R.to_artifact(t["elem"], t["kid"], t["annot"], rows(spark, "doc_id long, elem_id int", (1, 4)))[0]) == ["Document[P[Link]]"]
    e, k, a, marks = R.artifacts(told(t["elem"], _2="__!ARTIFACT", _4="__!ARTIFACT"), t["kid"], t["annot"])
    assert shape(e) == ["Document"] and [r.annot_id for r in a.collect()] == [8] and [tuple(r) for r in marks.collect()] == [(1, 1, 2)]
    e, k = R.mark_links(t["elem"], t["kid"], rows(spark, "doc_id long, page_num int, annot_id int, parent_id int", (1, 1, 8, 4), (1, 1, 7, None)))
    assert shape(e) == ["Document[P[Link],P[Link],Link]"] and kids(k, 5) == [("objr", 7)] and kids(k, 6) == [("objr", 8)]
    t = tables(spark, "Document[P[Span,Link]]", kid=[(1, 4, 1, "objr", None, None, 1, 9), (1, 2, 0, "mcr_num", None, 5, 1, None)])
    hit = rows(spark, "doc_id long, elem_id int, mcid int", (1, 4, 5))
    assert kids(R.fill_empty_links(t["kid"], hit), 4) == [("objr", 9)]
    near = t["kid"].withColumn("kid_ord", F.when(F.col("mcid") == 5, 2).when(F.col("child_id") == 4, 3).otherwise(F.col("kid_ord")))
    full = R.fill_empty_links(near, hit)
    assert kids(full, 4) == [("mcr_num", 5), ("objr", 9)] and kids(full, 2) == [("elem", 3), ("elem", 4)]
    assert kids(R.fill_empty_links(full, hit), 4) == kids(full, 4)
    word = rows(spark, "doc_id long, elem_id int, text string", (1, 3, "lost"), (1, 3, "lost"))
    once = R.signposts(t["elem"], word)
    assert shape(once) == ["Document[P[Lbl,Span,Link]]"] and once.where("role_raw = 'Lbl'").first().title == "__:misartifacted lost"
    assert shape(R.signposts(once, word)) == shape(once)


def test_parents_and_children(spark):
    e = tables(spark, "Document[P,P[Span,Link,Span],H1]")["elem"]
    out = R.add_parents(told(e, _2="__!ADD_PARENT Sect[Div]", _7="__!ADD_PARENTS Note[P[], Span[]]"))
    assert shape(out) == ["Document[Sect[Div[P]],P[Span,Link,Span],H1]"]
    assert [r.elem_id for r in R.refused(out).collect()] == [7]
    out = R.add_children(told(e, _3="__!ADD_CHILDREN Lbl[1], LBody[2..]", _2="__!ADD_CHILD Span, Note", _7="__!ADD_CHILD Lbl[1]"))
    assert shape(out) == ["Document[P[Span,Note],P[Lbl[Span],LBody[Link,Span]],H1]"]
    assert [r.elem_id for r in R.refused(out).collect()] == [7]


def test_reordering(spark):
    e = tables(spark, "Document[P,P[Span,Link,Span],H1]")["elem"]
    out = R.reorder_kids(told(e, _3="__!REORDER_KIDS", _5="__!REORDER 1", _6="__!REORDER 0"))
    assert [(r.elem_id, r.title) for r in out.where("parent_id = 3").orderBy("kid_ord").collect()] == [(6, "__:MOVE 3 -> 1"), (5, None), (4, None)]
    assert R.refused(out).count() == 0


def test_unlinking(spark):
    t = tables(spark, "Document[P[Span,Link[Span],Span],Link]", kid=[(1, 4, 2, "mcr_num", None, 7, 1, None), (1, 4, 3, "objr", None, None, 1, 9)], annot=[(1, 1, 9, "Link", *[None] * 11)])
    out, k, a = R.unlink(told(t["elem"], _4="__!UNLINK", _3="__!UNLINK"), t["kid"], t["annot"])
    assert shape(out) == ["Document[P[Span,Span,Span],Link]"] and a.count() == 0
    assert kids(k, 2) == [("elem", 3), ("elem", 5), ("mcr_num", 7), ("elem", 6)]
    assert [r.elem_id for r in R.refused(out).collect()] == [3]


def test_unwrapping(spark):
    t = tables(spark, "Document[L[LI[LBody[P]],LI[LBody[H1,P]]],L[LI[Lbl,LBody[P]]],L[LI[LBody]]]", content=[(1, 15, 1, 1, "x", ["TEXT"], BOX)])
    lists = [r.elem_id for r in t["elem"].where("role_raw = 'L'").orderBy("elem_id").collect()]
    out = R.unwrap_lists(told(t["elem"], **{f"_{i}": "__!UNWRAP_LIST" for i in lists}), t["kid"])
    assert shape(out) == ["Document[P,H1,P,L[LI[Lbl,LBody[P]]],L[LI[LBody]]]"]
    assert sorted(r.elem_id for r in R.refused(out).collect()) == lists[1:]
