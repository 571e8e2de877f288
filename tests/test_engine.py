import shutil

import pytest
from build import tables
from pyspark.sql import functions as F

from docloom.functions import exprs
from docloom.operators import patterns, repair, runs
from docloom.operators.hierarchy import closure, display_path, numbered
from docloom.plans import pipeline, report


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given))
    return row.select(column.alias("v")).first().v


def elem(spark, tree):
    e = tables(spark, tree)["elem"]
    return e.withColumn("role", F.col("role_raw"))


def shape(e):
    n = numbered(e.withColumn("role", F.col("role_raw")), hide_verified=False)
    return [r.tree for r in report.role_brackets(n).orderBy("doc_id").collect()]


@pytest.mark.parametrize(("text", "want"), [("Hello", "Hello"), ("0123456789", "0123456789"), ("Supercalifragilisticexpialidocious", "Supercali…+25"), ("Hello      world", "Hello…+11"), ("01234567890", "012345678…+2"), (None, None)])
def test_truncate(spark, text, want):
    assert value(spark, exprs.truncate(F.col("t"), 10), t=text) == want


GOOD = ["https://example.com", "http://example.com", "HTTPS://example.com", "https://example.com/path?q=1&r=2", "https://example.com:8080/path", "https://sub.example.co.uk"]
BAD = [None, "", "  ", "example.com", "ftp://example.com", "mailto:user@example.com", "file:///etc/hosts", "https://", "https://localhost", "https://example", "https://practice.10", "https://foo.1", "https://example.c", "https://foo.c0m", "https://exa mple.com", "http://[not a uri"]


def test_uris(spark):
    rows = spark.createDataFrame([(u,) for u in GOOD + BAD], "u string").select("u", exprs.valid_web_uri(F.col("u")).alias("ok")).collect()
    assert {r.u for r in rows if r.ok} == set(GOOD)


def test_notes(spark):
    assert value(spark, exprs.is_verified(F.col("t")), t="__check spacing // OK") is True
    for t in ("__OK reviewed 2026-07-09", "__OKAY but check figures", "__:OK", "OK"):
        assert value(spark, exprs.is_verified(F.col("t")), t=t) is False
    assert value(spark, exprs.clear_notes(F.col("t"), "INST"), t="__:INST OK // keep") == "__:keep"
    assert value(spark, exprs.clear_notes(F.col("t"), "INST"), t="__INST OK") is None
    assert value(spark, exprs.add_note(F.col("t"), F.lit("x")), t="plain") == "__:x"
    assert value(spark, exprs.word_wrap(F.col("t"), 10), t="one two three four") == "one two\nthree four"
    assert value(spark, exprs.clean_text(F.col("t")), t="a b c d word") == "abcdword"


def test_brackets_and_patterns(spark):
    for t in ("A[]", "A[B[],C[D[]]]"):
        assert str(patterns.parse_tree(t)) == t
    for bad in ("A[", "A]", "[B]", "A[],B[]"):
        with pytest.raises(ValueError):
            patterns.parse_tree(bad)
    rx = patterns.child_regex("Lbl? LBody")
    got = spark.createDataFrame([("LBody ",), ("Lbl LBody ",), ("LBody Lbl ",), ("",)], "r string").select(F.col("r").rlike(rx).alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, False, False]
    assert value(spark, F.col("r").rlike(patterns.child_regex("A* A")), r="A A ") is False
    with pytest.raises(ValueError):
        patterns.child_regex("(A?)*")


def test_outline_and_instructions():
    rows, errors = patterns.parse_outline("Root  @1\n  Child  @2\n    Grandchild  @3\n  SecondChild  @4\n")
    assert not errors and [r["parent"] for r in rows] == [None, 0, 1, 0]
    assert patterns.parse_outline("Twitter @42 status  @5")[0][0]["page"] == 5
    for bad in ("\tX  @1", "   X  @1", "A  @1\n    B  @2", "X  @?", "no page", "X  @0"):
        assert len(patterns.parse_outline(bad)[1]) == 1
    assert patterns.parent_chain("Reference[Link[P[]]]") == ["Reference", "Link", "P"]
    with pytest.raises(ValueError):
        patterns.parent_chain("Note[P[], Span[]]")
    assert patterns.child_ranges("Lbl[1], LBody[2..]", 3) == [("Lbl", 1, 1), ("LBody", 2, 3)]
    for bad in ("Lbl[1], LBody[3]", "Lbl[2], LBody[1]", "Lbl[1]"):
        with pytest.raises(ValueError):
            patterns.child_ranges(bad, 3)
    assert patterns.parse_instruction("!SET_ROLE H2").argument == "H2"
    with pytest.raises(ValueError):
        patterns.parse_instruction("!NOTHING")
    notes, warnings = patterns.parse_diagram('P #3 "a"\n  Span #4\nP #3 "b"')
    assert notes == {("P", 3): "b", ("Span", 4): None} and len(warnings) == 1


def test_hierarchy_against_recursion(spark):
    tree = "Document[Sect[P,L[LI[LBody],LI]],P,Art[H1,P[Span]]]"
    n = numbered(elem(spark, tree)).persist()
    want, order = {}, []

    def walk(node, above):
        own = len(order) + 1
        order.append(node.role)
        want[own] = (node.role, above)
        for k in node.kids:
            walk(k, [*above, own])
        want[own] = (*want[own], len(order))

    walk(patterns.parse_tree(tree), [])
    rows = {r.pre: r for r in n.collect()}
    assert {p: (r.role, r["last"]) for p, r in rows.items()} == {p: (w[0], w[2]) for p, w in want.items()}
    pairs = {(r.elem_id, r.anc_id) for r in closure(n).where("dist > 0").collect()}
    assert pairs == {(p, a) for p, w in want.items() for a in w[1]}
    assert display_path(n).where("elem_id = 3").first().shown == "/Document[1].Sect[2].P[3]"
    assert shape(elem(spark, tree)) == [str(patterns.parse_tree(tree))]


def test_verified_subtrees_are_hidden(spark):
    assert [r.role for r in numbered(elem(spark, "Document[Art=~OK[P],P]")).orderBy("pre").collect()] == ["Document", "P"]


def test_folds():
    assert runs.anchored([0, 2, 3, 5, 9], 2) == [1, 1, 2, 2, 3]
    assert runs.accepted([(0.0, 0.0), (0.5, 0.5), (1.4, 0.0)], 1) == [True, False, True]
    assert runs.ladder([0, 1, 20, 40, 21, 0, 33]) == [0, 0, 1, 2, 1, 0, 0]


def test_nearest_backward_wins_ties(spark):
    left = spark.createDataFrame([(1, 10, 5), (1, 11, 9), (1, 12, 0), (2, 13, 5)], "k int, id int, at int")
    right = spark.createDataFrame([(1, 1, 4), (1, 2, 6), (1, 3, 20)], "k int, id int, at int")
    assert {r.id: r.near_id for r in runs.nearest(left, right, ["k"], "at").collect()} == {10: 1, 11: 2, 12: 1}


def test_repairs_and_idempotence(spark):
    t = tables(spark, "Sect[P,P]", content=[(1, 2, 1, 5, "a", ["TEXT"], (0, 0, 1, 1)), (1, 3, 1, 2, "b", ["TEXT"], (0, 0, 1, 1))])
    e = repair.missing_document(t["elem"], spark.createDataFrame([(1,)], "doc_id long"))
    assert shape(e) == ["Document[Sect[P[],P[]]]"]
    at = t["kid"].where("kind = 'mcr_num'").selectExpr("doc_id", "owner_id as elem_id", "page_num", "mcid")
    hit = spark.createDataFrame([(1, 1)], "doc_id long, elem_id int")
    once = repair.reading_order(t["elem"], at, hit)
    assert [r.elem_id for r in once.where("parent_id = 1").orderBy("kid_ord").collect()] == [3, 2]
    again = repair.reading_order(once, at, hit)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    nested = repair.needless_nesting(tables(spark, "Document[P,Sect[Div[P,H1],P],P]")["elem"], ("Part", "Sect", "Art", "Div"))
    assert shape(nested) == ["Document[P[],P[],H1[],P[],P[]]"]
    pruned = repair.empty_elements(tables(spark, "Document[P,Sect[Div[Span]]]")["elem"], spark.createDataFrame([(1, 2)], "doc_id long, elem_id int"))
    assert shape(pruned) == ["Document[P[]]"]
    told = repair.note_headings(t["elem"], spark.createDataFrame([(1, 2, "H1")], "doc_id long, elem_id int, detail string"))
    done = repair.execute_set_role(told)
    assert shape(done) == ["Sect[H1[],P[]]"] and done.where("elem_id = 2").first().title == "__:INST OK (was: P)"
    assert repair.clear_notes(done).where("title is not null").count() == 0
    doc = repair.fix_documents(spark.createDataFrame([(1, None, None, None, 1)], "doc_id long, lang string, tab_order_p1 string, marked boolean, ua_part int")).first()
    assert tuple(doc) == (1, "en-US", "S", True, None)


def test_selection_and_prerequisites():
    assert pipeline.select_checks(["A", "B"], ["C"], include={"C"}, skip={"A"}, replace={"C": "D"}) == ["B", "D"]
    assert pipeline.select_checks(["A", "B"], ["C"], only={"C", "A", "X"}) == ["A", "C"]
    with pytest.raises(ValueError):
        pipeline.resolve_ordered(["Z"], {"A"})
    with pytest.raises(ValueError):
        pipeline.validate_prereqs(["MissingPageParts", "NeedlessNesting"], {"MissingPageParts": {"NeedlessNesting"}})


def test_stream_equals_batch(spark, tmp_path):
    from docloom.sources import html
    from docloom.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    shutil.copy("/root/testdata/sf0.001/pages.parquet", src / "a.parquet")
    q = ingest.start(ingest.pages(spark, str(src)), html.tree, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == html.tree(spark.read.parquet(str(src / "a.parquet"))).count()


def test_entities_as_in_sql():
    from docloom.sources.layout import run_text

    # A cut entity and those the SQL doesn't know stay as they are.
    assert run_text("the&amp;&amp;&amp") == "the&&&amp"
    assert run_text("a &lt;b&gt; &eacute; &nbsp; &#65; &#x27;&quot; &copy") == "a <b> &eacute; &nbsp; &#65; '\" &copy"
    assert run_text("&amp;lt; &amp;amp; &copy;&middot;") == "&lt; &amp; ©·"
