"""Repairs in sequence, splitting, diagrams, configuration, reports."""

import pytest
from build import tables
from pyspark.sql import functions as F

from docloom.operators import diagram, splitting
from docloom.operators.checks import Context, run_checks
from docloom.plans import config, listener, pipeline, remediate, report

BOX = (0, 0, 100, 20)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_repairs_follow_each_other(spark):
    t = tables(spark, "Sect[P,Figure,P]", "Document[P]", content=[(1, 2, 1, 2, "b", ["TEXT"], BOX), (1, 3, 1, 1, "words", ["TEXT"], BOX), (1, 4, 1, 3, "c", ["TEXT"], BOX), (2, 2, 1, 1, "x", ["TEXT"], BOX)])
    t["elem"] = t["elem"].withColumn("title", F.when((F.col("doc_id") == 1) & (F.col("elem_id") == 4), "__!SET_ROLE H2"))
    names = ["MissingDocument", "StructTreeOrder", "FigureWithText", "ScribbledInstruction", "StaleScribble"]
    done = remediate.remediate(spark, t, names)
    assert rows(done.issues, "doc_id", "check", "status") == [(1, n, "resolved") for n in sorted(names)]
    assert run_checks(Context(spark, done.tables), names).count() == 0
    ctx = Context(spark, done.tables)
    assert rows(report.role_brackets(ctx.numbers).where("doc_id = 1"), "tree") == [("Document[Sect[P[],P[],H2[]]]",)]
    # Content is where it was, and slots agree with the tree.
    assert rows(done.tables["kid"].where("kind = 'mcr_num' and doc_id = 1"), "owner_id", "mcid") == [(2, 2), (3, 1), (4, 3)]
    slots = rows(done.tables["kid"].where("kind = 'elem'"), "doc_id", "owner_id", "child_id", "kid_ord")
    assert slots == rows(done.tables["elem"].where("parent_id is not null"), "doc_id", "parent_id", "elem_id", "kid_ord")
    again = remediate.remediate(spark, done.tables, names)
    assert again.issues.count() == 0 and report.keep_result(done.issues, False) and not report.keep_result(again.issues, False) and report.keep_result(again.issues, True)
    lines = [r.line for r in report.documents(done.issues, t["doc"], "2026-01-01").where("doc_id = 1").orderBy("at").collect()]
    assert lines[:4] == ["Accessibility report", "====================", "Input:    p", "Date:     2026-01-01"]
    assert "Issues detected:  5" in lines and "[RESOLVED] 1 Figure elements containing text" in lines and any(x.startswith("  -> FigureWithText: words (#3, p. 1)") for x in lines)
    assert [r.line for r in report.documents(done.issues, t["doc"], "2026-01-01").where("doc_id = 2").orderBy("at").collect()][-1] == "No accessibility issues were detected."
    said = []
    listener.tell(done.issues, names, listener.Console(said.append, listener.Verbosity.VERBOSE), listener.Verbosity.VERBOSE)
    assert said[0].startswith("┌─ MissingDocument (1/5)") and said[-1] == "5 issues, 5 resolved, 0 remaining" and any("✓ 1 by FigureWithText" in x for x in said)
    done.release()


def test_fatal_documents_are_left_alone_and_refusals_fail(spark):
    doc = [(1, "a", 1, False, False, True, None, False, None, None, False, False), (2, "b", 1, True, True, False, None, True, None, "S", False, False)]
    t = tables(spark, "", "Document[P=~!NOTHING,P=~!SPLIT_LINES_9]", doc=doc)
    done = remediate.remediate(spark, t, ["ImageOnlyDocument", "LanguageSet", "ScribbledInstruction"])
    assert rows(done.issues, "doc_id", "type", "status") == [(1, "IMAGE_ONLY_DOCUMENT", "open"), (2, "LANGUAGE_NOT_SET", "resolved"), (2, "SCRIBBLED_INSTRUCTION", "failed"), (2, "SCRIBBLED_INSTRUCTION", "failed")]
    assert rows(done.tables["doc"], "doc_id", "lang") == [(1, None), (2, "en-US")]


def test_what_an_earlier_fix_makes_needless(spark):
    t = tables(spark, "Document[L[LI[Link],LI],L]")
    ctx = Context(spark, t)
    issue = "doc_id long, check_ord int, seq int, elem_id int, page int, detail string, type string, fix_kind string, fix_priority int"
    given = [(1, 0, 1, 2, 0, "element", "A", "MistaggedArtifact", 0), (1, 0, 2, 4, 0, "element", "A", "MistaggedArtifact", 0), (1, 0, 3, 2, 0, "5", "A", "MistaggedArtifact", 0), (1, 0, 4, 6, 0, "7", "A", "MistaggedArtifact", 0), (1, 0, 5, 6, 0, "8", "A", "MistaggedArtifact", 0), (1, 1, 1, 4, 0, "element", "A", "MistaggedArtifact", 0), (1, 1, 2, 4, 0, "", "B", None, 0)]
    got = pipeline.resolve(spark.createDataFrame(given, issue), ctx.closure)
    assert rows(got, "check_ord", "seq", "status") == [(0, 1, "resolved"), (0, 2, "superseded"), (0, 3, "superseded"), (0, 4, "resolved"), (0, 5, "resolved"), (1, 1, "resolved"), (1, 2, "open")]


OPS = [
    # A smaller font of the same effective size on the next line.
    (1, [("Tm", ["12", "0", "0", "12", "50", "700"]), ("Tf", ["/F1", "1"]), ("Tj", ["a"]), ("Td", ["0", "-1.5"]), ("Tf", ["/F2", "1"]), ("Tj", ["b"])]),
    # Bold within a line.
    (2, [("Tf", ["/F1", "12"]), ("Tm", ["1", "0", "0", "1", "50", "700"]), ("Tj", ["a"]), ("Td", ["30", "0"]), ("Tj", ["b"]), ("Tm", ["1", "0", "0", "1", "50", "690"]), ("Td", ["60", "10"]), ("Tj", ["c"])]),
    # Three lines, the last larger.
    (3, [("Tf", ["/F1", "10"]), ("TL", ["12"]), ("Tm", ["1", "0", "0", "1", "50", "700"]), ("Tj", ["a"]), ("'", ["b"]), ("Tf", ["/F1", "14"]), ("T*", []), ("TJ", ["c"])]),
]


def test_lines_of_operators(spark):
    ops = [(1, 1, m, i, op, x) for m, block in OPS for i, (op, x) in enumerate(block)]
    got = splitting.lines(splitting.shown(spark.createDataFrame(ops, splitting.OPERATORS)))
    assert rows(got, "mcid", "line", "changes", "text") == [(1, 1, False, "a"), (1, 2, False, "b"), (2, 1, False, "a"), (2, 1, False, "b"), (2, 1, False, "c"), (3, 1, False, "a"), (3, 2, False, "b"), (3, 3, True, "c")]


def test_blocks_are_split(spark):
    op = [(1, 1, 7, i, "show", 0.0 if i == 1 else -14.0, s, x) for i, (s, x) in enumerate([(12.0, "a"), (12.0, "b"), (18.0, "c"), (12.0, "d")], 1)]
    t = tables(spark, "Document[P,H1]", content=[(1, 2, 1, 7, "a b c d", ["TEXT"], (0, 0, 10, 40)), (1, 3, 1, 8, "x", ["TEXT"], BOX)], op=op)
    done = remediate.remediate(spark, t, ["BadlyMarkedContent"])
    assert rows(done.tables["content"], "mcid", "text", "y0", "y1") == [(10, "d", 0.0, 10.0), (7, "a b", 20.0, 40.0), (8, "x", 0.0, 20.0), (9, "c", 10.0, 20.0)]
    assert rows(report.role_brackets(Context(spark, done.tables).numbers), "tree") == [("Document[P[],P[],P[],H1[]]",)]
    assert rows(done.tables["elem"].where("title is not null"), "elem_id", "title") == [(2, "__:SPLIT"), (4, "__:SPLIT"), (5, "__:SPLIT")]
    told = dict(t) | {"elem": t["elem"].withColumn("title", F.when(F.col("elem_id") == 2, "__!SPLIT_LINES 1,2,1"))}
    done = remediate.remediate(spark, told, ["ScribbledInstruction"])
    assert rows(report.role_brackets(Context(spark, done.tables).numbers), "tree") == [("Document[L[LI[LBody[P[]]],LI[LBody[P[]]],LI[LBody[P[]]]],H1[]]",)]
    assert rows(done.tables["content"], "mcid", "text") == [(10, "d"), (7, "a"), (8, "x"), (9, "b c")]
    assert [r.title for r in done.tables["elem"].where("role_raw = 'L'").collect()] == ["__:3 items"]


def test_diagrams_round_trip(spark):
    t = tables(spark, "Document[Sect[P=~note,H1],P]", content=[(1, 3, 1, 1, "some words", ["TEXT"], BOX), (1, 4, 2, 1, "a heading that is rather long, in full", ["TEXT"], BOX)])
    ctx = Context(spark, t)
    plain = [r.line for r in diagram.dump(ctx).orderBy("at", "sub").collect()]
    assert plain == ["Document #1", "  Sect #2", '    P #3 "__note"', "--- page 1 ---", "      [text &1] `some words`", "    H1 #4", "--- page 2 ---", "      [text &1] `a heading that is rather long, in full`", "  P #5"]
    boxed = [r.line for r in diagram.dump(ctx, box=True).orderBy("at", "sub").collect()]
    assert boxed[:3] == ["Document #1", "├─ Sect #2", '│  ├─ P #3 "__note"'] and boxed[-1] == "└─ P #5"
    lines = lambda text: spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "doc_id long, line_no int, line string")
    same, n = diagram.annotate(t["elem"], ctx.numbers, lines(boxed))
    assert rows(n, "status", "n") == [("unchanged", 5)] and rows(same, "elem_id", "title") == rows(t["elem"], "elem_id", "title")
    edited, n = diagram.annotate(t["elem"], ctx.numbers, lines(["P #3", 'H1 #4 "__!SET_ROLE H2"', "Span #5", "P #77", '<link #5> "x"', "Document #1"]))
    assert rows(n, "status", "n") == [("cleared", 1), ("unchanged", 1), ("unmatched element", 2), ("unmatched line", 2), ("updated", 1)]
    assert rows(edited.where("title is not null"), "elem_id", "title") == [(4, "__!SET_ROLE H2")]


def test_outlines_are_replaced(spark):
    found, errors = diagram.outline_from("Root  @1\n  Child  @9\n    Below  @1\n  Other  @2\n")
    assert not errors
    new = spark.createDataFrame([(1, *r) for r in found], "doc_id long, node_id int, parent_id int, ord int, title string, page int")
    old = spark.createDataFrame([(1, 7, None, 1, "old", 1), (2, 8, None, 1, "kept", 1)], new.schema)
    doc = spark.createDataFrame([(1, 2), (2, 2)], "doc_id long, n_pages int")
    assert rows(diagram.replace_outline(old, doc, new), "doc_id", "title") == [(1, "Other"), (1, "Root"), (2, "kept")]


def test_configuration(tmp_path):
    assert config.parse("checks: [SchemaValidationCheck, EmptyElementCheck]").checks == ["SchemaValidation", "EmptyElement"]
    assert config.parse("checks: []").checks == [] and config.parse("checks:").checks == [] and config.parse("").checks is None
    got = config.parse("ReorderWebCapturesCheck: [b, a]\nrole-map: {A: B}\nother: 1\nReplaceRoleMapCheck: {Foo: P}\nStaleScribbleCheck: {scope: TOOL_AUTHORED}")
    assert config.options(got) == {"urls": ["b", "a"], "role_map": {"Foo": "P"}, "scribble_scope": "TOOL_AUTHORED"} and len(got.warnings) == 2
    for bad in ("checks: 3", "ReorderWebCapturesCheck: [1]", "- a"):
        with pytest.raises(ValueError):
            config.parse(bad)
    with pytest.raises(ValueError):
        config.options(config.parse("StaleScribbleCheck: {scope: SOME}"))
    assert config.comma_separated(" a, b,,a ") == ["a", "b"]
    doc = str(tmp_path / "x_docloom.pdf")
    assert not config.for_document(doc).present
    place = config.template(doc)
    assert place == str(tmp_path / "x.docloom.yaml") and config.for_document(doc).present and config.for_document(str(tmp_path / "x.pdf")).checks is None
    assert pipeline.inject_check(["A"], "B") == ["A", "B"]


def test_rules_and_patterns_from_yaml(spark):
    from docloom.operators import rules

    got = rules.parse("roles:\n  L: {allowed_children: [LI], required_children: LI, min_children: 1}\n  LI:\n    parent_must_be: [L]\n    child_pattern: 'Lbl? LBody'\n")
    assert got["L"] == {"allowed": ["LI"], "required": ["LI"], "parent_must_be": [], "min_c": 1, "max_c": None, "pattern": None} and got["LI"]["pattern"] == "Lbl? LBody"
    t = tables(spark, "Document[LI[LBody,Lbl],L]")
    found = run_checks(Context(spark, t, {"rules": rules.complete(got | {"Document": {"allowed": []}})}), ["SchemaValidation"])
    assert {r.type for r in found.where("elem_id in (2, 5)").collect()} == {"TAG_WRONG_PARENT", "TAG_WRONG_CHILD_PATTERN", "TAG_WRONG_CHILD_COUNT"}
    assert rules.parse_patterns("page: '^Page'") == {"page": "^Page"}
    for bad in ("- a", "a: 1"):
        with pytest.raises(ValueError):
            rules.parse_patterns(bad)


def test_elements_no_root_leads_to(spark):
    from docloom.operators import hierarchy

    e = tables(spark, "Document[P]")["elem"]
    bad = spark.createDataFrame([(1, 8, 9, 1, "P", None, None, None, None), (1, 9, 8, 1, "P", None, None, None, None), (1, 10, 77, 1, "P", None, None, None, None)], e.schema)
    deep = spark.createDataFrame([(2, i, i - 1 or None, 1, "Div", None, None, None, None) for i in range(1, 601)], e.schema)
    every = e.unionByName(bad).unionByName(deep)
    assert rows(hierarchy.lost(every), "elem_id") == [(10,), (8,), (9,)]
    n = hierarchy.numbered(every)
    assert n.where("doc_id = 2").agg(F.max("depth"), F.max("last")).first()[:] == (600, 600) and n.where("doc_id = 1").count() == 2


def test_fields_inherit_from_any_height(spark):
    fields = [(1, 1, i, "Field", None, None, None, None, None, None, None, None, "Btn" if i == 1 else None, 65536 if i == 1 else None, i - 1 or None) for i in range(1, 21)]
    widgets = [(1, 1, 50, "Widget", *[None] * 10, 20), (1, 1, 51, "Widget", *[None] * 10, 99), (1, 1, 52, "Widget", *[None] * 8, "Btn", 65536, 99)]
    t = tables(spark, "Document[P]", annot=fields + widgets)
    assert rows(run_checks(Context(spark, t), ["UnexpectedWidget"]), "detail") == [("50",), ("52",)]
