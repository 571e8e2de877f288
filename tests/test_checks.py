import collections

import pytest
from build import tables

from docloom.operators.checks import CHECKS, Context, run_checks
from docloom.operators.rules import default_rules, lint

BOX = (0, 0, 100, 10)


def found(spark, names, *trees, options=None, **rows):
    ctx = Context(spark, tables(spark, *trees, **rows), options or {})
    return sorted((r.doc_id, r.type, r.elem_id, r.detail) for r in run_checks(ctx, names).collect())


def test_every_check_runs_on_empty_tables(spark):
    from docloom.sources.tables import empty

    assert run_checks(Context(spark, empty(spark)), [n for n in CHECKS if n != "MissingPageParts"] + ["MissingPageParts"]).count() == 0
    assert len(CHECKS) == 35 and sum(c.default for c in CHECKS.values()) == 28


def test_document_checks_and_fatal_stop(spark):
    docs = [(1, "a", 1, False, False, True, None, False, 1, None, False, False), (2, "b", 1, True, True, False, None, True, 1, None, True, False), (3, "c", 1, True, True, False, "en", True, None, "S", False, False)]
    names = ["ImageOnlyDocument", "StructureTreeExists", "LanguageSet", "TabOrder", "TaggedPdf", "PdfUaConformance", "ClearRoleMap", "ReplaceRoleMap"]
    got = collections.defaultdict(list)
    for d, t, _, _ in found(spark, names, doc=docs):
        got[d].append(t)
    assert got == {1: ["IMAGE_ONLY_DOCUMENT"], 2: sorted(["LANGUAGE_NOT_SET", "TAB_ORDER_NOT_SET", "FALSE_PDFUA_CONFORMANCE", "ROLEMAP_PRESENT", "ROLEMAP_PRESENT"]), 3: ["ROLEMAP_PRESENT"]}


def test_schema(spark):
    got = found(spark, ["SchemaValidation"], "Document[L[P,P]]", "Document[L[LI[LBody[P],Lbl]]]", "Document[Blah,P[Span]]", "Document[L[LI[Lbl,LBody[P]]]]")
    assert got == [(1, "TAG_WRONG_CHILD", 3, "P"), (1, "TAG_WRONG_CHILD", 4, "P"), (2, "TAG_WRONG_CHILD_PATTERN", 3, "LBody Lbl "), (3, "TAG_UNKNOWN_ROLE", 2, ""), (3, "TAG_WRONG_CHILD", 2, "Blah")]


def test_lint():
    assert lint(default_rules()) == []
    rule = {"parent_must_be": [], "allowed": [], "required": [], "min_c": None, "max_c": None, "pattern": None}
    assert lint({"L": rule | {"allowed": ["Lbl"]}, "LI": rule | {"parent_must_be": ["L"]}, "Lbl": rule})
    assert lint({"L": rule | {"allowed": ["Lbl"], "required": ["LI"]}, "LI": rule, "Lbl": rule})
    assert lint({"L": rule | {"min_c": 5, "max_c": 2}})


@pytest.mark.parametrize(
    ("tree", "places", "hit"),
    [
        ("Document[P,P]", {2: (1, 1), 3: (2, 1)}, []),
        ("Document[P,P]", {2: (2, 1), 3: (1, 1)}, [1]),
        ("Document[P,P]", {2: (1, 5), 3: (1, 2)}, [1]),
        ("Document[Sect[P,P],P]", {3: (1, 2), 4: (1, 1), 5: (1, 3)}, [2]),
        ("Document[P]", {2: (2, 1)}, []),
    ],
)
def test_reading_order(spark, tree, places, hit):
    content = [(1, e, p, m, "t", ["TEXT"], BOX) for e, (p, m) in places.items()]
    assert [e for _, _, e, _ in found(spark, ["StructTreeOrder"], tree, content=content)] == hit


def test_structure_checks(spark):
    names = ["MissingDocument", "NeedlessNesting", "MissingPageParts", "IrregularToc", "EmptyElement", "StaleScribble", "ScribbledInstruction"]
    got = found(spark, names, "Sect[P]", "Document[TOC[P,TOC[P]],Sect]", "Document[P=~!ARTIFACT[Span=~!SET_ROLE_P],P=~note,Art=~OK[P=~x]]")
    assert (1, "MISSING_DOCUMENT_ELEMENT", None, "") in got and (1, "NEEDLESS_NESTING", None, "1") in got
    assert [g for g in got if g[1] == "IRREGULAR_TOC"] == [(2, "IRREGULAR_TOC", 2, "")]
    assert [g for g in got if g[1] == "SCRIBBLED_INSTRUCTION"] == [(3, "SCRIBBLED_INSTRUCTION", 2, "!ARTIFACT")]
    assert [g[2] for g in got if g[1] == "STALE_SCRIBBLE"] == [2, 3, 4]
    assert (1, "EMPTY_ELEMENT", None, "1") in got


@pytest.mark.parametrize(
    ("sizes", "want"),
    [
        ([24, 18] + [12] * 10, [(2, "H1"), (3, "H2")]),
        ([12] * 6, []),
        ([24, 20, 14, 12, 16] + [10] * 8, [(2, "H1"), (3, "H2"), (4, "H3"), (5, "H4"), (6, "H3")]),
        ([16, 24, 20] + [10] * 8, [(2, "too deep to open"), (3, "H1"), (4, "H2")]),
    ],
)
def test_headings(spark, sizes, want):
    tree = "Document[" + ",".join("P" for _ in sizes) + "]"
    content = [(1, i, 1, i, "some words of text" if s > 12 else "a long text of the body " * 5, ["TEXT"], BOX, s) for i, s in enumerate(sizes, 2)]
    assert [(e, d) for _, _, e, d in found(spark, ["MistaggedHeading"], tree, content=content)] == want


def test_lists_links_and_artifacts(spark):
    left = {2: 0, 3: 30, 4: 30, 5: 30, 6: 30}
    content = [(1, e, 1, e, "text", ["TEXT"], (x, 100 - 10 * e, x + 50, 108 - 10 * e)) for e, x in left.items()]
    got = found(spark, ["MistaggedList"], "Document[H1,P,P,P,P]", content=content)
    assert got == [(1, "LIST_TAGGED_AS_PARAGRAPHS", 3, "4")]
    got = found(spark, ["MistaggedList"], "Document[H1,P,P,P,P]", content=content, bullet=[(1, 1, i, 20.0, 104.0 - 10 * e) for i, e in enumerate((3, 4))])
    assert (1, "LIST_TAGGED_AS_PARAGRAPHS", 3, "2") in got

    def links(*uris):
        annot = [(1, 1, i, "Link", [0.0, 0.0, 9.0, 9.0], None, 1, "URI", u, None, None, None, None, None, None) for i, u in enumerate(uris)]
        kid = [(1, i + 3, 50, "objr", None, None, 1, i) for i in range(len(uris))]
        return {"annot": annot, "kid": kid}

    tree = "Document[P[Link,Link]]"
    far, same = links("https://a.example", "https://b.example"), links("https://a.example", "https://a.example")
    assert [g[1] for g in found(spark, ["MistaggedList", "BadlySplitLink"], tree, **far)] == ["PARAGRAPH_OF_LINKS"]
    assert [g[1] for g in found(spark, ["MistaggedList", "BadlySplitLink"], tree, **same)] == ["LINK_SPLIT_ACROSS_TAGS"]
    assert [g[3] for g in found(spark, ["InvalidLinkUri"], tree, **links("example.com", "https://sub.example.co.uk"))] == ["example.com"]

    content = [(1, 2, 1, 1, " ", [], BOX), (1, 3, 1, 2, "Page 3 of 9", ["TEXT"], BOX), (1, 4, 1, 3, None, ["PATH"], BOX), (1, 5, 1, 4, None, ["IMAGE"], (0, 0, 300, 300)), (1, 6, 1, 5, "plain", ["TEXT"], BOX)]
    got = found(spark, ["MistaggedArtifact"], "Document[Span,P,P,Figure,P]", content=content)
    assert [(e, d) for _, _, e, d in got] == [(2, "element"), (3, "element"), (4, "3")]


def test_annotations_and_optional_checks(spark):
    annot = [
        (1, 1, 1, "Link", [0.0, 0.0, 9.0, 9.0], None, None, "URI", "https://a.example", None, None, None, None, None, None),
        (1, 1, 2, "Widget", [0.0, 0.0, 9.0, 9.0], None, None, None, None, None, None, None, None, None, 3),
        (1, 1, 3, "Field", None, None, None, None, None, None, None, None, "Btn", 65536, None),
        (1, 1, 4, "Widget", [0.0, 0.0, 9.0, 9.0], None, None, None, None, None, None, None, "Tx", 0, None),
    ]
    got = found(spark, ["UnmarkedLink", "UnexpectedWidget"], "Document[P]", annot=annot)
    assert [(t, d) for _, t, _, d in got] == [("UNEXPECTED_WIDGET", "2"), ("UNMARKED_LINK", "1")]
    content = [(1, 2, 1, 7, "body", ["TEXT"], BOX)]
    block = [(1, 1, 1, None, "42"), (1, 1, 2, 7, "body"), (1, 1, 3, None, "no digits")]
    assert found(spark, ["MisartifactedText"], "Document[P]", content=content, block=block) == [(1, "MISARTIFACTED_TEXT", 2, "1")]
    urls = [(1, 1, "https://a.example/x", 1, 1), (1, 2, "https://b.example/long", 1, 2), (1, 3, "https://b.example", 1, 3)]
    got = found(spark, ["ReorderWebCaptures", "WrapWebCaptures", "InlineDestinations"], "Document[P]", url_page=urls, dest=[(1, "d", 1)], options={"urls": ["b.example", "a.example"]})
    assert [(t, d) for _, t, _, d in got] == [("NAMED_DESTINATIONS_PRESENT", "1"), ("WEB_CAPTURES_BADLY_ORDERED", "2"), ("WEB_CAPTURES_NOT_GROUPED", "3")]
    ops = [(1, 1, 7, 1, "show", 0.0, 12.0, "a"), (1, 1, 7, 2, "show", -14.0, 18.0, "b"), (1, 1, 7, 3, "show", -0.5, 12.0, "c")]
    assert found(spark, ["BadlyMarkedContent"], "Document[P]", content=content, op=ops) == [(1, "MIXED_FONT_MARKED_CONTENT", 2, "1")]
    assert found(spark, ["BadlyMappedLigature"], "Document[P]", font_map=[(1, 5, 2, "F", 1, "ﬁ"), (1, 6, 1, "F", 1, "a")]) == [(1, "LIGATURE_MAPPING_BROKEN", None, "1")]
