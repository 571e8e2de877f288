"""Content tables from a renderer's events and operators."""

import pytest

from docloom.operators import extraction as X
from docloom.sources.tables import SCHEMAS

IDENTITY = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]


def event(n, kind, mcid, text=None, font=None, size=10.0, points=None, curves=0, painted=None, ctm=IDENTITY, page=1):
    return (1, page, n, kind, mcid, text, font, 0.0, size, 0.0, 0.0, points, curves, painted, ctm)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        event(1, "TEXT", 0, "one", "A", 10.0, [0.0, 0.0, 20.0, 10.0]),
        event(2, "TEXT", 0, "two", "A", 10.005, [25.0, -2.0, 40.0, 9.0]),
        event(3, "TEXT", 0, "  ", "A", 99.0, [500.0, 500.0, 600.0, 600.0]),
        event(4, "TEXT", 0, "big", "A", 12.0, [41.0, 0.0, 60.0, 12.0]),
        event(5, "TEXT", 0, "bold", "B", 12.0, [61.0, 0.0, 70.0, 12.0]),
        event(6, "IMAGE", 1, ctm=[200.0, 0.0, 0.0, 100.0, 30.0, 40.0]),
        event(7, "PATH", 2, points=[0.0, 0.0, 5.0, 5.0], painted=False),
        event(8, "PATH", 3, points=[1.0, 2.0, 9.0, 4.0], painted=True),
        event(9, "TEXT", -1, "unmarked", "A", 10.0, [0.0, 0.0, 1.0, 1.0]),
        *[event(20 + i, "PATH", -1, points=[x, 100.0, x + 3.75, 105.0], curves=2, painted=True, ctm=[1.0, 0.0, 0.0, 1.0, 5.0, 0.0]) for i, x in enumerate((10.0, 10.4, 30.0))],
        event(30, "PATH", -1, points=[0.0, 0.0, 9.0, 9.0], curves=2, painted=True),
        event(31, "PATH", -1, points=[0.0, 0.0, 3.75, 5.0], curves=3, painted=True),
    ]
    return spark.createDataFrame(rows, X.EVENTS)


def test_spans_and_contents(spark, events):
    spans = [tuple(r)[2:] for r in X.spans(events).orderBy("mcid", "span_ord").collect()]
    assert spans == [(0, 1, "A", 10.0, "one two"), (0, 2, "A", 12.0, "big"), (0, 3, "B", 12.0, "bold")]
    got = [tuple(r)[2:] for r in X.contents(events).orderBy("mcid").collect()]
    assert got == [(0, "one two big bold", ["TEXT"], 0.0, -2.0, 70.0, 12.0), (1, None, ["IMAGE"], 30.0, 40.0, 230.0, 140.0), (3, None, ["PATH"], 1.0, 2.0, 9.0, 4.0)]
    for table, made in (("content", X.contents(events)), ("span", X.spans(events)), ("bullet", X.bullets(events))):
        assert [f.name for f in made.schema] == [c.split()[0] for c in SCHEMAS[table].split(", ")]


def test_bullets_and_flags(spark, events):
    assert [(r.ord, r.x, r.y) for r in X.bullets(events).orderBy("ord").collect()] == [(20, 15.0, 100.0), (22, 35.0, 100.0)]
    doc = spark.createDataFrame([(1, False, False), (2, True, True)], "doc_id long, has_text boolean, has_image boolean")
    assert sorted(map(tuple, X.document_flags(doc, events).collect())) == [(1, True, True), (2, False, False)]


def test_blocks_of_operators(spark):
    ops = [("BDC", ["/P", "<</MCID 4>>"]), ("Tj", ["some"]), ("BMC", ["/Span"]), ("Tj", [" text"]), ("EMC", []), ("EMC", []), ("Tj", ["lost"]), ("BMC", ["/Artifact"]), ("Tj", ["42"]), ("EMC", []), ("BMC", ["/Other"]), ("Tj", ["x"]), ("EMC", []), ("EMC", [])]
    rows = spark.createDataFrame([(1, 1, i, o, x) for i, (o, x) in enumerate(ops)], "doc_id long, page_num int, op_ord int, op string, operands array<string>")
    assert sorted(map(tuple, X.blocks(rows).collect())) == [(1, 1, 1, 4, "some text"), (1, 1, 2, None, "42")]
