"""Queries against their SQL on a few odd pages."""

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from docloom.operators import checks
from docloom.plans import check_queries, remediate
from docloom.sources import layout

#: Entities cut short, unknown ones, and two pages of runs whose boxes differ in width by them.
CUT = "<html><head><title>Thnd*** and&amp;&amp;&amp</title></head><body><nav><a href=\"http://www.a.example.org/x?a=1&amp\">one &lt two</a></nav><h1>Es&copy ad &eacute; &#65;</h1><p>the www.b.example.com&amp thing</p><div class=\"ad\">buy&amp</div><p>and&amp;&amp;&amp</p><footer>Cut &cop</footer></body></html>"


def differences(spark, folder, name, html):
    rows = [(i, f"https://h{i}.example/?page=1&x=2", h) for i, h in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    got = entry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    key = lambda r: tuple(map(repr, r))
    return sorted(map(key, map(tuple, got.select(*columns).collect()))), sorted(map(key, want.fetchall()))


def test_element_text_with_cut_entities(spark, tmp_path):
    got, want = differences(spark, tmp_path, "element_text", [CUT])
    assert got == want and any("&&&amp" in r[2] for r in want)


def test_structure_table_with_cut_entities(spark, tmp_path):
    got, want = differences(spark, tmp_path, "structure_table", [CUT, None, ""])
    assert got == want and want


def test_boxes_compared_with_cut_entities(spark, tmp_path):
    got, want = differences(spark, tmp_path, "boxes_compared", [CUT, CUT.replace("and&amp;&amp;&amp<", "and&amp;&amp;<")])
    assert got == want and want


#: Tags that close more than is open, an address that isn't closed, a blank that isn't one to SQL, signs that go with the blank before them.
ODD = "</div></nav><html><body><p>some short text</p><div\x0bid=x><div>a longer text than the others of its page</div><a href=\"/x>go</a><p>text</p></body></html>"
MARKED = "<html><body><p>word word word w \u0301marked and more than is shown</p><a href=\"/x>to a page</a><p>word word word w\u0600 and more than is shown</p></body></html>"


def test_boxes_compared_with_tags_closed_too_often(spark, tmp_path):
    got, want = differences(spark, tmp_path, "boxes_compared", [ODD + ODD * 2])
    assert got == want and want


def test_structure_table_with_marks_on_blanks(spark, tmp_path):
    got, want = differences(spark, tmp_path, "structure_table", [MARKED])
    assert got == want and want


@pytest.mark.parametrize("name", ["badly_split_link", "irregular_toc", "mistagged_artifact", "mistagged_heading", "needless_nesting", "schema_validation", "scribbled_instruction", "mistagged_list", "badly_marked_content", "empty_element", "inconsistent_parent_tree", "figure_with_text", "invalid_link_uri"])
def test_no_table_of_documents_is_sent_to_the_driver(spark, tmp_path, name):
    spark.createDataFrame([(1, "https://h.example/", CUT)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plan = entry.queries()[f"check_{name}"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [doc_id" in plan
    assert "BroadcastHashJoin [doc_id" not in plan


def test_unmarked_link_in_a_verified_paragraph(spark, tmp_path):
    """Hidden paragraphs hold nothing that a later page's annotation overlaps; the Document below the root takes it."""
    html = "<html><body>" + "<p>some words</p>" * 5 + "<p>%%% see www.a.example.org now</p></body></html>"
    got, want = differences(spark, tmp_path, "fix_unmarked_link", [html])
    assert got == want == [("'UNMARKED_LINK'", "1", "1", "0")]


@pytest.mark.parametrize("name", ["check_mistagged_heading", "check_mistagged_list", "check_missing_page_parts"])
def test_nothing_made_by_joins_is_sent_to_the_driver(spark, tmp_path, name):
    spark.createDataFrame([(1, "https://h.example/", CUT)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "text", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = entry.queries()[name](spark, str(tmp_path))
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [doc_id" not in plan


def test_plans_of_a_repair_stay_small(spark, tmp_path, monkeypatch):
    """What a repair reads several times is computed once: plans that multiply fill the driver on tables of any size."""
    joins, split = [], remediate.FIXES["MergeSplitLinks"]

    def spied(ctx, hits):
        new = split(ctx, hits)
        joins.extend(df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in new.values())
        return new

    monkeypatch.setitem(remediate.FIXES, "MergeSplitLinks", spied)
    html = "<html><body><div><a href=\"http://a.example/\">" + "a long text of a link that goes on " * 4 + "</a></div></body></html>"
    got, want = differences(spark, tmp_path, "fix_badly_split_link", [html])
    assert got == want and want
    assert joins and max(joins) <= 12, joins


def test_shredded_pages_are_read_few_at_a_time(spark, tmp_path):
    """A reader's task holds up to 4,096 rows of a row group, with all their texts: groups of nested rows are small."""
    pages = spark.range(700, numPartitions=1).selectExpr("id as page_id", "'https://h.example/' as url", "'<html><body><p>a</p></body></html>' as html")
    layout.tables(spark, pages, f"{tmp_path}/nested")
    files = [pq.ParquetFile(f).metadata for f in tmp_path.glob("nested/*.parquet")]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == 700 and max(groups) <= 256, groups


def test_candidates_for_artifacts_are_found_once(spark, tmp_path):
    """Elements and what is found of them are read several times by mistagged_artifact."""
    spark.createDataFrame([(1, "https://h.example/", CUT)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    ctx = checks.Context(spark, check_queries.tables(spark, str(tmp_path)))
    plan = checks.CHECKS["MistaggedArtifact"].run(ctx)._jdf.queryExecution().optimizedPlan().toString()
    ctx.release()
    assert plan.count("Join ") <= 4, plan.count("Join ")


def test_elements_and_boxes_of_lists_are_made_once(spark, tmp_path, monkeypatch):
    """Members, bullets and kids beside them read the same elements with their boxes."""
    joins, settled = {}, checks.Context.settled

    def spied(ctx, df, name):
        joins[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return settled(ctx, df, name)

    monkeypatch.setattr(checks.Context, "settled", spied)
    got, want = differences(spark, tmp_path, "check_mistagged_list", [CUT, "<html><body><div><p>one</p><p>two</p></div></body></html>"])
    assert got == want and want
    assert joins["members"] <= 3 and joins["inside"] <= 3, joins
