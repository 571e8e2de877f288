import pytest


@pytest.mark.parametrize("size", ["sf0.001"])
def test_pipeline_by_stage(spark, size):
    import corpus_pipeline

    sf = f"/root/testdata/{size}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        now = {r.doc_id for r in kept.select("doc_id").collect()}
        assert now <= seen
        seen = now
    out = corpus_pipeline.run(spark, sf).select("doc_id", "shard").collect()
    assert {r.doc_id for r in out} == seen


def test_queries_have_their_columns(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    want = {
        "op1_": "doc_id size source_size target taken", "op2_": "doc_id n_assign n_access n_hex base_sha256 spans", "op3_": "doc_id held_out score predicted", "op4_": "doc_id shard",
        "op5_": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op6_": "doc_id n_shingles component_id", "op7_": "query_id rank vec_id score", "op9_": "doc_id held_out score predicted", "op10_": "doc_id held_out lang_pred score",
    }
    found = entry.queries()
    for start, cols in want.items():
        name = next(n for n in found if n.startswith(start))
        assert set(cols.split()) <= set(found[name](spark, sf).columns), name


def test_stages_tell_rows_apart_by_id_and_text(spark):
    from docloom.llm import decontam, ngram_join

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    out = decontam.keep_clean(spark, frame([(None, a), (None, b), (1, a), (1, c), (2, None), (None, None)]), spark.createDataFrame([(7, a)], "item_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, b), (1, c), (2, None), (None, None)], key=str)
    rows = [(None, a), (None, a), (5, a), (3, a), (3, a), (3, b), (None, c), (None, c), (4, ""), (4, ""), (None, d), (None, d + " end")]
    out = sorted(map(tuple, ngram_join.keep_first(spark, frame(rows)).collect()), key=str)
    ends = [r for r in out if r[1].startswith("d0")]
    assert len(ends) == 1 and [r for r in out if r not in ends] == sorted([(3, a), (3, b), (None, c), (4, ""), (4, "")], key=str)
