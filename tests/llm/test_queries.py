"""Columns that the queries of operators derive."""

import __spark_entry__ as entry


def test_secrets_are_counted_by_kind_and_long_dotted_names_are_read(spark, tmp_path):
    texts = ["secret=abcdefghijkl secret=abcdefghijkl", "x AKIA1234567890ABCD y", "0123456789abcdef", "token: short user=me", "a." * 20000 + "b:8080", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in entry.queries()["op2_scan_secrets"](spark, str(tmp_path)).collect()}
    assert got == {0: (2, 0, 0), 1: (0, 1, 0), 2: (0, 0, 1), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0)}
