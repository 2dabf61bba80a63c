"""Composition of texts that are empty or null, and of documents that share a number or have none: as in the SQL."""

import duckdb
import pytest

import __spark_entry__

ROWS = [(1, "ACGTnN."), (2, ""), (3, None), (4, "éß\U0001f600\0uU"), (5, "acca"), (5, "GG t"), (6, None), (6, "T"), (7, ""), (7, ""), (None, "AC"), (None, None), (None, "GT")]


@pytest.mark.parametrize("name", ["base_composition", "base_encode_nibble"])
def test_composition_of_odd_documents_equals_its_sql(spark, tmp_path, name):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.sql(__spark_entry__.oracle_sql()[name])
    found = __spark_entry__.queries()[name](spark, str(tmp_path))
    assert found.columns == expected.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected.fetchall(), key=str)
