import pytest
from compare import connect, same

from vantloom.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows(spark, sf, name):
    found, want = same(QUERIES[name](spark, sf), connect(sf).sql(ORACLE_SQL[name]))
    assert found == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_one_row_a_document(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() == df.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
