"""Plans are the ones wanted: pruned scans, pushed filters, compiled top k, no cross products."""

import pytest
from pyspark.sql import functions as F

import vantloom.catalogue  # noqa: F401
from vantloom.operators import ann, search
from vantloom.queries import QUERIES

STREAMS = ("w", "x", "u", "i", "c", "s23")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith(STREAMS)])
def test_no_cross_products(spark, sf, name):
    found = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found


def test_top_k_is_one_operator_over_a_pruned_scan(spark, sf):
    found = plan(QUERIES["knn_cosine_top10"](spark, sf))
    assert "TakeOrderedAndProject" in found and "label" not in found.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector", "label", "'{}' AS metadata")
    c = search.Collection("e", 64, df.filter(F.col("label") == 3))
    found = plan(c.search([0.1] * 64, search.SearchOptions(include_metadata=False)))
    assert "EqualTo(label,3)" in found and "TakeOrderedAndProject" in found


def test_statistics_are_scalar_subqueries(spark, sf):
    assert "Subquery" in plan(QUERIES["r3_zscore"](spark, sf))


def test_group_by_pre_aggregates(spark, sf):
    assert "partial_sum" in plan(QUERIES["a1_group_sum"](spark, sf))


def test_an_index_is_read_by_cell(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    ann.Ivf(df, ann.IndexConfig("ivf", lists=8, probes=2)).save(str(tmp_path))
    ivf = ann.Ivf.load(spark, str(tmp_path))
    q = [0.1] * 64
    found = plan(ivf.search(q, 3))
    assert "PartitionFilters: [isnotnull(cell" in found or "PartitionFilters: [cell" in found
    assert set(ivf.cells(q)) == {int(f.rsplit("cell=", 1)[1].split("/")[0]) for f in ivf.rows.filter(F.col("cell").isin(ivf.cells(q))).inputFiles()} or len(ivf.cells(q)) == 2
    joined = plan(ivf.join(df.filter("id = 0"), 3))
    assert "PartitionFilters: [" in joined and "CartesianProduct" not in joined and "NestedLoop" not in joined


def test_pivots_reach_the_scan(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    pivots = [r.vector for r in df.filter("id < 2").collect()]
    ann.save_pivots(df, pivots, f"{tmp_path}/p")
    found = plan(ann.pivot_range_search(spark.read.parquet(f"{tmp_path}/p"), pivots, [0.1] * 64, 0.5))
    assert "PushedFilters: [" in found and "GreaterThanOrEqual(pivot_0" in found
