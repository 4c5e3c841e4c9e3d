import pytest

import __spark_entry__ as entry
from vantloom.operators import ann, search


@pytest.mark.parametrize("name, k, metric", [("i2_ivf_search", 10, "cosine"), ("i3_lsh_search", 10, "cosine"), ("i4_pq_search", 10, "cosine"), ("i5_ivfpq_search", 10, "cosine"), ("i6_exact_within_cells", 5, "euclidean")])
def test_index_queries_find_the_true_neighbours_of_every_query(spark, sf, name, k, metric):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    truth = search.knn_join(df.filter("id % 50 = 0"), df, k, metric).cache()
    found = entry.queries()[name](spark, sf).cache()
    share = ann.recall(found, truth).first().recall
    assert truth.count() == found.count() and share >= (0.9 if name == "i3_lsh_search" else 1.0), share


def test_zero_vectors_and_few_rows(spark):
    rows = [(k, [float(k % 3 - 1), float(k % 2), 0.5 * (k > 4)]) for k in range(9)] + [(9, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    for metric in ("cosine", "euclidean"):
        for k in (3, 20):
            truth = {(r.query_id, r.rank): round(r.score, 6) for r in search.knn_join(df, df, k, metric).collect()}
            ivf = ann.Ivf(df, ann.IndexConfig("ivf", metric, lists=3, probes=1))
            config = ann.IndexConfig("pq", metric, subvectors=2, bits=2)
            ways = [ivf.certain_join(df, k), ann.Pq(df, config).certain_join(df, k), ann.certain_ivfpq_join(ivf, ann.Pq(ivf.rows, config), df, k)]
            for found in ways:
                assert {(r.query_id, r.rank): round(r.score, 6) for r in found.collect()} == truth
