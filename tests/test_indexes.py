import numpy as np
import pytest
from pyspark.sql import functions as F

from vantloom.operators import ann, search, vectors


@pytest.fixture(scope="module")
def emb(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(7, 12)) * 3
    rows = [(k, (centers[k % 7] + rng.normal(size=12)).tolist()) for k in range(700)]
    return spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(3).cache()


def _rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_of_any_size_give_the_exact_join(emb, metric):
    asked = emb.filter("id % 20 = 0")
    want = _rows(search.knn_join(asked, emb, 6, metric))
    rows = emb.withColumnsRenamed({"vector": "v"})
    for block, group in ((10_000, 10_000), (50, 4)):
        assert _rows(ann.block_search(rows, ann.asked_of(asked), 6, ann.exact_kernel(metric), block_rows=block, group_queries=group)) == want
    ivf = ann.Ivf(emb, ann.IndexConfig("ivf", metric, lists=9, probes=2))
    assert _rows(ivf.certain_join(asked, 6)) == want
    assert _rows(ivf.probing(9).join(asked, 6)) == want


def test_saved_indexes_are_the_same_indexes(spark, emb, tmp_path):
    asked = emb.filter("id % 50 = 0")
    ivf = ann.Ivf(emb, ann.IndexConfig("ivf", lists=6, probes=2))
    ivf.save(f"{tmp_path}/ivf")
    again = ann.Ivf.load(spark, f"{tmp_path}/ivf")
    assert again.config == ivf.config and np.allclose(again.centroids, ivf.centroids) and again.stats == ivf.stats
    assert _rows(again.join(asked, 5)) == _rows(ivf.join(asked, 5))
    pq = ann.Pq(emb, ann.IndexConfig("pq", subvectors=4, bits=4))
    pq.save(f"{tmp_path}/pq")
    loaded = ann.Pq.load(spark, f"{tmp_path}/pq")
    assert _rows(loaded.certain_join(asked, 5)) == _rows(search.knn_join(asked, emb, 5))
    q = emb.first().vector
    assert [r.id for r in loaded.search(q, 3).collect()] == [r.id for r in pq.search(q, 3).collect()]


def test_knobs_are_tuned_to_a_recall(emb):
    asked, sample = emb.filter("id % 20 = 0"), emb.filter("id % 20 = 3")
    truth = search.knn_join(asked, emb, 5)
    tuned = ann.Ivf(emb, ann.IndexConfig("ivf", lists=20, probes=1)).tuned(sample, 5, 0.95)
    assert tuned.config.probes < 20 and ann.recall(tuned.join(asked, 5), truth).first().recall >= 0.9
    levels = ann.Hierarchy(tuned.probing(20), (3, 8), 1).tuned_beam(sample, 5, 0.95)
    assert [len(p) for p, _ in levels.levels] == [8, 3]
    assert sorted(np.concatenate(levels.levels[0][1]).tolist()) == list(range(20))
    assert ann.recall(levels.join(asked, 5), truth).first().recall >= 0.9
    trees = ann.Trees.fit(emb, trees=4, leaf_rows=30, leaves=1)
    placed = trees.assign(emb).cache()
    assert placed.groupBy("id").count().filter("count <> 4").count() == 0
    tuned = trees.tuned(placed, sample, search.knn_join(sample, emb, 5), 5, 0.95)
    found = tuned.join(placed, asked, 5)
    assert ann.recall(found, truth).first().recall >= 0.9
    assert found.groupBy("query_id", "id").count().filter("count > 1").count() == 0


def test_a_leaf_holds_what_its_halves_say(emb):
    trees = ann.Trees.fit(emb, trees=2, leaf_rows=40, metric="euclidean")
    x = np.array([r.vector for r in emb.orderBy("id").collect()])
    leaf = trees.leaf_of(x)
    for t, root in enumerate(trees.roots):
        for v, got in zip(x[:50], leaf[:50, t]):
            node = root
            while node >= 0:
                node = trees.children[node][int(trees.normals[node] @ v >= trees.offsets[node])]
            assert -node - 1 == got
    every = ann.Trees.fit(emb, trees=2, leaf_rows=40)
    every.leaves = every.n_leaves
    assert sorted(every.probed(x[0])) == list(range(every.n_leaves))


@pytest.mark.parametrize("crowd", [16_384, 100])
def test_leaves_hold_no_more_rows_than_asked(spark, emb, crowd):
    """Also of rows that the sample did not show, and of equal ones."""
    same = spark.range(900, 1200).select("id", F.lit(emb.first().vector).alias("vector"))
    both = emb.unionByName(same)
    trees = ann.Trees.fit(emb, trees=3, leaf_rows=20, fit_rows=150)
    placed = trees.assign(both)
    assert placed.groupBy("cell").count().agg(F.max("count")).first()[0] > 20
    parted = trees.parted(placed, crowd=crowd)
    assert parted.groupBy("cell", "part").count().agg(F.max("count")).first()[0] <= 20
    assert parted.drop("part").exceptAll(placed).isEmpty() and placed.exceptAll(parted.drop("part")).isEmpty()


@pytest.mark.parametrize("kind", ["hnsw", "graph", "ngt"])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_graphs_find_the_neighbours(emb, kind, metric):
    asked = emb.filter("id % 20 = 0")
    truth = search.knn_join(asked, emb, 8, metric)
    for lists, shard in ((1, 16_384), (3, 120)):
        ivf = ann.Ivf(emb, ann.IndexConfig("ivf", metric, lists=lists, probes=lists))
        config = ann.GraphConfig(kind, metric, degree=8, shard_rows=shard)
        graph = ann.build_graph(ivf, config).cache()
        assert graph.count() == 700
        assert graph.groupBy("cell", "block").agg((F.max("pos") + 1 == F.count(F.lit(1))).alias("ok")).filter("not ok").count() == 0
        found = ann.graph_join(graph, ivf, asked, 8, config)
        assert ann.recall(found, truth).first().recall >= 0.95
    if kind == "hnsw":
        assert graph.filter(F.size("links") > 1).count() > 0


def test_graphs_of_few_rows(spark):
    rows = [(k, [float(k), 1.0]) for k in range(3)] + [(9, None)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>").filter("vector is not null")
    ivf = ann.Ivf(df, ann.IndexConfig("ivf", "euclidean", lists=1, probes=1))
    config = ann.GraphConfig("hnsw", "euclidean")
    found = ann.graph_join(ann.build_graph(ivf, config), ivf, df, 10, config)
    assert found.count() == 9


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "centroid"])
def test_merging_is_the_plain_definition(linkage):
    rng = np.random.default_rng(1)
    for n in (2, 5, 18):
        x, size = rng.normal(size=(n, 3)), rng.integers(1, 5, n).astype(float)
        members = {k: [k] for k in range(n)}

        def gap(a, b):
            if linkage == "centroid":
                return np.linalg.norm(np.average(x[members[a]], axis=0, weights=size[members[a]]) - np.average(x[members[b]], axis=0, weights=size[members[b]]))
            d = np.linalg.norm(x[members[a]][:, None] - x[members[b]][None], axis=2)
            return {"single": d.min, "complete": d.max, "average": lambda: np.average(np.average(d, axis=1, weights=size[members[b]]), weights=size[members[a]])}[linkage]()

        while len(members) > 2:
            _, a, b = min((gap(a, b), a, b) for a in members for b in members if a < b)
            members[a] += members.pop(b)
        want = {frozenset(m) for m in members.values()}
        label = vectors.merge_points(x, 2, linkage, size)
        assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())} == want
