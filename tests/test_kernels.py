import hashlib
import math

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vantloom.functions import dsl, hashing, kernels
from vantloom.operators import vectors
from vantloom.plans import text_queries, vector_queries  # noqa: F401  registers the queries
from vantloom.queries import ORACLE_SQL, QUERIES

#: Queries whose SQL rounds components without adding 0.0.
SIGNED = """c11_weighted c7_transform_chain c8_normalize_l1 c8_normalize_max c8_normalize_mean c9_standard_scaler k6_normalize_l2
t23_fusion_attention t23_fusion_average t23_fusion_gated""".split()

A, B = [1.0, 2.0, 3.0], [4.0, 5.0, 6.0]


def _value(spark, fn, a=A, b=B):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    return df.select(fn(F.col("a"), F.col("b")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "fn, want",
    [
        (kernels.cosine_similarity, 0.9746318),
        (kernels.euclidean, 5.196152),
        (kernels.manhattan, 9.0),
        (kernels.dot, 32.0),
        (kernels.chebyshev, 3.0),
        (kernels.minkowski(3), 3 * 3 ** (1 / 3)),
        (kernels.SIMILARITY["euclidean"], -5.196152),
        (kernels.INDEX_DISTANCE["dot"], -32.0),
        (kernels.FLAT_DISTANCE["dot"], -31.0),
        (kernels.COLLECTION_SCORE["manhattan"], 0.1),
        (kernels.pearson_similarity, 1.0),
        (kernels.hamming_similarity, 0.0),
    ],
)
def test_values(spark, fn, want):
    assert _value(spark, fn) == pytest.approx(want, abs=1e-6)


def test_zero_vectors(spark):
    zero = [0.0, 0.0, 0.0]
    assert _value(spark, kernels.cosine_similarity, zero) == 0.0
    assert _value(spark, kernels.clamped_cosine_distance, zero) == 1.0
    assert _value(spark, kernels.jaccard_similarity, zero, zero) == 0.0
    with pytest.raises(Exception, match="zero vector"):
        _value(spark, lambda a, b: kernels.normalize_l2(a), zero)
    assert _value(spark, lambda a, b: kernels.normalize_l2(a), [3.0, 4.0]) == pytest.approx([0.6, 0.8])


def test_jaccard_and_hamming_bits(spark):
    a, b = [1.0, 0.6, 0.2, 0.0], [1.0, 0.4, 0.9, 0.0]
    assert _value(spark, kernels.jaccard_similarity, a, b) == pytest.approx(1 / 3)
    assert _value(spark, kernels.hamming_bits, a, b) == 2


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot", "manhattan", "jaccard"])
def test_unrolled_forms_agree(spark, metric):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=7).tolist()) for k in range(20)] + [(99, [0.0] * 7)]
    q = rng.normal(size=7).tolist()
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    lit = F.array(*(F.lit(x) for x in q))
    found = df.select(kernels.score_with(F.col("v"), q, metric).alias("a"), kernels.COLLECTION_SCORE[metric](F.col("v"), lit).alias("b"), kernels.distance_with(F.col("v"), q, metric).alias("c"), kernels.FLAT_DISTANCE[metric](F.col("v"), lit).alias("d")).collect()
    assert all(r.a == pytest.approx(r.b, abs=1e-12) and r.c == pytest.approx(r.d, abs=1e-12) for r in found)


def test_scalers_and_normalisers(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "vector array<double>")
    assert [r[0] for r in df.select(vectors.standard_scaler(df).apply(F.col("vector"))).collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    assert [r[0] for r in df.select(vectors.minmax_scaler(df).apply(F.col("vector"))).collect()] == [[0.0, 0.0], [1.0, 0.0]]
    assert df.select(vectors.normalized(F.col("vector"), "l1")).first()[0] == pytest.approx([1 / 6, 5 / 6])
    zero = spark.createDataFrame([([0.0, 0.0],)], "vector array<double>")
    assert zero.select(vectors.normalized(F.col("vector"))).first()[0] == [0.0, 0.0]


def test_kmeans_separates_and_checks_k(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(0, 0.1, 3) + 10 * (k % 3)).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    found = vectors.assign(df, vectors.fit_kmeans(df, 3)).groupBy("cluster").agg(F.count_distinct(F.col("id") % 3).alias("kinds"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r.kinds, r.n) for r in found) == [(1, 20)] * 3
    with pytest.raises(ValueError):
        vectors.fit_kmeans(df, 61)


def test_pca_finds_the_main_direction(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 1)) @ np.array([[3.0, 4.0, 0.0]]) + rng.normal(0, 0.01, (200, 3))
    mean, components = vectors.fit_pca(spark.createDataFrame([(r.tolist(),) for r in x], "vector array<double>"), 1)
    assert components[0] == pytest.approx([0.6, 0.8, 0.0], abs=0.01)
    assert mean == pytest.approx(x.mean(axis=0))


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "centroid"])
def test_agglomerative(spark, linkage):
    rows = [(k, [float(k % 2) * 50 + k * 0.1]) for k in range(10)]
    found = vectors.agglomerative(spark.createDataFrame(rows, "id bigint, vector array<double>"), 2, linkage).collect()
    assert len({(r.id % 2, r.cluster) for r in found}) == 2


def test_ring_agrees_with_its_column(spark):
    ring = hashing.Ring(["a", "b", "c"])
    rows = spark.createDataFrame([(f"key{k}",) for k in range(50)], "k string").select("k", ring.node_of(F.col("k")).alias("n")).collect()
    assert all(r.n == ring.owner(r.k) for r in rows)


def test_rounding_keeps_the_sign_of_zero(spark):
    """As DuckDB's round, bit by bit; halves away from zero."""
    values = [-1e-7, 1e-7, -4.9e-7, -5e-7, 0.5e-6, 1.5e-6, -2.5e-6, 0.0078125, -0.0078125, -0.0, 12.3456785, 1e300, 1e308, float("inf"), float("nan"), None]
    found = spark.createDataFrame([(values,)], "v array<double>").select(F.transform("v", kernels.rounded)).first()[0]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()]
    assert list(map(repr, found)) == list(map(repr, want))


def _vectors(spark, path):
    """Vectors with components that round to zero from below, under every transform."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 64))
    x[::2, 7], x[::2, 40] = -1e-9, -3e-9
    # The mean of component 9 is 1e-8, so that the first row's stands below it by less than rounding shows.
    x[:, 9] -= x[:, 9].mean() - 1e-8
    x[1, 9] += x[0, 9]
    x[0, 9] = 0.0
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")


@pytest.mark.parametrize("name", SIGNED)
def test_queries_keep_the_sign_of_zero(spark, tmp_path, name):
    _vectors(spark, tmp_path)
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    columns = ", ".join(df.columns)
    want = con.sql(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall()
    assert "-0.0" in str(want)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


#: Queries that are to divide as their SQL does whatever the vectors hold.
ODD = """c8_normalize_l1 c8_normalize_max c8_normalize_mean""".split()


@pytest.mark.parametrize("name", ODD)
def test_normalised_odd_vectors(spark, tmp_path, name):
    """Zero and empty vectors, nulls, not-a-numbers, infinities and the ends of the float range."""
    nan, inf = math.nan, math.inf
    vectors = [[0.0] * 4, [-0.0, 0.0, 0.0, 0.0], None, [], [None] * 4, [None, 1.0, -2.0, 3.0], [0.0, None, 0.0, 0.0], [nan, 1.0, 2.0, -0.0], [inf, 1.0, -1.0, 0.0], [-inf, inf, 1.0, 0.0], [1e-45, -1e-45, 1e-40, -0.0], [3e38, -3e38, 3e38, 1.0]]
    spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT id, z FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()))) == sorted(map(repr, want))


def test_bloom_has_no_false_negatives(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    bloom = hashing.Bloom.build(df.filter("k < '3'"), "k", 500)
    hits = df.select("k", bloom.might_contain(F.col("k")).alias("h")).collect()
    assert all(r.h for r in hits if r.k < "3") and sum(r.h for r in hits if r.k >= "3") < 30


def test_large_bloom_filters_are_probed_alike(spark, monkeypatch):
    df = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("k"))
    bloom = hashing.Bloom.build(df.filter("k < '3'"), "k", 1500)
    plain = df.select("k", bloom.might_contain(F.col("k")).alias("h")).collect()
    monkeypatch.setattr(hashing, "PLAN_WORDS", 0)
    assert df.select("k", bloom.might_contain(F.col("k")).alias("h")).collect() == plain


def test_bloom_query_keeps_its_rate_on_more_members(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    assert vector_queries.h2(spark, str(tmp_path)).first().asDict() == {"members": 10_000, "missed": 0, "few_false": True}


def test_scripts_refuse_what_they_do_not_know(spark):
    df = spark.createDataFrame([(2.0,)], "x double")
    assert df.select(dsl.script(F.col("x"), "abs(-value) ** 2 if value > 1 else 0")).first()[0] == 4.0
    with pytest.raises(ValueError):
        dsl.script(F.col("x"), "__import__('os')")
    program = dsl.compile_program("a = softmax(x)\nm = reshape(x, 1, 2)\nb = matmul(m, a)\nout = concat(a, b)")
    out = spark.createDataFrame([([0.0, math.log(3)],)], "x array<double>").select(program({"x": F.col("x")})).first()[0]
    assert out == pytest.approx([0.25, 0.75, 0.75 * math.log(3)])


def test_murmur3_gives_published_values():
    texts = [b"", b"test", b"Hello, world!", b"The quick brown fox jumps over the lazy dog"]
    assert hashing.murmur3_all(texts).tolist() == [0, 0xBA6BD213, 0xC0363E43, 0x2E4FF723]
    assert hashing.murmur3_all(texts[:2], 0x9747B28C).tolist() == [0xEBB6C228, 0x704B81DC]
    assert hashing.murmur3_all([]).tolist() == []


def test_blake3_of_counted_bytes():
    # Published test vectors: the input is 0, 1, ... 250, 0, 1, ... of the given length.
    known = {
        1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
        1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11",
        1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
        1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
        2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
        3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
        8193: "bab6c09cb8ce8cf459261398d2e7aef35700bf488116ceb94a36d0f5f1b7bc3b",
    }
    texts = {n: bytes(k % 251 for k in range(n)) for n in known}
    assert dict(zip(texts, hashing.blake3_all(list(texts.values())))) == known


def test_digests_are_those_of_the_library(spark):
    rows = [("",), ("abc",), (None,), ("é" * 900,)]
    df = spark.createDataFrame(rows, "x string").select("x", *(hashing.digest(F.col("x"), k).alias(k) for k in hashing.ALGORITHMS))
    for r in df.collect():
        if r.x is None:
            assert r[1:] == (None,) * 7
            continue
        raw = r.x.encode()
        assert (r.md5, r.sha1, r.sha256, r.sha512) == tuple(getattr(hashlib, k)(raw).hexdigest() for k in ("md5", "sha1", "sha256", "sha512"))
        assert r.blake3 == hashing.blake3_all([raw])[0] and r.city == r.xxh3 == xxhash.xxh3_64_digest(raw)[::-1].hex()
