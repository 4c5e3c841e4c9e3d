import numpy as np

from vantloom.llm import bitsliced


def _brute(vectors, queries, k):
    out = []
    for qid, q in sorted(queries.items()):
        scored = sorted((-int(np.dot(q, v)), i) for i, v in vectors if i != qid and len(v) == len(q))
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_signed_digits():
    values = np.array([0, 1, -1, 7, -513, 1023, -1024])
    digits = bitsliced.signed_digits(values)
    assert (sum(d << w for w, d in enumerate(digits)) == values).all()
    assert all((a == 0) | (b == 0) for x, y in zip(digits, digits[1:]) for a, b in zip(x, y))


def test_sliced_sums_add_up():
    rng = np.random.default_rng(0)
    rows, queries = rng.integers(-300, 300, (130, 9)), rng.integers(-300, 300, (5, 9))
    index = bitsliced.Slices(np.arange(130), rows, top=20)
    sums = bitsliced.add_slices(bitsliced._columns(index, queries))
    bits = [np.unpackbits(s.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64) << w for w, s in enumerate(sums) if s is not None]
    exact = queries @ rows.T
    assert (np.diff(sum(bits), axis=1) == np.diff(exact, axis=1)).all()


def test_search_is_exact_with_few_slices_ties_and_tiny_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = [(int(i), rng.integers(-40, 40, 6).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(30)] + [(5000, [1, 2, 3]), (5001, [4, 5, 6]), (5100, [0, 0, 0])]
    df = spark.createDataFrame([*vectors, (None, [1] * 6), (6000, None), (6001, []), (6002, [1, None, 3, 4, 5, 6])], "vec_id bigint, v array<bigint>")
    queries = {i: v for i, v in vectors if i % 100 == 0}
    asked = df.filter("vec_id % 100 = 0 and vec_id < 6000")
    for rows, group in ((16_384, 1024), (37, 2)):
        found = bitsliced.exact_topk(df, asked, block_rows=rows, group_queries=group)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == _brute(vectors, queries, 10)
    assert bitsliced.exact_topk(df.limit(0), asked.limit(0)).count() == 0


def test_every_number_of_top_slices_gives_the_same():
    rng = np.random.default_rng(2)
    rows, ids = rng.integers(-500, 500, (700, 8)), np.arange(700)
    for top in (1, 2, 4, 12):
        got = list(bitsliced.top_rows(bitsliced.Slices(ids, rows, top), ids[:7], rows[:7]))
        found = sorted(zip(*(np.concatenate(x).tolist() for x in zip(*got))))
        assert found == sorted((q, i, s) for q, _, i, s in _brute(list(enumerate(rows)), {k: rows[k] for k in range(7)}, 10))


def test_quantised_drops_what_is_not_finite(spark):
    rows = [(1, [0.5, -0.0001]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("-inf"), 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "3 AS v")
    assert [(r.vec_id, r.v) for r in bitsliced.quantised(df).collect()] == [(1, [512, -1])]


def test_components_of_any_size_and_ids_of_any_type(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), rng.integers(-40, 40, 5).tolist()) for i in range(120)]
    vectors += [(200 + i, rng.integers(-(2**62), 2**62, 5).tolist()) for i in range(30)] + [(300, [2**63 - 1] * 5), (400, [-(2**63)] * 5), (401, [2**21, 0, 0, 0, -1])]
    exact = {i: np.array(v, object) for i, v in vectors}
    clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = []
    for q in (i for i in exact if i % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(exact[q], exact[i])), i) for i in exact if i != q)
        want += [(q, r + 1, i, clamp(-s)) for r, (s, i) in enumerate(scored[:10])]
    df = spark.createDataFrame(vectors, "vec_id bigint, v array<bigint>")
    for rows, group in ((16_384, 1024), (37, 2)):
        found = bitsliced.exact_topk(df, df.filter("vec_id % 100 = 0"), block_rows=rows, group_queries=group)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == sorted(want)
    named = df.selectExpr("concat('n', vec_id) AS part", "v AS dim", "vec_id AS block")
    found = bitsliced.exact_topk(named, named.filter("block % 100 = 0"), id_col="part", vector_col="dim")
    assert found.columns == ["query_id", "rank", "part", "score"]
    assert {(int(r.query_id[1:]), r["rank"], r.score) for r in found.collect()} == {(q, r, s) for q, r, _, s in want}


def test_rows_repeated_beyond_k_crowd_no_block(spark):
    df = spark.createDataFrame([(1, [1, 2])] * 500 + [(100, [1, 1]), (2, [0, 1])], "vec_id bigint, v array<bigint>")
    found = bitsliced.exact_topk(df, df.filter("vec_id % 100 = 0")).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in found) == [(k, 1, 3) for k in range(1, 11)]


def test_query_takes_one_odd_vector(spark, tmp_path):
    rows = [(100 * k, [0.25 * k, 1.0]) for k in range(5)] + [(7, [1e9, 1.0]), (8, [-1e30, 1.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in bitsliced.op8_exact_topk(spark, str(tmp_path)).collect()}
    assert found[100, 1] == (7, 256 * 1024 * 10**9 + 1024**2) and found[100, 6] == (8, -(2**63))
