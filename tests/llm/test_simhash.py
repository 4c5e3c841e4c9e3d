import random

import numpy as np
import xxhash

from vantloom.llm import components, simhash


def _brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    value = 0
    for bit in range(64):
        if sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) * 2 > len(shingles):
            value |= 1 << bit
    return value - (1 << 64) if value >> 63 else value


def _components(values, limit=2):
    n = len(values)
    codes = np.array(values, np.int64).view(np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= limit
    label = np.arange(n)
    while True:
        new = np.where(near, label[None], n).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_fingerprints_bit_by_bit():
    rnd = random.Random(1)
    texts = ["", None, "a", "A b", "x y z", " \x0b\t", "É e f g", "w " * 700] + [" ".join(rnd.choice("abcdE") for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    assert [simhash.fingerprint(t) for t in texts] == [_brute(t) for t in texts]


def test_fingerprint_hash_is_that_of_the_engine(spark):
    value = spark.sql("SELECT xxhash64('one two three')").first()[0]
    assert value % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def _clustered(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, max(1, n // 40), dtype=np.uint64)
    codes = base[rng.integers(0, len(base), n)] ^ (np.uint64(1) << rng.integers(0, 12, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(codes)


def test_gray_index_finds_all_pairs():
    for n in (1, 5, 17, 300, 1200):
        codes = _clustered(n, n)
        codes = codes[np.argsort(simhash.gray_rank(codes))]
        a, b = simhash.GrayIndex(codes).search(codes, 2)
        want = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= 2)
        assert set(zip(a.tolist(), b.tolist())) == set(zip(*(w.tolist() for w in want)))


def test_own_pairs_are_all_pairs_under_a_key():
    rng = np.random.default_rng(5)
    for n, keys in ((1, 1), (40, 9), (700, 3), (3000, 500)):
        codes = _clustered(n, n)
        key = np.sort(rng.integers(0, keys, len(codes)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((simhash.gray_rank(codes), key))
        codes, key = codes[order], key[order]
        for front in (10, 10_000, 1 << 20):
            got = {(i, j) for a, b in simhash.GrayIndex(codes, key).own_pairs(2, front) for i, j in zip(a.tolist(), b.tolist())}
            near = (np.bitwise_count(codes[:, None] ^ codes[None]) <= 2) & (key[:, None] == key[None])
            assert got == {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(near))) if i < j}


def test_turns_bring_a_block_to_the_top(spark):
    values = np.random.default_rng(6).integers(0, 2**64, 50, dtype=np.uint64)
    df = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fp bigint").selectExpr("1L AS turn", "fp AS code", "fp")
    dealt, free = simhash._dealt(df, {1: 64})
    assert sorted(free) == [4, 5, 6] and dealt.count() == 150
    for r in dealt.collect():
        by = simhash._cuts(64)[r.turn - 4]
        x = r.fp % 2**64
        code = (x << by | x >> (64 - by)) % 2**64 if by else x
        assert r.code % 2**64 == code
        rank = int(simhash.gray_rank(np.array([code], np.uint64))[0])
        assert r["rank"] % 2**64 == rank and r.key == r.turn << 48 | rank >> free[r.turn]
    deeper, left = simhash._dealt(dealt.select("turn", "code", "fp"), free)
    assert len(left) == 9 and {bin(r.code % 2**64).count("1") - bin(r.fp % 2**64).count("1") for r in deeper.collect()} == {0}


def test_the_query_looks_every_fingerprint_up_in_the_index(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    searched = spark.sparkContext.accumulator(0)
    found = simhash.simhash_groups(docs, searched=searched).collect()
    prints = {r.fp for r in found}
    assert searched.value == 3 * len(prints)
    codes = sorted(prints)
    label = dict(zip(codes, _components(codes).tolist()))
    head: dict = {}
    for r in found:
        head[label[r.fp]] = min(head.get(label[r.fp], r.doc_id), r.doc_id)
    assert all(r.component_id == head[label[r.fp]] for r in found)


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(64, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def test_links_have_the_components_of_all_pairs(spark):
    codes = _clustered(9, 900).view(np.int64).tolist()
    df = spark.createDataFrame([(c,) for c in codes], "fp bigint")
    want = _components(codes)
    for bound in (8192, 4):
        stars = {r.node: r.root for r in components.components(simhash.fingerprint_links(df, bound)).collect()}
        roots = [stars.get(c, c) for c in codes]
        assert len({*zip(roots, want.tolist())}) == len(set(roots)) == len(set(want.tolist()))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 140)}, 201: 200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_of_documents(spark):
    rnd = random.Random(4)
    long = [rnd.choice("abcdefghij") + str(rnd.randint(0, 50)) for _ in range(4000)]
    near = [*long]
    near[17] = "changed"
    rows = [(5, " ".join(long)), (9, " ".join(near)), (7, " ".join(long).upper()), (3, None), (8, ""), (2, "quite another text here"), (2, "quite another text here"), (None, "quite another text here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS fp", "'y' AS component_id")
    found = {(r[0], r[1]): r[2] for r in simhash.simhash_groups(docs).collect()}
    prints = [simhash.fingerprint(t) for _, t in rows]
    label = _components(prints)
    for (i, _), p, k in zip(rows, prints, label):
        assert found[i, p] == min(r[0] for r, other in zip(rows, label) if other == k and r[0] is not None)
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
