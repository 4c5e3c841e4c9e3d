import random

import numpy as np

from vantloom.llm import near_copies, simhash


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _labels(texts):
    """Component of each text under similarity 0.8 or more of all pairs."""
    sets = [_shingles(t) for t in texts]
    label = list(range(len(sets)))

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            small, large = sorted((len(a), len(b)))
            if a == b or (small >= 0.8 * large and len(a & b) >= 0.8 * len(a | b)):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


def _edited(rnd, words, share):
    return " ".join(rnd.choice("uvwxyz") + str(rnd.randint(0, 999)) if rnd.random() < share else w for w in words)


def _fixture():
    rnd = random.Random(8)
    texts = []
    for n in (6, 30, 200, 600, 3000):
        for _ in range(6):
            base = [rnd.choice("abcdef") + str(rnd.randint(0, 400)) for _ in range(n)]
            texts += [" ".join(base)] + [_edited(rnd, base, share) for share in (0.002, 0.005, 0.01, 0.02, 0.03, 0.1, 0.3)]
    return texts


def test_similar_texts_and_no_others_are_grouped(spark):
    texts = _fixture()
    rows = [(1000 - k, t) for k, t in enumerate(texts)] + [(5000 + k, texts[3].upper()) for k in range(20)] + [(k, None if k % 2 else " ") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    label = _labels([t for _, t in rows])
    head = {}
    for (i, _), k in zip(rows, label):
        head[k] = min(head.get(k, i), i)
    for bound in (near_copies.KEY_BOUND, 3):
        found = {r.id: r["first"]["id"] for r in near_copies.near_components(docs, bound=bound).collect()}
        assert found == {i: head[k] for (i, _), k in zip(rows, label)}
        kept = near_copies.keep_first(docs, bound=bound).collect()
        assert sorted(r.doc_id for r in kept) == sorted(head.values())


def test_a_large_group_of_near_copies(spark):
    rnd = random.Random(4)
    base = [rnd.choice("abcdef") + str(rnd.randint(0, 400)) for _ in range(160)]
    texts = [_edited(rnd, base, rnd.choice([0.005, 0.01, 0.03, 0.06])) for _ in range(400)]
    label = _labels(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for bound in (near_copies.KEY_BOUND, 50):
        found = {r.id: r["first"]["id"] for r in near_copies.near_components(docs, bound=bound).collect()}
        assert found == dict(enumerate(label))


def test_no_similar_pair_is_lost_behind_candidates_that_are_not(spark):
    """Eight changed words of 600 each: most pairs are candidates and few of them similar, many more than the forests hold."""
    rnd = random.Random(1)
    base, texts = [f"w{rnd.randint(0, 5000)}" for _ in range(600)], []
    for k in range(150):
        words = list(base)
        for at in rnd.sample(range(600), 8):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    label = _labels(texts)
    assert 10 < len(set(label)) < 140
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for bound, set_bytes in ((near_copies.KEY_BOUND, near_copies.SET_BYTES), (40, 100_000)):
        found = {r.id: r["first"]["id"] for r in near_copies.near_components(docs, bound=bound, set_bytes=set_bytes).collect()}
        assert found == dict(enumerate(label))


def test_links_across_classes():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    for n in (1, 2, 40):
        sets = [np.unique(np.r_[base[rng.random(60) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 5)), dtype=np.uint64)]) for _ in range(n)] + [np.empty(0, np.uint64)]
        classes = rng.integers(0, 9, len(sets))
        found, whole = simhash.Forest(len(sets)), simhash.Forest(len(sets))
        same = [(a, b) for a in range(len(sets)) for b in range(a) if classes[a] == classes[b]]
        links = near_copies.similar_across(sets, classes)
        assert all(near_copies.similarity(sets[a], sets[b]) >= near_copies.SIMILARITY and classes[a] != classes[b] for a, b in links)
        similar = [(a, b) for a in range(len(sets)) for b in range(a) if near_copies.similarity(sets[a], sets[b]) >= near_copies.SIMILARITY]
        for forest, pairs in ((found, same + links), (whole, same + similar)):
            forest.add(*np.array(pairs, np.int64).reshape(-1, 2).T)
        assert len({*zip(found.label.tolist(), whole.label.tolist())}) == len(set(found.label.tolist())) == len(set(whole.label.tolist()))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (None, "q"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "another text"), (9, "ANOTHER text"), (9, "w " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS _text_hash", "2 AS id", "3 AS th", "4 AS _kept_id", "5 AS node")
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0), (r.text or "")[:12], r[2:]) for r in kept.collect())
    other = (1, 2, 3, 4, 5)
    assert got == [((False, 1), "", other), ((False, 3), "a b c d e f", other), ((False, 3), "another text", other), ((False, 9), "w w w w w w ", other), ((True, 0), "q", other)]
    assert near_copies.keep_first(docs.limit(0)).count() == 0


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    label = _labels([t for _, t in rows])
    head = {}
    for (i, _), k in zip(rows, label):
        head[k] = min(head.get(k, i), i)
    found = {r.id: r["first"]["id"] for r in near_copies.near_components(docs).collect()}
    assert found == {i: head[k] for (i, _), k in zip(rows, label)}


def test_sketches_do_not_depend_on_slices(monkeypatch):
    hashes = near_copies.shingle_hashes(" ".join(str(k % 700) for k in range(5000)))
    want = near_copies.sketch(hashes)
    monkeypatch.setattr(near_copies, "_SLICE", 64)
    assert near_copies.sketch(hashes) == want


def test_forest_is_the_heaviest():
    rng = np.random.default_rng(2)
    n = 60
    codes = np.zeros(n, np.uint64)
    sketches = rng.integers(0, 5, (n, near_copies.SKETCH)).astype(np.uint8)
    keys = np.sort(rng.integers(0, 4, n)).astype(np.uint64)
    weight = (sketches[:, None] == sketches[None]).sum(axis=2)
    for front in (1, 1 << 18):
        found = near_copies.heaviest_forests(keys, codes, sketches, 48, front=front)
        pairs = [{*zip(x.tolist(), y.tolist())} for x, y in found]
        assert len(pairs) == near_copies.FORESTS and len(set.union(*pairs)) == sum(map(len, pairs))
        a, b = found[0]
        for least in (48, 52, 56):
            part, whole = simhash.Forest(n), simhash.Forest(n)
            part.add(*(x[weight[a, b] >= least] for x in (a, b)))
            i, j = np.nonzero((weight >= least) & (keys[:, None] == keys[None]))
            whole.add(i, j)
            assert len({*zip(part.label.tolist(), whole.label.tolist())}) == len(set(part.label.tolist())) == len(set(whole.label.tolist()))
